"""Words of whole texts as 64-bit hashes, computed for many texts at once.

Arrow hands a task the texts as one byte buffer with offsets.  A word's hash is
keyed by its length and mixes its bytes in steps of eight, all words of a slice
at once, so no Python object is made per word; words over ``LONG`` bytes are
hashed by BLAKE2b.  ``second`` asks for another hash of the same bytes under
another key, so that the two together are 128 bits that do not follow from each
other.  Equality of words means equality of these hashes in all that builds on
them: different words of the same length up to eight bytes never meet, other
pairs with a chance of 2**-64 each, whatever their structure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
#: bytes handled at once; bounds the memory of a task, never the text
SLICE_BYTES = 1 << 18
#: longest word, in bytes, that is hashed in steps of eight
LONG = 64
#: keys and factors of the two hashes
KEYS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
FACTORS = (np.uint64(1), np.uint64(0xD6E8FEB86659FD93))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: white space and ASCII punctuation
BREAKS = SPACE.copy()
BREAKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: what is kept of eight bytes, by the number of them that belong to a word
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of documents.

    ``first`` is the row of the first document, ``offsets[i]:offsets[i + 1]``
    are the words of document ``first + i``; ``starts`` and ``ends`` are byte
    positions in ``data``.
    """

    first: int
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    prefixes: list[np.ndarray]
    second: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1, salt: int = 0) -> list[np.ndarray]:
    """One or two 64-bit hashes of each stretch ``data[start:end]``."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
    lengths = ends - starts
    out = []
    for key, factor in zip(KEYS[:lanes], FACTORS, strict=False):
        h = mix(lengths.astype(np.uint64) * np.uint64(BASE) ^ key ^ np.uint64(salt))
        at, done = np.flatnonzero(lengths <= LONG), 0
        while len(at):
            part = eight[starts[at] + done] & _MASKS[np.minimum(lengths[at] - done, 8)]
            h[at] = mix(h[at] ^ part * factor)
            done += 8
            at = at[lengths[at] > done]
        out.append(h)
    for i in np.flatnonzero(lengths > LONG).tolist():
        both = blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=salt.to_bytes(8, "little")).digest()
        for k, h in enumerate(out):
            h[i] = int.from_bytes(both[8 * k : 8 * k + 8], "little")
    return out


def words(
    column: pa.Array, lower: bool = True, breaks: np.ndarray = SPACE, prefixes: tuple[int, ...] = (), second: bool = False
) -> Iterator[Words]:
    """Cut a text column into runs of documents of about ``SLICE_BYTES`` and hash their words.

    ``prefixes`` asks for hashes of the first so many bytes of each word too,
    ``second`` for another hash of each word.
    """
    data, at = text_buffer(column)
    fold = LOWER if lower else SAME
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        part, rel = data[at[i] : at[j]], at[i : j + 1] - at[i]
        inside = ~breaks[part]
        size = len(part)
        before = np.zeros(size + 1, bool)
        before[1:] = inside
        before[rel] = False
        after = np.zeros(size + 1, bool)
        after[:size] = inside
        after[rel] = False
        starts = np.flatnonzero(inside & ~before[:size])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        folded = fold[part]
        hashes, *more = word_hashes(folded, starts, ends, 1 + second)
        cut = [word_hashes(folded, starts, np.minimum(ends, starts + k), 1, k)[0] for k in prefixes]
        yield Words(i, np.searchsorted(starts, rel), hashes, starts, ends, part, cut, more[0] if second else None)
        i = j


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position; the last ``n - 1`` positions fall away."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + hashes[k : k + len(out)]
    return mix(out)


def gram_docs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each run of ``n`` words inside one document."""
    every = grams(w.hashes, n)
    limit = np.repeat(w.offsets[1:], np.diff(w.offsets))[: len(every)]
    at = np.flatnonzero(np.arange(len(every)) + n <= limit)
    return at, every[at]
