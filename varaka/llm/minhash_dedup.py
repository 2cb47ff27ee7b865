"""Near-duplicate classes: banded MinHash, Odd sketches, links confirmed on full shingle sets.

Each document has ``BANDS`` band keys and an Odd sketch: its MinHash samples
folded into a parity bitmap.  The population count of the XOR of two Odd
sketches estimates their similarity before a pair leaves the join.  Classes,
rounds and the confirmation on full sets are those of ``linked_sets``, where
shingles are equal when their 64-bit hashes are.

Defined cases: a null or word-less text has an empty set, links with nothing
and is its own component.  A text with fewer words than a shingle has its whole
word sequence as its one shingle.  Rows that repeat a doc_id each give a row
and are judged each by its own text.
A null doc_id never links or leads a class that has another id.  An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from varaka.llm.linked_sets import Candidates, differing, linked_sets
from varaka.llm.text import mix

#: a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**36 < 1e-6
BANDS, ROWS = 36, 5
SKETCH_LONGS = 4
#: standard deviations of the estimate left below the threshold before a pair is dismissed unseen
MARGIN = 5.5

_rng = np.random.default_rng(20240613)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_SALT = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)

SAMPLE_BITS = [f"s{i}" for i in range(SKETCH_LONGS)]


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, in blocks that stay in cache."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 256):
        block = (low[i : i + 256, None] ^ _XOR) * _MUL
        np.minimum(out, block.min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of ``samples``."""
    keys = mix(samples.astype(np.uint64) + _SALT)
    return mix(keys.reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each (function, value) sample flips one bit."""
    bits = SKETCH_LONGS * 64
    at = mix((samples.astype(np.uint64) + _SALT) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)
    flips = np.zeros((len(samples), bits), np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], at.astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1).view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """Bits in which the Odd sketches of two sets at the threshold may differ, with the margin."""
    k, bits = BANDS * ROWS, SKETCH_LONGS * 64
    lowest = threshold - MARGIN * (threshold * (1 - threshold) / k) ** 0.5
    share = (1 - np.exp(-4 * k * (1 - lowest) / bits)) / 2
    return int(np.ceil(bits * share + 3 * (bits * share * (1 - share)) ** 0.5))


def _keys(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    samples = np.array([minhashes(s) for s in sets])
    bands = band_keys(samples)
    return [bands[i] if len(s) else bands[i][:0] for i, s in enumerate(sets)], odd_sketches(samples)


def near_duplicates(docs: DataFrame, shingle: int = 4, similar: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, component_key) for documents linked at Jaccard >= similar[0] / similar[1].

    ``text_key`` is the hash of the row's text, which tells rows with one doc_id apart;
    ``component_key`` tells components apart whose smallest doc_id is the same.
    """

    def promising() -> Column:
        return differing(SAMPLE_BITS) <= most_differing_bits(similar[0] / similar[1])

    return linked_sets(docs, shingle, similar, Candidates(_keys, SAMPLE_BITS, promising))
