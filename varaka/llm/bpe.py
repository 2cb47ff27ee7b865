"""BPE encoding and decoding with a public vocabulary file, by batched numpy merge rounds.

The distinct words of a batch lie in one flat symbol array.  In each round the
keys of all adjacent pairs are looked up in the sorted pair keys by binary
search, and every word merges its lowest-ranked pair; rounds go on until no
word has a pair left.  A task keeps the results of short words it has met.

The file's normaliser (NFC, white space to blanks, lower case), its split
pattern and the byte alphabet are followed; the special strings in a text
become their own ids, as the file asks.  Decoding joins the token strings with
blanks, since the file names no decoder.

Defined cases: a null or empty text has no tokens and decodes to the empty
text; other columns are ignored; each input row gives one row.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varaka.llm.stage import small_batches

#: white space of the pattern's \s, as it differs from str.split's
BLANKS = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: longest chunk between blanks, and number of chunks, that a task keeps results for
KEPT_LENGTH, KEPT_CHUNKS = 48, 100_000
#: texts and bytes of text that are taken at once, and chunks that are merged at once
TEXTS, TEXT_BYTES, NEW_CHUNKS = 500, 500_000, 10_000
NO_RANK = np.iinfo(np.int64).max

OUTPUT = "doc_id long, ids binary, n_tokens long, decoded string"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest count up from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def merge_words(symbols: np.ndarray, offsets: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray, safe: np.ndarray):
    """Merge the symbols of many words (flat, cut at ``offsets``) until no ranked pair is left.

    ``keys`` are the sorted pairs (left << 32 | right).  All occurrences of a
    word's lowest pair merge in one round where ``safe`` says that its result
    takes part only in higher-ranked pairs; otherwise only the leftmost.
    """
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        pair = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        inside = np.append((keys[at] == pair) & (word[:-1] == word[1:]), False)
        at = np.append(at, 0)
        rank = np.where(inside, ranks[at], NO_RANK)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
        over = lowest == NO_RANK
        if over.any():
            done.append((word[over], symbols[over]))
            keep = ~over
            symbols, word, at, rank, lowest = symbols[keep], word[keep], at[keep], rank[keep], lowest[keep]
        hits = np.flatnonzero(rank == lowest)
        if not len(hits):
            continue
        owner = word[hits]
        leads = np.append(True, owner[1:] != owner[:-1])
        run = np.append(True, (hits[1:] != hits[:-1] + 1) | leads[1:])  # aaa: every second of a chain
        start = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
        hits = hits[(leads | safe[at[hits]]) & ((np.arange(len(hits)) - start) % 2 == 0)]
        symbols = symbols.copy()
        symbols[hits] = merged[at[hits]]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbols[order].astype(np.uint32), np.searchsorted(word[order], np.arange(len(offsets)))


class Vocabulary:
    """A vocabulary file, ready for batches of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int64)
        self.last = np.array([ids[c + suffix] for c in alphabet], np.int64)
        left, right, made = (np.array([ids[m] for m in column], np.int64) for column in zip(*((a, b, a + b) for a, b in merges), strict=True))
        rank = np.arange(len(merges))
        used = np.full(max(self.tokens) + 1, NO_RANK)
        np.minimum.at(used, left, rank)
        np.minimum.at(used, right, rank)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], rank[order], made[order]
        self.safe = used[self.merged] > self.ranks
        self.forget()

    def forget(self) -> None:
        """Drop the results that a task has kept."""
        self.kept: dict[str, tuple[bytes, str]] = {s: (np.array([i], "<u4").tobytes(), s) for s, i in self.special.items()}

    def chunks(self, text: str) -> list[str]:
        """The stretches between blanks, special strings on their own."""
        out: list[str] = []
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern and "<|" in text else ():
            out += self._split(text[at : m.start()]) + [m[0]]
            at = m.end()
        return out + self._split(text[at:]) if at else self._split(text)

    def _split(self, text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [c for c in BLANKS.split(text) if c]
        return text.split()

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """(ids, decoded) of chunks."""
        raw, ends, counts = [], [], []
        for chunk in chunks:
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            found = [p.encode() for p in self.pieces(text)]
            raw += found
            counts.append(len(found))
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(p) for p in raw], out=offsets[1:])
        symbols = self.inner[data]
        ends = offsets[1:] - 1
        symbols[ends] = self.last[data[ends]]
        ids, cut = merge_words(symbols, offsets, self.keys, self.ranks, self.merged, self.safe)
        pieces = np.zeros(len(chunks) + 1, np.int64)
        np.cumsum(counts, out=pieces[1:])
        at, tokens = cut[pieces], self.tokens
        return {c: (ids[a:b].tobytes(), " ".join([tokens[i] for i in ids[a:b].tolist()])) for c, a, b in zip(chunks, at[:-1], at[1:], strict=True)}

    def run(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text."""
        cut = [self.chunks(t) for t in texts]
        wanted = set().union(*cut)
        if len(self.kept) > KEPT_CHUNKS:
            self.kept = {c: self.kept[c] for c in wanted | self.special.keys() if c in self.kept}
        missing = list(wanted.difference(self.kept))
        new: dict[str, tuple[bytes, str]] = {}
        for i in range(0, len(missing), NEW_CHUNKS):
            new |= self.learn(missing[i : i + NEW_CHUNKS])
        long = {c: r for c, r in new.items() if len(c) > KEPT_LENGTH}
        for c in long:
            del new[c]
        self.kept.update(new)
        look = self.kept | long if long else self.kept
        found = [[look[c] for c in chunks] for chunks in cut]
        return [b"".join([f[0] for f in x]) for x in found], [" ".join([f[1] for f in x if f[1]]) for x in found]

    def decode(self, ids: bytes) -> str:
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in self.tokens])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``TEXTS`` rows, whose texts begin within ``TEXT_BYTES``."""
    begins = np.append(0, np.asarray(pa.compute.binary_length(batch.column(1)).fill_null(0)).astype(np.int64).cumsum())
    at = 0
    while at < batch.num_rows:
        stop = min(int(np.searchsorted(begins[:-1], begins[at] + TEXT_BYTES)), at + TEXTS)
        stop = max(stop, at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded): ids packed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_path())
        for batch in batches:
            for part in parts(batch):
                ids, decoded = v.run([t or "" for t in part.column(1).to_pylist()])
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), counts, pa.array(decoded, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])
        v.forget()  # a worker lives on, and serves other steps
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUTPUT)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) back to (doc_id, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_path())
        for b in batches:
            texts = pa.array([v.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")
