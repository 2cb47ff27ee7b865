"""Benchmark decontamination by spaced seeds.

A spaced seed hashes the words at the set positions of a fixed mask and ignores
the rest.  The seeds of all benchmark items are held sorted; every position of
every document is looked up, and each hit fixes an alignment of the document
with an item.  Along it words are compared: a document is contaminated by an
item if some ``OVERLAP`` consecutive aligned words have at most
``MISSES`` substitutions.  The masks are chosen so that any such window shows
an unbroken seed, wherever the substitutions lie.

The benchmark is a stated query set, read in blocks of ``BLOCK_CHARS``
characters; each block goes to all tasks and meets all documents in one scan,
so a larger benchmark costs more scans but no more memory.

Repetitive texts: alignments of a text and an item are at most as many as their
words together, and are found without listing the pairs of places that meet.

Words are equal when their 64-bit hashes are (``text``), lower-cased (A-Z) and cut at white space and ASCII punctuation.

Defined cases: null or empty texts and items match nothing; an item with fewer
words than the overlap matches as a whole, word for word, if it has at least
``SHORTEST`` words and nothing otherwise; repeated items and documents each
give their rows; a null doc_id or item_id is reported as null; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varaka.llm.text import BASE, BREAKS, Words, grams, mix, words

OVERLAP, MISSES, SHORTEST = 13, 2, 5
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 3, 5, 6, 7), (0, 1, 4, 5, 8, 9))
BLOCK_CHARS = 8_000_000
#: a seed that occurs more often than this in a text and in the items is met by convolution; hits that are expanded at once
OFTEN, EXPANDED = 64, 1_000_000
FILTER_BITS = 22

FOUND = "doc_id long, text_key long, item_id long, n_matched long, n_aligned long, first_word long"


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at each position where the mask fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(mask[-1] + 1))
    for k in mask:
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return mix(out)


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        found = list(words(pa.array(texts, pa.string()), breaks=BREAKS))
        self.ids = ids
        self.words = [w.hashes[a:b] for w in found for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        parts = []
        for m, mask in enumerate(MASKS):
            for i, x in enumerate(self.words):
                if len(x) >= OVERLAP:
                    s = seeds(x, mask)
                    parts.append((s + np.uint64(m), np.full(len(s), i), np.arange(len(s))))
        short: dict[int, list] = {}
        for i, x in enumerate(self.words):
            if SHORTEST <= len(x) < OVERLAP:
                short.setdefault(len(x), []).append((int(grams(x, len(x))[0]), i))
        self.short = {n: (np.array([h for h, _ in sorted(x)], np.uint64), [i for _, i in sorted(x)]) for n, x in short.items()}
        key, item, place = (np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else ([], [], [])))
        order = np.argsort(key.astype(np.uint64), kind="stable")
        self.key, self.item, self.place = key.astype(np.uint64)[order], item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item, word where the item would begin)."""
        found = [np.zeros((0, 3), np.int64)]
        for m, mask in enumerate(MASKS):
            s = seeds(w.hashes, mask) + np.uint64(m)
            at = np.flatnonzero(self.filter[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, s[at]), np.searchsorted(self.key, s[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            doc = np.searchsorted(w.offsets, at, "right") - 1
            _, group = np.unique(np.stack([doc, lo]), axis=1, return_inverse=True)
            heavy = (np.bincount(group) > OFTEN)[group] & (n > OFTEN)  # a seed that text and items repeat
            for g in np.unique(group[heavy]):
                here = np.flatnonzero(group == g)
                found += self._shifts(at[here], int(doc[here[0]]), int(lo[here[0]]), int(n[here[0]]))
            at, lo, n, doc = at[~heavy], lo[~heavy], n[~heavy], doc[~heavy]
            for part in np.array_split(np.arange(len(at)), max(1, int(n.sum()) // EXPANDED)):
                k = n[part]
                which = np.repeat(lo[part] - np.append(0, k.cumsum()[:-1]), k) + np.arange(k.sum())
                found.append(np.unique(np.stack([np.repeat(doc[part], k), self.item[which], np.repeat(at[part], k) - self.place[which]], 1), axis=0))
        rows = np.unique(np.concatenate(found), axis=0)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def _shifts(self, at: np.ndarray, doc: int, lo: int, n: int) -> list[np.ndarray]:
        """The same for one seed of one document, all of whose places meet all of an item's: the differences by convolution of their indicators."""
        out = []
        for i in np.unique(self.item[lo : lo + n]):
            place = self.place[lo : lo + n][self.item[lo : lo + n] == i]
            first, last = at[0], place[-1]
            size = int(at[-1] - first + last - place[0] + 1)
            a, b = np.zeros(size), np.zeros(size)
            a[at - first], b[last - place] = 1, 1
            differ = np.flatnonzero(np.fft.irfft(np.fft.rfft(a, 2 * size) * np.fft.rfft(b, 2 * size), 2 * size)[:size] > 0.5) + first - last
            out.append(np.stack([np.full(len(differ), doc), np.full(len(differ), i), differ], 1))
        return out

    def matches(self, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, equal words, aligned words, first word): the best alignment of each pair that counts, the earliest of equals.

        Alignments are compared longest first; those that cannot have more
        equal words than one found are not compared.
        """
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        docs, items, begins = self.hits(w)
        starts, ends = w.offsets[:-1][docs], w.offsets[1:][docs]
        lows, highs = np.maximum(starts, begins), np.minimum(ends, begins + self.lengths[items])
        for k in np.lexsort((begins, lows - highs)).tolist():
            doc, item, begin, lo, hi = int(docs[k]), int(items[k]), int(begins[k]), int(lows[k]), int(highs[k])
            if hi - lo < OVERLAP:
                break
            old = best.get((doc, item), (-1, 0, 0, 0))
            if hi - lo < old[0] or hi - lo == old[0] and begin > old[3]:
                continue
            same = w.hashes[lo:hi] == self.words[item][lo - begin : hi - begin]
            total = int(np.count_nonzero(same))
            if total < old[0] or total == old[0] and begin > old[3]:
                continue
            sums = np.append(0, same.cumsum())
            if (sums[OVERLAP:] - sums[:-OVERLAP]).max() >= OVERLAP - MISSES:
                best[doc, item] = (total, hi - lo, lo - int(starts[k]), begin)
        for n, (keys, items) in self.short.items():
            every = grams(w.hashes, n)
            lo, hi = np.searchsorted(keys, every), np.searchsorted(keys, every, "right")
            for p in np.flatnonzero(hi > lo).tolist():
                doc = int(np.searchsorted(w.offsets, p, "right")) - 1
                if p + n <= w.offsets[doc + 1]:
                    for i in items[lo[p] : hi[p]]:
                        best.setdefault((doc, i), (n, n, p - int(w.offsets[doc]), p))
        for (doc, item), found in best.items():
            yield doc, item, *found[:3]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, n_matched, n_aligned, first_word) for each document and item that it repeats; ``text_key`` is the hash of the row's text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        part = _scan(texts, spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows])))
        out = part if out is None else out.unionByName(part)
    return out


def _scan(texts: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            ids, keys, rows = b.column(0), b.column(1), []
            for w in words(b.column(2), breaks=BREAKS):
                rows += [(ids[w.first + d].as_py(), keys[w.first + d].as_py(), items.ids[i], *rest) for d, i, *rest in items.matches(w)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_key", "item_id", "n_matched", "n_aligned", "first_word"])

    return texts.mapInArrow(run, FOUND)
