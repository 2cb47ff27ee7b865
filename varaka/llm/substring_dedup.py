"""Removal of repeated word windows by recompression.

Spark rounds turn the words of every text into longer symbols that have one
name wherever they stand.  In a round each block of documents asks for the names of
its symbols (``blocks.Exchange``): first of its runs of one word and of the pairs
of neighbours after these are merged, then of the pairs of the symbols so named.
A pair is merged where its left part lies in one half of the alphabet and its
right part in the other.  A bucket numbers the symbols that different texts
have; the others get no name.

A symbol is fixed by the words around it: by itself, and by as many neighbours
as decide where it begins and ends.  Equal windows have the same symbols
wherever those words lie inside the window, so a window that holds the words of a
symbol without a name stands in one text only.  What is left are the windows all
of whose high-level symbols are shared (and those that hold the words of none, such as the
inside of a long run: a run is never swallowed).  Their 128-bit hashes are
verified in one more exchange: a window repeats if a smaller doc_id has it.

Equality of words is that of two independent 64-bit hashes of their bytes (``text``).

Texts equal word for word need no windows: one exchange of text digests finds
those with a smaller doc_id, which lose all their words.  However many documents
share a symbol or window, a block sends it once.

Defined cases: a null or word-less text has no words; a text shorter than a
window loses nothing; rows that repeat a doc_id are judged each by itself, and a
window is no repeat of one with the same id; a null doc_id is compared with no
one and keeps all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varaka.llm.blocks import Answers, Exchange, asked, blocks_of, distinct, spread, squeezed, unpacked_rows
from varaka.llm.stage import Tables
from varaka.llm.text import BASE, Words, grams, mix, words

WINDOW = 13
BLOCK_BYTES = 3_000_000
BUCKET_BYTES = 6_000_000
FAR = np.int64(1) << np.int64(40)
ONE, TOP = np.uint64(1), np.uint64(63)
SALTS = (0x9FB21C651E98DF25, 0xE7037ED1A0B428DB)
RESULT = "doc_id long, n_words long, n_removed long, kept string"


@dataclass
class Symbols:
    """Symbols of the texts of a run of documents, in their order.

    ``first`` and ``last`` word; ``key`` of the content; ``low`` and ``high``
    bound the words that fix the symbol (beyond the text if its edge does);
    ``new``: a run or pair of this round.
    """

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    new: np.ndarray

    def take(self, i: np.ndarray, j: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, new: np.ndarray) -> Symbols:
        """The symbols that span those from ``i`` to ``j``."""
        return Symbols(self.doc[i], self.first[i], self.last[j], key, low, high, new)

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """``low`` of the symbol before and ``high`` of the one after; far off at the ends of a text."""
        cut = self.doc[1:] != self.doc[:-1]
        return np.append(-FAR, np.where(cut, -FAR, self.low[:-1])), np.append(np.where(cut, FAR, self.high[1:]), FAR)


def letters(w: Words) -> Symbols:
    at = np.arange(len(w.hashes))
    return Symbols(w.doc_of_word(), at, at, w.hashes, at, at + 1, np.zeros(len(at), bool))


def runs(s: Symbols) -> Symbols:
    """Neighbours that are the same symbol become one."""
    if not len(s.key):
        return s
    begins = np.append(True, (s.key[1:] != s.key[:-1]) | (s.doc[1:] != s.doc[:-1]))
    i = np.flatnonzero(begins)
    j = np.append(i[1:], len(s.key)) - 1
    n = (j - i + 1).astype(np.uint64)
    before, after = s.beside()
    key = np.where(n > 1, mix(s.key[i] * np.uint64(BASE) ^ n), s.key[i])
    return s.take(i, j, key, np.minimum(s.low[i], before[i]), np.maximum(s.high[j], after[j]), n > 1)


def pairs(s: Symbols, level: int) -> Symbols:
    """Neighbours of which the left is in one half of the alphabet and the right in the other become one."""
    if not len(s.key):
        return s
    left = (mix(s.key + np.uint64(level * 0x51ED27)) >> TOP) == ONE
    pair = np.append(left[:-1] & ~left[1:] & (s.doc[:-1] == s.doc[1:]), False)
    i = np.flatnonzero(~np.append(False, pair[:-1]))
    j = i + pair[i]
    before, after = s.beside()
    low = np.where(left[i], s.low[i], np.minimum(s.low[i], before[i]))
    high = np.where(~left[j], s.high[j], np.maximum(s.high[j], after[j]))
    key = np.where(pair[i], mix(s.key[i] * np.uint64(BASE) + s.key[j] + np.uint64(level)), s.key[i])
    return s.take(i, j, key, low, high, pair[i] | s.new[i])


class Text:
    """The documents of a slice of a block, round by round."""

    def __init__(self, w: Words, use: np.ndarray):
        """``use``: the documents that are looked at."""
        self.w = w
        self.doc = w.doc_of_word()
        left = np.repeat(w.offsets[1:], np.diff(w.offsets)) - np.arange(len(self.doc))
        #: words at which a window begins that may repeat
        self.alive = (left >= WINDOW) & use[self.doc]
        self.symbols = pairs(runs(letters(w)), 1)

    def holding(self) -> np.ndarray:
        """The symbols of this round whose words lie in some window that may repeat."""
        s, count = self.symbols, np.append(0, self.alive.cumsum())
        n = len(self.alive)
        fixed = s.new & (s.low >= 0) & (s.high <= n) & (s.high - s.low <= WINDOW)
        begin = np.clip(s.high - WINDOW, 0, n)
        return np.flatnonzero(fixed & (count[np.clip(s.low + 1, 0, n)] > count[begin]))

    def named(self, at: np.ndarray, names: np.ndarray) -> None:
        """Give symbols their names; windows that hold one without a name stand alone."""
        s = self.symbols
        lone = at[names == 0]
        edge = np.zeros(len(self.alive) + 1, np.int64)
        np.add.at(edge, np.maximum(s.high[lone] - WINDOW, 0), 1)
        np.add.at(edge, s.low[lone] + 1, -1)
        self.alive &= edge[:-1].cumsum() == 0
        s.key = s.key.copy()
        s.key[at] = np.where(names > 0, mix(names.astype(np.uint64)), s.key[at])
        s.new = np.zeros(len(s.key), bool)


class Block:
    """A block's documents and what is known of them."""

    def __init__(self, data: bytes, marks: bytes, answers: Answers, step: int):
        self.rows = unpacked_rows(data)
        self.ids = self.rows.column("doc_id").to_numpy()
        marked = spread(marks).reshape(3, -1)
        self.copy = _repeats(marked, answers.step(0))
        self.texts = [Text(w, ~self.copy[w.first : w.first + len(w)]) for w in words(self.rows.column("text"), lower=False, second=step > 2)]
        for level in (1, 2):
            if step <= level:
                break
            keys, _, asked_at = self.symbols()
            names = answers.step(level)
            for t, at in asked_at:
                t.named(at, names[np.searchsorted(keys, t.symbols.key[at])])
                if level == 1:
                    t.symbols = pairs(t.symbols, 2)

    def symbols(self) -> tuple[np.ndarray, np.ndarray, list[tuple[Text, np.ndarray]]]:
        """Distinct keys of the symbols that are asked for, whether one or more documents have each, and where they are."""
        at = [(t, t.holding()) for t in self.texts]
        keys = np.concatenate([np.zeros(0, np.uint64), *(t.symbols.key[i] for t, i in at)])
        doc = np.concatenate([np.zeros(0, np.int64), *(t.symbols.doc[i] + t.w.first for t, i in at)])
        found, place = distinct(keys)
        least, most = np.full(len(found), FAR), np.full(len(found), -1)
        np.minimum.at(least, place, doc)
        np.maximum.at(most, place, doc)
        return found, 1 + (most > least), at

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(h, g, doc_id) of the windows that may repeat, and their place in the block's words."""
        parts, places, base = [np.zeros((3, 0), np.int64)], [np.zeros(0, np.int64)], 0
        for t in self.texts:
            at = np.flatnonzero(t.alive)
            h, g = (x[at[at < len(x)]] for x in window_hashes(t.w))
            parts.append(np.stack([h.view(np.int64), g.view(np.int64), self.ids[t.w.first + t.doc[at]]]))
            places.append(base + at)
            base += len(t.doc)
        return np.concatenate(parts, axis=1), np.concatenate(places)


def window_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the window that begins at each word."""
    return grams(w.hashes, WINDOW), grams(w.second, WINDOW)


def _text_digest(w: Words, hashes: np.ndarray, salt: int) -> np.ndarray:
    """64-bit digest of each document's word sequence, from one of its two hashes."""
    place = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], np.diff(w.offsets))
    each = mix(hashes * np.uint64(salt) + mix(place.astype(np.uint64) + np.uint64(salt)))
    sums = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each, out=sums[1:])
    return sums[w.offsets[1:]] - sums[w.offsets[:-1]]


def _marks(rows: pa.Table) -> bytes:
    """(h, g, doc_id) of each text; those shorter than a window get digests of their own."""
    parts = [np.zeros((2, 0), np.int64)]
    for w in words(rows.column("text"), lower=False, second=True):
        h, g = (_text_digest(w, x, s).view(np.int64) for x, s in zip((w.hashes, w.second), SALTS, strict=True))
        parts.append(np.stack([h, g]))
    return squeezed(np.concatenate([np.concatenate(parts, axis=1), rows.column("doc_id").to_numpy()[None]]).ravel())


def _groups(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (h, g, doc_id): their order by hash and id, and the place in it of each one's group's first."""
    order = np.lexsort((marked[2], marked[1], marked[0].view(np.uint64)))
    h, g = marked[0][order], marked[1][order]
    first = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(order)]
    return order, np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))


def _ask_least(block: int, marked: np.ndarray, buckets: int) -> pa.Table:
    """Ask for each different (h, g) whether another block has a smaller id than the least of this one."""
    order, head = _groups(marked)
    found = marked[:, order[np.unique(head)]]
    return asked(block, found[0].view(np.uint64), found[1:], buckets)


def _smaller_elsewhere(_: int, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    marked = np.concatenate([keys.view(np.int64)[None], numbers])
    order, head = _groups(marked)
    out = np.zeros(len(keys), np.int64)
    out[order] = marked[2][order[head]] < marked[2][order]
    return out, []


def _repeats(marked: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """Which rows a smaller id has too, given the answers to ``_ask_least``."""
    order, head = _groups(marked)
    _, group = np.unique(head, return_inverse=True)
    out = np.zeros(len(order), bool)
    out[order] = (marked[2][order] > marked[2][order[head]]) | (answer[group] > 0)
    return out


def _name(bucket: int, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Numbers from 1 on, of this bucket, for the symbols that different texts have; 0 for the others."""
    found, place = distinct(keys)
    shared = np.bincount(place, numbers[0], len(found)) > 1
    return (((bucket << 32) + shared.cumsum()) * shared)[place], []


def _cut(rows: pa.Table, texts: list[Text], copy: np.ndarray, places: np.ndarray, repeated: np.ndarray) -> pa.Table:
    """Words of each text without those that a repeated window covers."""
    kept, gone, total, base = [], [], [], 0
    covered = np.zeros(sum(len(t.doc) for t in texts) + WINDOW + 1, np.int64)
    covered[places[repeated]] += 1
    covered[places[repeated] + WINDOW] -= 1
    drop = covered.cumsum() > 0
    for t in texts:
        w, here = t.w, drop[base : base + len(t.doc)]
        base += len(t.doc)
        here = here | (copy[w.first : w.first + len(w)] & (np.diff(w.offsets) >= WINDOW))[t.doc]
        data = w.data.tobytes()
        stay = np.flatnonzero(~here)
        cut = np.searchsorted(stay, w.offsets)
        words_ = [data[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]
        kept += [b" ".join(words_[a:z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        total.append(np.diff(w.offsets))
        gone.append(np.diff(w.offsets) - np.diff(cut))
    whole = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
    return pa.table([rows.column("doc_id"), whole(total), whole(gone), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` holds the words that stay, joined by one space."""
    t = Tables(docs.sparkSession, "substring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = blocks_of(t, texts.where("doc_id is not null"), BLOCK_BYTES, _marks)
    e = Exchange(t, blocks, BUCKET_BYTES)
    buckets = e.buckets
    e.ask(lambda block, data, marks, _: _ask_least(block, spread(marks).reshape(3, -1), buckets), _smaller_elsewhere, data=False)

    def ask_symbols(step: int):
        def run(block: int, data: bytes, marks: bytes, answers: Answers) -> pa.Table:
            keys, n, _ = Block(data, marks, answers, step).symbols()
            return asked(block, keys, n[None], buckets)

        return run

    e.ask(ask_symbols(1), _name)
    e.ask(ask_symbols(2), _name)
    e.ask(lambda block, data, marks, answers: _ask_least(block, Block(data, marks, answers, 3).windows()[0], buckets), _smaller_elsewhere)

    def cut(_: int, data: bytes, marks: bytes, answers: Answers) -> pa.Table:
        b = Block(data, marks, answers, 3)
        marked, places = b.windows()
        return _cut(b.rows, b.texts, b.copy, places, _repeats(marked, answers.step(3)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.table([b.column(0), b.column(1)], names=["doc_id", "text"])
            yield from _cut(rows, [Text(w, np.zeros(len(w), bool)) for w in words(b.column(1), lower=False)], np.zeros(b.num_rows, bool), np.zeros(0, np.int64), np.zeros(0, bool)).to_batches()

    return e.map(cut, RESULT).unionByName(texts.where("doc_id is null").mapInArrow(whole, RESULT))
