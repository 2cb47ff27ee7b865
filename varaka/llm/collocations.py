"""Phrase collocations of each language: counts by direct-address tiles over frequency-ranked word ids.

1. Blocks of documents send their distinct words with counts; Spark sums them.
   Only words that occur ``least`` times can stand in a candidate; these get ids
   by falling frequency, language after language, each language beginning at a
   multiple of ``TILE``.
2. Each block is written once as ids, with -1 between pieces and for rarer words.
3. A pair (i, j) belongs to the tile (i / TILE, j / TILE).  A task adds the pairs
   of its blocks: tiles with many pairs are counted densely, a pair's place in
   the tile being its address (``numpy.bincount``); the pairs of all other tiles
   are held as sorted coordinates with counts.  What a task holds is bounded:
   the coordinates are handed on whenever they grow beyond a limit.  Spark sums
   the coordinates of all tasks, so a frequent tile is no task's burden.
4. Pairs that occur ``least`` times get ids by falling frequency themselves and
   are counted with the next word in the same way: longer phrases of such pairs.
   A bitmap of these pairs, of a fixed size, keeps others from being asked for.

Words are compared as strings, all counts are exact, and scores are computed
with decimals of 38 digits (exact up to 10**15 occurrences of a phrase).

Defined cases: a null text is empty; a null lang is ``und`` (as is a lang that
says so); an empty table or one without candidates gives an empty result; words
of any length count; rows that repeat an id each count; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varaka.llm.blocks import blocks_of, spread, squeezed, unpacked_rows
from varaka.llm.stage import Tables
from varaka.llm.text import LOWER, Words, mix, words
from varaka.operators.ranks import ranked

#: bytes of text in a block
BLOCK_BYTES = 8_000_000
#: side of a tile
TILE = 512
#: a tile is counted densely once a block has a pair for every so many of its places
DENSE_SHARE = 16
#: dense tiles and coordinates that a task holds
MOST_DENSE, MOST_COORDINATES = 64, 3_000_000
#: bits of the bitmap of frequent pairs (4 MB, whatever their number)
FILTER_BITS = 1 << 25
ROWS = 200_000

PIECES = np.zeros(256, bool)
PIECES[[ord(c) for c in ".,;:!?"]] = True
PIECES[0x0A:0x0E] = True
CUTS = PIECES.copy()
CUTS[[0x20, 0x09]] = True

WORDS = "block long, local int, lang string, word string, n long"
SUMS = "code long, n long"


class Tiles:
    """Counts of pairs of ids."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        tile = (a // TILE << 32) | b // TILE
        place, found = pd.factorize(tile)
        counts = np.bincount(place, minlength=len(found))
        for k in np.argsort(-counts)[: max(0, MOST_DENSE - len(self.dense))]:
            if counts[k] * DENSE_SHARE >= TILE * TILE:
                self.dense.setdefault(int(found[k]), np.zeros(TILE * TILE, np.int64))
        direct = np.isin(found, np.fromiter(self.dense, np.int64, len(self.dense)))
        at = np.flatnonzero(direct[place])
        at = at[np.argsort(place[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(place[at])) + 1
        for part in np.split(at, cuts) if len(at) else []:
            self.dense[int(tile[part[0]])] += np.bincount(a[part] % TILE * TILE + b[part] % TILE, minlength=TILE * TILE)
        rest = ~direct[place]
        self._keep(np.sort((a[rest] << 32) | b[rest]), None)

    def _keep(self, codes: np.ndarray, n: np.ndarray | None) -> None:
        """Sorted coordinates, each once."""
        if not len(codes):
            return
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        counts = np.diff(np.append(first, len(codes))) if n is None else np.add.reduceat(n, first)
        self.runs.append((codes[first], counts))
        self.held += len(first)

    def merge(self) -> None:
        if len(self.runs) > 1:
            codes, n = (np.concatenate(x) for x in zip(*self.runs, strict=True))
            order = np.argsort(codes, kind="stable")
            self.runs, self.held = [], 0
            self._keep(codes[order], n[order])

    def full(self) -> bool:
        if self.held > MOST_COORDINATES:
            self.merge()
        return self.held > MOST_COORDINATES / 2

    def coordinates(self) -> Iterator[pa.RecordBatch]:
        """Hand on what the sparse tiles hold."""
        self.merge()
        for codes, n in self.runs:
            yield from _batches(codes, n)
        self.runs, self.held = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.coordinates()
        for tile, counts in self.dense.items():
            at = np.flatnonzero(counts)
            a, b = (tile >> 32) * TILE + at // TILE, (tile & 0xFFFFFFFF) * TILE + at % TILE
            yield from _batches((a << 32) | b, counts[at])


def _batches(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(codes), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + ROWS]), pa.array(n[i : i + ROWS].astype(np.int64))], names=["code", "n"])


def _keys(w: Words, langs: np.ndarray) -> np.ndarray:
    """A key for each word together with its document's language."""
    return mix(w.hashes ^ langs[w.first : w.first + len(w)][w.doc_of_word()])


def _read(data: bytes) -> tuple[list[Words], np.ndarray, list[str], np.ndarray]:
    """The words of a block, the key of each with its language, the languages of its documents and their number of words."""
    rows = unpacked_rows(data)
    langs = rows.column("lang").to_pylist()
    salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    found = list(words(rows.column("text"), breaks=CUTS))
    keys = np.concatenate([np.zeros(0, np.uint64), *(_keys(w, salt) for w in found)])
    return found, keys, langs, np.concatenate([np.zeros(0, np.int64), *(np.diff(w.offsets) for w in found)])


def _strings(found: list[Words], at: np.ndarray) -> pa.Array:
    """The words at the sorted places ``at`` of a block."""
    parts, base = [], 0
    for w in found:
        lo, hi = np.searchsorted(at, (base, base + len(w.starts)))
        here = at[lo:hi] - base
        base += len(w.starts)
        size = w.ends[here] - w.starts[here]
        offsets = np.append(0, size.cumsum())
        taken = np.repeat(w.starts[here] - offsets[:-1], size) + np.arange(offsets[-1])
        parts.append(pa.StringArray.from_buffers(len(here), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(LOWER[w.data[taken]])))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found, keys, langs, sizes = _read(data.as_py())
            place, _ = pd.factorize(keys.view(np.int64))
            first = np.flatnonzero(np.diff(np.maximum.accumulate(place), prepend=-1)) if len(place) else np.zeros(0, np.int64)
            doc = np.searchsorted(sizes.cumsum(), first, "right")
            columns = [np.full(len(first), block), np.arange(len(first), dtype=np.int32), pa.array(langs, pa.string()).take(pa.array(doc)), _strings(found, first), np.bincount(place, minlength=len(first))]
            whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["block", "local", "lang", "word", "n"])
            for i in range(0, len(first), ROWS):
                yield whole.slice(i, ROWS)


def _coded(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block as the ids of its words, -1 for rare words and between pieces."""
    out = []
    for data in left.column("data").to_pylist():
        found, keys, _, _ = _read(data)
        place, distinct = pd.factorize(keys.view(np.int64))
        ids = np.full(len(distinct) + 1, -1)
        ids[right.column("local").to_numpy()] = right.column("id").to_numpy()
        ids, base = ids[place], 0
        breaks = []
        for w in found:
            if len(w.starts):
                piece = np.cumsum(PIECES[w.data])[w.starts]
                new = np.append(True, piece[1:] != piece[:-1])
                new[w.offsets[:-1][w.offsets[:-1] < len(new)]] = True
                breaks.append(base + np.flatnonzero(new))
                base += len(new)
        out.append(squeezed(np.insert(ids, np.concatenate(breaks) if breaks else [], -1)))
    return pa.table([pa.array(left.column("block")), pa.array(out, pa.binary())], names=["block", "ids"])


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a pair begins, and its code."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, (ids[at] << 32) | ids[at + 1]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles = Tiles()
    for batch in batches:
        for data in batch.column(0):
            ids = spread(data.as_py())
            at, _ = _pairs(ids)
            tiles.add(ids[at], ids[at + 1])
            if tiles.full():
                yield from tiles.coordinates()
    yield from tiles.rest()


def _slot(codes: np.ndarray) -> np.ndarray:
    return (mix(codes.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bitmap that the codes of a task set."""
    bits = np.zeros(FILTER_BITS, bool)
    for b in batches:
        bits[_slot(b.column(0).to_numpy())] = True
    packed = np.packbits(bits, bitorder="little").view(np.int64)
    at = np.flatnonzero(packed)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "bits"])


class Frequent:
    """Bitmap of frequent pairs, at most ``FILTER_BITS`` bits on the driver and in each task."""

    def __init__(self, pairs: DataFrame):
        rows = pairs.select("code").mapInArrow(_bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        packed = np.zeros(FILTER_BITS // 64, np.int64)
        packed[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        self.shared = pairs.sparkSession.sparkContext.broadcast(packed.tobytes())

    def leading(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of pairs that may be frequent and are followed by another of which the same holds."""
        bits = np.frombuffer(self.shared.value, np.uint8)
        at, code = _pairs(ids)
        slot = _slot(code)
        maybe = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        both = np.flatnonzero(maybe[:-1] & maybe[1:] & (at[1:] == at[:-1] + 1))
        return at[both], code[both]


def _ask_pairs(frequent: Frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.unique(frequent.leading(spread(data.as_py()))[1])
                for i in range(0, len(codes), ROWS):
                    part = codes[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part)], names=["block", "code"])

    return run


def _longer(frequent: Frequent):
    """Counts of (frequent pair, next word) in a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tiles = Tiles()
        known = right.column("code").to_numpy()
        order = np.argsort(known)
        known, pair = known[order], right.column("id").to_numpy()[order]
        for data in left.column("ids").to_pylist() if len(known) else []:
            ids = spread(data)
            at, code = frequent.leading(ids)
            where = np.minimum(np.searchsorted(known, code), len(known) - 1)
            sure = known[where] == code
            tiles.add(pair[where[sure]], ids[at[sure] + 2])
        parts = list(tiles.rest())
        return pa.Table.from_batches(parts, pa.schema([("code", pa.int64()), ("n", pa.int64())]))

    return run


def _summed(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("code").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})").cast("long")


def collocations(docs: DataFrame, least: int = 10, covered: tuple[int, int] = (50, 100), best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of two or three words of each language.

    A pair inside a longer phrase that occurs at least covered[0] / covered[1]
    times as often is left out.
    """
    t = Tables(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = blocks_of(t, rows, BLOCK_BYTES)
    held = t.keep(blocks.select("block", "data").mapInArrow(_count_words, WORDS))

    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    counted = t.keep(held.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    starts = counted.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))  # a row for each language
    before = F.coalesce(F.sum("tiles").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("lang", (before * TILE).alias("start"))
    vocabulary = ranked(counted, ["lang"], [F.desc("f"), F.col("word")]).join(starts, "lang")
    vocabulary = t.keep(vocabulary.select("lang", "word", "f", (F.col("start") + F.col("rank") - 1).alias("id")))

    ids = held.join(vocabulary, ["lang", "word"]).select("block", "local", "id")
    coded = blocks.select("block", "data").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_coded, "block long, ids binary")
    coded = t.keep(coded)
    totals = t.keep(totals)
    t.drop(blocks, held)

    pairs = t.keep(_summed(coded.select("ids").mapInArrow(_count_pairs, SUMS), least))
    pairs = t.keep(ranked(pairs, [], [F.desc("a"), F.col("code")], "id").withColumn("id", F.col("id") - 1))
    frequent = Frequent(pairs)
    asked = coded.mapInArrow(_ask_pairs(frequent), "block long, code long").join(pairs.select("code", "id"), "code")
    longer = coded.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_longer(frequent), SUMS)
    longer = t.keep(_summed(longer, least))
    t.drop(coded)

    low = F.lit(0xFFFFFFFF)
    first, second = F.shiftright("code", 32), F.col("code").bitwiseAND(low)
    two = pairs.select("code", F.col("id").alias("pair"), "a", first.alias("i"), second.alias("j"))
    three = longer.select(first.alias("pair"), second.alias("k"), F.col("a").alias("a3")).join(two, "pair")
    three = three.select("i", "j", "k", F.col("a3").alias("a"), F.col("code").alias("code_12"), F.col("a").alias("f_12"), F.shiftleft(F.col("j"), 32).bitwiseOR(F.col("k")).alias("code_23"))
    three = t.keep(three.join(two.select(F.col("code").alias("code_23"), F.col("a").alias("f_23")), "code_23"))

    share, whole = covered
    inside = three.select(F.col("code_12").alias("code"), "a").unionByName(three.select(F.col("code_23").alias("code"), "a"))
    inside = inside.groupBy("code").agg(F.max("a").alias("longer"))
    two = two.join(inside, "code", "left").where(F.coalesce(F.col("longer") * whole < F.col("a") * share, F.lit(True)))

    word = lambda c: vocabulary.select(F.col("id").alias(c), F.col("word").alias(f"w_{c}"), F.col("f").alias(f"f_{c}"))
    lang = vocabulary.select(F.col("id").alias("i"), "lang")
    two = two.join(word("i"), "i").join(word("j"), "j").join(lang, "i")
    two = two.select("lang", F.concat_ws(" ", "w_i", "w_j").alias("phrase"), "a", F.col("f_i").alias("l"), F.col("f_j").alias("r"), score("a", "f_i", "f_j").alias("score"))
    three = three.join(word("i"), "i").join(word("j"), "j").join(word("k"), "k").join(lang, "i")
    three = three.withColumns({"s1": score("a", "f_i", "f_23"), "s2": score("a", "f_12", "f_k")})
    early = F.col("s1") <= F.col("s2")
    pick = lambda a, b: F.when(early, F.col(a)).otherwise(F.col(b))
    three = three.select("lang", F.concat_ws(" ", "w_i", "w_j", "w_k").alias("phrase"), "a", pick("f_i", "f_12").alias("l"), pick("f_23", "f_k").alias("r"), pick("s1", "s2").alias("score"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = two.unionByName(three).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)
    return found.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
