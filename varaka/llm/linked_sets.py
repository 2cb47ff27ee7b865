"""Documents whose shingle sets are similar, as classes of equal sets and links between them.

What joins two operators that differ in how they propose pairs: a set of
candidate keys for each document and a test that dismisses pairs inside the
join (``Candidates``).  The rest is common.

1. One pass over the texts gives each document its set size, a 128-bit digest
   of its shingle set, its candidate keys and sketches.
2. Documents with one and the same set collapse into a class (their link is
   certain); the smallest doc_id stands for it.  Classes are the nodes: a
   doc_id that stands for several (rows that repeat it with other texts) names
   the first, the others get a number out of their set.
3. Where an operator says which part of its shingles a linked set must share with
   others (``probe``), keys are made only for the sets that do, and each leaves out as many of its most frequent keys as it may.  Classes that share a key meet in buckets, of which those with the same
   members are one.  No bucket is expanded into
   all its pairs: each round picks a few pivots per bucket and compares the
   other members with them.  Pairs that sizes and sketches do not dismiss are
   confirmed on the full sets, each of which is stored once, when a pair first asks
   for it.  Confirmed links merge components; used pivots leave,
   and a bucket is done once its members lie in one component.  Rounds go on
   until every bucket is done, so no pair of different components that a bucket
   holds goes uncompared.  A bucket of M classes that never link takes about
   M / 1024 rounds.

The parity bitmap of a whole set flips one of 64 * ``longs`` bits for each shingle: two
bitmaps differ in at most as many bits as the sets have different shingles, so
that test never dismisses a link.  It tells little about sets of thousands of
shingles; where ``wide`` asks for it, those have bitmaps of about as many bits
as shingles, which are compared before the sets are fetched.

Shingles are equal when their 64-bit hashes are (``text``); the two halves of a
digest come from two independent hashes of the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varaka.llm.blocks import spread, squeezed
from varaka.llm.stage import Tables, components, dealt_join, marked_rows
from varaka.llm.text import grams, mix, words

#: nodes that no doc_id names begin here
UNNAMED = 1 << 62
#: pivots per bucket in the first, second, ... round
PIVOTS = (16, 128, 1024)
SETS = "node long, shingles binary, keys array<array<long>>"


@dataclass
class Candidates:
    """How pairs are proposed: ``keys`` gives for a list of sets the keys of each and a row of numbers for each, named ``columns``, on which ``promising`` judges a pair.

    With ``probe``, keys come in groups, before each group the number of its keys that may be left out if these are the most frequent ones.
    """

    keys: Callable[[list[np.ndarray]], tuple[list, np.ndarray]]
    columns: list[str]
    promising: Callable[[], Column] | None = None
    #: 64-bit words of the parity bitmap of a set, and whether sets that have more shingles than its bits get another that grows with them
    longs: int = 16
    wide: bool = False
    #: for a list of sets, groups of values of each, of which a linked one shares at least the group's first number with other sets;
    #: where given, keys are only made for the sets of which that holds
    probe: Callable[[list[np.ndarray]], list[list[np.ndarray]]] | None = None

    @property
    def set_bits(self) -> list[str]:
        return [f"w{i}" for i in range(self.longs)]

    @property
    def sketches(self) -> list[str]:
        return [*self.columns, *self.set_bits]


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingles of each text, as 64-bit hashes, and their second hashes; empty without words."""
    for w in words(column, second=True):
        every, other = grams(w.hashes, n), grams(w.second, n)
        for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True):
            if b - a >= n:
                found, at = np.unique(every[a : b - n + 1], return_index=True)
                yield found, other[a : b - n + 1][at]
            elif b > a:
                yield tuple(grams(x[a:b], b - a) ^ np.uint64(b - a) for x in (w.hashes, w.second))
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def parity_bitmap(shingles: np.ndarray, longs: int) -> np.ndarray:
    """Odd sketch of a whole set, of a power of two of bits: each shingle flips one."""
    bits = longs * 64
    at = ((shingles * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def wide_bitmap(shingles: np.ndarray, over: int) -> bytes | None:
    """Parity bitmap of a power of two of bits, at least as many as shingles; none for sets of no more than ``over``."""
    if len(shingles) <= over:
        return None
    bits = 1 << (len(shingles) - 1).bit_length()
    at = ((shingles * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """A wide bitmap at a smaller number of bytes: neighbouring bits are added, so parities stay parities."""
    while len(x) > size:
        bits = np.unpackbits(x).reshape(-1, 2)
        x = np.packbits(bits[:, 0] ^ bits[:, 1])
    return x


def _near(p: int, q: int):
    """Of rows (n, p_n, wide, p_wide): those whose wide bitmaps differ in no more bits than linked sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c) for c in ("n", "p_n", "wide", "p_wide"))
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint8) for c in (x, y))
                size = min(len(a), len(b))
                differ = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
                if differ * (p + q) <= (n[i].as_py() + m[i].as_py()) * (q - p):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b", "ca", "cb"])

    return run


def _signatures(n: int, how: Candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets, marks, parities, wide = [], [], [], []
            for s, other in shingle_sets(batch.column(2), n):
                sets.append(s)
                marks.append((mix(s).sum(dtype=np.uint64), mix(other).sum(dtype=np.uint64)))
                parities.append(parity_bitmap(s, how.longs))
                wide.append(wide_bitmap(s, 64 * how.longs) if how.wide else None)
            keys, numbers = how.keys(sets) if how.probe is None else ([np.zeros(0, np.uint64)] * len(sets), np.zeros((len(sets), 0), np.int64))
            probes = how.probe(sets) if how.probe else [[]] * len(sets)
            marks = np.array(marks, np.uint64).view(np.int64)
            at = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            columns = np.hstack([numbers, np.array(parities)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys).view(np.int64)))]
                + [pa.array(np.ascontiguousarray(columns[:, i])) for i in range(columns.shape[1])] + [pa.array(wide, pa.binary()), _nested(probes)],
                names=["doc_id", "text_key", "n", "f1", "f2", "keys", *how.sketches, "wide", "probe"],
            )

    return run


def _nested(groups: list[list[np.ndarray]]) -> pa.Array:
    """array<array<long>> of lists of arrays."""
    flat = [g for groups_ in groups for g in groups_]
    values = pa.array(np.concatenate([np.zeros(0, np.int64), *flat]))
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(g) for g in flat])).astype(np.int32)), values)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(g) for g in groups])).astype(np.int32)), inner)


def _sets(n: int, how: Candidates):
    """Node, its packed shingle set and, where they are made late, its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s, _ in shingle_sets(batch.column(1), n)]
            packed = [squeezed(np.diff(s.view(np.int64), prepend=0)) for s in sets]
            keys = _nested(how.keys(sets)[0]) if how.probe and sets else pa.nulls(len(sets), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), keys], names=["node", "shingles", "keys"])

    return run


def _similar(p: int, q: int):
    """Of rows (ca, cb, set, set): the links (ca, cb) of the sets that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = a.as_py(), b.as_py()
                if a != last[0]:  # neighbours mostly share their first set
                    last = (a, spread(a).cumsum().view(np.uint64))
                x, y = last[1], spread(b).cumsum().view(np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if both * q >= (len(x) + len(y) - both) * p:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return run


def linked_sets(docs: DataFrame, shingle: int, similar: tuple[int, int], how: Candidates) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, component_key) for documents linked at Jaccard >= similar[0] / similar[1].

    ``text_key`` is the hash of the row's text, which tells rows with one doc_id apart;
    ``component_key`` tells components apart whose smallest doc_id is the same.
    """
    t = Tables(docs.sparkSession, "near")
    p, q = similar
    promising = _promising(p, q, how.set_bits) & how.promising() if how.promising else _promising(p, q, how.set_bits)
    schema = "doc_id long, text_key long, n int, f1 long, f2 long, keys array<long>, " + ", ".join(f"{x} long" for x in how.sketches) + ", wide binary, probe array<array<long>>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    signed = t.keep(texts.mapInArrow(_signatures(shingle, how), schema))

    same = ["n", "f1", "f2"]
    classes = signed.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    classes = t.keep(classes.select(*same, F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("text_key")))
    named = classes.groupBy("rep").agg(F.min(F.struct(*same)).alias("named"))
    unnamed = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64(*same), 2)
    classes = t.keep(classes.join(named, "rep").select(*same, "rep", "text_key", F.when(F.struct(*same) == F.col("named"), F.col("rep")).otherwise(unnamed).alias("node")))
    heads = signed.drop("doc_id").join(classes, [*same, "text_key"]).dropDuplicates(["node"])
    heads = t.keep(heads.select(F.col("node").alias("doc_id"), "rep", "text_key", "n", *how.sketches, "keys", "wide", "probe"))
    whole, signed = signed, t.keep(signed.select("doc_id", "text_key", *same))
    t.drop(whole)
    sketches = t.keep(heads.drop("keys", "probe"))
    texts_of = sketches.select(F.col("doc_id").alias("node"), F.col("rep").alias("doc_id"), "text_key")
    wide = sketches.where("wide is not null").select("doc_id", "n", "wide")
    sketches = sketches.drop("rep", "text_key", "wide")
    sets: list[DataFrame] = []

    def held(nodes: DataFrame) -> None:
        """Store the sets of ``nodes`` (node) that are not stored yet."""
        for known in sets:
            nodes = nodes.join(known, "node", "left_anti")
        wanted = t.keep(texts_of.join(nodes, "node"))
        if not wanted.isEmpty():
            found = marked_rows(texts, wanted.select("doc_id", "text_key")).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["node"])
            sets.append(t.keep(found.select("node", "text").mapInArrow(_sets(shingle, how), SETS)))

    def all_sets() -> DataFrame:
        return reduce(DataFrame.unionByName, sets) if sets else t.spark.createDataFrame([], SETS)

    if how.probe is None:
        rows = heads.select("doc_id", F.explode("keys").alias("key"))
    else:
        held(_probed(heads).withColumnRenamed("doc_id", "node"))
        rows = t.keep(_rarest(all_sets()))
    busy = rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("members"))
    busy = busy.where("pivot < last").groupBy("pivot", "last", "n", "members").agg(F.min("key").alias("key")).select("key", "pivot")
    shared = t.keep(dealt_join(rows, busy, "key").where("doc_id <> pivot"))
    t.drop(heads, rows)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Components of the links among (a, b, ca, cb)."""
        if how.wide:
            both = pairs.join(wide.select(F.col("doc_id").alias("a"), "n", "wide"), "a", "left")
            both = both.join(wide.select(F.col("doc_id").alias("b"), F.col("n").alias("p_n"), F.col("wide").alias("p_wide")), "b", "left")
            sure = F.col("wide").isNotNull() & F.col("p_wide").isNotNull()
            pairs = t.keep(both.where(~sure).select("a", "b", "ca", "cb").unionByName(both.where(sure).mapInArrow(_near(p, q), "a long, b long, ca long, cb long")))
        if how.probe is None:
            held(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        return components(t, _confirmed(all_sets().drop("keys"), pairs, p, q))

    # the first round has one pivot a bucket: few pairs, which fetch their sketches
    pairs = shared.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    side = lambda c, pre: sketches.select(F.col("doc_id").alias(c), *(F.col(x).alias(pre + x) for x in ["n", *how.sketches]))
    pairs = pairs.join(side("b", ""), "b").join(side("a", "p_"), "a").where(promising)
    pairs = t.keep(pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    tested, roots = pairs.select("a", "b"), confirmed(pairs)

    placed = t.keep(_moved(shared.select("key", F.col("doc_id").alias("comp"), "doc_id"), roots))
    t.drop(shared)
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    active = t.keep(placed.join(open_keys, "key", "left_semi").join(sketches, "doc_id"))
    t.drop(placed)

    # later rounds have more pivots, and dismiss pairs inside the join
    turn = 0
    while True:
        slot = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(PIVOTS[min(turn, len(PIVOTS) - 1)]))
        first = active.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("doc_id", "n", "comp", *how.sketches)).alias("p"))
        open_keys = active.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
        first = first.join(open_keys, "key", "left_semi")
        pivots = t.keep(first.select("key", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("doc_id", "n", "comp", *how.sketches))))
        if pivots.isEmpty():
            break
        pairs = active.join(pivots, "key").where((F.col("comp") != F.col("p_comp")) & promising)
        ahead = F.col("doc_id") < F.col("p_doc_id")
        pairs = pairs.select(
            F.least("doc_id", "p_doc_id").alias("a"), F.greatest("doc_id", "p_doc_id").alias("b"),
            F.when(ahead, F.col("comp")).otherwise(F.col("p_comp")).alias("ca"), F.when(ahead, F.col("p_comp")).otherwise(F.col("comp")).alias("cb"),
        ).distinct()
        pairs = t.keep(pairs.join(tested, ["a", "b"], "left_anti"))
        used = pivots.select("key", F.col("p_doc_id").alias("doc_id"))
        left = active.join(used, ["key", "doc_id"], "left_anti")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs.select("a", "b"))
            step = confirmed(pairs)
            left = _moved(left, step)
            roots = t.keep(_composed(roots, step))
        left = t.keep(left.select(active.columns))
        t.drop(active, pivots)
        active = left
        turn += 1
    t.drop(active, pivots, *sets)

    ids = roots.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    found = classes.select(*same, "rep", "node").join(roots.join(ids, "root").select("node", "least", "root"), "node", "left")
    found = found.select(*same, F.coalesce("least", "rep").alias("comp"), F.coalesce("root", "node").alias("component_key"))
    out = signed.select("doc_id", "text_key", *same).join(found, same, "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    mine = F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(False))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("comp").alias("component_id"), mine.alias("kept"), "text_key", "component_key")


def _probed(heads: DataFrame) -> DataFrame:
    """(doc_id) of the sets that share enough of a group of their probes with other sets."""
    groups = heads.select("doc_id", F.posexplode("probe").alias("place", "p")).select("doc_id", "place", F.col("p")[0].alias("need"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("key"))
    several = groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = dealt_join(groups, several, "key", "left_semi").groupBy("doc_id", "place").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    open_ = heads.where(F.exists("probe", lambda g: g[0] <= 0)).select("doc_id")  # too few were sampled to tell
    return met.where("n >= need").select("doc_id").union(open_).distinct()


def _rarest(sets: DataFrame) -> DataFrame:
    """(doc_id, key) of the keys that several sets have, without those of each group that it may leave out.

    All groups leave out the most frequent of their keys, ties by key, so their orders agree.
    """
    groups = sets.select(F.col("node").alias("doc_id"), F.posexplode("keys").alias("place", "g"))
    rows = groups.select("doc_id", "place", F.col("g")[0].alias("spare"), F.explode(F.slice("g", F.lit(2), F.size("g"))).alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("doc_id", "place").orderBy(F.desc("n"), F.desc("key")))
    return dealt_join(rows, several, "key").withColumn("nth", place).where("nth > spare").select("doc_id", "key")


def _composed(roots: DataFrame, step: DataFrame) -> DataFrame:
    """One map (node, root) for two, of which the second goes on from the roots of the first."""
    further = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
    old = roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return old.unionByName(step.join(roots, "node", "left_anti"))


def _moved(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with their component replaced by its root."""
    return rows.join(roots.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def _promising(p: int, q: int, set_bits: list[str]) -> Column:
    """What two linked sets must fulfil: sizes and the parity bitmaps of the sets."""
    n, m = F.col("n").cast("long"), F.col("p_n").cast("long")
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (differing(set_bits) * (p + q) <= (n + m) * (q - p))


def differing(names: list[str]) -> Column:
    """Bits in which the columns of a row differ from those of its partner."""
    return reduce(add, (F.bit_count(F.col(s).bitwiseXOR(F.col(f"p_{s}"))) for s in names))


def _confirmed(held: DataFrame, pairs: DataFrame, p: int, q: int) -> DataFrame:
    """Edges (a, b) between the components of those pairs whose full shingle sets are similar enough.

    The set of b travels to a.  Both joins are plain equi-joins, so AQE splits
    a class with very many partners over tasks.
    """
    right = pairs.join(held.withColumnRenamed("shingles", "sb"), F.col("b") == F.col("node")).drop("node")
    both = right.join(held.withColumnRenamed("shingles", "sa"), F.col("a") == F.col("node"))
    return both.select("ca", "cb", "sa", "sb").mapInArrow(_similar(p, q), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
