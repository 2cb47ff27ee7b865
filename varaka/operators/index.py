"""A BM25 index on disk: blocks of postings, opened by later runs and extended by new chunks.

Every extension writes a segment: its postings, sorted by term and position and
cut into blocks, in pieces that hold ranges of terms; the terms with their
chunks; the chunks with their lengths.  A row of the log makes a segment visible
once all of it is written, so an extension that was cut off leaves nothing behind.

A block holds up to ``BLOCK`` postings of one term: differences of positions,
frequencies and lengths, each in as few bytes as the block needs, beside its
largest frequency and smallest length, which bound what it can contribute.
Queries read the pieces whose ranges hold one of their terms and of these the
blocks of their terms only.  Blocks that cannot lift any chunk to the score
that a query's best term alone guarantees are skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varaka.functions.text import tokenize
from varaka.operators.retrieve import B, EPSILON, K1, POOL, best_chunks, small
from varaka.sources.io import stored

#: postings of a block
BLOCK = 1024
BLOCKS = "term string, n int, first long, max_tf int, min_dl int, data binary"
POSTINGS = "term string, pos long, tf int, dl int"
LOG = "seq long, segment string, n_docs long, n_tokens long, mean_raw double, n_terms long"


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers from 0 on in the fewest bytes that hold them all."""
    for code, kind in enumerate(("u1", "<u2", "<u4", "<u8")):
        if int(x.max(initial=0)) <= np.iinfo(kind).max:
            break
    return code, x.astype(kind).tobytes()


def encode(pos: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> bytes:
    """The postings behind the first position of a block; one posting needs no bytes, its numbers stand beside the block."""
    if len(pos) == 1:
        return b""
    parts = [_narrow(np.diff(pos)), _narrow(tf), _narrow(dl)]
    return bytes(c for c, _ in parts) + b"".join(x for _, x in parts)


def decode(n: int, first: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, out = 3, []
    for code, count in zip(data[:3], (n - 1, n, n), strict=True):
        size = count << code
        out.append(np.frombuffer(data, f"<u{1 << code}", count, at).astype(np.int64))
        at += size
    return np.append(first, first + out[0].cumsum()), out[1], out[2]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings (term, pos, tf, dl) that come sorted."""

    def blocks(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        term = t.column("term")
        pos, tf, dl = (t.column(c).to_numpy() for c in ("pos", "tf", "dl"))
        new = np.append(True, np.asarray(pa.compute.not_equal(term.slice(1), term.slice(0, len(term) - 1)))) if len(term) > 1 else np.ones(len(term), bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(term))
        stop = len(begin) if last else len(begin) - 1 if len(term) - begin[-1] < BLOCK else len(begin)
        rows, rest = [], len(term)
        for k in range(stop):
            a, z = int(begin[k]), int(end[k])
            if k == len(begin) - 1 and not last:  # the term may go on: whole blocks only
                z = a + (z - a) // BLOCK * BLOCK
                rest = z
            rows += [(i, min(i + BLOCK, z)) for i in range(a, z, BLOCK)]
        if stop < len(begin):
            rest = int(begin[stop])
        at = np.array([a for a, _ in rows], np.int64)
        columns = [
            term.combine_chunks().take(pa.array(at)), pa.array([z - a for a, z in rows], pa.int32()), pa.array(pos[at]), pa.array([int(tf[a:z].max()) for a, z in rows], pa.int32()),
            pa.array([int(dl[a:z].min()) for a, z in rows], pa.int32()), pa.array([encode(pos[a:z], tf[a:z], dl[a:z]) for a, z in rows], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "n", "first", "max_tf", "min_dl", "data"]), t.slice(rest)

    import pyarrow.compute  # noqa: F401

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 20_000:
            out, rest = blocks(pa.Table.from_batches(held).combine_chunks(), False)
            yield out
            held = rest.to_batches()
    if sum(x.num_rows for x in held):
        yield blocks(pa.Table.from_batches(held).combine_chunks(), True)[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of chunks (pos, tokens, dl): a chunk holds all its tokens, so they are counted where they lie."""
    import pyarrow.compute as pc

    for b in batches:
        lists = b.column("tokens")
        words = lists.flatten().dictionary_encode()
        width = max(1, len(words.dictionary))
        of = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        key, tf = np.unique(of * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        at, term = pa.array(key // width), words.dictionary.take(pa.array(key % width))
        yield pa.RecordBatch.from_arrays([term, b.column("pos").take(at), pa.array(tf.astype(np.int32)), b.column("dl").take(at)], names=["term", "pos", "tf", "dl"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, first, tf, dl = (b.column(c).to_numpy() for c in ("n", "first", "max_tf", "min_dl"))
        alone = np.flatnonzero(n == 1)
        at, parts = [alone], [(first[alone], tf[alone], dl[alone])]
        data = b.column("data")
        for i in np.flatnonzero(n > 1).tolist():
            at.append(np.full(n[i], i))
            parts.append(decode(int(n[i]), int(first[i]), data[i].as_py()))
        at = np.concatenate(at)
        pos, tfs, dls = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(at)), pa.array(pos.astype(np.int64)), pa.array(tfs.astype(np.int32)), pa.array(dls.astype(np.int32))], names=["term", "pos", "tf", "dl"])


def _ratio(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


class StoredIndex:
    """The index in a folder that all machines share, as its log has it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        try:
            log = [r.asDict() for r in spark.read.schema(LOG).parquet(f"{self.folder}/log").orderBy("seq").collect()]  # a row for each extension
        except AnalysisException:
            log = []
        self.log = log
        self.n_docs, tokens = sum(r["n_docs"] for r in log), sum(r["n_tokens"] for r in log)
        self.avgdl = tokens / self.n_docs if self.n_docs else 0.0
        self.floor = EPSILON * log[-1]["mean_raw"] if log else 0.0

    def _read(self, name: str) -> DataFrame | None:
        out = None
        for r in self.log:
            part = self.spark.read.parquet(f"{self.folder}/segments/{r['segment']}/{name}").withColumn("segment", F.lit(r["segment"]))
            out = part if out is None else out.unionByName(part)
        return out

    def extend(self, chunks: DataFrame, text: str = "text") -> StoredIndex:
        """The index with ``chunks`` (pos, text) added; positions must be new."""
        name, at = uuid.uuid4().hex, f"{self.folder}/segments"
        tokens = stored(chunks.select(F.col("pos").cast("long").alias("pos"), tokenize(F.coalesce(text, F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens")), "index")
        tokens.select("pos", "dl").write.parquet(f"{at}/{name}/lengths")
        lengths = self.spark.read.parquet(f"{at}/{name}/lengths")
        seen = self._read("lengths")
        known = lengths.groupBy("pos").count().where("count > 1").select("pos")
        if not (known if seen is None else known.union(lengths.join(seen, "pos", "left_semi").select("pos"))).isEmpty():
            raise ValueError("a position is in the index already")
        postings = tokens.mapInArrow(_counted, POSTINGS)
        pieces = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = postings.select("term", "pos", "tf", "dl").repartitionByRange(pieces, "term", "pos").sortWithinPartitions("term", "pos").mapInArrow(_pack, BLOCKS)
        blocks.withColumn("piece", F.spark_partition_id()).write.partitionBy("piece").parquet(f"{at}/{name}/postings")
        blocks = self.spark.read.parquet(f"{at}/{name}/postings") if not lengths.where("dl > 0").isEmpty() else self.spark.createDataFrame([], f"{BLOCKS}, piece int")
        blocks.groupBy("piece").agg(F.min("term").alias("low"), F.max("term").alias("high")).write.parquet(f"{at}/{name}/bounds")
        blocks.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{at}/{name}/terms")

        found = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        n_docs = self.n_docs + found["n"]
        terms = self.spark.read.parquet(f"{at}/{name}/terms").select("term", "df")
        if self.log:
            terms = terms.unionByName(self._read("terms").select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
        mean = terms.agg(F.avg(self._raw(F.col("df"), n_docs)).alias("m"), F.count("*").alias("n")).first()
        entry = (len(self.log), name, found["n"], found["tokens"], float(mean["m"] or 0.0), mean["n"])
        self.spark.createDataFrame([entry], LOG).write.mode("append").parquet(f"{self.folder}/log")
        return StoredIndex(self.spark, self.folder)

    @staticmethod
    def _raw(df: Column, n_docs: int) -> Column:
        return F.log(F.lit(n_docs) - df + 0.5) - F.log(df + 0.5)

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df, idf) of ``terms`` (term), or of all."""
        every = self._read("terms").select("term", "df")
        every = every if terms is None else every.join(small(terms.select("term").distinct()), "term", "left_semi")
        raw = every.groupBy("term").agg(F.sum("df").alias("df")).withColumn("raw", self._raw(F.col("df"), self.n_docs))
        return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(self.floor)).otherwise(F.col("raw")).alias("idf"))

    def blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks of ``terms`` (term, ...), with its columns; pieces without one of them are not opened."""
        bounds = self._read("bounds")
        asked = terms.select("term").distinct()
        wanted = asked.join(F.broadcast(bounds), (F.col("term") >= F.col("low")) & (F.col("term") <= F.col("high"))).select("segment", "piece").distinct()
        out = None
        for segment, rows in self._by_segment(wanted.collect()).items():  # at most a row for each piece
            part = self.spark.read.parquet(f"{self.folder}/segments/{segment}/postings").where(F.col("piece").isin(rows))
            out = part if out is None else out.unionByName(part)
        out = self.spark.createDataFrame([], f"{BLOCKS}, piece int") if out is None else out
        return out.join(small(terms), "term")

    @staticmethod
    def _by_segment(rows: list) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for segment, piece in rows:
            out.setdefault(segment, []).append(piece)
        return out

    def topk(self, queries: DataFrame, pool: int = POOL) -> DataFrame:
        """(query_id, pos, score, rank) as of ``retrieve.Bm25Index.topk``: every chunk is ranked, those without a term by position."""
        asked = queries.select("query_id", F.explode_outer(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        known = small(self.frequencies(asked.where("term is not null")))
        weights = stored(asked.join(known, "term", "left").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w")), "index")
        met = weights.where("w is not null")
        near = self.blocks(met.select("term").distinct()).drop("piece")
        bound = F.greatest(F.col("w") * _ratio(F.col("max_tf"), F.col("min_dl"), self.avgdl), F.lit(0.0))
        # bounds of blocks for queries; the postings stay where they are
        rated = stored(near.drop("data").join(small(met), "term").withColumn("bound", bound), "index")

        # what a query's best term gives to its chunks is a score that the last of the pool has at least
        most = rated.groupBy("query_id", "term").agg(F.max("bound").alias("most"), F.first("w").alias("w"))
        per = Window.partitionBy("query_id")
        most = most.withColumn("others", F.sum("most").over(per) - F.col("most")).withColumn("lead", F.row_number().over(per.orderBy(F.desc("most"), "term")) == 1)
        most = stored(most.withColumn("safe", F.min("w").over(per) >= 0), "index")
        lead = rated.join(small(most.where("lead and safe").select("query_id", "term")), ["query_id", "term"], "left_semi")
        hits = self._postings(near, lead).join(small(lead.select("query_id", "term", "w").distinct()), "term")
        scores = hits.select("query_id", (F.col("w") * _ratio(F.col("tf"), F.col("dl"), self.avgdl)).alias("score"))
        least = scores.withColumn("r", F.row_number().over(per.orderBy(F.desc("score")))).where(F.col("r") == pool).select("query_id", F.col("score").alias("least"))
        kept = rated.join(small(most.select("query_id", "term", "others")), ["query_id", "term"]).join(small(least), "query_id", "left")
        kept = kept.where(F.col("least").isNull() | (F.col("bound") + F.col("others") >= F.col("least") - 1e-6))

        # chunks with those of their tokens that are asked for, and the first chunks without any
        early = self._read("lengths").orderBy("pos").limit(2 * pool).select(F.lit(None).cast("string").alias("term"), "pos", F.lit(0).alias("tf"), "dl")
        rows = self._postings(near, kept).unionByName(early)
        chunks = rows.groupBy("pos", "dl").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("tokens"))
        avgdl = self.avgdl
        gain = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        return best_chunks(chunks, self.n_docs, sum(r["n_tokens"] for r in self.log), weights, gain, None, pool)

    @staticmethod
    def _postings(blocks: DataFrame, rated: DataFrame) -> DataFrame:
        """(term, pos, tf, dl) of the blocks that ``rated`` (term, first, ...) names; each is decoded once for all queries."""
        wanted = blocks.join(small(rated.select("term", "first").distinct()), ["term", "first"], "left_semi")
        return wanted.select("term", "n", "first", "max_tf", "min_dl", "data").mapInArrow(_unpack, POSTINGS)
