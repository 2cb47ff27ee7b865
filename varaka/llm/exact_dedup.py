"""Exact dedup over a cuckoo-filter index of live digests.

A text's identity is the SHA-256 of its white-space-normalised UTF-8.  The
index is sharded by digest.  In a shard, two candidate buckets of four slots
hold 16-bit fingerprints and references; a fingerprint hit is only a hint and
is verified against the full digest stored for that slot, so the answers are
exact.  Deletion clears a verified slot.  When an insertion runs out of kicks
the filter doubles and is rebuilt from the stored keys.

Skew: each task merges the equal digests of a batch before the shuffle, so a
text that makes up a third of all rows reaches its shard as one row per batch.

Defined cases: a null text counts as empty; rows with a null doc_id belong to
their group, and lead it only if it has no other id; rows that repeat a doc_id
each count and each give a row, kept if the id is the one that stays; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.llm.stage import Tables

SLOTS, MAX_KICKS = 4, 200
#: digests of a shard; their number follows the rows
SHARD_ROWS = 2_000_000
NO_ID = np.iinfo(np.int64).max


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, "[ \\t-\\r]+", " "), F.lit(""))


class CuckooIndex:
    """Exact index of 256-bit keys with a smallest id and a row count for each."""

    def __init__(self, expected: int = 1024):
        self.size = 0
        self.keys = np.zeros((max(16, expected), 4), np.uint64)
        self.ids = np.zeros(len(self.keys), np.int64)
        self.counts = np.zeros(len(self.keys), np.int64)
        self.live = np.zeros(len(self.keys), bool)
        self.resizes = 0
        self._table(1 << max(4, int(expected / SLOTS / 0.8).bit_length()))

    def _table(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.refs = np.zeros((buckets, SLOTS), np.int64)

    def _print(self, keys: np.ndarray) -> np.ndarray:
        return (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket, prints):
        return bucket ^ ((np.asarray(prints, np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is stored, or -1.  Filter hits are verified against the stored keys."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys):
            return out
        prints, first = self._print(keys), self._first(keys)
        for bucket in (first, self._other(first, prints)):
            hits, slots = np.nonzero(self.prints[bucket] == prints[:, None])
            refs = self.refs[bucket[hits], slots]
            same = (self.keys[refs] == keys[hits]).all(axis=1)
            out[hits[same]] = refs[same]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Insert distinct keys or merge them with those that are there."""
        refs = self.locate(keys)
        old = refs >= 0
        self.ids[refs[old]] = np.minimum(self.ids[refs[old]], ids[old])
        self.counts[refs[old]] += counts[old]
        n = int((~old).sum())
        while self.size + n > len(self.keys):
            more = len(self.keys)
            self.keys = np.concatenate([self.keys, np.zeros((more, 4), np.uint64)])
            self.ids, self.counts, self.live = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.ids, self.counts, self.live))
        new = np.arange(self.size, self.size + n)
        self.keys[new], self.ids[new], self.counts[new], self.live[new] = keys[~old], ids[~old], counts[~old], True
        self.size += n
        self._place(new)

    def _place(self, refs: np.ndarray) -> None:
        while int(self.live.sum()) > 0.9 * self.buckets * SLOTS:
            return self._grow()
        prints = self._print(self.keys[refs])
        first = self._first(self.keys[refs])
        for k in range(2 * SLOTS):  # all that find a free slot, one newcomer per bucket at a time
            bucket = first if k % 2 == 0 else self._other(first, prints)
            free = (self.prints[bucket] == 0).any(axis=1)
            _, pick = np.unique(bucket, return_index=True)
            pick = pick[free[pick]]
            slot = (self.prints[bucket[pick]] == 0).argmax(axis=1)
            self.prints[bucket[pick], slot], self.refs[bucket[pick], slot] = prints[pick], refs[pick]
            rest = np.ones(len(refs), bool)
            rest[pick] = False
            refs, prints, first = refs[rest], prints[rest], first[rest]
            if not len(refs):
                return None
        for ref, mark, bucket in zip(refs, prints, first, strict=True):
            if not self._kick(int(ref), mark, int(bucket)):
                return self._grow()
        return None

    def _kick(self, ref: int, mark, bucket: int) -> bool:
        for turn in range(MAX_KICKS):
            free = np.flatnonzero(self.prints[bucket] == 0)
            slot = int(free[0]) if len(free) else turn % SLOTS
            self.prints[bucket, slot], mark, self.refs[bucket, slot], ref = mark, self.prints[bucket, slot], ref, int(self.refs[bucket, slot])
            if len(free):
                return True
            bucket = int(self._other(bucket, mark))
        return False

    def _grow(self) -> None:
        """Double the filter and rebuild it from the stored live keys."""
        self.resizes += 1
        self._table(self.buckets * 2)
        self._place(np.flatnonzero(self.live))

    def remove(self, keys: np.ndarray) -> np.ndarray:
        """Delete keys; tells which were there."""
        refs = self.locate(keys)
        there = refs >= 0
        prints, first = self._print(keys), self._first(keys)
        for bucket in (first, self._other(first, prints)):
            for i in np.flatnonzero(there):
                slot = np.flatnonzero((self.prints[bucket[i]] != 0) & (self.refs[bucket[i]] == refs[i]))
                self.prints[bucket[i], slot] = 0
        self.live[refs[there]] = False
        return there


def _keys(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _rows(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    digests = pa.array([k.tobytes() for k in keys], pa.binary())
    return pa.RecordBatch.from_arrays([digests, pa.array(ids, mask=ids == NO_ID), pa.array(counts)], names=["digest", "keep_id", "group_size"])


def _merged(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    _, at, back = np.unique(keys.view("V32").ravel(), return_index=True, return_inverse=True)
    least, total = np.full(len(at), NO_ID), np.zeros(len(at), np.int64)
    np.minimum.at(least, back, ids)
    np.add.at(total, back, counts)
    return keys[at], least, total


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _rows(*_merged(_keys(b.column(0)), b.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False), np.ones(b.num_rows, np.int64)))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        if b.num_rows:
            index.add(*_merged(_keys(b.column(0)), b.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False), b.column(2).to_numpy()))
    for i in range(0, index.size, 10_000):
        yield _rows(index.keys[i : min(i + 10_000, index.size)], index.ids[i : min(i + 10_000, index.size)], index.counts[i : min(i + 10_000, index.size)])


GROUPS = "digest binary, keep_id long, group_size long"


def digest_index(digests: DataFrame) -> DataFrame:
    """The live digests of (digest, doc_id) rows: (digest, keep_id, group_size), one row for each digest."""
    parts = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), digests.count() // SHARD_ROWS)
    return digests.select("digest", "doc_id").mapInArrow(_before, GROUPS).repartition(parts, "digest").mapInArrow(_shard, GROUPS)


def apply_changes(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after deleting the digests of ``removed`` (digest) and inserting ``added`` (digest, doc_id)."""
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), (index.count() + added.count()) // SHARD_ROWS)
    none = F.lit(None).cast("long")
    rows = (
        index.select("digest", "keep_id", "group_size", F.lit(0).alias("step"))
        .unionByName(removed.select("digest", none.alias("keep_id"), none.alias("group_size"), F.lit(1).alias("step")))
        .unionByName(added.select("digest", "doc_id").mapInArrow(_before, GROUPS).withColumn("step", F.lit(2)))
    )
    return rows.repartition(parts, "digest").sortWithinPartitions("step").mapInArrow(_changes, GROUPS)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        steps = b.column(3).to_numpy()
        for step in np.unique(steps):
            part = b.filter(pa.array(steps == step))
            keys = _keys(part.column(0))
            if step == 1:
                index.remove(np.unique(keys.view("V32").ravel()).view(np.uint64).reshape(-1, 4))
            else:
                index.add(*_merged(keys, part.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False), part.column(2).to_numpy()))
    live = np.flatnonzero(index.live)
    for i in range(0, len(live), 10_000):
        at = live[i : i + 10_000]
        yield _rows(index.keys[at], index.ids[at], index.counts[at])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept, text_key) for every row; of equal texts the smallest doc_id stays.

    ``text_key`` is the hash of the row's text as it stands, which tells rows with one doc_id apart.
    """
    t = Tables(docs.sparkSession, "exact")
    digest = F.unhex(F.sha2(normalised(F.col("text").cast("string")), 256))
    rows = t.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.xxhash64("text").alias("text_key")))
    groups = t.keep(digest_index(rows))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"), "text_key")
