"""Blocks of packed documents, and exchanges in which blocks ask about keys.

A block is one row that holds the rows of about ``size`` bytes of text,
compressed.  Blocks are cut where the table is read, so making them shuffles
nothing; their table is written once and every later step reads it.

In an exchange a block sends its distinct keys, sorted and cut by the buckets
that own them, with a few numbers for each; a bucket meets all blocks' numbers
for a key and answers each block in the order of its keys.  However often a key
occurs, it comes once from each block, and what a task holds is a bucket (a
few blocks' keys, since the number of buckets follows the bytes of the table)
or a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varaka.llm.stage import Tables

ASKED = "block long, bucket int, keys binary, n binary"
ANSWERS = "block long, bucket int, answer binary, facts array<long>"
#: bytes of packed blocks that a partition of a shuffle takes
PARTITION_BYTES = 64_000_000


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, lowest bytes first: the planes of small numbers are zeros, which compress."""
    planes = values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def spread(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 8 * n, "zstd") if n else b""
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def packed_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each key among them)."""
    codes, found = pd.factorize(keys.view(np.int64))
    found = found.view(np.uint64)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[codes]


def blocks_of(t: Tables, rows: DataFrame, size: int, marks: Callable[[pa.Table], bytes] | None = None) -> DataFrame:
    """(block, size, data, marks) of ``rows``, whose last column is a text; ``marks`` tells what else to note of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            columns = [[number], [n], [packed_rows(whole)], [marks(whole) if marks else b""]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "size", "data", "marks"])

        for batch in batches:
            ends = np.asarray(pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0)).astype(np.int64).cumsum()
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = min(int(np.searchsorted(ends, before + size - n)) + 1, batch.num_rows)
                held.append(batch.slice(at, stop - at))
                n += int(ends[stop - 1]) - before
                at = stop
                if n >= size:
                    yield made()
                    number, held, n = number + 1, [], 0
        if held:
            yield made()

    return t.keep(rows.mapInArrow(run, "block long, size long, data binary, marks binary"))


def asked(block: int, keys: np.ndarray, numbers: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket of the sorted ``keys``; ``numbers`` has a row of numbers for each kind, a column for each key."""
    cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    filled = np.flatnonzero(np.diff(cut))
    pieces = [slice(cut[k], cut[k + 1]) for k in filled]
    columns = [[block] * len(filled), filled, [squeezed(np.diff(keys[p].view(np.int64), prepend=0)) for p in pieces], [squeezed(np.ascontiguousarray(numbers[:, p]).ravel()) for p in pieces]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "keys", "n"])


class Exchange:
    """The blocks of a table and what they have been answered so far."""

    def __init__(self, t: Tables, blocks: DataFrame, bucket_bytes: int):
        self.t, self.blocks, self.steps, self.answers = t, blocks, 0, None
        size, data = blocks.agg(F.sum("size"), F.sum(F.octet_length("data"))).first()
        self.buckets = max(1, int(size or 0) // bucket_bytes)
        self.parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(data or 0) // PARTITION_BYTES)

    def map(self, f: Callable[[int, bytes, bytes, Answers], pa.Table], schema: str, data: bool = True) -> DataFrame:
        """``f`` of each block's number, rows (left out without ``data``), marks and answers."""
        rows = self.blocks.select("block", F.col("data") if data else F.lit(b"").alias("data"), "marks")
        if self.answers is None:

            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for i in range(b.num_rows):
                        yield from f(*(b.column(k)[i].as_py() for k in range(3)), Answers(None)).to_batches()

            return rows.mapInArrow(alone, schema)
        names = [x.split()[0] for x in schema.split(", ")]

        def together(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:  # answers come to blocks only
                raise ValueError("answers without a block")
            return f(*(left.column(k)[0].as_py() for k in range(3)), Answers(right)).select(names)

        return rows.repartition(self.parts, "block").groupBy("block").cogroup(self.answers.groupBy("block")).applyInArrow(together, schema)

    def ask(self, f: Callable[[int, bytes, bytes, Answers], pa.Table], reply: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, list[int]]], data: bool = True) -> list[int]:
        """One exchange.  ``reply(bucket, keys, numbers)`` gives an answer for each key that was asked for, and facts, which are summed over all buckets."""

        def answer(rows: pa.Table) -> pa.Table:
            keys = [spread(x).cumsum().view(np.uint64) for x in rows.column("keys").to_pylist()]
            numbers = [spread(x).reshape(-1, len(k)) for x, k in zip(rows.column("n").to_pylist(), keys, strict=True)]
            found, facts = reply(rows.column("bucket")[0].as_py(), np.concatenate(keys), np.concatenate(numbers, axis=1))
            pieces = np.split(found, np.cumsum([len(k) for k in keys])[:-1])
            columns = [rows.column("block"), rows.column("bucket"), pa.array([squeezed(x) for x in pieces], pa.binary()), pa.array([facts] + [None] * (len(keys) - 1), pa.list_(pa.int64()))]
            return pa.table(columns, names=["block", "bucket", "answer", "facts"])

        kept = self.t.keep(self.map(f, ASKED, data).groupBy("bucket").applyInArrow(answer, ANSWERS))
        width = kept.agg(F.max(F.size("facts"))).first()[0] or 0
        facts = kept.agg(*(F.sum(F.col("facts")[k]) for k in range(width))).first() if width > 0 else []
        step = kept.select("block", "bucket", "answer", F.lit(self.steps).alias("step"))
        self.answers = step if self.answers is None else self.answers.unionByName(step)
        self.steps += 1
        return [int(x or 0) for x in facts]


class Answers:
    """What a block has been answered."""

    def __init__(self, rows: pa.Table | None):
        self.rows = rows

    def step(self, k: int) -> np.ndarray:
        """The answers of an exchange, in the order of the keys that the block asked for."""
        mine = self.rows.filter(pa.array(self.rows.column("step").to_numpy() == k))
        found = mine.column("answer").to_pylist()
        parts = [spread(found[i]) for i in np.argsort(mine.column("bucket").to_numpy())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)
