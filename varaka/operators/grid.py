"""Every row of one table with every row of another, block by block.

Both tables are packed into blocks of rows, blocks are dealt to a grid of cells, and
each cell is one task that holds a bounded number of blocks of either side.  The plan is
the same for any number of rows, nothing passes through the driver but two counts, and
a cell returns what is left of it (a partial top k), so rows are never paired up as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varaka.sources.io import stored


def packed(df: DataFrame, rows: int) -> DataFrame:
    """(block, data): ``df`` as blocks of at most ``rows`` rows, cut where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def made(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t.combine_chunks())
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                t = pa.Table.from_batches(held)
                full = t.num_rows // rows * rows
                for i in range(0, full, rows):
                    yield made(t.slice(i, rows))
                held = t.slice(full).to_batches()
        if sum(x.num_rows for x in held):
            yield made(pa.Table.from_batches(held))

    return stored(df.mapInArrow(run, "block long, data binary"), "grid")


def meet(
    left: DataFrame, right: DataFrame, cell: Callable[[pa.Table, list[pa.Table]], pa.Table], schema: str, rows: tuple[int, int] = (2048, 4096), blocks: tuple[int, int] = (4, 8)
) -> DataFrame:
    """``cell`` of some left rows and some blocks of right rows, for all of either; ``blocks`` of ``rows`` rows make a cell, as a mean."""
    a, b = packed(left, rows[0]), packed(right, rows[1])
    n_a, n_b = a.count(), b.count()
    across = max(1, -(-n_a // blocks[0]))
    down = max(1, -(-n_b // blocks[1]), min(n_b, left.sparkSession.sparkContext.defaultParallelism // across))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.select(place(across).alias("i"), every(down).alias("j"), "data")
    b = b.select(every(across).alias("i"), place(down).alias("j"), "data")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        tables = [[pa.ipc.open_stream(d.as_buffer()).read_all() for d in t.column("data")] for t in (x, y)]
        if not tables[0] or not tables[1]:
            return nothing
        return cell(pa.concat_tables(tables[0]).combine_chunks(), [t.combine_chunks() for t in tables[1]])

    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    nothing = pa.table({k: pa.array([], kinds[t]) for k, t in (c.split() for c in schema.split(", "))})
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, schema)
