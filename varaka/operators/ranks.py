"""Ranks and neighbours of rows inside groups of any size.

Rows are dealt out by ranges of (group, order), so a group that holds a third of
all rows lies in many pieces, each sorted.  A piece knows the place of each of
its rows; what stands before a piece is a sum over pieces.  No task ever holds
a group.  The pieces are written, since ranges are sampled and may differ when a
stage runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varaka.operators.retrieve import small
from varaka.sources.io import stored


def in_pieces(df: DataFrame, by: list[str], order: list[Column], pieces: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, bounds): ``df`` with ``__piece`` and ``__place`` (1.. inside its group); of each group and piece ``__before``, ``__n`` and the group's ``__total``."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    # the low 33 bits of the increasing id count the rows of a partition
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(rows.select("*", F.spark_partition_id().alias("__piece"), at.alias("__at")), "ranks")
    held = rows.groupBy(*by, "__piece").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(group.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = held.select(*by, "__piece", "__n", "__first", before.alias("__before"), F.sum("__n").over(group).alias("__total"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__piece"]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    found = rows.alias("r").join(small(bounds).alias("b"), on)
    place = F.col("r.__at") - F.col("b.__first") + F.col("b.__before") + 1
    return found.select(*(F.col(f"r.{c}") for c in df.columns), F.col("r.__piece"), place.alias("__place"), F.col("b.__total").alias("__total")), bounds


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", pieces: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... inside each group of ``by`` (nulls are a group) in ``order``; ties in any order."""
    rows, _ = in_pieces(df, by, order, pieces)
    return rows.withColumnRenamed("__place", name).drop("__piece", "__total")


def before_each(df: DataFrame, by: list[str], order: list[Column], value: str, n: int, name: str = "recent", pieces: int | None = None) -> DataFrame:
    """``df`` with ``name``: the ``n`` values before each row of its group, the last one last.

    Windows run inside pieces; a piece is handed the last ``n`` rows before it.
    """
    rows, bounds = in_pieces(df, by, order, pieces)
    rows = rows.withColumn("__own", F.lit(True))
    step = lambda c: F.floor(c / n)
    starts = bounds.where("__before > 0").select(*(F.col(c).alias(f"__s_{c}") for c in by), F.col("__piece").alias("__to"), F.col("__before").alias("__upto"))
    starts = starts.withColumn("__step", F.explode(F.array(step(F.col("__upto") - n + 1), step(F.col("__upto"))))).distinct()
    near = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in by] + [step(F.col("__place")) == F.col("__step"), F.col("__place") <= F.col("__upto"), F.col("__place") > F.col("__upto") - n]
    on = near[0]
    for k in near[1:]:
        on = on & k
    handed = rows.join(small(starts), on).select(*df.columns, F.col("__to").alias("__piece"), "__place", "__total", F.lit(False).alias("__own"))
    w = Window.partitionBy(*by, "__piece").orderBy("__place").rowsBetween(-n, -1)
    both = rows.unionByName(handed.select(rows.columns)).withColumn(name, F.collect_list(value).over(w))
    return both.where("__own").select(*df.columns, name)
