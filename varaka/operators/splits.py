"""Quotas, stratified splits and their statistics.

Ranks inside a stratum are two-step: rows are ranked inside hash buckets of the
stratum and bucket offsets are added, so a stratum that holds a third of all
rows is spread over tasks.  Order inside a stratum is by md5(key || seed).
Quotas and preceding values go by arrival, over ranges (``ranks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varaka.operators.ranks import before_each, ranked

BUCKETS = 64


def salted_rank(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """``df`` with __rank, 1.. inside ``by`` in the order of md5(key || seed).

    Buckets are leading bits of the md5, so bucket order is md5 order.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("__md5", digest).withColumn("__bucket", F.shiftright(F.conv(F.substring("__md5", 1, 2), 16, 10).cast("int"), 2))
    rows = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__md5", key)))
    sizes = rows.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*by, "__bucket", before.alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__total"))
    return rows.join(offsets, [*by, "__bucket"]).withColumn("__rank", F.col("__in") + F.col("__before")).drop("__md5", "__bucket", "__in", "__before")


def stratified_split(df: DataFrame, by: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: strata of one or two rows train only; else val, then test, then train; shares round half to even."""
    rows = salted_rank(df, [by], key, seed)
    n = F.col("__total")
    n_val = F.when(n <= 2, 0).otherwise(F.greatest(F.lit(1), F.bround(n * val).cast("int")))
    n_test = F.when(n <= 2, 0).otherwise(F.greatest(F.lit(1), F.bround(n * (1 - train - val)).cast("int")))
    return rows.withColumn("split", F.when(F.col("__rank") <= n_val, "val").when(F.col("__rank") <= n_val + n_test, "test").otherwise("train")).drop("__rank", "__total")


def trunc_split(df: DataFrame, by: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: shares are cut down to whole rows, the rest is test."""
    rows = salted_rank(df, [by], key, seed)
    a, b = F.floor(F.col("__total") * train), F.floor(F.col("__total") * val)
    return rows.withColumn("split", F.when(F.col("__rank") <= a, "train").when(F.col("__rank") <= a + b, "val").otherwise("test")).drop("__rank", "__total")


def split_stats(df: DataFrame, by: str) -> DataFrame:
    """total, train, val, test for each stratum, and over all in a row ``TOTAL``."""
    count = lambda s: F.sum((F.col("split") == s).cast("int"))
    sums = df.rollup(by).agg(F.grouping(by).alias("__all"), F.count("*").alias("total"), count("train").alias("train"), count("val").alias("val"), count("test").alias("test"))
    return sums.select(F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(by)).alias("stratum"), "total", "train", "val", "test")


def quota_fill(df: DataFrame, by: str, arrival: str, target: Column) -> DataFrame:
    """The first ``target`` rows of each topic in arrival order, whatever the size of a topic."""
    return ranked(df, [by], [F.col(arrival)], "__r").where(F.col("__r") <= target).drop("__r")


def recent_values(df: DataFrame, by: str, order: list[str], value: str, n: int = 15) -> DataFrame:
    """``df`` with the ``n`` values before each row."""
    return before_each(df, [by], [F.col(c) for c in order], value, n)


def balanced_groups(df: DataFrame, bucket: Column, key: str, n_groups: int, per_group: int, seed: int = 42) -> DataFrame:
    """(key, group, split, id): rows with a bucket in hash order, dealt to groups; 80/10/10 split, ids restart in each split."""
    rows = df.withColumn("__bucket", bucket).where("__bucket is not null")
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    top = rows.select(key, digest.alias("__md5")).orderBy("__md5", key).limit(n_groups * per_group)
    r = F.row_number().over(Window.orderBy("__md5", key)) - 1  # bounded by the limit above
    dealt = top.withColumn("__r", r).withColumn("group", F.element_at(F.array(*(F.lit(chr(65 + i)) for i in range(n_groups))), (F.col("__r") % n_groups + 1).cast("int")))
    place = F.floor(F.col("__r") / n_groups)
    dealt = dealt.withColumn("split", F.when(place < per_group * 0.8, "train").when(place < per_group * 0.9, "valid").otherwise("test"))
    number = F.row_number().over(Window.partitionBy("group", "split").orderBy("__r"))
    return dealt.withColumn("id", F.concat(F.col("group"), F.lit("_"), F.lpad(number.cast("string"), 4, "0"))).select(key, "group", "split", "id")
