"""Tables between the steps of an operator, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, else one of our own.

    Unset, a local session gets a temporary folder and any other session a
    folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", f"file://{made}")
        return f"file://{made}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/varaka"


#: rows of whole texts that go to Python at once
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on a batch for Python has at most ``BATCH_ROWS`` rows; an executor and its workers hold several batches for each core."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Tables:
    """Parquet tables of one run in the shared folder; they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        # shuffle files go when a step's table is written, not when the driver happens to collect garbage
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in kept:
            if path := getattr(df, "kept_at", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


#: bits of a filter of keys; bounds what is broadcast
FILTER_BITS = 1 << 23


def _flagged(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with __maybe: false only where the columns of ``keys`` do not occur among them.

    The keys are hashed to a bitmap, a table of at most FILTER_BITS / 64 rows
    whatever their number; a full one only lets more rows through.
    """
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(FILTER_BITS))
    word, place = F.shiftright(slot, 6).alias("__word"), (slot % 64).cast("int").alias("__place")
    bits = keys.select(word, place).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __place)")).alias("__bits"))
    found = rows.select("*", word, place).join(F.broadcast(bits), "__word", "left")
    maybe = F.coalesce(F.getbit("__bits", F.col("__place")) == 1, F.lit(False))
    return found.withColumn("__maybe", maybe).drop("__word", "__place", "__bits")


def marked_rows(rows: DataFrame, keys: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose columns of ``keys`` occur among them, and few others (or all but these); nothing of ``rows`` is shuffled."""
    return _flagged(rows, keys).where(F.col("__maybe") == inside).drop("__maybe")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` but those whose columns of ``gone`` occur among them; only rows that a bitmap of ``gone`` lets through are shuffled."""
    return marked_rows(rows, gone, False).unionByName(marked_rows(rows, gone).join(gone, gone.columns, "left_anti"))


def dealt_join(rows: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that deals both sides by their keys and broadcasts neither.

    For ``rows`` out of an explode: Spark takes their size from the table they
    come from, of which an array counts as one element, so it would broadcast
    millions of them; a broadcast once planned stays whatever the side turns out to hold.
    """
    return rows.hint("merge").join(other, on, how)


def sampled(rows: DataFrame, label: str, limit: int, key: str) -> DataFrame:
    """At most ``limit`` rows with ``label`` 1 and as many with 0, smallest hash of ``key`` first.

    A cut of the hash, taken from the labels' counts, lets little more than
    ``limit`` rows of each through before they are sorted, whatever the number of tasks.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    out = None
    for value in (1, 0):
        share = min(1.0, (limit + 10 * limit**0.5 + 100) / max(counts.get(value, 0), 1))
        part = rows.where((F.col(label) == value) & (place < int(share * (1 << 30)))).orderBy(place, key).limit(limit)
        out = part if out is None else out.unionByName(part)
    return out


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, root) for each node, root = smallest node reachable.

    Each round points every node at the smallest of itself and its neighbours
    and contracts the edges along these pointers.  A surviving node is a local
    minimum, so at least half of the nodes of each open component vanish a
    round, and the smallest of a component never does.  Groups are only ever
    aggregated with ``min`` (combined before the shuffle) or joined (which AQE
    splits), so a hub of any degree is spread over tasks.
    """
    edges = tables.keep(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root"))
        steps.append(tables.keep(step))
        left = steps[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = steps[-1].select(F.col("node").alias("b"), F.col("root").alias("rb"))
        smaller = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, edges = edges, tables.keep(smaller)
        tables.drop(old)
    if not steps:
        return tables.spark.createDataFrame([], "node long, root long")
    roots = steps[0]
    for step in steps[1:]:
        further = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return tables.keep(roots) if len(steps) > 1 else roots
