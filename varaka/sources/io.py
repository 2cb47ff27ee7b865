"""Readers and writers of records, chat rows, chunks, vectors, taxonomies and text pairs; schemas are always given."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = (
    "struct<document_type:string,sender_type:string,primary_topic:string,requested_action:string,"
    "key_information:array<struct<type:string,value:string>>,missing_information:array<string>,summary:string>"
)
RECORD = f"document_text string, labels {LABELS}"
CHAT = "messages array<struct<role:string,content:string>>"
CHUNK = (
    "chunk_id string, doc_id string, text string, raw_text string, article_label string, article_kind string, article_title string, law_no string,"
    "canonical_title string, page_start int, page_end int, source_files array<string>, units array<string>"
)
TAXONOMY = "units map<string,array<string>>, shared_topics map<string,array<string>>, topic_to_unit map<string,string>, topic_to_rag map<string,string>"
DECISION = "text string, esasNo string, kararNo string, kararTarihi string, source string"


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Labelled records of JSON-lines files, with the file each came from; blank lines give no row."""
    rows = spark.read.schema(RECORD).json(list(paths)).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.where("document_text is not null or labels is not null")


def read_chat(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(CHAT).json(list(paths)).where("messages is not null")


def first_of(spark: SparkSession, schema: str, paths: tuple[str, ...]) -> DataFrame:
    """The first of ``paths`` that exists, as JSON lines."""
    for path in paths:
        try:
            return spark.read.schema(schema).json(path)
        except AnalysisException:  # not there
            continue
    raise FileNotFoundError(", ".join(paths))


def read_eval_records(spark: SparkSession, *paths: str) -> DataFrame:
    """(document_text, labels) of raw or chat rows of the first path that exists; a row that is neither is an error."""
    rows = first_of(spark, f"{RECORD}, {CHAT}", paths)
    text = F.coalesce("document_text", F.get("messages", F.lit(1))["content"])
    labels = F.coalesce("labels", F.from_json(F.get("messages", F.lit(2))["content"], LABELS))
    rows = rows.where("document_text is not null or labels is not null or messages is not null").select(text.alias("document_text"), labels.alias("labels"))
    return rows.where(F.assert_true(F.col("document_text").isNotNull() & F.col("labels").isNotNull(), F.lit("neither a raw nor a chat row")).isNull())


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with ``pos``, which the table must carry: file order is part of the data."""
    return spark.read.schema(f"{CHUNK}, pos bigint").json(path)


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.schema("chunk_id string, model string, vector array<float>").parquet(path).where(F.col("model") == model).select("chunk_id", "vector")


def read_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """unit_topics, shared, routes and phrases (without all-digit tokens)."""
    row = spark.read.schema(TAXONOMY).option("multiLine", True).json(path)
    pairs = lambda c, k, v: row.select(F.explode(F.map_entries(c)).alias("e")).select(F.col("e.key").alias(k), F.col("e.value").alias(v))
    from varaka.functions.text import drop_numeric_tokens

    return {
        "unit_topics": pairs("units", "unit", "topics").select("unit", F.explode("topics").alias("topic")),
        "shared": pairs("shared_topics", "topic", "units").select("topic", F.explode("units").alias("unit")),
        "routes": pairs("topic_to_unit", "topic", "unit"),
        "phrases": pairs("topic_to_rag", "topic", "phrase").withColumn("phrase", drop_numeric_tokens(F.col("phrase"))),
    }


def read_text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(split, id, text) of one text file per sample below train, val or valid, and test, in any case."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("f"))
    split = F.lower(F.regexp_extract("f", r"(?i)/(train|valid|val|test)/", 1))
    return rows.select(F.when(split == "val", "valid").otherwise(split).alias("split"), F.regexp_extract("f", r"([^/]+)\.txt$", 1).alias("id"), F.col("value").alias("text"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISION).parquet(path)


def write_records(df: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines; as one ``array`` in a single file only where asked for, which is meant for small results."""
    if array:
        lines = df.select(F.to_json(F.struct("*")).alias("value"), F.monotonically_increasing_id().alias("at")).orderBy("at").coalesce(1)
        first = F.col("at") == F.min("at").over(Window.partitionBy())
        last = F.col("at") == F.max("at").over(Window.partitionBy())
        lines.select(F.concat(F.when(first, "[").otherwise(""), "value", F.when(last, "]").otherwise(",")).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, chat: DataFrame | None = None) -> None:
    """One folder per split, raw rows and, if given, chat rows."""
    df.write.mode("overwrite").partitionBy("split").json(f"{path}/raw")
    if chat is not None:
        chat.write.mode("overwrite").partitionBy("split").json(f"{path}/chat")


def append_split(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("split").json(path)


def write_issues(df: DataFrame, path: str) -> None:
    df.where(F.size("problems") > 0).select("idx", "status", "problems").write.mode("overwrite").json(path)


def remaining(done: DataFrame, targets: DataFrame) -> DataFrame:
    """(type, remaining) of targets (type, target) that stored rows (type) do not yet fill."""
    counted = done.groupBy("type").agg(F.count("*").alias("n"))
    return targets.join(counted, "type", "left").select("type", F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("remaining"))


def write_report(df: DataFrame, run: str, path: str) -> None:
    """A one-row report as (run, metric, value) rows."""
    names = df.columns
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names)))
    df.select(F.lit(run).alias("run"), pairs.alias("x")).select("run", "x.metric", "x.value").write.mode("append").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, else the warehouse; a local session without either setting may use its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    if spark.sparkContext.master.startswith("local[") and not spark.sparkContext.getConf().contains("spark.checkpoint.dir") and not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for what several steps of a job read; it survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: generated rows of a run
GENERATED = "type string, seq long, content string"


def checkpoint(rows: DataFrame, path: str, attempt: str) -> None:
    """Add generated rows (type, seq, content) of one ``attempt`` to the store.

    An attempt is a partition that is written whole or not at all, so one that is repeated
    replaces itself; a (type, seq) that another attempt has stored is not written again.
    """
    spark = rows.sparkSession
    done = stored_rows(spark, path, but=attempt)
    fresh = rows.select("type", F.col("seq").cast("long").alias("seq"), "content").dropDuplicates(["type", "seq"]).join(done.select("type", "seq"), ["type", "seq"], "left_anti")
    fresh = stored(fresh, "checkpoint")  # read before the store changes
    fresh.withColumn("attempt", F.lit(attempt)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("attempt").parquet(path)


def stored_rows(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """(type, seq, content) of all attempts; of a (type, seq) that two attempts wrote at the same time one row, the smaller content."""
    try:
        rows = spark.read.schema(f"{GENERATED}, attempt string").parquet(path)
    except AnalysisException:  # nothing is stored yet
        return spark.createDataFrame([], GENERATED)
    rows = rows if but is None else rows.where(F.col("attempt") != but)
    return rows.groupBy("type", "seq").agg(F.min("content").alias("content"))


def resume(wanted: DataFrame, path: str) -> DataFrame:
    """What is left of ``wanted`` (type, seq, ...): rows whose (type, seq) the store does not hold."""
    return wanted.join(stored_rows(wanted.sparkSession, path).select("type", "seq"), ["type", "seq"], "left_anti")


def read_sample_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, group) from the first JSON map of ids to metadata that exists; empty where none does."""
    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException:
            continue
        return text.select(F.explode(F.from_json("value", "map<string,struct<group:string>>")).alias("id", "m")).select("id", F.col("m.group").alias("group"))
    return spark.createDataFrame([], "id string, group string")


def with_group(samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """``samples`` (id) with the group of their metadata, else the part of the id before the first ``_``."""
    return samples.join(metadata, "id", "left").withColumn("group", F.coalesce("group", F.substring_index("id", "_", 1)))
