"""From raw documents to token ids: five stages, each on all that the stage before it kept.

toxicity -> exact dedup -> MinHash near-dedup (five-word shingles, Jaccard 0.8)
-> benchmark decontamination -> BPE.  Every stage but the last returns the
columns of ``documents``.

Rows are told apart by doc_id and text, so rows that repeat a doc_id are judged
each by its own text.  Each filter finds its verdicts on narrow tables; then one
scan drops the rows, of which only those are shuffled that a bitmap of the
dropped ones lets through.

Defined cases, in every stage: other columns, whatever their names, pass
through; an empty table stays empty; a null text counts as empty.  A null doc_id is
judged like any other by the first, second and fourth stage (of equal texts
without any id one stays); the third keeps it, since no group has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varaka.llm import bpe, decontaminate, exact_dedup, minhash_dedup, toxicity
from varaka.llm.queries import table
from varaka.llm.stage import Tables, marked_rows, small_batches, without

KEY = ["id", "none", "text_key"]


def key_of(doc_id: Column, text_key: Column) -> list[Column]:
    """What tells a row from others, without nulls."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), doc_id.isNull().alias("none"), text_key.alias("text_key")]


def keyed(docs: DataFrame) -> DataFrame:
    """(row, id, none, text_key): whole rows inside ``row``, where their names clash with nothing."""
    return docs.select(F.struct("*").alias("row"), *key_of(F.col("doc_id"), F.xxhash64("text")))


def dropped(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id, text_key)."""
    return without(keyed(docs), gone.select(*key_of(F.col("doc_id"), F.col("text_key"))).distinct()).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of their language (0.5 where it has none)."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, calibrated=True)
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key"))
    scored = Tables(spark, "toxicity").keep(toxicity.score(rows, model, keep=("doc_id", "text_key", "lang")))
    cut = F.lit(0.5)
    for lang, value in toxicity.thresholds(scored, labels).items():
        cut = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(cut)
    return dropped(docs, scored.where(F.col("score") >= cut))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, compared after white space is normalised: that with the smallest doc_id."""
    small_batches(spark)
    several = Tables(spark, "copies").keep(exact_dedup.exact_duplicates(docs).where("group_size > 1").drop("keep_id", "group_size"))
    key = key_of(F.col("doc_id"), F.col("text_key"))
    lost = several.where("not kept").select(*key, F.lit(False).alias("stays"))
    # an id that stays may have the text in several rows
    stays = several.where("kept").groupBy("digest", *key).agg(F.count("*").alias("n"))
    once = stays.groupBy("digest").agg(F.min("text_key").alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    fates = lost.unionByName(stays.join(once, "digest").select(*KEY, (F.col("text_key") == F.col("first")).alias("stays"))).distinct()
    rows = keyed(docs)
    judged = marked_rows(rows, fates.select(*KEY)).join(fates, KEY, "left").where(F.coalesce("stays", F.lit(True)))
    judged = judged.groupBy(*KEY).agg(F.first("row").alias("row"))
    return marked_rows(rows, fates.select(*KEY), False).select("row.*").unionByName(judged.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest doc_id, of several such rows the one with the smaller hash of its text.

    Rows equal in id and text are one document.
    """
    small_batches(spark)
    found = minhash_dedup.near_duplicates(docs, shingle=5, similar=(4, 5)).where("doc_id is not null and n_shingles > 0")
    found = Tables(spark, "copies").keep(found.select("doc_id", "text_key", "kept", "component_key"))
    leads = found.where("kept").groupBy("component_key").agg(F.min("text_key").alias("first"), F.max("text_key").alias("last")).where("first < last")
    others = found.where("kept").join(leads, "component_key").where("text_key > first")
    return dropped(docs, found.where("not kept").select("doc_id", "text_key").unionByName(others.select("doc_id", "text_key")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return dropped(docs, Tables(spark, "leaks").keep(found.select("doc_id", "text_key").distinct()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its packed token ids and the digest of the decoded text."""
    found = bpe.encode_decode(docs)
    return found.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE", encode),
]

#: SQL cannot express the toxicity, decontamination and BPE stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    t = Tables(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = t.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
