"""Plans for generated rows: batches of a topic with suggested scenarios and summaries to stay away from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.operators.ranks import ranked

BATCH, RECENT = 3, 15


def shuffled(values: list[str], *key: Column) -> Column:
    """``values`` in an order that ``key`` decides, the same in every run."""
    scored = F.transform(F.array(*map(F.lit, values)), lambda v: F.struct(F.md5(F.concat_ws("|", *key, v)).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(scored), lambda x: x["v"])


def prompt_plan(targets: DataFrame, accepted: DataFrame, scenarios: list[str], template: str, avoid_template: str, batch: int = BATCH, recent: int = RECENT, seed: int = 42) -> DataFrame:
    """(topic, batch_no, count, scenarios, avoid, prompt): the batches that fill what ``accepted`` leaves of ``targets``.

    ``targets`` (topic, target, hint, required), ``accepted`` (topic, arrival,
    summary).  A topic gets a batch of ``batch`` records for every started ``batch`` that is
    missing, each with its own shuffled scenarios and the last ``recent``
    accepted summaries, oldest first.  ``template`` holds {topic}, {count}, {hint}, {required}, {scenarios}
    and {avoid}; {avoid} is ``avoid_template`` with its {summaries}, or nothing
    where nothing is accepted.
    """
    last = ranked(accepted, ["topic"], [F.desc("arrival"), F.desc("summary")], "__r")
    counted = accepted.groupBy("topic").agg(F.count("*").alias("n"))
    listed = last.where(F.col("__r") <= recent).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), "summary"))).alias("s"))
    rows = targets.join(counted, "topic", "left").join(listed, "topic", "left")
    missing = F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0))
    rows = rows.withColumn("batches", F.ceil(missing / batch).cast("int")).where("batches > 0")
    rows = rows.withColumn("batch_no", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    suggested = F.slice(shuffled(scenarios, F.lit(str(seed)), F.col("topic"), F.col("batch_no").cast("string")), 1, batch)
    avoid = F.coalesce(F.transform("s", lambda x: x["summary"]), F.expr("cast(array() as array<string>)"))
    rows = rows.select("topic", "batch_no", F.lit(batch).alias("count"), suggested.alias("scenarios"), avoid.alias("avoid"), F.coalesce("hint", F.lit("")).alias("hint"), F.coalesce("required", F.lit("")).alias("required"))
    numbered = F.array_join(F.transform("scenarios", lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v)), "\n")
    away = F.when(F.size("avoid") > 0, F.replace(F.lit(avoid_template), F.lit("{summaries}"), F.array_join("avoid", "\n- "))).otherwise("")
    prompt = F.lit(template)
    for name, value in (("count", F.col("count").cast("string")), ("topic", F.col("topic")), ("hint", F.col("hint")), ("required", F.col("required")), ("scenarios", numbered), ("avoid", away)):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), value)
    return rows.select("topic", "batch_no", "count", "scenarios", "avoid", prompt.alias("prompt"))
