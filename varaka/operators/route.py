"""Topics and units: routing, retrieval phrases, taxonomy checks, law pools and scenarios.

Topic tables are vocabularies; they are broadcast where a count shows that they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.operators.retrieve import small

DEFAULT_UNIT = "Yazı İşleri Müdürlüğü"


def with_topic(rows: DataFrame, topics: DataFrame, topic: str, value: str, default: str | None = None) -> DataFrame:
    """``rows`` with ``value`` of their topic; ``default`` where the topic is unknown or null.

    ``topics`` (topic, value) lists a topic once, so no row is repeated.
    """
    found = rows.join(small(topics.select(topic, value)), topic, "left")
    return found if default is None else found.withColumn(value, F.coalesce(value, F.lit(default)))


def route_unit(rows: DataFrame, topics: DataFrame, topic: str = "topic", unit: str = "unit") -> DataFrame:
    return with_topic(rows, topics, topic, unit, DEFAULT_UNIT)


def shared_units(rows: DataFrame, owners: DataFrame, topic: str = "topic") -> DataFrame:
    """A row for each unit that owns the row's topic; rows of unknown topics are dropped."""
    return rows.join(small(owners), topic)


def taxonomy_check(units: DataFrame, topics: DataFrame, key: str, unit: str, topic: str) -> DataFrame:
    """(unit, topic, problem): units without a topic and topics without a unit."""
    rows = units.select(key, unit).join(topics.select(key, topic), key, "full").where(F.col(unit).isNull() | F.col(topic).isNull())
    return rows.select(F.col(unit).alias("unit"), F.col(topic).alias("topic"), F.when(F.col(topic).isNull(), "unit_without_topic").otherwise("topic_without_unit").alias("problem"))


def legislation_pool(rows: DataFrame, pools: DataFrame, topic: str, law: str = "law", default: str = "DEFAULT") -> DataFrame:
    """``rows`` with the law of their topic, else the default pool's name."""
    return with_topic(rows, pools, topic, law, default)


def expand_scenarios(rows: DataFrame, statuses: list[str], barred: Column) -> DataFrame:
    """One row per process status, which ``barred``, an expression on ``status`` and the row, may exclude."""
    return rows.withColumn("status", F.explode(F.array(*map(F.lit, statuses)))).where(~F.coalesce(barred, F.lit(False)))
