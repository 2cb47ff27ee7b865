"""Intake and payload: the two jobs around a clerk's decision.

``intake`` turns a table of scanned documents and raw model answers into two
linked tables, documents with their flags and trace, and provisions; rows that
could not be read stay in it with their problem.  A clerk's decisions arrive later as rows with
a version; ``letter_payload`` merges them over what intake has routed.

Answers are kept as VARIANT, so a field may be a list, an object or a scalar and
keys outside the schema survive.  Nested values are shown as JSON text; pairs of
an object come in the order of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.functions import text as T
from varaka.operators import records as P
from varaka.operators import retrieve as R
from varaka.operators import route as O
from varaka.operators import search as Q

# Fixed values of the workload
NOTHING = ["", "yok", "-", "yok."]
NOTHING_ALONE = ["", "yok", "-"]
WAITING, REDIRECTED, OPEN = "EKSIK_BILGI_BEKLENIYOR", "YONLENDIRILDI", "INCELEMEDE"
UNTYPED, UNSAID = "bilgi", "—"
ANALYSIS = ["document_type", "sender_type", "primary_topic", "requested_action", "key_information", "missing_information", "summary"]
PAIR = "array<struct<type:string,value:string>>"


def parsed_answer(answer: Column) -> Column:
    """The JSON object of a model's answer as VARIANT, cut-off ones repaired; null without one."""
    return F.try_parse_json(T.repaired_json(answer))


def field_text(v: Column, path: str) -> Column:
    """A field of a VARIANT as text, null where it is missing or null."""
    return F.try_variant_get(v, path, "string")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _shown(v: Column) -> Column:
    return T.stripped(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def _said(s: Column) -> Column:
    return ~F.lower(s).isin(NOTHING)


def keys_of(v: Column) -> Column:
    """Names of an object's fields, those outside the schema too; null for anything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def info_pairs(v: Column) -> Column:
    """array<struct<type, value>> of information in any shape.

    An object gives a pair for each key; a list one for each entry, which may be
    an object with ``type`` or ``key`` and ``value`` or ``val``, or a scalar without a type; a scalar is one
    value.  Entries that say nothing (blank, ``yok``, ``-``, ``yok.``) are dropped,
    but a typed entry of a list stays without its value.
    """
    pair = lambda kind, value: F.struct(kind.alias("type"), value.alias("value"))
    entries = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: pair(e["key"], _shown(e["value"])))

    def entry(x: Column) -> Column:
        either = lambda a, b: T.stripped(F.coalesce(F.nullif(field_text(x, f"$.{a}"), F.lit("")), field_text(x, f"$.{b}"), F.lit("")))
        kind, value = either("type", "key"), either("value", "val")
        typed = F.when((kind != "") | _said(value), pair(F.coalesce(F.nullif(kind, F.lit("")), F.lit(UNTYPED)), F.coalesce(F.nullif(value, F.lit("")), F.lit(UNSAID))))
        return F.when(_is(x, "OBJECT"), typed).when(_said(_shown(x)), pair(F.lit(""), _shown(x)))

    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), entry), lambda p: p.isNotNull())
    alone = F.filter(F.array(pair(F.lit(""), _shown(v))), lambda p: _said(p["value"]))
    found = F.when(_is(v, "OBJECT"), F.filter(entries, lambda p: _said(p["value"]))).when(_is(v, "ARRAY"), items).otherwise(alone)
    return F.coalesce(found.cast(PAIR), F.expr(f"cast(array() as {PAIR})"))


def variant_missing(v: Column) -> Column:
    """Whether the list or scalar of missing information names any."""
    listed = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: _said(_shown(x)))
    return F.coalesce(F.when(_is(v, "ARRAY"), listed).otherwise(~F.lower(_shown(v)).isin(NOTHING_ALONE)), F.lit(False))


def complete_fields(v: Column, fields: list[str]) -> Column:
    """Whether an object has all ``fields``, none of them an empty text, an empty list or null."""
    held = F.lit(True)
    for k in fields:
        x = F.try_variant_get(v, f"$.{k}", "variant")
        empty = F.coalesce(F.try_variant_get(x, "$", "string").isin("", "[]"), F.lit(True))
        held = held & ~empty
    return _is(v, "OBJECT") & held


def labels_of(v: Column) -> Column:
    """The labels of a record as a struct of its schema; key information in any shape."""
    text = lambda k: field_text(v, f"$.{k}").alias(k)
    missing = F.try_variant_get(v, "$.missing_information", "array<string>").alias("missing_information")
    info = F.when(F.try_variant_get(v, "$.key_information", "variant").isNotNull(), info_pairs(F.try_variant_get(v, "$.key_information", "variant"))).alias("key_information")
    return F.when(v.isNotNull(), F.struct(text("document_type"), text("sender_type"), text("primary_topic"), text("requested_action"), info, missing, text("summary")))


def record_problem_of(text: Column, labels: Column, topic: Column, key_types: list[str], forbidden: tuple[str, ...]) -> Column:
    """``records.record_problem`` of labels as JSON text, of which all keys count."""
    v = F.try_parse_json(labels)
    return P.record_problem(text, labels_of(v), topic, key_types, keys_of(v), forbidden)


def intake(
    requests: DataFrame, topics: DataFrame, chunks: DataFrame, year: int, top_k: int = 8, first: int = 5, **options
) -> tuple[DataFrame, DataFrame]:
    """(documents, provisions) of ``requests`` (request_id, ocr_text, answer).

    ``topics`` (topic, unit, phrase) routes and gives a query; an unknown topic or unreadable answer
    gets the default unit and phrase.  Documents: request_id, ocr_text,
    analysis, topic, unit, queries, missing_information (flag), no_provisions
    (flag), status, trace (array<struct<agent, extra>>) and problem: null,
    ``no_text`` or ``unparsable_answer``.  Provisions: request_id, rank and the
    fields of the chunk, its text too.  ``options`` go to the search.
    """
    rows = requests.select("request_id", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), parsed_answer(F.col("answer")).alias("analysis"))
    rows = rows.withColumn("topic", field_text(F.col("analysis"), "$.primary_topic"))
    routed = rows.join(R.small(topics.select("topic", "unit", "phrase")), "topic", "left")
    queries = P.build_queries(F.col("phrase"), field_text(F.col("analysis"), "$.requested_action"))
    rows = R.stored(routed.withColumns({"unit": F.coalesce("unit", F.lit(O.DEFAULT_UNIT)), "queries": queries}).drop("phrase"), "intake")
    results, _ = Q.search(rows.select("request_id", "queries"), chunks, year, top_k, **options)
    provisions = Q.hydrate(Q.drop_boilerplate(results, first), chunks, ["text"])

    counted = provisions.groupBy("request_id").agg(F.count("*").alias("n"))
    said = F.when(T.stripped(F.col("ocr_text")) == "", "no_text").when(F.col("analysis").isNull(), "unparsable_answer")
    missing = variant_missing(F.try_variant_get("analysis", "$.missing_information", "variant"))
    step = lambda agent, extra: F.struct(F.lit(agent).alias("agent"), extra.alias("extra"))
    n = F.coalesce("n", F.lit(0))
    trace = F.array(
        step("Okuyucu", F.concat(F.length("ocr_text").cast("string"), F.lit(" kr"))), step("Analiz", F.coalesce("topic", F.lit(""))),
        step("Mevzuat", F.concat(F.size("queries").cast("string"), F.lit(" sorgu / "), n.cast("string"), F.lit(" madde"))),
    )
    documents = rows.join(counted, "request_id", "left").withColumns(
        {"missing_information": missing, "no_provisions": n == 0, "status": F.when(missing, WAITING).otherwise(OPEN), "trace": trace, "problem": said}
    )
    return documents.drop("n"), provisions


def write_intake(documents: DataFrame, provisions: DataFrame, folder: str) -> None:
    """``documents``, ``provisions`` and, beside them, the rows with a problem in ``failures``."""
    documents.where("problem is null").write.mode("overwrite").parquet(f"{folder}/documents")
    documents.where("problem is not null").write.mode("overwrite").parquet(f"{folder}/failures")
    provisions.write.mode("overwrite").parquet(f"{folder}/provisions")


DECISION = ["status", "selected", "redirect", "actions", "result"]


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The decision with the largest version of each request; of equal versions the one with the larger values.

    ``decisions`` (request_id, version, status, selected, redirect, actions,
    result) may hold late rows of any order.
    """
    newest = decisions.groupBy("request_id").agg(F.max(F.struct("version", *DECISION)).alias("d"))
    return newest.select("request_id", "d.*")


def letter_payload(documents: DataFrame, provisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(request_id, version, process_status, target_unit, n_selected, payload) of documents that have a decision.

    A redirected document goes to the unit of the decision, others to the routed
    one; provisions are those ticked, none while information is missing.
    ``payload`` is the writer's input as JSON text.
    """
    blank = lambda c: T.stripped(F.coalesce(c, F.lit("")))
    latest = latest_decisions(decisions).withColumn("status", F.coalesce(F.nullif(blank(F.col("status")), F.lit("")), F.lit(OPEN)))
    ticked = latest.where(F.col("status") != WAITING).select("request_id", F.explode(F.array_distinct("selected")).alias("rank"))
    fields = ["law", "article", "title", "text"]
    chosen = provisions.select("request_id", F.col("rank").cast("long").alias("rank"), *fields).join(ticked.select("request_id", F.col("rank").cast("long")), ["request_id", "rank"])
    chosen = chosen.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("chosen"))
    rows = documents.select("request_id", "analysis", "unit").join(latest, "request_id").join(chosen, "request_id", "left")
    dest = blank(F.col("redirect"))
    target = F.when((F.col("status") == REDIRECTED) & (dest != ""), dest).otherwise(F.coalesce(F.nullif(blank(F.col("unit")), F.lit("")), F.lit(O.DEFAULT_UNIT)))
    slim = F.transform(F.coalesce("chosen", F.expr("cast(array() as array<struct<rank:bigint,law:string,article:string,title:string,text:string>>)")), lambda x: F.struct(*(x[k].alias(k) for k in fields)))
    actions = F.filter(F.transform(F.split(F.coalesce("actions", F.lit("")), "\n"), T.stripped), lambda a: a != "")
    default = {"key_information": "{}", "missing_information": "[]"}
    part = lambda k: F.coalesce(F.try_variant_get("analysis", f"$.{k}", "variant"), F.try_parse_json(F.lit(default.get(k, '""')))).alias(k)
    payload = F.struct(
        *map(part, ANALYSIS), F.col("status").alias("process_status"), actions.alias("performed_actions"), blank(F.col("result")).alias("result_information"),
        target.alias("target_unit"), slim.alias("selected_legislation"),
    )
    return rows.select("request_id", "version", F.col("status").alias("process_status"), target.alias("target_unit"), F.size(slim).alias("n_selected"), F.to_json(payload).alias("payload"))
