"""Records and retrieval inputs: one reason per rejected record, query building, article chunks and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.functions.text import drop_numbers, stripped

# Fixed values of the workload
DOCUMENT_TYPES = ["TALEP_DILEKCE_BASVURUSU", "SIKAYET_IHBAR_BASVURUSU", "BILGI_TALEBI", "ITIRAZ_IDARI_BASVURU", "KURUMLAR_ARASI_RESMI_YAZI"]
SENDER_TYPES = ["VATANDAS", "KAMU_KURUMU", "OZEL_KURULUS", "YARGI_MERCII"]
LETTER_FIELDS = ["performed_actions", "responsible_unit", "response_type", "process_status", "result_information", "process_information", "draft"]
ADDRESS_MARKS = ["mahallesi", "caddesi", "sokak", "bulvar", " no:", "no.", "cad.", "mah."]
DEFAULT_PHRASE = "belediye gorev yetki mevzuat"
GENERIC_ACTION = r"(?i)^\s*geregi(nin)? yap[iı]lmas[iı]\.?\s*$"

#: a chunk's words, the most an article may have to stay whole, and the words that neighbours share
BODY, WHOLE, OVERLAP, SHORT = 380, 480, 64, 40


def _long(s: Column, least: int) -> Column:
    return F.coalesce(F.length(stripped(s)) >= least, F.lit(False))


def record_problem(text: Column, labels: Column, topic: Column, key_types: list[str], keys: Column | None = None, forbidden: tuple[str, ...] = ()) -> Column:
    """The first rule that a labelled record breaks, or null.

    ``labels`` is a struct of the record schema; ``keys`` are the names that
    the label object carried, where a parse kept them.  Null counts as broken.
    """
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    info = labels["key_information"]
    extra = F.lit(False) if keys is None else F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, forbidden))), F.lit(False))
    # items are judged one by one, so the first bad one tells the reason
    of_item = lambda x: F.when(bad(x["type"].isin(key_types)), "key_information_type").when(~_long(x["value"], 1), "key_information_value")
    first_bad = F.get(F.filter(F.transform(info, of_item), lambda r: r.isNotNull()), F.lit(0))
    rules = [
        (~_long(text, 40), "short_text"),
        (labels.isNull(), "no_labels"),
        (extra, "forbidden_key"),
        (bad(labels["document_type"].isin(DOCUMENT_TYPES)), "document_type"),
        (bad(labels["sender_type"].isin(SENDER_TYPES)), "sender_type"),
        (bad(labels["primary_topic"].eqNullSafe(topic)), "primary_topic"),
        (~_long(labels["requested_action"], 10), "short_action"),
        (labels["requested_action"].rlike(GENERIC_ACTION), "generic_action"),
        (info.isNull(), "no_key_information"),
        (first_bad.isNotNull(), first_bad),
        (bad(F.size(labels["missing_information"]) == 0), "missing_information"),
        (~_long(labels["summary"], 10), "short_summary"),
    ]
    return F.coalesce(*(F.when(broken, reason) for broken, reason in rules))


def generated_problem(answer: Column, response_type: Column, status: Column) -> Column:
    """Why a generated letter (JSON text) is rejected, or null: other type or status than asked for, or an empty field."""
    field = lambda k: F.get_json_object(answer, f"$.{k}")
    empty = [F.coalesce(field(k).isin("", "[]", "{}", "0", "false"), F.lit(True)) for k in LETTER_FIELDS]
    some = empty[0]
    for e in empty[1:]:
        some = some | e
    return F.coalesce(
        F.when(~field("response_type").eqNullSafe(response_type), "response_type"), F.when(~field("process_status").eqNullSafe(status), "process_status"), F.when(some, "incomplete")
    )


def build_queries(phrase: Column, action: Column) -> Column:
    """At most two queries of an analysis: the topic's phrase and the requested action.

    Numbers go; queries under eight characters and repeats go; an action that
    reads like an address is left out; without any query the phrase stands.
    """
    phrase, action = F.coalesce(phrase, F.lit("")), F.coalesce(action, F.lit(""))
    marks = F.size(F.filter(F.array(*map(F.lit, ADDRESS_MARKS)), lambda m: F.contains(F.lower(action), m)))
    first, second = drop_numbers(phrase), F.when(marks < 2, drop_numbers(F.trim(action)))
    has_first = F.length(first) >= 8
    has_second = F.coalesce(F.length(second) >= 8, F.lit(False)) & ~(has_first & (F.lower(first) == F.lower(second)))
    found = F.filter(F.array(F.when(has_first, first), F.when(has_second, second)), lambda q: q.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(drop_numbers(F.when(phrase == "", DEFAULT_PHRASE).otherwise(phrase))))


def split_queries(text: Column) -> Column:
    """The queries of a request: pieces between double pipes, blank ones dropped; the default phrase without any, or for null."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|\|"), stripped)
    found = F.filter(pieces, lambda q: q != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_PHRASE)))


def chunk_articles(docs: DataFrame, heading: str = r"(?m)(?=^Madde\s+\d+)", body: int = BODY, whole: int = WHOLE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, article, part, n_words, short, text): an article is a chunk; one over ``whole`` words becomes windows.

    Articles begin where ``heading`` splits the text and are never merged;
    windows of ``body`` words overlap inside their article only.  An article
    without words gives no chunk, ``short`` marks those under ``SHORT`` words.
    """
    articles = docs.select("doc_id", F.posexplode(F.split("text", heading, -1)).alias("article", "t"))
    worded = articles.select("doc_id", (F.col("article") + 1).alias("article"), F.filter(F.split("t", r"(?U)\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    n, step = F.size("w"), body - overlap
    parts = F.when(n <= whole, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    rows = worded.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = F.when(F.col("n") <= whole, F.col("w")).otherwise(F.slice("w", F.col("part") * step + 1, F.lit(body)))
    return rows.select("doc_id", "article", "part", F.size(cut).alias("n_words"), (F.col("n") < SHORT).alias("short"), F.array_join(cut, " ").alias("text"))


def ingest_report(chunks: DataFrame) -> DataFrame:
    """Chunks, articles, words and short articles of each document."""
    first = F.col("part") == 0
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum(first.cast("int")).alias("n_articles"), F.max("n_words").alias("longest"), F.sum((first & F.col("short")).cast("int")).alias("n_short")
    )


def draft_context(user: Column, answer: Column) -> Column:
    """The payload for a new draft as JSON text: what was asked and all of the old answer but its draft."""
    return F.to_json(F.struct(user.alias("input"), answer.dropFields("draft").alias("decision")))
