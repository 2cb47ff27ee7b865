"""Search over a table of requests: scope, candidates, pair scores, ranking rules, selection and the decision.

A request asks several queries; ``search`` answers all requests of a table in
one job.  Chunks carry (pos, text, doc_id, article_label, article_kind,
article_title, units).  Ties go to the smaller ``pos``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varaka.functions import text as T
from varaka.operators import retrieve as R
from varaka.sources.io import stored

BLEND = 0.25
FIELDS = ["doc_id", "article_label", "article_kind", "article_title", "units"]
# Fixed values of the workload
LOOSE_TITLES, LOOSE_STARTS = ["amaç", "amac", "kapsam", "dayanak", "tanımlar", "tanimlar", "tanım", "tanim"], ["amaç", "amac", "tanım", "tanim"]


def drop_blank_queries(requests: DataFrame) -> DataFrame:
    """(request_id, q_idx, query) of (request_id, queries): trimmed, blank and null ones dropped, counted from 0 without gaps."""
    kept = F.filter(F.transform("queries", lambda q: T.stripped(F.coalesce(q, F.lit("")))), lambda q: q != "")
    return requests.select("request_id", F.posexplode(kept).alias("q_idx", "query"))


def scope_reasons(requests: DataFrame, queries: DataFrame) -> DataFrame:
    """(request_id, n_queries, n_skipped, skipped, scope_reason), requests without queries too.

    ``queries`` (request_id, q_idx, query, reason) has a null reason for those in
    scope, which ``n_queries`` counts.  A request of which nothing is in scope
    has the reason of its queries, or ``multiple_out_of_scope_reasons``.
    """
    out = F.col("reason").isNotNull()
    per = queries.groupBy("request_id").agg(
        F.sum((~out).cast("int")).alias("n_queries"), F.array_sort(F.collect_list(F.when(out, F.struct("q_idx", "query")))).alias("s"), F.collect_set("reason").alias("r")
    )
    reason = F.when((F.col("n_queries") == 0) & (F.size("r") == 1), F.col("r")[0]).when((F.col("n_queries") == 0) & (F.size("r") > 1), "multiple_out_of_scope_reasons")
    rows = requests.select("request_id").join(per, "request_id", "left")
    skipped = F.coalesce(F.transform("s", lambda x: x["query"]), F.expr("cast(array() as array<string>)"))
    return rows.select("request_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), F.size(skipped).alias("n_skipped"), skipped.alias("skipped"), reason.alias("scope_reason"))


def hydrate(rows: DataFrame, chunks: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``rows`` (pos) with fields of their chunks; unknown ones are dropped.  Few rows are broadcast, the corpus never is."""
    wanted = chunks if fields is None else chunks.select("pos", *fields)
    return wanted.join(R.small(rows), "pos")


def rerank_pairs(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, pos, rank, query, text, chunk fields): what a pair scorer reads for candidates (query_id, pos, rank)."""
    return hydrate(candidates.join(queries.select("query_id", "query"), "query_id"), chunks)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of a query's different tokens that the text holds; 0 for a query without tokens."""
    asked = F.array_distinct(T.tokenize(query))
    share = F.size(F.array_intersect(asked, T.tokenize(text))) / F.nullif(F.size(asked), F.lit(0))
    return F.coalesce(F.round(share, 9), F.lit(0.0))


def score_pairs(pairs: DataFrame, scorer: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """``pairs`` (query, text) with ``score``, higher is better; a model comes as a pandas UDF of the two columns.

    Factors below one demote only scores of 0 or more, so a negative score (a
    raw logit) is an error.
    """
    score = scorer(F.col("query"), F.col("text")).cast("double")
    scored = pairs.withColumn("score", score)
    return scored.withColumn("score", F.when(F.col("score") < 0, F.raise_error(F.lit("a pair score is below 0")).cast("double")).otherwise(F.col("score")))


def blend(rows: DataFrame, weight: float = BLEND) -> DataFrame:
    """``rows`` (query_id, pos, query, reranked, retrieved) with ``blended``, the place after weighted rank fusion.

    A null rank stands for a chunk outside that list.  Citation queries keep
    the reranked order, as do all with a weight of 0 or less.
    """
    mixed = F.lit(weight > 0) & ~T.is_citation_query(F.col("query"))
    part = lambda rank, w: F.coalesce(F.lit(float(w)) / (R.RRF_K + F.col(rank)), F.lit(0.0))
    score = F.round(part("reranked", 1.0) + F.when(mixed, part("retrieved", weight)).otherwise(0.0), 12)
    seen = F.when(F.col("reranked").isNotNull(), F.struct(F.lit(0), F.col("reranked").cast("long"))).otherwise(F.struct(F.lit(1), F.col("retrieved").cast("long")))
    order = Window.partitionBy("query_id").orderBy(F.desc("__score"), "__seen")
    kept = rows.where(F.col("reranked").isNotNull() | mixed).withColumn("__score", score).withColumn("__seen", seen)
    return kept.withColumn("blended", F.row_number().over(order)).drop("__score", "__seen")


def rerank_order(scored: DataFrame, weight: float = BLEND) -> DataFrame:
    """Scored pairs with their ``place``: by score times article factor, ties by the blended order.

    ``scored`` has (query_id, query, pos, rank, score) and the chunk fields;
    all windows share one exchange.
    """
    per = Window.partitionBy("query_id")
    rows = scored.withColumn("reranked", F.row_number().over(per.orderBy(F.desc("score"), "rank"))).withColumn("retrieved", F.col("rank"))
    factor = R.article_factor(F.col("query"), F.col("article_label"), F.col("article_kind"), F.col("article_title"))
    rows = blend(rows, weight).withColumn("__key", F.round(F.col("score") * factor, 9))
    return rows.withColumn("place", F.row_number().over(per.orderBy(F.desc("__key"), "blended"))).drop("__key", "reranked", "retrieved")


def fuse_scores(rows: DataFrame, keys: list[str], score: str, order: str, source: str) -> DataFrame:
    """(keys, best, sources): the best score of each key and its sources in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, source))), lambda x: x[source])
    return rows.groupBy(*keys).agg(F.max(score).alias("best"), listed.alias("sources"))


def article_dedup(ranked: DataFrame, request: str, article: list[str], order: str = "rank") -> DataFrame:
    """The first row of each article of a request."""
    w = Window.partitionBy(request, *article).orderBy(order)
    return ranked.withColumn("__copy", F.row_number().over(w)).where("__copy = 1").drop("__copy")


def final_order(rows: DataFrame) -> DataFrame:
    """(request_id, pos, display, ...) with ``rank`` by the display score."""
    w = Window.partitionBy("request_id").orderBy(F.desc("display"), "pos")
    return rows.withColumn("rank", F.row_number().over(w))


def search(
    requests: DataFrame, chunks: DataFrame, year: int, top_k: int = 8, unit: str | None = None, abstain: bool = True, least: float | None = None, coverage: bool = True,
    max_per_document: int | None = None, dense: Callable[[DataFrame], DataFrame] | None = None, scorer: Callable[[Column, Column], Column] = token_overlap,
    weight: float = BLEND, index: R.Bm25Index | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, decisions) of ``requests`` (request_id, queries array).

    Queries out of scope are skipped when abstaining.  For the others BM25 and
    ``dense``, a function from (query_id, query) to a ranking (query_id, pos,
    rank), give candidates, ``scorer`` reorders them, the orders of a request's
    queries are fused, a unit and the article factor weigh, every query forces
    its best article, and the selection keeps to the cap on documents.
    Results: request_id, rank, pos, chunk fields, display, raw, fused, score,
    sources.  Decisions: one row per request: answerable, reason, top_score,
    margin, skipped.
    """
    queries = drop_blank_queries(requests)
    reason = T.classify_scope(F.col("query"), year)
    queries = queries.withColumn("reason", F.when(F.lit(abstain) & (reason != "legislation_retrieval"), reason))
    queries = stored(queries.withColumn("query_id", F.struct("request_id", "q_idx")), "search")
    asked = scope_reasons(requests, queries)
    active = queries.where("reason is null").select("query_id", "query")

    pool = max(R.POOL, 2 * R.CANDIDATES)
    sparse = (index or R.Bm25Index(chunks)).topk(active, pool)
    found = sparse.where(F.col("rank") <= R.CANDIDATES) if dense is None else R.candidates(dense(active), sparse)
    pairs = rerank_pairs(stored(found.select("query_id", "pos", "rank"), "search"), active, chunks.select("pos", "text", *FIELDS))
    placed = rerank_order(score_pairs(pairs, scorer).drop("text"), weight)
    placed = stored(placed.select(F.col("query_id.request_id").alias("request_id"), F.col("query_id.q_idx").alias("q_idx"), "query", "pos", "score", "place", *FIELDS), "search")

    # one row per chunk of a request
    listed = F.array_sort(F.collect_list(F.struct("q_idx", "query")))
    fused = placed.groupBy("request_id", "pos").agg(
        F.max("score").alias("raw"), F.round(F.sum(F.lit(1.0) / (R.RRF_K + F.col("place"))), 12).alias("fused"), listed.alias("__asked"), *(F.first(c).alias(c) for c in FIELDS)
    )
    per = queries.where("reason is null").groupBy("request_id").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("q_idx", "query"))), lambda x: x["query"])).alias("__all"), F.bool_or(T.is_citation_query(F.col("query"))).alias("__cites"), F.count("*").alias("__n")
    )
    rows = fused.join(per, "request_id")
    factor = R.article_factor(F.col("__all"), F.col("article_label"), F.col("article_kind"), F.col("article_title"), F.col("__cites"))
    rows = rows.withColumn("__factor", factor).withColumn("score", F.round(R.unit_boost(F.col("fused"), F.col("units"), unit) * F.col("__factor"), 12))
    if coverage:
        forced = R.facet_guarantee(placed.withColumn("rank", F.col("place")))
        rows = rows.join(forced, ["request_id", "pos"], "left")
    else:
        rows = rows.withColumn("forced", F.lit(None).cast("int"))
    chosen = R.select_topk(rows, top_k, "__n", max_per_document)
    chosen = final_order(chosen.withColumn("display", F.round(F.col("raw") * F.col("__factor"), 9)))
    chosen = stored(chosen.select("request_id", "rank", "pos", *FIELDS, "display", "raw", "fused", "score", F.transform("__asked", lambda x: x["query"]).alias("sources")), "search")

    decided = R.decide(chosen.select("request_id", "pos", "display", "raw"), least if abstain else None, asked.select("request_id", "n_queries", "n_skipped"))
    decisions = decided.join(asked.select("request_id", "skipped", "scope_reason"), "request_id")
    decisions = decisions.select("request_id", "answerable", F.coalesce("scope_reason", "reason").alias("reason"), "top_score", "margin", "skipped")
    return chosen.join(decisions.where("answerable").select("request_id"), "request_id", "left_semi"), decisions


def run_grid(
    queries: DataFrame, chunks: DataFrame, relevant: DataFrame, runs: list[dict], ks: tuple[int, ...] = (1, 3, 5, 10), scorer: Callable[[Column, Column], Column] = token_overlap,
    index: R.Bm25Index | None = None, dense: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(run, n_queries, hit_k.., mrr, misses) of several settings over the same queries (query_id, query) and (query_id, pos) that are relevant.

    A run is a dict of ``name``, ``weight`` of the blend, ``candidates`` and
    ``factor`` (whether the article factor weighs).  All runs share the index, the largest candidate
    set and its pair scores: a run is a column of one plan, not a search of its own.
    """
    most = max(r.get("candidates", R.CANDIDATES) for r in runs)
    sparse = (index or R.Bm25Index(chunks)).topk(queries, max(R.POOL, 2 * most))
    ranked = sparse if dense is None else R.rrf_fuse([(dense(queries), 1.0), (sparse, 1.0)])
    found = stored(ranked.where(F.col("rank") <= most).select("query_id", "pos", "rank"), "grid")
    pairs = score_pairs(rerank_pairs(found, queries, chunks.select("pos", "text", *FIELDS)), scorer).drop("text")
    options = [(r["name"], float(r.get("weight", BLEND)), int(r.get("candidates", R.CANDIDATES)), bool(r.get("factor", True))) for r in runs]
    settings = F.array(*(F.struct(*(F.lit(x).alias(k) for x, k in zip(o, ("run", "weight", "most", "factor"), strict=True))) for o in options))
    rows = stored(pairs, "grid").withColumn("__s", F.explode(settings)).where(F.col("rank") <= F.col("__s.most"))
    rows = rows.withColumns({"run": F.col("__s.run"), "__weight": F.col("__s.weight"), "__factor": F.col("__s.factor")})
    per = Window.partitionBy("run", "query_id")
    rows = rows.withColumn("__re", F.row_number().over(per.orderBy(F.desc("score"), "rank")))
    mixed = (F.col("__weight") > 0) & ~T.is_citation_query(F.col("query"))
    blended = F.round(1.0 / (R.RRF_K + F.col("__re")) + F.when(mixed, F.col("__weight") / (R.RRF_K + F.col("rank"))).otherwise(0.0), 12)
    rows = rows.withColumn("__blend", F.row_number().over(per.orderBy(F.desc(blended), "__re")))
    factor = F.when(F.col("__factor"), R.article_factor(F.col("query"), F.col("article_label"), F.col("article_kind"), F.col("article_title"))).otherwise(1.0)
    place = F.row_number().over(per.orderBy(F.desc(F.round(F.col("score") * factor, 9)), "__blend"))
    placed = stored(rows.select("run", "query_id", "pos", place.alias("rank")), "grid")
    # of what is relevant only pairs that are placed are shuffled
    hit = relevant.select("query_id", "pos").join(R.small(placed.select("query_id", "pos").distinct()), ["query_id", "pos"], "left_semi").distinct()
    first = placed.join(hit, ["query_id", "pos"]).groupBy("run", "query_id").agg(F.min("rank").alias("first"))
    asked = relevant.select("query_id").distinct().withColumn("run", F.explode(F.array(*(F.lit(o[0]) for o in options)))).join(first, ["run", "query_id"], "left")
    hits = [F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}") for k in ks]
    return asked.groupBy("run").agg(F.count("*").alias("n_queries"), *hits, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.sum(F.col("first").isNull().cast("int")).alias("misses"))


def facet_coverage(results: DataFrame, targets: DataFrame, k: int = 8) -> DataFrame:
    """One row: requests, and the share whose every target (request_id, q_idx, pos) is met among the first ``k`` of (request_id, pos, rank).

    A query with several targets is met by any of them.
    """
    hits = results.where(F.col("rank") <= k).select("request_id", "pos", F.lit(True).alias("hit"))
    met = targets.join(hits, ["request_id", "pos"], "left").groupBy("request_id", "q_idx").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("met"))
    full = met.groupBy("request_id").agg(F.bool_and("met").alias("full"))
    return full.agg(F.count("*").alias("n_requests"), F.avg(F.col("full").cast("int")).alias("covered"))


def is_loose_boilerplate(label: Column, title: Column) -> Column:
    """The looser rule: plain lower case, titles that only begin like a purpose or a definition count."""
    label, title = F.lower(F.coalesce(label, F.lit(""))), F.trim(F.lower(F.coalesce(title, F.lit(""))))
    found = label.contains("geçici") | label.contains("gecici") | title.isin(LOOSE_TITLES)
    for start in LOOSE_STARTS:
        found = found | title.startswith(start)
    return found


def drop_boilerplate(results: DataFrame, first: int = 5) -> DataFrame:
    """Results without boilerplate articles, then the first ones of each request, ranked anew."""
    kept = results.where(~is_loose_boilerplate(F.col("article_label"), F.col("article_title")))
    w = Window.partitionBy("request_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)


def best_per_request(rows: DataFrame, request: str, order: list, missing: Column, most: int = 2) -> DataFrame:
    """The first rows of each request; none where information is missing."""
    w = Window.partitionBy(request).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.when(missing, 0).otherwise(most)).drop("__r")


def pick_selected(results: DataFrame, ticked: DataFrame, status: DataFrame) -> DataFrame:
    """Results whose (request_id, rank) is ticked; none of requests of ``status`` (request_id, status) that wait for information."""
    waiting = status.where("status = 'EKSIK_BILGI_BEKLENIYOR'").select("request_id")
    return results.join(ticked.select("request_id", "rank").distinct(), ["request_id", "rank"], "left_semi").join(waiting, "request_id", "left_anti")


def slim_selected(selected: Column) -> Column:
    """Law, article and title of array<struct<law, article, title, ...>>, trimmed; entries without law and article are dropped."""
    part = lambda x, k: F.trim(F.coalesce(x[k], F.lit(""))).alias(k)
    slim = F.transform(F.coalesce(selected, F.array()), lambda x: F.struct(*(part(x, k) for k in ("law", "article", "title"))))
    return F.filter(slim, lambda x: (x["law"] != "") | (x["article"] != ""))


def provision_fields(law_no: Column, law_title: Column, title: Column, body: Column, start: Column, end: Column, files: Column) -> Column:
    """struct<law, title, text, summary, pages, file> of a chunk: a missing title is ``-``, the summary has 300 characters."""
    text = T.stripped(body)
    law = F.when(F.coalesce(law_no, F.lit("")) != "", F.concat(law_no, F.lit(" sayılı "), law_title)).otherwise(law_title)
    pages = F.when(start.eqNullSafe(end), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    return F.struct(
        law.alias("law"), F.coalesce(F.nullif(title, F.lit("")), F.lit("-")).alias("title"), text.alias("text"), F.substring(F.regexp_replace(text, r"(?U)\s+", " "), 1, 300).alias("summary"),
        pages.alias("pages"), F.get(files, F.lit(0)).alias("file"),
    )


def provision_row(results: DataFrame, full_text: bool = True) -> DataFrame:
    """Results as reported: four decimals for display and raw scores, six for fusion and ordering, halves to even; ``text`` whole or the summary."""
    rows = results.select("*", *(F.bround(c, n).alias("__" + c) for c, n in (("display", 4), ("raw", 4), ("fused", 6), ("score", 6)))).drop("display", "raw", "fused", "score")
    rows = rows.withColumnsRenamed({"__" + c: c for c in ("display", "raw", "fused", "score")})
    return rows.drop("summary") if full_text else rows.drop("text").withColumnRenamed("summary", "text")


def decision_row(decisions: DataFrame) -> DataFrame:
    return decisions.withColumns({c: F.bround(c, 4) for c in ("top_score", "margin")})
