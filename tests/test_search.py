"""Search against a plain loop over requests, and its small parts."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from varaka.functions.text import STOP_WORDS
from varaka.operators import search as Q

WORDS = "imar plan ruhsat yapı vergi harç su atık park zabıta ceza izin kira ihale bütçe meclis yol çevre sokak pazar".split()
CHUNK = "pos long, text string, doc_id string, article_label string, article_kind string, article_title string, units array<string>"


def tokens(s):
    found = re.findall(r"[0-9]+|(?<![a-zçğıöşü])[a-zçğıöşü]{3,6}", s.replace("I", "ı").replace("İ", "i").lower())
    return [t for t in found if t not in STOP_WORDS]


def corpus(seed=3, n=60):
    rng, rows = random.Random(seed), []
    for pos in range(n):
        title = rng.choice(["Amaç", "İmar planı", "Vergi ve harç", "", None])
        label = rng.choice(["Madde 1", "Madde 2", "Geçici Madde 1", "Madde 3"])
        rows.append((pos, " ".join(rng.choices(WORDS, k=rng.randrange(4, 25))), f"d{rng.randrange(5)}", label, "madde", title, rng.choice([["fen"], ["mali"], []])))
    return rows


def expected(queries, chunks, top_k, unit):
    """Positions in their final order, by loops."""
    toks = {c[0]: tokens(c[1]) for c in chunks}
    n, avg = len(chunks), sum(map(len, toks.values())) / len(chunks)
    df = Counter(t for x in toks.values() for t in set(x))
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    by = {c[0]: c for c in chunks}

    def factor(qs, c):
        if any(re.search(r"madde\s*\d+", q.lower()) for q in qs):
            return 1.0
        title, label, text = (c[5] or "").strip().replace("İ", "i").lower(), c[3].lower(), " ".join(qs).lower()
        f = 0.12 if ("geçici" in label or title == "amaç") and not ("geçici" in label and "geçici" in text) else 1.0
        hits = len(set(tokens(text)) & set(tokens(title)))
        return f * (1 + 0.1 * min(hits, 3)) if title not in ("", "amaç") else f

    best, places, orders = {}, Counter(), []
    for q in queries:
        score = {}
        for p, x in toks.items():
            tf = Counter(x)
            score[p] = round(sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in tokens(q) if tf[t]), 9)
        found = sorted(toks, key=lambda p: (-score[p], p))[:20]
        asked = set(tokens(q))
        overlap = {p: round(len(asked & set(toks[p])) / len(asked), 9) for p in found}
        reranked = sorted(found, key=lambda p: (-overlap[p], found.index(p)))
        mix = 0 if re.search(r"madde\s*\d+", q.lower()) else 0.25
        blend = sorted(reranked, key=lambda p: (-round(1 / (61 + reranked.index(p)) + mix / (61 + found.index(p)), 12), reranked.index(p)))
        order = sorted(blend, key=lambda p: -round(overlap[p] * factor([q], by[p]), 9))
        orders.append(order)
        for i, p in enumerate(order):
            best[p] = max(best.get(p, -1), overlap[p])
            places[p] += 1 / (61 + i)
    rank = {p: round(round(v, 12) * (1.15 if unit in by[p][6] else 1) * factor(queries, by[p]), 12) for p, v in places.items()}
    ranked = sorted(rank, key=lambda p: (-rank[p], p))
    article = lambda p: by[p][2:4]
    chosen, seen, docs = [], set(), Counter()

    def add(p, cap):
        if article(p) not in seen and (cap is None or docs[by[p][2]] < cap):
            chosen.append(p)
            seen.add(article(p))
            docs[by[p][2]] += 1

    if len(orders) > 1:
        for order in orders:
            for p in order:
                if article(p) not in seen:
                    add(p, None)
                    break
    cap = max(2, math.ceil(top_k / len(orders))) if len(orders) > 1 else None
    for limit in (cap, None):
        for p in ranked:
            if len(chosen) < top_k:
                add(p, limit)
    return sorted(chosen, key=lambda p: (-round(best[p] * factor(queries, by[p]), 9), p))


def test_search_equals_the_loop(spark):
    chunks = corpus()
    asked = {1: ["imar planı ruhsat", "vergi harç ihale"], 2: ["Madde 2 su kira"], 3: ["geçici park izin", "yol çevre", "meclis bütçe ceza"], 4: ["  çöp yapı imar "]}
    requests = spark.createDataFrame([*asked.items(), (5, ["", None]), (6, ["Belediyemizin telefon numarası"]), (7, None), (8, ["dün alınan karar", "yapı ruhsat"])], "request_id long, queries array<string>")
    results, decisions = Q.search(requests, spark.createDataFrame(chunks, CHUNK), 2026, 6, "fen")
    got = {}
    for r in results.orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["pos"])
    assert got == {k: expected([q.strip() for q in v], chunks, 6, "fen") for k, v in (asked | {8: ["yapı ruhsat"]}).items()}
    said = {r["request_id"]: (r["answerable"], r["reason"], r["skipped"]) for r in decisions.collect()}
    assert said == {
        **{k: (True, "retrieved", []) for k in (1, 2, 3, 4)}, 5: (False, "empty_query", []), 6: (False, "local_contact_or_navigation_data", ["Belediyemizin telefon numarası"]), 7: (False, "empty_query", []),
        8: (True, "retrieved_with_skipped_queries", ["dün alınan karar"]),
    }


def test_low_scores_give_no_results(spark):
    requests = spark.createDataFrame([(1, ["bilinmeyen sözcükler"]), (2, ["imar"])], "request_id long, queries array<string>")
    results, decisions = Q.search(requests, spark.createDataFrame(corpus(), CHUNK), 2026, 3, least=0.5)
    assert {r["request_id"] for r in results.collect()} == {2}
    assert {r["request_id"]: r["reason"] for r in decisions.collect()} == {1: "low_reranker_score", 2: "retrieved"}


def test_search_without_requests_or_chunks(spark):
    none = spark.createDataFrame([], "request_id long, queries array<string>")
    results, decisions = Q.search(none, spark.createDataFrame(corpus(), CHUNK), 2026)
    assert results.count() == 0 and decisions.count() == 0
    asked = spark.createDataFrame([(1, ["imar"])], none.schema)
    results, decisions = Q.search(asked, spark.createDataFrame([], CHUNK), 2026)
    assert results.count() == 0 and [r["reason"] for r in decisions.collect()] == ["no_candidates"]


def test_rows_as_reported(spark):
    rows = spark.createDataFrame([(1, 0.123456, 0.98765, 0.01234567, 0.1234567, "uzun", "kısa")], "request_id long, display double, raw double, fused double, score double, text string, summary string")
    got = Q.provision_row(rows, False).first()
    assert (got["display"], got["raw"], got["fused"], got["score"], got["text"]) == (0.1235, 0.9876, 0.012346, 0.123457, "kısa")
    assert Q.provision_row(rows).first()["text"] == "uzun"
    said = Q.decision_row(spark.createDataFrame([(True, 0.98765, None)], "answerable boolean, top_score double, margin double")).first()
    assert tuple(said) == (True, 0.9876, None)


def test_slim_selection(spark):
    rows = spark.createDataFrame([([(" 3194 ", None, "Plan", "metin"), (None, " ", "boş", "x")],), (None,)], "s array<struct<law:string,article:string,title:string,text:string>>")
    assert [[tuple(x) for x in r[0]] for r in rows.select(Q.slim_selected(F.col("s"))).collect()] == [[("3194", "", "Plan")], []]
