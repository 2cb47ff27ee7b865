"""Intake and payload: information of all shapes, the failure lane, late decisions, letters with a citation paragraph."""

import json

import pytest
from pyspark.sql import functions as F

from varaka.operators import drafts as D
from varaka.operators import intake as I
from varaka.operators import search as Q

LAW = "array(named_struct('law', '3194 sayılı Kanun', 'article', '8', 'title', 'Plan'), named_struct('law', '5393 sayılı Kanun', 'article', 'Madde 14', 'title', '-'), named_struct('law', 'X', 'article', '1', 'title', ''))"
CITE = "İşlemler 3194 sayılı Kanun Madde 8 (Plan), 5393 sayılı Kanun Madde 14 uyarınca yürütülmüştür."


@pytest.mark.parametrize(
    "value, pairs, missing",
    [
        ('{"ad": "Ali", "yer": "yok", "no": 3, "x": null}', [("ad", "Ali"), ("no", "3")], True),
        ('[{"type": "PERSON", "value": " Ali "}, {"key": "yer", "val": "-"}, {"value": "7"}, {"type": "", "value": "Yok."}, {}]', [("PERSON", "Ali"), ("yer", "-"), ("bilgi", "7")], True),
        ('["adres", " Yok ", "-", "", 5, null]', [("", "adres"), ("", "5")], True),
        ('"yok"', [], False),
        ('"Yok."', [], True),
        ('" adres "', [("", "adres")], True),
        ("null", [], False),
        ("[]", [], False),
        ('["-", "yok"]', [], False),
        ("12.5", [("", "12.5")], True),
    ],
)
def test_information_of_all_shapes(spark, value, pairs, missing):
    v = F.try_parse_json(F.lit(value))
    row = spark.range(1).select(I.info_pairs(v).alias("p"), I.variant_missing(v).alias("m")).first()
    assert [tuple(x) for x in row["p"]] == pairs and row["m"] == missing


def test_no_information(spark):
    row = spark.range(1).select(I.info_pairs(F.try_parse_json(F.lit(None).cast("string"))).alias("p"), I.variant_missing(F.try_parse_json(F.lit("no json"))).alias("m")).first()
    assert row["p"] == [] and row["m"] is False


def test_forbidden_keys_and_complete_fields(spark):
    labels = {"document_type": "BILGI_TALEBI", "sender_type": "VATANDAS", "primary_topic": "IMAR", "requested_action": "imar durumunun bildirilmesi", "key_information": {"PERSON": "Ali"}, "missing_information": [], "summary": "imar durumu soruluyor"}
    text = "x" * 50
    reason = lambda d: spark.range(1).select(I.record_problem_of(F.lit(text), F.lit(json.dumps(d)), F.lit("IMAR"), ["PERSON"], ("target_unit",))).first()[0]
    assert reason(labels) is None
    assert reason({**labels, "target_unit": "x"}) == "forbidden_key"
    assert reason({**labels, "key_information": [{"type": "OTHER", "value": "x"}]}) == "key_information_type"
    assert reason({**labels, "missing_information": ["adres"]}) == "missing_information"
    full = lambda d: spark.range(1).select(I.complete_fields(F.try_parse_json(F.lit(json.dumps(d))), ["a", "b"])).first()[0]
    assert full({"a": [1], "b": {"c": 1}}) and not full({"a": [], "b": 1}) and not full({"a": "", "b": 1}) and not full({"a": None, "b": 1}) and not full({"a": 1}) and not full([1])


def test_intake_keeps_rows_that_fail(spark):
    chunks = spark.createDataFrame([(k, f"imar planı madde {k} belediye görev", f"d{k % 3}", f"Madde {k}", "madde", "Amaç" if k == 1 else "-", ["x"]) for k in range(30)], "pos long, text string, doc_id string, article_label string, article_kind string, article_title string, units array<string>")
    good = {"primary_topic": "IMAR", "requested_action": "imar planı değişikliği", "missing_information": ["adres"]}
    rows = [(1, "metin", "```json\n" + json.dumps(good) + "\n```"), (2, "metin", json.dumps(good)[:-2]), (3, "", json.dumps({**good, "missing_information": "yok"})), (4, "metin", "bilmiyorum"), (5, None, None)]
    requests = spark.createDataFrame(rows, "request_id long, ocr_text string, answer string")
    topics = spark.createDataFrame([("IMAR", "İmar Müdürlüğü", "imar planı mevzuatı")], "topic string, unit string, phrase string")
    documents, provisions = I.intake(requests, topics, chunks, 2025)
    got = {r["request_id"]: r for r in documents.collect()}
    assert [got[k]["problem"] for k in range(1, 6)] == [None, None, "no_text", "unparsable_answer", "no_text"]
    assert [got[k]["unit"] for k in (1, 4)] == ["İmar Müdürlüğü", "Yazı İşleri Müdürlüğü"]
    assert [got[k]["missing_information"] for k in range(1, 6)] == [True, True, False, False, False]
    assert got[1]["status"] == "EKSIK_BILGI_BEKLENIYOR" and got[4]["queries"] == ["belediye gorev yetki mevzuat"]
    assert [x["extra"] for x in got[1]["trace"]] == ["5 kr", "IMAR", "2 sorgu / 5 madde"]
    kept = provisions.collect()
    assert {r["request_id"] for r in kept} == {1, 2, 3, 4, 5} and max(r["rank"] for r in kept) == 5 and all(r["article_title"] == "-" and r["text"] for r in kept)


def test_the_latest_decision_wins(spark):
    documents = spark.createDataFrame([(k, '{"primary_topic":"IMAR","key_information":{"a":"b"},"x":1}', "İmar Müdürlüğü" if k < 4 else None) for k in range(1, 6)], "request_id long, a string, unit string")
    documents = documents.select("request_id", F.try_parse_json("a").alias("analysis"), "unit")
    provisions = spark.createDataFrame([(k, r, f"L{r}", str(r), "t", "m") for k in range(1, 6) for r in (1, 2, 3)], "request_id long, rank int, law string, article string, title string, text string")
    decide = [
        (1, 1, "INCELEMEDE", [1], "", "a", "r"), (1, 3, "YONLENDIRILDI", [3, 1, 1, 9], " Park ", " a \n\nb", " r "), (1, 2, "OLUMLU", [2], None, None, None),
        (2, 1, "EKSIK_BILGI_BEKLENIYOR", [1, 2], "Park", None, None), (3, 1, "OLUMLU", None, "Park", None, None), (4, 1, None, [2], None, None, None), (9, 1, "OLUMLU", [1], None, None, None),
    ]
    decisions = spark.createDataFrame(decide, "request_id long, version int, status string, selected array<int>, redirect string, actions string, result string")
    got = {r["request_id"]: r for r in I.letter_payload(documents, provisions, decisions).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = json.loads(got[1]["payload"])
    assert got[1]["version"] == 3 and one["target_unit"] == "Park" and one["performed_actions"] == ["a", "b"] and one["result_information"] == "r"
    assert [x["law"] for x in one["selected_legislation"]] == ["L1", "L3"] and one["key_information"] == {"a": "b"} and one["missing_information"] == [] and one["summary"] == ""
    assert (got[2]["n_selected"], got[2]["target_unit"]) == (0, "İmar Müdürlüğü")
    assert (got[3]["n_selected"], got[3]["target_unit"]) == (0, "İmar Müdürlüğü")
    assert (got[4]["process_status"], got[4]["target_unit"], got[4]["n_selected"]) == ("INCELEMEDE", "Yazı İşleri Müdürlüğü", 1)


@pytest.mark.parametrize(
    "letter, found",
    [
        ("T.C.\n\nGövde.\n\nBilgilerinizi rica ederim.\n", f"T.C.\n\nGövde.\n\n{CITE}\n\n\nBilgilerinizi rica ederim.\n"),
        ("Gövde.", f"Gövde.\n\n{CITE}\n"),
        ("", f"{CITE}\n"),
        (None, f"{CITE}\n"),
        ("5393 sayılı Kanun 14. madde uyarınca işlem yapıldı.\nSaygılarımla", "5393 sayılı Kanun 14. madde uyarınca işlem yapıldı.\nSaygılarımla\n"),
        ("Gövde. İşlemler eski kanun uyarınca yürütülmüştür.  \nArz ederim.", f"Gövde.\n\n{CITE}\n\nArz ederim.\n"),
        ("Saygılarımla,\nİmza", f"\n{CITE}\n\nSaygılarımla,\nİmza\n"),
    ],
)
def test_citation_paragraph(spark, letter, found):
    row = spark.range(1).select(D.ensure_citation_paragraph(F.lit(letter).cast("string"), F.expr(LAW)).alias("x"), D.ensure_citation_paragraph(F.lit("a"), F.expr("cast(array() as array<struct<law:string,article:string,title:string>>)")).alias("y")).first()
    assert row["x"] == found and row["y"] == "a"


def test_the_missing_information_rule(spark):
    raw = lambda kind: json.dumps({"response_type": kind, "draft": "T.C.\n\nGövde.\n\nArz ederim."})
    rows = [(1, raw("RED_YAZISI"), "EKSIK_BILGI_BEKLENIYOR"), (2, raw("EKSIK_BILGI_BELGE_TAMAMLAMA_YAZISI"), "INCELEMEDE"), (3, raw("RED_YAZISI"), "INCELEMEDE"), (4, "metin", "EKSIK_BILGI_BEKLENIYOR")]
    df = spark.createDataFrame(rows, "id long, raw string, process_status string").withColumns({"pairs": F.expr("cast(array() as array<struct<type:string,value:string>>)"), "chosen": F.expr(LAW), "sender_unit": F.lit("A Müdürlüğü"), "target_unit": F.lit("")})
    got = {r["id"]: r for r in D.finished_rows(df).collect()}
    assert [got[k]["response_type"] for k in (1, 2, 3, 4)] == ["EKSIK_BILGI_BELGE_TAMAMLAMA_YAZISI"] * 2 + ["RED_YAZISI", "EKSIK_BILGI_BELGE_TAMAMLAMA_YAZISI"]
    assert [got[k]["breaks_rule"] for k in (1, 2, 3, 4)] == [False, True, False, False]
    assert "uyarınca" in got[3]["letter"] and "uyarınca" not in got[1]["letter"]
    assert {r["process_status"]: (r["n"], r["overwritten"], r["broken"]) for r in D.rule_violations(df).collect()} == {"EKSIK_BILGI_BEKLENIYOR": (2, 2, 0), "INCELEMEDE": (2, 0, 1)}


def test_scores_below_zero_are_an_error(spark):
    pairs = spark.createDataFrame([("a", "b")], "query string, text string")
    assert Q.score_pairs(pairs, lambda q, t: F.lit(0.5)).first()["score"] == 0.5
    with pytest.raises(Exception, match="below 0"):
        Q.score_pairs(pairs, lambda q, t: F.lit(-0.5)).collect()
