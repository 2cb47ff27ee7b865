import random

from pyspark.sql import functions as F

from varaka.functions import text as T
from varaka.operators import evaluate as E
from varaka.operators import letters as L
from varaka.operators import records as P
from varaka.operators import retrieve as R
from varaka.operators import splits as S
from varaka.sources import io


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


def test_turkish_words(spark):
    assert one(spark, T.tr_lower(F.col("s")), s="IĞDIR İL") == "ığdır il"
    assert one(spark, T.tokenize(F.col("s")), s="Madde maddesi 13/B kararımız ve") == ["maddes", "13/b", "kararı"]


def test_scope_and_citation(spark):
    assert one(spark, T.classify_scope(F.col("s"), 2026), s="") == "empty_query"
    assert one(spark, T.classify_scope(F.col("s"), 2026), s="Belediyemizin telefon numarası") == "local_contact_or_navigation_data"
    assert one(spark, T.classify_scope(F.col("s"), 2026), s="2025 ücret tarifesi ne kadar") == "legislation_retrieval"
    assert one(spark, T.classify_scope(F.col("s"), 2025), s="2025 ücret tarifesi ne kadar") == "current_or_local_tariff_data"
    assert one(spark, T.is_citation_query(F.col("s")), s="3194 sayılı kanun MADDE 18") is True


def test_json_repair(spark):
    fenced = '```json\n{"a": 1}\n```'
    assert one(spark, T.json_text(F.col("s")), s=fenced) == '{"a": 1}'
    assert one(spark, T.json_text(F.col("s")), s="x {\"a\": 1} y") == '{"a": 1}'
    assert one(spark, T.json_text(F.col("s")), s="17") is None
    assert one(spark, T.json_text(F.col("s")), s='{"a": NaN}') is None
    assert one(spark, F.get_json_object(T.repaired_json(F.col("s")), "$.b[0]"), s='{"a": 1, "b": ["x') == "x"


def test_closings(spark):
    assert one(spark, T.check_closing(F.col("s"), F.lit("VATANDAS")), s="rica ederim.") is True
    assert one(spark, T.check_closing(F.col("s"), F.lit("VATANDAS")), s="arz ve rica ederim.") is True  # "arz ederim" does not occur
    assert one(spark, T.check_closing(F.col("s"), F.lit("YARGI_MERCII")), s="arz ederim.") is True
    assert one(spark, T.strip_dative(F.col("s")), s="Fen İşleri Müdürlüğüne ") == "Fen İşleri Müdürlüğü"
    assert one(spark, T.cite_label(F.lit("3194 sayılı Kanun"), F.lit("8"), F.lit("Plan")), s="") == "3194 sayılı Kanun Madde 8 (Plan)"


def test_published_split_counts(spark):
    expected = {1: (0, 0), 2: (0, 0), 3: (1, 1), 35: (4, 3), 45: (4, 4), 55: (6, 5)}
    rows = spark.createDataFrame([(n, f"{n}-{i}") for n in expected for i in range(n)], "n int, key string")
    found = S.stratified_split(rows, "n", "key").groupBy("n").pivot("split", ["val", "test"]).count().fillna(0)
    assert {r["n"]: (r["val"], r["test"]) for r in found.collect()} == expected


def test_selection_equals_the_greedy_loop(spark):
    rng = random.Random(5)
    cases, rows = {}, []
    for case in range(60):
        chunks = [(p, rng.randrange(4), rng.randrange(3), rng.random()) for p in range(14)]
        cases[case] = chunks
        rows += [(case, p, f"d{d}", f"a{a}", s, None) for p, d, a, s in chunks]
    df = spark.createDataFrame(rows, "request_id int, pos int, doc_id string, article_label string, score double, forced int")
    got = {}
    for r in R.select_topk(df, 6, 1, 2).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["pos"])
    for case, chunks in cases.items():
        order, chosen, seen, docs = sorted(chunks, key=lambda c: (-c[3], c[0])), [], set(), {}
        for enforce in (True, False):
            for c in order:
                if len(chosen) >= 6:
                    break
                if (c[1], c[2]) in seen or (enforce and docs.get(c[1], 0) >= 2):
                    continue
                chosen.append(c)
                seen.add((c[1], c[2]))
                docs[c[1]] = docs.get(c[1], 0) + 1
        assert got[case] == [c[0] for c in sorted(chosen, key=lambda c: (-c[3], c[0]))]


def test_facets_force_distinct_articles(spark):
    rows = [(1, 0, 5, "d", "a", 1), (1, 0, 6, "d", "b", 2), (1, 1, 5, "d", "a", 1), (1, 1, 7, "d", "c", 2), (2, 0, 5, "d", "a", 1)]
    df = spark.createDataFrame(rows, "request_id int, q_idx int, pos long, doc_id string, article_label string, rank int")
    assert sorted((r["request_id"], r["pos"], r["forced"]) for r in R.facet_guarantee(df).collect()) == [(1, 5, 0), (1, 7, 1)]


def test_bm25_fills_with_unmatched_chunks(spark):
    chunks = spark.createDataFrame([(0, "elma armut"), (1, "kiraz"), (2, "ceviz kiraz"), (3, "nohut")], "pos long, text string")
    queries = spark.createDataFrame([(9, "ceviz")], "query_id long, query string")
    assert [r["pos"] for r in R.bm25_topk(chunks, queries, 3).orderBy("rank").collect()] == [2, 0, 1]


def test_letters(spark):
    lines = F.array(*map(F.lit, ["a", "a", "", "a", "b"]))
    assert one(spark, L.drop_adjacent_duplicates(lines), s="") == ["a", "", "b"]
    for letter, kept in (
        ("Konu\nGereğini rica ederim.\nEkler:\n- Başvuru dilekçesi", "Konu\nGereğini rica ederim."),
        ("Konu\nrica ederim.\n1. İnceleme raporu sunulmuştur.\n \n", "Konu\nrica ederim.\n1. İnceleme raporu sunulmuştur."),
        ("Ek: dilekçe\nmetin\nSaygılarımla,\nEK LİSTESİ: 2 sayfa\n\n- plan\nAd Soyad\n- plan", "Ek: dilekçe\nmetin\nSaygılarımla,\nAd Soyad\n- plan"),
        ("rica ederim.\nEk: evrak\nara\nGereğini arz ederim.\nEk: var", "rica ederim.\nEk: evrak\nara\nGereğini arz ederim.\nEk: var"),
        ("yalnız metin\n• fotokopi\n", "yalnız metin"),
        (None, ""),
    ):
        assert one(spark, L.strip_attachments(F.col("s")), s=letter) == kept


def test_turkish_errors(spark):
    df = spark.createDataFrame([("ışık", "isik"), ("", "x"), ("çöp", "çöp!")], "r string, h string")
    rows = df.select(E.turkish_char_errors(F.col("r"), F.col("h")).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in rows] == [(3, 3), (0, 0), (2, 0)]


def test_readers(spark, tmp_path):
    (tmp_path / "dataset_a.jsonl").write_text('{"document_text": "x", "labels": {"summary": "s"}}\n\n')
    assert io.read_records(spark, str(tmp_path / "dataset_a.jsonl")).count() == 1
    (tmp_path / "Valid").mkdir()
    (tmp_path / "Valid" / "A_0001.txt").write_text("metin")
    assert [tuple(r) for r in io.read_text_pairs(spark, str(tmp_path)).collect()] == [("valid", "A_0001", "metin")]


def test_padding_goes_before_the_salutation(spark):
    pad = T.pad_to_words(F.col("s"), ["bir iki", "üç"], 6)
    assert one(spark, pad, s="a b Saygılarımla,") == "a b bir iki\n\nüç\n\nSaygılarımla,"
    assert one(spark, pad, s="a b c") == "a b c bir iki üç"


def test_record_reasons(spark):
    schema = "s string, labels struct<document_type:string,sender_type:string,primary_topic:string,requested_action:string,key_information:array<struct<type:string,value:string>>,missing_information:array<string>,summary:string>, keys array<string>"
    good, text = ("BILGI_TALEBI", "VATANDAS", "SU", "su faturasının dökümü", [("PERSON", "A")], [], "dökümü istiyor"), "x" * 40
    change = lambda i, v: good[:i] + (v,) + good[i + 1 :]
    cases = [
        ("x", good, [], "short_text"), (None, good, [], "short_text"), (text, None, [], "no_labels"), (text, good, ["unit"], "forbidden_key"), (text, change(0, "X"), [], "document_type"), (text, change(1, None), [], "sender_type"),
        (text, change(2, "YOL"), [], "primary_topic"), (text, change(3, "kısa"), [], "short_action"), (text, change(3, " Gereginin yapılması. "), [], "generic_action"), (text, change(4, None), [], "no_key_information"),
        (text, change(4, [("X", "A")]), [], "key_information_type"), (text, change(4, [("PERSON", " ")]), [], "key_information_value"), (text, change(4, [("PERSON", " "), ("X", "A")]), [], "key_information_value"), (text, change(4, [("PERSON", "A"), ("X", " "), ("PERSON", " ")]), [], "key_information_type"), (text, change(5, ["adres"]), [], "missing_information"), (text, change(6, "kısa"), [], "short_summary"), (text, good, [], None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], schema)
    found = df.select(P.record_problem(F.col("s"), F.col("labels"), F.lit("SU"), ["PERSON"], F.col("keys"), ("unit",)).alias("r")).collect()
    assert [r[0] for r in found] == [c[3] for c in cases]


def test_queries_of_an_analysis(spark):
    ask = P.build_queries(F.col("p"), F.col("a"))
    assert one(spark, ask, p="imar mevzuatı 3194", a="ruhsat verilmesi") == ["imar mevzuatı", "ruhsat verilmesi"]
    assert one(spark, ask, p="imar mevzuatı", a="IMAR MEVZUATI".lower()) == ["imar mevzuatı", "imar mevzuati"]
    assert one(spark, ask, p="imar mevzuatı", a="Gül mahallesi Lale sokak 5") == ["imar mevzuatı"]
    assert one(spark, ask, p="", a="kısa") == [P.DEFAULT_PHRASE]


def test_article_windows_cover_every_word(spark):
    text = "giriş\nMadde 1 " + " ".join(map(str, range(1000))) + "\nMadde 2 kısa"
    rows = P.chunk_articles(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("article", "part").collect()
    assert [(r["article"], r["part"], r["n_words"]) for r in rows] == [(1, 0, 1), (2, 0, 380), (2, 1, 380), (2, 2, 370), (3, 0, 3)]
    assert {w for r in rows for w in r["text"].split()} == set(text.split())


def test_repeated_pairs_are_aligned_once(spark, monkeypatch):
    """The function itself, of 500 rows with two pairs: as many alignments as pairs."""
    import pandas as pd

    from varaka.operators import evaluate as E

    seen, real = [], E.aligned_equal
    monkeypatch.setattr(E, "aligned_equal", lambda a, b: seen.append(1) or real(a, b))
    monkeypatch.setattr(E.F, "pandas_udf", lambda schema: lambda f: f)
    refs, hyps = pd.Series(["ışık", "güç", None, "abd"] * 125), pd.Series(["isik", "güç", "x", "abd"] * 125)
    out = E.turkish_char_errors(refs, hyps)
    assert len(seen) == 2 and list(map(tuple, out.values.tolist()))[:4] == [(3, 3), (3, 0), (0, 0), (0, 0)]
