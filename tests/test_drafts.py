"""Letters by literals."""

from pyspark.sql import functions as F

from varaka.operators import drafts as D
from varaka.sources import io


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


def test_extraction(spark):
    for raw, letter in (
        ('```json\n{"draft": " T.C.\\nMetin. "}\n```', "T.C.\nMetin."), ('{"draft": {"draft": "İç metin"}}', "İç metin"), ("düz metin\nT.C. Kimlik No: 1\nİmza\nAdres: x\n\nson", "düz metin\nson"),
        ("a\nkimlik no 5\nb", "a"), ('{"draft": ""}', '{"draft": ""}'), (None, ""),
    ):
        assert one(spark, D.extract_letter(F.col("s")), s=raw) == letter


def polished(spark, letter, unit="Fen İşleri Müdürlüğüne", target="Fen İşleri Müdürlüğü", status="INCELEMEDE"):
    pairs = F.expr("array(named_struct('type', 'PERSON', 'value', 'Ali Veli'), named_struct('type', 'ORGANIZATION', 'value', 'Metin'))")
    return one(spark, D.polish_letter(F.col("s"), pairs, F.lit(unit), F.lit(target), F.lit(status)), s=letter)


def test_polish(spark):
    head = "T.C.\nFen İşleri Müdürlüğü\n\n"
    assert polished(spark, "T.C.\nX BELEDİYE BAŞKANLIĞINA\n\nMetin.\nMetin.\nrica ederim.\nAli Veli\n0 532 111 22 33\nGül Mahallesi 5") == head + "Metin.\nrica ederim."
    assert polished(spark, "Metin.\nSaygılarımla Ali Veli\n\n") == head + "Metin.\nSaygılarımla Ali Veli"
    kept = "T.C.\nX Müdürlüğü\n(Fen İşleri Müdürlüğü)\nMetin."
    assert polished(spark, kept) == "T.C.\nX Müdürlüğü\nMetin."
    assert polished(spark, "T.C.\nMetin.", target="Park Müdürlüğü", status="YONLENDIRILDI") == "T.C.\nMetin.\n\nBaşvurunuz Park Müdürlüğü birimine yönlendirilmiştir.\n"
    assert polished(spark, None) == "T.C.\nFen İşleri Müdürlüğü"


def test_citations(spark):
    laws = F.expr("array(named_struct('law', '3194 sayılı Kanun', 'article', '8', 'title', 'Plan'))")
    said = "İşlemler 3194 sayılı Kanun Madde 8 (Plan) uyarınca yürütülmüştür."
    for letter, found in (
        ("Sayın X,\nİnceledik\n\nrica ederim.", f"Sayın X,\nİnceledik. {said}\n\nrica ederim.\n"), ("Sayın X,\nrica ederim.", f"Sayın X,\n\n{said}\nrica ederim.\n"), ("rica ederim.", f"rica ederim.\n\n{said}\n"),
        ("3194 sayılı Kanun madde 8 gereği.", "3194 sayılı Kanun madde 8 gereği."), ("", said + "\n"), (None, said + "\n"), ("İnceledik!", f"İnceledik! {said}\n"),
    ):
        assert one(spark, D.ensure_citation(F.col("s"), laws), s=letter) == found
    none = F.expr("cast(array() as array<struct<law:string,article:string,title:string>>)")
    assert one(spark, D.ensure_citation(F.col("s"), none), s="x ") == "x "
    assert one(spark, D.ensure_citation(F.col("s"), none), s=None) == ""


def test_finished_letters(spark):
    raw = '{"response_type": "x", "draft": "T.C.\\nX BAŞKANLIĞINA\\nİnceledik\\nrica ederim.\\nAli Veli"}'
    pairs, laws = F.expr("array(named_struct('type', 'PERSON', 'value', 'Ali Veli'))"), F.expr("array(named_struct('law', 'Kanun', 'article', '8', 'title', ''))")
    done = D.finish_letters(F.col("s"), pairs, laws, F.lit("Fen İşleri Müdürlüğü"), F.lit("Fen İşleri Müdürlüğü"), F.lit("INCELEMEDE"))
    assert one(spark, done, s=raw) == "T.C.\nFen İşleri Müdürlüğü\n\nİnceledik. İşlemler Kanun Madde 8 uyarınca yürütülmüştür.\nrica ederim.\n"


USER = "struct<sender_type:string,primary_topic:string,summary:string,requested_action:string,key_information:array<struct<type:string,value:string>>,missing_information:array<string>,selected_legislation:array<struct<law_name:string,article:string,reference_text:string>>>"
ANSWER = "struct<target_unit:string,performed_actions:array<string>,result_information:string,process_information:string>"


def test_template_letters(spark):
    user = ("vatandas", "YOL_BAKIM", "Yol bozuk.", "yolun onarılması.", [("PERSON", "Ali"), ("LOCATION", "Gül Mah./Seyhan, Adana"), ("DATE", "1.1.2025")], ["adres. ", ""], [("3194 sayılı Kanun", "Madde 8", None)])
    rows = spark.createDataFrame([(1, "failed", "eski", user, ("Fen İşleri", ["keşif."], None, "Sürüyor.")), (2, "cached", "eski", user, None), (3, "failed", None, (None,) * 7, (None,) * 4)], f"uid int, status string, draft string, user {USER}, answer {ANSWER}")
    got = {r["uid"]: r for r in D.fill_templates(rows).collect()}
    lines = got[1]["draft"].split("\n")
    assert lines[:5] == ["T.C.", "SEYHAN BELEDİYE BAŞKANLIĞI", "Fen İşleri", "", "Sayı: -"] and lines[5] == "Konu: Yol Bakim Hk." and lines[7:11] == ["İlgi: 1.1.2025 tarihli başvurunuz.", "", "Sayın Ali,", ""]
    assert lines[11] == "Yol bozuk. Başvurunuzda yolun onarılması talep edilmektedir." and "edilmiştir: adres. Söz" in lines[12] and "3194 sayılı Kanun'nun 8. maddesi uyarınca." in lines[13]
    assert lines[14].endswith("gerçekleştirilmiştir: keşif.") and lines[15].endswith("Sürüyor.") and lines[-1] == "Fen İşleri" and "Bilgilerinizi rica ederim." in lines
    assert got[2]["draft"] == "eski" and got[2]["problems"] is None and got[1]["problems"] == []
    assert "Sayın İlgili," in got[3]["draft"] and "Konu: Başvurunuz Hk." in got[3]["draft"] and "None" not in got[3]["draft"]


def test_refresh(spark):
    law = [("3194 sayılı Kanun", "8")]
    rows = spark.createDataFrame([(i, "eski", "VATANDAS", law if i else []) for i in range(5)], "uid int, draft string, sender string, laws array<struct<law_name:string,article:string>>")
    good = "3194 " + "söz " * 190 + "rica ederim."
    pair = "uid int, draft string"
    got = D.refresh_drafts(rows, spark.createDataFrame([(1, "saklı")], pair), spark.createDataFrame([(1, good), (2, good), (3, "kısa")], pair))
    assert {r["uid"]: (r["status"], r["draft"], len(r["problems"])) for r in got.collect()} == {
        0: ("skipped_no_legislation", "eski", 0), 1: ("cached", "saklı", 0), 2: ("regenerated", good, 0), 3: ("regenerated_with_warnings", "kısa", 3), 4: ("failed", "eski", 0),
    }


def test_domains_and_notes(spark):
    assert one(spark, D.check_domains({"a": F.col("s"), "b": F.lit("y")}, {"a": ["x"], "b": ["y"]}), s=None) == ["a"]
    for note, ok in (("Başvuru incelenmektedir.", True), ("İki. Cümle.", False), ("Sayın Ali.", False), ("noktasız", False), ("3.5 metre.", True), ("", False), (None, False)):
        assert one(spark, D.one_sentence_note(F.col("s")), s=note) is ok


def test_sample_groups(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"A_1": {"group": "G"},\n "B_2": {}}')
    found = io.read_sample_metadata(spark, [str(tmp_path / "none.json"), str(tmp_path / "m.json")])
    samples = spark.createDataFrame([("A_1",), ("B_2",), ("C_3",)], "id string")
    assert {tuple(r) for r in io.with_group(samples, found).collect()} == {("A_1", "G"), ("B_2", "B"), ("C_3", "C")}
    assert io.read_sample_metadata(spark, [str(tmp_path / "none.json")]).count() == 0


def test_actions_of_both_forms_and_the_older_key(spark):
    import json

    from varaka.operators import drafts as D

    user = "named_struct('sender_type','VATANDAS','primary_topic','IMAR','summary','Özet.','requested_action','','key_information',cast(array() as array<struct<type:string,value:string>>),'missing_information',cast(array() as array<string>),'selected_legislation',cast(array() as array<struct<law_name:string,article:string,reference_text:string>>))"
    rest = "'result_information','','process_information','Sürüyor.'"
    for actions in ("array('keşif.', ' ölçüm ')", "array(named_struct('action','x','detail','keşif'), named_struct('action','ölçüm','detail',cast(null as string)))"):
        answer = f"named_struct('target_unit',' ','responsible_unit','Park Müdürlüğü','performed_actions',{actions},{rest})"
        rows = spark.range(1).selectExpr("'failed' as status", "'' as draft", f"{user} as user", f"{answer} as answer")
        letter = D.fill_templates(rows).first()["draft"]
        assert "gerçekleştirilmiştir: keşif; ölçüm." in letter and "Park Müdürlüğü" in letter.split("\n")[2]
    bare = spark.range(1).selectExpr("'failed' as status", "'' as draft", f"{user} as user", f"named_struct('target_unit',cast(null as string),'performed_actions',cast(null as array<string>),{rest}) as answer")
    letter = D.fill_templates(bare).first()["draft"]
    assert "gerçekleştirilmiştir" not in letter and "İlgili Müdürlük" in letter
    assert json.dumps(letter)


def test_refreshed_messages(spark):
    import json

    from pyspark.sql import functions as F

    from varaka.functions import text as T
    from varaka.operators import drafts as D

    law = [{"law_name": "3194 sayılı Kanun", "article": "8"}]
    users = [json.dumps({"sender_type": "VATANDAS", "selected_legislation": x, "n": k}) for k, x in enumerate((law, [], law, law))]
    answers = [{"responsible_unit": "A", "draft": "eski", "z": 1}, {"responsible_unit": "A", "target_unit": "B"}, {"target_unit": "B", "draft": "eski"}, {"draft": "eski", "x": None}]
    rows = [("train", k, [("assistant", "ilk"), ("user", u), ("assistant", json.dumps(a)), ("system", "x")]) for k, (u, a) in enumerate(zip(users, answers, strict=True))]
    records = spark.createDataFrame(rows, "file string, idx int, messages array<struct<role:string,content:string>>")
    uid = lambda k: T.record_uid(F.lit("train"), F.lit(k), F.lit(users[k]))
    cache = spark.range(1).select(uid(2).alias("uid"), F.lit('yeni "2"').alias("draft"), F.array(F.lit("p")).alias("problems"))
    new = spark.range(1).select(uid(0).alias("uid"), F.lit("3194").alias("draft"))
    got = {r["idx"]: r for r in D.refresh_messages(records, cache, new, "S").collect()}
    assert [got[k]["status"] for k in range(4)] == ["regenerated_with_warnings", "skipped_no_legislation", "cached", "failed"]
    assert all([m["role"] for m in r["messages"]] == ["system", "user", "assistant"] and r["messages"][0]["content"] == "S" for r in got.values())
    final = [json.loads(got[k]["messages"][2]["content"]) for k in range(4)]
    assert final == [{"z": 1, "target_unit": "A", "draft": "3194"}, {"responsible_unit": "A", "target_unit": "B"}, {"target_unit": "B", "draft": 'yeni "2"'}, {"x": None, "draft": "eski"}]
    assert got[2]["problems"] == ["p"] and "too_short(1w)" in got[0]["problems"] and got[3]["problems"] == []


def test_long_letters_take_time_in_proportion(spark):
    """A letter of twice the lines takes about twice the time: what its lines share is computed once, not for each."""
    import time

    from varaka.operators import letters as L

    def seconds(n: int) -> float:
        text = "\n".join(["Sayın Ali Veli,", *(f"Satır {i} metin burada" for i in range(n)), "Bilgilerinizi rica ederim.", "- dilekçe", "Ek: 2 sayfa", "son"])
        rows = spark.createDataFrame([(text,)], "t string").coalesce(1).cache()
        rows.count()
        laws, info = F.expr("array(named_struct('law', '3194 sayılı Kanun', 'article', 'Madde 8', 'title', 'Plan'))"), F.expr("array(named_struct('type', 'PERSON', 'value', 'Ali Veli'))")
        began = time.time()
        out = rows.select(D.finish_letters(F.col("t"), info, laws, F.lit("Fen İşleri"), F.lit("Park"), F.lit(None).cast("string"), True), L.strip_attachments(F.col("t"))).first()
        took = time.time() - began
        assert "Ek: 2" not in out[1] and out[1].endswith("son") and "3194" in out[0]
        return took

    seconds(50)
    assert seconds(1500) < 10


def test_white_space_and_line_breaks_as_the_patterns_have_them(spark):
    from varaka.functions import text as T
    from varaka.operators import letters as L

    rows = spark.createDataFrame([(f"{chr(c)}a{chr(c)}{chr(c)}b{chr(c)}",) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000], "s string")
    s = F.col("s")
    wrong = (T.stripped(s) != F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")) | (T.rstripped(s) != F.regexp_replace(s, r"(?U)\s+\z", "")) | (L.lines_of(s) != F.split(s, L.LINE_BREAK))
    assert rows.where(wrong).count() == 0


def test_last_index_counts_from_the_end(spark):
    from varaka.operators import letters as L

    last = lambda items: L.last_index(F.array(*map(F.lit, items)) if items else F.expr("cast(array() as array<string>)"), lambda x: x == "a")
    assert tuple(spark.range(1).select(last(["a", "b", "a", "b"]), last(["a"]), last(["b"]), last([])).first()) == (2, 0, -1, -1)


def same_as_sql(spark, tmp_path, name, texts):
    import duckdb

    from varaka.plans import registry

    rows = [(i * len(texts) + k, t) for i in range(3) for k, t in enumerate(texts)] + [(i * len(texts) + k + 3001, t) for i in range(3) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["letter"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert found == dict(c.execute(registry.ORACLE_SQL[name]).fetchall())


#: blank ones, ones with other line breaks or white space at their ends, none
ODD_LETTERS = ["", " ", "\n", " \n \n", "a", "a\r\nb", "a\r\n\r\nb\r\n", "a\fb", "a\x0bb c", "a\u2028b", "a\rb\r", "a\n\n \r\n\n", "\r\n a \t\n", "a\x85b", None]


def test_extracted_letters_keep_their_breaks(spark, tmp_path):
    same_as_sql(spark, tmp_path, "L1_extract_letter", ODD_LETTERS)
    assert one(spark, D.extract_letter(F.col("s")), s="a\u2028kimlik no 5\r\nb\x85\x85c") == "a\u2028c"


def test_citation_paragraphs_keep_the_breaks_of_a_letter(spark, tmp_path):
    same_as_sql(spark, tmp_path, "L4b_citation_paragraph", ODD_LETTERS)
