"""Scalar functions on text, names and small structures, as column expressions.

Null input gives null unless stated otherwise.  Patterns carry ``(?U)`` where
word classes must cover Turkish letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the workload
STOP_WORDS = ["madde", "fıkra", "bent", "kanun", "yöneti", "hüküm", "bu", "ve", "ile", "veya", "için", "olan", "göre", "gibi", "her", "bir", "olarak", "dair", "ilişki", "hakkın", "belge", "sayılı"]
META_TITLES = ["amaç", "kapsam", "tanımlar", "tanım", "tanım ve kısaltmalar", "dayanak", "amaç ve kapsam", "konu", "genel esaslar"]
CLOSINGS = {"VATANDAS": "Bilgilerinizi rica ederim.", "OZEL_KURULUS": "Bilgilerinizi rica ederim.", "KAMU_KURUMU": "Gereğini bilgilerinize arz ve rica ederim.", "YARGI_MERCII": "Gereğini saygılarımla arz ederim."}
DEFAULT_CLOSING = "Gereğini saygılarımla arz ederim."
DATIVES = [("Müdürlüğüne", "Müdürlüğü"), ("MÜDÜRLÜĞÜNE", "MÜDÜRLÜĞÜ"), ("Başkanlığına", "Başkanlığı"), ("BAŞKANLIĞINA", "BAŞKANLIĞI"), ("müdürlüğüne", "müdürlüğü"), ("başkanlığına", "başkanlığı")]
COUNCIL = ["dns", "danıstay", "danıştay", "danistay"]
COURT_DEFAULTS = {"case_no": "2021/1042", "decision_no": "2022/4510", "date": "15.03.2022"}
PERSON_LIKE = ["person", "ad", "soyad", "isim", "basvuran", "kisi", "location", "address", "adres", "mahalle", "konum"]
#: the characters that the pattern (?U)\s matches
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[0-9]+(?:/[0-9A-Za-zÇĞİÖŞÜçğıöşü]+)?|[a-zçğıöşü]+"
ARTICLE_REFERENCE = (
    r"(?iuU)(?:\bmadde(?:si|sinin|de|den)?\s*\d+(?:\s*/\s*[a-zçğıöşü0-9]+)?\b|"
    r"\b\d+(?:\s*/\s*[a-zçğıöşü0-9]+)?\s*(?:inci|ıncı|uncu|üncü|\.?)\s*madde(?:si|sinin|de|den)?\b)"
)
LOCAL = r"(?U)\b(?:bu belediye(?:nin)?|belediyemiz(?:de|in)?|ilçe(?:deki|mizde)?|mahalle(?:deki|mizde)?|kurumumuz(?:un)?)\b"
CONTACT = r"(?U)\b(?:telefon(?: numarası)?\w*|e[ -]?posta\w*|internet adres\w*|web site\w*|url|hangi adres\w*)\b"
LIVE_SERVICE = r"(?U)\b(?:nöbetçi|bugün açık|yarın açık)\b"
RECENT = r"(?U)\b(?:geçen hafta\w*|bu hafta\w*|dün|bugün|az önce|son toplantı)\b"
EVENT = r"(?U)\b(?:toplantı|karar|gündem|ihale sonucu|etkinlik)\w*\b"
MARKDOWN = [
    (r"\*{1,3}(.*?)\*{1,3}", "$1"), (r"_{1,3}(.*?)_{1,3}", "$1"), (r"(?m)^#+\s*", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"`{1,3}(.*?)`{1,3}", "$1"), (r"(?m)^\s*[-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"),
]
PRICE, HOW_MUCH = r"\b(?:tarife|ücret|bedel|metrekare değer|rayiç değer)\w*\b", r"\b(?:ne kadar|kaç (?:tl|lira)|tutar)\w*\b"
AMOUNT = f"(?U){PRICE}.*{HOW_MUCH}|{HOW_MUCH}.*{PRICE}"


def tr_lower(s: Column) -> Column:
    return F.lower(F.translate(s, "Iİ", "ıi"))


def tokenize(s: Column) -> Column:
    """Numbers whole; words of three letters or more cropped to six; stop words dropped after cropping."""
    number, letter = TOKEN.split("|")[0], TOKEN.split("|")[1].removesuffix("+")
    found = F.regexp_extract_all(tr_lower(s), F.lit(f"{number}|(?<!{letter}){letter}{{3,6}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))


def clean_markdown(s: Column) -> Column:
    """Emphasis, headings, links, code, rules and long gaps, in this order; null becomes empty."""
    for pattern, to in MARKDOWN:
        s = F.regexp_replace(s, pattern, to)
    return F.coalesce(F.regexp_replace(s, r"(?U)^\s+|\s+\z", ""), F.lit(""))


def length_bucket(s: Column) -> Column:
    n = F.length(s)
    return F.when(n.between(500, 999), "short").when(n.between(1000, 2999), "medium").when(n.between(3000, 6000), "long")


def drop_numeric_tokens(s: Column) -> Column:
    return F.array_join(F.filter(F.split(F.trim(s), r"\s+"), lambda t: ~t.rlike(r"^\d+$")), " ")


def drop_numbers(s: Column) -> Column:
    """Numbers of three to five digits go, spaces are squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\b\d{3,5}\b", " "), r"\s{2,}", " "))


def humanize(code: Column) -> Column:
    return F.coalesce(F.initcap(F.lower(F.trim(F.regexp_replace(F.replace(code, F.lit("_"), F.lit(" ")), r"\s+", " ")))), F.lit(""))


def district(location: Column) -> Column:
    return F.coalesce(F.trim(F.substring_index(F.trim(F.substring_index(location, "/", -1)), ",", 1)), F.lit(""))


def first_value(pairs: Column, kind: str) -> Column:
    """First value of a type in array<struct<type, value>>."""
    return F.get(F.filter(pairs, lambda x: x["type"] == kind), F.lit(0))["value"]


def record_uid(file: Column, index: Column, content: Column) -> Column:
    return F.concat_ws("_", file, index.cast("string"), F.substring(F.sha1(content), 1, 10))


def stripped(s: Column) -> Column:
    """Without white space of any kind at both ends; only these are looked at."""
    return F.btrim(s, F.lit(WHITE))


def rstripped(s: Column) -> Column:
    return F.rtrim(s, F.lit(WHITE))


def unfenced(s: Column) -> Column:
    return stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(s), r"^```(json)?", "")), r"```\z", ""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once.

    Bodies of lambdas are interpreted, and there what an expression names twice
    is computed twice.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _object(s: Column) -> Column:
    """The text, where it is a JSON object."""
    return let(s, lambda x: let(F.try_parse_json(x), lambda v: F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), x)))


def _braced(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))


def json_text(s: Column) -> Column:
    """The JSON object in a model's answer: fences dropped, else the outermost braces; null without one."""
    return let(unfenced(s), lambda t: F.when(t.contains("{"), F.coalesce(_object(t), _object(_braced(t)))))


def repaired_json(s: Column) -> Column:
    """``json_text``, and for cut-off answers the open string, arrays and objects are closed."""
    count = lambda x, ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))
    quoted = lambda c: F.when(count(c, '"') % 2 == 1, F.concat(c, F.lit('"'))).otherwise(c)

    def closed(c: Column) -> Column:
        curly, square = count(c, "{") - count(c, "}"), count(c, "[") - count(c, "]")
        return F.concat(F.regexp_replace(F.rtrim(c), r",+$", ""), F.repeat(F.lit("]"), F.greatest(square, F.lit(0))), F.repeat(F.lit("}"), F.greatest(curly, F.lit(0))))

    cut = lambda t: let(let(F.substr(t, F.instr(t, "{")), quoted), closed)
    bare = lambda x: stripped(F.regexp_replace(stripped(x), r"(?m)^```(json)?|```$", ""))
    read = lambda t: F.coalesce(_object(t), _object(_braced(t)), _object(cut(t)))
    return let(s, lambda x: F.when(x.contains("{"), let(bare(x), read)))


def closing(sender: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CLOSINGS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(sender, F.lit(""))), F.lit(DEFAULT_CLOSING))


def legislation_paragraph(laws: Column) -> Column:
    """One sentence for each law of array<struct<law_name, article, reference_text>> that has a name."""

    def sentence(x: Column) -> Column:
        name, article, ref = (F.trim(F.coalesce(x[k], F.lit(""))) for k in ("law_name", "article", "reference_text"))
        number = F.trim(F.replace(F.lower(article), F.lit("madde"), F.lit("")))
        text = F.concat(name, F.when(article != "", F.concat(F.lit("'nun "), number, F.lit(". maddesi uyarınca"))).otherwise(F.lit(" hükümleri uyarınca")))
        low = F.when(F.length(ref) > 1, F.concat(F.lower(F.substring(ref, 1, 1)), F.substr(ref, F.lit(2)))).otherwise(ref)
        text = F.when(ref != "", F.concat(text, F.lit(", "), low)).otherwise(text)
        return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))

    named = F.filter(laws, lambda x: F.trim(F.coalesce(x["law_name"], F.lit(""))) != "")
    return F.coalesce(F.array_join(F.transform(named, sentence), " "), F.lit(""))


def cite_label(law: Column, article: Column, title: Column) -> Column:
    law, article, title = (F.trim(F.coalesce(c, F.lit(""))) for c in (law, article, title))
    title = F.when(title.isin("-", "—", "–", "yok", "Yok"), "").otherwise(title)
    article = F.when(~article.rlike(r"(?iuU)\bmadde\b") & article.rlike(r"\d"), F.concat(F.lit("Madde "), article)).otherwise(article)
    base = F.concat_ws(" ", F.nullif(law, F.lit("")), F.nullif(article, F.lit("")))
    add = (title != "") & ~F.contains(F.lower(base), F.lower(title)) & (F.length(title) <= 90)
    return F.trim(F.when(add, F.concat(base, F.lit(" ("), title, F.lit(")"))).otherwise(base))


def strip_dative(unit: Column) -> Column:
    t = F.trim(F.coalesce(unit, F.lit("")))
    out = t
    for suffix, to in reversed(DATIVES):
        out = F.when(t.endswith(suffix), F.concat(F.substr(t, F.lit(1), F.length(t) - len(suffix)), F.lit(to))).otherwise(out)
    return out


def citizen_tokens(pairs: Column) -> Column:
    """Values of person- or place-like types and their words of three letters or more."""
    kind = lambda x: F.lower(F.coalesce(x["type"], F.lit("")))
    value = lambda x: F.trim(F.coalesce(x["value"], F.lit("")))
    wanted = F.filter(pairs, lambda x: (value(x) != "") & ~F.lower(value(x)).isin("yok", "-", "yok.") & F.exists(F.array(*map(F.lit, PERSON_LIKE)), lambda w: F.contains(kind(x), w)))
    return F.flatten(F.transform(wanted, lambda x: F.concat(F.array(value(x)), F.filter(F.split(value(x), r"[,\s/]+"), lambda w: F.length(w) > 2))))


def has_missing(values: Column) -> Column:
    kept = lambda v: ~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("", "yok", "-", "yok.")
    return F.coalesce(F.exists(values, kept), F.lit(False))


def default_status(missing: Column) -> Column:
    return F.when(has_missing(missing), "EKSIK_BILGI_BEKLENIYOR").otherwise("INCELEMEDE")


def is_citation_query(q: Column) -> Column:
    return q.rlike(ARTICLE_REFERENCE)


def is_boilerplate(label: Column, kind: Column, title: Column) -> Column:
    label, kind, title = (tr_lower(F.trim(F.coalesce(c, F.lit("")))) for c in (label, kind, title))
    return label.contains("geçici") | kind.isin("gecici", "geçici", "temporary") | title.isin(META_TITLES)


def classify_scope(query: Column, year: int) -> Column:
    """The reason why a query is out of scope, or ``legislation_retrieval``."""
    t = tr_lower(F.coalesce(query, F.lit("")))
    local, contact, live = t.rlike(LOCAL), t.rlike(CONTACT), t.rlike(LIVE_SERVICE)
    years = F.regexp_extract_all(t, F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1))
    current = local | t.contains("güncel") | F.exists(years, lambda y: y.cast("int") >= year)
    return (
        F.when(F.trim(t) == "", "empty_query").when(contact & (local | live), "local_contact_or_navigation_data").when(live & (local | contact), "live_service_data")
        .when(t.rlike(RECENT) & t.rlike(EVENT), "recent_local_event_data").when(t.rlike(AMOUNT) & current, "current_or_local_tariff_data").otherwise("legislation_retrieval")
    )


def closing_flags(draft: Column) -> tuple[Column, Column, Column]:
    low = F.lower(draft)
    has = lambda stem: low.contains(stem + " ederim") | low.contains(stem + " ederiz")
    return has("rica"), has("arz"), has("arz ve rica")


def check_closing(draft: Column, sender: Column) -> Column:
    rica, arz, both = closing_flags(draft)
    s = F.upper(F.coalesce(sender, F.lit("")))
    return F.when(s.isin("VATANDAS", "OZEL_KURULUS"), rica & ~arz).when(s == "KAMU_KURUMU", both).otherwise(arz & ~rica)


def check_citation(draft: Column, laws: Column) -> Column:
    """True without laws, or if the first number of a law's name or article occurs in the draft."""
    hit = lambda text: (F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+", 0) != "") & F.contains(draft, F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+", 0))
    return (F.coalesce(F.size(laws), F.lit(0)) <= 0) | F.exists(laws, lambda x: hit(x["law_name"]) | hit(x["article"]))


def draft_problems(draft: Column, sender: Column, laws: Column) -> Column:
    """All rule violations of a letter."""
    s = F.upper(F.coalesce(sender, F.lit("")))
    expected = F.when(s.isin("VATANDAS", "OZEL_KURULUS"), "wrong_closing_expected_rica").when(s == "KAMU_KURUMU", "wrong_closing_expected_arz_and_rica").otherwise("wrong_closing_expected_arz")
    n = word_count(draft)
    found = F.array(
        F.when(n < 180, F.concat(F.lit("too_short("), n.cast("string"), F.lit("w)"))), F.when(~check_closing(draft, sender), expected),
        F.when(~check_citation(draft, laws), "no_legislation_citation_found"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def enforce_missing_rule(status: Column, response: Column) -> Column:
    """The response type that a missing-information status demands, else the given one."""
    return F.when(status == "EKSIK_BILGI_BEKLENIYOR", "EKSIK_BILGI_BELGE_TAMAMLAMA_YAZISI").otherwise(response)


def court_header(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    council = [low.contains(w) for w in COUNCIL]
    return F.when(council[0] | council[1] | council[2] | council[3], "DANIŞTAY").otherwise("YARGITAY")


def court_fields(source: Column, case: Column, decision: Column, date: Column) -> Column:
    """struct<court, case_no, decision_no, date> of a decision; empty numbers and dates get the defaults."""
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return F.struct(court_header(source).alias("court"), *(given(c, d).alias(n) for (n, d), c in zip(COURT_DEFAULTS.items(), (case, decision, date), strict=True)))


def pad_to_words(draft: Column, fillers: list[str], least: int = 200, most: int = 12, salutation: str = "Saygılarımla,") -> Column:
    """Rotating filler sentences go before the salutation, or to the end without one, until the text has enough words."""
    options, mark = F.array(*map(F.lit, fillers)), F.lit(salutation)

    def step(d: Column, i: Column) -> Column:
        filler, at = F.get(options, F.pmod(i, F.lit(len(fillers)))), F.instr(d, mark)
        before = F.concat(F.substr(d, F.lit(1), at - 1), filler, F.lit("\n\n"), F.substr(d, at))
        longer = F.when(at > 0, before).otherwise(F.concat(d, F.lit(" "), filler))
        return F.when(word_count(d) < least, longer).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), draft, step)
