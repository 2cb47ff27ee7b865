"""Drafts from raw answers and templates: extraction, polish, citations, rule-based letters and their refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.functions import text as T
from varaka.operators import letters as L

# Fixed values of the workload
ID_MARKS = ["kimlik no", "t.c. kimlik", "tc kimlik"]
SALUTATIONS = ["saygılar", "saygilar", "bilgilerinize", "gereğini", "geregini"]
PHONE, ADDRESS = r"(?<!\d)(0\s*)?5\d[\d\s]{8,}", r"(?iu)(mahallesi|caddesi|sokak|sok\.|no:|telefon|/[A-ZÇĞİÖŞÜ])"
ADDRESSEE = r"(BAŞKANLIĞINA|MÜDÜRLÜĞÜNE)"
HEADINGS = ["sayın", "ilgi", "konu:", "t.c"]
REDIRECTED = "Başvurunuz {} birimine yönlendirilmiştir."
CITED = "İşlemler {} uyarınca yürütülmüştür."
DANGLING = r"(?iuUs)\s*İşlemler\s+.+?uyarınca(?:\s+yürütülmüştür)?\.?\s*\z"
#: the end of the line at which a text begins, up to its line feed if only white space comes before that
FIRST_END = rf"(?U)\A(?:[^\S\n]*\n|{L.LINE_BREAK})"
WAITING, COMPLETION = "EKSIK_BILGI_BEKLENIYOR", "EKSIK_BILGI_BELGE_TAMAMLAMA_YAZISI"
MISSING = "Yapılan inceleme neticesinde başvurunuza ilişkin bazı bilgi/belgelerin eksik olduğu tespit edilmiştir: {}. Söz konusu eksikliklerin tarafımıza iletilmesi, başvurunuzun sağlıklı bir şekilde sonuçlandırılabilmesi için önem arz etmektedir."
LAWS = "Konuya ilişkin mevzuat hükümleri incelenmiş olup; {} Bu hükümler çerçevesinde başvurunuz değerlendirmeye alınmıştır."
ASKED = "Başvurunuzda {} talep edilmektedir."
FOLLOWED = "Süreç, {} tarafından takip edilmektedir. "
REFERRED = "İlgi: {} tarihli başvurunuz.\n"
OFFICE, NO_TOPIC, TOPIC, NUMBER = "BELEDİYE BAŞKANLIĞI", "Konu: Başvurunuz Hk.", "Konu: {} Hk.", "Sayı: {}"
DEAR, SOMEONE, SOME_UNIT, REGARDS = "Sayın {},", "İlgili", "İlgili Müdürlük", "Saygılarımla,"
ACTIONS = "Bu kapsamda tarafımızca aşağıdaki işlemler gerçekleştirilmiştir: {}."
CONTACT = "Başvurunuzun değerlendirilmesi sürecinde belediyemiz, ilgili mevzuat hükümlerine ve idari usul esaslarına tam uyum göstererek, konunun sağlıklı ve zamanında sonuçlandırılması için gerekli çalışmaları titizlikle yürütmektedir. Süreçle ilgili herhangi bir sorunuz olması halinde {} ile iletişime geçebilirsiniz."
FILLERS = [
    "İlgili birimlerimiz, başvurunuzu titizlikle ele almakta olup süreç boyunca mevzuata ve idari usul esaslarına tam uyum gösterilmektedir.",
    "Konuya ilişkin her türlü gelişme tarafınıza ayrıca bildirilecektir.",
    "Başvurunuzun sağlıklı bir şekilde sonuçlandırılması belediyemizin önceliğidir.",
    "Talebinizle ilgili işlemler, ilgili mevzuat hükümleri çerçevesinde titizlikle yürütülmektedir.",
]


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _text(c: Column) -> Column:
    return T.stripped(F.coalesce(c, F.lit("")))


def _sentence(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _filled(c: Column) -> Column:
    """Null for blank text."""
    return F.nullif(_text(c), F.lit(""))


def extract_letter(raw: Column) -> Column:
    """The letter of a model's answer: the draft of its JSON, nested ones too; identity numbers go with all that follows to the next blank line.

    A blank draft is an empty letter where the answer has a response type.  Lines keep their breaks.
    """
    inner = lambda told: lambda json: F.coalesce(told(F.get_json_object(json, "$.draft.draft")), told(F.get_json_object(json, "$.draft")))
    draft = lambda s, told: F.coalesce(T.let(T.repaired_json(s), inner(told)), s)
    answer = lambda s: F.when(s.startswith("{") & s.contains("response_type"), draft(s, T.stripped)).otherwise(s)
    text = T.let(T.let(_text(raw), lambda s: draft(s, _filled)), answer)
    marked = lambda line: T.let(F.lower(line), lambda low: _any([low.contains(m) for m in ID_MARKS]))
    kinds = lambda lines: F.transform(lines, lambda line: F.when(marked(line), "M").when(T.stripped(line) == "", "B").otherwise("O"))
    kept = T.let(L.ended_lines(text), lambda lines: L.without_runs(lines, kinds(lines), r"M|(?!\A)(?<!B)\G[OB]"))
    return T.stripped(F.array_join(kept, ""))


def polish_letter(letter: Column, pairs: Column, sender_unit: Column, target_unit: Column, status: Column) -> Column:
    """A letter with the sender's heading, without repeated lines, the citizen's signature block and attachment lists; redirected ones say so."""
    target = T.strip_dative(target_unit)
    sender = F.coalesce(_filled(T.strip_dative(sender_unit)), target)
    tokens = F.transform(F.filter(F.coalesce(T.citizen_tokens(pairs), F.expr("cast(array() as array<string>)")), lambda t: F.length(t) > 2), F.lower)
    given = F.struct(target.alias("target"), sender.alias("sender"), tokens.alias("tokens"))
    return T.let(given, lambda g: _polished(_text(letter), g["target"], g["sender"], g["tokens"], status))


def _polished(letter: Column, target: Column, sender: Column, tokens: Column, status: Column) -> Column:
    def heading(x: Column) -> Column:
        return T.let(F.upper(T.stripped(x)), lambda up: up.isin("", "T.C.", "TC") | up.endswith("BAŞKANLIĞINA") | up.endswith("MÜDÜRLÜĞÜNE"))

    def headed(text: Column) -> Column:
        return T.let(L.lines_of(text), lambda lines: T.let(F.coalesce(F.array_min(F.transform(F.slice(lines, 1, 8), lambda x, k: F.when(~heading(x), k))), F.least(F.size(lines), F.lit(8))), lambda head: with_head(text, lines, head)))

    def with_head(text: Column, lines: Column, head: Column) -> Column:
        body = F.ltrim(F.array_join(F.slice(lines, head + 1, F.size(lines)), "\n"), F.lit(T.WHITE))
        wrong = F.array_join(F.slice(lines, F.lit(1), head), "\n").rlike("(?iu)" + ADDRESSEE) | ~text.rlike(r"(?i)^T\.C\.")
        return F.when(wrong, T.stripped(F.concat(F.lit("T.C.\n"), F.when(sender != "", F.concat(sender, F.lit("\n"))).otherwise(F.lit("")), F.lit("\n"), body))).otherwise(text)

    def in_brackets(x: Column) -> Column:
        inner = lambda t: F.lower(T.stripped(F.regexp_replace(t, r"^\(+|\)+\z", "")))
        return T.let(T.stripped(x), lambda t: t.rlike(r"(?s)^\(.*\)\z") & (inner(t) == F.lower(sender)))

    def stays(x: Column) -> Column:
        signature = lambda low: F.exists(tokens, lambda t: F.contains(low, t)) | x.rlike(PHONE) | x.rlike(ADDRESS)
        return T.let(F.lower(T.stripped(x)), lambda low: (low != "") & (_any([low.startswith(s) for s in SALUTATIONS]) | ~signature(low)))

    unsigned = lambda lines: F.array_join(F.slice(lines, F.lit(1), L.last_index(lines, stays) + 1), "\n")
    cut = lambda text: T.let(L.drop_adjacent_duplicates(F.filter(L.lines_of(text), lambda x: ~in_brackets(x))), unsigned)

    def redirected(text: Column) -> Column:
        told = (F.coalesce(status, F.lit("")) == "YONLENDIRILDI") & (target != "") & ~F.contains(F.lower(text), F.lower(target))
        return F.when(told, F.concat(text, F.lit("\n\n"), _sentence(REDIRECTED, target), F.lit("\n"))).otherwise(text)

    text = letter
    for step in (headed, cut, L.strip_attachments, redirected):
        text = T.let(text, step)
    return text


def _citable(chosen: Column) -> Column:
    """Labels of the first two of ``chosen`` that have one."""
    return F.filter(F.transform(F.slice(chosen, 1, 2), lambda x: T.cite_label(x["law"], x["article"], x["title"])), lambda s: s != "")


def _body(text: Column, use, lines_of=L.lines_of) -> Column:
    """``use`` of (lines, at, close) of a text: the place of the last filled line before its first closing line, and of that; each computed once."""
    filled = lambda x: T.stripped(x) != ""

    def placed(lines: Column) -> Column:
        close = F.array_min(F.transform(lines, lambda x, i: F.when(L.is_closing_line(x), i)))
        at = lambda c: L.last_index(F.slice(lines, F.lit(1), F.coalesce(c, F.size(lines))), filled)
        return T.let(close, lambda c: T.let(at(c), lambda a: use(lines, a, c)))

    return T.let(lines_of(text), placed)


def ensure_citation(letter: Column, chosen: Column) -> Column:
    """The letter, citing the first two of ``chosen`` (array<struct<law, article, title>>) at the end of its body unless it cites one already."""
    return T.let(F.coalesce(letter, F.lit("")), lambda s: T.let(_citable(chosen), lambda labels: _with_citation(s, chosen, labels)))


def _with_citation(letter: Column, chosen: Column, labels: Column) -> Column:
    def cited(low: Column, x: Column) -> Column:
        number, law = F.regexp_extract(F.coalesce(x["article"], F.lit("")), r"\d+", 0), F.lower(F.coalesce(x["law"], F.lit("")))
        named = [(law != "") & F.contains(low, F.substring(law, 1, 16)), *(law.contains(w) & low.contains(w) for w in ("yönetmelik", "kanun"))]
        return (number != "") & F.contains(low, number) & _any(named)

    sentence = _sentence(CITED, F.array_join(labels, ", "))

    def joined(lines: Column, at: Column, last: Column) -> Column:
        above, below = F.slice(lines, F.lit(1), F.greatest(at, F.lit(0))), F.slice(lines, F.greatest(at, F.lit(0)) + 2, F.size(lines))
        apart = T.let(F.lower(last), lambda lead: _any([lead.startswith(h) for h in HEADINGS]) | (lead == "tc"))
        grown = F.concat(F.when(last.rlike(r"[.!?]\z"), last).otherwise(F.concat(last, F.lit("."))), F.lit(" "), sentence)
        return F.array_join(F.concat(above, F.when(apart, F.array(F.get(lines, at), F.lit(""), sentence)).otherwise(F.array(grown)), below), "\n")

    def added(text: Column) -> Column:
        grown = lambda lines, at, _: F.when(at < 0, F.concat(text, F.lit("\n\n"), sentence)).otherwise(T.rstripped(T.let(T.rstripped(F.get(lines, at)), lambda last: joined(lines, at, last))))
        return F.when(text == "", sentence).otherwise(_body(text, grown))

    known = T.let(F.lower(letter), lambda low: F.exists(chosen, lambda x: cited(low, x)))
    keep = (F.coalesce(F.size(labels), F.lit(0)) <= 0) | F.coalesce(known, F.lit(False))
    return F.when(keep, letter).otherwise(F.concat(T.let(T.rstripped(letter), added), F.lit("\n")))


def ensure_citation_paragraph(letter: Column, chosen: Column) -> Column:
    """The letter with a paragraph before its closing that cites the first two of ``chosen``, unless its body cites an article already.

    A dangling clause of that kind at the end of the body goes; without a closing
    the paragraph stands last, and alone if nothing is left of the body.  Blank lines before the
    closing stay between it and the paragraph; without a body the paragraph follows the first of them.
    Lines keep their breaks.  Null counts as an empty letter.
    """
    return T.let(F.coalesce(letter, F.lit("")), lambda s: T.let(_citable(chosen), lambda labels: _with_paragraph(s, labels)))


def _with_paragraph(letter: Column, labels: Column) -> Column:
    paragraph = _sentence(CITED, F.array_join(labels, ", "))
    named = lambda low: (low.contains("uyarınca") | low.contains("gereğince")) & low.contains("madde")
    cites = lambda x: T.let(F.lower(x), named) & ~L.is_closing_line(x)
    joined = lambda lines: F.array_join(lines, "")

    def placed(body: Column, rest: Column, at: Column, close: Column) -> Column:
        alone = lambda whole: F.when(whole == "", paragraph).otherwise(F.concat(whole, F.lit("\n\n"), paragraph))
        below = F.regexp_replace(rest, FIRST_END, "")
        before = F.concat(body, F.when(at < 0, "\n").otherwise("\n\n"), paragraph, F.lit("\n\n"), below)
        return F.when(close.isNull(), T.let(T.rstripped(body), alone)).otherwise(T.rstripped(before))

    def grown(text: Column, lines: Column, at: Column, close: Column) -> Column:
        above = joined(F.slice(lines, F.lit(1), F.greatest(at, F.lit(0))))
        last = T.rstripped(F.coalesce(F.get(lines, at), F.lit("")))
        body = F.concat(above, T.rstripped(F.regexp_replace(last, DANGLING, "")))
        rest = F.substr(joined(F.slice(lines, F.greatest(at, F.lit(0)) + 1, F.size(lines))), F.length(last) + 1)
        parts = F.struct(body.alias("body"), rest.alias("rest"))
        return F.when(F.exists(lines, cites), text).otherwise(T.let(parts, lambda x: placed(x["body"], x["rest"], at, close)))

    added = lambda text: F.when(text == "", paragraph).otherwise(_body(text, lambda lines, at, close: grown(text, lines, at, close), L.ended_lines))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, letter).otherwise(F.concat(T.let(T.rstripped(letter), added), F.lit("\n")))


def finish_letters(raw: Column, pairs: Column, chosen: Column, sender_unit: Column, target_unit: Column, status: Column, paragraph: bool = False) -> Column:
    """A model's answer as a finished letter: extracted, polished, cited; in a ``paragraph`` of its own or at the end of the body."""
    polished = T.let(extract_letter(raw), lambda s: polish_letter(s, pairs, sender_unit, target_unit, status))
    return (ensure_citation_paragraph if paragraph else ensure_citation)(polished, chosen)


def finished_rows(rows: DataFrame, paragraph: bool = True) -> DataFrame:
    """``rows`` (raw, pairs, chosen, sender_unit, target_unit, process_status) with letter, response_type and breaks_rule.

    A status of missing information demands its response type, and overwrites
    the answer's; the other direction is only told (``breaks_rule``).  While
    information is missing no law is cited.
    """
    answer = T.repaired_json(F.col("raw"))
    given = F.get_json_object(answer, "$.response_type")
    waiting = F.coalesce(F.col("process_status") == WAITING, F.lit(False))
    chosen = F.when(~waiting, F.col("chosen"))
    letter = finish_letters(F.col("raw"), F.col("pairs"), chosen, F.col("sender_unit"), F.col("target_unit"), F.col("process_status"), paragraph)
    breaks = (F.coalesce(given, F.lit("")) == COMPLETION) & ~waiting
    return rows.withColumns({"letter": letter, "response_type": T.enforce_missing_rule(F.col("process_status"), given), "breaks_rule": breaks})


def rule_violations(rows: DataFrame) -> DataFrame:
    """(process_status, n, overwritten, broken): answers whose response type was overwritten, and those that ask for documents though nothing is missing."""
    given = F.get_json_object(T.repaired_json(F.col("raw")), "$.response_type")
    over = (F.col("process_status") == WAITING) & ~given.eqNullSafe(F.lit(COMPLETION))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.groupBy("process_status").agg(F.count("*").alias("n"), count(over).alias("overwritten"), count((given == COMPLETION) & ~F.col("process_status").eqNullSafe(F.lit(WAITING))).alias("broken"))


def action_texts(actions: Column) -> Column:
    """Texts of performed actions, a list of texts or of objects with ``detail`` or else ``action``, of any column type."""
    every = F.try_variant_get(F.try_parse_json(F.to_json(F.struct(actions.alias("a")))), "$.a", "array<variant>")
    field = lambda x, k: F.nullif(F.try_variant_get(x, f"$.{k}", "string"), F.lit(""))
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    return F.transform(every, lambda x: F.when(is_object(x), F.coalesce(field(x, "detail"), field(x, "action"), F.lit(""))).otherwise(F.try_variant_get(x, "$", "string")))


def template_letter(user: Column, answer: Column, older_unit: Column | None = None) -> Column:
    """The rule-based letter for ``user`` (sender_type, primary_topic, summary, requested_action, key_information, missing_information,
    selected_legislation) and ``answer`` (target_unit, performed_actions in either form, result_information, process_information).

    ``older_unit``, the unit under its older key, counts where ``target_unit`` is blank.
    """
    info = user["key_information"]
    first = lambda *kinds: F.coalesce(*(_filled(T.first_value(info, k)) for k in kinds))
    unit = F.coalesce(migrated_unit(_filled(answer["target_unit"]), F.lit(None).cast("string") if older_unit is None else _filled(older_unit)), F.lit(SOME_UNIT))
    place, topic, date = F.upper(T.district(first("LOCATION"))), T.humanize(user["primary_topic"]), first("DATE", "REFERENCE_DATE")
    summary, action = _text(user["summary"]), _text(user["requested_action"])
    bare = lambda s: F.regexp_replace(_text(s), r"\.+\z", "")
    listed = lambda items: _filled(F.array_join(F.filter(F.transform(items, bare), lambda s: s != ""), "; "))
    ask = F.when((action != "") & ~F.contains(summary, action), _sentence(ASKED, bare(action)))
    process = _filled(answer["process_information"])
    paragraphs = [
        _filled(F.concat_ws(" ", F.nullif(summary, F.lit("")), ask)), _sentence(MISSING, listed(user["missing_information"])), _sentence(LAWS, _filled(T.legislation_paragraph(user["selected_legislation"]))),
        _sentence(ACTIONS, listed(action_texts(answer["performed_actions"]))), _filled(answer["result_information"]), F.concat(_sentence(FOLLOWED, unit), process), _sentence(CONTACT, unit),
    ]
    head = [
        F.lit("T.C."), F.when(place != "", F.concat_ws(" ", place, F.lit(OFFICE))).otherwise(OFFICE), unit, F.lit(""),
        _sentence(NUMBER, F.coalesce(first("REFERENCE_NO", "DOCUMENT_NO", "APPLICATION_NO"), F.lit("-"))), F.when(topic != "", _sentence(TOPIC, topic)).otherwise(NO_TOPIC), F.lit(""),
        _sentence(REFERRED, date), _sentence(DEAR, F.coalesce(first("PERSON", "ORGANIZATION"), F.lit(SOMEONE))), F.lit(""),
    ]
    tail = [F.lit(""), T.closing(F.upper(user["sender_type"])), F.lit(""), F.lit(REGARDS), F.lit(""), F.lit(""), unit]
    return F.concat_ws("\n", *head, *paragraphs, *tail)


def migrated_unit(target: Column, old: Column) -> Column:
    """The target unit, which the older key gives only where it is missing."""
    return F.coalesce(target, old)


def refresh_drafts(records: DataFrame, cache: DataFrame, new: DataFrame) -> DataFrame:
    """``records`` (uid, draft, sender, laws) with their draft and ``status`` after a refresh, and the problems of a new draft.

    Records without laws keep their draft; a cached draft (uid, draft) comes
    before a new one (uid, draft); without either the refresh has failed.
    """
    rows = records.join(cache.select("uid", F.col("draft").alias("__cached")), "uid", "left").join(new.select("uid", F.col("draft").alias("__new")), "uid", "left")
    bare, problems = F.coalesce(F.size("laws"), F.lit(0)) <= 0, T.draft_problems(F.col("__new"), F.col("sender"), F.col("laws"))
    status = (
        F.when(bare, "skipped_no_legislation").when(F.col("__cached").isNotNull(), "cached").when(F.col("__new").isNull(), "failed")
        .when(F.size(problems) > 0, "regenerated_with_warnings").otherwise("regenerated")
    )
    rows = rows.withColumn("status", status).withColumn("problems", F.when(F.col("status") == "regenerated_with_warnings", problems).otherwise(F.expr("cast(array() as array<string>)")))
    return rows.withColumn("draft", F.when(bare, F.col("draft")).otherwise(F.coalesce("__cached", "__new", "draft"))).drop("__cached", "__new")


def refresh_messages(records: DataFrame, cache: DataFrame, new: DataFrame, system: str) -> DataFrame:
    """(file, idx, uid, messages, status, problems) of chat rows (file, idx, messages) after a refresh of their drafts.

    The user's and the assistant's contents are JSON objects.  Messages come
    back as system, user, assistant, the system's text replaced, the unit
    moved from its older key where the new one is missing, and the draft from
    ``cache`` (uid, draft, problems) or ``new`` (uid, draft); the fields of
    the answer come in the order of their names, those that were set last.
    ``problems`` of a new draft are judged, those of a cached one are kept.
    """
    part = lambda role: L.content_of(F.col("messages"), role)
    rows = records.select("file", "idx", part("user").alias("user"), part("assistant").alias("assistant"))
    rows = rows.withColumns({"uid": T.record_uid(F.col("file"), F.col("idx"), F.col("user")), "answer": F.try_variant_get(F.try_parse_json("assistant"), "$", "map<string,variant>")})
    laws = F.from_json(F.get_json_object("user", "$.selected_legislation"), "array<struct<law_name:string,article:string>>")
    judged = rows.select("file", "idx", "uid", "user", "answer", F.get_json_object("assistant", "$.draft").alias("draft"), F.get_json_object("user", "$.sender_type").alias("sender"), laws.alias("laws"))
    found = refresh_drafts(judged, cache, new).join(cache.select("uid", F.col("problems").alias("__told")), "uid", "left")
    held = F.map_filter("answer", lambda k, v: (k != "draft") & ~((k == "responsible_unit") & F.map_contains_key("answer", "target_unit").eqNullSafe(F.lit(False))))
    moved = F.when(~F.map_contains_key("answer", "target_unit") & F.map_contains_key("answer", "responsible_unit"), F.create_map(F.lit("target_unit"), F.col("answer")["responsible_unit"]))
    added = F.when(F.col("draft").isNotNull(), F.create_map(F.lit("draft"), F.try_variant_get(F.try_parse_json(F.to_json(F.struct(F.col("draft").alias("d")))), "$.d", "variant")))
    none = F.expr("cast(map() as map<string,variant>)")
    whole = F.map_concat(held, F.coalesce(moved, none), F.coalesce(added, none))
    text = F.to_json(whole)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit(system)), message("user", F.col("user")), message("assistant", text))
    problems = F.when(F.col("status") == "cached", F.coalesce("__told", F.expr("cast(array() as array<string>)"))).otherwise(F.col("problems"))
    return found.select("file", "idx", "uid", messages.alias("messages"), "status", problems.alias("problems"))


def fill_templates(records: DataFrame, least: int = 200) -> DataFrame:
    """``records`` (status, draft, user, answer): failed ones take a padded template letter and tell its problems.

    An answer may hold its unit under the older key ``responsible_unit``.
    """
    older = F.col("answer.responsible_unit") if "responsible_unit" in records.schema["answer"].dataType.names else None
    made = T.pad_to_words(template_letter(F.col("user"), F.col("answer"), older), FILLERS, least)
    rows = records.withColumn("draft", F.when(F.col("status") == "failed", made).otherwise(F.col("draft")))
    return rows.withColumn("problems", F.when(F.col("status") == "failed", T.draft_problems(F.col("draft"), F.col("user.sender_type"), F.col("user.selected_legislation"))))


def check_domains(values: dict[str, Column], domains: dict[str, list[str]]) -> Column:
    """Names of the fields whose value is null or outside its domain."""
    bad = [F.when(~F.coalesce(values[k].isin(domains[k]), F.lit(False)), F.lit(k)) for k in domains]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def one_sentence_note(note: Column) -> Column:
    """True for exactly one sentence that ends with a full stop and does not greet."""
    t = _text(note)
    greets = _any([F.lower(t).startswith(s) for s in ("sayın", *SALUTATIONS)])
    return t.rlike(r"(?s)^[^.!?]*(?:[.!?](?=\S)[^.!?]*)*\.\z") & ~greets
