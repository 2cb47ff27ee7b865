"""Chat rows and letters: rebuilding messages, cached refresh, selective update and line jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.functions.text import let, rstripped, stripped
from varaka.operators.ranks import ranked


def content_of(messages: Column, role: str) -> Column:
    """Content of a role; the last of several wins, null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def in_role_order(messages: Column) -> Column:
    """system, user, assistant, each once; missing roles are left out."""
    made = F.array(*(F.when(content_of(messages, r).isNotNull(), F.struct(F.lit(r).alias("role"), content_of(messages, r).alias("content"))) for r in ("system", "user", "assistant")))
    return F.filter(made, lambda m: m.isNotNull())


def to_messages(system: Column, user: Column, labels: Column) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", F.to_json(labels)))))


def set_system_prompt(messages: Column, text: str) -> Column:
    return F.transform(messages, lambda m: F.when(m["role"] == "system", F.struct(m["role"].alias("role"), F.lit(text).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def resume_cached(records: DataFrame, cache: DataFrame, uid: str = "uid", draft: str = "draft") -> tuple[DataFrame, DataFrame]:
    """(records with their cached draft and whether it was cached, those that remain to do)."""
    found = records.join(cache.select(uid, F.col(draft).alias("cached_draft")), uid, "left").withColumn("cached", F.col("cached_draft").isNotNull())
    return found, found.where("not cached").drop("cached_draft", "cached")


def update_failed_only(base: DataFrame, patch: DataFrame, key: str, value: str, status: str = "status") -> DataFrame:
    """Rows whose status is ``failed`` take the patch's value where there is one."""
    rows = base.join(patch.select(key, F.col(value).alias("__new")), key, "left")
    return rows.withColumn(value, F.when(F.col(status) == "failed", F.coalesce("__new", value)).otherwise(F.col(value))).drop("__new")


def drop_adjacent_duplicates(lines: Column) -> Column:
    """Lines without those equal to the last non-blank line before them; blank lines stay."""
    none = F.expr("named_struct('last', cast(null as string), 'kept', cast(array() as array<string>))")

    def step(s: Column, line: Column) -> Column:
        blank, same = F.trim(line) == "", F.coalesce(F.trim(line) == s["last"], F.lit(False))
        last = F.when(blank, s["last"]).otherwise(F.trim(line))
        return F.struct(last.alias("last"), F.when(blank | ~same, F.concat(s["kept"], F.array(line))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(lines, none, step, lambda s: s["kept"])


# Fixed values of the workload
ATTACHMENT_WORDS = r"(?iu)(dilekçe|sayfa|evrak|fotokopi|başvuru)"
ATTACHMENT_HEAD = r"(?iuU)^ek(?:ler| listesi)?\s*:?\s*(.*)$"
BULLET = r"^[-•*–]"
CLOSING_STARTS = ["saygılarımla", "saygılar", "saygilar", "bilgilerinize", "gereğini", "geregini"]
CLOSING_PARTS = ["rica ederim", "arz ederim"]
RARE_BREAK = r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
LINE_END = r"(?<=[\n\x0B\f\x1C-\x1E\x85\u2028\u2029])|(?<=\r)(?!\n)"


def lines_of(text: Column) -> Column:
    """The lines of a text; only one with other breaks than line feeds needs the pattern of all."""
    return let(text, lambda s: F.when(s.rlike(RARE_BREAK), F.split(s, LINE_BREAK)).otherwise(F.split(s, "\n")))


def ended_lines(text: Column) -> Column:
    """``lines_of`` with the break that ends each, so that they make up the text again."""
    return let(text, lambda s: F.when(s.rlike(RARE_BREAK), F.split(s, LINE_END)).otherwise(F.split(s, r"(?<=\n)")))


def _names_attachment(t: Column) -> Column:
    rest = lambda r: (stripped(r) == "") | r.rlike(ATTACHMENT_WORDS)
    return (t.rlike(BULLET) & t.rlike(ATTACHMENT_WORDS)) | (t.rlike(ATTACHMENT_HEAD) & let(F.regexp_extract(t, ATTACHMENT_HEAD, 1), rest))


def _closes(low: Column) -> Column:
    tests = [low.startswith(x) for x in CLOSING_STARTS] + [low.contains(x) for x in CLOSING_PARTS]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def is_attachment_line(line: Column) -> Column:
    """A bullet that names an attachment, or a heading of attachments that stands alone or names one."""
    return let(stripped(line), _names_attachment)


def is_closing_line(line: Column) -> Column:
    return let(F.lower(stripped(line)), _closes)


def last_index(lines: Column, test) -> Column:
    """0-based place of the last line that ``test`` holds for; -1 without one.

    Lines are tested from the end until one holds: the state counts down and is negative from there on.
    """
    step = lambda s, x: F.when(s < 0, s).when(test(x), -s).otherwise(s - 1)
    found = let(lines, lambda rows: F.aggregate(F.reverse(rows), F.size(rows), step, lambda s: F.when(s < 0, -s - 1).otherwise(F.lit(-1))))
    return F.coalesce(found, F.lit(-1))


def without_runs(lines: Column, kinds: Column, pattern: str) -> Column:
    """``lines`` without those whose letter in ``kinds``, a letter for each, ``pattern`` finds; ``\\G`` goes on where the letter before was found."""
    found = F.split(F.regexp_replace(F.array_join(kinds, ""), pattern, "-"), "")
    return let(found, lambda f: F.filter(lines, lambda _, i: F.get(f, i) != "-"))


def strip_attachments(letter: Column) -> Column:
    """The letter without attachment lists at its end or after its last closing line; blanks at the end go.

    After the closing an attachment line starts a list: blank lines and bullets go
    with it until another line ends it.  Null becomes empty.
    """
    every = lines_of(rstripped(F.coalesce(letter, F.lit(""))))
    kind = lambda t: F.when(_names_attachment(t), "A").when(t == "", "B").when(t.rlike(BULLET), "L").otherwise("O")
    judged = F.transform(every, lambda x: let(stripped(x), lambda t: F.struct(x.alias("x"), kind(t).alias("kind"), _closes(F.lower(t)).alias("closes"))))
    cut = lambda rows: F.slice(rows, F.lit(1), last_index(rows, lambda r: ~r["kind"].isin("A", "B")) + 1)

    def stripped_rows(rows: Column, close: Column) -> Column:
        kinds = F.transform(rows, lambda r, i: F.when((close >= 0) & (i > close), r["kind"]).otherwise("O"))
        return without_runs(rows, kinds, r"A|(?!\A)\G[BL]")

    kept = let(let(judged, cut), lambda rows: let(last_index(rows, lambda r: r["closes"]), lambda close: stripped_rows(rows, close)))
    return rstripped(F.array_join(F.transform(kept, lambda r: r["x"]), "\n"))


def worst_k(df: DataFrame, score: str, k: int = 5, tie: str = "record_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def round_robin(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """``df`` with ``scenario`` 0..n-1 dealt in turn inside each ``by``, whatever its size."""
    rows = ranked(df, [by], [F.col(c) for c in order], "__r")
    return rows.withColumn("scenario", F.pmod(F.col("__r") - 1, F.lit(n))).drop("__r")
