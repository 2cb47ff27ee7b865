"""Conversation structure repair: cheapest edits to turns that alternate, by Four-Russians block tables.

The turns of a conversation, in order, are to spell role initials of the form
``(s?(ua)+)?``: four states (nothing yet, after s, after u, after a).  The
cheapest repair from each state to the end is a cost vector; a turn maps the
vector behind it to the one before it.  Vectors, less their least entry, are few
(their entries differ by what a few insertions cost), so the transitions of every
vector under every block of ``BLOCK`` turns are computed once, by rule, and a
conversation is walked backward block by block, by lookup, all conversations of
a batch at once.  A forward pass then expands each block backward into the
vectors between its turns and takes at each turn the letter that is least among those
that keep the total least; the walk backward comes first because of two repairs of
the same cost the least in ASCII can only be told from behind.

Turns that must go (blank ones and repeats) map every vector to itself plus a
constant, so they stand outside the blocks; identical rows of one turn are one
row with a count.

Rows are dealt out by ranges of (conversation, turn).  Conversations that lie in
one range are judged there; the few that cross into another are gathered as one
byte a turn, which is as long as the audit they ask for, and their texts stream through
the hash piece by piece.  No task holds the texts of a conversation of any length.

Defined cases: rows of a turn are ordered by role and text; null turns come
first; a null role or text is one space; rows with a null conv_id are one
conversation; a role that begins with none of s, u, a can only be rerolled or
deleted; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.llm.blocks import packed_rows, unpacked_rows
from varaka.llm.stage import Tables

#: turns in a block
BLOCK = 4
#: symbols: role class (s, u, a, other) * 2 + truncated, then a turn that must go, then the end of a conversation that does not fill its last block
CLASSES, GONE, PAD, SYMBOLS = 4, 8, 8, 9
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after one more turn of a user or assistant, whichever may follow
NEXT = (USER, USER, ASSISTANT, USER)
#: turns to add at the end
TAIL = (0, 2, 1, 0)
NAMES = {USER: b"user:", ASSISTANT: b"assistant:"}
#: rows and bytes of texts that are judged at once; bytes of one conversation that a task holds
BATCH_ROWS, BATCH_BYTES, HELD_BYTES = 20_000, 8_000_000, 32_000_000

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PLACE = "none boolean, conv long"
#: initials that may stand side by side
LEGAL = ((0, 1), (1, 2), (2, 1))


def keeps(role: int, state: int) -> int | None:
    """The state after a turn is kept, none if it may not stand there."""
    if role == 0:
        return SYSTEM if state == START else None
    if role in (1, 2):
        after = USER if role == 1 else ASSISTANT
        return after if NEXT[state] == after else None
    return None


def before(symbol: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector in front of a turn."""
    role, more = divmod(symbol, 2)
    here = []
    for q in range(4):
        cost = min(DELETE + behind[q], REROLE + TRUNCATED * more + behind[NEXT[q]])
        if (kept := keeps(role, q)) is not None:
            cost = min(cost, TRUNCATED * more + behind[kept])
        here.append(cost)
    for _ in range(3):
        here = [min(here[q], INSERT + here[NEXT[q]]) for q in range(4)]
    return tuple(here)


@dataclass
class Lookups:
    vectors: np.ndarray
    step: np.ndarray  # vector behind, symbol -> vector in front
    block: np.ndarray  # vector behind, block -> vector in front
    cost: np.ndarray  # vector behind, block -> constant
    trace: np.ndarray  # vector behind, symbol, state -> entry
    letters: list[str]
    outputs: list[tuple[bytes, int]]  # inserted lines; then 0 nothing, -1 the turn as it is, or the state whose role it gets
    end: np.ndarray  # entry -> state


@lru_cache(1)
def lookups() -> Lookups:
    vectors, number = [(0, 4, 2, 0)], {(0, 4, 2, 0): 0}
    step, offset = [], []
    for v in vectors:  # grows until closed
        row, constants = [], []
        for symbol in range(8):
            found = before(symbol, v)
            least = min(found)
            found = tuple(x - least for x in found)
            if found not in number:
                number[found] = len(vectors)
                vectors.append(found)
            row.append(number[found])
            constants.append(least)
        step.append([*row, number[v]])
        offset.append([*constants, 0])
    step, offset = np.array(step), np.array(offset)
    block, cost = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
    for _ in range(BLOCK):  # one more symbol in front, which is the leading digit
        cost = np.concatenate([cost + offset[block, s] for s in range(SYMBOLS)], axis=1)
        block = np.concatenate([step[block, s] for s in range(SYMBOLS)], axis=1)
    entries: dict[tuple[str, bytes, int, int], int] = {("", b"", 0, q): q for q in range(4)}
    trace = np.zeros((len(vectors), SYMBOLS, 4), np.int16)
    for v, behind in enumerate(vectors):
        for symbol in range(8):
            front = before(symbol, behind)
            role, more = divmod(symbol, 2)
            for state in range(4):
                q, letters, added, main = state, "", [], None
                while main is None:
                    kept = keeps(role, q)
                    if front[q] == DELETE + behind[q]:
                        letters, main, after = letters + "D", 0, q
                    elif front[q] == INSERT + front[NEXT[q]]:
                        q = NEXT[q]
                        letters += "I"
                        added.append(NAMES[q])
                    elif kept is not None and front[q] == TRUNCATED * more + behind[kept]:
                        letters, main, after = letters + "K", -1, kept
                    else:
                        letters, main, after = letters + "R", NEXT[q], NEXT[q]
                trace[v, symbol, state] = entries.setdefault((letters, b"\n".join(added), main, after), len(entries))
        trace[v, PAD] = np.arange(4)
    keys = list(entries)
    return Lookups(np.array(vectors), step, block, cost, trace, [k[0] for k in keys], [(k[1], k[2]) for k in keys], np.array([k[3] for k in keys]))


def solve(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each turn, state at each conversation's end, cost of each): turns that must go have entry -1 and cost nothing here."""
    t, n = lookups(), len(offsets) - 1
    real = np.flatnonzero(symbols < GONE)
    conv = np.searchsorted(offsets, real, "right") - 1
    length = np.bincount(conv, minlength=n)
    blocks = -(-length // BLOCK)
    first = np.append(0, blocks.cumsum())[:-1]
    place = np.arange(len(real)) - np.repeat(np.append(0, length.cumsum())[:-1], length) + first[conv] * BLOCK
    padded = np.full(int(blocks.sum()) * BLOCK, PAD, np.int64)
    padded[place] = symbols[real]
    padded = padded.reshape(-1, BLOCK)
    codes = padded @ (SYMBOLS ** np.arange(BLOCK)[::-1])
    order = np.argsort(-blocks, kind="stable")
    least = -blocks[order]

    behind = np.zeros(len(codes), np.int64)
    vector, cost = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s in range(int(blocks.max(initial=0))):
        on = order[: np.searchsorted(least, -s)]
        b = first[on] + blocks[on] - 1 - s
        behind[b] = vector[on]
        cost[on] += t.cost[vector[on], codes[b]]
        vector[on] = t.block[vector[on], codes[b]]
    cost += t.vectors[vector, START]

    state, found = np.zeros(n, np.int64), np.zeros(padded.shape, np.int16)
    for s in range(int(blocks.max(initial=0))):
        on = order[: np.searchsorted(least, -s)]
        b = first[on] + s
        chain = [behind[b]]
        for k in range(BLOCK - 1, 0, -1):  # the vectors between the turns of a block
            chain.append(t.step[chain[-1], padded[b, k]])
        for k in range(BLOCK):
            found[b, k] = t.trace[chain[BLOCK - 1 - k], padded[b, k], state[on]]
            state[on] = t.end[found[b, k]]
    entries = np.full(len(symbols), -1, np.int16)
    entries[real] = found.ravel()[place]
    return entries, state, cost


def tail_lines(state: int) -> list[bytes]:
    out = []
    for _ in range(TAIL[state]):
        state = NEXT[state]
        out.append(NAMES[state])
    return out


def letters_of(entries: np.ndarray, copies: np.ndarray) -> str:
    t = lookups().letters
    return "".join((t[e] if e >= 0 else "D") + "D" * (m - 1) for e, m in zip(entries.tolist(), copies.tolist(), strict=True))


def lines_of(entries: np.ndarray, roles: list[str], texts: list[str]) -> list[bytes]:
    """The lines that the turns leave, inserted ones included."""
    outputs, out = lookups().outputs, []
    for e, role, text in zip(entries.tolist(), roles, texts, strict=True):
        if e < 0:
            continue
        added, main = outputs[e]
        if added:
            out.append(added)
        if main:
            out.append((role.encode() + b":" if main < 0 else NAMES[main]) + text.encode())
    return out


def _counts(rows: dict[str, np.ndarray], offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each stretch of rows: counts of faults and of pairs inside it, its turns, and its first and last role class and turn."""
    at = offsets[:-1]
    add = lambda x: np.add.reduceat(x.astype(np.int64), at)
    blank, sym, m, role, turn, known = (rows[c] for c in ("blank", "sym", "copies", "role_class", "turn", "known"))
    inside = np.ones(len(sym), bool)
    inside[at] = False
    legal = np.zeros(len(sym), bool)
    for a, b in LEGAL:
        legal[1:] |= (role[:-1] == a) & (role[1:] == b)
    new = known & np.append(True, (turn[1:] != turn[:-1]) | ~known[:-1])
    new[at] = known[at]
    last = offsets[1:] - 1
    low = np.where(known, turn, np.iinfo(np.int64).max)
    high = np.where(known, turn, np.iinfo(np.int64).min)
    return {
        "blank": add(np.where(blank, m, 0)), "duplicate": add(np.where(blank, 0, m - (sym != GONE))), "truncated": add((sym < GONE) & (sym % 2 == 1)),
        "illegal": add(np.where(inside & ~legal, m, m - 1)), "gone": add(m - (sym != GONE)), "turns": add(new), "low": np.minimum.reduceat(low, at), "high": np.maximum.reduceat(high, at),
        "first_role": role[at], "last_role": role[last], "first_turn": turn[at], "first_known": known[at], "last_turn": turn[last], "last_known": known[last],
    }


def _gaps(low: int, high: int, turns: int) -> int:
    return high - low + 1 - turns if turns else 0


class Rows:
    """Sorted rows as columns."""

    NAMES = ("none", "conv", "turn", "role", "text", "sym", "blank", "copies")

    def __init__(self, table: pa.Table):
        self.table = table
        get = lambda c: table.column(c).to_numpy()
        self.none, self.conv = get("none").astype(bool), get("conv")
        turn = table.column("turn")
        self.numbers = {"sym": get("sym").astype(np.int64), "blank": get("blank").astype(bool), "copies": get("copies"), "known": ~np.asarray(turn.is_null()), "turn": turn.fill_null(0).to_numpy()}
        self.numbers["role_class"] = get("role_class").astype(np.int64)
        new = np.append(True, (self.conv[1:] != self.conv[:-1]) | (self.none[1:] != self.none[:-1]))[: len(self.conv)]
        self.offsets = np.append(np.flatnonzero(new), len(self.conv))


def _whole(rows: Rows) -> pa.RecordBatch:
    """Results of whole conversations."""
    c = _counts(rows.numbers, rows.offsets)
    entries, state, cost = solve(rows.numbers["sym"], rows.offsets)
    roles, texts = rows.table.column("role").to_pylist(), rows.table.column("text").to_pylist()
    audits, hashes = [], []
    for k, (a, z) in enumerate(zip(rows.offsets[:-1], rows.offsets[1:], strict=True)):
        audits.append(letters_of(entries[a:z], rows.numbers["copies"][a:z]) + "I" * TAIL[state[k]])
        hashes.append(hashlib.sha256(b"\n".join(lines_of(entries[a:z], roles[a:z], texts[a:z]) + tail_lines(int(state[k])))).hexdigest())
    gaps = [_gaps(int(a), int(b), int(n)) for a, b, n in zip(c["low"], c["high"], c["turns"], strict=True)]
    at = rows.offsets[:-1]
    n = len(at)
    columns = [pa.array(rows.none[at]), pa.array(rows.conv[at]), pa.array(gaps, pa.int64()), *(pa.array(c[x]) for x in ("blank", "duplicate", "truncated", "illegal")), pa.array(cost + DELETE * c["gone"]), pa.array(audits), pa.array(hashes)]
    columns += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=PASS_NAMES)


PASS = f"{PLACE}, {RESULT}, part long, seq long, data binary"
PASS_NAMES = [x.split()[0] for x in PASS.split(", ")]


def _piece(rows: Rows, part: int, seq: int) -> pa.RecordBatch:
    """A piece of one conversation."""
    values = {"none": bool(rows.none[0]), "conv": int(rows.conv[0]), "part": part, "seq": seq, "data": packed_rows(rows.table)}
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([values.get(x.split()[0])], kinds[x.split()[1]]) for x in PASS.split(", ")], names=PASS_NAMES)


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge the conversations inside a partition of sorted rows; hand on the first and the last of it, and long ones, in pieces."""
    from pyspark import TaskContext

    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
    begun = True  # the first conversation held may have begun elsewhere or in an earlier piece
    of: tuple | None = None  # the conversation of which pieces are out

    def split(rows: Rows, last: bool) -> Iterator[pa.RecordBatch]:
        """Results of what is complete; returns what is not."""
        nonlocal begun, seq, of
        o = rows.offsets
        lead = 0
        if begun or of == (bool(rows.none[0]), int(rows.conv[0])):
            if len(o) == 2 and not last and rows.table.nbytes < HELD_BYTES:
                return rows.table
            yield _piece(Rows(rows.table.slice(0, o[1])), part, seq)
            seq += 1
            of = (bool(rows.none[0]), int(rows.conv[0]))
            begun, lead = False, 1
        if len(o) - 1 - lead <= 0:
            return None
        if len(o) - 2 > lead:
            yield _whole(Rows(rows.table.slice(o[lead], o[-2] - o[lead])))
        rest = rows.table.slice(o[-2])
        if last or rest.nbytes >= HELD_BYTES:
            yield _piece(Rows(rest), part, seq)
            seq += 1
            of = (bool(rows.none[o[-2]]), int(rows.conv[o[-2]]))
            return None
        return rest

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= BATCH_BYTES or sum(x.num_rows for x in held) >= BATCH_ROWS:
            rest = yield from split(Rows(pa.Table.from_batches(held).combine_chunks()), False)
            held = rest.combine_chunks().to_batches() if rest is not None else []
            size = 0
    if held:
        yield from split(Rows(pa.Table.from_batches(held).combine_chunks()), True)


SYMBOLS_OF = f"{PLACE}, part long, seq long, sym binary, copies binary, facts array<long>"
FACTS = ("blank", "duplicate", "truncated", "illegal", "gone", "turns", "low", "high", "first_role", "last_role", "first_turn", "first_known", "last_turn", "last_known")


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte a turn and the counts of each piece."""
    for batch in batches:
        out = []
        for data in batch.column("data"):
            rows = Rows(unpacked_rows(data.as_py()))
            c = _counts(rows.numbers, rows.offsets)
            out.append((rows.numbers["sym"].astype(np.uint8).tobytes(), rows.numbers["copies"].astype("<i8").tobytes(), [int(c[x][0]) for x in FACTS]))
        sym, copies, facts = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("none", "conv", "part", "seq")), pa.array(sym, pa.binary()), pa.array(copies, pa.binary()), pa.array(facts, pa.list_(pa.int64()))], names=["none", "conv", "part", "seq", "sym", "copies", "facts"])


JUDGED = f"{PLACE}, part long, seq long, entries binary, tail int, {RESULT.rpartition(', ')[0]}"
JUDGED_NAMES = [x.split()[0] for x in JUDGED.split(", ")]


def _judged(rows: pa.Table) -> pa.Table:
    """The entries of each piece of a conversation, its results beside the first."""
    rows = rows.sort_by([("part", "ascending"), ("seq", "ascending")])
    sym = [np.frombuffer(x, np.uint8) for x in rows.column("sym").to_pylist()]
    copies = [np.frombuffer(x, "<i8") for x in rows.column("copies").to_pylist()]
    facts = [dict(zip(FACTS, x, strict=True)) for x in rows.column("facts").to_pylist()]
    every = np.concatenate(sym).astype(np.int64)
    entries, state, cost = solve(every, np.array([0, len(every)]))
    cuts = np.append(0, np.cumsum([len(x) for x in sym]))
    total = {x: sum(f[x] for f in facts) for x in FACTS[:6]}
    for f, g in zip(facts, facts[1:], strict=False):
        total["illegal"] += (f["last_role"], g["first_role"]) not in LEGAL
        total["turns"] -= bool(f["last_known"] and g["first_known"] and f["last_turn"] == g["first_turn"])
    gaps = _gaps(min(f["low"] for f in facts), max(f["high"] for f in facts), total["turns"])
    audit = letters_of(entries, np.concatenate(copies)) + "I" * TAIL[state[0]]
    first = lambda x, kind: pa.array([x] + [None] * (len(sym) - 1), kind)
    columns = [rows.column(x) for x in ("none", "conv", "part", "seq")]
    columns += [pa.array([entries[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([-1] * (len(sym) - 1) + [int(state[0])], pa.int32())]
    columns += [first(x, pa.int64()) for x in (gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], int(cost[0]) + DELETE * total["gone"])] + [first(audit, pa.string())]
    return pa.table(columns, names=JUDGED_NAMES)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired text of each piece, every line ended."""
    for batch in batches:
        out = []
        for data, entries, tail in zip(batch.column("data"), batch.column("entries"), batch.column("tail").to_pylist(), strict=True):
            rows = unpacked_rows(data.as_py())
            lines = lines_of(np.frombuffer(entries.as_py(), np.int16), rows.column("role").to_pylist(), rows.column("text").to_pylist())
            lines += tail_lines(tail) if tail >= 0 else []
            out.append(b"".join(x + b"\n" for x in lines))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("none", "conv", "part", "seq")), pa.array(out, pa.binary())], names=["none", "conv", "part", "seq", "lines"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's lines, which come in order."""
    of, digest, ends = None, None, b""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of[0]]), pa.array([of[1]]), pa.array([digest.hexdigest()])], names=["none", "conv", "repaired_sha256"])

    for batch in batches:
        for none, conv, lines in zip(batch.column("none").to_pylist(), batch.column("conv").to_pylist(), batch.column("lines"), strict=True):
            if of != (none, conv):
                if of is not None:
                    yield row()
                of, digest, ends = (none, conv), hashlib.sha256(), b""
            data = lines.as_py()
            if data:
                digest.update(ends + data[:-1])
                ends = data[-1:]
    if of is not None:
        yield row()


def damaged(conversations: DataFrame) -> DataFrame:
    """(none, conv, turn, role, text, copies): every twentieth turn or so is dropped, emptied, stripped of its sentence ends, repeated or given to the user."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    space = F.lit(" ")
    shown = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    rows = conversations.select(
        conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.alias("turn"), (F.crc32(shown.cast("binary")) % 20).alias("fault"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("none", "conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """(none, conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows (none, conv, turn, role, text, copies)."""
    spark = rows.sparkSession
    t = Tables(spark, "repair")
    rows = rows.groupBy("none", "conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    key = ["none", "conv", "role", "digest"]
    when = F.struct(F.col("turn").isNotNull(), "turn")
    rows = t.keep(rows.withColumns({"last": last, "digest": F.md5("text")}))
    first = rows.groupBy(*key).agg(F.min(when).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, key, "left").withColumn("again", F.coalesce(when != F.col("first"), F.lit(False)))
    role = F.left("role", F.lit(1))
    number = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    blank = F.col("last") == ""
    symbol = F.when(blank | F.col("again"), GONE).otherwise(number * 2 + (~F.col("last").isin(".", "!", "?")).cast("int"))
    rows = rows.select("none", "conv", "turn", "role", "text", symbol.alias("sym"), blank.alias("blank"), "copies", number.alias("role_class"))

    order: list[Column | str] = ["none", "conv", F.col("turn").asc_nulls_first()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "role", "text")
    found = t.keep(dealt.mapInArrow(_pass, PASS))
    names = [x.split()[0] for x in f"{PLACE}, {RESULT}".split(", ")]
    done = found.where("data is null").select(*names)

    pieces = found.where("data is not null").select("none", "conv", "part", "seq", "data")
    judged = t.keep(pieces.mapInArrow(_symbols, SYMBOLS_OF).groupBy("none", "conv").applyInArrow(_judged, JUDGED))
    texts = pieces.join(judged.select("none", "conv", "part", "seq", "entries", "tail"), ["none", "conv", "part", "seq"]).mapInArrow(_repaired, f"{PLACE}, part long, seq long, lines binary")
    hashes = texts.repartition(parts, "none", "conv").sortWithinPartitions("none", "conv", "part", "seq").mapInArrow(_hashed, f"{PLACE}, repaired_sha256 string")
    crossing = judged.where("cost is not null").drop("part", "seq", "entries", "tail").join(hashes, ["none", "conv"])
    return done.unionByName(crossing.select(*names))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations`` after ``damaged``; those that lose every turn have zeros."""
    found = repair(damaged(conversations))
    conv = F.col("conv_id").cast("long")
    every = conversations.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv")).distinct().join(found, ["none", "conv"], "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return every.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
