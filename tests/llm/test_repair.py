"""Repair of conversations against a search over all repairs, and the odd cases of its contract."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest

from varaka.llm import queries, repair

from test_operators import SF

BLANKS = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def moves(state):
    return {"u": 2} if state in (0, 1, 3) else {"a": 3}


def search(turns):
    """(cost, audit, lines) of turns (role, text, gone, cut), by all choices at each place."""

    @lru_cache(None)
    def best(i, q, added):
        found = []
        if i == len(turns):
            if q in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, gone, cut = turns[i]
            c, a, lines = best(i + 1, q, 0)
            found.append((c + 3, "D" + a, lines))
            if not gone:
                targets = dict(moves(q), **({"s": 1} if q == 0 else {}))
                if role[:1] in targets:
                    c, a, lines = best(i + 1, targets[role[:1]], 0)
                    found.append((c + cut, "K" + a, (f"{role}:{text}", *lines)))
                for to, name in ((2, "user"), (3, "assistant")):
                    if to in moves(q).values():
                        c, a, lines = best(i + 1, to, 0)
                        found.append((c + 2 + cut, "R" + a, (f"{name}:{text}", *lines)))
        if added < 4:
            for to in moves(q).values():
                c, a, lines = best(i, to, added + 1)
                found.append((c + 2, "I" + a, (("user:", "assistant:")[to - 2], *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, 0, 0)


def expected(rows):
    """Results by conv_id of rows (conv_id, turn, role, text)."""
    of, space = defaultdict(list), lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        of[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, held in of.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in held:
            bare = text.strip(BLANKS)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role, text, fault in (0, 1), int(fault == 2)))
        cost, audit, lines = search(tuple(turns))
        known = [t for t, _, _ in held if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in names) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, sym string, part int")


def test_lookups_are_few_and_blocks_agree_with_single_turns():
    t = repair.lookups()
    assert len(t.vectors) < 100 and t.block.shape == (len(t.vectors), repair.SYMBOLS**repair.BLOCK)
    rng = np.random.default_rng(1)
    for _ in range(200):
        block, v = rng.integers(0, 8, repair.BLOCK), int(rng.integers(0, len(t.vectors)))
        vector = tuple(int(x) for x in t.vectors[v])
        for s in block[::-1]:
            vector = repair.before(int(s), vector)
        code = int(block @ (repair.SYMBOLS ** np.arange(repair.BLOCK)[::-1]))
        assert [x + t.cost[v, code] for x in t.vectors[t.block[v, code]]] == list(vector)


def test_repair_by_search(spark):
    random.seed(7)
    texts = ["a.", "b?", "c", "d!", " ", "", "e\n", "f. \t", None]
    rows = []
    for conv in range(300):
        for turn in range(random.randint(1, 11)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, random.choice([turn, turn, turn, turn + 3, None]), role, random.choice(texts)))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, "user", "x")]
    want = expected(rows)
    got = found(repair.repaired_conversations(frame(spark, rows)))
    assert set(got) == {r[0] for r in rows}
    for conv, values in got.items():
        assert values == want.get(conv, (0, 0, 0, 0, 0, 0, "", EMPTY))


def test_repair_of_the_given_table(spark):
    table = pd.read_parquet(f"{SF}/conversations.parquet")
    want = expected([(int(r.conv_id), int(r.turn), r.role, r.text) for r in table.itertuples()])
    got = found(queries.QUERIES["op13_conversation_repair"](spark, SF))
    assert {k: v for k, v in got.items() if k in want} == want and len(got) == table.conv_id.nunique()


@pytest.mark.parametrize("batch, held", [(20_000, 32_000_000), (7, 400)])
def test_a_conversation_over_many_partitions(spark, monkeypatch, batch, held):
    random.seed(3)
    monkeypatch.setattr(repair, "BATCH_ROWS", batch)
    monkeypatch.setattr(repair, "HELD_BYTES", held)
    rows = [(5, k, random.choice(["user", "assistant"]), random.choice([f"t{k}.", f"t{k}", "same."])) for k in range(400)]
    rows += [(k, 0, "user", "hi.") for k in range(20, 40)] + [(k, 1, "assistant", "yes.") for k in range(20, 40)]
    want = expected(rows)
    got = found(repair.repaired_conversations(frame(spark, rows)))
    for conv, values in got.items():
        assert values == want.get(conv, (0, 0, 0, 0, 0, 0, "", EMPTY)), conv


def test_many_copies_of_one_turn_and_empty_tables(spark):
    rows = [(1, 1, "user", "hello.")] * 500 + [(1, 2, "assistant", "x" * 200_000 + ".")]
    assert found(repair.repaired_conversations(frame(spark, rows))) == expected(rows)
    assert repair.repaired_conversations(frame(spark, rows).where("1 = 0")).count() == 0
