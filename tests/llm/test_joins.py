"""The similarity join by parity sketches against brute force, and words that only their bytes tell apart."""

import numpy as np
import pandas as pd
import pyarrow as pa

from varaka.llm import bpe, decontaminate, linked_sets, lm_score, minhash_dedup, parity_join, queries, stage
from varaka.llm.text import words

from test_operators import ODD, SF, brute_windows, docs, empty, found_windows, odd, true_components


def test_parity_join(spark):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    for df, rows in ((odd(spark), ODD), (queries.table(spark, SF, "documents"), list(zip(table.doc_id, table.text, strict=True)))):
        expected, sets = true_components(rows, 5)
        found = parity_join.similar_documents(df).collect()
        assert len(found) == len(rows)
        for r in found:
            if r["doc_id"] is not None:
                assert (r["component_id"], r["n_shingles"]) == (expected[r["doc_id"]], len(sets[r["doc_id"]]))
    assert parity_join.similar_documents(empty(spark)).count() == 0


def test_parity_join_near_the_threshold(spark):
    rng, rows, i = np.random.default_rng(5), [], 0
    for n in (5, 6, 8, 9, 10, 13, 18, 30, 70, 200, 900):
        for _ in range(6):
            base = [f"b{i}-{k}" for k in range(n + 4)]
            rows.append((i, " ".join(base)))
            for cut in rng.integers(0, max(2, n // 4) + 1, 2):  # each word cut from the end takes one shingle
                rows.append((i + 1 + int(cut), " ".join(base[: len(base) - int(cut)])))
            i += 1000
    rows = list({i: (i, t) for i, t in rows}.values())
    expected, _ = true_components(rows, 5)
    found = {r["doc_id"]: r["component_id"] for r in parity_join.similar_documents(docs(spark, rows)).collect()}
    assert found == expected


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(11)
    for n in [*range(1, 40), 64, 100, 250, 1000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            d = int(rng.integers(0, 2 * n // 9 + 2))
            less = int(rng.integers(0, min(d, n - 1) + 1))
            b = np.unique(np.append(rng.permutation(a)[less:], rng.integers(0, 1 << 63, d - less, np.uint64)))
            both = len(np.intersect1d(a, b))
            if len(a) != both or len(b) != both:
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    x, y = parity_join.probes(a, 4, 5), parity_join.probes(b, 4, 5)
                    assert any(len(np.intersect1d(g[1:], h[1:])) >= max(g[0], h[0]) for g in x for h in y)
                    assert len(np.intersect1d(parity_join.part_keys(a, 4, 5), parity_join.part_keys(b, 4, 5)))


def test_sets_keep_their_rarest_parts(spark):
    # all share a half with 59 others, which is no link; 4 pairs differ in little
    rng = np.random.default_rng(12)
    new = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    common, sets = new(600), []
    for k in range(60):
        sets.append(np.unique(np.concatenate([common, new(600)])))
        if k < 4:
            sets.append(np.unique(np.append(rng.permutation(sets[-1])[(30, 60, 90, 120)[k] :], new((30, 60, 90, 10)[k]))))
    linked = {(i, j) for i in range(64) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(linked) == 4
    rows = [(k, b"", [g.tolist() for g in parity_join.part_groups(s, 4, 5)]) for k, s in enumerate(sets)]
    having = {}
    for r in linked_sets._rarest(spark.createDataFrame(rows, linked_sets.SETS)).collect():
        having.setdefault(r["key"], []).append(r["doc_id"])
    met = {(i, j) for nodes in having.values() for i in nodes for j in nodes if j < i}
    assert linked <= met
    every = [set(parity_join.part_keys(s, 4, 5)) for s in sets]
    assert sum(bool(every[i] & every[j]) for i in range(64) for j in range(i)) > 1000 and len(met) < 100


def test_crowded_sets_meet():
    # 5 shingles of one part: fewer parts that are not zero than the bound, so the common key is sent
    one = np.arange(5, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(7)
    keys = parity_join.part_keys(np.sort(one), 4, 5)
    other = parity_join.part_keys(np.sort(one[:4]), 4, 5)
    assert len(np.intersect1d(keys, other))


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_structured_words_apart():
    for n in (2, 4, 8, 16, 32, 64, 128, 1024, 65536):
        for w in words(pa.array([" ".join(thue_morse(n))]), second=True, prefixes=(4, 5)):
            assert len(set(w.hashes)) == len(set(w.second)) == 2 and not set(w.hashes) & set(w.second)


def test_operators_tell_structured_words_apart(spark):
    for n in (1024, 65536):
        x, y = thue_morse(n)
        twelve = " ".join(f"w{k}" for k in range(12))
        rows = [(1, f"{x} {twelve}"), (2, f"{y} {twelve}")]
        assert found_windows(docs(spark, rows)) == brute_windows(rows)
        short = docs(spark, [(1, f"{x} one two three"), (2, f"{y} one two three")])
        assert {r["component_id"] for r in minhash_dedup.near_duplicates(short).collect()} == {1, 2}
        assert {r["component_id"] for r in parity_join.similar_documents(short).collect()} == {1, 2}
        # crc32("2") % 7 == 2 is not needed here: one of the ids from 1 to 20 is held out, the others train
        many = docs(spark, [(k, f"{x} z") for k in range(1, 21)])
        scored = {r["doc_id"]: r for r in lm_score.scores(many).collect()}
        held = next(k for k, r in scored.items() if r["held_out"])
        mixed = docs(spark, [(k, f"{y if k == held else x} z") for k in range(1, 21)])
        assert scored[held]["n_known"] == 3 and {r["doc_id"]: r for r in lm_score.scores(mixed).collect()}[held]["n_known"] == 2
        item = spark.createDataFrame([(9, " ".join([x] * 3 + [f"w{k}" for k in range(10)]))], "item_id long, text string")
        clean = docs(spark, [(1, " ".join([y] * 3 + [f"w{k}" for k in range(10)]))])
        assert decontaminate.overlaps(clean, item).count() == 0


def test_bpe_takes_bounded_parts(spark, monkeypatch):
    v, learned = bpe.Vocabulary(bpe.default_path()), []
    learn = v.learn
    monkeypatch.setattr(v, "learn", lambda chunks: learned.append(len(chunks)) or learn(chunks))
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(100)]
    ids, decoded = v.run(texts)
    assert sum(learned) == 30_000 and max(learned) <= 10_000
    assert (ids[7], decoded[7]) == tuple(x[0] for x in bpe.Vocabulary(bpe.default_path()).run(texts[7:8]))
    sizes = [3, 400_000, 200_000, 0, 1_000_000, 5, *[1] * 1200]
    batch = pa.record_batch({"doc_id": range(len(sizes) + 1), "text": [*("a" * n for n in sizes), None]})
    cut = list(bpe.parts(batch))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in cut] == [3, 2, 500, 500, 202]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        stage.small_batches(spark)
        rows = spark.range(5000, numPartitions=1).mapInArrow(lambda b: (pa.record_batch({"n": [x.num_rows]}) for x in b), "n long").collect()
        assert max(r["n"] for r in rows) <= 1000 and sum(r["n"] for r in rows) == 5000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def exploded_below_a_broadcast(plan):
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.split("== Initial Plan ==")[0].split("\n")]
    for i, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((k for k in range(i + 1, len(lines)) if lines[k][0] <= depth), len(lines))
            if any("Generate explode" in x or "Generate posexplode" in x for _, x in lines[i + 1 : below]):
                return True
    return False


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    # Spark takes an array for one element, so keys of 200,000 sets seem to fit a broadcast
    plans, keep = [], stage.Tables.keep

    def watched(self, df, *partition_by):
        if "Generate" in df._jdf.queryExecution().optimizedPlan().toString():
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, *partition_by)

    monkeypatch.setattr(stage.Tables, "keep", watched)
    rng = np.random.default_rng(17)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(60)]
    table = docs(spark, list(enumerate(base + [t + " more" for t in base[:20]])))
    for found in (minhash_dedup.near_duplicates(table), parity_join.similar_documents(table)):
        assert found.where("component_id < doc_id").count() == 20
    assert len(plans) >= 3
    assert not any(map(exploded_below_a_broadcast, plans))
