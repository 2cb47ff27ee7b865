"""The stored index, grids of blocks, ranks in pieces, snapping and alignment against plain Python."""

import difflib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from varaka.operators import evaluate as E
from varaka.operators import index as X
from varaka.operators import ranks
from varaka.operators.index import StoredIndex
from varaka.operators.retrieve import Bm25Index, dense_topk
from varaka.sources import io


def words(rng, n):
    return " ".join(f"{'abcdefghij'[min(int(rng.expovariate(0.5)), 9)]}{rng.choice('klmn')}elime" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(k * 3, words(rng, rng.randint(0, 60))) for k in range(400)] + [(5000, None), (5001, "")]
    asked = [(k, words(rng, 3)) for k in range(12)] + [(90, "tekilke"), (91, ""), (92, "akelime " * 4)]
    return spark.createDataFrame(rows, "pos long, text string"), spark.createDataFrame(asked, "query_id long, query string")


def ranking(df):
    return {(r["query_id"], r["rank"]): (r["pos"], round(r["score"], 7)) for r in df.collect()}


def test_stored_index_equals_the_plain_one(spark, corpus, monkeypatch):
    chunks, asked = corpus
    monkeypatch.setattr(X, "BLOCK", 16)
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}/index"
    index = StoredIndex(spark, folder).extend(chunks.where("pos % 2 = 0"))
    assert ranking(index.topk(asked, 10)) == ranking(Bm25Index(chunks.where("pos % 2 = 0").fillna("")).topk(asked, 10))
    index.extend(chunks.where("pos % 2 = 1"))
    again = StoredIndex(spark, folder)  # as a later run opens it
    assert ranking(again.topk(asked, 10)) == ranking(Bm25Index(chunks.fillna("")).topk(asked, 10))
    assert again.n_docs == 402 and len(again.log) == 2
    with pytest.raises(ValueError):
        again.extend(chunks.where("pos = 6"))


def test_only_blocks_of_asked_terms_are_read(spark, corpus):
    chunks, _ = corpus
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}/index"
    index = StoredIndex(spark, folder).extend(chunks)
    term = spark.createDataFrame([("akelim",)], "term string")
    every = {r["file"] for r in index._read("postings").select(F.input_file_name().alias("file")).distinct().collect()}
    read = index.blocks(term).select("term", F.input_file_name().alias("file")).collect()
    assert {r["term"] for r in read} == {"akelim"} and len({r["file"] for r in read}) < len(every)
    assert index.blocks(spark.createDataFrame([("zzz",)], "term string")).count() == 0


def test_an_extension_that_was_cut_off_is_not_seen(spark, corpus):
    chunks, asked = corpus
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}/index"
    index = StoredIndex(spark, folder).extend(chunks.where("pos % 2 = 0"))
    chunks.where("pos % 2 = 1").write.parquet(f"{folder}/segments/half/postings")  # no row of the log
    assert ranking(StoredIndex(spark, folder).topk(asked, 5)) == ranking(index.topk(asked, 5))


def test_blocks_keep_their_postings():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        pos = np.cumsum(rng.integers(1, 1 << 34, n))
        tf, dl = rng.integers(1, 300, n), rng.integers(1, 70_000, n)
        if n > 1:
            found = X.decode(n, int(pos[0]), X.encode(pos, tf, dl))
            assert all((a == b).all() for a, b in zip(found, (pos, tf, dl), strict=True))
        else:
            assert X.encode(pos, tf, dl) == b""


def test_dense_topk_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8)).round(2)
    rows = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(700)] + [(900, None)], "pos long, vector array<double>").repartition(5)
    asked = rows.where("pos % 7 = 0").withColumnRenamed("pos", "query_id")
    from varaka.operators import grid

    meet = grid.meet
    monkeypatch.setattr(grid, "meet", lambda *a: meet(*a, rows=(9, 31), blocks=(2, 3)))
    found = {(r["query_id"], r["rank"]): (r["pos"], r["score"]) for r in dense_topk(asked, rows, 5, same=False).collect()}
    for q in range(0, 700, 7):
        scores = np.round(v @ v[q], 6)
        order = [k for k in np.lexsort((np.arange(700), -scores)) if k != q][:5]
        assert [found[q, r + 1] for r in range(5)] == [(k, scores[k]) for k in order]
    assert len(found) == 500


def test_ranks_of_a_large_group(spark):
    rng = random.Random(3)
    rows = [("big" if k % 10 else None, rng.randint(0, 10**6), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "topic string, at long, id long")
    order = [F.col("at"), F.col("id")]
    found = ranks.ranked(df, ["topic"], order, pieces=9).collect()
    last = ranks.before_each(df, ["topic"], order, "id", 15, pieces=40).collect()
    for topic in ("big", None):
        want = [r[2] for r in sorted((r for r in rows if r[0] == topic), key=lambda r: (r[1], r[2]))]
        assert {r["id"]: r["rank"] for r in found if r["topic"] == topic} == {x: k + 1 for k, x in enumerate(want)}
        assert {r["id"]: r["recent"] for r in last if r["topic"] == topic} == {x: want[max(0, k - 15) : k] for k, x in enumerate(want)}
    assert ranks.ranked(df.where("1 = 0"), ["topic"], order).count() == 0


def test_snapping_equals_a_full_scan(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_type", "p_name").collect()
    labels = sorted({r["p_type"] for r in table} | {r["p_name"] for r in table})
    values = sorted({x[1:] for x in labels} | {x[::-1] for x in labels[:60]} | {"", "é", labels[0]})
    found = E.snap_to_label(spark.createDataFrame([(v,) for v in [*values, None]], "value string"), "value", spark.createDataFrame([(x,) for x in labels], "label string"), "label")
    want = {v: max(labels, key=lambda x: difflib.SequenceMatcher(None, x, v).ratio()) for v in values}
    assert {r["value"]: r["snapped"] for r in found.collect()} == want


def matrix_equal(a, b):
    cost = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, equal = len(a), len(b), [False] * len(a)
    while i > 0:
        if j > 0 and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            equal[i - 1] = a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return equal


def test_alignment_equals_the_matrix_and_needs_little_memory():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abıi") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert E.aligned_equal(np.array([*a], "U1"), np.array([*b], "U1")).tolist() == matrix_equal(a, b)
    import tracemalloc

    a = np.array([rng.choice("abcdefıi") for _ in range(6000)], "U1")
    b = np.delete(a, rng.sample(range(6000), 300))
    tracemalloc.start()
    assert E.aligned_equal(a, b).sum() == len(b)
    assert tracemalloc.get_traced_memory()[1] < 30e6  # the matrix has 137 MB


def test_generated_rows_are_stored_once(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/store"
    wanted = spark.createDataFrame([("a", k) for k in range(6)] + [("b", 0)], "type string, seq long")
    made = lambda rows, tag: rows.withColumn("content", F.concat(F.lit(tag), "seq"))
    assert io.resume(wanted, path).count() == 7
    io.checkpoint(made(wanted.where("seq < 3"), "x"), path, "one")
    io.checkpoint(made(wanted.where("seq < 4"), "x"), path, "one")  # the attempt again, as after a loss
    io.checkpoint(made(wanted.where("seq < 5"), "y"), path, "two")  # overlaps what is stored
    assert {(r["type"], r["seq"]) for r in io.resume(wanted, path).collect()} == {("a", 5)}
    rows = io.stored_rows(spark, path).collect()
    assert len(rows) == 6 and {r["content"] for r in rows if r["seq"] < 4} == {"x0", "x1", "x2", "x3"}


def test_scored_pairs_are_never_rows(spark):
    """Queries and chunks meet in blocks: no step of the plan has a row for each pair of a query and a chunk that share a term."""
    chunks = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("ortak kelime "), F.col("id").cast("string")).alias("text"))
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("ortak kelime "), F.col("id").cast("string")).alias("query"))
    index = Bm25Index(chunks)
    for found in (index.topk(asked, 5), index.overlap(asked, 5)):
        rows = found.collect()
        assert len(rows) == 40 * 5 and all(r["pos"] == r["query_id"] for r in rows if r["rank"] == 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(tokens" not in plan
    assert [r["pos"] for r in index.topk(spark.createDataFrame([(7, "xyz"), (8, "")], "query_id long, query string"), 3).orderBy("query_id", "rank").collect()] == [0, 1, 2] * 2
    assert index.overlap(spark.createDataFrame([(7, "xyz")], "query_id long, query string"), 3).count() == 0
