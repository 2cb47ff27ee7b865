"""URL verdicts: listed rules first, then gradient-boosted trees on lexical features.

A rule holds for its host and all subdomains where the path begins with the
rule's; the longest rule that fits wins (ties: the rule listed first).  URLs
without a rule get the verdict of a boosted tree ensemble trained, in numpy,
from labelled URLs: length, depth, digit ratio, entropy, parameter counts and
suffix statistics.  Training uses a bounded sample of different URLs (``MAX_SAMPLE`` of either
label, smallest hash first); the statistics of suffixes and first segments are
aggregated over all labelled URLs, kept as tables and joined to the URLs.  A
URL of the sample gets them without the URLs of its own fold (hosts are dealt
into ``FOLDS``), so the trees learn how far the statistics of other hosts can be
trusted.  Each tree sees half of the features, so none decides alone.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is judged by the trees on its (empty) features; with labels of
one kind only, the trees always say that kind, and "allow" without any; rows
that repeat a URL or id each give a row and count in the statistics, but the
trees learn a URL once; a URL labelled both ways is learned as bad; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.llm.stage import Tables, sampled

MAX_SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 40, 3, 0.2, 32, 20, 1.0
SUFFIX_WEIGHT = 10.0
SALTS = 16
#: folds of labelled hosts
FOLDS = 5
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "parameters", "query_length", "fragment", "secure", "suffix_rate", "segment_rate"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one.  ``rules``: (verdict, rule)."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # longer rules are asked first, so they come last here
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def segment_of(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.lit(1))


def _features(url: pd.Series, host: pd.Series, path: pd.Series, suffix_rate: pd.Series, segment_rate: pd.Series) -> np.ndarray:
    url = url.fillna("")
    tail = url.str.replace("(?s)#.*", "", regex=True).str.replace(r"(?s)^[^?]*\??", "", regex=True)
    digits = url.str.count("[0-9]")
    columns = [
        url.str.len(), host.str.len(), path.str.len(), path.str.count("/"), host.str.count(r"\.") + (host != ""), digits / url.str.len().clip(lower=1),
        host.str.count("[0-9]"), host.str.count("-"), host.map(_entropy), tail.str.count("=") , tail.str.len(), url.str.contains("#", regex=False), url.str.startswith("https"), suffix_rate, segment_rate,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1) if len(url) else np.zeros((0, len(FEATURES)))


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    _, n = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


class Boosted:
    """Depth-limited trees on binned features, grown by Newton steps on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.0
            return
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f, rng = np.full(len(y), self.base), np.random.default_rng(11)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, p - y, p * (1 - p), rng.permutation(x.shape[1])[: -(-x.shape[1] // 2)])
            self.trees.append(tree)
            f += self._leaf(tree, bins)

    def _grow(self, bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, seen: np.ndarray):
        feature, cut, value = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS), np.zeros(2**DEPTH)
        node = np.zeros(len(grad), np.int64)
        for depth in range(DEPTH):
            wide = 2**depth
            best = np.full(wide, 1e-6)
            for k in seen.tolist():
                at = node * BINS + bins[:, k]
                g, h, n = (np.bincount(at, w, wide * BINS).reshape(wide, BINS).cumsum(1) for w in (grad, hess, None))
                score = lambda a, b: a * a / (b + RIDGE)
                gain = score(g, h) + score(g[:, -1:] - g, h[:, -1:] - h) - score(g[:, -1:], h[:, -1:])
                gain[(n < LEAST) | (n[:, -1:] - n < LEAST)] = -1
                top = gain.argmax(1)
                better = gain[np.arange(wide), top] > best
                best[better] = gain[np.arange(wide), top][better]
                own = wide - 1 + np.flatnonzero(better)
                feature[own], cut[own] = k, top[better]
            at = wide - 1 + node
            node = 2 * node + (bins[np.arange(len(node)), feature[at]] > cut[at])
        g, h = np.bincount(node, grad, 2**DEPTH), np.bincount(node, hess, 2**DEPTH)
        value[:] = -RATE * g / (h + RIDGE)
        return feature, cut, value

    def _leaf(self, tree, bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(bins), np.int64)
        for depth in range(DEPTH):
            at = 2**depth - 1 + node
            node = 2 * node + (bins[np.arange(len(node)), feature[at]] > cut[at])
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        bins = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        return 1 / (1 + np.exp(-(self.base + sum((self._leaf(t, bins) for t in self.trees), np.zeros(len(x))))))


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Rows with __host, __path, __suffix and __segment beside them."""
    u = F.col(url).cast("string")
    rows = urls.withColumn("__url", u).withColumn("__host", host_of(u)).withColumn("__path", path_of(u))
    return rows.withColumn("__suffix", suffix_of(F.col("__host"))).withColumn("__segment", F.coalesce(segment_of(F.col("__path")), F.lit("")))


def counts_of(labelled: DataFrame, name: str) -> DataFrame:
    """(name, __fold, n, bad): labelled rows of each value of a column in each fold, and how many of them are bad."""
    return labelled.groupBy(name, "__fold").agg(F.count("*").alias("n"), F.sum("__bad").alias("bad"))


def rates(counts: DataFrame, name: str, prior: float) -> DataFrame:
    """(name, name_rate): the share of bad rows of each value, drawn to the prior."""
    summed = counts.groupBy(name).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return summed.select(name, ((F.col("bad") + SUFFIX_WEIGHT * prior) / (F.col("n") + SUFFIX_WEIGHT)).alias(f"{name}_rate"))


def rates_of_others(sample: DataFrame, counts: DataFrame, name: str, prior: float) -> DataFrame:
    """``sample`` with name_rate from the rows of other folds."""
    summed = counts.groupBy(name).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    own = counts.select(name, "__fold", F.col("n").alias("own"), F.col("bad").alias("own_bad"))
    rest = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    rate = (rest("bad", "own_bad") + SUFFIX_WEIGHT * prior) / (rest("n", "own") + SUFFIX_WEIGHT)
    return sample.join(summed, name, "left").join(own, [name, "__fold"], "left").withColumn(f"{name}_rate", rate).drop("n", "bad", "own", "own_bad")


def with_rates(rows: DataFrame, tables: dict[str, DataFrame], prior: float) -> DataFrame:
    """Rows with the rate of their suffix and first segment beside them; the prior where no labelled row has it.  A frequent value is dealt over ``SALTS`` tasks."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__url"), F.lit(SALTS)))
    for name, table in tables.items():
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(salted, [name, "__salt"], "left").withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(prior)))
    return rows.drop("__salt")


@dataclass
class UrlModel:
    """Trees, the rates of every suffix and first segment, and the share of bad labelled URLs."""

    trees: Boosted
    tables: dict[str, DataFrame]
    prior: float


def train(labelled: DataFrame, limit: int = MAX_SAMPLE) -> UrlModel:
    """A model from rows of ``parts`` with a label __bad (0 or 1); the trees learn from ``limit`` URLs of either label."""
    labelled = labelled.withColumn("__fold", F.pmod(F.xxhash64("__host"), F.lit(FOLDS)))
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("__bad"), F.lit(0))).first()
    prior = bad / n if n else 0.0
    t = Tables(labelled.sparkSession, "url")
    counts = {name: t.keep(counts_of(labelled, name)) for name in ("__suffix", "__segment")}
    once = labelled.groupBy("__url").agg(F.max("__bad").alias("__bad"), *(F.first(c).alias(c) for c in ("__host", "__path", "__suffix", "__segment", "__fold")))
    sample = t.keep(sampled(t.keep(once), "__bad", limit, "__url"))
    for name, counted in counts.items():
        sample = rates_of_others(sample, counted, name, prior)
    rows = sample.withColumn("__order", F.xxhash64("__url")).toPandas().sort_values(["__bad", "__order", "__url"])
    x = _features(*(rows[c] for c in ("__url", "__host", "__path", "__suffix_rate", "__segment_rate")))
    return UrlModel(Boosted(x, rows["__bad"].to_numpy(np.float64)), {name: t.keep(rates(counted, name, prior)) for name, counted in counts.items()}, prior)


def scored(rows: DataFrame, model: UrlModel) -> DataFrame:
    """Rows of ``parts`` with the trees' score: how likely a URL is bad."""
    shared = rows.sparkSession.sparkContext.broadcast(model.trees)  # TREES of DEPTH

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(shared.value.score(_features(*columns)))

    return with_rates(rows, model.tables, model.prior).withColumn("score", score("__url", "__host", "__path", "__suffix_rate", "__segment_rate"))


def judge(urls: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, score): the rules' verdicts, and those of trees trained from the URLs that rules label."""
    rows = parts(urls.select(F.col(id_column), F.col("url").cast("string").alias("url")))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumn("__rule", rule).withColumn("__verdict", verdict)
    labelled = rows.where("__verdict is not null").withColumn("__bad", (F.col("__verdict") == "block").cast("int"))
    found = scored(rows, train(labelled))
    said = F.coalesce("__verdict", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return found.select(id_column, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), said.alias("verdict"), "score")
