"""Document quality by hierarchical empirical Bayes.

A logistic classifier on text statistics gives every document its own evidence.
Sites (host) and their sections (path) get posteriors by grouped aggregation
over all documents: the expected number of good documents in the group, shrunk
to the level above by a Beta prior, sections to their host and hosts to the
whole corpus, so a sparse site stays near the global rate.  How strongly is
estimated from the spread of the group rates (method of moments).  A document's
score adds its section's log odds, relative to the whole corpus, to its own.

The classifier learns from a bounded sample (``MAX_SAMPLE`` of either label,
smallest hash first) of rows that are not held out; all else covers all rows.

Defined cases: null or empty texts have all statistics 0 and are scored; a null
host or path is a group of its own; labels that are null or neither 0 nor 1 are
ignored; without both labels the classifier's evidence is 0 and the score the
rate of the label there is; rows that repeat a doc_id each count and each give
a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.llm.stage import Tables, sampled

MAX_SAMPLE = 20_000
STEPS = 12
#: weight of a section's log odds beside the document's own evidence
SITE_WEIGHT = 0.5
FEATURES = ["chars", "words", "word_length", "letters", "upper", "digits", "marks", "odd_marks", "pipes", "lines", "repeated_lines", "distinct_words", "stops", "ends", "end_stops"]


def statistics(text: Column) -> list[Column]:
    """Text statistics as column expressions; shares are of characters, words or lines."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    share = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n
    of = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    words = F.filter(F.split(t, r"[ \t-\r]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    return [
        F.log1p(F.length(t)), F.log1p(F.size(words)), n / n_words, share(r"\p{L}+"), share(r"\p{Lu}+"), of("0123456789"), of(".,;:'\""), of("#$%&*!|@=<>{}[]\\~^"), of("|"),
        F.log1p(F.size(lines)), 1 - F.size(F.array_distinct(lines)) / F.size(lines), F.size(F.array_distinct(words)) / n_words,
        F.log1p(F.regexp_count(t, F.lit(r"[.] "))) , F.regexp_count(t, F.lit(r"[.!?]\n")) / F.size(lines), t.endswith(".").cast("double"),
    ]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(means, scales, weights, intercept) of a ridge-penalised logistic fit by Newton steps; balanced classes."""
    if len(y) == 0 or y.min() == y.max():
        k = len(FEATURES)
        return np.zeros(k), np.ones(k), np.zeros(k), 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), -6, 6)
    each = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(x.shape[1], 1.0), 1e-6)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = each * p * (1 - p) + 1e-6
        w -= np.linalg.solve((z * h[:, None]).T @ z + np.diag(ridge), z.T @ (each * (p - y)) + ridge * w)
    return mean, scale, w[:-1], float(w[-1])


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, rate: Column) -> float:
    """Size of the Beta prior from the spread of group rates around ``rate``, by the method of moments.

    With n rows and rate r each, the expected squared deviation is
    v * (1/n + (1 - 1/n) / (strength + 1)), v = rate * (1 - rate).
    """
    v = rate * (1 - rate)
    n = F.col("n").cast("double")
    sums = groups.where("n > 1").agg(F.sum(n * F.pow(F.col("good") / n - rate, 2)), F.sum(v), F.sum(v * (n - 1))).first()
    square, noise, full = (float(x or 0) for x in sums)
    if full <= 0 or square <= noise:
        return 1000.0
    return float(min(1000.0, max(1.0, full / (square - noise) - 1)))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, held_out, evidence, host_rate, path_rate, score, keep) for every row."""
    t = Tables(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("__host"), F.col(path).cast("string").alias("__path"), *(c.cast("double").alias(f"__{n}") for n, c in zip(FEATURES, statistics(F.col("text")), strict=True)))
    rows = t.keep(rows)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("__label")).where("__label in (0, 1) and doc_id is not null")
    marked = marked.where(~held_out()).groupBy("doc_id").agg(F.min("__label").alias("__label"))
    # of rows that repeat an id one counts
    near = rows.join(sampled(marked, "__label", MAX_SAMPLE, "doc_id"), "doc_id").groupBy("doc_id", "__label").agg(F.min(F.struct(*(f"__{n}" for n in FEATURES))).alias("x"))
    sample = near.select("__label", *(f"x.__{n}" for n in FEATURES)).toPandas()
    y = sample["__label"].to_numpy(np.float64)
    mean, scale, weights, intercept = fit(sample.drop(columns="__label").to_numpy(np.float64), y)
    base = marked.agg(F.avg("__label")).first()[0]
    base = 0.5 if base is None else min(max(float(base), 1e-4), 1 - 1e-4)

    # the fit treats the labels as equally frequent, so its log odds are evidence beside the base rate
    inside = lambda c: F.least(F.greatest(c, F.lit(-6.0)), F.lit(6.0))
    evidence = sum((inside((F.col(f"__{n}") - float(m)) / float(s)) * float(w) for n, m, s, w in zip(FEATURES, mean, scale, weights, strict=True)), F.lit(intercept))
    own = 1 / (1 + F.exp(-(evidence + float(np.log(base / (1 - base))))))
    rows = rows.select("doc_id", "__host", "__path", evidence.alias("evidence"), own.alias("__own"))
    sections = t.keep(rows.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("__own").alias("good")))
    hosts = sections.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = sections.agg(F.sum("good") / F.sum("n")).first()[0]
    total = base if total is None else float(total)
    of_hosts = strength(hosts, F.lit(total))
    hosts = hosts.withColumn("__host_rate", (F.col("good") + of_hosts * total) / (F.col("n") + of_hosts)).select(F.col("__host").alias("__h"), "__host_rate")
    joined = sections.join(hosts, F.col("__host").eqNullSafe(F.col("__h"))).drop("__h")
    of_paths = strength(joined, F.col("__host_rate"))
    rates = joined.withColumn("__path_rate", (F.col("good") + of_paths * F.col("__host_rate")) / (F.col("n") + of_paths))
    rates = t.keep(rates.select(F.col("__host").alias("__h"), F.col("__path").alias("__p"), "__host_rate", "__path_rate"))
    out = rows.join(rates, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")))
    odds = F.col("evidence") + float(np.log(base / (1 - base))) + SITE_WEIGHT * (logit(F.col("__path_rate")) - logit(F.lit(total)))
    score = 1 / (1 + F.exp(-odds))
    return out.select("doc_id", held_out().alias("held_out"), "evidence", F.col("__host_rate").alias("host_rate"), F.col("__path_rate").alias("path_rate"), score.alias("score"), (score >= 0.5).alias("keep"))
