"""Quality reports: field accuracy, writer rules, off-vocabulary labels and character error."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURKISH = "ıiİIşsğgöoüuçc"
WEIGHTS = {"complete": 0.15, "target_unit": 0.20, "response_type": 0.15, "process_status": 0.15, "closing": 0.15, "citation": 0.20}


def rate(flag: Column, name: str) -> Column:
    """Share of all rows, in percent with two decimals; null flags count as false."""
    return F.round(F.avg(F.coalesce(flag.cast("int"), F.lit(0))) * 100, 2).alias(name)


def writer_report(rows: DataFrame) -> DataFrame:
    """One row of rates from flag columns named like the weights and json_valid, min_words; overall from the rounded rates."""
    flags = ["json_valid", "complete", "target_unit", "response_type", "process_status", "closing", "citation", "min_words"]
    report = rows.agg(F.count("*").alias("n_rows"), *(rate(F.col(f), f) for f in flags))
    return report.withColumn("overall", F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 2))


def off_vocabulary(rows: DataFrame, value: str, allowed: DataFrame, label: str) -> DataFrame:
    return rows.join(allowed.select(F.col(label).alias(value)).distinct(), value, "left_anti")


#: letters are counted in so many classes; merged classes only raise the bound
CLASSES = 64


def _letters(values: list[str]) -> np.ndarray:
    """How often each class of letters occurs in each text."""
    out = np.zeros((len(values), CLASSES), np.int32)
    for row, v in zip(out, values, strict=True):
        np.add.at(row, np.frombuffer(v.encode("utf-32-le", "surrogatepass"), "<u4") % CLASSES, 1)
    return out


def closest(value: str, counts: np.ndarray, labels: list[str], letters: np.ndarray, sizes: np.ndarray) -> tuple[float, str]:
    """The largest sequence-matcher ratio of ``value`` with a label, and the first such label in order.

    No ratio exceeds twice the letters in common by the letters of both, so
    labels are taken by that bound until it falls below a ratio found.
    """
    both = sizes + len(value)
    bound = np.where(both > 0, 2.0 * np.minimum(letters, counts).sum(axis=1) / np.maximum(both, 1), 1.0)
    matcher = difflib.SequenceMatcher(None, "", value)
    best = (-1.0, "")
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < best[0]:
            break
        matcher.set_seq1(labels[k])
        ratio = matcher.ratio()
        if ratio > best[0] or ratio == best[0] and labels[k] < best[1]:
            best = (ratio, labels[k])
    return best


def snap_to_label(bad: DataFrame, value: str, allowed: DataFrame, label: str) -> DataFrame:
    """(value, snapped): the label with the largest sequence-matcher ratio, ties to the first in order; any number of labels.

    Blocks of different values meet blocks of different labels; each cell
    compares a value only with labels whose letters allow a better ratio.
    """
    import pyarrow as pa

    from varaka.operators.grid import meet

    def cell(values: pa.Table, blocks: list[pa.Table]) -> pa.Table:
        asked = values.column(0).to_pylist()
        counts, best = _letters(asked), [(-1.0, "")] * len(asked)
        for block in blocks:
            labels = sorted(block.column(0).to_pylist())
            letters, sizes = _letters(labels), np.array([len(x) for x in labels])
            for k, v in enumerate(asked):
                ratio, found = closest(v, counts[k], labels, letters, sizes)
                if ratio > best[k][0] or ratio == best[k][0] and found < best[k][1]:
                    best[k] = (ratio, found)
        return pa.table({value: asked, "ratio": [r for r, _ in best], "snapped": [x for _, x in best]})

    values = bad.select(F.col(value).cast("string").alias(value)).where(F.col(value).isNotNull()).distinct()
    labels = allowed.select(F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull()).distinct()
    found = meet(values, labels, cell, f"{value} string, ratio double, snapped string", rows=(512, 4096))
    best = found.groupBy(value).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "snapped"))["snapped"].alias("snapped"))
    return values.join(best, value, "left").select(value, "snapped")


def char_error(reference: Column, found: Column) -> Column:
    """Edit distance by reference length; an empty reference errs 0 or 1."""
    return F.when(F.length(reference) == 0, (F.length(found) > 0).cast("double")).otherwise(F.levenshtein(reference, found) / F.length(reference))


def aligned_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which letters of ``a`` a cheapest alignment with ``b`` leaves equal.

    Walked from the end, equal or changed letters before omissions before
    additions.  Of the cost matrix only every so many rows are kept (about the root of
    their number); the rows between are computed again when the walk reaches
    them, so two texts of n letters need n * sqrt(n) numbers.
    """
    steps = np.arange(len(b) + 1, dtype=np.int32)
    every = max(1, int(len(a) ** 0.5))

    def below(row: np.ndarray, i: int) -> np.ndarray:  # a row at once: additions are a running minimum
        out = np.empty_like(row)
        out[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (b != a[i - 1]), out=out[1:])
        return np.minimum.accumulate(out - steps) + steps

    kept, row = [steps.copy()], steps.copy()
    for i in range(1, len(a) + 1):
        row = below(row, i)
        if i % every == 0:
            kept.append(row)
    i, j, equal, low, rows = len(a), len(b), np.zeros(len(a), bool), len(a) + 1, []
    while i > 0:
        if i <= low:  # the rows from the last kept one above i
            low = (i - 1) // every * every
            rows = [kept[low // every]]
            for k in range(low + 1, i + 1):
                rows.append(below(rows[-1], k))
        here, above = rows[i - low], rows[i - low - 1]
        if j > 0 and here[j] == above[j - 1] + (a[i - 1] != b[j - 1]):
            equal[i - 1] = a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif here[j] == above[j] + 1:
            i -= 1
        else:
            j -= 1
    return equal


def turkish_char_errors(reference: Column, found: Column) -> Column:
    """struct<total, errors>: letters of the confusable set in the reference, and those not aligned as equal."""

    @F.pandas_udf("total int, errors int")
    def align(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        pairs, counted = list(zip(refs.fillna(""), hyps.fillna(""), strict=True)), {}
        for r, h in set(pairs):  # rows that repeat a pair are aligned once
            a, b = np.array([*r], dtype="U1"), np.array([*h], dtype="U1")
            wanted = np.isin(a, [*TURKISH])
            right = aligned_equal(a, b) if wanted.any() else wanted
            counted[r, h] = int(wanted.sum()), int((wanted & ~right).sum())
        out = [counted[p] for p in pairs]
        return pd.DataFrame(out, columns=["total", "errors"])

    return align(reference, found)


def pred_gold(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Every gold row with its prediction; a missing one is null and stays in the denominator."""
    return gold.join(predicted, key, "left")


def analysis_report(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """One row: all rows, the share that parsed and the share that equals the gold value."""
    return rows.agg(F.count("*").alias("n_rows"), rate(F.col(pred).isNotNull(), "valid"), rate(F.col(pred) == F.col(gold), "exact"))


def analysis_fields(rows: DataFrame, fields: tuple[str, ...] = ("document_type", "sender_type", "primary_topic")) -> DataFrame:
    """One row over (pred, gold), structs of labels of which ``pred`` may be null: valid, a rate for each of ``fields`` and ``missing_information``.

    Lists of missing information agree when both are empty or neither is; an
    unparsable row agrees in nothing and stays in the denominator.
    """
    none = lambda side: F.coalesce(F.size(F.col(side)["missing_information"]) <= 0, F.lit(True))
    parsed = F.col("pred").isNotNull()
    same = [rate(parsed & F.col("pred")[k].eqNullSafe(F.col("gold")[k]), k) for k in fields]
    return rows.agg(F.count("*").alias("n_rows"), rate(parsed, "valid"), *same, rate(parsed & (none("pred") == none("gold")), "missing_information"))


def corrected_accuracy(rows: DataFrame, snapped: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """One row: accuracy of ``rows`` before and after ``snapped`` (value, snapped) replaces predictions."""
    found = rows.join(snapped.select(F.col("value").alias(pred), "snapped"), pred, "left")
    after = F.coalesce("snapped", pred) == F.col(gold)
    return found.agg(F.count("*").alias("n_rows"), rate(F.col(pred) == F.col(gold), "before"), rate(after, "after"), F.sum(F.col("snapped").isNotNull().cast("int")).alias("n_snapped"))


def response_distribution(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, percent); null counts as ``MISSING``."""
    counted = rows.groupBy(F.coalesce(value, F.lit("MISSING")).alias(value)).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def group_counts(rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def off_vocabulary_counts(rows: DataFrame, field: str, allowed: list[str]) -> DataFrame:
    """(field, value, n) of values outside the vocabulary; null is no value."""
    return group_counts(rows.where(~F.col(field).isin(allowed)), F.lit(field).alias("field"), F.col(field).alias("value"))


def label_vocabulary(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """Different labels over several tables."""
    if not columns:
        raise ValueError("no table with labels")
    found = columns[0][0].select(F.col(columns[0][1]).alias("label"))
    for rows, name in columns[1:]:
        found = found.union(rows.select(name))
    return found.distinct()


def ocr_summary(rows: DataFrame, group: str, error: Column, errors: Column, total: Column) -> DataFrame:
    """(grp, n, mean_error, pooled) of each group and of ``ALL``; pooled is null without any such character."""
    found = rows.rollup(group).agg(F.count("*").alias("n"), F.avg(error).alias("mean_error"), (F.sum(errors) / F.nullif(F.sum(total), F.lit(0))).alias("pooled"), F.grouping(group).alias("__all"))
    return found.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col(group)).alias("grp"), "n", "mean_error", "pooled")


def ocr_eval(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """``pairs`` with error, tr_total, tr_errors and lengths; a missing hypothesis counts as empty."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    rows = pairs.withColumn("__tr", turkish_char_errors(r, h))
    return rows.select("*", char_error(r, h).alias("error"), F.col("__tr.total").alias("tr_total"), F.col("__tr.errors").alias("tr_errors"), F.length(r).alias("n_ref"), F.length(h).alias("n_hyp")).drop("__tr")


def split_group_matrix(rows: DataFrame, split: str, group: str) -> DataFrame:
    """(split, grp, n) with totals named ``ALL``."""
    name = lambda c, to: F.when(F.grouping(c) == 1, "ALL").otherwise(F.col(c)).alias(to)
    counted = rows.cube(split, group).agg(F.count("*").alias("n"), name(split, "split"), name(group, "grp"))
    return counted.select("split", "grp", "n")


def topic_shortfall(rows: DataFrame, targets: DataFrame, topic: str, target: int) -> DataFrame:
    """(``targets``, n, missing): rows of each topic and how many are missing to the target; topics without rows too."""
    n = F.coalesce("n", F.lit(0))
    return targets.join(group_counts(rows, topic), topic, "left").withColumn("missing", F.greatest(target - n, F.lit(0))).withColumn("n", n)


def agent_board(trace: DataFrame, document: str, stage: str, ready: Column) -> DataFrame:
    """(document, stages, n_rows, ready) of trace rows."""
    return trace.groupBy(document).agg(F.array_sort(F.collect_set(stage)).alias("stages"), F.count("*").alias("n_rows"), F.bool_or(ready).alias("ready"))


def compare_runs(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(metric, base, tuned, difference) of two (metric, value) tables; null where one side is missing."""
    a, b = base.select("metric", F.col("value").alias("base")), tuned.select("metric", F.col("value").alias("tuned"))
    return a.join(b, "metric", "full").withColumn("difference", F.round(F.col("tuned") - F.col("base"), 6))


def first_errors(rows: DataFrame, key: str, text: str, pred: str = "pred", gold: str = "gold", most: int = 5, width: int = 500) -> DataFrame:
    """The first rows whose prediction is wrong or missing, with a preview of their text."""
    wrong = rows.where(F.col(pred).isNull() | (F.col(pred) != F.col(gold)))
    return wrong.orderBy(key).limit(most).select(key, F.substring(text, 1, width).alias("preview"))
