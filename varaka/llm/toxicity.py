"""Toxicity scores from a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of three rows of a hashed table: of the whole
word and of its first four and five bytes, so an inflected stem is met again.
Filters of width 1, 2 and 3 slide over the words; each keeps its largest
response in the text (and a text that is shorter than a filter sees zeros);
a logistic layer weighs these.  Each filter offset's product with the table is
taken once per model, so scoring adds rows and never touches the embeddings.

Learning: a bounded sample of labelled rows (``MAX_SAMPLE`` of either label,
smallest hash first) is fitted on the driver with Adam.  ``thresholds`` then
picks, for each language, the cut that classifies labelled rows best that the
fit has not seen (``calibration`` rows, which ``fit`` leaves out on demand); it
serves the filtering stage and is never an input of a score.

Defined cases: a null or empty text scores like a text without words; labels
that are null or neither 0 nor 1 are not learned from; with labels of one kind
only all scores are 1 (toxic) or 0 (clean), and 0 without any; rows that
repeat a doc_id each give a row, and the largest of several labels counts; a
null doc_id is scored, never learned from, and not held out; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varaka.llm.stage import sampled
from varaka.llm.text import BREAKS, words

TABLE_BITS, DIM, WIDTHS, FILTERS = 15, 12, (1, 2, 3), 8
PREFIXES = (4, 5)
#: bytes of text that a fit reads
SAMPLE_BYTES = 64_000_000
MAX_SAMPLE = 2000
#: a small sample is gone through more often
LEAST_STEPS = 240
EPOCHS, BATCH, RATE, DECAY = 8, 48, 0.01, 1e-4
PAD = 1 << TABLE_BITS


def rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table rows of each word, word offsets of each document) for runs of documents."""
    shift = np.uint64(64 - TABLE_BITS)
    for w in words(column, breaks=BREAKS, prefixes=PREFIXES):
        yield np.stack([h >> shift for h in (w.hashes, *w.prefixes)], 1).astype(np.int32), w.offsets


@dataclass
class Model:
    """``table``: (rows + 1, DIM), the last row is the padding; ``filters[k]``: (width, DIM, FILTERS)."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    constant: float | None = None

    def responses(self) -> list[np.ndarray]:
        return [np.einsum("rd,wdf->wrf", self.table, f).astype(np.float32) for f in self.filters]

    def pooled(self, rows: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each document, and the word where it begins."""
        rows, offsets = padded(rows, offsets)
        n, out, where = len(offsets) - 1, [], []
        last = max(WIDTHS) - 1
        for width, table in zip(WIDTHS, tables, strict=True):
            score = np.zeros((len(rows), table.shape[2]), np.float32)
            for k in range(width):
                part = table[k][rows[:, 0]] + table[k][rows[:, 1]] + table[k][rows[:, 2]]
                score[: len(rows) - k] += part[k:]
            ends = offsets[1:] - last  # the padding alone begins no window
            cut = np.stack([offsets[:-1], ends], 1).ravel()
            best = np.maximum.reduceat(score, cut[:-1], axis=0)[::2] if n else np.zeros((0, table.shape[2]), np.float32)
            out.append(best)
            where.append((score, offsets[:-1], ends))
        return np.hstack(out) if n else np.zeros((0, len(self.weights))), where

    def score(self, column: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        found = [self.pooled(rows, offsets, tables)[0] for rows, offsets in rows_of(column)]
        top = np.vstack(found) if found else np.zeros((0, len(self.weights)))
        return _sigmoid(np.maximum(top + self.bias, 0) @ self.weights + self.intercept)


def padded(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document followed by padding, and one padding word in place of none."""
    last = max(WIDTHS) - 1
    sizes = np.diff(offsets)
    full = np.maximum(sizes, 1) + last
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(full, out=at[1:])
    out = np.full((at[-1], rows.shape[1]), PAD, np.int32)
    out[np.arange(len(rows)) + np.repeat(at[:-1] - offsets[:-1], sizes)] = rows
    return out, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit the network on a bounded sample."""
    rng = np.random.default_rng(seed)
    counts = np.bincount(labels.astype(int), minlength=2)
    size = len(WIDTHS) * FILTERS
    model = Model(
        rng.normal(0, 0.1, (PAD + 1, DIM)).astype(np.float32), [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(size, np.float32), np.full(size, 0.5, np.float32), -2.0,
    )
    model.table[PAD] = 0
    if counts.min() == 0:
        model.constant = float(counts[1] > 0)
        return model
    docs = []
    for rows, offsets in rows_of(pa.array(texts, pa.string())):
        docs += [rows[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    params = {"table": model.table, "bias": model.bias, "weights": model.weights} | {f"f{k}": f for k, f in enumerate(model.filters)}
    first = {k: np.zeros_like(v) for k, v in params.items() if k != "table"}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step, b_first, b_second = 0, 0.0, 0.0
    total = len(docs)
    average: dict[str, np.ndarray] | None = None
    epochs = max(EPOCHS, LEAST_STEPS // -(-total // BATCH))
    for epoch in range(epochs):
        order = rng.permutation(total)
        rate = RATE * (1 - epoch / epochs) + RATE / 10
        for i in range(0, total, BATCH):
            pick = order[i : i + BATCH]
            rows, offsets = np.concatenate([docs[j] for j in pick]), np.zeros(len(pick) + 1, np.int64)
            np.cumsum([len(docs[j]) for j in pick], out=offsets[1:])
            used, back = np.unique(padded(rows, offsets)[0], return_inverse=True)
            rows, at = back.reshape(-1, 3), padded(rows, offsets)[1]
            table = model.table[used]
            grads = {"table": np.zeros_like(table)}
            top, where = [], []
            embedded = table[rows].sum(axis=1)
            for k, width in enumerate(WIDTHS):
                score = sum((np.pad(embedded, ((0, width), (0, 0)))[o : o + len(embedded)] @ model.filters[k][o]) for o in range(width))
                best = np.stack([a + score[a : b - max(WIDTHS) + 1].argmax(axis=0) for a, b in zip(at[:-1], at[1:], strict=True)])
                where.append(best)
                top.append(np.take_along_axis(score, best, axis=0))
            hidden = np.hstack(top) + model.bias
            active = np.maximum(hidden, 0)
            keep = (rng.random(active.shape) > 0.2) / 0.8
            p = _sigmoid((active * keep) @ model.weights + model.intercept)
            d = ((p - labels[pick]) / len(pick)).astype(np.float32)
            grads["weights"] = (active * keep).T @ d + DECAY * model.weights
            dh = d[:, None] * model.weights * keep * (hidden > 0)
            grads["bias"] = dh.sum(axis=0)
            for k, width in enumerate(WIDTHS):
                part = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(model.filters[k])
                for o in range(width):
                    pos = where[k] + o  # padding follows every document
                    for f in range(FILTERS):
                        g[o, :, f] = part[:, f] @ embedded[pos[:, f]]
                        flow = part[:, f, None] * model.filters[k][o, :, f]
                        for c in range(3):
                            np.add.at(grads["table"], rows[pos[:, f], c], flow)
                grads[f"f{k}"] = g + DECAY * model.filters[k]
            if used[-1] == PAD:
                grads["table"][-1] = 0
            step += 1
            for name, g in grads.items():
                if name == "table":  # a word met now and then learns at its own pace
                    second["table"][used] += g * g
                    model.table[used] -= 3 * rate * g / (np.sqrt(second["table"][used]) + 1e-4)
                else:
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    params[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            gi = float(d.sum())
            b_first, b_second = 0.9 * b_first + 0.1 * gi, 0.999 * b_second + 0.001 * gi * gi
            model.intercept -= rate * (b_first / (1 - 0.9**step)) / ((b_second / (1 - 0.999**step)) ** 0.5 + 1e-8)
            if epoch == epochs - 1:
                now = params | {"intercept": np.float64(model.intercept)}
                average = {k: v.copy() for k, v in now.items()} if average is None else {k: average[k] + v for k, v in now.items()}
    steps = -(-total // BATCH)
    for name, v in (average or {}).items():
        if name == "intercept":
            model.intercept = float(v / steps)
        else:
            params[name][...] = v / steps
    return model


def held_out(doc_id="doc_id"):
    """Rows never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def calibration(doc_id="doc_id"):
    """Rows for ``thresholds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 4, F.lit(False))


def marked_docs(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): the largest usable label of each document."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    return marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_SAMPLE, calibrated: bool = False) -> Model:
    """Train on about ``limit`` labelled rows at most of either label that are not held out (nor, if ``calibrated``, for thresholds).

    Of rows that repeat an id one counts, the smallest text; in the order of
    the sample, texts are taken until they pass ``SAMPLE_BYTES``.
    """
    marked = marked_docs(labels).where(~held_out())
    if calibrated:
        marked = marked.where(~calibration())
    picked = sampled(marked, "toxic", limit, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    near = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sizes = near.select("doc_id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))  # at most 2 * limit rows
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    taken = sizes.withColumn("upto", before).where((F.col("upto") <= SAMPLE_BYTES) | (F.col("upto") == F.col("size"))).select("doc_id")
    sample = near.join(F.broadcast(taken), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    return train(sample["text"].fillna("").tolist(), sample["toxic"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep`` (none named score) and a score in 0..1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by TABLE_BITS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.responses()
        for b in batches:
            scores = pa.array(model.score(b.column(b.num_columns - 1), tables), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], scores], names=[*keep, "score"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")


def thresholds(scored: DataFrame, labels: DataFrame, bins: int = 200) -> dict[str | None, float]:
    """For each language the score cut with the best balanced accuracy on labelled calibration rows; 0.5 where there are too few.

    ``scored`` has doc_id, lang and score.  Counts by language and score bin
    are aggregated first, so the driver sees languages times bins.
    """
    marked = marked_docs(labels)
    binned = scored.select("doc_id", "lang", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    counted = binned.where(calibration()).join(marked, "doc_id").groupBy("lang", "bin").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    found: dict[str | None, float] = {}
    table = counted.toPandas()
    for lang, part in table.groupby("lang", dropna=False):
        bad, good = np.zeros(bins), np.zeros(bins)
        bad[part["bin"]] = part["bad"]
        good[part["bin"]] = part["n"] - part["bad"]
        if min(bad.sum(), good.sum()) < 20:
            continue
        hit, kept = bad[::-1].cumsum()[::-1] / bad.sum(), np.append(0, good.cumsum()[:-1]) / good.sum()
        value = hit + kept
        best = np.flatnonzero(value >= value.max() - 1e-9)
        found[lang if isinstance(lang, str) else None] = float(best[np.abs(best - bins / 2).argmin()] / bins)
    return found
