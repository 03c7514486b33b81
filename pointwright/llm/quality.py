"""Operator 7: quality by positive-unlabelled learning.

A logistic curve g on measures of the text's form minimises the non-negative unbiased risk
  pi R_p(g, +) + max(0, R_u(g, -) - pi R_p(g, -))
of trusted positives (rows labelled 1 outside the held-out fold) and unlabelled texts (all rows
of the table, whatever their label). Labels of 0 teach nothing.

The class prior pi is estimated from positives and unlabelled texts alone: a first curve tells the
two apart; above a threshold of its scores the share of unlabelled texts over the share of
positives is at least pi, and comes near it where the texts above are positive ones only. The
threshold with the least upper confidence bound of that ratio gives pi.

With the logistic loss the risk is convex while the second part stays positive, so Newton steps
find its minimum; a step that makes that part negative is halved until it does not, and there the
fit ends. Every step's sums (gradient and curvature, some hundred numbers) are of all rows: a pass
over the written measures, summed by task and then by group of tasks, in a fixed order. The driver
holds those sums alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import fold
from .words import Words, grams, inside, steps
from .work import written

#: Steps of a fit, halvings of its last one, the weights' penalty, and the greatest distance of a measure from its mean (in deviations).
STEPS, HALVINGS, RIDGE, CLIP = 25, 8, 1e-2, 6.0
#: Bins of scores, and the confidence, by which the prior is estimated.
BINS, DOUBT = 1000, 0.1
#: Groups of tasks whose sums come to the driver.
GROUPS = 64
#: Classes of bytes: lower, upper, digit, mark of a sentence, other ASCII mark, line end, other white space, beyond ASCII.
CLASSES = 8


def _classes() -> np.ndarray:
    c = np.full(256, 7, dtype=np.uint8)
    for i in range(128):
        ch = chr(i)
        c[i] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch in ".,;:'\"-" else 5 if ch == "\n" else 6 if ch.isspace() else 4
    return c


BYTE_CLASS = _classes()


def _per(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(float)


def _repeats(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of items that are not the first of their kind in the row, and the share of the most frequent kind."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(x)))
    total = np.maximum(_per(row, n), 1)
    most = np.zeros(n)
    np.maximum.at(most, r[at], size.astype(float))
    return 1 - _per(r[at], n) / total, most / total


def measures(column: pa.Array) -> np.ndarray:
    """A row of measures for each text; zeros for a text without words."""
    w = Words(column)
    n = len(w.counts)
    kinds = BYTE_CLASS[w.data]
    size = np.diff(w.offsets)
    doc = np.repeat(np.arange(n), size)
    by = np.bincount(doc * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    share = by / np.maximum(size, 1)[:, None]
    words = np.maximum(w.counts, 1).astype(float)
    length = (w.end - w.start).astype(float)
    mean = _per(w.doc, n, length) / words
    spread = np.sqrt(np.maximum(_per(w.doc, n, length**2) / words - mean**2, 0))
    h = w.hashes()
    first, last = kinds[w.start] if len(w) else kinds[:0], kinds[w.end - 1] if len(w) else kinds[:0]
    one, one_most = _repeats(w.doc, h, n)
    if len(w) > 2:
        at = np.flatnonzero(inside(w, 3))
        three, three_most = _repeats(w.doc[at], grams(h, 3)[at], n)
    else:
        three, three_most = np.zeros(n), np.zeros(n)
    after = np.zeros(len(w), dtype=bool)
    if len(w) > 1:
        after[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    out = [
        *share.T, mean, spread, _per(w.doc, n, length <= 3) / words, _per(w.doc, n, length >= 12) / words, _per(w.doc, n, length == 1) / words,
        _per(w.doc, n, last == 3) / words, _per(w.doc, n, last == 4) / words, _per(w.doc, n, first == 4) / words, _per(w.doc, n, first == 1) / words, _per(w.doc, n, (first == 1) & (last == 1)) / words,
        _per(w.doc, n, first == 2) / words, one, one_most, three, three_most, _per(w.doc, n, after) / words, by[:, 5] / words, by[:, 3] / words, by[:, 4] / words, np.log1p(w.counts), np.log1p(w.counts) ** 2 / 10,
    ]
    m = np.stack(out, axis=1)
    m[w.counts == 0] = 0
    return m


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Curve:
    """Weights of standardised, clipped measures and an offset."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        self.mean, self.scale, self.w = mean, scale, np.zeros(len(mean) + 1)

    def input(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((np.clip((x - self.mean) / self.scale, -CLIP, CLIP), np.ones(len(x))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.input(x) @ self.w)


def moments(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Rows, trusted rows, and sums and square sums of the measures of all."""
    return np.concatenate(([len(x), trusted.sum()], x.sum(axis=0), (x * x).sum(axis=0)))


def apart(curve: Curve) -> Callable:
    """Sums that tell positives from all rows: gradient and curvature of either's logistic loss."""

    def f(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        m = curve.input(x)
        g = sigmoid(m @ curve.w)
        p, gp = m[trusted], g[trusted]
        return np.concatenate((m.T @ g, p.T @ (gp - 1), ((m.T * (g * (1 - g))) @ m).ravel(), ((p.T * (gp * (1 - gp))) @ p).ravel()))

    return f


def bins(curve: Curve) -> Callable:
    """Rows and trusted rows by bin of the score."""

    def f(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        at = np.minimum((curve.score(x) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at[trusted], minlength=BINS))).astype(float)

    return f


def risks(curve: Curve) -> Callable:
    """Sums of the risk's parts: loss of all as negatives, of positives as negatives and as positives; gradients of the first two and the first's curvature; the positives' inputs."""

    def f(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        m = curve.input(x)
        z = m @ curve.w
        g, p, zp = sigmoid(z), m[trusted], z[trusted]
        loss = [np.logaddexp(0, z).sum(), np.logaddexp(0, zp).sum(), np.logaddexp(0, -zp).sum()]
        return np.concatenate((loss, m.T @ g, p.T @ sigmoid(zp), p.sum(axis=0), ((m.T * (g * (1 - g))) @ m).ravel()))

    return f


def prior_of(every: np.ndarray, trusted: np.ndarray) -> float:
    """The class prior by the rows' and the trusted rows' counts by ascending bin of score."""
    n, k = every.sum(), trusted.sum()
    u, p = every[::-1].cumsum() / n, trusted[::-1].cumsum() / k
    some = p > 0
    slack = np.sqrt(np.log(4 / DOUBT) / (2 * n)) + np.sqrt(np.log(4 / DOUBT) / (2 * k))
    best = int(np.argmin((u[some] + slack) / p[some]))
    return float(np.clip((u[some] / p[some])[best], 0.01, 0.99))


def sums(table: DataFrame, f: Callable) -> np.ndarray:
    """The sum of f(measures, trusted) over all rows of (measures, trusted); by task, then by group of tasks, each in a fixed order."""
    schema = "grp int, task int, sums array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = f(batch.column("measures").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("trusted").to_numpy(zero_copy_only=False))
                total = got if total is None else total + got
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task % GROUPS], pa.int32()), pa.array([task], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["grp", "task", "sums"])

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group["task"].to_numpy())
        lists = group["sums"].combine_chunks()
        total = lists.flatten().to_numpy().reshape(len(order), -1)[order].sum(axis=0)
        return pa.Table.from_arrays([group["grp"][:1], group["task"][:1], pa.array([total], pa.list_(pa.float64()))], names=["grp", "task", "sums"])

    found = table.select("measures", "trusted").mapInArrow(run, schema).groupBy("grp").applyInArrow(add, schema).collect()
    return np.sum([r.sums for r in sorted(found, key=lambda r: r.grp)], axis=0) if found else np.zeros(0)


def fit(total: Callable[[Callable], np.ndarray]) -> tuple[Curve | None, float]:
    """The curve of least risk and the prior, by a function that gives the sums of another over all rows; (None, 0.5) without positives."""
    first = total(moments)
    if not len(first) or not first[1]:
        return None, 0.5
    n, k, d = first[0], first[1], (len(first) - 2) // 2
    mean = first[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(first[2 + d :] / n - mean**2, 0)) + 1e-6
    penalty = np.append(np.full(d, RIDGE), 0.0)
    steady = np.diag(penalty + 1e-9)

    def newton(curve: Curve, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        step = np.linalg.solve(curvature + steady, gradient + penalty * curve.w)
        return step * min(1.0, 6 / max(1e-12, np.abs(step).max()))

    curve, size = Curve(mean, scale), d + 1
    for _ in range(STEPS):
        got = total(apart(curve))
        gradient, curvature = got[:size] / n + got[size : 2 * size] / k, (got[2 * size :][: size * size] / n + got[2 * size + size * size :] / k).reshape(size, size)
        step = newton(curve, gradient, curvature)
        curve.w = curve.w - step
        if np.abs(step).max() < 1e-3:
            break
    counts = total(bins(curve))
    prior = prior_of(counts[:BINS], counts[BINS:])

    curve, step, halved = Curve(mean, scale), np.zeros(size), 0
    for _ in range(STEPS):
        got = total(risks(curve))
        if got[0] / n - prior * got[1] / k < 0:  # the negatives' risk, below zero
            if halved == HALVINGS:
                curve.w = curve.w + step
                break
            halved, step = halved + 1, step / 2
            curve.w = curve.w + step
            continue
        if halved:
            break
        as_all, as_positive, inputs = (got[3 + i * size : 3 + (i + 1) * size] for i in range(3))
        # the positives' losses differ by g, so theirs is pi (sigmoid - 1) - pi sigmoid
        step = newton(curve, as_all / n + prior * (as_positive - inputs) / k - prior * as_positive / k, (got[3 + 3 * size :] / n).reshape(size, size))
        curve.w = curve.w - step
        if np.abs(step).max() < 1e-3:
            break
    return curve, prior


def measured(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its measures; null text counts as empty."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in steps(batch, "text"):
                m = measures(table.column("text").combine_chunks())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), lists], names=["doc_id", "measures"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, measures array<double>")


def classify(df: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row of df.

    Labels are used of rows whose fold of the id is not `held_out`; null labels and ids teach
    nothing. Every row of df is an unlabelled text, every row with a learnt label of 1 a positive.
    Without positives every score is 0.5. Null and empty text have zero measures and their score.
    Repeated rows each get their row; other columns are ignored.
    """
    known = labels.where((F.col("quality") == 1) & (fold(F.col(id_col), folds) != held_out)).select(F.col(id_col).alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    table = written(measured(df, id_col, text).hint("merge").join(known, "doc_id", "left").select("doc_id", "measures", F.coalesce("trusted", F.lit(False)).alias("trusted")), "measures")
    curve, prior = fit(lambda f: sums(table, f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("measures").flatten().to_numpy().reshape(batch.num_rows, -1)
            score = np.full(len(x), prior) if curve is None else curve.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = table.select("doc_id", "measures").mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
