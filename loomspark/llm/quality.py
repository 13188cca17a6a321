"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed word n-grams (one and two words) and byte trigrams.
Each is scaled by its class log-count ratio; a linear hinge-loss model over the scaled
indicators, brought to unit length, is fitted by dual coordinate descent, drawn towards
its mean weight, and its margin is turned into a probability on a held-out fifth.

The sample takes the labels whose hash of the id is below a threshold that lets through
``SAMPLE_ROWS`` on average (all if there are fewer); if their texts have more than
``SAMPLE_BYTES`` the threshold is lowered in proportion.

Edge cases: null and empty texts have no features and get the score of a zero margin;
with one class or none in the sample the score is that class's share (0.5 without
rows or labels); of an id with several labels the greatest counts; a label counts once for
each text of its id; texts of any length are whole; repeated rows are each scored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _M, blocks, bounded_sample, column_bytes, learnable, list_bytes, materialise, mix, sent, stable_fraction, word_hashes

BITS = 18
#: Bounds on what is learned from: labelled rows, on average, and bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 26


def indicators(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a block, by document."""
    n = len(offs) - 1
    h, doc = word_hashes(buf, offs)
    found = [(doc.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))]
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        # A word after itself is one feature whatever the word is.
        pair = np.where(h[1:] == h[:-1], np.uint64(0), mix(h[:-1] * np.uint64(_M) + h[1:]))
        found.append(((doc[1:].astype(np.uint64) << np.uint64(BITS)) | (pair >> np.uint64(64 - BITS)))[same])
        # How often that happens, by powers of two.
        again = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n)
        for level in range(1, 12):
            many = np.flatnonzero(again >= 1 << level).astype(np.uint64)
            found.append((many << np.uint64(BITS)) | (mix(np.full(len(many), level, np.uint64)) >> np.uint64(64 - BITS)))
    if len(buf) > 2:
        tri = (buf[:-2].astype(np.uint64) << np.uint64(16)) | (buf[1:-1].astype(np.uint64) << np.uint64(8)) | buf[2:]
        owner = np.repeat(np.arange(n), np.diff(offs))
        same = owner[2:] == owner[:-2]
        found.append(((owner[2:].astype(np.uint64) << np.uint64(BITS)) | (mix(tri + np.uint64(1)) >> np.uint64(64 - BITS)))[same])
    both = np.unique(np.concatenate(found))
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss, L2: each row is scale[indices] brought to unit length, and a bias.

    Rows are scaled anew each time: kept, they would take twice the memory of the indices.
    """
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    length = [max(np.linalg.norm(scale[r]), 1e-12) for r in rows]
    norm = [float(v @ v) + 1.0 for v in (scale[r] / n for r, n in zip(rows, length))]
    # A class's cost is by its share, so that the rarer one weighs as much.
    cost = np.where(y > 0, c * 0.5 / max((y > 0).mean(), 1e-9), c * 0.5 / max((y < 0).mean(), 1e-9))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r] / length[i]
            slope = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                bias += step
    return w, bias


class Model:
    def __init__(self, scale: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.scale, self.weight, self.bias, self.slope, self.shift = scale, weight, bias, slope, shift

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        doc, f = indicators(buf, offs)
        length = np.sqrt(np.bincount(doc, weights=self.scale[f] ** 2, minlength=n))
        margin = np.bincount(doc, weights=self.scale[f] * self.weight[f], minlength=n) / np.maximum(length, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def train(rows: list[tuple[str, int]], c: float = 1.0, epochs: int = 20, smooth: float = 1.0, pull: float = 0.25, seed: int = 5) -> Model:
    """Fit on (text, label) pairs, label 1 for good."""
    rows = sorted(((t or "", int(q)) for t, q in rows if q is not None))
    zero = np.zeros(1 << BITS)
    if len({q for _, q in rows}) < 2:
        share = min(max(float(np.mean([q for _, q in rows])) if rows else 0.5, 1e-6), 1 - 1e-6)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    raw, offs = list_bytes([t.encode() for t, _ in rows])
    sets: list[np.ndarray] = []
    for lo, hi, buf, at in blocks(raw, offs, 1 << 16):
        doc, f = indicators(buf, at)
        sets += np.split(f.astype(np.int32), np.searchsorted(doc, np.arange(1, hi - lo)))
    y = np.array([1 if q == 1 else -1 for _, q in rows])
    fit = np.random.default_rng(seed).random(len(rows)) >= 0.2
    if len({*y[fit]}) < 2 or len({*y[~fit]}) < 2:
        fit = np.ones(len(rows), bool)
    test = ~fit if not fit.all() else fit
    seen = {s: smooth + sum_indicators([r for r, a, b in zip(sets, y, fit) if a == s and b]) for s in (1, -1)}
    scale = np.log(seen[1] / seen[1].sum()) - np.log(seen[-1] / seen[-1].sum())
    part = [r for r, b in zip(sets, fit) if b]
    w, bias = dual_descent(part, scale, y[fit], c, epochs, seed)
    used = sum_indicators(part) > 0
    w[used] = (1 - pull) * np.abs(w[used]).mean() + pull * w[used]
    margin = np.array([(scale[r] @ w[r]) / max(np.linalg.norm(scale[r]), 1e-12) + bias for r, b in zip(sets, test) if b])
    slope, shift = fit_sigmoid(margin, y[test] > 0)
    return Model(scale, w, bias, slope, shift)


def sum_indicators(rows: list[np.ndarray]) -> np.ndarray:
    """How many rows have each feature; a row has it once."""
    total = np.zeros(1 << BITS)
    for r in rows:
        total[r] += 1
    return total


def fit_sigmoid(margin: np.ndarray, good: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Newton steps for P(good) = 1 / (1 + exp(-(a m + b))), with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def learning_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """About ``rows`` labels, chosen by hash, with their documents' texts."""
    marks = labels.filter(learnable() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("id_"), F.col(label).cast("int").alias("q_"))
    share = rows / max(marks.count(), 1)
    marks = marks.withColumn("u", stable_fraction(F.lit(4), F.col("id_")) / min(share, 1.0)).filter("u < 1").groupBy("id_").agg(F.max("q_").alias("q_"), F.first("u").alias("u"))
    chosen = docs.select("doc_id", "text").join(sent(materialise(marks)), F.col("doc_id") == F.col("id_"))
    return bounded_sample(chosen.select("doc_id", "text", "q_", "u"), size)


def score_documents(docs: DataFrame, model: Model, accept: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` (1 from ``accept`` up), which
    take the place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = column_bytes(b.column("text"))
            s = np.concatenate([shared.value.scores(buf, at) for _, _, buf, at in blocks(raw, offs)]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s), pa.array((s >= accept).astype(np.int32))], [*keep, "score", "predicted"])

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, accept: float) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = column_bytes(b.column("text"))
            if b.num_rows:
                yield b.filter(pa.array(np.concatenate([shared.value.scores(buf, at) for _, _, buf, at in blocks(raw, offs)]) >= accept))

    return docs.mapInArrow(run, docs.schema)
