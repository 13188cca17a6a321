"""Language identification from averaged hashed subword embeddings.

A text is the mean of the embeddings of its byte n-grams of ``SIZES`` (case folded,
other than letters taken as word ends), hashed into ``BUCKETS``; a linear softmax on
that mean gives the language.  Both are trained by stochastic gradient descent in numpy
on a bounded sample.  Because text and softmax are linear, embedding and output matrix
are multiplied once and a text then costs one small row for each n-gram.

The sample takes of each language the rows whose hash of id and text is below a threshold
that lets through ``SAMPLE_ROWS`` rows on average (all if it has fewer), so rare languages
are learned too; if it has more than ``SAMPLE_BYTES`` the threshold is lowered in proportion.

Calibration: a temperature fitted on a held-out fifth of the sample makes the score a
probability; ``reject_below`` is the least score from which the held-out part is right
at least ``ACCURACY`` of the time, and lower scores are marked ``rejected``.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled row every text is ``und``; rows without language or id are not learned from; of
equally likely languages the first by name is taken; texts of any length are whole; repeated
rows are learned from once and each predicted; an empty table gives no rows; further columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, column_bytes, learnable, list_bytes, materialise, mix, sent, stable_fraction

SIZES = (2, 3, 4)
BUCKETS, DIM = 1 << 15, 16
#: Bounds on what is learned from: rows of a language, on average, and bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 26
ACCURACY = 0.995

#: ASCII letters folded to lower case, other ASCII bytes to a blank; all else as it is.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of ``size`` bytes that has no blank within."""
    x = _FOLD[buf]
    if len(x) > 1:  # capital letters of the Latin-1 block
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        x[second] += 0x20
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    ok = np.ones(n, bool)
    for j in range(size):
        c = x[j : j + n]
        h = (h << np.uint64(8)) | c.astype(np.uint64)
        if 0 < j < size - 1:
            ok &= c != 32
    ok &= (x[:n] != 32) | (x[size - 1 :] != 32)
    starts = np.arange(n)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    ok &= starts + size <= offs[doc + 1]
    return (mix(h[ok]) >> np.uint64(64 - 15)).astype(np.int64), doc[ok]


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.langs, self.table, self.bias, self.temperature, self.reject_below = langs, table, bias, temperature, reject_below

    def logits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        sums, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for size in SIZES:
            f, doc = features(buf, offs, size)
            count += np.bincount(doc, minlength=n)
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(doc, weights=self.table[k][f], minlength=n)
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(buf, offs) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _examples(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and two short spans of it, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for most in (3, 12):
        if len(words) > most:
            n, at = int(rng.integers(1, most + 1)), int(rng.integers(0, len(words) - most))
            out.append(" ".join(words[at : at + n]))
    return out


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.5, seed: int = 11) -> Model | None:
    """Fit on (text, language) pairs."""
    rows = sorted(r for r in rows if r[0] and r[1] is not None)
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    held = rng.random(len(rows)) < 0.2
    sets: dict[bool, list] = {False: [], True: []}
    for (text, lang), h in zip(rows, held):
        for x in _examples(text, rng):
            raw, offs = list_bytes([x.encode()])
            f = np.concatenate([features(raw, offs, s)[0] for s in SIZES])
            if len(f):
                u, c = np.unique(f, return_counts=True)
                sets[bool(h)].append((u, (c / c.sum()).astype(np.float64), langs.index(lang)))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    steps, done = max(1, epochs * len(sets[False])), 0
    for _ in range(epochs):
        for i in rng.permutation(len(sets[False])):
            u, c, y = sets[False][i]
            x = c @ emb[u]
            g = _softmax(x @ out + bias)
            g[y] -= 1
            lr = rate * (1 - done / steps)
            back = out @ g
            out -= lr * np.outer(x, g)
            bias -= lr * 0.01 * g
            emb[u] -= (lr * np.sqrt(len(u))) * np.outer(c, back)
            done += 1
    table = np.ascontiguousarray((emb @ out).T)
    test = sets[True] or sets[False]
    z = np.array([[(c * table[k][u]).sum() for k in range(len(langs))] + bias for u, c, _ in test])
    y = np.array([t for _, _, t in test])
    hope = np.full(z.shape, 0.01 / len(langs))  # smoothed targets, so that a perfect held-out part has a finite best
    hope[np.arange(len(y)), y] += 0.99
    loss = lambda t: -(hope * np.log(_softmax(z / t) + 1e-12)).sum(axis=1).mean()
    temperature = min((2.0 ** (k / 4) for k in range(-40, 25)), key=loss)
    p = _softmax(z / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= ACCURACY)
    least = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return Model(langs, table, bias, temperature, least)


def learning_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """(text, language) pairs of learnable documents, about ``rows`` of each language, chosen by hash."""
    can = docs.filter(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    share = can.groupBy("lang").agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("share"))
    found = can.join(sent(materialise(share)), "lang").withColumn("u", stable_fraction(F.lit(3), F.col("doc_id"), F.col("text")))
    return bounded_sample(found.filter("u < share").select("doc_id", "text", "lang", (F.col("u") / F.least("share", F.lit(1.0))).alias("u")), size)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for b in batches:
            raw, offs = column_bytes(b.column("text"))
            pred: list[str] = []
            score: list[float] = []
            for lo, hi, buf, at in blocks(raw, offs):
                ascii_letters = np.bincount(np.repeat(np.arange(hi - lo), np.diff(at)), weights=letter[buf], minlength=hi - lo)
                p = m.probabilities(buf, at) if m else None
                for i in range(hi - lo):
                    known = ascii_letters[i] > 0 or any(ch.isalpha() for ch in bytes(buf[at[i] : at[i + 1]]).decode("utf-8", "replace"))
                    k = int(p[i].argmax()) if m else 0
                    pred.append(m.langs[k] if m and known else "und")
                    score.append(float(p[i][k]) if m and known else 0.0)
            low = [s < m.reject_below if m else True for s in score]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
