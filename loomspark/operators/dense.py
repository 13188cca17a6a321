"""Exact vector top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Questions that are scored by one matrix product.
QUESTION_BLOCK = 1024
#: Bytes of question vectors that are sent to the executors for one scan of the index.
SEND_BYTES = 1 << 26


def rank_by(score: str = "score", index: str = "index") -> list[Column]:
    """Order of results: score to nine places, then the later row."""
    return [F.round(F.col(score), 9).desc(), F.col(index).desc()]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*rank_by())
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def matches(fy: Column, kind: Column, want_fy: Column, want_kind: Column) -> Column:
    """Equality filters; a null or empty one filters nothing."""
    free = lambda want: want.isNull() | (want == "")
    return (free(want_fy) | (fy == want_fy)) & (free(want_kind) | (kind == want_kind))


def dense_top_k(index: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, rank, score, index, chunk_id of the k most similar rows for each question.

    ``questions``: query_id, qvec and optionally want_fy, want_type.  Each task scores its
    rows against blocks of questions by matrix products and keeps its own k best; only
    those are shuffled.  Rows and questions without a vector take no part.  The questions
    are sent to the executors, at most ``SEND_BYTES`` of vectors for each scan of the index.
    """
    for c in ("want_fy", "want_type"):
        if c not in questions.columns:
            questions = questions.withColumn(c, F.lit(None).cast("string"))
    asked = questions.filter("qvec is not null").select("query_id", "qvec", "want_fy", "want_type")
    size = asked.agg(F.sum(F.size("qvec").cast("long") * 8 + 100).alias("s")).first().s or 0
    scans = max(1, -(-size // SEND_BYTES))
    rows = index.filter("embedding is not null").select(F.col("index").cast("long").alias("index"), "chunk_id", "chunk_type", "fiscal_year", "embedding")
    out: DataFrame | None = None
    for b in range(scans):
        part = asked if scans == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == b)
        found = rows.mapInArrow(_scorer(part.collect(), k), "query_id long, score double, index long, chunk_id string")
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


class _Best:
    """The k best rows so far of each question of a block, as flat arrays."""

    def __init__(self, asked: list, k: int):
        self.k = k
        self.ids = np.array([r.query_id for r in asked], np.int64)
        self.vectors = np.array([r.qvec for r in asked], np.float64)
        wants = [(r.want_fy or "", r.want_type or "") for r in asked]
        self.filters = {w: np.flatnonzero([w == x for x in wants]) for w in set(wants)}
        self.row, self.score, self.index, self.name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, vectors: np.ndarray, index: np.ndarray, names: np.ndarray, fy: np.ndarray, kind: np.ndarray) -> None:
        found = [(self.row, self.score, self.index, self.name)]
        for (wfy, wkind), who in self.filters.items():
            ok = np.flatnonzero(((fy == wfy) if wfy else np.ones(len(fy), bool)) & ((kind == wkind) if wkind else True))
            if not len(ok):
                continue
            s = np.round(self.vectors[who] @ vectors[ok].T, 9)
            if len(ok) > self.k:
                least = np.partition(s, len(ok) - self.k, axis=1)[:, len(ok) - self.k]
                r, c = np.nonzero(s >= least[:, None])
            else:
                r, c = (x.ravel() for x in np.indices(s.shape))
            found.append((who[r], s[r, c], index[ok[c]], names[ok[c]]))
        row, score, at, name = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-at, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        kept = order[place < self.k]
        self.row, self.score, self.index, self.name = row[place < self.k], score[kept], at[kept], name[kept]


def _scorer(asked: list, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(asked[i : i + QUESTION_BLOCK], k) for i in range(0, len(asked), QUESTION_BLOCK)]
        for b in batches:
            if not b.num_rows or not best:
                continue
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            names, fy, kind = (np.array(b.column(c).to_pylist(), object) for c in ("chunk_id", "fiscal_year", "chunk_type"))
            for x in best:
                x.add(v, b.column("index").to_numpy(), names, fy, kind)
        for x in best:
            if len(x.row):
                cols = [pa.array(x.ids[x.row]), pa.array(x.score), pa.array(x.index), pa.array(x.name, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "score", "index", "chunk_id"])

    return run
