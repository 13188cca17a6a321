"""Bottom-k fingerprints of word shingles.

A fingerprint holds the ``K`` smallest distinct 48-bit hashes of a text's shingles of
``WIDTH`` words (all of them if there are fewer).  Fingerprints of parts merge into that
of the whole, and two of them estimate resemblance, containment and distinct shingles.
As text a fingerprint is the base64 of its hashes, ascending, six bytes each.

Edge cases: a text with fewer words than a shingle has its whole word sequence as its
one shingle; a text without words, or null, has the empty fingerprint ``""``; two empty
fingerprints are alike (1.0), an empty and another are not (0.0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_bytes, shingles, blocks, word_hashes
from .ordering import n_parts, part_of, range_bounds

K = 128
WIDTH = 5
#: Keys that a merging task holds.
HOLD = 1 << 15
_TOP = float(1 << 48)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Bottom-k sketch of 64-bit hashes in ascending order."""
    return np.unique(hashes >> np.uint64(16))[:k]


def sketches(texts: list[bytes], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    raw, offs = list_bytes(texts)
    out: list[np.ndarray] = []
    for lo, hi, buf, at in blocks(raw, offs):
        h, doc = word_hashes(buf, at)
        out += [sketch(s, k) for s in shingles(h, doc, hi - lo, width)]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two texts' shingles."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _TOP)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity, from the sketch of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, u[-1], "right")) / len(u)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    inter = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, inter / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(s: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, 2:] = six
    return wide.view(">u8").ravel().astype(np.uint64)


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles (estimate), fingerprint for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sketches([(t or "").encode() for t in b.column("text").to_pylist()], k, width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([distinct(x, k) for x in s]), pa.array([encode(x) for x in s])], ["doc_id", "n_shingles", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles double, fingerprint string")


def merge_fingerprints(parts: DataFrame, by: str, k: int = K) -> DataFrame:
    """``by``, fingerprint: that of the union of all parts (column fingerprint) with the same ``by``.

    Each task merges what it has of a key first, so a key's rows never meet in one task,
    only a merged one for each task or ``HOLD`` keys does.  A null fingerprint is empty.
    """
    kind = parts.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), parts_type), pa.array([encode(x) for x in held.values()], pa.string())], [by, "fingerprint"])

        for b in batches:
            parts_type = b.column(by).type
            for key, f in zip(b.column(by).to_pylist(), b.column("fingerprint").to_pylist()):
                mine = decode(f or "")
                held[key] = merge(held[key], mine, k) if key in held else mine
            if len(held) > HOLD:
                yield out()
                held = {}
        if held:
            yield out()

    @F.pandas_udf("string")
    def union(prints: pd.Series) -> str:
        found = decode("")
        for f in prints:
            found = merge(found, decode(f), k)
        return encode(found)

    merged = parts.select(by, "fingerprint").mapInArrow(run, f"`{by}` {kind}, fingerprint string")
    return merged.groupBy(by).agg(union("fingerprint").alias("fingerprint"))


def neighbours(docs: DataFrame) -> DataFrame:
    """target, sent, doc_id, text: ranges of ascending doc_id, one range a partition.

    The first document of each range is also sent, marked, to the range before it (that
    of the first range to the last one), so that each document finds its follower in its
    own partition.  Text is shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = n_parts(docs)
    bounds = range_bounds(rows, "doc_id", parts)
    placed = rows.withColumn("part", part_of(F.col("doc_id"), bounds))
    ids = rows.select("doc_id").withColumn("part", part_of(F.col("doc_id"), bounds))
    # One row for each range: bounded by the number of partitions.
    firsts = ids.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("least")).orderBy("part").collect()
    known = [(r.part, r.least, firsts[i - 1].part) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(known, "part int, least long, before int")
    here = F.struct(F.col("part").alias("target"), F.lit(False).alias("sent"))
    there = F.struct(F.col("before").alias("target"), F.lit(True).alias("sent"))
    first = F.coalesce("doc_id", F.lit(-(2**63))) == F.col("least")
    dealt = placed.join(F.broadcast(heads), "part").withColumn("to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select("to.target", "to.sent", "doc_id", "text").repartitionById(parts, F.col("target"))
    return dealt.sortWithinPartitions("target", "sent", "doc_id", "text")


def edited_pairs(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each document against its edited text and against the next document."""

    def finish(items: list[tuple], rest: int) -> pa.RecordBatch:
        """items: (id, text), the last ``rest`` only as followers."""
        n = len(items) - rest
        texts = [t for _, t in items]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts[:n], texts[1:])]
        own = sketches([t.encode() for t in texts], k, width)
        new_bytes = [t.encode() for t in edited]
        new = sketches(new_bytes, k, width)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in items[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in new_bytes]),
                pa.array([encode(x) for x in own[:n]]),
                pa.array([encode(x) for x in new]),
                pa.array([resemblance(a, b, k) for a, b in zip(own, new)]),
                pa.array([resemblance(a, b, k) for a, b in zip(own[:n], own[1:])]),
                pa.array([distinct(x, k) for x in own[:n]]),
                pa.array([containment(a, b, k) for a, b in zip(own, new)]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "kept_share"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, target, closed = 0, None, False
        for b in batches:
            for to, sent, doc, text in zip(*(b.column(c).to_pylist() for c in ("target", "sent", "doc_id", "text"))):
                if to != target:
                    held, size, target, closed = [], 0, to, False
                if closed:  # another row with the id that was sent
                    continue
                held.append((doc, text))
                size += len(text)
                if sent:
                    yield finish(held, 1)
                    held, closed = [], True
                elif size > 1 << 20 and len(held) > 1:
                    yield finish(held, 1)
                    held, size = held[-1:], len(text)

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_share double"
    return neighbours(docs).mapInArrow(run, out)
