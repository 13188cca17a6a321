"""Shared helpers: table access, lineage cuts and vectorised text hashing.

Text arrives in Python as Arrow string columns.  Their bytes are read in place as
numpy arrays, in blocks of bounded size, so that no operator makes a Python object
for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import materialise, scratch, ship

__all__ = ["materialise", "scratch"]

#: Bytes of text that one numpy block holds (a longer document is a block of its own).
BLOCK_BYTES = 1 << 19
#: Rows in an Arrow batch.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only."""
    ship(spark)
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if option not in spark.conf.getAll:  # a user's own setting stays
        spark.conf.set(option, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column (Spark does not tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows up to which a table of a few columns is sent to all executors.
SENT_ROWS = 1 << 17


def sent(df: DataFrame) -> DataFrame:
    """A written table, marked to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def learnable(doc_id: str | Column = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 != 2


def bounded_sample(chosen: DataFrame, size: int) -> list[tuple]:
    """(text, label) of ``chosen`` (doc_id, text, label, u), each once: a bounded sample of rows.

    ``u`` is a row's random number in (0, 1).  If the texts have more than ``size`` bytes,
    rows whose number is not below the share that ``size`` is of them are left out.
    """
    label = chosen.columns[2]
    found = materialise(chosen.distinct())
    total = found.agg(F.sum(F.octet_length("text").cast("long")).alias("s")).first().s or 0
    if total > size:
        found = found.filter(F.col("u") < size / total)
    return [(r.text, r[label]) for r in found.collect()]


# --- sets of numbers, of bounded size -----------------------------------------------------

#: Bits of a set that is sent to the executors (2 MB at any input size).
FILTER_BITS = 1 << 24


def bit_set(df: DataFrame, col: str) -> np.ndarray:
    """Set of a column modulo FILTER_BITS, as bits; its size does not depend on the input."""
    x = F.pmod(F.col(col), F.lit(FILTER_BITS))
    rows = df.filter(F.col(col).isNotNull()).select(F.floor(x / 32768).cast("int").alias("k"), (x % 32768).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.collect():
        out[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def in_set(df: DataFrame, col: str, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose number may be (or surely is not) in the set: fewer rows to shuffle for a join."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def has(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype=np.int64) % FILTER_BITS
        return pd.Series((sent.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    # Else Spark infers from a join that the other side, often the longer one, can be filtered so too.
    has = has.asNondeterministic()
    known = F.coalesce(F.col(col), F.lit(0))
    return df.filter(has(known) if inside else ~has(known))


def only(df: DataFrame, names: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``names`` (each once), few of which are shuffled."""
    names = materialise(names)
    if names.count() <= SENT_ROWS:
        return df.join(F.broadcast(names), col, "left_semi")
    return in_set(df, col, bit_set(names, col)).join(names, col, "left_semi")


# --- bytes of Arrow string columns -------------------------------------------------

WORD_BREAK = np.zeros(256, bool)
WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, o


def list_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts) or b"", np.uint8), offs


def blocks(raw: np.ndarray, offs: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut documents into runs of about ``size`` bytes: (first, end, bytes, offsets from 0)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


# --- hashing -------------------------------------------------------------------------

_M = 0x9E3779B97F4A7C15
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, BLOCK_BYTES + 1024)
        both = []
        for base in (_M, pow(_M, -1, 1 << 64)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POW, _INV = both
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of ``buf`` modulo 2**64."""
    n = len(buf)
    power, _ = _powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end); equal bytes have equal hashes anywhere."""
    _, inv = _powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    n = len(buf)
    inside = ~WORD_BREAK[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word."""
    if lower:
        buf = LOWER[buf]
    start, end, doc = word_spans(buf, offs)
    return span_hash(prefix_sums(buf), start, end), doc


def fold(hashes: np.ndarray) -> np.ndarray:
    """Hash of each row of an (n, k) array, in order."""
    acc = np.full(len(hashes), hashes.shape[1], np.uint64)
    for j in range(hashes.shape[1]):
        acc = mix(acc * np.uint64(_M) + hashes[:, j])
    return acc


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each document, ascending.

    A document with fewer than ``width`` words has its whole word sequence as its one
    shingle; a document without words has none.
    """
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    windows = np.zeros(0, np.uint64)
    if len(hashes) >= width:
        windows = fold(np.lib.stride_tricks.sliding_window_view(hashes, width))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield fold(hashes[None, a:b])
        else:
            yield np.zeros(0, np.uint64)


def stable_fraction(*cols: Column) -> Column:
    """Reproducible uniform number in (0, 1) from the given columns."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))
