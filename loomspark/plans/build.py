"""Building an index, from scratch, by resuming, or for its tables only."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EMBED_TYPES, MANIFEST_COLUMNS
from ..sources.chunks import FILE_ORDER, chunk_store, load_index, manifest_rows, read_chunks, with_order, write_index
from ..sources.store import file_system, materialise

#: Parts in which a build embeds, each written when it is done.
SLICES = 16
LOG = logging.getLogger(__name__)


def todo(eligible: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks that the index does not have yet."""
    return eligible.join(manifest.select("chunk_id"), "chunk_id", "left_anti")


def next_index(index: DataFrame) -> int:
    top = index.agg(F.max("index")).first()[0]
    return 0 if top is None else top + 1


def type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("chunk_type").isin(*EMBED_TYPES)).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


def embed_in_slices(rows: DataFrame, embed: Callable[[Column], Column], path: str, slices: int) -> DataFrame:
    """``rows`` with ``embedding``, kept at ``path``, slice by slice.

    Each slice is written when it is done, and a run after one that broke off goes on with
    the rows that no slice has written.  A row whose embedding fails has a null.
    """
    spark = rows.sparkSession
    for i in range(slices):
        part = rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(slices)) == i)
        try:
            part = todo(part, spark.read.parquet(path))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        part.withColumn("embedding", embed(F.col("embed_text"))).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def build_index(eligible: DataFrame, embed: Callable[[Column], Column], order: list[str], start: int = 0, pending: str | None = None, slices: int = SLICES) -> DataFrame:
    """Manifest rows with vectors, ``index`` from ``start`` in the given order.

    A row whose embedding fails (null) is left out, counted and logged; it is tried again by
    the next resuming run.  ``pending``: a folder that keeps vectors until the index is whole.
    """
    rows = manifest_rows(eligible)
    if pending is None:
        done = materialise(rows.withColumn("embedding", embed(F.col("embed_text"))))
    else:
        done = embed_in_slices(rows, embed, pending, slices)
    failed = done.filter("embedding is null").count()
    if failed:
        LOG.warning("%d chunks could not be embedded; the next run tries them again", failed)
    rows = with_order(done.filter("embedding is not null"), order, "index").withColumn("index", (F.col("index") + start).cast("long"))
    return rows.select(*MANIFEST_COLUMNS, "embedding")


def reembed_tables(index: DataFrame, eligible: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """New vectors and ``embed_chars`` for the tables, all else as it was.

    A table whose chunk has gone keeps its old row.
    """
    tables = manifest_rows(eligible.filter("chunk_type = 'table'")).select("chunk_id", F.col("embed_chars").alias("chars_"), embed(F.col("embed_text")).alias("vec_"))
    kept = index.filter("chunk_type != 'table'")
    new = index.filter("chunk_type = 'table'").join(tables, "chunk_id", "left")
    new = new.withColumn("embedding", F.coalesce("vec_", "embedding")).withColumn("embed_chars", F.coalesce("chars_", "embed_chars"))
    return kept.unionByName(new.select(*kept.columns))


def run(spark: SparkSession, source: str, path: str, embed: Callable[[Column], Column], reindex: bool = False, tables_only: bool = False) -> DataFrame:
    """Build or update the index at ``path`` and return it.

    Vectors are kept in slices beside the index until it is whole, so that a run that
    breaks off is taken up where it stopped.  A new version is written beside the old one
    and then takes its place, so that a run that fails leaves an index.
    """
    eligible = read_chunks(spark, source, eligible_only=True)
    pending = f"{path}.pending"
    old = None
    if not reindex or tables_only:
        try:
            old = load_index(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if tables_only and old is not None:
        new = reembed_tables(old, chunk_store(eligible), embed)
    elif old is None:
        new = build_index(eligible, embed, FILE_ORDER, pending=pending)
    else:
        start = next_index(old)
        new = old.unionByName(build_index(todo(eligible, old), embed, FILE_ORDER, start, pending))
    write_index(new, f"{path}.new")
    replace(spark, f"{path}.new", path)
    fs, target = file_system(spark, pending)
    fs.delete(target, True)
    return load_index(spark, path)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put ``new`` in the place of ``path``; if that fails, the old one is put back."""
    fs, target = file_system(spark, path)
    source, aside = file_system(spark, new)[1], file_system(spark, f"{path}.old")[1]
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if fs.exists(aside):
            fs.rename(aside, target)
        raise OSError(f"could not move {new} to {path}")
    fs.delete(aside, True)
