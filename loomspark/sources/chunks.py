"""Chunk files, the index on disk, and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import effective_page, embed_text
from ..schemas import CHUNK, EMBED_TYPES
from .store import materialise


#: Columns that order the chunks of files.
FILE_ORDER = ["file", "block", "line"]


def read_chunks(spark: SparkSession, paths: str | list[str], eligible_only: bool = False) -> DataFrame:
    """Chunks of JSON-lines files with ``file``, ``block`` and ``line``, which give them an order.

    Files are split and read by blocks; ``line`` counts within a block's task.  A line that
    is no JSON object fails the read.  Blank lines are skipped.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line")
    )
    parsed = lines.filter(F.trim("raw") != "").withColumn("c", F.from_json("raw", CHUNK, {"mode": "FAILFAST"}))
    out = parsed.select(*FILE_ORDER, "c.*")
    return out.filter(F.col("chunk_type").isin(*EMBED_TYPES)) if eligible_only else out


def chunk_store(chunks: DataFrame) -> DataFrame:
    """One row for each id; of several the last in file order stays."""
    order = [c for c in FILE_ORDER if c in chunks.columns]
    last = chunks.groupBy("chunk_id").agg(F.max(F.struct(*order, *[c for c in chunks.columns if c not in (*order, "chunk_id")])).alias("c"))
    return last.select("chunk_id", "c.*")


def with_order(chunks: DataFrame, by: list[str], name: str = "ord") -> DataFrame:
    """A dense number from 0 in the order of ``by``.

    Rows are range-partitioned and numbered within their range, and written so; the ranges'
    sizes, one number for each partition, give the offsets.
    """
    spark = chunks.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = chunks.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialise(placed)
    sizes = placed.groupBy("part_").agg((F.max("at_") + 1).alias("n_"))
    offsets = sizes.withColumn("from_", F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return placed.join(F.broadcast(offsets.select("part_", "from_")), "part_").withColumn(name, (F.col("from_") + F.col("at_")).cast("long")).drop("part_", "at_", "from_")


def manifest_rows(chunks: DataFrame) -> DataFrame:
    """Metadata of what is embedded, with ``embed_text``."""
    text = embed_text(F.col("chunk_type"), F.col("text"), F.col("text_nl"), F.col("section_breadcrumb"), F.col("table_title"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return chunks.select(
        "chunk_id",
        "chunk_type",
        blank("fiscal_year"),
        blank("source_file"),
        blank("section_breadcrumb"),
        effective_page(F.col("page_number"), F.col("start_page")).alias("page"),
        F.length(text).cast("int").alias("embed_chars"),
        F.when(F.col("chunk_type") == "table", F.coalesce("table_title", F.lit(""))).alias("table_title"),
        text.alias("embed_text"),
        *[c for c in (*FILE_ORDER, "ord") if c in chunks.columns],
    )


def write_index(index: DataFrame, path: str) -> None:
    """The index, partitioned by type so that a search of one type reads that type alone."""
    index.write.mode("overwrite").partitionBy("chunk_type").parquet(path)


def load_index(spark: SparkSession, path: str, chunk_type: str | None = None) -> DataFrame:
    """The index, or one type of it by partition pruning.  A path without an index fails."""
    out = spark.read.parquet(path)
    return out.filter(F.col("chunk_type") == chunk_type) if chunk_type else out


def per_type_index(index: DataFrame) -> DataFrame:
    """``local_index``: position among the rows of the same type."""
    parts = [with_order(index.filter(F.col("chunk_type") == t), ["index"], "local_index") for t in EMBED_TYPES]
    return reduce(DataFrame.unionByName, parts)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; a blank question becomes an error row downstream."""
    from ..schemas import QUESTION

    return spark.read.schema(QUESTION).json(path)


def write_responses(answers: DataFrame, path: str) -> None:
    answers.write.mode("overwrite").json(path)
