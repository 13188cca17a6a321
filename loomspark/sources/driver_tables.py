"""Chunks, index and questions derived from the generic test tables.

Fiscal year, page, type and links are made up from the document id by fixed rules, so
that every retrieval operator has something to work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ship

#: Tables whose rows are costly to work on.
DEALT = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  One that comes as fewer partitions than there are cores is dealt to all of them."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if name not in DEALT or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: The derivation, written once for both engines (``div`` is ``//`` in the oracle).
CHUNK_SQL = """
SELECT doc_id AS ord, chunk_id, chunk_type, text,
  CASE WHEN chunk_type = 'table' AND idx % 16 = 1 THEN concat('Summary. ', text) END AS text_nl,
  fiscal_year, source AS source_file,
  CASE WHEN idx % 3 = 0 THEN '' ELSE concat('Part ', idx % 3, ' > ', source) END AS section_breadcrumb,
  CASE WHEN chunk_type = 'table' THEN concat('Table ', idx) END AS table_title,
  CASE WHEN chunk_type <> 'narrative' THEN page END AS page_number,
  CASE WHEN chunk_type = 'narrative' THEN page END AS start_page,
  CASE WHEN idx % 8 = 6 THEN concat(fyp, '_table_', lpad(CAST(page AS STRING), 4, '0'), '_', lpad(CAST(idx - 5 AS STRING), 4, '0')) END AS parent_chunk_id,
  CASE WHEN idx % 8 = 0 THEN {array}concat(fyp, '_table_', lpad(CAST(page AS STRING), 4, '0'), '_', lpad(CAST(idx + 1 AS STRING), 4, '0')), 'no_such_chunk'{end} END AS related_chunk_ids
FROM (
  SELECT *, concat(fyp, '_', chunk_type, '_', lpad(CAST(page AS STRING), 4, '0'), '_', lpad(CAST(idx AS STRING), 4, '0')) AS chunk_id
  FROM (
    SELECT *, CASE WHEN idx % 8 IN (1, 6) THEN 'table' WHEN idx % 8 = 3 THEN 'chart' WHEN idx % 8 = 7 THEN 'footnote' ELSE 'narrative' END AS chunk_type,
      concat(fy, '-', fy + 1) AS fiscal_year, concat(fy, fy + 1) AS fyp, CAST(1 + idx {div} 8 AS INT) AS page
    FROM (SELECT doc_id, text, source, doc_id {div} 5 AS idx, 2018 + doc_id % 5 AS fy FROM documents)
  )
)
"""

SPARK_CHUNKS = CHUNK_SQL.format(array="array(", end=")", div="div")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return spark.sql(SPARK_CHUNKS.replace("FROM documents", "FROM {docs}"), docs=docs)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all eligible chunks, ``index`` dense from 0, with a vector where there is one.

    It has no texts: they stay where they are (see :func:`with_embed_text`).
    """
    from .chunks import manifest_rows, with_order

    rows = manifest_rows(chunks(spark, sf_dir).filter("chunk_type in ('narrative', 'table')")).drop("embed_text")
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    return with_order(rows.join(vec, "ord", "left"), ["ord"], "index")


def with_embed_text(index: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``index`` with ``embed_text``, the text that is embedded."""
    from .chunks import manifest_rows

    return index.join(manifest_rows(chunks(spark, sf_dir)).select("ord", "embed_text"), "ord", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question, qvec: every benchmark item, its vector that of the same number."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return q.join(v, "query_id", "left")
