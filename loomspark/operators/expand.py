"""Context lookup around results: parents, pages, neighbours, tables of the same page.

All are equi-joins.  ``chunks`` has ``ord``, the order of the chunk store.  Each returns
query_id, rank, part, pos, ctx_id: the chunks found for a result, ordered by (part, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import effective_page, id_number, id_prefix


def _own(results: DataFrame, chunks: DataFrame, *cols: str) -> DataFrame:
    """Results with columns of their chunks, which are in ``own_``-names."""
    mine = chunks.select("chunk_id", *[F.col(c).alias(f"own_{c}") for c in cols])
    return results.select("query_id", "rank", "chunk_id").join(mine, "chunk_id")


def parent_child(results: DataFrame, chunks: DataFrame, max_related: int = 3) -> DataFrame:
    """Related chunks (the first few named, if they exist), the parent, its other children,
    the chunk's own children; each once, at most twice ``max_related`` for a result."""
    me = _own(results, chunks, "related_chunk_ids", "parent_chunk_id")
    ids = chunks.select(F.col("chunk_id").alias("ctx_id"))
    child = chunks.filter(F.col("parent_chunk_id").isNotNull() & (F.col("parent_chunk_id") != "")).select(F.col("chunk_id").alias("ctx_id"), F.col("parent_chunk_id").alias("of_"), "ord")
    related = me.select("query_id", "rank", F.lit(1).alias("part"), F.posexplode(F.slice("own_related_chunk_ids", 1, max_related)).alias("pos", "ctx_id")).join(ids, "ctx_id")
    has = F.col("own_parent_chunk_id").isNotNull() & (F.col("own_parent_chunk_id") != "")
    parent = me.filter(has).select("query_id", "rank", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.col("own_parent_chunk_id").alias("ctx_id")).join(ids, "ctx_id")
    sibling = me.filter(has).join(child, F.col("own_parent_chunk_id") == F.col("of_")).filter("ctx_id != chunk_id").select("query_id", "rank", F.lit(3).alias("part"), F.col("ord").alias("pos"), "ctx_id")
    own = me.join(child, F.col("chunk_id") == F.col("of_")).select("query_id", "rank", F.lit(4).alias("part"), F.col("ord").alias("pos"), "ctx_id")
    cols = ["query_id", "rank", "part", F.col("pos").cast("long").alias("pos"), "ctx_id"]
    every = related.select(*cols).unionByName(parent.select(*cols)).unionByName(sibling.select(*cols)).unionByName(own.select(*cols))
    once = every.withColumn("n_", F.row_number().over(W.partitionBy("query_id", "rank", "ctx_id").orderBy("part", "pos"))).filter("n_ = 1")
    place = F.row_number().over(W.partitionBy("query_id", "rank").orderBy("part", "pos"))
    return once.withColumn("n_", place).filter(F.col("n_") <= 2 * max_related).select("query_id", "rank", "part", "pos", "ctx_id")


def full_page(results: DataFrame, chunks: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """All other chunks of the result's fiscal year and page that it does not have yet."""
    page = effective_page(F.col("page_number"), F.col("start_page"))
    store = chunks.select(F.col("chunk_id").alias("ctx_id"), F.coalesce("fiscal_year", F.lit("")).alias("fy_"), page.alias("page_"), "ord").filter("page_ is not null")
    me = results.select("query_id", "rank", "chunk_id").join(store.select(F.col("ctx_id").alias("chunk_id"), "fy_", "page_"), "chunk_id")
    found = me.join(store, ["fy_", "page_"]).filter("ctx_id != chunk_id")
    if already is not None:
        found = found.join(already.select("query_id", "rank", "ctx_id"), ["query_id", "rank", "ctx_id"], "left_anti")
    return found.select("query_id", "rank", F.lit(5).alias("part"), F.col("ord").alias("pos"), "ctx_id")


def neighbours(results: DataFrame, chunks: DataFrame, radius: int | None = None) -> DataFrame:
    """Chunks whose number in the same fiscal-year prefix is at most ``radius`` away.

    ``results`` may have its own ``radius`` column.  A gap in the numbers gives nothing.
    """
    store = chunks.select("chunk_id", "ord", id_prefix(F.col("chunk_id")).alias("pre_"), id_number(F.col("chunk_id")).alias("num_")).filter("pre_ is not null")
    at = store.groupBy("pre_", "num_").agg(F.max_by("chunk_id", "ord").alias("ctx_id"))
    r = F.lit(radius) if radius is not None else F.col("radius")
    me = results.withColumn("pre_", id_prefix(F.col("chunk_id"))).withColumn("mine_", id_number(F.col("chunk_id"))).filter("pre_ is not null")
    steps = me.withColumn("pos", F.explode(F.sequence(-r, r))).filter("pos != 0").withColumn("num_", F.col("mine_") + F.col("pos"))
    return steps.join(at, ["pre_", "num_"]).select("query_id", "rank", F.lit(6).alias("part"), F.col("pos").cast("long").alias("pos"), "ctx_id")


def same_page_tables(results: DataFrame, chunks: DataFrame, exclude: DataFrame, strict_scope: bool = False) -> DataFrame:
    """For a table: the other tables with its page number, in any fiscal year.

    A missing page number counts as 0.  ``exclude`` (query_id, chunk_id) are never given.
    ``strict_scope`` keeps to the same fiscal year.
    """
    tables = chunks.filter("chunk_type = 'table'").select("chunk_id", "ord", F.coalesce("page_number", F.lit(0)).alias("page_"), F.coalesce("fiscal_year", F.lit("")).alias("fy_"))
    me = results.select("query_id", "rank", "chunk_id").join(tables.drop("ord"), "chunk_id")
    other = tables.withColumnRenamed("chunk_id", "ctx_id")
    if not strict_scope:
        me, other = me.drop("fy_"), other.drop("fy_")
    found = me.join(other, ["page_", "fy_"] if strict_scope else ["page_"]).filter("ctx_id != chunk_id")
    found = found.join(exclude.select("query_id", F.col("chunk_id").alias("ctx_id")).distinct(), ["query_id", "ctx_id"], "left_anti")
    return found.select("query_id", "rank", F.lit(7).alias("part"), F.col("ord").alias("pos"), "ctx_id")


def expansion(relevant: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """What the answer step sees beside relevant results (query_id, rank, chunk_id, signal).

    Neighbours if the signal asks for them or the radius is above 1, then same-page tables
    of tables; the two lists are not merged, and neighbours may be relevant themselves.
    """
    near = relevant if radius > 1 else relevant.filter("signal = 'NEED_ADJACENT'")
    return neighbours(near, chunks, radius).unionByName(same_page_tables(relevant, chunks, relevant))


def collect_context(found: DataFrame) -> DataFrame:
    """query_id, rank, context: ordered array of chunk ids."""
    return found.groupBy("query_id", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "ctx_id"))), lambda x: x["ctx_id"]).alias("context"))
