"""Reciprocal rank fusion and what is composed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .dense import dense_top_k
from .lexical import LexicalIndex, bm25_top_k

RRF_K = 60


def _side(results: DataFrame, n: int) -> DataFrame:
    return results.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(float(RRF_K)) + F.col("rank"))).alias(f"s{n}"), F.min("rank").alias(f"r{n}"), F.max("index").alias(f"i{n}"))


def rrf(first: DataFrame, second: DataFrame) -> DataFrame:
    """Fuse two rankings: ties keep the first list's order, then the second's."""
    both = _side(first, 1).join(_side(second, 2), ["query_id", "chunk_id"], "full")
    zero = F.lit(0.0)
    both = both.withColumn("score", F.coalesce("s1", zero) + F.coalesce("s2", zero))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("r1").asc_nulls_last(), F.col("r2"))
    return both.select("query_id", F.row_number().over(w).cast("long").alias("rank"), "score", F.coalesce("i1", "i2").alias("index"), "chunk_id")


def first_k(results: DataFrame, k: int) -> DataFrame:
    return results.filter(F.col("rank") <= k)


def hybrid_top_k(index: DataFrame, ix: LexicalIndex, questions: DataFrame, k: int) -> DataFrame:
    """Dense and keyword search with a pool of max(4k, 20), fused, cut to k."""
    pool = max(4 * k, 20)
    return first_k(rrf(dense_top_k(index, questions, pool), bm25_top_k(ix, questions, pool)), k)


def merge_variants(results: DataFrame) -> DataFrame:
    """Union of rankings (query_id, variant, rank, ...): each chunk once, at its first place."""
    first = W.partitionBy("query_id", "chunk_id").orderBy("variant", "rank")
    once = results.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")
    order = W.partitionBy("query_id").orderBy("variant", "rank")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).drop("variant")


def multi_query(index: DataFrame, ix: LexicalIndex, variants: DataFrame, k: int, reranker=None) -> DataFrame:
    """``variants``: query_id, variant, question, qvec (want_fy, want_type): hybrid search for
    each, merged, reranked against the first variant if a reranker is given, cut to k."""
    coded = variants.withColumn("of", F.struct("query_id", "variant")).withColumn("qid", F.xxhash64("query_id", "variant"))
    found = hybrid_top_k(index, ix, coded.withColumn("query_id", F.col("qid")), k).withColumnRenamed("query_id", "qid")
    merged = merge_variants(found.join(coded.select("qid", "of.query_id", "of.variant"), "qid").drop("qid"))
    if reranker is not None:
        merged = reranker(merged, variants.filter("variant = 0").select("query_id", "question"))
    return first_k(merged, k)
