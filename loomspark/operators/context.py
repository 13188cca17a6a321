"""Texts for the answer model, and rows for the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import effective_page, first_non_empty, printed_snippet, snippet
from ..sources.store import materialise
from .lexical import row_keys
from .rank import wanted

BETWEEN = "\n\n---\n\n"


def _head(label: Column, fy: Column, page: Column, bc: Column, width: int) -> Column:
    shown = F.coalesce(page.cast("string"), F.lit("None"))
    return F.concat(label, F.lit("FY "), F.coalesce(fy, F.lit("")), F.lit(" | p."), shown, F.lit(" | "), F.substring(F.coalesce(bc, F.lit("")), 1, width))


def described(results: DataFrame, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their manifest row's metadata and their chunk's body and text."""
    keys = row_keys(manifest, chunks)
    meta = manifest.select("index", *keys, "chunk_type", "fiscal_year", "page", "section_breadcrumb", "table_title")
    shown = materialise(results.join(meta, ["index", "chunk_id"]))
    text = wanted(chunks, shown).select(*keys, F.coalesce(first_non_empty(F.col("text_nl"), F.col("text")), F.lit("")).alias("body"), F.coalesce("text", F.lit("")).alias("full_text"))
    return shown.join(text, keys, "left").drop("ord").na.fill("", ["body", "full_text"])


def metadata(fy: str = "fiscal_year", page: str = "page", bc: str = "section_breadcrumb", width: int = 70) -> Column:
    return _head(F.lit(""), F.col(fy), F.col(page), F.col(bc), width)


def reduce_context(relevant: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, context: each relevant result's block, then those of what was found around it.

    ``relevant`` is :func:`described`; ``found`` is from ``expand.expansion``.
    """
    label = lambda tail: F.concat(F.lit("["), F.col("rank").cast("string"), F.lit(f"{tail}] "))
    own = relevant.select(
        "query_id", "rank", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(_head(label(""), F.col("fiscal_year"), F.col("page"), F.col("section_breadcrumb"), 60), F.lit("\n"), F.col("body")).alias("block")
    )
    found = materialise(found)
    c = wanted(chunks, found.select(F.col("ctx_id").alias("chunk_id"))).select(F.col("chunk_id").alias("ctx_id"), "fiscal_year", effective_page(F.col("page_number"), F.col("start_page")).alias("page"), "section_breadcrumb", F.coalesce(first_non_empty(F.col("text_nl"), F.col("text")), F.lit("")).alias("body"))
    around = found.join(c, "ctx_id").select("query_id", "rank", "part", "pos", F.concat(_head(label("+adj"), F.col("fiscal_year"), F.col("page"), F.col("section_breadcrumb"), 60), F.lit("\n"), F.col("body")).alias("block"))
    blocks = own.unionByName(around).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "pos", "block"))).alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), BETWEEN).alias("context"))


def faithfulness_context(results: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, context: all results, long bodies cut to 1500 characters."""
    cut = F.when(F.length("body") <= 2000, F.col("body")).otherwise(F.substring("body", 1, 1500))
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "))
    block = F.concat(_head(label, F.col("fiscal_year"), F.col("page"), F.col("section_breadcrumb"), 60), F.lit("\n"), cut)
    all_ = results.select("query_id", "rank", block.alias("block")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return all_.select("query_id", (F.substring(text, 1, limit) if limit else text).alias("context"))


def source_rows(results: DataFrame, signals: DataFrame) -> DataFrame:
    """What a reader sees of each result; ``signals``: query_id, rank, signal."""
    j = results.join(signals.select("query_id", "rank", "signal"), ["query_id", "rank"], "left")
    return j.select(
        "query_id",
        "rank",
        "fiscal_year",
        "chunk_type",
        "page",
        "section_breadcrumb",
        F.coalesce("table_title", F.lit("")).alias("table_title"),
        F.round("score", 4).alias("score"),
        snippet(F.col("body")).alias("snippet"),
        "full_text",
        F.coalesce("signal", F.lit("UNKNOWN")).alias("signal"),
    )


def format_results(results: DataFrame) -> DataFrame:
    """One printable line set for each result.

    A table is labelled by its title (55 characters), other chunks by their page, if any;
    only a table shows its prose in place of its text.
    """
    table = F.col("chunk_type") == "table"
    title = F.concat(F.lit("Table: "), F.substring(F.nullif("table_title", F.lit("")), 1, 55))
    page = F.concat(F.lit("p."), F.nullif("page", F.lit(0)).cast("string"))
    return results.select(
        "query_id",
        "rank",
        F.format_string("%.4f", F.col("score")).alias("score_text"),
        "fiscal_year",
        "chunk_type",
        F.when(table, F.coalesce(title, F.lit("Table"))).otherwise(F.coalesce(page, F.lit(""))).alias("label"),
        F.substring(F.coalesce("section_breadcrumb", F.lit("")), 1, 70).alias("breadcrumb"),
        printed_snippet(F.when(table, F.col("body")).otherwise(F.col("full_text"))).alias("snippet"),
    )
