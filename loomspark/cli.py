"""Command line: build an index, search it.

Models are given as ``--embedder module:function`` and ``--reranker module:function``
(functions that return a column function, see ``plans/providers.py``); without them the
stand-ins are used.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import query_text
from .operators.context import described, format_results
from .operators.dense import dense_top_k
from .operators.fusion import hybrid_top_k
from .operators.lexical import bm25_top_k
from .operators.rank import rerank
from .plans import build
from .plans.models import hash_embedder, overlap
from .plans.pipeline import Corpus
from .sources.chunks import FILE_ORDER, chunk_store, load_index, read_chunks, with_order
from .sources.store import version


def named(model: str):
    """The column function that ``module:function`` returns."""
    module, _, name = model.partition(":")
    return getattr(importlib.import_module(module), name)()


def main(argv: list[str] | None = None) -> None:
    # Names, choices and defaults of the search options.
    p = argparse.ArgumentParser(prog="loomspark")
    p.add_argument("--chunks", required=True, help="folder or glob of JSON-lines chunk files")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--embedder")
    p.add_argument("--reranker")
    sub = p.add_subparsers(dest="do", required=True)
    b = sub.add_parser("build")
    b.add_argument("--reindex", action="store_true")
    b.add_argument("--reindex-tables-only", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("question")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--year")
    s.add_argument("--type", choices=["narrative", "table"])
    s.add_argument("--mode", choices=["dense", "bm25", "hybrid"], default="dense")
    s.add_argument("--rerank", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomspark").getOrCreate()
    embed = named(a.embedder) if a.embedder else hash_embedder()
    if a.do == "build":
        ix = build.run(spark, a.chunks, a.index, embed, a.reindex, a.reindex_tables_only)
        ix.groupBy("chunk_type").count().show()
        return
    chunks = with_order(chunk_store(read_chunks(spark, a.chunks)), FILE_ORDER)
    index = load_index(spark, a.index)
    asked = spark.createDataFrame([(0, a.question, a.year, a.type)], "query_id long, question string, want_fy string, want_type string").withColumn("qvec", embed(query_text(F.col("question"))))
    if a.mode == "dense":
        found = dense_top_k(index, asked, a.top_k)
    else:
        corpus = Corpus.of(index, chunks, f"{a.index}.lexical-{version(spark, a.index)}")
        found = bm25_top_k(corpus.lexical, asked, a.top_k) if a.mode == "bm25" else hybrid_top_k(index, corpus.lexical, asked, a.top_k)
    if a.rerank:
        found = rerank(found, asked, chunks, named(a.reranker) if a.reranker else overlap)
    for r in format_results(described(found, index, chunks)).orderBy("rank").toLocalIterator():
        print(f"{r.rank}. {r.score_text} [{r.fiscal_year} | {r.chunk_type} | {r.label}]\n   {r.breadcrumb}\n   {r.snippet}")


if __name__ == "__main__":
    main()
