"""Every retrieval operator as a query over the test tables (chunks derived from them)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import expand as X
from ..operators import fusion, rank
from ..operators.dense import dense_top_k
from ..operators.lexical import bm25_scores, bm25_top_k
from ..sources import chunks as S
from ..sources import driver_tables as D
from ..sources.store import materialise, shared_dir, stored, version
from . import build
from .models import stand_ins
from .pipeline import Corpus, ask, hyde, stage3, with_pages

WANT_FY, WANT_TYPE = "2019-2020", "table"
Q = Callable[[SparkSession, str], DataFrame]


def corpus(spark: SparkSession, sf_dir: str, texts: bool = True) -> Corpus:
    """Index, chunks and keyword index; what is derived is stored once for these files.

    ``texts``: the index has ``embed_text``, which is not stored but joined from the chunks.
    """
    root = _root(spark, sf_dir)
    index = stored(spark, f"{root}/index", lambda: D.index(spark, sf_dir))
    found = Corpus.of(index, D.chunks(spark, sf_dir), f"{root}/lexical")
    return Corpus(D.with_embed_text(index, spark, sf_dir), found.chunks, lambda: found.lexical) if texts else found


#: For all that embeds nothing.
_corpus = partial(corpus, texts=False)


def _root(spark: SparkSession, sf_dir: str) -> str:
    return f"{shared_dir(spark)}/loomspark-index-{version(spark, f'{sf_dir}/documents.parquet', f'{sf_dir}/embeddings.parquet')}"


def _vector(spark: SparkSession, sf_dir: str, shift: int, name: str) -> DataFrame:
    return D.table(spark, sf_dir, "embeddings").select((F.col("vec_id") - shift).alias("query_id"), F.col("embedding").alias(name))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a hypothetical answer's vector and keywords; every other one asks for a year."""
    q = D.questions(spark, sf_dir).join(_vector(spark, sf_dir, 2, "hvec"), "query_id", "left")
    return q.withColumn("keywords", T.keywords(F.col("question"))).withColumn("want_fy", F.when(F.col("query_id") % 2 == 0, F.lit(WANT_FY)))


def _out(results: DataFrame, places: int = 5) -> DataFrame:
    return results.select("query_id", "rank", F.round("score", places).alias("score"), "index", "chunk_id")


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir)
    return c.filter(F.col("chunk_type").isin("narrative", "table")).select("chunk_id", "chunk_type", "fiscal_year", "text")


def chunk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk store when ids repeat: here an id for each source and type, last one wins."""
    c = D.chunks(spark, sf_dir).select(F.concat_ws("_", "source_file", "chunk_type").alias("chunk_id"), F.lit("f").alias("file"), F.col("ord").alias("line"), "fiscal_year")
    return S.chunk_store(c).select("chunk_id", F.col("line"), "fiscal_year")


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.type_counts(D.chunks(spark, sf_dir))


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.manifest_rows(D.chunks(spark, sf_dir)).select("chunk_id", "page", "embed_chars", F.md5("embed_text").alias("text_md5"))


def bm25_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.lexical_text(F.col("chunk_type"), F.col("text"), F.col("text_nl"), F.col("section_breadcrumb"))
    return D.chunks(spark, sf_dir).select("chunk_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.keywords(F.col("text")).alias("keywords"))


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = D.chunks(spark, sf_dir).filter(F.col("chunk_type").isin("narrative", "table"))
    return build.todo(eligible, _corpus(spark, sf_dir).index.filter("embedding is not null")).select("chunk_id")


def index_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.per_type_index(_corpus(spark, sf_dir).index).select("chunk_id", "chunk_type", "index", "local_index", "page", "embed_chars", "table_title")


def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.questions(spark, sf_dir).select("query_id", F.md5(T.query_text(F.col("question"))).alias("text_md5"))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).lexical.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bm25_scores(_corpus(spark, sf_dir).lexical, D.questions(spark, sf_dir))
    return s.select("query_id", "index", F.round("score", 5).alias("score"))


def _filtered(q: DataFrame) -> DataFrame:
    return q.withColumn("want_fy", F.lit(WANT_FY)).withColumn("want_type", F.lit(WANT_TYPE))


def bm25_topk(spark: SparkSession, sf_dir: str, filtered: bool = False) -> DataFrame:
    q = D.questions(spark, sf_dir)
    return _out(bm25_top_k(_corpus(spark, sf_dir).lexical, _filtered(q) if filtered else q, 10))


def dense_topk(spark: SparkSession, sf_dir: str, filtered: bool = False) -> DataFrame:
    q = D.questions(spark, sf_dir)
    return _out(dense_top_k(_corpus(spark, sf_dir).index, _filtered(q) if filtered else q, 10), 5)


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product and normalisation of every vector with its scaled self."""
    v = D.table(spark, sf_dir, "embeddings").withColumn("twice", F.transform("embedding", lambda x: x * 2))
    return v.select("vec_id", F.round(T.dot(F.col("embedding"), F.col("twice")), 5).alias("dot"), F.round(T.dot(T.l2_normalise(F.col("twice")), F.col("embedding")), 5).alias("cosine"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _corpus(spark, sf_dir), D.questions(spark, sf_dir)
    return _out(fusion.rrf(dense_top_k(c.index, q, 20), bm25_top_k(c.lexical, q, 20)))


def rrf_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _corpus(spark, sf_dir), _asked(spark, sf_dir).drop("want_fy")
    base = fusion.rrf(dense_top_k(c.index, q, 20), bm25_top_k(c.lexical, q, 20))
    return _out(fusion.rrf(base, dense_top_k(c.index, q.withColumn("qvec", F.col("hvec")), 20)))


def hybrid_results(spark: SparkSession, sf_dir: str, k: int = 5) -> tuple[Corpus, DataFrame]:
    c = _corpus(spark, sf_dir)
    return c, materialise(fusion.hybrid_top_k(c.index, c.lexical, D.questions(spark, sf_dir), k))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(hybrid_results(spark, sf_dir)[1])


def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _corpus(spark, sf_dir), D.questions(spark, sf_dir)
    other = q.select("query_id", F.lit(1).alias("variant"), T.keywords(F.col("question")).alias("question")).join(_vector(spark, sf_dir, 1, "qvec"), "query_id", "left")
    both = q.select("query_id", F.lit(0).alias("variant"), "question", "qvec").unionByName(other)
    return _out(fusion.multi_query(c.index, c.lexical, both, 5))


def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = hybrid_results(spark, sf_dir, 20)
    return _out(rank.deduplicate(r, c.chunks))


def edge_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(rank.edge_reorder(hybrid_results(spark, sf_dir)[1]))


def hyde_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(hyde(_corpus(spark, sf_dir), _asked(spark, sf_dir).drop("want_fy"), 5))


def stage3_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    found = with_pages(materialise(stage3(c, _asked(spark, sf_dir), 10)), c)
    return _out(found.withColumn("chunk_id", F.concat_ws(" ", "chunk_id", "context")))


def listwise_rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hybrid_results(spark, sf_dir)[1]
    orders = D.questions(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 3 != 0, F.array(F.lit(3), F.lit(3), F.lit(9), F.lit(1))).alias("order"))
    return _out(rank.apply_permutation(r, orders))


def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = hybrid_results(spark, sf_dir, 10)
    return _out(rank.rerank(r, D.questions(spark, sf_dir), c.chunks, stand_ins().pair_score))


def _found(f: Callable[[Corpus, DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = hybrid_results(spark, sf_dir)
    return f(c, r).select("query_id", "rank", "part", "pos", "ctx_id")


def signals(results: DataFrame) -> DataFrame:
    return results.withColumn("signal", F.element_at(F.array(F.lit("NOT_FOUND"), F.lit("YES"), F.lit("NEED_ADJACENT")), (F.col("rank") % 3 + 1).cast("int")))


def _relevant(results: DataFrame) -> DataFrame:
    return signals(results).filter(F.col("signal").isin("YES", "NEED_ADJACENT"))


def expand_policy(c: Corpus, r: DataFrame) -> DataFrame:
    return X.expansion(_relevant(r), c.chunks, 1)


def reduce_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = hybrid_results(spark, sf_dir)
    rel = materialise(_relevant(r))
    text = C.reduce_context(C.described(rel, c.index, c.chunks), X.expansion(rel, c.chunks, 1), c.chunks)
    return text.select("query_id", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n"))


def faithfulness_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = hybrid_results(spark, sf_dir)
    text = C.faithfulness_context(C.described(r, c.index, c.chunks), 4000)
    return text.select("query_id", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = hybrid_results(spark, sf_dir)
    return C.source_rows(C.described(r, c.index, c.chunks), signals(r).filter("rank < 5"))


def format_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = hybrid_results(spark, sf_dir)
    return C.format_results(C.described(r, c.index, c.chunks))


def verdict_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in (" yes, clearly", "need more", "Adjacent page", "maybe", "no: see the adjacent one", "")]), (F.col("turn") % 6 + 1).cast("int"))
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.verdict(F.concat(said, F.lit(" "), F.coalesce("text", F.lit("")))).alias("signal"))


def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir).select("chunk_id").unionByName(D.table(spark, sf_dir, "documents").select(F.concat_ws("_", "source", "lang").alias("chunk_id")))
    return c.select("chunk_id", T.id_prefix(F.col("chunk_id")).alias("prefix"), T.id_number(F.col("chunk_id")).alias("number"))


def image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.base64(F.encode("text", "UTF-8"))
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), b)).otherwise(b)
    p = T.image_parts(url)
    return D.table(spark, sf_dir, "documents").select("doc_id", p["mime"].alias("mime"), F.md5(p["data"]).alias("data_md5"))


def two_way_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(T.two_way_softmax(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")), 6).alias("p"))


def _ask(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every benchmark item as a request, models by stand-ins; vectors by the hashing one too."""
    req = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("fiscal_year"), (F.col("item_id") % 2 == 1).alias("power_search"))
    c = _corpus(spark, sf_dir)
    stub = stand_ins()
    index = stored(spark, f"{_root(spark, sf_dir)}/hashed", lambda: D.with_embed_text(c.index, spark, sf_dir).withColumn("embedding", stub.embed(F.col("embed_text"))).drop("embed_text"))
    return ask(stub, Corpus(index, c.chunks, c.lexical), req)


def ask_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir)[0].drop("filters_detected")


def ask_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir)[1].drop("full_text")


QUERIES: dict[str, Q] = {
    "chunk_scan": chunk_scan,
    "chunk_dedupe": chunk_dedupe,
    "type_counts": type_counts,
    "embed_text": embed_text,
    "bm25_text": bm25_text,
    "query_text": query_text,
    "tokenize_counts": tokenize_counts,
    "keyword_fallback": keyword_fallback,
    "resume_todo": resume_todo,
    "index_per_type": index_per_type,
    "bm25_stats": bm25_stats,
    "bm25_scores": bm25_all_scores,
    "bm25_topk": bm25_topk,
    "bm25_topk_filtered": partial(bm25_topk, filtered=True),
    "dense_topk": dense_topk,
    "dense_topk_filtered": partial(dense_topk, filtered=True),
    "vector_functions": vector_functions,
    "rrf_fuse": rrf_fuse,
    "rrf_nested": rrf_nested,
    "hybrid_topk": hybrid_topk,
    "multi_query_merge": multi_query_merge,
    "dedup_greedy": dedup_greedy,
    "edge_reorder": edge_reorder,
    "hyde_pipeline": hyde_pipeline,
    "stage3_pipeline": stage3_pipeline,
    "listwise_rerank_apply": listwise_rerank_apply,
    "rerank_pairs": rerank_pairs,
    "expand_parent_child": partial(_found, lambda c, r: X.parent_child(r, c.chunks)),
    "expand_full_page": partial(_found, lambda c, r: X.full_page(r, c.chunks)),
    "expand_neighbours": partial(_found, lambda c, r: X.neighbours(r, c.chunks, 3)),
    "expand_same_page_tables": partial(_found, lambda c, r: X.same_page_tables(r, c.chunks, r)),
    "expand_policy": partial(_found, expand_policy),
    "verdict_normalise": verdict_normalise,
    "id_parts": id_parts,
    "image_decode": image_decode,
    "two_way_softmax": two_way_softmax,
    "reduce_context": reduce_context,
    "faithfulness_context": faithfulness_context,
    "source_rows": source_rows,
    "format_results": format_results,
    "ask_staged": ask_staged,
    "ask_sources": ask_sources,
}
