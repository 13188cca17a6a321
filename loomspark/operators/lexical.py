"""Okapi BM25 over a relational inverted index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import lexical_text, tokens
from ..sources.store import materialise, stored
from .dense import matches, rank_by, top_k

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Buckets of terms of a stored index; take more for a larger corpus.
BUCKETS = 16
#: Bytes of questions that are sent to the executors.
SEND_BYTES = 1 << 23


@dataclass
class LexicalIndex:
    """Tables of an index: they hold for the whole corpus, whatever a search filters."""

    postings: DataFrame  # bucket, term, index, tf, dl
    terms: DataFrame  # bucket, term, df, idf
    rows: DataFrame  # index, chunk_id, chunk_type, fiscal_year
    n: int
    avgdl: float


def bucket(buckets: int) -> Column:
    """Part of the stored index that a term is in."""
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def row_keys(index: DataFrame, chunks: DataFrame) -> list[str]:
    """What tells the chunk of an index row: its id, and its place in the store where both have it,
    as ids may repeat."""
    return ["chunk_id", *(["ord"] if "ord" in index.columns and "ord" in chunks.columns else [])]


def manifest_text(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """index rows with ``lexical``, the text that is searched; a missing chunk gives an empty one."""
    keys = row_keys(index, chunks)
    body = chunks.select(*keys, "text", "text_nl")
    joined = index.select("index", *keys, "chunk_type", "fiscal_year", "section_breadcrumb").join(body, keys, "left")
    return joined.withColumn("lexical", lexical_text(F.col("chunk_type"), F.col("text"), F.col("text_nl"), F.col("section_breadcrumb")))


def lexical_index(spark: SparkSession, rows: Callable[[], DataFrame], path: str, buckets: int = BUCKETS) -> LexicalIndex:
    """The keyword index stored at ``path``; built there from ``rows`` if it is not.

    ``rows``: index, chunk_id, chunk_type, fiscal_year, lexical.  Postings and terms are
    partitioned by ``bucket`` of the term, so that a search reads its terms' buckets alone.
    Name ``path`` by the version of what is indexed: a stored index is never looked through
    for changes.
    """

    def postings() -> DataFrame:
        # Grouped by what the rows were joined by too: their tokens are counted where they are.
        of = [c for c in ("chunk_id", "ord", "index") if c in rows().columns]
        toks = rows().select(*of, tokens(F.col("lexical")).alias("t")).select(*of, F.size("t").alias("dl"), F.explode("t").alias("term"))
        counted = toks.groupBy(*of, "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")).withColumn("bucket", bucket(buckets))
        # A row's terms of one bucket travel as one string; no term has a blank.
        packed = counted.groupBy(*of, "dl", "bucket").agg(F.collect_list(F.struct("term", "tf")).alias("v"))
        sent = packed.select("bucket", "index", "dl", F.array_join(F.col("v.term"), " ").alias("terms"), F.col("v.tf").alias("tfs")).repartition("bucket")
        each = sent.select("index", "dl", "bucket", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))).alias("p"))
        return each.select("p.term", "index", F.col("p.tf").cast("long").alias("tf"), "dl", "bucket")

    names = stored(spark, f"{path}/rows", lambda: rows().select("index", "chunk_id", "chunk_type", "fiscal_year"))
    found = stored(spark, f"{path}/postings", postings, "bucket")

    def sums() -> DataFrame:
        return names.agg(F.count(F.lit(1)).alias("n")).crossJoin(found.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length")))  # one row each

    total = stored(spark, f"{path}/sums", sums).first()

    def terms() -> DataFrame:
        df = found.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
        raw = df.withColumn("raw", F.log(F.lit(total.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        # Summed as decimals, so that the mean is the same in whatever order terms come.
        s = raw.agg(F.sum(F.col("raw").cast("decimal(28,18)")).alias("sum"), F.count("raw").alias("n")).first()
        mean = float(s["sum"]) / s["n"] if s["n"] else 0.0
        idf = F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw"))
        return raw.select("bucket", "term", "df", idf.alias("idf")).repartition("bucket")

    return LexicalIndex(found, stored(spark, f"{path}/terms", terms, "bucket"), names, total.n, total.length / total.n if total.n else 0.0)


def _hits(ix: LexicalIndex, questions: DataFrame, text: str) -> DataFrame:
    """query_id, index, part of every token that a row and a question share.

    Up to ``SEND_BYTES`` of questions go to the postings, which are not shuffled for them.
    """
    small = (questions.agg(F.sum(F.length(text) + 16)).first()[0] or 0) <= SEND_BYTES
    sent = F.broadcast if small else lambda x: x
    asked = questions.select("query_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(ix.avgdl or 1.0)))
    known = sent(ix.terms.join(sent(asked), "term"))
    return ix.postings.join(known, ["bucket", "term"]).select("query_id", "index", (F.col("qtf") * weight).alias("part"))


def bm25_scores(ix: LexicalIndex, questions: DataFrame, text: str = "question") -> DataFrame:
    """query_id, index, score of every row that shares a token with the question."""
    return _hits(ix, questions, text).groupBy("query_id", "index").agg(F.sum("part").alias("score"))


def bm25_top_k(ix: LexicalIndex, questions: DataFrame, k: int, text: str = "question") -> DataFrame:
    """query_id, rank, score, index, chunk_id; min(k, eligible rows) for each question.

    ``questions`` may have want_fy and want_type.  Rows that share no token count as 0 and
    are eligible: a question with fewer than k better ones is filled up with the last such
    rows, taken from the last k + (its matches) eligible rows, never from a cross product.
    """
    for c in ("want_fy", "want_type"):
        if c not in questions.columns:
            questions = questions.withColumn(c, F.lit(None).cast("string"))
    wants = questions.select("query_id", F.coalesce("want_fy", F.lit("")).alias("want_fy"), F.coalesce("want_type", F.lit("")).alias("want_type"))
    wants = materialise(wants)
    ok = matches(F.col("fiscal_year"), F.col("chunk_type"), F.col("want_fy"), F.col("want_type"))

    def eligible(asked: DataFrame) -> DataFrame:
        """Scores of the rows that a search may give."""
        if wants.filter("want_fy != '' or want_type != ''").isEmpty():
            return bm25_scores(ix, asked, text)
        # Dealt by row, scores are summed up where the rows' years and types are.
        summed = _hits(ix, asked, text).repartition("index").groupBy("index", "query_id").agg(F.sum("part").alias("score"))
        return summed.join(ix.rows, "index").join(wants, "query_id").filter(ok).select("query_id", "index", "score")

    best = materialise(top_k(eligible(questions), k))
    good = best.filter(F.round("score", 9) >= 0).groupBy("query_id").agg(F.count(F.lit(1)).alias("good"))
    needy = materialise(wants.join(good, "query_id", "left").filter(F.coalesce("good", F.lit(0)) < k).drop("good"))
    if needy.isEmpty():
        return _named(best, ix)
    hits = materialise(eligible(questions.join(needy.select("query_id"), "query_id", "left_semi")))
    needy = needy.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left").na.fill(0, ["m"])
    most = needy.agg(F.max("m")).first()[0]
    # The last k + most rows for each wanted pair of year and type; each row is under four such keys.
    either = lambda c: F.explode(F.array_distinct(F.array(F.coalesce(c, F.lit("")), F.lit(""))))
    keyed = ix.rows.select("index", "chunk_type", either("fiscal_year").alias("want_fy")).select("index", "want_fy", either("chunk_type").alias("want_type"))
    last = keyed.join(needy.select("want_fy", "want_type").distinct(), ["want_fy", "want_type"])
    last = last.withColumn("r", F.row_number().over(W.partitionBy("want_fy", "want_type").orderBy(F.col("index").desc()))).filter(F.col("r") <= k + most)
    fill = needy.join(last, ["want_fy", "want_type"]).filter(F.col("r") <= k + F.col("m")).select("query_id", "index", F.lit(0.0).alias("score"))
    fill = fill.join(hits.select("query_id", "index"), ["query_id", "index"], "left_anti")
    filled = top_k(hits.unionByName(fill), k).unionByName(best.join(needy.select("query_id"), "query_id", "left_anti"))
    return _named(materialise(filled), ix)


def _named(ranked: DataFrame, ix: LexicalIndex) -> DataFrame:
    """Written results with the ids of their rows."""
    names = ix.rows.select("index", "chunk_id").join(F.broadcast(ranked.select("index").distinct()), "index", "left_semi")
    return ranked.join(names, "index").select("query_id", "rank", "score", "index", "chunk_id")


__all__ = ["LexicalIndex", "bm25_scores", "bm25_top_k", "lexical_index", "manifest_text", "rank_by"]
