"""Composite retrieval and the staged answer pipeline, over batches of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import image_parts, query_text, verdict
from ..functions.text import keywords as keyword_fallback
from ..operators.context import described, faithfulness_context, metadata, reduce_context, source_rows
from ..operators.dense import dense_top_k
from ..operators.expand import collect_context, expansion, full_page
from ..operators.fusion import first_k, multi_query, rrf
from ..operators.lexical import LexicalIndex, bm25_top_k, lexical_index, manifest_text
from ..operators.rank import deduplicate, edge_reorder, rerank
from ..sources.store import materialise
from .models import ABSTAIN, NO_ANSWER, Models

RELEVANT = ("YES", "NEED_ADJACENT")


@dataclass
class Corpus:
    """A built index with its chunk store (with ``ord``) and keyword index."""

    index: DataFrame
    chunks: DataFrame
    keyword_index: LexicalIndex | Callable[[], LexicalIndex]

    @classmethod
    def of(cls, index: DataFrame, chunks: DataFrame, path: str) -> Corpus:
        """``path``: where the keyword index is stored (see :func:`lexical_index`) once a search wants it."""
        return cls(index, chunks, lambda: lexical_index(index.sparkSession, lambda: manifest_text(index, chunks), path))

    @property
    def lexical(self) -> LexicalIndex:
        if callable(self.keyword_index):
            self.keyword_index = self.keyword_index()
        return self.keyword_index


def hyde(corpus: Corpus, questions: DataFrame, k: int) -> DataFrame:
    """Question and hypothetical answer (``hvec``) together: the first two rankings are fused,
    then the third with that; deduplicated, cut to k, best results to both ends."""
    pool = max(4 * k, 50)
    base = rrf(dense_top_k(corpus.index, questions, pool), bm25_top_k(corpus.lexical, questions, pool))
    guess = dense_top_k(corpus.index, questions.withColumn("qvec", F.col("hvec")), pool)
    return edge_reorder(first_k(deduplicate(rrf(base, guess), corpus.chunks), k))


def stage3(corpus: Corpus, questions: DataFrame, k: int = 10) -> DataFrame:
    """The widest search: HyDE over the pool, keywords (``keywords``), and, where a fiscal
    year was asked for, half a pool without that filter; nested fusion in this order.

    HyDE's results enter by their places after the reorder.  Types are not filtered.
    """
    pool = max(4 * k, 50)
    asked = questions.drop("want_type") if "want_type" in questions.columns else questions
    found = rrf(hyde(corpus, asked, pool), bm25_top_k(corpus.lexical, asked, pool, "keywords"))
    if "want_fy" in asked.columns:
        free = asked.filter("want_fy is not null and want_fy != ''").drop("want_fy")
        found = rrf(found, dense_top_k(corpus.index, free, pool // 2))
    return first_k(deduplicate(found, corpus.chunks), k)


def with_pages(results: DataFrame, corpus: Corpus) -> DataFrame:
    """Results of the widest search with ``context``: the other chunks of their pages, in order."""
    pages = collect_context(full_page(results, corpus.chunks))
    none = F.array().cast("array<string>")
    return results.join(pages, ["query_id", "rank"], "left").withColumn("context", F.coalesce("context", none))


def keyword_text(models: Models, question: Column) -> Column:
    """A model's list of terms, else acronyms and numbers, else the question."""
    said = F.array_join(F.from_json(models.keywords(question), "array<string>"), " ")
    return F.coalesce(F.nullif(said, F.lit("")), keyword_fallback(question))


def query_variants(models: Models, questions: DataFrame, n: int = 3) -> DataFrame:
    """query_id, variant, question: the question, then a model's first n other wordings less
    blanks and copies of the question."""
    image = F.col("image") if "image" in questions.columns else F.lit(None).cast("string")
    said = F.coalesce(F.from_json(models.variants(F.col("question"), image_parts(image)), "array<string>"), F.array().cast("array<string>"))
    rest = F.filter(F.slice(said, 1, n), lambda x: x.isNotNull() & (F.trim(x) != "") & (F.trim(x) != F.col("question")))
    cols = [c for c in ("want_fy",) if c in questions.columns]
    return questions.select("query_id", *cols, F.posexplode(F.concat(F.array("question"), rest)).alias("variant", "question"))


def verdicts(models: Models, corpus: Corpus, questions: DataFrame, results: DataFrame) -> DataFrame:
    """Results described, with ``metadata`` and the model's ``signal``; no reply is NOT_FOUND."""
    rows = described(results, corpus.index, corpus.chunks).join(questions.select("query_id", "question"), "query_id")
    rows = rows.withColumn("metadata", metadata())
    return rows.withColumn("signal", verdict(models.verdict(F.col("question"), F.col("metadata"), F.col("body"))))


def answer(models: Models, corpus: Corpus, questions: DataFrame, judged: DataFrame, radius: int) -> DataFrame:
    """One row for each question: answer, abstained, faithful, issues, clarification.

    ``judged`` is from :func:`verdicts`.  A question without relevant results abstains; a
    failing answer model gives an error text and does not abstain.
    """
    relevant = judged.filter(F.col("signal").isin(*RELEVANT))
    context = reduce_context(relevant, expansion(relevant.select("query_id", "rank", "chunk_id", "signal"), corpus.chunks, radius), corpus.chunks)
    image = F.col("image") if "image" in questions.columns else F.lit(None).cast("string")
    asked = questions.select("query_id", "question", image.alias("image")).join(context, "query_id", "left")
    reply = models.answer(F.col("question"), F.coalesce("context", F.lit("")), image_parts(F.col("image")))
    said = materialise(asked.withColumn("said", F.when(F.col("context").isNotNull(), F.trim(reply))))  # a model's replies are had once
    nothing, failed = F.col("context").isNull(), F.col("said").isNull()
    out = said.withColumn("abstained", nothing | F.coalesce(F.col("said").contains(ABSTAIN), F.lit(False)))
    out = out.withColumn("answer", F.when(F.col("abstained"), F.lit(NO_ANSWER)).when(failed, F.lit("Generation error: the model gave no reply")).otherwise(F.col("said")))
    out = out.withColumn("real", ~F.col("abstained") & ~failed)
    seen = faithfulness_context(judged, 4000).withColumnRenamed("context", "seen")
    out = out.join(seen, "query_id", "left")
    f = F.from_json(models.faithful(F.col("question"), F.col("answer"), F.coalesce("seen", F.lit(""))), "faithful boolean, issues string")
    c = F.from_json(models.clarify(F.col("question"), F.col("answer")), "needed boolean, question string")
    out = out.withColumn("f", F.when(F.col("real"), f)).withColumn("c", F.when(F.col("real"), c))
    return out.select(
        "query_id",
        "question",
        "answer",
        "abstained",
        F.col("f.faithful").alias("faithful"),
        F.col("f.issues").alias("faithfulness_issues"),
        F.coalesce("c.needed", F.lit(False)).alias("clarification_needed"),
        F.when(F.col("c.needed"), F.col("c.question")).alias("clarification_question"),
    )


def detected_filters(models: Models, question: Column) -> Column:
    """A model's map of filters without blank ones; empty if it gives none."""
    said = F.from_json(models.filters(question), "map<string,string>")
    return F.coalesce(F.map_filter(said, lambda k, v: v.isNotNull() & (v != "")), F.create_map().cast("map<string,string>"))


def ask(models: Models, corpus: Corpus, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses, sources) for requests (query_id, question, fiscal_year, power_search, image).

    All questions run as one batch.  Those that abstain run again, as a second batch,
    through the widest search, and its outcome is taken where it does not abstain.
    A blank question gives an error row and no sources.  Each step's outcome is a written
    table, so plans stay short and no model is asked twice.
    """
    if "image" not in requests.columns:
        requests = requests.withColumn("image", F.lit(None).cast("string"))
    trimmed = requests.withColumn("question", F.trim(F.coalesce("question", F.lit(""))))
    bad = trimmed.filter("question = ''").select("query_id", F.lit("No question provided").alias("error"))
    q = trimmed.filter("question != ''").withColumn("filters", detected_filters(models, F.col("question")))
    q = materialise(q.withColumn("want_fy", F.coalesce(F.nullif("fiscal_year", F.lit("")), F.col("filters")["fiscal_year"])))
    answers, judged = None, None
    for power, k, radius in ((False, 5, 1), (True, 10, 3)):
        part = q.filter(F.coalesce("power_search", F.lit(False)) == power)
        variants = materialise(query_variants(models, part).withColumn("qvec", models.embed(query_text(F.col("question")))))
        order = lambda rows, asked: rerank(rows, asked, corpus.chunks, models.pair_score)
        found = materialise(multi_query(corpus.index, corpus.lexical, variants, k, order))
        j = materialise(verdicts(models, corpus, part, found))
        a = materialise(answer(models, corpus, part, j, radius).withColumn("search_stage", F.lit(2 if power else 1)))
        answers = a if answers is None else answers.unionByName(a)
        judged = j if judged is None else judged.unionByName(j)
    again = q.join(answers.filter("abstained").select("query_id"), "query_id", "left_semi")
    if not again.isEmpty():
        answers, judged = _escalated(models, corpus, again, answers, judged)
    sources = source_rows(judged.drop("signal"), judged)
    responses = answers.join(q.select("query_id", F.col("filters").alias("filters_detected")), "query_id").withColumn("error", F.lit(None).cast("string"))
    return responses.unionByName(bad, allowMissingColumns=True), sources


def _escalated(models: Models, corpus: Corpus, again: DataFrame, answers: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, judged) after the widest search for the questions ``again``, which abstained."""
    asked = again.withColumn("qvec", models.embed(query_text(F.col("question")))).withColumn("hvec", models.embed(F.coalesce(models.hypothetical(F.col("question")), F.col("question"))))
    asked = materialise(asked.withColumn("keywords", keyword_text(models, F.col("question"))))
    deep = materialise(deduplicate(stage3(corpus, asked, 10), corpus.chunks))
    deep_judged = materialise(verdicts(models, corpus, asked, deep))
    deep_answers = materialise(answer(models, corpus, asked, deep_judged, 3).withColumn("search_stage", F.lit(3)))
    taken = deep_answers.filter("not abstained").select("query_id")
    stays = answers.join(taken, "query_id", "left_anti").withColumn("search_stage", F.when(F.col("abstained"), F.lit(3)).otherwise(F.col("search_stage")))
    rows = judged.join(taken, "query_id", "left_anti").unionByName(deep_judged.join(taken, "query_id", "left_semi"))
    return stays.unionByName(deep_answers.join(taken, "query_id", "left_semi")), rows


__all__ = ["Corpus", "ask", "answer", "hyde", "keyword_text", "query_variants", "stage3", "verdicts", "with_pages"]
