"""What a search stores, and chunks whose ids repeat."""

from pyspark.sql import functions as F

from conftest import SF
from loomspark.operators import context, rank
from loomspark.operators.lexical import bm25_scores, bm25_top_k, lexical_index, manifest_text
from loomspark.plans import catalogue

SMALL = SF.replace("0.01", "0.001")


def twins(spark):
    """Two chunks of one id, one more; the index has a row for each."""
    cols = "ord long, chunk_id string, chunk_type string, fiscal_year string, text string, text_nl string, section_breadcrumb string, page int, table_title string"
    rows = [(0, "a", "narrative", "y", "red plums", None, "", 1, None), (1, "a", "narrative", "z", "green pears and figs", None, "", 1, None), (2, "b", "narrative", "z", "green pears and figs too", None, "", 1, None)]
    chunks = spark.createDataFrame(rows, cols)
    return chunks, chunks.select(F.col("ord").alias("index"), "ord", "chunk_id", "chunk_type", "fiscal_year", "section_breadcrumb", "page", "table_title")


def test_index_is_stored_without_texts_and_keywords_only_once_searched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "shared_dir", lambda spark: str(tmp_path))
    assert catalogue.QUERIES["dense_topk"](spark, SMALL).count()
    found = next(tmp_path.glob("loomspark-index-*"))
    assert [p.name for p in found.iterdir()] == ["index"]
    assert "embed_text" not in spark.read.parquet(str(found / "index")).columns


def test_a_row_has_its_own_text_where_ids_repeat(spark, tmp_path):
    chunks, index = twins(spark)
    rows = manifest_text(index, chunks).select("index", "lexical").collect()
    assert sorted(map(tuple, rows)) == [(0, "red plums"), (1, "green pears and figs"), (2, "green pears and figs too")]
    ix = lexical_index(spark, lambda: manifest_text(index, chunks), str(tmp_path / "x"))
    asked = spark.createDataFrame([(1, "plums"), (2, "green figs")], "query_id long, question string")
    assert sorted((r.query_id, r["index"]) for r in bm25_scores(ix, asked).collect()) == [(1, 0), (2, 1), (2, 2)]
    best = bm25_top_k(ix, asked, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["index"]) for r in best] == [(1, 0), (1, 2), (1, 1), (2, 0), (2, 2), (2, 1)]  # common tokens count below 0
    results = spark.createDataFrame([(1, 1, 0.5, 1, "a"), (1, 2, 0.4, 2, "b")], "query_id long, rank long, score double, index long, chunk_id string")
    shown = context.described(results, index, chunks).orderBy("rank").collect()
    assert [r.body for r in shown] == ["green pears and figs", "green pears and figs too"]
    pairs = rank.rerank(results, spark.createDataFrame([(1, "x")], "query_id long, question string"), chunks.withColumn("section_breadcrumb", F.lit("s")), lambda q, d: F.length(d).cast("double"))
    assert [r.chunk_id for r in pairs.orderBy("rank").collect()] == ["b", "a", "a"]


def test_deduplicate_gives_a_repeated_id_once_for_each_chunk(spark):
    chunks, _ = twins(spark)
    results = spark.createDataFrame([(1, 1, 0.5, 0, "a"), (1, 2, 0.4, 2, "b")], "query_id long, rank long, score double, index long, chunk_id string")
    assert [r.chunk_id for r in rank.deduplicate(results, chunks, 0.8).orderBy("rank").collect()] == ["a", "a"]
    assert [r.chunk_id for r in rank.deduplicate(results, chunks, 0.9).orderBy("rank").collect()] == ["a", "a", "b"]


def test_deduplicate_by_signatures_loses_nothing(spark):
    import random

    draw = random.Random(5)
    base = [[f"w{draw.randrange(400)}" for _ in range(n)] for n in (3, 30, 120, 900)]
    texts = [[w if draw.random() > rate else f"x{draw.randrange(9)}" for w in b] for b in base for rate in (0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.3)]
    draw.shuffle(texts)
    sets, kept = [set(t) for t in texts], []
    for i, s in enumerate(sets):
        if not any(len(s & sets[j]) / len(s | sets[j]) >= rank.THRESHOLD for j in kept):
            kept.append(i)
    chunks = spark.createDataFrame([(f"c{i}", " ".join(t), None) for i, t in enumerate(texts)], "chunk_id string, text string, text_nl string")
    results = spark.createDataFrame([(1, i + 1, 0.5, i, f"c{i}") for i in range(len(texts))], "query_id long, rank long, score double, index long, chunk_id string")
    assert 4 < len(kept) < len(texts)
    assert [r["index"] for r in rank.deduplicate(results, chunks).orderBy("rank").collect()] == kept
    row = rank.deduplicate(results, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in row


def test_common_terms_weigh_the_same_in_whatever_order_terms_come(spark, tmp_path):
    """Terms of more than half of the rows get a share of the mean of all weights: the exact mean."""
    import math

    from loomspark.operators.lexical import EPSILON

    n = 600
    rows = [(i, f"c{i}", "narrative", "y", "common " + " ".join(f"w{j}" for j in range(3000) if i % (j % 97 + 2) == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "index long, chunk_id string, chunk_type string, fiscal_year string, lexical string")
    terms = {r.term: r for r in lexical_index(spark, lambda: df, str(tmp_path / "m")).terms.collect()}
    raw = [math.log(n - r.df + 0.5) - math.log(r.df + 0.5) for r in terms.values()]
    assert abs(terms["common"].idf - EPSILON * math.fsum(raw) / len(raw)) <= 2 * math.ulp(terms["common"].idf)


def test_postings_travel_packed(spark, tmp_path, monkeypatch):
    """What is dealt to buckets is a row for each text and bucket, not for each word; counts are kept."""
    from collections import Counter

    from loomspark.operators import lexical

    plans = []
    monkeypatch.setattr(lexical, "stored", lambda s, path, build, *by, f=lexical.stored: f(s, path, lambda: plans.append(df := build()) or df, *by))
    words = [f"w{i % (7 + i % 13)}" for i in range(500)]
    texts = [" ".join(words[k:] + words[:3]) for k in (0, 100, 250)] + ["", "é_9 É_9 x"]
    df = spark.createDataFrame([(i, f"c{i}", "narrative", "y", t) for i, t in enumerate(texts)], "index long, chunk_id string, chunk_type string, fiscal_year string, lexical string")
    ix = lexical_index(spark, lambda: df, str(tmp_path / "p"), 4)
    want = {(t, i): (n, len(text.split())) for i, text in enumerate(x.lower() for x in texts) for t, n in Counter(text.split()).items()}
    assert {(r.term, r["index"]): (r.tf, r.dl) for r in ix.postings.collect()} == want
    dealt = next(p for p in plans if "tf" in p.columns)
    assert "RepartitionByExpression" in dealt._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[1]
