"""Every catalogued query against its DuckDB form, over the whole test tables."""

import pytest

from conftest import SF
from loomspark.plans.catalogue import QUERIES
from loomspark.plans.oracles import ORACLES

#: The slowest; the driver compares them at the same size.
SLOW = {"stage3_pipeline", "hyde_pipeline", "ask_sources"}


def plain(rows):
    clean = [tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(clean, key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in SLOW])
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert plain(got) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
    spark.catalog.clearCache()


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("all_abstain", [False, True])
def test_escalation(spark, all_abstain):
    """Nobody abstains: no third stage.  All abstain: all are in it and keep their first results."""
    from loomspark.plans import catalogue
    from loomspark.plans.models import NO_ANSWER, stand_ins
    from loomspark.plans.pipeline import Corpus, ask

    small = SF.replace("0.01", "0.001")
    c = catalogue.corpus(spark, small)
    stub = stand_ins(yes=2.0, near=2.0 if all_abstain else 0.0)
    index = c.index.withColumn("embedding", stub.embed(c.index.embed_text))
    rows = [(1, "Heat of the ed", None, False, None), (2, "  ", None, True, None), (3, "Than ess", None, True, "data:image/png;base64,AAAA")]
    requests = spark.createDataFrame(rows, "query_id long, question string, fiscal_year string, power_search boolean, image string")
    answers, sources = ask(stub, Corpus(index, c.chunks, c.lexical), requests)
    got = {r.query_id: r for r in answers.collect()}
    assert got[2].error == "No question provided" and got[2].answer is None
    assert [got[i].search_stage for i in (1, 3)] == ([3, 3] if all_abstain else [1, 2])
    assert all(got[i].abstained == all_abstain and (got[i].answer == NO_ANSWER) == all_abstain for i in (1, 3))
    shown = sources.groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in shown} == {1: 5, 3: 10}


def test_models_are_loaded_once_a_worker(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from loomspark.plans.providers import pair_scorer, text_embedder

    def load():
        def run(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return np.array([[len(t), 1.0] for t in texts])

        return run

    rows = spark.createDataFrame([(0, "abc"), (1, None), (2, "bad"), (3, "abcdefgh")], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in rows.select("i", text_embedder("t", load)(F.col("t")).alias("v")).collect()}
    assert got[1] is None and got[2] is None and abs(sum(x * x for x in got[3]) - 1) < 1e-6 and abs(got[0][0] / got[0][1] - 3) < 1e-5
    score = pair_scorer("p", lambda: lambda q, t: np.array([[len(a), len(b)] for a, b in zip(q, t)]))
    assert [round(r.p, 3) for r in rows.filter("i = 0").select(score(F.lit("abc"), F.col("t")).alias("p")).collect()] == [0.5]
