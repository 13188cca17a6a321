"""Hand-computed cases of the order-dependent operators, and the index build."""

import json

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import fusion, rank
from loomspark.plans import build
from loomspark.plans.models import hash_embedder
from loomspark.sources import chunks as S


def ranking(spark, names):
    return spark.createDataFrame([(1, i + 1, 0.0, ord(c), c) for i, c in enumerate(names)], "query_id long, rank long, score double, index long, chunk_id string")


def order(df):
    return "".join(r.chunk_id for r in df.orderBy("rank").collect())


def test_fusion_ties_keep_the_first_list(spark):
    assert order(fusion.rrf(ranking(spark, "abc"), ranking(spark, "baz"))) == "abcz"


def test_nested_fusion(spark):
    inner = fusion.rrf(ranking(spark, "abcd"), ranking(spark, "daxy"))
    assert order(fusion.rrf(inner, ranking(spark, "ydqa"))) == "daybqcx"


def test_edge_reorder(spark):
    for said, want in (("abcde", "aceDb".lower()), ("ab", "ab"), ("a", "a"), ("abc", "acb")):
        assert order(rank.edge_reorder(ranking(spark, said))) == want


def test_deduplicate_compares_with_kept_only(spark):
    w = [f"w{i}" for i in range(40)]
    texts = {"a": w[:20], "b": w[1:21], "c": w[3:23], "d": []}
    chunks = spark.createDataFrame([(k, " ".join(v), None) for k, v in texts.items()], "chunk_id string, text string, text_nl string")
    assert order(rank.deduplicate(ranking(spark, "abcd"), chunks)) == "acd"


def test_permutation(spark):
    r = ranking(spark, "abcd")
    said = spark.createDataFrame([(1, [3, 3, 9, 1])], "query_id long, order array<int>")
    out = rank.apply_permutation(r, said).orderBy("rank").collect()
    assert [(x.chunk_id, x.score) for x in out] == [("c", 4.0), ("a", 3.0), ("b", 0.0), ("d", 0.0)]
    none = spark.createDataFrame([(1, None)], "query_id long, order array<int>")
    assert order(rank.apply_permutation(r, none)) == "abcd"


def test_text_functions(spark):
    row = spark.range(1).select(
        T.keywords(F.lit("EI, MIE rose 4.5% to $1,234.50 in 2023-24, ROE")).alias("k"),
        T.tokens(F.lit("A-b C_d é2!")).alias("t"),
        T.id_prefix(F.lit("20192020_table_0306_0147")).alias("p"),
        T.id_number(F.lit("20192020_table_0306_0147")).alias("n"),
        T.id_prefix(F.lit("abc")).alias("none"),
        T.verdict(F.lit("maybe")).alias("v"),
    ).first()
    assert row.k == "EI MIE ROE , 4.5% $1,234.50 2023 24,"
    assert row.t == ["a", "b", "c_d", "é2"]
    assert (row.p, row.n, row.none, row.v) == ("20192020", 147, None, "NOT_FOUND")


def chunk(i, kind="narrative", **more):
    return {"chunk_id": f"2020_{kind}_0001_{i:04d}", "chunk_type": kind, "text": f"text number {i}", "fiscal_year": "2019-2020", "page_number": 1} | more


def test_build_and_resume(spark, tmp_path):
    src, path = tmp_path / "chunks", str(tmp_path / "index")
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(json.dumps(chunk(i)) for i in range(3)) + "\n" + json.dumps(chunk(9, "footnote")))
    embed = hash_embedder(8)
    one = build.run(spark, str(src), path, embed)
    assert sorted(r["index"] for r in one.collect()) == [0, 1, 2]
    (src / "b.jsonl").write_text("\n".join(json.dumps(chunk(i, "table", table_title="T")) for i in (4, 5)))
    two = {r.chunk_id: r["index"] for r in build.run(spark, str(src), path, embed).collect()}
    assert sorted(two.values()) == [0, 1, 2, 3, 4]
    assert two["2020_narrative_0001_0001"] == 1
    (src / "b.jsonl").write_text("\n".join(json.dumps(chunk(i, "table", text="longer text here now")) for i in (4, 5)))
    three = build.run(spark, str(src), path, embed, tables_only=True).filter("chunk_type = 'table'").collect()
    assert {r.embed_chars for r in three} == {20}
    assert S.load_index(spark, path, "table").count() == 2
    spark.catalog.clearCache()


def test_stream_adds_each_chunk_once(spark, tmp_path):
    from loomspark.streaming.incremental import stream_index

    src, path = tmp_path / "in", str(tmp_path / "index")
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text("\n".join(json.dumps(chunk(i)) for i in range(2 + n)))
        stream_index(spark, str(src), path, str(tmp_path / "check"), hash_embedder(8)).awaitTermination()
    rows = spark.read.parquet(path).collect()
    assert sorted(r["index"] for r in rows) == [0, 1, 2]
    spark.catalog.clearCache()


def test_command_line(spark, tmp_path, capsys):
    from loomspark.cli import main

    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(chunk(i, text=f"apples and {w}")) for i, w in enumerate(["pears", "plums", "figs"])))
    where = ["--chunks", str(tmp_path / "a.jsonl"), "--index", str(tmp_path / "index")]
    main([*where, "build"])
    for mode in ("dense", "bm25", "hybrid"):
        capsys.readouterr()
        main([*where, "search", "plums", "--mode", mode, "--top-k", "2", "--rerank"])
        said = capsys.readouterr().out
        assert "apples and plums" in said.split("2. ")[0]
    spark.catalog.clearCache()
