"""What written tables and joins leave behind, and lists of packed memberships."""

import time

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import near_dedup, suffix_dedup
from loomspark.llm.common import materialise


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    written = materialise(spark.range(5000).repartition(7).groupBy((F.col("id") % 9).alias("k")).count())
    end = time.time() + 10  # files go in the background
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert written.count() == 9


def test_spans_are_not_filtered_by_what_finds_their_texts(spark):
    docs = materialise(spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string"))
    rows = suffix_dedup.keyed(docs).drop("row")
    spans = materialise(rows.select("loom_rid", F.lit(0).alias("s"), F.lit(1).alias("e")))
    some, none = suffix_dedup.with_spans(rows, spans)
    assert (some.count(), none.count()) == (20, 0)
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan


def test_lists_bring_together_what_shares_enough(spark):
    draw = np.random.default_rng(3)
    low = lambda n: draw.integers(0, 1 << 60, n)
    base, sets = np.unique(low(300)), []
    for i in range(60):
        pick = base if i % 3 else np.unique(low(300))
        sets.append(np.sort(np.unique(np.concatenate([pick[draw.random(len(pick)) > i / 300], low(i)]))))
    sets += [s[:40] for s in sets[:6]] + [s[1:40] for s in sets[:6]]
    rows = [(i, len(s), [int(x) for x in s[: near_dedup.K]], i) for i, s in enumerate(sets)]
    reps = near_dedup.named_sets(spark.createDataFrame(rows, "hid long, n int, sk array<long>, doc_id long"))
    got = reps.select("nid", "hid").collect()
    assert len({r.nid for r in got}) == len(sets) and max(r.nid for r in got) < 1 << 12
    name = {r.nid: r.hid for r in got}
    lists: dict[int, set] = {}
    need = {}
    for r in near_dedup.prefix_lists(reps, 80, 100).collect():
        lists.setdefault(name[r.nid], set()).add(r.v)
        need[name[r.nid]] = r.need
    met = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x, y = a[: near_dedup.K], b[: near_dedup.K]
            small = max(len(a), len(b)) < 100
            least = -(-max(len(a), len(b)) * 80 // 100) if small else near_dedup.least_shared(0.8)
            if len(np.intersect1d(x, y)) >= least and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                met += 1
                assert len(lists[i] & lists[j]) >= max(need[i], need[j]), (i, j)
    assert met > 100
