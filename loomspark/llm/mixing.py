"""Mix sources to target weights by Pareto order sampling.

Targets: sources share the budget by weight; a target stops at ``max_repeats`` times its
source's size and the excess is shared again by weight (water filling).  Every document of
a source is taken target / source size times, rounded down: these whole copies are
certain.  The source's remaining words are a fixed-size sample (fixed in words) of unequal
probabilities: longer documents are wanted more.  The words are shared, by water filling
again, among classes of documents of like size (powers of two), by the class's words times
the power ``TASTE`` of its size, up to one copy; a document's inclusion probability is its
class's share.  Documents are ranked by their random odds divided by their inclusion odds
and taken in that order until the words are reached; near that edge a document is taken if
it still fits.  Only whole copies are taken; a source misses its target by fewer words than
the next documents in order have.

The edge is found from sums over ``BINS`` bins of the rank, so that only the documents of
one bin of a source, and of the next bins up to ``FIT`` documents, ever meet in one task.
Sources and size classes, a row for each, are tables of a few rows.

Edge cases: a null source is a source of its own, last in order; null text has size 0;
documents of size 0 take nothing; repeated rows are ranked alike and each counts; an empty
table gives no rows; further columns are not looked at.  Random numbers come from hashes of
id and text: reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, materialise, scratch, sent, stable_fraction

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 14
#: Power of a document's size by which it is wanted more often.
TASTE = 0.125
#: Documents after the edge's bin that may fill up what is left.
FIT = 256


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(rows: DataFrame, total: Column, of: list[str], tie: Column) -> DataFrame:
    """``rows`` (w, cap) with ``share``: ``total``, the same in all rows of a group ``of``,
    is shared by weight; a share stops at its cap and the excess is shared again."""
    by = W.partitionBy(*of).orderBy("ratio", tie)
    everything, before = W.partitionBy(*of), by.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("ratio", F.coalesce(F.try_divide("cap", "w"), F.lit(0.0))).withColumn("rn", F.row_number().over(by))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", F.coalesce(F.try_divide(left, weight), F.lit(0.0)))
    # The first row whose cap is not below the level that is left decides the level of all later ones.
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("rn", "level"))).over(everything)
    share = F.when(first.isNull() | (F.col("rn") < first["rn"]), F.col("cap")).otherwise(F.least("cap", F.col("w") * first["level"]))
    return rows.withColumn("share", F.greatest(share, F.lit(0.0))).drop("ratio", "rn", "level")


def source_targets(classes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: float = 3.0) -> DataFrame:
    """skey, source_size, target: one row for each source (a small table)."""
    per = classes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(cycle, (place % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(max_repeats))
    everything = F.sum("source_size").over(W.partitionBy()).cast("double")
    return water_fill(per, everything, [], F.col("source").asc_nulls_last()).select("skey", "source_size", F.col("share").alias("target"))


def class_copies(classes: DataFrame, goal: DataFrame) -> DataFrame:
    """skey, class, source_size, target, whole (certain copies), p (inclusion probability of one more), rest (words of the source's sample)."""
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate + F.lit(1e-9)).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.round("target").cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
    per = classes.join(goal, "skey").withColumn("w", F.col("words") * F.pow(F.lit(2.0), F.col("class") * TASTE)).withColumn("cap", F.col("words").cast("double"))
    per = water_fill(per, F.col("rest").cast("double"), ["skey"], F.col("class"))
    p = F.least(F.coalesce(F.try_divide("share", "words"), F.lit(0.0)), F.lit(1.0))
    return per.select("skey", "class", "source_size", "target", "whole", p.alias("p"), "rest")


def sample_edges(bins: DataFrame) -> DataFrame:
    """skey, cut, before, last: the bin in which a source's sample ends, the words before it,
    and the last of the bins whose documents may fill up the rest."""
    order = W.partitionBy("skey").orderBy("bin")
    upto = bins.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("seen", F.sum("docs").over(order))
    cut = upto.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))).groupBy("skey").agg(F.min(F.struct("bin", "before", "seen")).alias("c"))
    near = upto.join(cut, "skey").filter((F.col("bin") >= F.col("c.bin")) & ((F.col("bin") == F.col("c.bin")) | (F.col("seen") - F.col("c.seen") <= FIT)))
    return near.groupBy("skey").agg(F.first("c.bin").alias("cut"), F.first("c.before").alias("before"), F.max("bin").alias("last"))


def _fit(rows: pd.DataFrame, more: list[str]) -> pd.DataFrame:
    """In order, what still fits into the words that are left."""
    rows = rows.sort_values(["q", "doc_id", "size"], kind="stable")
    left, taken = int(rows["rest"].iloc[0] - rows["before"].iloc[0]), []
    for size in rows["size"]:
        taken.append(int(size) if size <= left else 0)
        left -= taken[-1]
    return rows.assign(taken=rows["whole"] * rows["size"] + taken)[["doc_id", "size", "source_size", "target", "taken", *more]]


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), max_repeats: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``, as a written table."""
    with scratch():
        return materialise(_mixed(docs, word_count() if size is None else size, weights, max_repeats, seed), keep=True)


def _numbers(size: Column, seed: int) -> list[Column]:
    """What the mix asks of a document."""
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    u = stable_fraction(F.lit(seed), F.col("doc_id"), F.col("text"))
    return [F.col("doc_id").cast("long").alias("doc_id"), "source", skey.alias("skey"), size.alias("size"), F.floor(F.log2(size + 1)).cast("int").alias("class"), u.alias("u")]


def _ranked(rows: DataFrame, goal: DataFrame) -> DataFrame:
    # Odds ratio q, kept as q / (1 + q) in (0, 1); the sample's edge lies near a half.
    u, p = F.col("u"), F.col("p")
    q = F.when(p > 0, F.try_divide(u * (1 - p), u * (1 - p) + p * (1 - u)))
    ranked = rows.drop("source").join(sent(goal), ["skey", "class"]).withColumn("q", q)
    return ranked.withColumn("bin", F.when(F.col("size") > 0, F.least(F.floor(F.col("q") * BINS), F.lit(BINS - 1)).cast("int")))


def _placed(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """``near`` the edge or not, and if not, whether one ``more`` copy is taken."""
    rows = ranked.join(sent(edges), "skey", "left")
    near = F.coalesce(F.col("bin").between(F.col("cut"), F.col("last")), F.lit(False))
    # Without an edge all that may be sampled fits.
    more = F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    return rows.withColumn("near", near).withColumn("more", F.coalesce(more, F.lit(False)).cast("int"))


def _tables(sizes: DataFrame, weights: tuple[float, ...], max_repeats: float) -> tuple[DataFrame, DataFrame]:
    """(copies by source and class, edges by source): small written tables."""
    classes = materialise(sizes.groupBy("skey", "class").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    goal = materialise(class_copies(classes, source_targets(classes, weights, max_repeats)))
    bins = _ranked(sizes, goal).filter("bin is not null").groupBy("skey", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.first("rest").alias("rest"))
    return goal, materialise(sample_edges(bins))


def _fitted(placed: DataFrame, *more: str) -> DataFrame:
    kinds = "doc_id long, size long, source_size long, target double, taken long"
    edge = placed.filter("near").select("skey", "doc_id", "size", "source_size", "target", "whole", "rest", "before", "q", *[c for c in more if c != "skey"])
    return edge.groupBy("skey").applyInPandas(lambda rows: _fit(rows, list(more)), kinds + "".join(f", {c} {edge.schema[c].dataType.simpleString()}" for c in more))


def _mixed(docs: DataFrame, size: Column, weights: tuple[float, ...], max_repeats: float, seed: int) -> DataFrame:
    sizes = materialise(docs.select(*_numbers(size, seed)))
    goal, edges = _tables(sizes, weights, max_repeats)
    placed = _placed(_ranked(sizes, goal), edges)
    far = placed.filter("not near").select("doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("more")) * F.col("size")).cast("long").alias("taken"))
    return far.unionByName(_fitted(placed))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_sources` takes it.

    Texts are not shuffled: a row's copies follow from its own numbers and small tables of
    sources and of documents near an edge.  A row of size 0 weighs nothing and is kept once;
    of equal rows near an edge each gets their mean, rounded.  All columns stay, whatever
    their names; without rows there are none.
    """
    numbers = _numbers(word_count(), seed)
    sizes = materialise(docs.select(*numbers))
    goal, edges = _tables(sizes, weights, max_repeats)
    fits = _fitted(_placed(_ranked(sizes, goal), edges), "skey", "u").groupBy("skey", "u").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("fit"))
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *numbers)
    placed = _placed(_ranked(wide, goal), edges).join(sent(materialise(fits)), ["skey", "u"], "left")
    times = F.when(F.col("size") == 0, F.lit(1)).when(F.col("near"), F.coalesce("fit", F.lit(0))).otherwise((F.col("whole") + F.col("more")).cast("int"))
    return placed.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as taken / size says.

    A document of size 0 weighs nothing and is kept once.  Rows with the same id get the
    same number of copies (the mean of theirs, rounded).  All columns of ``docs`` stay,
    whatever their names; without rows there are none.
    """
    own, times, copy = (fresh(docs, c) for c in ("loom_id", "loom_copies", "loom_copy"))
    copies = mixed.groupBy("doc_id").agg(F.when(F.sum("size") > 0, F.round(F.sum("taken") / F.sum("size"))).otherwise(F.lit(1)).cast("int").alias(times))
    kept = docs.join(copies.filter(F.col(times) > 0).withColumnRenamed("doc_id", own), F.col("doc_id").eqNullSafe(F.col(own)))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[c] for c in docs.columns])
