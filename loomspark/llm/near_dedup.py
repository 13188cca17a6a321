"""Near-duplicate groups from bottom-k sketches of one hash function.

Each distinct shingle set keeps the ``K`` smallest of its 64-bit shingle hashes.  Sets of
similarity num/den share at least ``least_shared`` of these but for a chance below ``RISK``
a pair (at 0.8, 79 of 128).  Inverted lists of retained values generate the overlaps.  By
the prefix principle two such sets meet in ``MEET`` lists or more even if a set enters only
the lists of its K - least + MEET rarest values, so values that many documents share link
nothing by themselves.  Small sets are whole in their sketch and get the exact prefix.

Every list takes as its centre the member that is in most lists, so that the many lists of
one family of near copies have the same centre, and the lists of a centre make one group.
Two sets that are alike share a list and so a group.  No pairs are made: groups are compared
in cells of bounded size (``cells``), in two rounds.

1. The centre of each group meets the members that share ``MEET`` of its lists (small sets fewer).  This joins
   large families of near copies.
2. Groups whose members are all in one component are done.  In the others each member
   outside the largest component meets all members of another component; a cell first
   holds the lists that its members are in, and those go on that share ``MEET`` with another.

In both rounds cells then hold sketches, of each value the upper half: the union sketch estimates each meeting's
similarity, and only members with a likely partner go on.  Last the cells hold whole sets
and exact Jaccard confirms; out come the links that connect what is alike.  Equal sets are
one set throughout; their documents are joined to it at the end.

Edge cases: null text or no words: an empty set, linked with nothing; repeated rows and
ids are each returned; a set that only rows without id have is linked with nothing but its
equals; ties between centres go to the greater name; texts of any length are whole; an
empty table gives no rows; further columns of ``docs`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells
from .common import blocks, column_bytes, fresh, materialise, mix, only, scratch, shingles, word_hashes
from .components import components

K = 128
#: Lists in which a pair of large sets must meet; the more, the fewer sets meet by chance.
MEET = 8
#: Rounds of closing lists; the result does not depend on it.
PRUNE = 2
#: Chance that a pair shares fewer retained values than it must.
RISK = 1e-7


def least_shared(share: float, k: int = K, risk: float = RISK) -> int:
    """Most values that two sketches share but for ``risk`` if ``share`` of the union is common."""
    tail = 0.0
    for s in range(k + 1):
        tail += comb(k, s) * share**s * (1 - share) ** (k - s)
        if tail > risk:
            return max(s, 1)
    return k


def _sets(batch: pa.RecordBatch, width: int, lower: bool) -> Iterator[np.ndarray]:
    raw, offs = column_bytes(batch.column("text"))
    for lo, hi, buf, at in blocks(raw, offs):
        h, doc = word_hashes(buf, at, lower)
        yield from shingles(h, doc, hi - lo, width)


def _set_id(s: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64).item()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offs[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


def sketch_documents(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """doc_id, n (set size), hid (hash of the set), sk (its bottom-k sketch) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_sets(b, width, lower))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([_set_id(s) for s in sets], pa.int64()), _lists([s[:K] for s in sets])], ["doc_id", "n", "hid", "sk"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, hid long, sk array<long>")


def named_sets(rows: DataFrame) -> DataFrame:
    """nid, hid, id (least doc_id), n, sk of every distinct set that is not empty, in a written table.

    ``nid`` names the set from here on: a small number, of which fewer bytes are shuffled.
    """
    sets = rows.filter("n > 0").groupBy("hid").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sk").alias("sk"))
    sets = materialise(sets.withColumn("at", F.monotonically_increasing_id()), keep=True)
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    bits = (sets.agg(F.max(place)).first()[0] or 0).bit_length()
    return sets.select(F.shiftleft(F.shiftright("at", 33), bits).bitwiseOR(place).alias("nid"), "hid", "id", "n", "sk")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int, lower: bool) -> DataFrame:
    """nid, els for the sets named by ``wanted`` (doc_id, nid, hid: one document for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_sets(b, width, lower))
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), _lists(sets)], ["hid", "els"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = only(rows, wanted.select("doc_id").distinct(), "doc_id")
    sets = rows.select("text").mapInArrow(run, "hid long, els array<long>")
    # An id that stands in several rows may bring sets that nobody wants, or one set twice.
    return sets.join(wanted.select("nid", "hid"), "hid").dropDuplicates(["hid"]).select("nid", "els")


#: Retained values that one part holds, and the least number of parts (rows of some kB: Arrow takes 2,000 at a time).
PART, PARTS = 1 << 19, 1 << 11
#: Bytes of a retained value, its upper ones, that name its list; values that they do not tell apart share one.
VALUE = 6

_PACKED = "part int, least binary, nid binary, v binary"


def packed(part: np.ndarray, *columns: tuple[np.ndarray, int]) -> list[pa.Array]:
    """A row for each number in ``part``: that, and its entries of each column in as many bytes as are given."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    out = [pa.array(part[first].astype(np.int32))]
    for x, width in columns:
        raw = x[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        ends = (np.append(first, len(part)) * width).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]))
    return out


def unpacked(batches: Iterator[pa.RecordBatch], *widths: int) -> Iterator[list[np.ndarray]]:
    """The columns of each part; ``batches`` have packed rows in order of ``part``."""
    held: list[list[bytes]] = [[] for _ in widths]
    last = None

    def whole() -> list[np.ndarray]:
        out = []
        for rows, width in zip(held, widths):
            raw = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
            x = np.zeros((len(raw), 8), np.uint8)
            x[:, :width] = raw
            out.append(x.view("<u8").ravel())
            rows.clear()
        return out

    for b in batches:
        for part, *row in zip(b.column(0).to_pylist(), *(b.column(i + 1) for i in range(len(widths)))):
            if part != last and held[0]:
                yield whole()
            last = part
            for rows, x in zip(held, row):
                rows.append(x.as_py())
    if held[0]:
        yield whole()


def prefix_lists(reps: DataFrame, num: int, den: int) -> DataFrame:
    """v, nid, need: membership of sets in the inverted lists that can generate a link.

    A set shares ``need`` lists or more with all that it is alike (see :func:`meetings_needed`).
    Sets so small that no different set can be alike enough are in none.  Memberships travel
    packed: to the part of their value, which counts its members, and, if it has several, to
    the part of their set, which ranks them.
    """
    able = reps.filter(F.col("n") * (den - num) >= num).select("nid", "n", "sk")
    top, values = able.agg(F.max("nid"), F.sum(F.least(F.col("n"), F.lit(K)))).first()
    wide = max(1, -(-(top or 0).bit_length() // 8))
    parts = np.uint64(max(PARTS, 1 << ((values or 0) // PART).bit_length()) - 1)
    exact = least_shared(num / den)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk, n = b.column("sk"), b.column("n").to_numpy().astype(np.int64)
            v = sk.flatten().to_numpy().view(np.uint64) >> np.uint64(64 - 8 * VALUE)
            owner = np.repeat(np.arange(len(n)), sk.value_lengths().to_numpy())
            # A partner of a set below K * num / den is whole in its sketch too.
            least = np.where(n * den < K * num, -(-n * num // den), exact)
            yield pa.RecordBatch.from_arrays(packed(v & parts, (least[owner], 1), (b.column("nid").to_numpy()[owner], wide), (v, VALUE)), ["part", "least", "nid", "v"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for least, nid, v in unpacked(batches, 1, wide, VALUE):
            _, at, df = np.unique(v, return_inverse=True, return_counts=True)
            df = df[at]
            several = df > 1
            # Eighths of powers of two, which one byte holds: any order will do that is the same for all sets.
            often = (8 * np.log2(df[several])).astype(np.uint64)
            nid = nid[several]
            yield pa.RecordBatch.from_arrays(packed(mix(nid) & parts, (least[several], 1), (nid, wide), (v[several], VALUE), (often, 1)), ["part", "least", "nid", "v", "often"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for least, nid, v, often in unpacked(batches, 1, wide, VALUE, 1):
            order = np.lexsort((v, often, nid))
            least, nid, v = least[order].astype(np.int64), nid[order], v[order]
            first = np.searchsorted(nid, nid, "left")
            # Values of one set alone are the rarest and fill the prefix first: K - least + MEET less their number.
            room = np.searchsorted(nid, nid, "right") - first - least + np.minimum(MEET, least)
            kept = np.arange(len(nid)) - first < room
            need = np.minimum(MEET, -(-least * num // den))[kept].astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(v[kept].view(np.int64)), pa.array(nid[kept].view(np.int64)), pa.array(need)], ["v", "nid", "need"])

    counted = able.mapInArrow(dealt, _PACKED).repartition("part").sortWithinPartitions("part").mapInArrow(shared, f"{_PACKED}, often binary")
    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(rarest, "v long, nid long, need byte")


def meetings_needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Lists that sets of ``n`` shingles share with any that they are alike.

    Sets that must have t values in common with a partner are in the lists of all but the
    last t - MEET of these, so a pair shares as many as the smaller set's min(t, MEET).  The
    smaller set has num/den of the larger one's size or more: its t is a set's own num/den
    at least.
    """
    least = np.where(n * den < K * num, -(-n * num // den), least_shared(num / den))
    return np.minimum(MEET, -(-least * num // den))


def centred(lists: DataFrame) -> DataFrame:
    """``lists`` (v, nid, need) with ``c``, the centre of each list."""
    often = lists.join(lists.groupBy("nid").agg(F.count(F.lit(1)).alias("often")), "nid")
    centre = often.groupBy("v").agg(F.max(F.struct("often", "nid")).alias("o")).select("v", F.col("o.nid").alias("c"))
    return lists.join(centre, "v")


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """v, nid, need, label: members of lists that hold several components, if in ``need`` of them.

    Lists that this leaves with one component are closed in turn, ``PRUNE`` times.
    """
    named = lists.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("v", "nid", "need", F.coalesce("label", "nid").alias("label"))
    for _ in range(PRUNE):
        several = named.groupBy("v").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("v")
        open_ = named.join(several, "v")
        named = materialise(open_.join(open_.groupBy("nid").agg(F.count(F.lit(1)).alias("times"), F.first("need").alias("least")).filter("times >= least").select("nid"), "nid"))
    return named


def outsiders(found: DataFrame) -> DataFrame:
    """``found`` (c, nid, label) of groups with several labels; those outside the largest one ask."""
    sizes = found.groupBy("c", "label").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("c").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    return found.join(main.select("c", F.col("top.label").alias("main")), "c").withColumn("ask", F.col("label") != F.col("main")).drop("main")


class _Comparison:
    """Compares groups first by sketches, then by whole sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, num: int, den: int, lower: bool):
        self.docs, self.reps, self.width, self.num, self.den, self.lower = docs, reps, width, num, den, lower

    def sized(self, found: DataFrame) -> DataFrame:
        return materialise(found.join(self.reps.select("nid", "n"), "nid").select("c", "nid", "label", "n", "ask"))

    def sharing(self, found: DataFrame, lists: DataFrame) -> DataFrame:
        """Members of ``found`` that share enough of ``lists`` with one of another label."""
        num, den = self.num, self.den
        of = lists.groupBy("nid").agg(F.sort_array(F.collect_list("v")).alias("els"))
        dealt = cells.deal(self.sized(found), of, F.lit(K))
        return materialise(dealt.mapInArrow(cells.filtered(lambda s: cells.meeting_rows(s, meetings_needed(s.n.astype(np.int64), num, den), num, den)), _MEMBER).distinct())

    def links(self, found: DataFrame) -> DataFrame:
        """a, b: what is alike in ``found`` (c, nid, label, n, ask), as a written table."""
        with scratch():
            return materialise(self._links(found), keep=True)

    def _links(self, found: DataFrame) -> DataFrame:
        num, den = self.num, self.den
        least = least_shared(num / den)
        sketches = only(self.reps, found.select("nid").distinct(), "nid").select("nid", F.transform("sk", lambda v: F.shiftright(v, 32).cast("int")).alias("els"))
        dealt = cells.deal(found, sketches, F.least(F.col("n"), F.lit(K)))
        left = materialise(dealt.mapInArrow(cells.filtered(lambda s: cells.overlap_rows(s, K, least, num, den)), _MEMBER).distinct())
        wanted = only(self.reps.select("nid", "hid", "id"), left.select("nid").distinct(), "nid").select("nid", "hid", F.col("id").alias("doc_id"))
        sets = materialise(whole_sets(self.docs, materialise(wanted), self.width, self.lower))
        return cells.deal(left, sets, F.col("n")).mapInArrow(cells.links(num, den), "a long, b long").distinct()


_MEMBER = "c long, nid long, label long, n int, ask boolean"


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``, as a written table."""
    with scratch():
        return materialise(_groups(docs, width, num, den, lower), keep=True)


def _groups(docs: DataFrame, width: int, num: int, den: int, lower: bool) -> DataFrame:
    with scratch():  # the sketches of all documents end with it
        sketched = materialise(sketch_documents(docs, width, lower))
        reps = named_sets(sketched)
        rows = materialise(sketched.drop("sk"), keep=True)
    lists = materialise(prefix_lists(reps, num, den))
    compare = _Comparison(docs, reps, width, num, den, lower)
    members = materialise(centred(lists).filter("c != nid").groupBy("c", "nid").agg(F.count(F.lit(1)).alias("times"), F.first("need").alias("need")).filter("times >= need").select("c", "nid"))
    # A centre that meets nobody takes no part: its sketch stays where it is.
    near = members.withColumn("ask", F.lit(False)).unionByName(members.select("c", F.col("c").alias("nid"), F.lit(True).alias("ask")).distinct())
    edges = compare.links(compare.sized(near.withColumn("label", F.col("nid"))))
    left = open_lists(lists, components(edges))
    found = outsiders(materialise(centred(left).select("c", "nid", "label").distinct()))
    found = outsiders(compare.sharing(found, left).select("c", "nid", "label"))
    edges = edges.unionByName(compare.links(compare.sized(found)))
    labels = components(edges)
    named = reps.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("hid", "id", F.coalesce("label", "nid").alias("c"))
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    of = named.join(least, "c").select("hid", "component_id")
    out = rows.join(of, "hid", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """``docs`` without all but one document of each group (that of the least id).

    An id that stands in several rows stays if one of them stays, and equal rows of it
    become one.  Rows without id stay.  All columns of ``docs`` stay, whatever their names.
    """
    own = fresh(docs, "loom_id")
    found = materialise(near_duplicates(docs, width, num, den, lower).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")))
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(own))
    left = docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
    many = found.filter("rows > 1").select(F.col("doc_id").alias(own))
    if many.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col(own))
    return left.join(many, same, "left_anti").unionByName(left.join(many, same, "left_semi").dropDuplicates())
