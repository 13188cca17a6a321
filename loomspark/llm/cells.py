"""Comparison of the sets of a group, in cells of bounded size.

A group is named by its centre ``c`` and has members (nid, label, n); some of them ask.
Every asking member meets all members of another label.  The members are dealt into parts
of about ``BLOCK`` elements, and a cell is one part of asking members against one part of
all members: the unit of work that a task streams through.  So memory does not depend on
the size of a group, a large group is spread over tasks, and no row is made for a pair;
a cell puts out which members have a partner, or the links that connect them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Elements of the sets of one part, and of the cells that are looked at together.
BLOCK, TOGETHER = 1 << 16, 1 << 17
#: Meetings of elements that are counted together, and entries of a table of counts.
STEP = 1 << 20


def deal(groups: DataFrame, sets: DataFrame, weight: Column) -> DataFrame:
    """Cells of ``groups`` (c, nid, label, n, ask), each in one partition and in one run.

    ``sets``: nid and its elements ``els`` (long, or int for upper halves), of which a member has ``weight``.  Groups in
    which nobody asks are left out.  ``role``: 1 asks in this cell, 2 is asked, 3 both.
    """
    count = lambda w: F.ceil(F.sum(w) / BLOCK).cast("int")
    parts = groups.groupBy("c").agg(count(F.when(F.col("ask"), weight)).alias("asks"), count(weight).alias("all")).filter("asks > 0")
    h = F.xxhash64("nid")
    at = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    zero, one = F.lit(0), F.lit(1)
    asking = F.transform(F.sequence(zero, F.col("all") - 1), lambda j: at(F.pmod(h, F.col("asks")), j, one))
    asked = F.transform(F.sequence(zero, F.col("asks") - 1), lambda i: at(i, F.pmod(h, F.col("all")), F.lit(2)))
    several = F.when(F.col("ask"), F.concat(asking, asked)).otherwise(asked)
    single = F.array(at(zero, zero, F.lit(2) + F.col("ask").cast("int")))
    each = groups.join(parts, "c").withColumn("at", F.explode(F.when(F.col("all") == 1, single).otherwise(several)))
    cells = each.select(F.xxhash64("c", "at.i", "at.j").alias("cell"), "c", "nid", "label", "n", "ask", "at.role")
    return cells.join(sets, "nid").repartition("cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one or more whole cells, of about ``TOGETHER`` elements or one cell."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += len(b.column("els").flatten())
        if size < TOGETHER:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cell = t["cell"].to_numpy()
        other = np.flatnonzero(cell != cell[-1])
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield t.slice(0, end)
        rest = t.slice(end)
        held, size = rest.to_batches(), len(rest["els"].combine_chunks().flatten())
    if held:
        yield pa.Table.from_batches(held)


class Sets:
    """The sets of whole cells as flat arrays; elements of different cells never meet."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        els = t["els"].chunk(0)
        self.rows = t.num_rows
        self.size = els.value_lengths().to_numpy().astype(np.int64)
        flat = els.flatten().to_numpy()
        flat = flat.view(np.uint32).astype(np.uint64) if flat.dtype == np.int32 else flat.view(np.uint64)
        owner = np.repeat(np.arange(self.rows), self.size)
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        cell = t["cell"].to_numpy().view(np.uint64)
        self.single = bool((cell == cell[0]).all())
        key = flat if self.single else mix(flat + mix(cell)[owner])
        self.nid, self.label, self.n = (t[c].to_numpy() for c in ("nid", "label", "n"))
        role = t["role"].to_numpy()
        self.asking, self.asked = ((key[p], owner[p], rank[p]) for p in ((role & 1 != 0)[owner], (role & 2 != 0)[owner]))

    def able(self, f: np.ndarray, g: np.ndarray, num: int, den: int) -> np.ndarray:
        """Pairs of rows of different labels whose sizes allow a similarity of num/den."""
        a, b = self.n[f].astype(np.int64), self.n[g].astype(np.int64)
        return (self.label[f] != self.label[g]) & (np.minimum(a, b) * den >= np.maximum(a, b) * num)


def _runs(owner: np.ndarray, total: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Cuts of the asking elements at whole rows: at most about STEP meetings and ``rows`` rows."""
    begin, n = 0, len(owner)
    while begin < n:
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + STEP, "right"))
        end = min(end, int(np.searchsorted(owner, owner[begin] + rows, "left")))
        if end < n:
            first = int(np.searchsorted(owner, owner[end], "left"))
            end = first if first > begin else int(np.searchsorted(owner, owner[begin], "right"))
        yield begin, end
        begin = end


def _expand(lo: np.ndarray, count: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, position): positions lo[i], lo[i] + 1 … for each i of [begin, end)."""
    c = count[begin:end]
    i = np.repeat(np.arange(begin, end), c)
    return i, lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)


def _pairs(s: Sets, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(f, g, common, both) of pairs of rows with a common element: how many they have, and
    how many of those are among the ``k`` least of the union of both."""
    (key, owner, rank), (other, of, other_rank) = s.asking, s.asked
    order = np.argsort(other, kind="stable")
    known = other[order]
    lo = np.searchsorted(known, key, "left")
    count = np.searchsorted(known, key, "right") - lo
    for begin, end in _runs(owner, np.cumsum(count), max(1, STEP // s.rows)):
        i, p = _expand(lo, count, begin, end)
        if not len(i):
            continue
        m = order[p]
        low, high = int(owner[begin]), int(owner[end - 1]) + 1
        code, mine, theirs = (owner[i] - low) * s.rows + of[m], rank[i], other_rank[m]
        if len(code) * 8 < (high - low) * s.rows:  # few meet: by pair, elements ascending
            by = np.argsort(code, kind="stable")
            code, places = code[by], (mine + theirs)[by]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            common = np.diff(np.append(first, len(code)))
            before = np.arange(len(code)) - np.repeat(first, common)
            both = np.add.reduceat((places - before < k).astype(np.int64), first)
            code = code[first]
        else:  # a table of all pairs, one element of each asking row after the other
            common, both = np.zeros((2, (high - low) * s.rows), np.int32)
            by = np.argsort(mine.astype(np.uint16), kind="stable") if mine.max() < 1 << 16 else np.argsort(mine, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(mine[by])) + 1, len(by))
            start = 0
            for stop in ends:
                at = by[start:stop]
                c = code[at]
                before = common[c]
                both[c] += mine[at] + theirs[at] - before < k
                common[c] = before + 1
                start = stop
            code = np.flatnonzero(common)
            common, both = common[code], both[code]
        yield code // s.rows + low, code % s.rows, common, both


def meeting_rows(s: Sets, need: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows that have as many elements in common with a row of another label as each of the two needs."""
    good = np.zeros(s.rows, bool)
    for f, g, common, _ in _pairs(s, 1):
        enough = (common >= np.maximum(need[f], need[g])) & s.able(f, g, num, den)
        good[f[enough]] = True
        good[g[enough]] = True
    return good


def overlap_rows(s: Sets, k: int, least: int, num: int, den: int) -> np.ndarray:
    """Rows with a partner whose union sketch leaves num/den possible; elements are sketches.

    The union sketch is the ``k`` least values of both sketches; a common value is in it if
    fewer than ``k`` values of the union are less.
    """
    good = np.zeros(s.rows, bool)
    for f, g, common, both in _pairs(s, k):
        union = s.size[f] + s.size[g] - common
        enough = np.where(union < k, both * den >= union * num, both >= least) & s.able(f, g, num, den)
        good[f[enough]] = True
        good[g[enough]] = True
    return good


def linked_rows(s: Sets, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sets, here whole, have a similarity of num/den or more.

    An element that most members have is counted by the members that lack it.
    """
    (key, owner, _), (other, of, _) = s.asking, s.asked
    if not len(key) or not len(other):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    members, column = np.unique(of, return_inverse=True)
    order = np.argsort(other, kind="stable")
    known, column = other[order], column[order]
    first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
    values, df = known[first], np.diff(np.append(first, len(known)))
    heavy = df * 2 > len(members)
    lists, start, length = column, first.copy(), df.copy()
    if heavy.any():
        number = np.cumsum(heavy) - 1
        lacks = np.ones((int(heavy.sum()), len(members)), bool)
        kind = np.repeat(np.arange(len(values)), df)
        common = heavy[kind]
        lacks[number[kind[common]], column[common]] = False
        lengths = lacks.sum(axis=1)
        start[heavy], length[heavy] = len(column) + np.cumsum(lengths) - lengths, lengths
        lists = np.concatenate([column, np.nonzero(lacks)[1]])
    at = np.minimum(np.searchsorted(values, key), len(values) - 1)
    hit = values[at] == key
    count = np.where(hit, length[at], 0)
    lo, most = start[at], hit & heavy[at]
    left, right = [], []
    for begin, end in _runs(owner, np.cumsum(count), max(1, STEP // len(members))):
        low, high = int(owner[begin]), int(owner[end - 1]) + 1
        i, p = _expand(lo, count, begin, end)
        sign = np.where(most[i], -1.0, 1.0)
        both = np.bincount((owner[i] - low) * len(members) + lists[p], sign, (high - low) * len(members)).reshape(high - low, -1)
        both += np.bincount(owner[begin:end][most[begin:end]] - low, minlength=high - low)[:, None]
        size = s.size[low:high, None] + s.size[members][None, :]
        f, g = np.nonzero((both > 0) & (both * den >= num * (size - both)))
        f, g = f + low, members[g]
        ok = s.able(f, g, num, den)
        left.append(f[ok])
        right.append(g[ok])
    return np.concatenate(left), np.concatenate(right)


def connected(f: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """For each row the least row that the links (f, g) join it with."""
    label = np.arange(rows)
    while True:
        low = np.minimum(label[f], label[g])
        new = label.copy()
        np.minimum.at(new, f, low)
        np.minimum.at(new, g, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def filtered(keep: Callable[[Sets], np.ndarray]) -> Callable:
    """mapInArrow function: members (c, nid, label, n, ask) that ``keep`` marks in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches):
            yield from t.select(["c", "nid", "label", "n", "ask"]).filter(pa.array(keep(Sets(t)))).to_batches()

    return run


def links(num: int, den: int) -> Callable:
    """mapInArrow function: links (a, b) that connect what is alike in a cell, at most one a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches):
            s = Sets(t)
            label = connected(*linked_rows(s, num, den), s.rows)
            moved = np.flatnonzero(label != np.arange(s.rows))
            yield pa.RecordBatch.from_arrays([pa.array(s.nid[moved]), pa.array(s.nid[label[moved]])], ["a", "b"])

    return run
