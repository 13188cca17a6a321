"""Removal of long passages that stand more than once, exact to the byte.

Every byte is removed that lies in a ``LENGTH``-byte string which also starts anywhere
else in the corpus, itself judged on the input.  Strings never cross documents.

A generalised suffix array decides which strings repeat, and is built by linear grouping
(``suffix_array``).  In Python that costs some microseconds a symbol, too much for every
byte of a corpus, so the text is reduced first, without loss, to what is undecided:

1. Each window of LENGTH bytes has an anchor, the position of its least GRAM-byte hash.
   Equal windows have equal anchors at equal places, so windows are compared among those
   of one anchor hash only; the windows of an anchor make one run.  Runs whose bytes
   stand twice as a whole are decided by a count, runs whose anchor stands once too.
2. What is left are runs at the edge of a passage.  They are cut into nodes of STEP
   windows on a grid counted from the anchor; the bytes that all windows of a node share
   are its core.  Again whole nodes that stand twice, and cores that stand once, are
   decided by counts.
3. The nodes left meet in groups by core.  Their strings, with the core as one symbol of
   its own, go through the suffix array: a window repeats if its neighbour in the array
   begins with the same symbols.  A group larger than ``GROUP`` (a core that very many
   documents share) is not brought together: its windows are counted by hash instead,
   which partial sums keep even.

Counts are keyed by 64-bit hashes within 64-bit anchor hashes.

Edge cases: null text is empty; a text shorter than LENGTH keeps all; repeated rows are
copies of each other and so are removed whole; repeated ids are told apart by text; an
empty table gives no rows; further columns, whatever their names, are not looked at.
Texts may have fewer than 2**28 bytes; a longer one is an error.

Passages can also be measured in words (``remove_repeats``): the text is then the 64-bit
hashes of its words one after another, of which there may be fewer than 2**25.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_set, blocks, column_bytes, fold, in_set, list_bytes, materialise, mix, prefix_sums, scratch, span_hash, word_hashes, word_spans
from .suffix_array import suffix_array

LENGTH, GRAM, STEP = 400, 64, 18
#: Strings of one core up to which they are sorted together.
GROUP = 4096
#: Symbols that one suffix array is built over.
SYMBOLS = 1 << 16

#: Bytes of text whose anchors are found together: some dozen arrays of 64-bit numbers for each.
TOGETHER = 1 << 17

#: Bytes that stand for a word where passages are measured in words.
WORD = 8

_POS = np.uint64((1 << 28) - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), ``loom_rid``, a name for (id, text), and ``row``, all columns as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id"), text).alias("loom_rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def word_stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of documents whose words are written as hashes of WORD bytes."""
    h, doc = word_hashes(buf, offs)
    return h.view(np.uint8), WORD * np.searchsorted(doc, np.arange(len(offs)))


# --- 1. anchors ----------------------------------------------------------------------------


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, from running minima of blocks of that width."""
    n = len(v)
    pad = -n % width
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(x, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def anchor_runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """document, anchor, first and last window start, anchor hash, hash of the run's bytes.

    Positions are those in ``buf``.
    """
    none = np.zeros(0, np.int64)
    if len(buf) > int(_POS):
        raise ValueError("a text of 2**28 bytes or more")
    if len(buf) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_sums(buf)
    start = np.arange(len(buf) - gram + 1)
    g = span_hash(sums, start, start + gram)
    least = sliding_minimum((g & ~_POS) | start.astype(np.uint64), length - gram + 1)
    anchor = (least & _POS).astype(np.int64)
    p = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    ok = p + length <= offs[doc + 1]
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~ok[:-1]])
    first = np.flatnonzero(ok & fresh)
    if not len(first):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    over = np.concatenate([(anchor[1:] != anchor[:-1]) | ~ok[1:], [True]])
    last = np.flatnonzero(ok & over)
    a = anchor[first]
    whole = mix(span_hash(sums, first, last + length) + g[a] * np.uint64(3) + (a - first).astype(np.uint64))
    return doc[first], a, first, last, g[a], whole


def anchors(docs: DataFrame, length: int, gram: int, words: bool = False) -> DataFrame:
    """loom_rid, a, lo, hi, ah, hf: every anchor; its windows start lo to hi bytes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = column_bytes(b.column("text"))
            rid = b.column("loom_rid").to_numpy()
            for lo, _, buf, at in blocks(raw, offs, TOGETHER):
                if words:
                    buf, at = word_stream(buf, at)
                doc, a, first, last, ah, hf = anchor_runs(buf, at, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid[lo + doc]),
                        pa.array((a - at[doc]).astype(np.int32)),
                        pa.array((a - last).astype(np.int16)),
                        pa.array((a - first).astype(np.int16)),
                        pa.array(ah.view(np.int64)),
                        pa.array(hf.view(np.int64)),
                    ],
                    ["loom_rid", "a", "lo", "hi", "ah", "hf"],
                )

    return docs.select("loom_rid", "text").mapInArrow(run, "loom_rid long, a int, lo smallint, hi smallint, ah long, hf long")


def classes(rows: DataFrame, inner: str, outer: str) -> DataFrame:
    """inner, n, alone: how often each whole stands and whether its kind has one that stands
    once; only kinds (``outer``) that stand more than once."""
    n = rows.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    kinds = n.groupBy(outer).agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("all > 1")
    return n.join(kinds, outer).select(F.col(inner), F.col(outer).alias("kind_"), "n", (F.col("least") == 1).alias("alone"))


# --- 2. nodes ------------------------------------------------------------------------------


def contexts(docs: DataFrame, undecided: DataFrame, length: int, words: bool = False) -> DataFrame:
    """loom_rid, a, lo, hi, ah, rep and the bytes of each undecided run."""
    per = undecided.groupBy("loom_rid").agg(F.collect_list(F.struct("a", "lo", "hi", "ah", "rep")).alias("runs"))
    rows = in_set(docs, "loom_rid", bit_set(undecided, "loom_rid")).select("loom_rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for rid, text, runs in zip(b.column("loom_rid").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist()):
                t = text.encode("utf-8", "surrogatepass")
                if words:
                    t = word_stream(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()
                for r in runs:
                    out.append((rid, r["a"], r["lo"], r["hi"], r["ah"], r["rep"], t[r["a"] - r["hi"] : r["a"] - r["lo"] + length]))
            for i in range(0, len(out), 5000):
                cols = list(zip(*out[i : i + 5000]))
                kinds = [pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["loom_rid", "a", "lo", "hi", "ah", "rep", "ctx"])

    return rows.join(per, "loom_rid").mapInArrow(run, "loom_rid long, a int, lo smallint, hi smallint, ah long, rep boolean, ctx binary")


def node_table(ctx: pa.RecordBatch, length: int) -> dict[str, np.ndarray]:
    """The nodes of a batch of contexts."""
    col = ctx.column("ctx")
    raw, offs = list_bytes(col.to_pylist())
    lo, hi = ctx.column("lo").to_numpy().astype(np.int64), ctx.column("hi").to_numpy().astype(np.int64)
    j0, j1 = lo // STEP, hi // STEP
    count = j1 - j0 + 1
    owner = np.repeat(np.arange(len(lo)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + j0[owner]
    first, last = np.maximum(lo[owner], STEP * j), np.minimum(hi[owner], STEP * j + STEP - 1)
    base = offs[owner] + hi[owner] - STEP * j  # where the core starts
    end = base + length - STEP + 1
    sums = prefix_sums(raw)
    ah = ctx.column("ah").to_numpy().view(np.uint64)[owner]
    core = mix(span_hash(sums, base, end) + ah * np.uint64(5) + j.astype(np.uint64))
    left, right = last - STEP * j, STEP - 1 - (first - STEP * j)
    whole = fold(np.stack([core, span_hash(sums, base - left, base), span_hash(sums, end, end + right), (left * STEP + right).astype(np.uint64)], axis=1))
    return {"owner": owner, "base": base, "end": end, "left": left, "right": right, "core": core, "whole": whole, "raw": raw, "at": ctx.column("a").to_numpy().astype(np.int64)[owner] - STEP * j}


def nodes(ctx: DataFrame, length: int, payload: bool) -> DataFrame:
    """core, nf and, if asked for, loom_rid, rep, at (where the core starts in the document),
    nl, nr and pay (the bytes left and right of the core, each padded to STEP - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = STEP - 1
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                t = node_table(b, length)
                names = [pa.array(t["core"].view(np.int64)), pa.array(t["whole"].view(np.int64))]
                if not payload:
                    yield pa.RecordBatch.from_arrays(names, ["core", "nf"])
                    continue
                raw = np.concatenate([np.zeros(wide, np.uint8), t["raw"], np.zeros(wide, np.uint8)])
                span = np.arange(wide)
                both = np.concatenate([raw[t["base"][:, None] + span], raw[wide + t["end"][:, None] + span]], axis=1)
                n = len(both)
                pay = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * 2 * wide, 2 * wide, dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(both.tobytes())])
                rid, rep = (b.column(c).to_numpy(zero_copy_only=False)[t["owner"]] for c in ("loom_rid", "rep"))
                yield pa.RecordBatch.from_arrays(
                    [*names, pa.array(rid), pa.array(rep), pa.array(t["at"].astype(np.int32)), pa.array(t["left"].astype(np.int16)), pa.array(t["right"].astype(np.int16)), pay],
                    ["core", "nf", "loom_rid", "rep", "at", "nl", "nr", "pay"],
                )

    kinds = "core long, nf long" + ", loom_rid long, rep boolean, at int, nl smallint, nr smallint, pay binary" * payload
    return ctx.select("loom_rid", "a", "lo", "hi", "ah", "rep", "ctx").mapInArrow(run, kinds)


# --- 3. suffix arrays ------------------------------------------------------------------------


def repeated_windows(strings: list[tuple[int, bytes, bytes]]) -> list[list[int]]:
    """For each (core number, left bytes, right bytes): the bytes left of the core (as many
    as the window begins before it) of those windows that another of the strings has too."""
    text: list[int] = []
    begins: list[int] = []
    for core, left, right in strings:
        begins.append(len(text))
        text += [x + 1 for x in left]
        text.append(257 + core)
        text += [x + 1 for x in right]
        text.append(0)
    order = np.asarray(suffix_array(text), np.int64)
    t = np.asarray([*text, *[0] * STEP], np.int64)
    same = np.ones(len(order) - 1, bool)
    live = np.ones(len(order), bool)  # windows without a separator
    for k in range(STEP):
        c = t[order + k]
        live &= c != 0
        same &= c[1:] == c[:-1]
    same &= live[1:] & live[:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out = []
    for at, (_, left, right) in zip(begins, strings):
        # A window of STEP symbols that starts in the left part or at the core.
        out.append([len(left) - q for q in range(len(left) + 1) if STEP - 1 - (len(left) - q) <= len(right) and twice[at + q]])
    return out


def sorted_leaves(leaves: DataFrame, length: int) -> DataFrame:
    """loom_rid, s, e: runs of repeated windows among leaves of one core, by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = STEP - 1
        held: list[tuple] = []
        cores = symbols = 0
        last = None

        def out() -> pa.RecordBatch:
            found = repeated_windows([(h[0], h[4], h[5]) for h in held])
            rows = [(h[1], h[2] - x, h[2] - x + length) for h, f in zip(held, found) if not h[3] for x in f]
            r, s, e = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["loom_rid", "s", "e"])

        for b in batches:
            for core, rid, rep, at, nl, nr, pay in zip(*(b.column(c).to_pylist() for c in ("core", "loom_rid", "rep", "at", "nl", "nr", "pay"))):
                if core != last:
                    if symbols > SYMBOLS:
                        yield out()
                        held, cores, symbols = [], 0, 0
                    last, cores = core, cores + 1
                held.append((cores, rid, at, rep, pay[wide - nl : wide], pay[wide : wide + nr]))
                symbols += nl + nr + 2
        if held:
            yield out()

    cols = ("core", "loom_rid", "rep", "at", "nl", "nr", "pay")
    dealt = leaves.select(*cols).repartition("core").sortWithinPartitions("core")
    return dealt.mapInArrow(run, "loom_rid long, s int, e int")


def counted_leaves(leaves: DataFrame, length: int) -> DataFrame:
    """The same for cores that very many strings share: windows counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = STEP - 1
        for b in batches:
            core = b.column("core").to_numpy().view(np.uint64)
            nl, nr = b.column("nl").to_numpy().astype(np.int64), b.column("nr").to_numpy().astype(np.int64)
            pays = np.frombuffer(b"".join(b.column("pay").to_pylist()), np.uint8)
            sums = prefix_sums(pays)
            row = np.arange(len(core)) * 2 * wide
            for back in range(STEP):
                ok = np.flatnonzero((nl >= back) & (nr >= STEP - 1 - back))
                mid = row[ok] + wide
                h = mix(span_hash(sums, mid - back, mid + STEP - 1 - back) + core[ok] * np.uint64(7) + np.uint64(back))
                pick = pa.array(ok)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), b.column("loom_rid").take(pick), b.column("rep").take(pick), pa.array((b.column("at").to_numpy()[ok] - back).astype(np.int32))], ["h", "loom_rid", "rep", "s"]
                )

    each = leaves.select("core", "loom_rid", "rep", "at", "nl", "nr", "pay").mapInArrow(run, "h long, loom_rid long, rep boolean, s int")
    twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return each.join(twice, "h").filter(~F.col("rep")).select("loom_rid", "s", (F.col("s") + length).alias("e"))


# --- whole operator ----------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, length: int = LENGTH, words: bool = False) -> DataFrame:
    """loom_rid, s, e: byte spans that together cover what repeats, as a written table.

    ``words``: bytes are those of the word streams.  ``docs`` has ``loom_rid`` (see :func:`keyed`).
    """
    gram = max(8, min(GRAM, length // 4))
    if length < gram + STEP:
        raise ValueError(f"length must be at least {gram + STEP}")
    with scratch():
        return materialise(_spans(docs, length, gram, words), keep=True)


def _spans(docs: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    rows = materialise(anchors(docs, length, gram, words))
    known = classes(rows, "hf", "ah").select("hf", "n", "alone")
    decided = materialise(rows.join(known, "hf"))
    spans = decided.filter("n > 1").select("loom_rid", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + length).alias("e"))
    cols = ["loom_rid", "a", "lo", "hi", "ah"]
    single = decided.filter("n = 1").select(*cols, F.lit(False).alias("rep"))
    stand_in = decided.filter("n > 1 and alone").dropDuplicates(["hf"]).select(*cols, F.lit(True).alias("rep"))
    undecided = materialise(single.unionByName(stand_in))
    ctx = materialise(contexts(docs, undecided, length, words))
    known = materialise(classes(nodes(ctx, length, False), "nf", "core").select("nf", "n", "alone"))
    live = materialise(nodes(ctx, length, True).join(known, "nf"))
    whole = live.filter("n > 1 and not rep").select("loom_rid", (F.col("at") - F.col("nl")).alias("s"), (F.col("at") - (STEP - 1 - F.col("nr")) + length).alias("e"))
    one = live.filter("n = 1").drop("n", "alone")
    stand_in = live.filter("n > 1 and alone").dropDuplicates(["nf"]).withColumn("rep", F.lit(True)).drop("n", "alone")
    leaves = materialise(one.unionByName(stand_in))
    large = materialise(leaves.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > GROUP).select("core"))
    few = sorted_leaves(leaves.join(large, "core", "left_anti"), length)
    found = spans.unionByName(whole).unionByName(few)
    if not large.isEmpty():
        found = found.unionByName(counted_leaves(leaves.join(large, "core", "left_semi"), length))
    return found


def cut_spans(size: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(ends, np.int64), -1)
    inside = np.concatenate([[False], np.cumsum(edge[:size]) > 0, [False]])
    at = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(at[::2].tolist(), at[1::2].tolist()))


def with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with ``spans`` collected for each, documents that have none)."""
    bits = bit_set(spans, "loom_rid")
    per = spans.groupBy("loom_rid").agg(*(F.collect_list(c).alias(f"loom_{c}") for c in spans.columns if c != "loom_rid"))
    return in_set(docs, "loom_rid", bits).join(per, "loom_rid", "left"), in_set(docs, "loom_rid", bits, False)


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    rows = keyed(docs.select("doc_id", "text")).drop("row")
    some, none = with_spans(rows, repeated_spans(rows, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, s, e in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "loom_s", "loom_e"))):
                t = text.encode("utf-8", "surrogatepass")
                cut = cut_spans(len(t), s or [], e or [])
                left = hashlib.sha256()
                at = 0
                for x, y in cut:
                    left.update(t[at:x])
                    at = y
                left.update(t[at:])
                out.append((doc, len(t), sum(y - x for x, y in cut), len(cut), left.hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cut = some.select("doc_id", "text", "loom_s", "loom_e").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    kept = none.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return cut.unionByName(kept)


def word_cuts(raw: bytes, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Byte spans from the first to the last word of each run that spans of a word stream cover.

    Spans that only touch are two runs: no repeated run holds what stands between them.
    """
    first, last, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    runs: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    words = [(-(-s // WORD), e // WORD) for s, e in runs]
    return [(int(first[i]), int(last[j - 1])) for i, j in words if i < j]


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` (whole characters only) and
    ``n_chars`` set anew where that column exists; all rows and columns stay.

    Passages are strings of ``length`` bytes and, if given, runs of ``words`` words, however
    few bytes those have and whatever blanks part them; both are judged on the input.
    """
    rows = keyed(docs)
    known = rows.drop("row")
    spans = repeated_spans(known, length)
    if words is not None:
        worded = repeated_spans(known, words * WORD, True).withColumnsRenamed({"s": "ws", "e": "we"})
        spans = spans.unionByName(worded, allowMissingColumns=True)
    else:
        spans = spans.withColumns({c: F.lit(None).cast("int") for c in ("ws", "we")})
    some, none = with_spans(rows, spans)

    @F.pandas_udf("string")
    def left(text: pd.Series, s: pd.Series, e: pd.Series, ws: pd.Series, we: pd.Series) -> pd.Series:
        out = []
        for t, a, z, wa, wz in zip(text, s, e, ws, we):
            if t is None or a is None:
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            both = [*zip(a, z), *(word_cuts(raw, list(wa), list(wz)) if len(wa) else ())]
            parts, at = [], 0
            for x, y in cut_spans(len(raw), [x for x, _ in both], [y for _, y in both]):
                while x < y and raw[x] & 0xC0 == 0x80:  # within a character
                    x += 1
                while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                    y -= 1
                parts.append(raw[at:x])
                at = y
            parts.append(raw[at:])
            out.append(b"".join(parts).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    cut = some.withColumn("text", left("row.text", "loom_s", "loom_e", "loom_ws", "loom_we"))
    new = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cut.select(new.alias("row")).select("row.*").unionByName(none.select("row.*"))
