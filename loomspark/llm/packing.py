"""Pack documents into token sequences along a space-filling curve.

A document's hashed word vector is projected to ``DIMS`` signed sums, each brought to
``BITS`` bits, and placed on a Hilbert curve.  Rows are dealt into ranges of the curve
(ties broken by a hash of the id, so that equal texts spread over ranges), sorted, and
their tokens laid end to end into sequences of ``seq_len``.  What is left at the end of
a range becomes sequences of power-of-two lengths, which need no padding.  Ranges hold
about ``RANGE`` bytes of text; they follow from the documents alone, so that pieces do not
depend on how rows are partitioned.

Edge cases: a null or empty text is its end token alone; repeated rows are packed one
after another; texts of any length are whole; an empty table gives no rows; further columns
are not looked at.  Token ids are those of the tokenizer file, whose added tokens are found
inside text, as ``tokenizers`` does.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column_bytes, materialise, mix, sent, word_hashes

DIMS, BITS, TIE_BITS = 4, 8, 20
SEQ_LEN = 1024
#: Every this-many-th id (by hash) is looked at to choose the ranges.
SAMPLE = 8
#: Bytes of text of a range, about; take more for a corpus of many terabytes.
RANGE = 1 << 25
#: Bits of a position by which ranges are told apart at each look.
LOOK = 13


def project(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, DIMS) coordinates of BITS bits from word hashes."""
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    out = np.zeros((n_docs, DIMS), np.int64)
    for d in range(DIMS):
        sign = ((h >> np.uint64(7 + d)) & np.uint64(1)).astype(np.float64) * 2 - 1
        z = np.bincount(doc, weights=sign, minlength=n_docs) / np.sqrt(n)
        out[:, d] = np.clip((1 << BITS) / (1 + np.exp(-z)), 0, (1 << BITS) - 1).astype(np.int64)
    return out


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each row of an (n, dims) array of ``bits``-bit numbers."""
    x = coords.T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the sub-cubes, from the coarsest level down
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry = np.where((x[dims - 1] & q) != 0, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_positions(batch: pa.RecordBatch) -> np.ndarray:
    """Curve index and tie-breaking hash as one number below 2**53."""
    raw, offs = column_bytes(batch.column("text"))
    keys = [hilbert(project(*word_hashes(buf, at), hi - lo)) for lo, hi, buf, at in blocks(raw, offs)]
    ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    tie = mix(ids.view(np.uint64)) >> np.uint64(64 - TIE_BITS)
    return (np.concatenate(keys) << TIE_BITS) | tie.astype(np.int64)


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Byte-level BPE of a tokenizer file, run by tiktoken (the same ids, four times as fast)."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Byte-level vocabularies write printable bytes as themselves, the others as code points from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def tokenised(docs: DataFrame, path: str, bounds: list[int]) -> DataFrame:
    cuts = np.asarray(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            pos = curve_positions(b)
            ids = [np.array([*enc.encode(t or "", allowed_special="all"), 0], np.uint32).tobytes() for t in b.column("text").to_pylist()]
            part = np.searchsorted(cuts, pos, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(pos), b.column("doc_id"), pa.array([_narrow(x) for x in ids], pa.binary())], ["part", "pos", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, pos long, doc_id long, ids binary")


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all fit, after a byte that says so; four else."""
    wide = np.frombuffer(ids, np.uint32)
    return b"2" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"4" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[:1] == b"2" else "<u4", offset=1).astype("<u4")


def lay_out(docs: Iterator[tuple[int, np.ndarray]], base: int, seq_len: int = SEQ_LEN) -> Iterator[tuple]:
    """Pieces (doc, start, length, crc, doc tokens, sequence, offset) of documents laid end to end."""
    number, filled = base, 0
    open_: list[tuple] = []  # (doc, start, ids, doc tokens) of the sequence that is not full

    def close(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at
            at += len(ids)

    for doc, ids in docs:
        start = 0
        while start < len(ids):
            take = min(seq_len - filled, len(ids) - start)
            open_.append((doc, start, ids[start : start + take], len(ids)))
            start, filled = start + take, filled + take
            if filled == seq_len:
                yield from close(open_, number)
                open_, filled, number = [], 0, number + 1
    while filled:
        length = 1 << (filled.bit_length() - 1)
        now, rest, got = [], [], 0
        for doc, start, ids, total in open_:
            take = min(length - got, len(ids))
            if take:
                now.append((doc, start, ids[:take], total))
            if take < len(ids):
                rest.append((doc, start + take, ids[take:], total))
            got += take
        yield from close(now, number)
        open_, filled, number = rest, filled - length, number + 1


def range_cuts(docs: DataFrame, size: int) -> list[int]:
    """Positions that part the documents into ranges of about ``size`` bytes of text.

    From sums of text over equal parts of the curve, of which those that hold more than a
    range are parted again, level by level; at most ``2**LOOK`` sums for each such part
    reach the driver.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = np.diff(column_bytes(b.column("text"))[1])
            yield pa.RecordBatch.from_arrays([pa.array(curve_positions(b)), pa.array((text + 1) * SAMPLE)], ["pos", "size"])

    looked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    looked = materialise(looked.mapInArrow(place, "pos long, size long"))
    sums: dict[int, int] = {}
    heavy, shift = [0], DIMS * BITS + TIE_BITS
    while heavy and shift > 0:
        shift -= LOOK
        parent = F.shiftright("pos", shift + LOOK)
        here = looked if shift + LOOK == DIMS * BITS + TIE_BITS else looked.join(sent(looked.sparkSession.createDataFrame([(h,) for h in heavy], "h long")), parent == F.col("h"), "left_semi")
        found = {r.part << shift: r.size for r in here.groupBy(F.shiftright("pos", shift).alias("part")).agg(F.sum("size").alias("size")).collect()}
        for h in heavy:
            sums.pop(h << (shift + LOOK), None)
        sums |= found
        heavy = [at >> shift for at, n in found.items() if n > size]
    cuts, held = [], 0
    for at in sorted(sums):
        if held and held + sums[at] > size:
            cuts.append(at)
            held = 0
        held += sums[at]
    return cuts


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, size: int = RANGE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    bounds = range_cuts(docs, size)
    parts = len(bounds) + 1
    dealt = tokenised(docs, tokenizer_path, bounds).repartitionById(parts, F.col("part")).sortWithinPartitions("pos", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] = []

        def rows() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                if b.num_rows and not first:
                    first.append(b.column("part")[0].as_py())
                for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                    yield doc, _wide(ids)

        stream = rows()
        head = next(stream, None)
        if head is None:
            return

        def again() -> Iterator[tuple[int, np.ndarray]]:
            yield head
            yield from stream

        out: list[tuple] = []
        for piece in lay_out(again(), first[0] << 32, seq_len):
            out.append(piece)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], _PIECES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], _PIECES)

    return dealt.mapInArrow(run, ", ".join(f"`{c}` long" for c in _PIECES))


_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
