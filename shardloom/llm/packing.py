"""Packing (operator 7): hierarchical packing into windows of several context sizes.

Windows hold 256, 512, 1024 or 2048 ids.  A document's whole windows of the
longest size are cut off; what is left is routed to the smallest size that
holds it.  From the longest size down, a window starts with the longest piece
of its own tier, its gap is filled by the best fitting shorter pieces, and what
gap then remains by cutting a piece.  Every window is therefore full.  The last
few ids of a task, less than one window of the shortest size, are cut at powers
of two, which need no padding either.

Windows of one size are numbered over all tasks, by the prefix sums of what each
task has, and dealt to steps in that order, so all steps of a size hold the same
number of ids but for the last one.

Each task packs its own rows, ``POOL`` ids at a time, with no shuffle.  The
pieces are written to the shared folder, so they are made once; a lost task is
packed again from its split.

Rows: every row of the input is a document of its own, repeated ids and texts
included.  A null or empty text is a document of one id, the end mark.  A very
long text is encoded alone and cut into whole windows.  Other columns are left
out, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.common import table, text_of, written
from shardloom.llm.pieces import pieces, text_chunks

TIERS = (256, 512, 1024, 2048)
#: Ids that are packed at once.
POOL = 1_000_000
#: Bytes of text encoded at once; a worker takes some twenty times as much while it does.
CHUNK = 2 << 20
#: Ids in one step of a tier.
STEP_IDS = 32_768
END = 1


@dataclass(slots=True)
class Piece:
    doc: int
    start: int
    length: int


def pack_pool(pool: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows ``(size, pieces)`` and what is left; with ``last`` nothing is left, as the end is cut at powers of two."""
    top, windows = tiers[-1], []
    rest: list[Piece] = []
    for p in pool:
        whole = p.length // top
        windows += [(top, [Piece(p.doc, p.start + k * top, top)]) for k in range(whole)]
        if p.length > whole * top:
            rest.append(Piece(p.doc, p.start + whole * top, p.length - whole * top))
    # Kept by length, so that the longest piece and the best fit are found by bisection.
    keys = sorted((p.length, k) for k, p in enumerate(rest))
    left = sum(k[0] for k in keys)

    def take(i: int, most: int) -> Piece:
        """Piece i, or as much of it as fits; the rest goes back."""
        nonlocal left
        length, k = keys.pop(i)
        p = rest[k]
        if length > most:
            rest[k] = Piece(p.doc, p.start + most, length - most)
            bisect.insort(keys, (length - most, k))
            p = Piece(p.doc, p.start, most)
        left -= p.length
        return p

    for n in range(len(tiers) - 1, -1, -1):
        size, below = tiers[n], tiers[n - 1] if n else 0
        while keys and keys[-1][0] > below and left >= size:
            window, gap = [take(len(keys) - 1, size)], size
            gap -= window[0].length
            while gap:
                fit = bisect.bisect_right(keys, (gap, len(rest))) - 1
                window.append(p := take(max(fit, 0), gap))
                gap -= p.length
            windows.append((size, window))
    if not last:
        return windows, [rest[k] for _, k in keys]
    while left:  # less than a window: the powers of two in what is left
        size = 1 << (left.bit_length() - 1)
        window, gap = [], min(size, top)
        while gap:
            fit = bisect.bisect_right(keys, (gap, len(rest))) - 1
            window.append(p := take(max(fit, 0), gap))
            gap -= p.length
        windows.append((sum(p.length for p in window), window))
    return windows, []


def pack(docs: DataFrame, model: str, ranks: str | None = None, id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, pool: int = POOL, step_ids: int = STEP_IDS) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step`` of every piece; see the module.

    ``tier`` is the window's size: one of ``tiers``, or at the end of a task a smaller power of two.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sequence = task << 40
        held: dict[int, tuple[object, bytes]] = {}  # number of the document: its id and its ids as bytes
        open_pieces: list[Piece] = []
        waiting = number = 0
        ranks_of: dict[int, int] = {}

        def emit(windows: list[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for size, window in windows:
                offset = 0
                rank = ranks_of[size] = ranks_of.get(size, -1) + 1
                for p in window:
                    name, ids = held[p.doc]
                    out.append((name, p.start, p.length, zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]), len(ids) // 4, sequence, offset, size, task, rank))
                    offset += p.length
                sequence += 1
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.record_batch([pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:]], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "task", "rank"])

        id_type: pa.DataType = pa.int64()
        for chunk in text_chunks(batches, CHUNK):
            id_type = chunk.schema.field("id").type
            ids, count = pieces(model, ranks).ids(chunk.column("text"))
            data, end = ids.astype("<u4").tobytes(), 0
            for name, n in zip(chunk.column("id").to_pylist(), count.tolist()):
                held[number] = name, data[end : end + 4 * n] + END.to_bytes(4, "little")
                open_pieces.append(Piece(number, 0, n + 1))
                end += 4 * n
                number += 1
                waiting += n + 1
                if waiting >= pool:
                    windows, open_pieces = pack_pool(open_pieces, tiers, last=False)
                    yield from emit(windows)
                    held = {p.doc: held[p.doc] for p in open_pieces}
                    waiting = sum(p.length for p in open_pieces)
        yield from emit(pack_pool(open_pieces, tiers, last=True)[0])

    found = written(docs.select(F.col(id).alias("id"), text_of(text).alias("text")).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, task long, rank long"))
    # Windows of a size before those of a task: one row for each task and size.
    has = found.groupBy("tier", "task").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = has.select("tier", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    step = F.floor((F.col("base") + F.col("rank")) * F.col("tier") / step_ids).cast("long").alias("step")
    return found.join(base, ["tier", "task"]).select(F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", step)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of at most 2048 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
