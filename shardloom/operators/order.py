"""Positions: global indexes, slices, hash-ordered shuffles and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_of(seed: object, *keys: Column | str) -> Column:
    """The first 32 bits of an MD5 over a seed and keys; the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Shards whose sizes are summed up in one task.
BLOCK = 4096


def with_index(df: DataFrame, shard: Column | str, order: Sequence[Column | str], name: str = "index") -> DataFrame:
    """``df`` with a global index from 0 in the order (shard, order), without sorting everything in one task.

    Rows are numbered inside each shard; the shards' sizes, one row each, are
    summed up and joined back.  Sizes of whole-number shards are summed up in
    blocks of BLOCK shards and then over the blocks, so that no task sees all of
    them.  ``shard`` must not fall as ``order`` rises.
    """
    s = F.col(shard) if isinstance(shard, str) else shard
    held = df.withColumn("__shard", s)
    sizes = held.groupBy("__shard").agg(F.count(F.lit(1)).alias("__n"))
    if sizes.schema["__shard"].dataType.typeName() in ("byte", "short", "integer", "long"):
        sizes = sizes.withColumn("__block", F.floor(F.col("__shard") / BLOCK))
        sums = sizes.groupBy("__block").agg(F.sum("__n").alias("__s"))
        starts = sums.select(F.col("__block").alias("__b"), F.coalesce(F.sum("__s").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
        before = Window.partitionBy("__block").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
        placed = sizes.withColumn("__inner", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(starts, F.col("__block").eqNullSafe(F.col("__b")))
        offsets = placed.select("__shard", (F.col("__start") + F.col("__inner")).alias("__before"))
    else:
        before = Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__shard").orderBy(*order)) - 1
    # A null shard comes first, as nulls do in Spark's order.
    keyed = held.withColumn("__row", inside).alias("l").join(offsets.alias("r"), F.col("l.__shard").eqNullSafe(F.col("r.__shard")))
    return keyed.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__before") + F.col("__row")).alias(name))


def slice_rows(df: DataFrame, index: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows ``start, start + step, ...`` before ``stop`` of an indexed frame."""
    if start < 0 or step < 1 or (stop is not None and stop < 0):
        raise ValueError("slices count forwards from 0")
    rows = F.col(index) >= start
    if stop is not None:
        rows = rows & (F.col(index) < stop)
    return df.where(rows & ((F.col(index) - start) % step == 0) if step > 1 else rows)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int, offset: int = 0) -> DataFrame:
    """The first n rows in an order; each task keeps its own first rows only."""
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0, epoch: int = 0, name: str = "rank") -> DataFrame:
    """``df`` with its place in a random order that depends only on key, seed and epoch; ties go by key.

    The hash's leading bits are the shard of ``with_index``, so ranks need no global sort.
    """
    held = df.withColumn("__hash", hash_of(seed + epoch, key))
    return with_index(held, F.shiftright("__hash", 22), ["__hash", key], name).drop("__hash")


def buffer_shuffled(df: DataFrame, size: int = 1000, initial: int = 100, seed: int = 0) -> DataFrame:
    """Rows shuffled through a buffer of ``size`` rows inside each partition; no exchange, for rows that only need stirring.

    Rows leave at random as soon as ``initial`` are held; the buffer goes on
    filling by one row for each that leaves until it holds ``size``.
    """
    import random

    import pyarrow as pa
    from pyspark import TaskContext

    if size < 1:
        return df
    first = min(initial, size)

    def run(batches):  # noqa: ANN001, ANN202
        rng = random.Random(f"{seed}:{TaskContext.get().partitionId()}")
        held: pa.Table | None = None  # rows in the buffer, by number, and those of the batch
        buffer: list[int] = []
        grows = False
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rows = now if held is None else pa.concat_tables([held.take(pa.array(buffer, pa.int64())), now])
            buffer, out = list(range(len(buffer))), []
            for k in range(len(buffer), rows.num_rows):
                buffer.append(k)
                # Two rows come in for one that leaves, as long as the buffer is not full.
                grows = not grows and len(buffer) < size
                if len(buffer) >= max(first, 1) and not grows:
                    i = rng.randrange(len(buffer))
                    buffer[i], buffer[-1] = buffer[-1], buffer[i]
                    out.append(buffer.pop())
            held = rows
            if out:
                yield from rows.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
        rng.shuffle(buffer)
        if held is not None and buffer:
            yield from held.take(pa.array(buffer, pa.int64())).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)


def sampled(df: DataFrame, p: float, key: str | None = None, seed: int = 0) -> DataFrame:
    """Each row with probability p: by the key's hash if one is given (the same rows every time), else by Spark's sampler."""
    if not 0 <= p <= 1:
        raise ValueError("a probability lies between 0 and 1")
    if key is None:
        return df.sample(withReplacement=False, fraction=p, seed=seed)
    return df.where(hash_of(seed, key) < int(p * 2**32))
