"""Epochs, repetition and mixing of indexed frames.

Frames that are mixed must have the same columns and an index from 0 without gaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.operators.order import hash_of, with_index


def repeat(df: DataFrame, index: str, epochs: int, most: int | None = None) -> DataFrame:
    """``epochs`` passes: ``epoch`` and ``position``, over all passes, beside the columns; ``most`` caps the rows of all passes together."""
    size = df.count()
    wide = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs, 1) - 1)))) if epochs > 0 else df.withColumn("epoch", F.lit(0)).limit(0)
    out = wide.withColumn("position", F.col("epoch") * F.lit(size) + F.col(index))
    return out if most is None else out.where(F.col("position") < most)


def with_epoch(df: DataFrame, index: str, n: int) -> DataFrame:
    """n rows: as many passes as it takes, the last one cut short; nothing if there is nothing to repeat."""
    size = df.count()
    if size == 0:
        return repeat(df, index, 0)
    return repeat(df, index, -(-n // size), n)


def repeat_weighted(df: DataFrame, index: str, size: str, most: int, epochs: int) -> DataFrame:
    """Batches repeated until their sizes reach ``most``; the batch that passes it is still whole."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("t")).first().t
    before = Window.partitionBy("__shard").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    shard = F.floor(F.col(index) / 65536)
    sums = df.groupBy(shard.alias("__shard")).agg(F.sum(size).alias("__s"))
    offsets = sums.select("__shard", F.coalesce(F.sum("__s").over(Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    held = df.withColumn("__shard", shard).withColumn("__b", F.coalesce(F.sum(size).over(before), F.lit(0))).join(offsets, "__shard")
    out = held.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    reached = F.col("epoch") * F.lit(total) + F.col("__o") + F.col("__b")
    return out.where(reached < most).drop("__shard", "__b", "__o", "__s")


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames with the frame's number as ``src``."""
    parts = [f.withColumn("src", F.lit(k)) for k, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, parts)


def round_robin(frames: Sequence[DataFrame], index: str, longest: bool = False) -> DataFrame:
    """Rows taken in turn, with ``src`` and ``turn``, in the order (turn, src).

    By default until a frame is asked for more than it has; with ``longest``
    exhausted frames are passed over.
    """
    every = concatenated(frames).withColumnRenamed(index, "turn")
    if longest:
        return every
    sizes = every.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    known = {r.src: r.n for r in sizes.collect()}  # a row per frame
    least = min(known.get(k, 0) for k in range(len(frames)))
    ends = next(k for k in range(len(frames)) if known.get(k, 0) == least)
    return every.where((F.col("turn") < least) | ((F.col("turn") == least) & (F.col("src") < ends)))


def random_mix(frames: Sequence[DataFrame], index: str, weights: Sequence[float] | None = None, seed: int = 0, longest: bool = False) -> DataFrame:
    """Rows drawn from frames by weight: ``draw, src`` and the columns, each frame's rows in order.

    Draw i takes the frame into whose share of the weights the hash of (seed,
    i) falls.  It ends when a frame is asked for more than it has; with
    ``longest`` such draws are passed over and more are made, until all rows are out.
    """
    shares = list(weights) if weights is not None else [1.0] * len(frames)
    sizes = [f.count() for f in frames]
    alive = [k for k, s in enumerate(shares) if s > 0 and (sizes[k] or not longest)]
    spark = frames[0].sparkSession
    total, draws = sum(shares), sum(sizes) + 1
    if longest and alive:
        # Enough for the rarest frame with a wide margin, and doubled below until it is.
        draws = int(max(sizes[k] * total / shares[k] for k in alive) * 1.5) + 64
    bounds = [int(sum(shares[: k + 1]) / total * 2**32) for k in range(len(shares))]
    while True:
        spot = hash_of(seed, "draw")
        src = F.lit(len(shares) - 1)
        for k in range(len(shares) - 2, -1, -1):
            src = F.when(spot < bounds[k], F.lit(k)).otherwise(src)
        drawn = spark.range(draws).select(F.col("id").alias("draw")).withColumn("src", src)
        counts = {r.src: r.n for r in drawn.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()} if longest else {}
        if not longest or all(counts.get(k, 0) >= sizes[k] for k in alive):
            break
        draws *= 2
    # The row of its frame that a draw asks for: how often the frame was drawn before.
    parts = [with_index(drawn.where(F.col("src") == k), F.floor(F.col("draw") / 65536), ["draw"], "__row") for k in range(len(frames))]
    asked = reduce(DataFrame.unionByName, parts)
    size = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("src") + 1)
    if not longest:
        end = asked.where(F.col("__row") >= size).agg(F.min("draw").alias("e")).first().e
        asked = asked.where(F.col("draw") < end) if end is not None else asked
    every = concatenated(frames).withColumnRenamed(index, "__row")
    return asked.join(every, ["src", "__row"]).drop("__row")
