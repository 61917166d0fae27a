"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.sources.storage import shared_dir

#: A key is hot if it has HOT_ROWS rows or more and at least one row in HOT_SHARE; there are HOT_SHARE such keys at most, so they can be broadcast.
HOT_ROWS, HOT_SHARE, SALTS = 10_000, 1000, 64
#: Bits of the bitmap that clears rows from joins.
FILTER_BITS = 1 << 23
#: Within small_batches: bytes that Python is handed at once (or one row, if it is larger), and rows that are read from Parquet at once.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text of a column, a null counting as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run within takes large rows in small batches, whatever the size of a partition; Spark's own are 10,000 rows or 64 MB.

    Plans that are made outside, also of tables named within, are as before.
    """
    before = {key: spark.conf.get(key) for key in SMALL}
    try:
        for key, value in SMALL.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; smaller than a checkpoint and pruned by column.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """The hot keys of ``df``, of ``rows`` rows, as a written table; none if no key can be or is hot."""
    if rows < HOT_ROWS:
        return None
    hot = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= max(HOT_ROWS, rows / HOT_SHARE)).select(*keys))
    return None if hot.isEmpty() else hot


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``big.join(small, keys, how)``, inner, left or left_anti, with the ``hot`` keys spread over SALTS parts by a hash of ``spread``.

    Only the rows of ``small`` under hot keys are repeated, for each part.  Keys aren't null.
    """
    if hot is None:
        return big.join(small, list(keys), how)
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(mark, list(keys), "left").withColumn("__part", part).drop("__hot")
    right = small.join(mark, list(keys), "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def maybe_among(df: DataFrame, keys: Sequence[str], side: DataFrame, name: str = "maybe") -> DataFrame:
    """``df`` with a boolean that is false only where the keys aren't among those of ``side``.

    A bitmap of FILTER_BITS bits, 2 MB as a table, whatever the size of
    ``side``: rows that it clears need no join and so no shuffle.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    word = F.call_function("shiftright", bit, F.lit(6)).alias("__word")
    words = side.select(word, flag.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = df.withColumn("__word", word).withColumn("__bit", flag).join(F.broadcast(words), "__word", "left")
    return held.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))).drop("__word", "__bit", "__bits")


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str], spread: Sequence[str], rows: int) -> DataFrame:
    """The rows of ``df`` (of ``rows`` rows) whose keys aren't among those of ``gone``, both without null keys; only rows that a bitmap can't clear are joined."""
    marked = maybe_among(df, keys, gone)
    rest = marked.where("maybe").drop("maybe")
    return marked.where("not maybe").drop("maybe").unionByName(salted_join(rest, gone.select(*keys), keys, spread, "left_anti", hot_keys(df, keys, rows)))


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # the session has been stopped
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
