"""A directory of shards as a stream: new archives are read as they come.

Spark's checkpoint takes the place of claims by renaming: every shard is read
once, by one task, and again only if that task is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.sources.tarscan import SAMPLE_TYPE, SAMPLES, Settings, _batch, _Stop, members, samples_of

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def unpacked(archives: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Samples of archives given as ``path, content`` (the ``binaryFile`` source), streaming or not.

    ``shard_id`` is a hash of the path; archives of 2 GB and more don't fit into a row.
    """
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows: list[tuple] = []
                size = 0
                try:
                    stream = pa.BufferReader(content.as_buffer())
                    for n, (key, fields) in enumerate(samples_of(members(stream, settings, path), settings, path)):
                        rows.append((number, n, key, path, None, list(fields.items())))
                        size += sum(map(len, fields.values()))
                        if size > 16 << 20:
                            yield _batch(rows, SAMPLE_TYPE)
                            rows, size = [], 0
                except _Stop:
                    pass
                if rows:
                    yield _batch(rows, SAMPLE_TYPE)

    return archives.select(F.xxhash64("path"), "path", "content").mapInArrow(run, SAMPLES)


def shard_stream(spark: SparkSession, path: str, pattern: str = "*.{tar,tgz,tar.gz}", per_trigger: int = 1, after: str = "keep", archive_dir: str | None = None, settings: Settings | None = None) -> DataFrame:
    """Samples of the archives that come into a directory, ``per_trigger`` shards a micro-batch.

    ``after``: ``keep`` leaves read shards, ``unlink`` deletes and ``done``
    moves them (to ``archive_dir``) once their batch is committed.
    """
    clean = {"keep": "off", "unlink": "delete", "done": "archive"}[after]
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).option("cleanSource", clean)
    if archive_dir:
        reader = reader.option("sourceArchiveDir", archive_dir)
    return unpacked(reader.load(path), settings)


def resample_stream(spark: SparkSession, urls: list[str], rows_per_second: int = 10, seed: int = 0) -> DataFrame:
    """Endless draws of shards with replacement: ``draw, url``, the same for the same seed."""
    from shardloom.operators.order import hash_of
    from shardloom.operators.shards import shard_list

    listed = shard_list(spark, urls)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    draws = ticks.select(F.col("value").alias("draw"), (hash_of(seed, "value") % len(urls)).alias("shard_id"))
    return draws.join(listed, "shard_id").select("draw", "url")


def drain(stream: DataFrame, checkpoint: str, table: str, **options: Any) -> DataFrame:
    """Everything that is there now, written to a Parquet table by micro-batches; called again, only what is new."""
    run = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).options(**options).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)
