"""Shard lists: splitting over nodes and workers, resampling, multi-source specifications."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.naming import expand_braces, expand_source, glob_to_regex
from shardloom.operators.order import hash_of, shuffled, with_index


def shard_list(spark: SparkSession, urls: str | Iterable[str], seed: int | None = None) -> DataFrame:
    """``shard_id, url`` of a shard specification; with a seed in the same random order every time."""
    rows = list(enumerate(expand_source(urls)))
    listed = spark.createDataFrame(rows, "shard_id long, url string")
    if seed is None:
        return listed
    return shuffled(listed.select("url", F.concat_ws("#", "shard_id", "url").alias("k")), "k", seed, name="shard_id").select("shard_id", "url")


def split_by_node(df: DataFrame, rank: int, world: int, index: str = "shard_id") -> DataFrame:
    """Every ``world``-th shard from ``rank``."""
    return df.where(F.col(index) % world == rank)


def split_by_worker(df: DataFrame, worker: int, workers: int, world: int = 1, index: str = "shard_id") -> DataFrame:
    """Of what a node has (every ``world``-th shard), every ``workers``-th from ``worker``."""
    return df.where(F.floor(F.col(index) / world) % workers == worker)


def worker_info(env: Mapping[str, str] | None = None) -> tuple[int, int, int, int]:
    """Rank, world size, worker and number of workers by the variables RANK, WORLD_SIZE, WORKER and NUM_WORKERS; one of one if unset."""
    values = os.environ if env is None else env
    return int(values.get("RANK", 0)), int(values.get("WORLD_SIZE", 1)), int(values.get("WORKER", 0)), int(values.get("NUM_WORKERS", 1))


def single_node_only(df: DataFrame, world: int = 1) -> DataFrame:
    """``df``, or an error if there is more than one node."""
    if world > 1:
        raise ValueError("several nodes need a node splitter")
    return df


def non_empty(df: DataFrame) -> DataFrame:
    """``df``, or an error if it has no row; looks for one row only."""
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def resampled(items: DataFrame, n: int, key: str, seed: int = 0, epoch: int = 0, buckets: Column | None = None) -> DataFrame:
    """n draws with replacement from ``items``: ``draw`` and the columns of the item drawn; none from an empty frame."""
    shard = F.shiftright(hash_of("index", key), 22) if buckets is None else buckets
    indexed = with_index(items, shard, [key], "__i")
    size = indexed.count()
    if size == 0:
        return indexed.select(F.lit(0).cast("long").alias("draw"), *items.columns).limit(0)
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), (hash_of(seed + epoch, "id") % size).alias("__i"))
    return draws.join(indexed, "__i").select("draw", *items.columns)


def chosen(items: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k items without replacement, those of the smallest hashes."""
    return items.orderBy(hash_of(seed, key), key).limit(k)


def multi_source(spark: SparkSession, spec: dict[str, Any], seed: int = 0, epoch: int = 0) -> DataFrame:
    """``rank, name, url`` of one epoch over several shard sets.

    ``spec`` has ``datasets``, each with ``name``, ``shards`` and either
    ``resample`` (draws with replacement) or ``choose`` (without); else all its
    shards come.  ``prefix`` and ``buckets`` are put before the shards' names.
    """
    out: DataFrame | None = None
    prefix, buckets = spec.get("prefix", ""), spec.get("buckets") or [""]
    for number, part in enumerate(spec["datasets"]):
        if part.get("resample", -1) > 0 and part.get("choose", -1) > 0:
            raise ValueError(f"{part.get('name')}: either resample or choose")
        shards = part["shards"] if isinstance(part["shards"], list) else [part["shards"]]
        urls = [prefix + bucket + u for bucket in buckets for s in shards for u in expand_source(s)]
        listed = shard_list(spark, urls)
        if part.get("resample", -1) > 0:
            listed = resampled(listed, part["resample"], "shard_id", seed + number, epoch)
        elif part.get("choose", -1) > 0:
            if part["choose"] > len(urls):
                raise ValueError(f"{part.get('name')}: {part['choose']} of {len(urls)} shards")
            listed = chosen(listed, part["choose"], "shard_id", seed + number + epoch).withColumn("draw", F.col("shard_id"))
        else:
            listed = listed.withColumn("draw", F.col("shard_id"))
        rows = listed.select(F.lit(number).alias("set"), F.lit(part.get("name", str(number))).alias("name"), "draw", "url")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no datasets")
    keyed = out.withColumn("__k", F.concat_ws(":", "set", "draw", "url"))
    return shuffled(keyed, "__k", seed, epoch).select("rank", "name", "url")


def shard_spec(spark: SparkSession, spec: str | dict[str, Any] | Sequence[str], seed: int = 0) -> DataFrame:
    """Shards of a YAML file, a specification, a directory (its address ends with a slash) or an address pattern."""
    if isinstance(spec, str) and re.search(r"\.ya?ml$", spec):
        import yaml

        with open(spec, encoding="utf-8") as f:
            return multi_source(spark, yaml.safe_load(f), seed)
    if isinstance(spec, str) and spec.endswith(".json"):
        raise NotImplementedError("shard lists in JSON")
    if isinstance(spec, str) and spec.endswith("/"):
        return shard_list(spark, directory_shards(spark, spec))
    return multi_source(spark, spec, seed) if isinstance(spec, dict) else shard_list(spark, spec)


def directory_shards(spark: SparkSession, path: str, pattern: str = "*.{tar,tgz,tar.gz,tar.bz2,tar.xz}") -> list[str]:
    """The shards of a directory on any file system that Spark reads, by name; hidden files are left out."""
    wanted = [re.compile(glob_to_regex(p)) for p in expand_braces(pattern)]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(f.getPath().getName() for f in found if f.isFile())
    return [path + n for n in names if n[0] not in "._" and any(w.search(n) for w in wanted)]


def constant(spark: SparkSession, sample: dict[str, Any], n: int) -> DataFrame:
    """n equal samples with their number."""
    return spark.range(n).select(F.col("id").alias("index"), *[F.lit(v).alias(k) for k, v in sample.items()])
