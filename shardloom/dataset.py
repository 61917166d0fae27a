"""A fluent interface over frames of samples.

A ``Dataset`` is immutable: every method returns a new one.  It carries the
columns that give its order (``shard`` and ``pos``), so that slices, batches
and repetitions mean the same on a cluster as on one machine.  Fields that are
named before anything else is done with the map are pushed to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import batching, epochs, joins, order, project, shards
from shardloom.sources.tarscan import read_shards

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    shard: str = "shard_id"
    pos: str = "sample_no"
    length: int | None = None
    #: How the scan is made again with fewer extensions, as long as nothing but it has happened.
    scan: Callable[[Sequence[str]], DataFrame] | None = None

    # --- making one ---

    @classmethod
    def open(cls, spark: SparkSession, urls: Any, shuffle_seed: int | None = None, rank: int = 0, world: int = 1, resample: int = 0, **settings: Any) -> Dataset:
        """Samples of shards: listed, split over nodes, ordered or resampled, then read one partition a shard."""
        listed = shards.shard_spec(spark, urls) if isinstance(urls, (str, dict)) else shards.shard_list(spark, urls)
        if "rank" in listed.columns:
            listed = listed.select(F.col("rank").alias("shard_id"), "url")
        names = [r.url for r in shards.split_by_node(listed, rank, world).orderBy("shard_id").collect()]  # a shard list is the driver's
        if resample:
            drawn = shards.resampled(shards.shard_list(spark, names), resample, "shard_id", shuffle_seed or 0)
            names = [r.url for r in drawn.orderBy("draw").collect()]
        elif shuffle_seed is not None:
            names = [r.url for r in shards.shard_list(spark, names, shuffle_seed).orderBy("shard_id").collect()]
        if not names:
            raise ValueError("no shards")
        again = lambda exts: read_shards(spark, names, exts=tuple(exts) if exts else None, **settings)
        return cls(again(()), scan=again)

    @classmethod
    def of(cls, df: DataFrame, shard: str, pos: str) -> Dataset:
        """Any frame with its order columns."""
        return cls(df, shard, pos)

    def _with(self, df: DataFrame) -> Dataset:
        return replace(self, df=df, scan=None)

    def _keys(self) -> list[str]:
        return [c for c in (self.shard, self.pos) if c in self.df.columns]

    # --- fields ---

    def fields(self, **declared: tuple[str, Callable[[Column], Column]]) -> Dataset:
        """Columns decoded from the fields map: ``name=(extension, decoder)``; a scan reads these extensions only."""
        exts = sorted({e for e, _ in declared.values()})
        df = self.scan(exts) if self.scan else self.df
        made = df.withColumns({n: decoder(F.col("fields")[e]) for n, (e, decoder) in declared.items()})
        return self._with(made.drop("fields"))

    def select(self, predicate: Column) -> Dataset:
        return self._with(project.select(self.df, predicate))

    def map(self, drop_null: Sequence[str] = (), **new: Column) -> Dataset:
        return self._with(project.map_columns(self.df, drop_null, **new))

    def map_dict(self, **functions: Callable[[Column], Column]) -> Dataset:
        return self._with(project.map_dict(self.df, **functions))

    def map_tuple(self, *functions: Callable[[Column], Column] | None) -> Dataset:
        """The columns ``_0, _1, ...`` transformed by position."""
        pairs = {f"_{k}": f for k, f in enumerate(functions) if f is not None and f"_{k}" in self.df.columns}
        return self._with(project.map_dict(self.df, **pairs))

    def to_tuple(self, *specs: str, missing_is_error: bool = True) -> Dataset:
        """Columns ``_0, _1, ...`` beside the order columns; fields of the map if there is one."""
        keys = self._keys()
        specs = tuple(specs[0].split()) if len(specs) == 1 else specs
        if "fields" in self.df.columns:
            df = self.scan([a for s in specs for a in s.split(";")]) if self.scan else self.df
            named = {f"__t{k}": project.first_field("fields", s) for k, s in enumerate(specs)}
            there = df.select(*keys, *[v.alias(n) for n, v in named.items()])
            specs = tuple(named)
        else:
            there = self.df
        made = project.to_tuple(there, *keys, *specs, missing_is_error=missing_is_error)
        names = [*keys, *[f"_{k}" for k in range(len(specs))]]
        return self._with(made.toDF(*names))

    def rename(self, keep: bool = True, **spec: str) -> Dataset:
        return self._with(project.rename(self.df, keep, **(spec if keep else {k: k for k in self._keys()} | spec)))

    def rename_keys(self, *pairs: tuple[str, str], **options: Any) -> Dataset:
        kept = [(k, k) for k in self._keys()]
        return self._with(project.rename_keys(self.df, *kept, *pairs, **options))

    def extract_keys(self, *patterns: str, **options: Any) -> Dataset:
        return self._with(project.extract_keys(self.df, *patterns, **options))

    def associate(self, side: DataFrame, key: str = "__key__") -> Dataset:
        return self._with(joins.associate(self.df, side, key))

    def xdecode(self, *rules: tuple[str, Callable[[Column], Column] | bool], name: str = "ext", value: str = "data", must_decode: bool = True) -> Dataset:
        """``value`` decoded by the last glob that matches ``name``."""
        return self._with(self.df.withColumn(value, project.dispatch(F.col(name), F.col(value), *rules, must_decode=must_decode)))

    def map_samples(self, f: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str, image: str | None = None, only: Sequence[str] | None = None, handlers: dict[str, Callable[[bytes], Any]] | None = None, secure: bool = True, on_error: str = "fail") -> Dataset:
        """Samples with decoded fields through any Python function; None drops a sample.

        The result has the order columns and those of ``schema``; ``__key__``
        is copied if the schema names it and the function leaves it out.
        Policies: fail, skip, warn (skip with a warning), stop (end the partition).
        """
        df = self.scan(list(only)) if self.scan and only else self.df
        return self._with(mapped(df, self._keys(), f, schema, image, only, handlers, secure, on_error))

    def decode(self, schema: str, *handlers: Callable[[str, bytes], Any] | str, pre: Sequence[Callable[[str, bytes], Any]] | None = None, post: Sequence[Callable[[str, bytes], Any]] | None = None, only: Sequence[str] | None = None, secure: bool = True, on_error: str = "fail") -> Dataset:
        """The columns of ``schema`` (named like extensions) decoded by a chain of handlers: pre, own, post; see ``codecs.Chain``.

        A handler that is a string is the form in which images are decoded.
        """
        from shardloom.functions import codecs

        images = [h for h in handlers if isinstance(h, str)]
        chain = codecs.Chain(tuple(h for h in handlers if not isinstance(h, str)), (codecs.unpack,) if pre is None else tuple(pre), None if post is None else tuple(post), images[-1] if images else None, secure)
        df = self.scan(list(only)) if self.scan and only else self.df
        return self._with(mapped(df, self._keys(), dict, schema, None, only, None, secure, on_error, chain))

    def valid(self) -> Dataset:
        """Samples that hold a field and aren't marked as bad."""
        return self._with(project.valid(self.df))

    def log_keys(self, rank: int = 0, worker: int = 0, key: str = "__key__") -> DataFrame:
        """The log of keys as a table."""
        return project.key_log(self._indexed().df, key, "index", worker, rank)

    def info(self, n: int = 3) -> Dataset:
        project.info(self.df, n)
        return self

    # --- order ---

    def indexed(self, name: str = "index") -> Dataset:
        """A global index in the order of the shards and positions."""
        return self._with(order.with_index(self.df, self.shard, [self.pos], name))

    def _indexed(self) -> Dataset:
        return self if "index" in self.df.columns else self.indexed()

    def slice(self, *bounds: int | None) -> Dataset:
        """``stop``, or ``start, stop[, step]``."""
        start, stop, step = (0, bounds[0], 1) if len(bounds) == 1 else (bounds[0] or 0, bounds[1], bounds[2] if len(bounds) > 2 else 1)
        return self._with(order.slice_rows(self._indexed().df, "index", start, stop, step or 1))

    def rsample(self, p: float = 0.5, key: str | None = None, seed: int = 0) -> Dataset:
        return self._with(order.sampled(self.df, p, key, seed))

    def shuffle(self, size: int = 1000, initial: int = 100, seed: int = 0) -> Dataset:
        """Stirred through a bounded buffer in each partition; a size below 1 does nothing."""
        return self._with(order.buffer_shuffled(self.df, size, initial, seed))

    def detshuffle(self, key: str = "__key__", seed: int = 0, epoch: int = 0) -> Dataset:
        """A global order that depends on key, seed and epoch only; ``index`` is the new place."""
        df = self.df.drop("index")
        return self._with(order.shuffled(df, key, seed, epoch, "index"))

    # --- batches ---

    def batched(self, size: int = 20, partial: bool = True, columns: Sequence[str] | None = None) -> Dataset:
        names = columns or [c for c in self.df.columns if c not in {*self._keys(), "index"}]
        return self._with(batching.batched(self._indexed().df, "index", size, partial, names))

    def listed(self, size: int = 20, partial: bool = True) -> Dataset:
        return self._with(batching.listed(self._indexed().df, "index", size, partial))

    def unbatched(self) -> Dataset:
        arrays = [c for c, t in self.df.dtypes if t.startswith("array")]
        flat = batching.unbatched(self.df, arrays)
        size = F.lit(1 << 32)
        return self._with(flat.withColumn("index", F.col("batch") * size + F.col("pos")).drop("batch", "n", "pos"))

    def unlisted(self) -> Dataset:
        flat = batching.unlisted(self.df)
        return self._with(flat.withColumn("index", F.col("batch") * F.lit(1 << 32) + F.col("pos")).drop("batch", "n", "pos"))

    # --- epochs ---

    def repeat(self, times: int, most: int | None = None) -> Dataset:
        out = epochs.repeat(self._indexed().df, "index", times, most)
        return self._with(out.drop("index", "epoch").withColumnRenamed("position", "index"))

    def with_epoch(self, n: int) -> Dataset:
        out = epochs.with_epoch(self._indexed().df, "index", n)
        return self._with(out.drop("index", "epoch").withColumnRenamed("position", "index"))

    def with_length(self, n: int) -> Dataset:
        """A length that ``len`` gives without counting."""
        return replace(self, length=n)

    def __len__(self) -> int:
        return self.df.count() if self.length is None else self.length

    # --- composition and results ---

    def compose(self, *stages: Transform | None) -> Dataset:
        return self._with(project.composed(self.df, *stages))

    def cached(self) -> Dataset:
        """Kept in memory and on disk after the first pass."""
        return self._with(self.df.persist())

    def stored(self, path: str) -> Dataset:
        """Kept as Parquet; a finished table is read again instead of being made anew."""
        spark = self.df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            self.df.write.mode("overwrite").parquet(path)
        return self._with(spark.read.parquet(path))

    def to_batches(self, size: int = 1000) -> Iterator[list[dict[str, Any]]]:
        """Rows in order as lists, for a training loop."""
        held: list[dict[str, Any]] = []
        for row in self:
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def __iter__(self) -> Iterator[dict[str, Any]]:
        """Rows in order, a partition at a time."""
        keys = ["index"] if "index" in self.df.columns else ["batch"] if "batch" in self.df.columns else self._keys()
        for row in self.df.orderBy(*keys).toLocalIterator():
            yield row.asDict(recursive=True)


def mapped(df: DataFrame, keys: Sequence[str], f: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str, image: str | None, only: Sequence[str] | None, handlers: dict[str, Callable[[bytes], Any]] | None, secure: bool, on_error: str, chain: Callable[[str, bytes], Any] | None = None) -> DataFrame:
    """Rows with a map of fields through a Python function, batch by batch; see ``Dataset.map_samples``."""
    import warnings

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from shardloom.functions.codecs import DecodeError, decode_value
    from shardloom.sources.tarscan import POLICIES

    if on_error not in POLICIES:
        raise ValueError(f"unknown policy {on_error}")
    order_part = StructType([field for field in df.schema.fields if field.name in keys])
    result = StructType.fromDDL(schema)
    kind = to_arrow_schema(StructType([*order_part.fields, *result.fields]))
    names = [field.name for field in result.fields]

    def sample_of(row: dict[str, Any]) -> dict[str, Any]:
        out = {k: v for k, v in row.items() if k != "fields" and k not in keys}
        for ext, data in row.get("fields") or []:
            if only is None or ext in only:
                try:
                    out[ext] = decode_value(ext, data, image, secure, handlers) if chain is None else chain(ext, data)
                except Exception as error:
                    raise DecodeError(row.get("__url__"), row.get("__key__"), ext, error) from error
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    made = f(sample_of(row))
                except Exception as error:
                    if on_error == "fail":
                        raise
                    if on_error == "stop":
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        return
                    if on_error == "warn":
                        warnings.warn(repr(error), stacklevel=1)
                    continue
                if made is not None:
                    rows.append({k: row[k] for k in keys} | {n: made.get(n, row.get("__key__") if n == "__key__" else None) for n in names})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return df.mapInArrow(run, StructType([*order_part.fields, *result.fields]))
