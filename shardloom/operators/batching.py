"""Batches: consecutive rows as one, and back; grouping of files into samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: Column | str, order: Sequence[str], shard: str | None = None, name: str = "run") -> DataFrame:
    """``df`` with the number of its run: neighbours with equal keys, counted from 1 in each shard.

    Rows without a key are dropped first, so that they do not break a run.
    """
    k = F.col(key) if isinstance(key, str) else key
    w = Window.partitionBy(shard).orderBy(*order) if shard else Window.orderBy(*order)
    held = df.withColumn("__key", k).where("__key is not null")
    starts = F.when(F.lag("__key").over(w) == F.col("__key"), 0).otherwise(1)
    marked = held.withColumn("__start", starts)
    return marked.withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__key", "__start")


def group_files(files: DataFrame, shard: str = "shard_id", pos: str = "pos", suffixes: Sequence[str] | None = None, on_duplicate: str = "fail") -> DataFrame:
    """Samples from files ``shard, pos, key, ext, data``: neighbours with one key become a row with a map of fields.

    A suffix twice in a sample fails, or with ``on_duplicate="first"`` keeps
    the first.  Files with other than the wanted suffixes are left out of the
    map only, so a sample may have no field.
    """
    held = runs(files, "key", [pos], shard)
    wanted = F.col("ext").isin(list(suffixes)) if suffixes is not None else F.lit(True)
    entry = F.when(wanted, F.struct(F.col(pos).alias("pos"), F.col("ext").alias("ext"), F.col("data").alias("data")))
    grouped = held.groupBy(shard, "run", "key").agg(F.min(pos).alias("__first"), F.array_sort(F.collect_list(entry)).alias("__files"))
    names, values = F.transform("__files", lambda f: f["ext"]), F.transform("__files", lambda f: f["data"])
    if on_duplicate == "first":
        kept = F.filter("__files", lambda f: F.array_position(names, f["ext"]) == F.array_position(F.transform("__files", lambda g: g["pos"]), f["pos"]))
        names, values = F.transform(kept, lambda f: f["ext"]), F.transform(kept, lambda f: f["data"])
    once = F.assert_true(F.size(F.array_distinct(names)) == F.size(names), F.concat(F.lit("a suffix twice in "), F.col("key")))
    fields = F.map_from_arrays(names, values)
    if on_duplicate != "first":
        fields = F.when(once.isNull(), fields)
    return grouped.select(shard, (F.col("run") - 1).alias("sample_no"), F.col("key").alias("__key__"), fields.alias("fields"))


def batched(df: DataFrame, index: str, size: int = 20, partial: bool = True, columns: Sequence[str] | None = None, name: str = "batch") -> DataFrame:
    """One row per ``size`` consecutive rows: ``batch``, ``n`` and each column as an array in order.

    Nulls stay in their places.  Without ``partial`` a shorter last batch is dropped.
    """
    if size < 1:
        raise ValueError("a batch holds a row at least")
    names = list(columns) if columns is not None else [c for c in df.columns if c != index]
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("__i"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])))
    grouped = df.groupBy(F.floor(F.col(index) / size).cast("long").alias(name)).agg(rows.alias("__rows"))
    if not partial:
        grouped = grouped.where(F.size("__rows") == size)
    return grouped.select(name, F.size("__rows").alias("n"), *[F.col(f"__rows.c{k}").alias(c) for k, c in enumerate(names)])


def listed(df: DataFrame, index: str, size: int = 20, partial: bool = True, name: str = "batch") -> DataFrame:
    """``batched`` without collation: ``batch, n, rows``, an array of structs in order."""
    names = [c for c in df.columns if c != index]
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("__i"), F.struct(*names).alias("row"))))
    grouped = df.groupBy(F.floor(F.col(index) / size).cast("long").alias(name)).agg(rows.alias("__rows"))
    if not partial:
        grouped = grouped.where(F.size("__rows") == size)
    return grouped.select(name, F.size("__rows").alias("n"), F.col("__rows.row").alias("rows"))


def unbatched(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Batches of equally long arrays as rows, with ``pos`` in the batch; unequal lengths fail."""
    first = F.size(columns[0])
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(c) == first)
    ok = F.assert_true(same, F.lit("columns of a batch differ in length"))
    rest = [c for c in df.columns if c not in columns]
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    flat = df.where(ok.isNull()).select(*rest, F.posexplode(zipped).alias("pos", "__row"))
    return flat.select(*rest, "pos", *[F.col(f"__row.{c}").alias(c) for c in columns])


def unlisted(df: DataFrame, rows: str = "rows") -> DataFrame:
    """Lists as rows, with ``pos`` in the list."""
    rest = [c for c in df.columns if c != rows]
    return df.select(*rest, F.posexplode(rows).alias("pos", "__row")).select(*rest, "pos", "__row.*")


def batched_in_partitions(df: DataFrame, size: int, collate: Callable[[dict[str, list]], dict[str, Any]], schema: str, partial: bool = True) -> DataFrame:
    """Batches inside each partition, with any collation of columns to one row; no exchange.

    As with independent workers, each partition has a last batch of its own.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= size:
                row = collate(held.slice(0, size).to_pydict())
                held = held.slice(size)
                yield pa.RecordBatch.from_pylist([row], schema=kind)
        if partial and held is not None and held.num_rows:
            yield pa.RecordBatch.from_pylist([collate(held.to_pydict())], schema=kind)

    return df.mapInArrow(run, schema)


def same_shape(arrays: Column) -> Column:
    """Whether all arrays in an array have one length, so that they can be stacked."""
    sizes = F.transform(arrays, F.size)
    return F.size(F.array_distinct(sizes)) <= 1


def stacked(arrays: Column) -> Column:
    """Equally long arrays as one flat array in row order, null if their lengths differ."""
    return F.when(same_shape(arrays), F.flatten(arrays))


def sample_weights(df: DataFrame, n: str, weight: str, name: str = "share") -> DataFrame:
    """``n * weight`` of each row against the largest such product."""
    product = F.col(n) * F.col(weight)
    top = df.agg(F.max(product).alias("__top"))
    return df.join(F.broadcast(top), F.lit(True)).withColumn(name, product / F.col("__top")).drop("__top")
