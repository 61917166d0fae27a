"""Joins of samples with side tables and with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def associate(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``df`` with the side table's columns; where a key is found these replace columns of the same name, else nothing changes.

    The side table's key must be unique.  Spark broadcasts it if its size allows.
    """
    other = side.withColumn("__hit", F.lit(True)).alias("r")
    joined = df.alias("l").join(other, F.col(f"l.{key}") == F.col(f"r.{key}"), "left")
    out = []
    for c in df.columns:
        if c != key and c in side.columns:
            out.append(F.when(F.col("__hit"), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c))
        else:
            out.append(F.col(f"l.{c}"))
    return joined.select(*out, *[F.col(f"r.{c}") for c in side.columns if c not in df.columns])


def zip_columns(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """A column store put together again: rows with equal keys, columns of both sides; with ``strict`` a lone row fails.

    Columns of the same name come from the right.
    """
    l, r = left.withColumn("__l", F.lit(1)).alias("l"), right.withColumn("__r", F.lit(1)).alias("r")
    both = l.join(r, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], "full" if strict else "inner")
    ok = F.assert_true(F.col("__l").isNotNull() & F.col("__r").isNotNull(), F.lit("a key is on one side only"))
    if strict:
        both = both.where(ok.isNull())
    names = [c for c in left.columns if c in keys or c not in right.columns]
    return both.select(*[F.col(f"l.{c}") for c in names], *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def zip_rows(left: DataFrame, right: DataFrame, index: str = "index") -> DataFrame:
    """Two indexed frames side by side as far as both go; columns of the same name come from the right."""
    names = [c for c in left.columns if c == index or c not in right.columns]
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{index}") == F.col(f"r.{index}"))
    return both.select(*[F.col(f"l.{c}") for c in names], *[F.col(f"r.{c}") for c in right.columns if c != index])


def members(df: DataFrame, side: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is (or is not) among the side table's."""
    return df.join(side.select(key), key, "left_semi" if inside else "left_anti")
