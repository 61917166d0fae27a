"""Projections, renames, predicates and mappings over samples.

Samples are rows with one column per field, or rows with a map column of
fields whose names are only known at run time; the functions ending in
``_fields`` take the latter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.naming import expand_braces, glob_to_regex


def select(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which a predicate holds."""
    return df.where(predicate)


def map_columns(df: DataFrame, drop_null: Sequence[str] = (), **new: Column) -> DataFrame:
    """``df`` with columns computed from it; a row whose result in ``drop_null`` is null is dropped."""
    out = df.withColumns(new)
    return out.dropna(subset=list(drop_null)) if drop_null else out


def map_dict(df: DataFrame, **functions: Callable[[Column], Column]) -> DataFrame:
    """Each named column transformed; an unknown name is an error."""
    missing = sorted(set(functions) - set(df.columns))
    if missing:
        raise KeyError(f"no column {missing[0]}")
    return df.withColumns({k: f(F.col(k)) for k, f in functions.items()})


def map_tuple(df: DataFrame, *functions: Callable[[Column], Column] | None) -> DataFrame:
    """The leading columns transformed by position; None leaves a column, surplus functions are ignored."""
    pairs = zip(df.columns, [*functions, *[None] * max(0, len(df.columns) - len(functions))])
    return df.select(*[(F.col(c) if f is None else f(F.col(c))).alias(c) for c, f in pairs])


def _alternatives(spec: str | Sequence[str]) -> list[str]:
    return spec.split(";") if isinstance(spec, str) else list(spec)


def first_present(df: DataFrame, spec: str | Sequence[str]) -> str | None:
    """The first of several alternatives that is a column of ``df``."""
    return next((a for a in _alternatives(spec) if a in df.columns), None)


def first_field(fields: Column | str, spec: str | Sequence[str]) -> Column:
    """The value of the first alternative that the map holds, be it null; null if it holds none."""
    m = F.col(fields) if isinstance(fields, str) else fields
    out = F.lit(None)
    for name in reversed(_alternatives(spec)):
        out = F.when(F.map_contains_key(m, name), m[name]).otherwise(out)
    return out


def to_tuple(df: DataFrame, *specs: str, missing_is_error: bool = True, none_is_error: bool | None = None) -> DataFrame:
    """Columns ``_0, _1, ...``, each the first alternative of a specification that is there.

    One string may hold several specifications between blanks.  A null fails
    when it is computed unless ``none_is_error`` is false.
    """
    specs = tuple(specs[0].split()) if len(specs) == 1 else specs
    strict = missing_is_error if none_is_error is None else none_is_error
    out = []
    for k, spec in enumerate(specs):
        name = first_present(df, spec)
        if name is None and missing_is_error:
            raise KeyError(f"none of {spec} is a column")
        value = F.col(name) if name else F.lit(None)
        if strict:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{spec} is null"))).otherwise(value)
        out.append(value.alias(f"_{k}"))
    return df.select(*out)


def to_tuple_fields(df: DataFrame, *specs: str, fields: str = "fields", missing_is_error: bool = True) -> DataFrame:
    """``to_tuple`` over a map column; a missing field fails for its row."""
    specs = tuple(specs[0].split()) if len(specs) == 1 else specs
    out = []
    for k, spec in enumerate(specs):
        there = reduce(lambda a, b: a | b, [F.map_contains_key(fields, n) for n in _alternatives(spec)])
        value = first_field(fields, spec)
        if missing_is_error:
            value = F.when(there, value).otherwise(F.raise_error(F.concat(F.lit(f"{spec} is not among "), F.array_join(F.map_keys(fields), " "))))
        out.append(value.alias(f"_{k}"))
    return df.select(*out)


def rename(df: DataFrame, keep: bool = True, **spec: str) -> DataFrame:
    """New names for the first alternatives that are there.

    With ``keep`` all alternatives go and the other columns stay; without, the
    new columns alone are left.
    """
    new = {}
    for name, old in spec.items():
        found = first_present(df, old)
        if found is None:
            raise KeyError(f"none of {old} is a column")
        new[name] = F.col(found).alias(name)
    if not keep:
        return df.select(*new.values())
    gone = {a for old in spec.values() for a in _alternatives(old)} | set(spec)
    return df.select(*[c for c in df.columns if c not in gone], *new.values())


def _matches(name: str, pattern: str) -> bool:
    return any(fnmatchcase(name, p) for p in expand_braces(pattern))


def rename_keys(df: DataFrame, *pairs: tuple[str, str], keep_unselected: bool = False, must_match: bool = True, duplicate_is_error: bool = True, **spec: str) -> DataFrame:
    """Columns renamed by globs on their lower-cased base names; of several that match, the last pattern counts."""
    rules = [*pairs, *spec.items()]
    out: dict[str, Column] = {}
    used: set[str] = set()
    for c in df.columns:
        base = re.sub(r".*/", "", c).lower()
        hits = [new for new, pattern in rules if _matches(base, pattern)]
        used |= set(hits)
        name = hits[-1] if hits else c if keep_unselected else None
        if name is None:
            continue
        if name in out and duplicate_is_error:
            raise ValueError(f"two columns for {name}")
        out[name] = F.col(c).alias(name)
    unused = [new for new, _ in rules if new not in used]
    if must_match and unused:
        raise ValueError(f"nothing matches the pattern for {unused[0]}")
    return df.select(*out.values())


def rename_fields(df: DataFrame, *pairs: tuple[str, str], fields: str = "fields", keep_unselected: bool = False, **spec: str) -> DataFrame:
    """``rename_keys`` over the keys of a map; two fields of one name fail when they are computed."""
    def name(k: Column) -> Column:
        base = F.lower(F.regexp_replace(k, r".*/", ""))
        out = k if keep_unselected else F.lit(None).cast("string")
        for new, pattern in [*pairs, *spec.items()]:  # the last that matches counts
            out = F.when(base.rlike(glob_to_regex(pattern)), F.lit(new)).otherwise(out)
        return out

    kept = F.map_filter(fields, lambda k, v: name(k).isNotNull())
    return df.withColumn(fields, F.transform_keys(kept, lambda k, v: name(k)))


def extract_keys(df: DataFrame, *patterns: str, duplicate_is_error: bool = True, ignore_missing: bool = False) -> DataFrame:
    """Columns ``_0, ...`` picked by globs with alternatives, matched against the name or the name after a dot."""
    out = []
    for pattern in patterns:
        hits = [c for c in df.columns if any(_matches(c, p) or _matches("." + c, p) for p in pattern.split(";"))]
        if len(hits) > 1 and duplicate_is_error:
            raise ValueError(f"{pattern} matches {hits}")
        if not hits and not ignore_missing:
            raise ValueError(f"nothing matches {pattern}")
        if hits:
            out.append(F.col(hits[0]).alias(f"_{len(out)}"))
    return df.select(*out)


def extract_fields(df: DataFrame, *patterns: str, fields: str = "fields", ignore_missing: bool = False, name: str = "values") -> DataFrame:
    """``name``: the map's values picked by globs, one after another; shorter where fields are missing and that is allowed."""
    parts = []
    for pattern in patterns:
        tests = lambda k: reduce(lambda a, b: a | b, [k.rlike(glob_to_regex(p)) | F.concat(F.lit("."), k).rlike(glob_to_regex(p)) for p in pattern.split(";")])  # noqa: B023, E731
        hits = F.map_values(F.map_filter(fields, lambda k, v: tests(k)))  # noqa: B023
        if not ignore_missing:
            hits = F.when(F.size(hits) == 1, hits).otherwise(F.raise_error(F.lit(f"{pattern} must match one field")))
        parts.append(F.slice(hits, 1, 1))
    return df.select(*[c for c in df.columns if c != fields], F.concat(*parts).alias(name))


def dispatch(name: Column, value: Column, *rules: tuple[str, Callable[[Column], Column] | bool], must_decode: bool = True) -> Column:
    """A value decoded by the last glob that matches its name; False passes it on, no match fails or passes it on."""
    out = F.raise_error(F.concat(F.lit("no decoder for "), name)) if must_decode else value
    for pattern, decoder in rules:
        out = F.when(name.rlike(glob_to_regex(pattern)), value if decoder is False else decoder(value)).otherwise(out)
    return out


def info(df: DataFrame, n: int = 3, width: int = 50) -> DataFrame:
    """``df``, after its first rows were printed."""
    df.show(n, truncate=width)
    return df


def key_log(df: DataFrame, key: str, index: str, worker: int = 0, rank: int = 0) -> DataFrame:
    """The log of keys as a table: ``i, worker, rank, key``."""
    return df.select(F.col(index).alias("i"), F.lit(worker).alias("worker"), F.lit(rank).alias("rank"), F.col(key).cast("string").alias("key"))


def composed(df: DataFrame, *stages: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Stages applied one after another; None is skipped."""
    for stage in stages:
        df = df if stage is None else df.transform(stage)
    return df


def valid(df: DataFrame, fields: str = "fields", bad: str = "__bad__") -> DataFrame:
    """Samples that hold a field and aren't marked as bad; a column or map that isn't there rejects nothing."""
    out = df
    if bad in df.columns:
        out = out.where(~F.coalesce(F.col(bad).cast("boolean"), F.lit(False)))
    return out.where(F.coalesce(F.size(fields), F.lit(0)) > 0) if fields in df.columns else out
