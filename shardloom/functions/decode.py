"""Decoding and encoding of common fields as columns; binary formats are in ``codecs``.

``policy``: "fail" stops at a bad value, "skip" gives null for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(data: Column, policy: str = "fail") -> Column:
    """UTF-8 text."""
    return F.decode(data, "utf-8") if policy == "fail" else F.try_validate_utf8(data.cast("string"))


def as_int(data: Column, policy: str = "fail") -> Column:
    """A whole number in decimal, blanks around it allowed."""
    text = F.trim(data.cast("string"))
    return text.cast("long") if policy == "fail" else text.try_cast("long")


def as_json(data: Column, schema: str | None = None, policy: str = "fail") -> Column:
    """JSON by a declared schema, or as a variant without one."""
    text = as_text(data, policy)
    if schema is not None:
        return F.from_json(text, schema, {"mode": "FAILFAST" if policy == "fail" else "PERMISSIVE"})
    return F.parse_json(text) if policy == "fail" else F.try_parse_json(text)


def encode_column(value: Column, kind: str, ext: str) -> Column:
    """A column as the bytes of a file with extension ``ext``; ``kind`` is its Spark type."""
    last = ext.rsplit(".", 1)[-1].lower()
    if kind == "binary":
        return value
    if last in ("json", "jsn") and kind != "string":
        return F.encode(F.to_json(value), "utf-8")
    if last in ("txt", "text", "transcript", "html", "htm", "json", "jsn", "cls", "cls2", "class", "count", "index", "inx", "id"):
        return F.encode(value.cast("string"), "utf-8")
    raise ValueError(f"no encoder for {kind} as {ext}")
