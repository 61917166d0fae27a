"""Writing shards: a tar writer, a rolling writer, and the sink of ``shardtar``."""

from __future__ import annotations

import io
import os
import re
import tarfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import MapType, StructType

from shardloom.functions.codecs import encode_value
from shardloom.sources.opener import Policy, open_url
from shardloom.sources.rolling import Roller

Encoder = Callable[[str, Any], bytes]


def make_encoder(spec: bool | dict[str, Callable[[Any], bytes]] | Encoder = True, secure: bool = True) -> Encoder:
    """An encoder of (extension, value): the usual ones, those with own ones by extension, one of one's own, or bytes only."""
    if spec is True:
        return lambda ext, value: encode_value(ext, value, secure)
    if spec is False:
        def plain(ext: str, value: Any) -> bytes:
            if not isinstance(value, (bytes, bytearray)):
                raise ValueError(f"{ext} must be bytes")
            return bytes(value)

        return plain
    if isinstance(spec, dict):
        return lambda ext, value: spec[ext](value) if ext in spec else encode_value(ext, value, secure)
    return spec


def tar_mode(name: str, compress: bool | str | None = None) -> str:
    """The mode of ``tarfile`` by a wish or, without one, by the end of a file's name."""
    kind = {True: "gz", False: ""}.get(compress, compress) if compress is not None else next((k for k, ends in {"gz": (".gz", ".tgz"), "bz2": (".bz2", ".tbz2"), "xz": (".xz", ".txz")}.items() if name.endswith(ends)), "")
    if kind not in ("", "gz", "bz2", "xz"):
        raise ValueError(f"unknown compression {kind}")
    return f"w|{kind}"


class TarWriter:
    """Samples as members ``key.ext`` in the order of their extensions; other names beginning with ``_`` are left out unless kept."""

    def __init__(self, target: str | Any, compress: bool | str | None = None, encoder: Any = True, keep_meta: bool = False, mode: int = 0o444, user: str = "bigdata", group: str = "bigdata", mtime: float | None = None, secure: bool = True, policy: Policy | None = None):
        self.stream = open_url(target, "wb", policy) if isinstance(target, str) else target
        self.owned = isinstance(target, str)
        self.tar = tarfile.open(fileobj=self.stream, mode=tar_mode(target if self.owned else "", compress), format=tarfile.USTAR_FORMAT)
        self.encode, self.keep_meta = make_encoder(encoder, secure), keep_meta
        self.mode, self.user, self.group, self.mtime = mode, user, group, mtime

    def write(self, sample: dict[str, Any]) -> int:
        """Write a sample with its ``__key__``; returns the bytes of its fields."""
        if not isinstance(sample.get("__key__"), str):
            raise ValueError("a sample needs a __key__")
        total = 0
        for ext in sorted(sample):
            if ext == "__key__" or sample[ext] is None or (ext.startswith("_") and not self.keep_meta):
                continue
            data = self.encode(ext, sample[ext])
            info = tarfile.TarInfo(f"{sample['__key__']}.{ext}")
            info.size, info.mode, info.uname, info.gname = len(data), self.mode, self.user, self.group
            info.mtime = time.time() if self.mtime is None else self.mtime
            self.tar.addfile(info, io.BytesIO(data))
            total += len(data)
        return total

    def close(self) -> None:
        self.tar.close()
        if self.owned:
            self.stream.close()

    def __enter__(self) -> TarWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class ShardWriter:
    """Samples into ``pattern % number``, a new shard when the last one is full by count or bytes."""

    def __init__(self, pattern: str, max_count: int = 100_000, max_size: float = 3e9, start: int = 0, post: Callable[[str], None] | None = None, **options: Any):
        self.pattern, self.post, self.options = pattern, post, options
        self.roller, self.now = Roller(max_count, max_size, start), start
        self.names: list[str] = []
        self._open()

    def _open(self) -> None:
        self.names.append(self.pattern % self.now)
        self.out: TarWriter | None = TarWriter(self.names[-1], **self.options)

    def write(self, sample: dict[str, Any]) -> None:
        shard = self.roller.place(0)
        if shard != self.now:
            self._finish()
            self.now = shard
            self._open()
        self.roller.size += self.out.write(sample)

    def _finish(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            if self.post:
                self.post(self.names[-1])

    def close(self) -> None:
        self._finish()

    def __enter__(self) -> ShardWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShardSink(DataSourceWriter):
    """Each task writes shards below ``_temporary``; the commit names them in task order, an abort removes them.

    Options: ``path``, ``prefix``, ``suffix`` (.tar), ``maxcount``, ``maxsize``,
    ``compression``, ``keep_meta``, ``mtime``.  Columns are fields by their
    names; a column ``fields`` of type map adds its entries.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.options, self.path, self.overwrite = dict(options), options["path"], overwrite
        self.maps = [f.name for f in schema.fields if isinstance(f.dataType, MapType) and f.name == "fields"]
        self.part = os.path.join(self.path, "_temporary", uuid.uuid4().hex)
        if "__key__" not in schema.fieldNames():
            raise ValueError("shards need a column __key__")

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context, o = TaskContext.get(), self.options
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        os.makedirs(self.part, exist_ok=True)
        try:
            return self._write(rows, stem, o)
        except BaseException:  # a failed attempt takes its own files with it
            for name in os.listdir(self.part):
                if name.startswith(stem):
                    os.unlink(os.path.join(self.part, name))
            raise

    def _write(self, rows: Iterator[Row], stem: str, o: dict[str, str]) -> Written:
        writer: ShardWriter | None = None
        for row in rows:
            sample = row.asDict()
            for m in self.maps:
                sample.update(sample.pop(m) or {})
            if writer is None:
                pattern = os.path.join(self.part, stem + "-%06d" + o.get("suffix", ".tar"))
                writer = ShardWriter(pattern, int(o.get("maxcount", 100_000)), float(o.get("maxsize", 3e9)), compress=o.get("compression") or None, keep_meta=o.get("keep_meta") == "true", mtime=float(o["mtime"]) if "mtime" in o else None)
            writer.write({k: v for k, v in sample.items() if k not in ("shard_id", "sample_no")})
        if writer is None:
            return Written([])
        writer.close()
        return Written(writer.names)

    def commit(self, messages: list[Written | None]) -> None:
        suffix, prefix = self.options.get("suffix", ".tar"), self.options.get("prefix", "shard-")
        mine = re.compile(re.escape(prefix) + r"\d{6,}" + re.escape(suffix))
        there = sorted(n for n in os.listdir(self.path) if mine.fullmatch(n)) if os.path.isdir(self.path) else []
        if self.overwrite:
            for name in there:
                os.unlink(os.path.join(self.path, name))
            there = []
        number = int(there[-1][len(prefix) : -len(suffix)]) + 1 if there else 0
        for message in messages:
            for name in message.names if message else []:
                os.replace(name, os.path.join(self.path, f"{prefix}{number:06d}{suffix}"))
                number += 1
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        import shutil

        shutil.rmtree(self.part, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.part))
        except OSError:
            pass


def write_shards(df: DataFrame, path: str, mode: str = "append", **options: Any) -> None:
    """``df`` as shards below a path that all executors share."""
    from shardloom.sources.tarscan import register

    register(df.sparkSession)
    writer = df.write.format("shardtar").mode(mode)
    for k, v in options.items():
        writer = writer.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    writer.save(path)
