"""The ``shardtar`` data source: tar archives as files or samples, one partition per shard.

Rows of ``layout="files"``: ``shard_id, pos, __url__, fname, key, ext, data``.
Rows of ``layout="samples"``: ``shard_id, sample_no, __key__, __url__,
__local_path__, fields``, neighbours with one key as a map of fields.  Archives
are read as streams, whatever their compression, and given to Spark in Arrow
batches of bounded bytes.  Spark prunes no columns of Python sources, so the
wanted extensions are an option (``exts``), and predicates on ``key``, ``ext``
and ``fname`` of the files layout are pushed down: the bytes of other members
are skipped.

Error policies: ``fail``; ``skip`` and ``warn`` leave out a bad member or what
is left of a broken archive; ``stop`` ends the partition, which is a shard.
"""

from __future__ import annotations

import base64
import json
import re
import tarfile
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from shardloom.functions.naming import expand_source, split_name
from shardloom.sources.opener import FileCache, Policy, is_local, open_url

FILES = "shard_id long, pos long, __url__ string, fname string, key string, ext string, data binary"
SAMPLES = "shard_id long, sample_no long, __key__ string, __url__ string, __local_path__ string, fields map<string,binary>"
META = r"^__[^/]*__($|/)"
POLICIES = ("fail", "skip", "warn", "stop")
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2000


class ShardError(OSError):
    """An error with the shard and member where it happened."""


@dataclass
class Shard(InputPartition):
    number: int
    url: str


@dataclass
class Settings:
    """What a scan does; callables are for members' names."""

    on_error: str = "fail"
    lower: bool = True
    exts: tuple[str, ...] | None = None
    skip_meta: str | None = META
    select_files: Callable[[str], bool] | None = None
    rename_files: Callable[[str], str] | None = None
    split: Callable[[str], tuple[str, str] | None] = split_name
    secure: bool = True
    local: bool = True
    rewrites: str = ""
    cache_dir: str | None = None
    cache_bytes: int = -1
    equals: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.on_error not in POLICIES:
            raise ValueError(f"unknown policy {self.on_error}")


class _Stop(Exception):
    pass


def _handle(settings: Settings, where: str, error: BaseException) -> None:
    """Go on, or raise, as the policy says."""
    if settings.on_error == "fail":
        raise ShardError(f"{where}: {error!r}") from error
    if settings.on_error == "stop":
        raise _Stop
    if settings.on_error == "warn":
        warnings.warn(f"{where}: {error!r}", stacklevel=2)


def members(stream: Any, settings: Settings, where: str) -> Iterator[tuple[str, bytes]]:
    """Names and bytes of the regular files of an archive; names are changed first, then selected."""
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for info in tar:
                tar.members = []  # else the archive's whole listing stays in memory
                name = info.name
                if not info.isreg() or (settings.skip_meta and re.search(settings.skip_meta, name)):
                    continue
                if settings.rename_files:
                    name = settings.rename_files(name)
                if settings.select_files and not settings.select_files(name):
                    continue
                if settings.equals and not _wanted(name, settings):
                    continue
                data = tar.extractfile(info).read()
                if len(data) < info.size:
                    raise tarfile.ReadError("the archive ends within a member")
                yield name, data
    except (tarfile.TarError, EOFError, OSError) as error:
        if isinstance(error, ShardError):
            raise
        _handle(settings, where, error)


def _wanted(name: str, settings: Settings) -> bool:
    parts = settings.split(name)
    ext = parts and (parts[1].lower() if settings.lower else parts[1])
    values = {"fname": name, "key": parts and parts[0], "ext": ext}
    return all(values[k] in allowed for k, allowed in settings.equals.items())


def samples_of(files: Iterable[tuple[str, bytes]], settings: Settings, where: str) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Keys and fields of neighbours with one key; names without a key don't break a run.

    A suffix twice among the kept ones is an error; if that is passed over, the first stays.
    """
    now: str | None = None
    fields: dict[str, bytes] = {}
    for name, data in files:
        parts = settings.split(name)
        if parts is None:
            continue
        key, ext = parts[0], parts[1].lower() if settings.lower else parts[1]
        if key != now:
            if now is not None:
                yield now, fields
            now, fields = key, {}
        if settings.exts is None or ext in settings.exts:
            if ext in fields:
                _handle(settings, f"{where}: {name}", ValueError(f"suffix {ext} twice in a sample"))
            else:
                fields[ext] = data
    if now is not None:
        yield now, fields


class ShardReader(DataSourceReader):
    def __init__(self, urls: list[str], layout: str, settings: Settings):
        self.urls, self.layout, self.settings = urls, layout, settings

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            known = self.layout == "files" and name in ("fname", "key", "ext")
            if known and isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.settings.equals[name] = self.settings.equals.get(name, values) & values
            elif not (known and isinstance(f, IsNotNull) and name == "fname"):
                yield f

    def partitions(self) -> list[Shard]:
        return [Shard(k, u) for k, u in enumerate(self.urls)]

    def _files(self, url: str) -> Iterator[tuple[str, bytes]]:
        s = self.settings
        policy = Policy(s.secure, s.local, s.rewrites)
        where = FileCache(s.cache_dir, s.cache_bytes).path(url, policy) if s.cache_dir and not is_local(url) else url
        try:
            stream = open_url(where, "rb", policy)
        except OSError as error:
            _handle(s, url, error)
            return
        with stream:
            yield from members(stream, s, url)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        rows = self._file_rows(partition) if self.layout == "files" else self._sample_rows(partition)
        kind = FILE_TYPE if self.layout == "files" else SAMPLE_TYPE
        held: list[tuple] = []
        size = 0
        try:
            for row, n in rows:
                held.append(row)
                size += n
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield _batch(held, kind)
                    held, size = [], 0
        except _Stop:
            pass
        if held:
            yield _batch(held, kind)

    def _file_rows(self, shard: Shard) -> Iterator[tuple[tuple, int]]:
        for pos, (name, data) in enumerate(self._files(shard.url)):
            key, ext = self.settings.split(name) or (None, None)
            ext = ext.lower() if ext is not None and self.settings.lower else ext
            if self.settings.exts is None or ext in self.settings.exts:
                yield (shard.number, pos, shard.url, name, key, ext, data), len(data)

    def _sample_rows(self, shard: Shard) -> Iterator[tuple[tuple, int]]:
        local = re.sub(r"^file:(//)?", "", shard.url) if is_local(shard.url) else None
        for n, (key, fields) in enumerate(samples_of(self._files(shard.url), self.settings, shard.url)):
            yield (shard.number, n, key, shard.url, local, list(fields.items())), sum(map(len, fields.values()))


FILE_TYPE = pa.schema([("shard_id", pa.int64()), ("pos", pa.int64()), ("__url__", pa.string()), ("fname", pa.string()), ("key", pa.string()), ("ext", pa.string()), ("data", pa.binary())])
SAMPLE_TYPE = pa.schema([("shard_id", pa.int64()), ("sample_no", pa.int64()), ("__key__", pa.string()), ("__url__", pa.string()), ("__local_path__", pa.string()), ("fields", pa.map_(pa.string(), pa.binary()))])


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


class ShardTar(DataSource):
    """``spark.read.format("shardtar")``; ``spec`` is the option that ``read_shards`` writes, or give ``urls`` and plain options."""

    @classmethod
    def name(cls) -> str:
        return "shardtar"

    def schema(self) -> str:
        return FILES if self.options.get("layout", "samples") == "files" else SAMPLES

    def reader(self, schema: StructType) -> ShardReader:
        o = self.options
        urls = json.loads(o["urls"]) if o.get("urls", "").startswith("[") else expand_source(o.get("urls") or o["path"])
        if "settings" in o:
            settings = cloudpickle.loads(base64.b64decode(o["settings"]))
        else:
            exts = o.get("exts")
            settings = Settings(on_error=o.get("on_error", "fail"), lower=o.get("lower", "true") == "true", exts=tuple(exts.split(",")) if exts else None)
        return ShardReader(urls, o.get("layout", "samples"), settings)

    def writer(self, schema: StructType, overwrite: bool) -> Any:
        from shardloom.sources.tarwrite import ShardSink

        return ShardSink(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with predicates pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardTar)


def read_shards(spark: SparkSession, urls: str | list[str], layout: str = "samples", **settings: Any) -> DataFrame:
    """Shards as files or samples; ``settings`` are those of ``Settings``."""
    register(spark)
    packed = base64.b64encode(cloudpickle.dumps(Settings(**settings))).decode()
    return spark.read.format("shardtar").options(urls=json.dumps(expand_source(urls)), layout=layout, settings=packed).load()
