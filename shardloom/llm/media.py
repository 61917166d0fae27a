"""Media columns (operator 9): interleaved document sequences with stored payloads.

``interleave`` parses pages into ordered sequences of text and media-reference
structs with positions and captions; ``store`` turns payloads into 8-bit RGB
images (PNG, 64 pixels or 192 samples a row, no loss) with a digest, to be
written as a table; ``described`` reads the written bytes back and computes
features from the pixels; ``resolve`` joins the references to the described
media by digest and puts each sequence together again in order.  Only digests,
sizes and features are shuffled, never payloads.  Digests that many references
share are spread.

The query makes a sequence of one reference for every document, stores the
payloads, reads them back and resolves the sequences.

Rows: one per input row, told apart by a number of their own, so repeated and
null ids keep their sequences.  A null or empty text is one row of 192 blanks;
a null or empty page is an empty sequence.  Payloads and pages are handed to
Python in batches of 2 MB, and very long ones one at a time.  Equal texts give equal values; a payload that a task has stored
lately is not stored again.  References without a stored payload keep a null.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import hot_keys, salted_join, small_batches, table, text_of, written

#: Samples in a row of pixels.
ROW = 192
_SIGN = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
#: Digests that a task remembers, so as not to store a payload again, and bytes in one batch.
SEEN, BATCH_BYTES = 100_000, 2 << 20
DESCRIBED = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(data: bytes) -> bytes:
    """``data`` filled with blanks to a positive multiple of ROW."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def encode(payload: bytes) -> bytes:
    """A PNG of 8-bit RGB samples whose rows are ROW bytes of the payload."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # filter type 0 before each row
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGN + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(stored: bytes) -> np.ndarray:
    """The samples of such a PNG, one row of ROW each; checks the sign, the sums and the header."""
    if stored[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, data, width, height = 8, b"", 0, 0
    while at < len(stored):
        size, name = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(name + body):
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            width, height, *kind = struct.unpack(">IIBBBBB", body)
            if kind != [8, 2, 0, 0, 0]:
                raise ValueError("not 8-bit RGB")
        elif name == b"IDAT":
            data += body
        at += size + 12
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 3 * width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered PNG")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of each colour, and a 64-bit hash of the brightness in 8 by 8 fields against its mean."""
    pixels = samples.reshape(len(samples), -1, 3)
    height = len(pixels)
    total = pixels.sum(axis=1, dtype=np.int64)  # by row and colour
    count = pixels.shape[0] * pixels.shape[1]
    mean = total.sum(axis=0) / count
    squares = np.einsum("ijk,ijk->k", pixels, pixels, dtype=np.int64, casting="unsafe")
    deviation = np.sqrt(np.maximum(squares / count - mean**2, 0))
    grey = samples.reshape(height, 8, -1).sum(axis=2, dtype=np.int64)
    bounds = np.arange(8) * height // 8
    fields = np.add.reduceat(grey, bounds, axis=0) / np.maximum(np.diff(np.append(bounds, height)), 1)[:, None]
    bits = int("".join("1" if x else "0" for x in (fields > fields.mean()).ravel()), 2)
    return ",".join(f"{x:.4f}" for x in [*mean, *deviation]) + f",{bits:016x}"


def store(payloads: DataFrame, data: str = "data") -> DataFrame:
    """``digest, n_bytes, media`` of the rows of ``payloads`` (binary column ``data``), ready to be written.

    The digest is the SHA-256 of the data as given, null counting as empty.
    Payloads that a task has met lately come once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for value in batch.column(0):
                raw = value.as_py() or b""
                digest = hashlib.sha256(raw)
                if digest.digest() in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest.digest())
                rows.append((digest.hexdigest(), len(raw), encode(payload_of(raw))))
                held += len(rows[-1][2])
                if held >= BATCH_BYTES:
                    yield _batch(rows, "digest string, n_bytes long, media binary")
                    rows, held = [], 0
        if rows:
            yield _batch(rows, "digest string, n_bytes long, media binary")

    return payloads.select(F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data")).mapInArrow(run, "digest string, n_bytes long, media binary")


def described(stored: DataFrame) -> DataFrame:
    """What DESCRIBED lists, one row for each digest, from the media bytes of a stored table; they are read here and now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for digest, n_bytes, media in zip(batch.column("digest"), batch.column("n_bytes"), batch.column("media")):
                media = media.as_py()
                samples = decode(media)
                back = samples.tobytes()
                rows.append((digest.as_py(), n_bytes.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
                if len(rows) >= 1000:
                    yield _batch(rows, DESCRIBED)
                    rows = []
            if rows:
                yield _batch(rows, DESCRIBED)

    with small_batches(stored.sparkSession):
        found = written(stored.select("digest", "n_bytes", "media").mapInArrow(run, DESCRIBED), "zstd")  # digests in hex take half the bytes
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in found.columns[1:]])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, types[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


class _Sequence(HTMLParser):
    """Events of a page as ordered items: texts, and references of images, audio and video with captions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.figure: list[int] | None = None  # items of the open figure
        self.caption: list[str] | None = None
        self.silent = 0

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line:
            self.items.append({"kind": "text", "text": line, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(attrs)
        if tag in ("script", "style", "head", "template"):
            self.silent += 1
        elif tag in ("img", "audio", "video", "source", "embed") and (values.get("data-digest") or values.get("src")):
            self.flush()
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"kind": "media", "text": None, "digest": values.get("data-digest") or hashlib.sha256(values["src"].encode()).hexdigest(), "caption": values.get("alt")})
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "template"):
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for k in self.figure or []:
                self.items[k]["caption"] = text
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The items of one page in order, positions from 0."""
    try:
        parser = _Sequence()
        parser.feed(html or "")
        parser.close()
    except AssertionError:
        parser = _Sequence()
        parser.feed((html or "").replace("<![", "&lt;!["))
        parser.close()
    parser.flush()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def interleave(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """``row`` (a number of the row's own), ``id`` and ``items``, the ordered text and media-reference structs of each page."""
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                items = pa.array([sequence_of(x) for x in part.column("html").to_pylist()], pa.list_(item))
                yield pa.record_batch({"row": pa.array(range(row, row + part.num_rows), pa.int64()), "id": part.column("id"), "items": items})
                row += part.num_rows

    kind = pages.schema[id].dataType.simpleString()
    return pages.select(F.col(id).alias("id"), text_of(html).alias("html")).mapInArrow(run, f"row long, id {kind}, items array<{ITEM}>").withColumnRenamed("id", id)


def resolve(sequences: DataFrame, media: DataFrame, id: str = "page_id") -> DataFrame:
    """``row``, ``id`` and ``items``, each reference with what ``media`` (of ``described``) has of it, or nulls, in order."""
    columns = [x.split()[0] for x in DESCRIBED.split(", ")[1:]]
    with small_batches(sequences.sparkSession):
        kept = written(sequences)
    flat = kept.select("row", F.col(id).alias("id"), F.explode_outer("items").alias("item")).select("row", "id", "item.*")
    parts = F.when(F.col("position").isNotNull(), F.struct("position", "kind", "text", "digest", "caption", *columns))
    texts = flat.where("digest is null").select("row", "id", *[F.col(c) for c in ("position", "kind", "text", "digest", "caption")], *[F.lit(None).cast(media.schema[c].dataType).alias(c) for c in columns])
    refs = flat.where("digest is not null")
    found = salted_join(refs, media.select("digest", *columns), ["digest"], ["row", "position"], "left", hot_keys(refs, ["digest"], kept.count()))
    every = texts.unionByName(found.select(*texts.columns))
    return every.groupBy("row", "id").agg(F.array_sort(F.collect_list(parts)).alias("items")).withColumnRenamed("id", id)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sequence of one reference, resolved against the stored payloads as read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").cast("binary").alias("data"))
    with small_batches(spark):
        stored = written(store(docs), "none")  # PNGs don't get any smaller
    page = F.concat(F.lit('<img data-digest="'), F.sha2("data", 256), F.lit('">'))
    sequences = interleave(docs.select("doc_id", page.alias("html")), "doc_id")
    found = resolve(sequences, described(stored), "doc_id").select("doc_id", F.get("items", F.lit(0)).alias("item"))
    columns = [x.split()[0] for x in DESCRIBED.split(", ")[1:]]
    return found.select("doc_id", *[F.col(f"item.{c}").alias(c) for c in columns], F.col("item.digest").alias("digest"))
