"""Binary formats of fields: tensors, arrays, compression and optional libraries.

Decoders take bytes, encoders give bytes.  ``secure`` (the default) refuses
formats that can run code when they are read.
"""

from __future__ import annotations

import gzip
import io
import json
import pickle
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENSOR = "struct<dtype:string,shape:array<bigint>,data:binary>"

# --- tensor lists: 64-byte aligned chunks, little-endian ---

_MAGIC = b"~TenBin~"
_CODES = {"f2": "float16", "f4": "float32", "f8": "float64", "i1": "int8", "i2": "int16", "i4": "int32", "i8": "int64", "u1": "uint8", "u2": "uint16", "u4": "uint32", "u8": "uint64"}
_SHORT = {np.dtype(v): k for k, v in _CODES.items()}


def _chunk(payload: bytes) -> bytes:
    return _MAGIC + struct.pack("<q", len(payload)) + payload + b"\0" * (-len(payload) % 64)


def _name(text: str) -> bytes:
    raw = text.encode("ascii")
    if len(raw) > 8:
        raise ValueError("names have 8 bytes at most")
    return raw.ljust(8, b"\0")


def tensors_to_bytes(arrays: list[np.ndarray], infos: list[str] | None = None) -> bytes:
    """A list of arrays (fewer than 10 axes) as header and data chunks; ``infos`` are short names."""
    if infos is not None and len(infos) != len(arrays):
        raise ValueError("one name for each array")
    out = []
    for k, a in enumerate(arrays):
        a = np.asarray(a)
        kind = a.dtype.newbyteorder("=")
        if kind not in _SHORT or a.ndim >= 10:
            raise ValueError(f"no tensor form for {a.dtype} with {a.ndim} axes")
        head = _name(_SHORT[kind]) + _name(infos[k] if infos else "") + struct.pack(f"<{a.ndim + 1}q", a.ndim, *a.shape)
        out += [_chunk(head), _chunk(np.ascontiguousarray(a, dtype=kind.newbyteorder("<")).tobytes())]
    return b"".join(out)


def _chunks(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        if data[at : at + 8] != _MAGIC:
            raise ValueError("no chunk begins here")
        (size,) = struct.unpack_from("<q", data, at + 8)
        if size < 0 or at + 16 + size > len(data):
            raise ValueError("a chunk is cut short")
        yield data[at + 16 : at + 16 + size]
        at += 16 + size + (-size % 64)


def tensors_from_bytes(data: bytes, infos: bool = False) -> list[np.ndarray] | tuple[list[np.ndarray], list[str]]:
    """The arrays of such bytes, and with ``infos`` their names too."""
    arrays, names, parts = [], [], list(_chunks(data))
    if len(parts) % 2:
        raise ValueError("a header without data")
    for head, body in zip(parts[::2], parts[1::2]):
        code = head[:8].rstrip(b"\0").decode("ascii")
        (axes,) = struct.unpack_from("<q", head, 16)
        if code not in _CODES or not 0 <= axes < 10:
            raise ValueError("unknown tensor header")
        shape = struct.unpack_from(f"<{axes}q", head, 24)
        arrays.append(np.frombuffer(body, dtype=np.dtype(_CODES[code]).newbyteorder("<")).reshape(shape))
        names.append(head[8:16].rstrip(b"\0").decode("ascii"))
    return (arrays, names) if infos else arrays


def save_tensors(path: str, *arrays: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(tensors_to_bytes(list(arrays)))


def load_tensors(path: str) -> list[np.ndarray]:
    with open(path, "rb") as f:
        return tensors_from_bytes(f.read())


# --- single formats ---


def npy_to_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(a), allow_pickle=False)
    return out.getvalue()


def npy_from_bytes(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def npz_to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def npz_from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def _optional(module: str, *names: str) -> Callable[[Any], Any]:
    def run(value: Any) -> Any:
        import importlib

        try:
            found = importlib.import_module(module)
        except ImportError as e:
            raise RuntimeError(f"this format needs {module}") from e
        for n in names:
            found = getattr(found, n)
        return found(value)

    return run


def _images(data: bytes, spec: str) -> Any:
    """An image as ``spec`` says: l, rgb or rgba for floats from 0 to 1, with 8 at the end for bytes, with pil before for an image object."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("images need PIL") from e
    image = Image.open(io.BytesIO(data)).convert(spec.removeprefix("pil").removeprefix("torch").rstrip("8").upper() or "RGB")
    if spec.startswith("pil"):
        return image
    pixels = np.asarray(image)
    pixels = pixels if spec.endswith("8") else pixels.astype(np.float32) / 255
    return np.moveaxis(pixels, -1, 0) if spec.startswith("torch") and pixels.ndim == 3 else pixels


UNSAFE = frozenset("pkl pickle pyd pth".split())
IMAGES = frozenset("jpg jpeg png ppm pgm pbm pnm bmp gif tif tiff webp img image".split())
DECODERS: dict[str, Callable[[bytes], Any]] = {
    **dict.fromkeys("txt text transcript".split(), lambda b: b.decode("utf-8")),
    **dict.fromkeys("cls cls2 index inx id".split(), int),
    **dict.fromkeys("json jsn".split(), json.loads),
    **dict.fromkeys("pkl pickle pyd".split(), pickle.loads),
    **dict.fromkeys("ten tb".split(), tensors_from_bytes),
    **dict.fromkeys("mp msg msgpack".split(), _optional("msgpack", "unpackb")),
    "npy": npy_from_bytes,
    "npz": npz_from_bytes,
    "cbor": _optional("cbor", "loads"),
    "pth": lambda b: _optional("torch", "load")(io.BytesIO(b)),
}
ENCODERS: dict[str, Callable[[Any], bytes]] = {
    **dict.fromkeys("txt text transcript html htm".split(), lambda v: v.encode("utf-8")),
    **dict.fromkeys("cls cls2 class count index inx id".split(), lambda v: str(v).encode("ascii")),
    **dict.fromkeys("json jsn".split(), lambda v: json.dumps(v).encode("utf-8")),
    **dict.fromkeys("pickle pyd pkl".split(), pickle.dumps),
    **dict.fromkeys("ten tenbin tb".split(), lambda v: tensors_to_bytes(v if isinstance(v, (list, tuple)) else [v])),
    **dict.fromkeys("mp msgpack msg".split(), _optional("msgpack", "packb")),
    "npy": npy_to_bytes,
    "npz": npz_to_bytes,
    "cbor": _optional("cbor", "dumps"),
}


class DecodeError(ValueError):
    """A field that can't be decoded: address, key, extension."""

    def __init__(self, url: str | None, key: str | None, ext: str, cause: BaseException):
        super().__init__(f"{url or '?'}: {key or '?'}.{ext}: {cause!r}")


def decode_value(ext: str, data: bytes, image: str | None = None, secure: bool = True, handlers: dict[str, Callable[[bytes], Any]] | None = None) -> Any:
    """One field by the last part of its extension; ``.gz`` is unpacked first, unknown formats stay bytes.

    ``handlers`` maps dotted suffixes in lower case to decoders of one's own, which come first.
    """
    low = ext.lower()
    for suffix, f in (handlers or {}).items():
        if low == suffix or low.endswith("." + suffix):
            return f(data)
    parts = ext.split(".")
    while parts and parts[-1] == "gz":
        data, parts = gzip.decompress(data), parts[:-1]
    last = parts[-1] if parts else ""
    if image and last.lower() in IMAGES:
        return _images(data, image)
    if last in UNSAFE and secure:
        raise PermissionError(f"{last} can run code; it is off in secure mode")
    return DECODERS[last](data) if last in DECODERS else data


class Again(NamedTuple):
    """What a handler gives back to have its result decoded further under another extension."""

    ext: str
    data: bytes


Handler = Callable[[str, bytes], Any]


def unpack(ext: str, data: bytes) -> Any:
    """Handler for packed fields: ``x.gz`` goes on as ``x``."""
    return Again(ext[:-3], gzip.decompress(data)) if ext.endswith(".gz") else None


def by_suffix(suffixes: str, f: Callable[[bytes], Any]) -> Handler:
    """Handler for the dotted suffixes between blanks, in any case."""
    wanted = tuple(x.lower() for x in suffixes.split())

    def handle(ext: str, data: bytes) -> Any:
        low = ext.lower()
        return f(data) if any(low == x or low.endswith(f".{x}") for x in wanted) else None

    return handle


@dataclass(frozen=True)
class Chain:
    """Handlers in the order pre, own, post; the first result that isn't None counts, and after ``Again`` the next handler gets the field under its new extension.

    Fields that no handler takes stay bytes.  By default packed fields are
    unpacked first and the formats of ``decode_value`` come last.
    """

    own: tuple[Handler, ...] = ()
    pre: tuple[Handler, ...] = (unpack,)
    post: tuple[Handler, ...] | None = None
    image: str | None = None
    secure: bool = True

    def __call__(self, ext: str, data: bytes) -> Any:
        last: tuple[Handler, ...] = self.post if self.post is not None else (lambda e, d: decode_value(e, d, self.image, self.secure),)
        for handler in (*self.pre, *self.own, *last):
            found = handler(ext, data)
            if isinstance(found, Again):
                ext, data = found
            elif found is not None:
                return found
        return data


def encode_value(ext: str, value: Any, secure: bool = True) -> bytes:
    """One field as bytes; bytes pass through, and text is encoded whatever the extension."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, str):
        data = value.encode("utf-8")
        return gzip.compress(data, mtime=0) if ext.endswith(".gz") else data
    parts = ext.split(".")
    packed = parts[-1] == "gz"
    last = (parts[-2] if packed and len(parts) > 1 else parts[-1]).lower()
    if last not in ENCODERS:
        raise ValueError(f"no encoder for {ext}")
    if last in UNSAFE and secure:
        raise PermissionError(f"{last} is off in secure mode")
    data = ENCODERS[last](value)
    return gzip.compress(data, mtime=0) if packed else data


# --- as columns ---


def _column(f: Callable[[bytes], Any], kind: str, arrow: pa.DataType, policy: str) -> Callable[[Column], Column]:
    if policy not in ("fail", "skip"):
        raise ValueError("columns fail or skip")

    @F.arrow_udf(kind)
    def run(data: pa.Array) -> pa.Array:
        out = []
        for value in data:
            raw = value.as_py()
            try:
                out.append(None if raw is None else f(raw))
            except Exception:
                if policy == "fail":
                    raise
                out.append(None)
        return pa.array(out, arrow)

    return run


_TENSOR_TYPE = pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.binary())])


def _tensor(a: np.ndarray) -> dict[str, Any]:
    plain = np.ascontiguousarray(a, dtype=a.dtype.newbyteorder("<"))
    return {"dtype": plain.dtype.name, "shape": list(a.shape), "data": plain.tobytes()}


def _array(t: dict[str, Any]) -> np.ndarray:
    return np.frombuffer(t["data"], dtype=np.dtype(t["dtype"]).newbyteorder("<")).reshape(t["shape"])


def gunzip(data: Column, policy: str = "fail") -> Column:
    """Bytes unpacked."""
    return _column(gzip.decompress, "binary", pa.binary(), policy)(data)


def gzipped(data: Column) -> Column:
    """Bytes packed, the same every time."""
    return _column(lambda b: gzip.compress(b, mtime=0), "binary", pa.binary(), "fail")(data)


def npy_tensor(data: Column, policy: str = "fail") -> Column:
    """An npy file as a tensor struct."""
    return _column(lambda b: _tensor(npy_from_bytes(b)), TENSOR, _TENSOR_TYPE, policy)(data)


def tensor_npy(tensor: Column) -> Column:
    """A tensor struct as an npy file."""
    return _column(lambda t: npy_to_bytes(_array(t)), "binary", pa.binary(), "fail")(tensor)


def tensor_list(data: Column, policy: str = "fail") -> Column:
    """A tensor file as an array of tensor structs."""
    return _column(lambda b: [_tensor(a) for a in tensors_from_bytes(b)], f"array<{TENSOR}>", pa.list_(_TENSOR_TYPE), policy)(data)


def list_tensor(tensors: Column) -> Column:
    """An array of tensor structs as a tensor file."""
    return _column(lambda ts: tensors_to_bytes([_array(t) for t in ts]), "binary", pa.binary(), "fail")(tensors)


def npz_tensors(data: Column, policy: str = "fail") -> Column:
    """An npz file as a map of tensor structs."""
    kind = pa.map_(pa.string(), _TENSOR_TYPE)
    return _column(lambda b: list({k: _tensor(a) for k, a in npz_from_bytes(b).items()}.items()), f"map<string,{TENSOR}>", kind, policy)(data)


def floats_tensor(values: Column) -> Column:
    """A float array column as a one-dimensional tensor struct."""
    return _column(lambda v: _tensor(np.asarray(v, dtype=np.float32)), TENSOR, _TENSOR_TYPE, "fail")(values)


def tensor_floats(tensor: Column) -> Column:
    """A tensor struct as a flat float array column."""
    return _column(lambda t: _array(t).astype(np.float32).ravel(), "array<float>", pa.list_(pa.float32()), "fail")(tensor)


def decoded(df: DataFrame, schema: dict[str, tuple[str, Callable[[Column], Column]]], fields: str = "fields") -> DataFrame:
    """``df`` with a column for each declared field of its map: ``{column: (extension, decoder)}``; other fields are not touched."""
    return df.withColumns({name: decoder(F.col(fields)[ext]) for name, (ext, decoder) in schema.items()})
