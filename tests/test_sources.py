import glob
import gzip
import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.dataset import Dataset
from shardloom.functions import codecs
from shardloom.functions.decode import as_int, as_json, as_text, encode_column
from shardloom.sources import opener
from shardloom.sources.tarscan import Settings, members, read_shards, samples_of
from shardloom.sources.tarwrite import ShardWriter, TarWriter, make_encoder, tar_mode, write_shards
from shardloom.streaming.directory import drain, shard_stream


def tar_bytes(files, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            tar.addfile(info, io.BytesIO(data or b""))
    return out.getvalue()


def group(files, **settings):
    s = Settings(**settings)
    return [(k, sorted(f)) for k, f in samples_of(members(io.BytesIO(tar_bytes(files)), s, "t"), s, "t")]


def test_grouping():
    assert group([("a.x", b"1"), ("b.x", b"2"), ("a.y", b"3")]) == [("a", ["x"]), ("b", ["x"]), ("a", ["y"])]
    assert group([("a.cls", b"1"), ("README", b""), ("a.txt", b"2")]) == [("a", ["cls", "txt"])]
    assert group([("a.PNG", b"1")]) == [("a", ["png"])] and group([("a.PNG", b"1")], lower=False) == [("a", ["PNG"])]
    with pytest.raises(OSError, match="twice"):
        group([("a.PNG", b"1"), ("a.png", b"2")])
    assert group([("a.x", b"1"), ("a.x", b"2")], on_error="skip") == [("a", ["x"])]
    assert group([("a.x", b"1"), ("a.x", b"2")], exts=("y",)) == [("a", [])]
    assert group([("a/.hidden", b""), ("dir.v1/x.tar.gz", b""), ("a.", b""), ("a.b/c", b""), ("./a.b", b"")]) == [("a/", ["hidden"]), ("dir.v1/x", ["tar.gz"]), ("a", [""]), ("./a", ["b"])]
    assert group([("__meta__", b""), ("__x__/y.txt", b""), ("d", None), ("a.x", b"")]) == [("a", ["x"])]
    assert group([("a.x", b""), ("b.x", b"")], rename_files=lambda n: n.replace("a", "c"), select_files=lambda n: n.startswith("c")) == [("c", ["x"])]
    assert group([]) == []


@pytest.mark.parametrize("mode", ["w", "w:gz", "w:bz2", "w:xz"])
def test_compressions(spark, tmp_path, mode):
    path = tmp_path / "x.tar"
    path.write_bytes(tar_bytes([("a.txt", b"hi"), ("a.cls", b"1")], mode))
    r = read_shards(spark, str(path)).collect()
    assert [(x["__key__"], dict(x.fields), x["__local_path__"]) for x in r] == [("a", {"txt": b"hi", "cls": b"1"}, str(path))]


def test_broken_archives(spark, tmp_path):
    whole = tar_bytes([(f"{k:03d}.txt", b"x" * 2000) for k in range(47)])
    (tmp_path / "a.tar").write_bytes(whole[:30000])
    (tmp_path / "b.tar").write_bytes(whole)
    (tmp_path / "c.tar").write_bytes(b"no archive at all")
    urls = [str(tmp_path / f"{n}.tar") for n in "abc"]
    with pytest.raises(Exception, match="a.tar"):
        read_shards(spark, urls[0]).collect()
    for policy in ("skip", "warn", "stop"):
        counts = {r.shard_id: r["count"] for r in read_shards(spark, urls, on_error=policy).groupBy("shard_id").count().collect()}
        assert counts[1] == 47 and 0 < counts[0] < 47 and 2 not in counts
    assert read_shards(spark, [*urls[1:2], str(tmp_path / "none.tar")], on_error="skip").count() == 47


def test_push_down(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(tar_bytes([("a.txt", b"1"), ("a.json", b"{}"), ("b.TXT", b"2")]))
    f = read_shards(spark, str(tmp_path / "a.tar"), layout="files")
    assert [(r.pos, r.fname) for r in f.where("ext = 'txt'").collect()] == [(0, "a.txt"), (1, "b.TXT")] or f.where("ext = 'txt'").count() == 2
    assert f.where(F.col("ext").isin("json")).count() == 1 and f.where("key = 'a' and ext = 'txt'").count() == 1
    assert f.where("upper(ext) = 'TXT'").count() == 2 and f.where("ext like 't%'").count() == 2


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(50).repartition(2).select(F.format_string("%03d", "id").alias("__key__"), F.col("id").alias("cls"), F.concat(F.lit("text "), "id").alias("txt"), F.lit("m").alias("_meta"))
    write_shards(df, path, mode="overwrite", maxcount=5, mtime=0)
    names = sorted(os.listdir(path))
    assert len(names) == 10 and all(n.endswith(".tar") for n in names)
    back = read_shards(spark, sorted(glob.glob(path + "/*"))).select("__key__", as_int(F.col("fields")["cls"]).alias("c"), as_text(F.col("fields")["txt"]).alias("t"), F.size("fields").alias("n"))
    assert sorted((r["__key__"], r.c, r.t, r.n) for r in back.collect()) == [(f"{k:03d}", k, f"text {k}", 2) for k in range(50)]
    write_shards(df, path, maxcount=25)
    assert len(os.listdir(path)) > 10
    write_shards(df.limit(0), path, mode="overwrite")
    assert os.listdir(path) == []


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(4, numPartitions=1).select(F.lit("k").alias("__key__"), F.when(F.col("id") < 3, "x").otherwise(F.raise_error(F.lit("no"))).alias("txt"))
    with pytest.raises(Exception, match="no"):
        write_shards(df, path)
    assert not os.path.isdir(path) or not [f for _, _, fs in os.walk(path) for f in fs]


def test_writers(tmp_path):
    done = []
    with ShardWriter(str(tmp_path / "s-%02d.tar"), max_count=5, post=done.append) as w:
        for k in range(12):
            w.write({"__key__": str(k), "cls": k, "json": {"a": k}, "txt.gz": "hello", "ten": [np.ones((3, 3), np.float32)]})
    assert [os.path.basename(d) for d in done] == ["s-00.tar", "s-01.tar", "s-02.tar"]
    with tarfile.open(done[0]) as tar:
        assert tar.getnames()[:4] == ["0.cls", "0.json", "0.ten", "0.txt.gz"] and tar.getmembers()[0].uname == "bigdata"
        assert gzip.decompress(tar.extractfile("0.txt.gz").read()) == b"hello"
    sizes = []
    with ShardWriter(str(tmp_path / "z-%02d.tar"), max_size=10, post=sizes.append) as w:
        for k in range(4):
            w.write({"__key__": str(k), "txt": "123456"})
    assert len(sizes) == 2
    with TarWriter(io.BytesIO()) as t:
        with pytest.raises(ValueError):
            t.write({"txt": "x"})
        with pytest.raises(ValueError):
            t.write({"__key__": "a", "foo": 1})
    with pytest.raises(ValueError):
        make_encoder(False)("txt", "x")
    assert make_encoder({"x": lambda v: b"!"})("x", 1) == b"!"
    assert [tar_mode(n) for n in ("a.tar", "a.tgz", "a.tar.bz2", "a.tar.xz")] == ["w|", "w|gz", "w|bz2", "w|xz"] and tar_mode("a", True) == "w|gz"


@pytest.mark.parametrize("kind", ["uint8", "float16", "float32", "float64", "uint32", "int64"])
def test_tensors(kind):
    for shape in [(0,), (1,), (3, 3), (10, 345), (2, 0, 4), ()]:
        a = (np.arange(int(np.prod(shape))) % 200).reshape(shape).astype(kind)
        data = codecs.tensors_to_bytes([a, a], ["x", "y"])
        back, names = codecs.tensors_from_bytes(data, infos=True)
        assert len(data) % 16 == 0 and names == ["x", "y"] and all(b.dtype == a.dtype and (b == a).all() and b.shape == a.shape for b in back)
    with pytest.raises(ValueError):
        codecs.tensors_from_bytes(data[:20])
    with pytest.raises(ValueError):
        codecs.tensors_from_bytes(b"x" * 64)
    with pytest.raises(ValueError):
        codecs.tensors_to_bytes([np.array(["s"])])


def test_decoding(spark):
    assert codecs.decode_value("txt", b"hi") == "hi" and codecs.decode_value("cls", b"7") == 7 and codecs.decode_value("x.json", b"[1]") == [1]
    assert codecs.decode_value("txt.gz", gzip.compress(b"hi")) == "hi" and codecs.decode_value("foo", b"x") == b"x"
    with pytest.raises(PermissionError):
        codecs.decode_value("pkl", b"x")
    assert codecs.decode_value("pyd", codecs.encode_value("pyd", [1], secure=False), secure=False) == [1]
    assert codecs.decode_value("seg.png", b"x", handlers={"png": lambda b: "image"}) == "image"
    assert list(codecs.npz_from_bytes(codecs.npz_to_bytes({"a": np.ones(2)}))) == ["a"]
    df = spark.createDataFrame([(b"12",), (b"x",), (None,)], "b binary")
    assert [r.v for r in df.select(as_int(F.col("b"), "skip").alias("v")).collect()] == [12, None, None]
    with pytest.raises(Exception):
        df.select(as_int(F.col("b"))).collect()
    bad = spark.createDataFrame([(b"\xff",)], "b binary")
    assert [r.v for r in bad.select(as_text(F.col("b"), "skip").alias("v")).collect()] == [None]
    with pytest.raises(Exception):
        bad.select(as_text(F.col("b"))).collect()
    assert [r.v for r in bad.select(codecs.gunzip(F.col("b"), "skip").alias("v")).collect()] == [None]
    with pytest.raises(Exception):
        bad.select(codecs.gunzip(F.col("b"))).collect()
    j = spark.createDataFrame([(b'{"a": 1}',)], "b binary")
    assert j.select(as_json(F.col("b"), "a int").alias("v")).first().v.a == 1
    assert spark.range(1).select(encode_column(F.col("id"), "bigint", "cls").alias("v")).first().v == b"0"


def test_openers(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"x")
    for url in (str(path), f"file:{path}"):
        with opener.open_url(url) as f:
            assert f.read() == b"x"
        with pytest.raises(PermissionError):
            opener.open_url(url, policy=opener.Policy(local=False))
    with pytest.raises(PermissionError):
        opener.open_url("pipe:cat /dev/null")
    with pytest.raises(PermissionError):
        opener.Policy(rewrites="a=b")
    free = opener.Policy(secure=False)
    with opener.open_url(f"pipe:cat {path}", policy=free) as f:
        assert f.read() == b"x"
    with pytest.raises(OSError, match="exit status"):
        opener.open_url("pipe:exit 3", policy=free).read()
    with pytest.raises(ValueError):
        opener.open_url("nothing://x")
    with pytest.raises(ValueError):
        opener.open_url(str(path), "ab")


def test_cache(tmp_path):
    source = tmp_path / "a.tar"
    source.write_bytes(tar_bytes([("a.txt", b"1")]))
    opener.register("copy", lambda url, mode, policy: open(url.removeprefix("copy:"), mode))
    cache = opener.FileCache(str(tmp_path / "cache"), name=lambda u: "a.tar")
    kept = cache.path(f"copy:{source}")
    source.unlink()
    assert cache.path(f"copy:{source}") == kept and opener.file_kind(kept) == "tar"
    bad = tmp_path / "bad"
    bad.write_bytes(b"x")
    with pytest.raises(OSError):
        opener.FileCache(str(tmp_path / "c2"), tries=1).path(f"copy:{bad}")
    full = tmp_path / "full"
    full.mkdir()
    for k in range(20):
        (full / f"{k:02d}").write_bytes(b"x" * 4096)
    gone = opener.FileCache(str(full), max_bytes=10 * 4096).clean(force=True)
    assert len(gone) == 10 and len(list(full.iterdir())) == 10


def test_fluent(spark, tmp_path):
    for s in range(3):
        with TarWriter(str(tmp_path / f"s-{s}.tar")) as t:
            for k in range(7):
                t.write({"__key__": f"{s}{k}", "cls": k, "txt": f"t{k}"})
    d = Dataset.open(spark, str(tmp_path / "s-{0..2}.tar"))
    assert len(d) == 21 and len(d.with_length(5)) == 5
    f = d.fields(c=("cls", as_int), t=("txt", as_text))
    assert [r["c"] for r in f.slice(5, 9)] == [5, 6, 0, 1]
    b = f.batched(4, columns=["c", "t"])
    assert [r["n"] for r in b] == [4, 4, 4, 4, 4, 1] and [r["c"] for r in b.unbatched()] == [r["c"] for r in f.indexed()]
    assert len(f.select(F.col("c") > 3).listed(2, partial=False).unlisted()) == 8
    assert len(f.with_epoch(50)) == 50 and len(f.repeat(2)) == 42
    assert sorted(r["c"] for r in f.shuffle(5, 2)) == sorted(r["c"] for r in f.detshuffle())
    assert {r["_1"] for r in d.to_tuple("png;cls txt")} == {f"t{k}".encode() for k in range(7)}
    with pytest.raises(Exception, match="null"):
        list(d.to_tuple("png"))
    stored = f.stored(str(tmp_path / "p"))
    assert len(stored) == 21 and len(f.stored(str(tmp_path / "p")).cached()) == 21
    assert len(Dataset.open(spark, str(tmp_path / "s-{0..2}.tar"), rank=1, world=2)) == 7
    assert len(Dataset.open(spark, str(tmp_path / "s-{0..2}.tar"), resample=4)) == 28
    with pytest.raises(ValueError):
        Dataset.open(spark, [])


def test_functions_over_samples(spark, tmp_path):
    with TarWriter(str(tmp_path / "a.tar")) as t:
        for k in range(6):
            t.write({"__key__": str(k), "cls": k, "txt.gz": f"t{k}", "bad": b"x"})
    d = Dataset.open(spark, str(tmp_path / "a.tar"))
    even = lambda s: {"v": s["cls"] * 10, "t": s["txt.gz"]} if s["cls"] % 2 == 0 else None
    assert [(r["__key__"], r["v"], r["t"]) for r in d.map_samples(even, "__key__ string, v long, t string")] == [("0", 0, "t0"), ("2", 20, "t2"), ("4", 40, "t4")]
    odd_fails = lambda s: {"v": 1 // (s["cls"] % 2)}
    with pytest.raises(Exception, match="ZeroDivision"):
        list(d.map_samples(odd_fails, "v long"))
    assert [len(list(d.map_samples(odd_fails, "v long", on_error=p))) for p in ("skip", "warn", "stop")] == [3, 3, 0]
    with pytest.raises(Exception, match="a.tar: 0.bad"):
        list(d.map_samples(lambda s: s, "v long", handlers={"bad": int}))
    assert len(list(d.map_samples(lambda s: {"v": len(s)}, "v long", only=["cls"]))) == 6
    assert d.log_keys().count() == 6 and [len(b) for b in d.to_batches(4)] == [4, 2]
    up = Dataset.of(spark.createDataFrame([(0, 0, "x", "v")], "shard_id long, sample_no long, ext string, data string"), "shard_id", "sample_no").xdecode(("x", F.upper))
    assert [r["data"] for r in up] == ["V"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make = lambda n: (tmp_path / "in" / f"{n}.tar").write_bytes(tar_bytes([(f"{n}{k}.txt", b"x") for k in range(3)]))
    make("a"), make("b")
    run = lambda: drain(shard_stream(spark, str(tmp_path / "in")), str(tmp_path / "check"), str(tmp_path / "out")).count()
    assert run() == 6
    make("c")
    assert run() == 9 and run() == 9
