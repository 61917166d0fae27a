import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators import batching, epochs, joins, order, project, shards


def rows(df, *names):
    return [tuple(r[c] for c in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def frame(spark, n, **columns):
    return spark.range(n).select(F.col("id").alias("index"), *[c.alias(k) for k, c in columns.items()])


def test_select_and_map(spark):
    df = spark.range(10)
    assert sorted(rows(project.select(df, F.col("id") % 2 == 0), "id")) == [0, 2, 4, 6, 8]
    odd = F.when(F.col("id") % 2 == 1, F.col("id"))
    assert sorted(rows(project.map_columns(spark.range(5), ["x"], x=odd), "x")) == [1, 3]
    with pytest.raises(KeyError):
        project.map_dict(df, nothing=F.upper)
    assert rows(project.map_tuple(spark.createDataFrame([(1, 2)], "a int, b int"), None, lambda x: x + 1, F.upper), "a", "b") == [(1, 3)]


def test_to_tuple(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert rows(project.to_tuple(df, "a", "x;c"), "_0", "_1") == [(1, 3)]
    assert rows(project.to_tuple(df, "a b"), "_0", "_1") == [(1, 2)]
    with pytest.raises(KeyError):
        project.to_tuple(df, "x")
    null = spark.createDataFrame([(None,)], "a int")
    with pytest.raises(Exception, match="a is null"):
        project.to_tuple(null, "a").collect()
    assert rows(project.to_tuple(null, "a", none_is_error=False), "_0") == [None]


def test_map_fields(spark):
    df = spark.sql("select map('png', 'x', 'cls', cast(null as string)) fields, 1 k")
    assert rows(df.select(project.first_field("fields", "cls;png").alias("v")), "v") == [None]
    assert rows(df.select(project.first_field("fields", "jpg;png").alias("v")), "v") == ["x"]
    assert rows(project.to_tuple_fields(df, "jpg;png"), "_0") == ["x"]
    with pytest.raises(Exception, match="is not among"):
        project.to_tuple_fields(df, "jpg").collect()
    assert rows(project.extract_fields(df, "p*", "zip", ignore_missing=True), "values") == [["x"]]
    twice = spark.sql("select map('a1', 1, 'a2', 2) fields")
    with pytest.raises(Exception, match="(?i)duplicat"):
        project.rename_fields(twice, ("a", "a*")).collect()


def test_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "png int, jpg int, cls int")
    assert set(project.rename(df, image="png;jpg").columns) == {"image", "cls"}
    assert project.rename(df, keep=False, image="png;jpg").columns == ["image"]
    old = spark.createDataFrame([("v",)], "old_key string")
    assert project.rename_keys(old, new_key="old_key").columns == ["new_key"]
    with pytest.raises(ValueError):
        project.rename_keys(old, new_key="nothing")
    with pytest.raises(ValueError):
        project.rename_keys(df, x="*")
    assert project.rename_keys(df, ("a", "*g"), ("b", "j*"), ("c", "c*")).columns == ["a", "b", "c"]


def test_extract(spark):
    df = spark.createDataFrame([(1, 2)], "a int, a_extra int")
    assert rows(project.extract_keys(df, "a;x"), "_0") == [1]
    with pytest.raises(ValueError):
        project.extract_keys(df, "a*")
    with pytest.raises(ValueError):
        project.extract_keys(df, "z")
    assert project.extract_keys(df, "z", "a", ignore_missing=True).columns == ["_0"]


def test_dispatch(spark):
    df = spark.createDataFrame([("f.txt", b"hi"), ("f.bin", b"x")], "n string, v binary")
    text = project.dispatch(F.col("n"), F.col("v").cast("string"), ("*.bin", False), ("*.txt", F.upper))
    assert rows(df.select(text.alias("o")), "o") == ["HI", "x"]
    with pytest.raises(Exception, match="no decoder"):
        df.select(project.dispatch(F.col("n"), F.col("v"), ("*.txt", False)).alias("o")).collect()


def test_associate_and_zip(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    side = spark.createDataFrame([("a", None, 5)], "k string, v int, w int")
    assert sorted(rows(joins.associate(df, side, "k"), "k", "v", "w")) == [("a", None, 5), ("b", 2, None)]
    left, right = spark.createDataFrame([(1, 1), (2, 2)], "k int, a int"), spark.createDataFrame([(1, 7)], "k int, b int")
    assert rows(joins.zip_columns(left, right, ["k"]), "k", "a", "b") == [(1, 1, 7)]
    with pytest.raises(Exception, match="one side"):
        joins.zip_columns(left, right, ["k"], strict=True).collect()


def test_runs_and_groups(spark):
    files = spark.createDataFrame([(0, 0, "a", "x", b"1"), (0, 1, None, None, b""), (0, 2, "a", "y", b"2"), (0, 3, "b", "x", b"3"), (0, 4, "a", "x", b"4"), (1, 5, "a", "z", b"5")], "shard_id int, pos int, key string, ext string, data binary")
    got = sorted((r.shard_id, r.sample_no, r["__key__"], tuple(r.fields)) for r in batching.group_files(files).collect())
    assert got == [(0, 0, "a", ("x", "y")), (0, 1, "b", ("x",)), (0, 2, "a", ("x",)), (1, 0, "a", ("z",))]
    none = {(r["__key__"], len(r.fields)) for r in batching.group_files(files, suffixes=["q"]).collect()}
    assert none == {("a", 0), ("b", 0)}
    twice = spark.createDataFrame([(0, 0, "a", "x", b"1"), (0, 1, "a", "x", b"2")], files.schema)
    with pytest.raises(Exception, match="twice"):
        batching.group_files(twice).collect()
    assert [dict(r.fields) for r in batching.group_files(twice, on_duplicate="first").collect()] == [{"x": bytearray(b"1")}]
    assert [dict(r.fields) for r in batching.group_files(twice, suffixes=["q"]).collect()] == [{}]


def test_batches(spark):
    df = frame(spark, 10, x=F.col("id"), y=F.when(F.col("id") != 3, F.col("id")))
    b = sorted(rows(batching.batched(df, "index", 3), "batch", "n", "x", "y"))
    assert [x[1] for x in b] == [3, 3, 3, 1] and b[1][3] == [None, 4, 5]
    assert len(rows(batching.batched(df, "index", 3, partial=False), "batch")) == 3
    back = batching.unbatched(batching.batched(df, "index", 3), ["x", "y"])
    assert sorted(rows(back, "x")) == list(range(10))
    assert sorted(rows(batching.unlisted(batching.listed(df, "index", 4)), "x")) == list(range(10))
    assert batching.batched(df.limit(0), "index", 3).count() == 0
    bad = spark.sql("select array(1, 2) a, array(1) b")
    with pytest.raises(Exception, match="differ in length"):
        batching.unbatched(bad, ["a", "b"]).collect()


def test_batches_in_partitions(spark):
    df = spark.range(47, numPartitions=4)
    out = batching.batched_in_partitions(df, 10, lambda c: {"n": len(c["id"])}, "n int")
    assert sum(rows(out, "n")) == 47 and max(rows(out, "n")) == 10


def test_stacking(spark):
    df = spark.sql("select array(array(1, 2), array(3, 4)) a union all select array(array(1), array(1, 2))")
    assert rows(df.select(batching.stacked(F.col("a")).alias("s")), "s") == [[1, 2, 3, 4], None]


def test_index_slice_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    i = order.with_index(df, F.floor(F.col("k") / 64), ["k"])
    assert sorted(rows(i, "index", "k")) == [(n, n) for n in range(1000)]
    assert sorted(rows(order.slice_rows(i, "index", 5, 30, 10), "k")) == [5, 15, 25]
    assert order.sampled(df, 1.0, "k").count() == 1000 and order.sampled(df, 0.0, "k").count() == 0
    assert 50 < order.sampled(df, 0.1, "k").count() < 150
    assert order.with_index(df.limit(0), F.lit(0), ["k"]).count() == 0


def test_shuffles(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a, b, c = (dict(rows(order.shuffled(df, "k", 1, e), "k", "rank")) for e in (0, 0, 1))
    assert a == b != c and sorted(a.values()) == list(range(500))
    assert sorted(rows(order.buffer_shuffled(df, 50, 10), "k")) == list(range(500))
    assert order.buffer_shuffled(df, 0) is df


def test_the_buffer_fills(spark):
    df = spark.range(5000).coalesce(1)
    out = rows(order.buffer_shuffled(df, 1000, 100), "id")
    assert sorted(out) == list(range(5000)) and out == rows(order.buffer_shuffled(df, 1000, 100), "id")
    late = max(k - x for k, x in enumerate(out))  # how long a row was held
    assert late > 1000 and max(x - k for k, x in enumerate(out)) <= 1000
    assert all(x <= 2 * k + 200 for k, x in enumerate(out))  # two come in for one that leaves
    assert rows(order.buffer_shuffled(df, 1), "id") == list(range(5000))


def test_index_over_many_shards(spark):
    df = spark.range(20_000).selectExpr("id", "id div 2 shard", "cast(id div 2 as string) name")
    assert all(r.id == r.i for r in order.with_index(df, "shard", ["id"], "i").collect())
    by_name = {r.id: r.i for r in order.with_index(df.where("id < 40"), "name", ["id"], "i").collect()}
    assert [k for k, _ in sorted(by_name.items(), key=lambda x: x[1])] == sorted(range(40), key=lambda k: (str(k // 2), k))


def test_valid_samples(spark):
    df = spark.createDataFrame([(1, {"a": b"x"}, None), (2, {}, None), (3, None, None), (4, {"a": b"x"}, True), (5, {"a": b""}, False)], "k int, fields map<string,binary>, __bad__ boolean")
    assert sorted(rows(project.valid(df), "k")) == [1, 5] and sorted(rows(project.valid(df.drop("__bad__")), "k")) == [1, 4, 5]
    assert project.valid(df.select("k")).count() == 5


def test_chains():
    import gzip

    from shardloom.functions import codecs

    own = codecs.by_suffix("up x.low", lambda b: b.decode().upper())
    chain = codecs.Chain((own,))
    assert chain("a.up", b"x") == "X" and chain("A.X.LOW", b"x") == "X" and chain("low", b"x") == b"x" and chain("cls", b"7") == 7
    assert chain("up.gz", gzip.compress(b"y")) == "Y" and chain("txt.gz", gzip.compress(b"y")) == "y"
    assert codecs.Chain((), pre=(), post=())("cls", b"7") == b"7"
    assert codecs.Chain((own,), pre=(lambda e, d: "first",))("up", b"x") == "first"


def test_directories_as_shard_lists(spark, tmp_path):
    for name in ("b.tar", "a.tgz", "c.tar.gz", "d.txt", "_e.tar", ".f.tar"):
        (tmp_path / name).write_bytes(b"")
    found = shards.shard_spec(spark, f"{tmp_path}/").orderBy("shard_id")
    assert [u.rsplit("/", 1)[1] for u in rows(found, "url")] == ["a.tgz", "b.tar", "c.tar.gz"]
    with pytest.raises(NotImplementedError):
        shards.shard_spec(spark, "list.json")


def test_shards(spark):
    s = shards.shard_list(spark, "s{0..9}.tar")
    once, again = (rows(shards.shard_list(spark, "s{0..9}.tar", 3).orderBy("shard_id"), "url") for _ in range(2))
    assert once == again != rows(s.orderBy("shard_id"), "url") and len(set(once)) == 10
    parts = [set(rows(shards.split_by_worker(shards.split_by_node(s, r, 3), w, 2, 3), "shard_id")) for r in range(3) for w in range(2)]
    assert sorted(x for p in parts for x in p) == list(range(10))
    assert shards.resampled(s, 27, "shard_id").count() == 27
    assert shards.resampled(s.limit(0), 27, "shard_id").count() == 0
    with pytest.raises(Exception, match="no rows"):
        shards.non_empty(s.limit(0)).collect()
    with pytest.raises(ValueError):
        shards.single_node_only(s, 2)
    assert shards.worker_info({}) == (0, 1, 0, 1) and shards.worker_info({"RANK": "2", "WORLD_SIZE": "4"}) == (2, 4, 0, 1)
    spec = {"prefix": "p/", "datasets": [{"name": "a", "shards": "a{0..3}", "choose": 2}, {"name": "b", "shards": ["b0"], "resample": 5}]}
    got = rows(shards.multi_source(spark, spec), "name", "url")
    assert sorted(x for x, _ in got) == ["a", "a"] + ["b"] * 5 and all(u.startswith("p/") for _, u in got)
    with pytest.raises(ValueError):
        shards.multi_source(spark, {"datasets": [{"shards": "a", "choose": 2}]})


def test_epochs(spark):
    df = frame(spark, 47)
    assert epochs.repeat(df, "index", 2).count() == 94
    assert epochs.with_epoch(df, "index", 193).count() == 193
    assert epochs.with_epoch(df, "index", 2).count() == 2
    assert epochs.with_epoch(df.limit(0), "index", 5).count() == 0
    pairs = frame(spark, 3, size=F.lit(2))
    assert epochs.repeat_weighted(pairs, "index", "size", 10, 9).count() == 5


def take_turns(lists, longest):
    out, alive, turn = [], list(range(len(lists))), 0
    while alive:
        for s in list(alive):
            if turn >= len(lists[s]):
                if not longest:
                    return out
                alive.remove(s)
            else:
                out.append(lists[s][turn])
        turn += 1
    return out


@pytest.mark.parametrize("longest", [True, False])
def test_round_robin(spark, longest):
    assert take_turns([[2, 2], [1], [3, 3, 3]], True) == [2, 1, 3, 2, 3, 3]
    rng = random.Random(5)
    for _ in range(3):
        lists = [[f"{s}.{k}" for k in range(rng.randint(0, 4))] for s in range(3)]
        frames = [spark.createDataFrame([(k, v) for k, v in enumerate(x)], "index long, v string") for x in lists]
        got = rows(epochs.round_robin(frames, "index", longest).orderBy("turn", "src"), "v")
        assert got == take_turns(lists, longest)


def test_random_mix(spark):
    frames = [frame(spark, 30, v=F.concat(F.lit("a"), "id")), frame(spark, 10, v=F.concat(F.lit("b"), "id"))]
    every = rows(epochs.random_mix(frames, "index", [3, 1], seed=2, longest=True).orderBy("draw"), "v")
    assert sorted(every) == sorted([f"a{k}" for k in range(30)] + [f"b{k}" for k in range(10)])
    assert [v for v in every if v[0] == "a"] == [f"a{k}" for k in range(30)]
    some = rows(epochs.random_mix(frames, "index", [3, 1], seed=2).orderBy("draw"), "v")
    assert some == every[: len(some)] and 0 < len(some) <= 40


def test_weights(spark):
    df = spark.createDataFrame([(2, 3.0), (4, 1.0)], "n int, w double")
    assert sorted(rows(batching.sample_weights(df, "n", "w"), "share")) == pytest.approx([4 / 6, 1.0])
