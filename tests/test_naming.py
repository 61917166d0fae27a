import re

import pytest
from pyspark.sql import functions as F

from shardloom.functions import naming as n


def test_braces():
    assert len(n.expand_braces("test-{000000..000099}.tar")) == 100
    assert n.expand_braces("test-{000000..000099}.tar")[7] == "test-000007.tar"
    assert n.expand_braces("{a,b{1..2}}x") == ["ax", "b1x", "b2x"]
    assert n.expand_braces("{a}{}x{") == ["{a}{}x{"]
    assert n.expand_braces("{3..1}") == ["3", "2", "1"]
    assert n.expand_braces("{a..c}") == ["a", "b", "c"]
    assert n.expand_braces("{0..6..3}") == ["0", "3", "6"]


def test_urls_and_variables():
    assert n.expand_urls("a{0..1}::b") == ["a0", "a1", "b"]
    assert n.expand_urls("${X}/s{1,2}", {"SHARDS_X": "${Y}", "SHARDS_Y": "base"}) == ["base/s1", "base/s2"]
    with pytest.raises(KeyError):
        n.expand_urls("${NONE}", {})
    assert n.expand_source(iter(["a", "b", "c"]), 2) == ["a", "b"]


NAMES = {"a.cls": ("a", "cls"), "x/y.seg.PNG": ("x/y", "seg.PNG"), "a.b/c": None, "a/.hidden": ("a/", "hidden"), ".hidden": None, "README": None, "dir.v1/x.tar.gz": ("dir.v1/x", "tar.gz"), "a.": ("a", ""), "a/b.c/d.txt": ("a/b.c/d", "txt"), "./a.b": ("./a", "b")}


def test_keys(spark):
    assert {k: n.split_name(k) for k in NAMES} == NAMES
    df = spark.createDataFrame([(k,) for k in NAMES], "p string").select("p", n.key_of(F.col("p")).alias("k"), n.ext_of(F.col("p"), lower=False).alias("e"))
    assert {r.p: (r.k, r.e) if r.k is not None else None for r in df.collect()} == NAMES


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.{jpg,png}", ["a.jpg", "b.png"], ["a.gif"]), ("a?[0-9]", ["ab1"], ["a1", "abc"]), ("[!x]*", ["abc"], ["xbc"]), ("a.b", ["a.b"], ["axb"])])
def test_globs(spark, glob, yes, no):
    pattern = n.glob_to_regex(glob)
    assert all(re.match(pattern, y) for y in yes) and not any(re.match(pattern, x) for x in no)
    df = spark.createDataFrame([(x,) for x in yes + no], "s string")
    assert {r.s for r in df.where(n.matches_glob(F.col("s"), glob)).collect()} == set(yes)


def test_rewrite():
    rules = n.parse_rewrites("gs://=s3://;s3://old=s3://new")
    assert [n.rewrite(u, rules) for u in ("gs://b/x", "s3://old/x", "x")] == ["s3://b/x", "s3://new/x", "x"]


def test_cache_names():
    assert n.cache_name("http://h/a/b/c.tar") == "c.tar"
    assert n.cache_name("http://h/a/b/c.tar", 1) == "b/c.tar"
    assert "/" not in n.cache_name("pipe:cat /x/y.tar | gzip -d") and len(n.cache_name("pipe:" + "y" * 500)) == 128
