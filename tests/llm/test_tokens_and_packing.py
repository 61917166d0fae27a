import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardloom.llm import packing, pieces, token_counts

MODEL, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "b", "The", " ", "  ", "\n", " \n", "\t", "'s", "'", " '", "12", "é", "ß", "中", "　", "\xa0", "<|endoftext|>", "<|endo", "😀", "\x1c", "՘", "Ж", ".", "!!", "\r\n", "\x85", "ſ"]
SCHEMA = "doc_id long, text string, n_tokens string, unit string, start int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def strings(n, seed=0, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_ids_are_the_library_s(library, ranks):
    texts = [*strings(4000), "", "word " * 5000, "x" * 3000]
    ids, count = pieces.Pieces(MODEL, ranks).ids(pa.array(texts))
    bounds = np.cumsum(count)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] - count[k] : bounds[k]].tolist() == e.ids, texts[k]


def test_settled_characters_agree(library):
    import pyarrow.compute as pc

    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    good = pc.match_substring_regex(pa.array(every), pieces.SETTLED).to_pylist()
    probe = "".join(f"a{c}1" for c, ok in zip(every, good) if ok)
    assert library.encode(probe, add_special_tokens=False).ids == pieces.pieces(MODEL, RANKS).fast.encode_ordinary(probe)
    assert all(bool(pieces._SETTLED.match(c)) == ok for c, ok in zip(every, good))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, "x", "y", 1) for k, t in enumerate(strings(300, 1))] + [(7, "again", None, None, None), (7, "again", None, None, None), (900, None, None, None, None), (None, "no id", None, None, None), (901, "word, " * 30000, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("head", [0, 50, 10000])
def test_counts(awkward, library, head):
    got = token_counts.count_tokens(awkward, MODEL, RANKS, max_tokens=10, head=head).collect()
    rows = awkward.collect()
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)


def test_counts_of_nothing(spark, awkward):
    assert token_counts.count_tokens(awkward.limit(0), MODEL, RANKS).count() == 0


def test_texts_without_blanks(library):
    texts = ["a,b;c." * 100, "字词" * 200 + "，" + "字" * 50, "x" * 500, "one two three"]
    _, number, units, _, _ = pieces.Pieces(MODEL, RANKS).units(pa.array(texts))
    cut = {u for t in texts[:3] for u in (t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t))}
    assert cut <= set(units.to_pylist())
    ids, count = pieces.Pieces(MODEL, RANKS).ids(pa.array(texts))
    assert count.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_steps_hold_equal_ids(spark):
    docs = spark.range(800).selectExpr("id doc_id", "repeat(concat('word ', id, ' and more '), 1 + cast(id % 400 as int)) text").repartition(5)
    rows = packing.pack(docs, MODEL, RANKS, pool=50_000, step_ids=8192).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.tier, r.step] += r.length
    assert {t for t, _ in held} >= set(packing.TIERS)
    for (tier, step), n in held.items():
        last = max(s for t, s in held if t == tier)
        assert n == 8192 or (step == last and n < 8192)


def check_packed(rows, texts, library, top=2048):
    """Every id in one piece, sequences gapless, padding small."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for name, versions in texts.items():
        ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in versions]
        assert sum(r.length for r in by_doc[name]) == sum(map(len, ids))
        for r in by_doc[name]:
            assert any(len(i) == r.doc_tokens and zlib.crc32(np.array(i[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for i in ids)
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= top
        padding += 0 if at & (at - 1) == 0 else top - at
        total += at
    return padding / max(total, 1)


def test_packing(awkward, library):
    rows = packing.pack(awkward, MODEL, RANKS, pool=20_000).collect()
    texts = defaultdict(list)
    for r in awkward.collect():
        texts[r.doc_id].append(r.text)
    assert check_packed(rows, texts, library) == 0
    assert packing.pack(awkward.limit(0), MODEL, RANKS).count() == 0


def test_pools_are_filled():
    rng = random.Random(4)
    for _ in range(200):
        pool = [packing.Piece(k, 0, rng.choice([1, 2, 30, 255, 256, 257, 700, 2048, 5000])) for k in range(rng.randint(0, 40))]
        total = sum(p.length for p in pool)
        for last in (True, False):
            windows, left = packing.pack_pool(list(pool), packing.TIERS, last)
            seen = defaultdict(list)
            for size, window in windows:
                assert size == sum(p.length for p in window) and (size in packing.TIERS or size & (size - 1) == 0)
                for p in window:
                    seen[p.doc].append((p.start, p.length))
            for p in left:
                seen[p.doc].append((p.start, p.length))
            for p in pool:
                at = 0
                for start, length in sorted(seen[p.doc]):
                    assert start == at
                    at += length
                assert at == p.length
            assert sum(s for s, _ in windows) + sum(p.length for p in left) == total and not (last and left)


def test_packing_of_documents(spark, sf, library):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packed(packing.op7_packing(spark, sf).collect(), docs, library) == 0


def test_counts_of_documents(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = token_counts.op1_token_counts(spark, sf)
    assert dict(got.dtypes)["over_limit"] == "boolean"
    assert {r.doc_id: r.n_tokens for r in got.select("doc_id", F.col("n_tokens")).collect()} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in docs.items()}
