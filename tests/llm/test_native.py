"""Secret scans, near duplicates and decontamination: no Python on the executors, and right on awkward rows."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shardloom.llm import decontamination, near_dups, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ScanExistingRDD.*py", plan)


# --- secrets ---

PARTS = ["token", "TOKEN", "pass", "word", "password", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abcdefgh", "short", "é", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "abcdef", "中", "\n", "secret", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890ab", "eyJ"]
ASCII_ONLY = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = []
    for k, r in enumerate(secrets.RULES):
        pattern = ASCII_ONLY if r.kind == "assign" else re.compile(r.pattern)
        found += [(m.start(), k, r.kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(r.group)) >= r.least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choices(PARTS, k=rng.randint(0, 14))), 1, "low") for k in range(1500)]
    rows += [(1, 'token = "abcdefgh1"', None, None), (9000, None, None, None), (9001, "", None, None), (None, "AKIA" + "B" * 12, None, None), (9002, "x " * 50000 + "secret: 12345678 " * 30, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_hex int, spans string")


def test_spans(leaky):
    got = secrets.secret_spans(leaky)
    no_python(secrets.secret_spans(leaky.sparkSession.range(3).selectExpr("id doc_id", "string(id) text")))
    expected = sorted((str(r.doc_id), brute(r.text)) for r in leaky.collect())
    assert sorted((str(r.doc_id), r.spans) for r in got.collect()) == expected
    assert secrets.secret_spans(leaky.limit(0)).count() == 0


def test_spans_like_sql(compare):
    compare(secrets.op3_secret_scans, secrets.sql())


def holds(query, low):
    if query is True or isinstance(query, str):
        return query is True or query in low
    return (all if query[0] == "and" else any)(holds(q, low) for q in query[1])


@pytest.mark.parametrize("segments", [1, 7])
def test_index_gives_the_texts_that_satisfy_the_queries(leaky, segments):
    index = secrets.postings(leaky, segments=segments)
    found = {r.t: r.rules for r in secrets.candidates(index).collect()}
    no_python(secrets.candidates(secrets.postings(leaky.sparkSession.range(3).selectExpr("string(id) text"))))
    for r in leaky.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect():
        for k, rule in enumerate(secrets.RULES):
            query = secrets.trigram_query(rule.pattern)
            held = bool(found.get(r.t, 0) & 1 << k)
            assert held == (query is not True and holds(query, (r.text or "").lower()))
            assert held or query is True or f"{rule.kind}:" not in brute(r.text)
    assert secrets.candidates(secrets.postings(leaky.limit(0))).count() == 0


def test_rules_without_trigrams_only(spark):
    hex_only = tuple(r for r in secrets.RULES if r.kind == "hex")
    df = spark.createDataFrame([(1, "a" * 32 + " b"), (2, "none")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.secret_spans(df, hex_only).collect()} == {1: "hex:0:32", 2: ""}


def test_many_matches_in_blocks(spark, monkeypatch):
    run, text = "0123456789abcdef" * 2, "x y"
    many = " ".join([run] * 5000)
    df = spark.createDataFrame([(1, many), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_spans(df).collect()}
    assert got == {1: brute(many), 2: ""}


def test_redaction(spark, leaky):
    clean = secrets.redact(leaky)
    assert clean.columns == leaky.columns
    rows = [(1, 'a token = "abcdefgh1" b', "l", "n", "r"), (2, None, "l", "n", "r"), (3, "token = short", "l", "n", "r")]
    one = spark.createDataFrame(rows, "doc_id long, text string, _low string, now string, row string")
    got = secrets.redact(one).collect()
    assert {r.doc_id: r.text for r in got} == {1: 'a [assign]" b', 2: None, 3: "token = short"}
    assert all((r._low, r.now, r.row) == ("l", "n", "r") for r in got) and got[0].__fields__ == one.columns


# --- near duplicates ---


def shingle_set(text):
    w = WORD.findall((text or "").translate(str.maketrans(near_dups.UPPER, near_dups.LOWER)))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def groups_of(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            holders[h].append(i)
    for i, s in sets.items():
        for j in {j for h in s for j in holders[h] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 85 * len(s | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(rng, size, members, edits):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    for _ in range(members):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(size)] = f"e{rng.randint(0, 9999)}"
        yield " ".join(text)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    texts = [t for size, members, edits in [(200, 60, 12), (40, 30, 3), (20, 20, 1), (500, 15, 40), (7, 20, 1), (100, 25, 0)] for t in family(rng, size, members, edits)]
    chain = [f"c{k}" for k in range(300)]
    for _ in range(12):  # neighbours are alike, ends are not
        texts.append(" ".join(chain))
        at = rng.randrange(280)
        chain[at : at + 12] = [f"n{rng.randint(0, 9999)}" for _ in range(12)]
    texts += ["", "   ", "one", "One", "one two", "ONE  two", "É x y z", "é x y z", "a\tb\nc", "A B C", "tie " * 1000]
    rng.shuffle(texts)
    return dict(enumerate(texts)) | {5000: None, 5001: "word " * 30000}


def test_groups(spark, copies):
    rows = [(k, t, "x", 1) for k, t in copies.items()] + [(3, copies[3], "y", 2), (None, copies[4], "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int")
    got = near_dups.near_duplicates(df)
    named = [r for r in got.collect() if r.doc_id is not None]
    assert len(named) == len(copies)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in named} == groups_of(copies)
    assert all(r.kept == (r.doc_id == r.component_id) for r in named)
    lone = [r for r in got.collect() if r.doc_id is None]
    assert len(lone) == 1 and lone[0].component_id == groups_of(copies)[4][1] and not lone[0].kept
    no_python(got)


def test_ids_with_several_texts_and_rows_without(spark):
    first, other, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, first, "a"), (1, other, "b"), (1, other, "b"), (2, first + " end", "c"), (None, other, "d"), (None, third, "e"), (None, third, "e"), (None, None, "f"), (3, "", "g"), (4, None, "h"), (3, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    kept = near_dups.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.k for r in kept.collect()) == ["a", "b", "e", "f", "g", "h"]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(df).where("n_shingles > 0").collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True)], key=str)


def test_hot_keys_are_spread(spark):
    from shardloom.llm import common

    big = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, id, -1) a", "'x' b")
    small = spark.createDataFrame([(-1, "x", "hot"), (3, "x", "cold"), (-1, "y", "no")], "a long, b string, c string")
    hot = common.hot_keys(big, ["a", "b"], 30_000)
    assert [tuple(r) for r in hot.collect()] == [(-1, "x")] and common.hot_keys(big, ["id"], 30_000) is None
    for how, rows, hits in (("inner", 20_001, 20_000), ("left", 30_000, 20_000), ("left_anti", 9_999, 0)):
        out = common.salted_join(big, small, ["a", "b"], ["id"], how, hot)
        assert out.count() == rows and (not hits or out.where("c = 'hot'").count() == hits)
    spread = common.salted_join(big, small, ["a", "b"], ["id"], "left", hot).where("a = -1")
    assert max(r.n for r in big.where("a = -1").groupBy(F.pmod(F.xxhash64("id"), F.lit(common.SALTS))).agg(F.count(F.lit(1)).alias("n")).collect()) < 500
    assert spread.count() == 20_000
    left = common.without(big, small, ["a", "b"], ["id"], 30_000)
    assert left.count() == 9_999 and left.columns == big.columns


def test_many_equal_and_empty_texts(spark):
    same = spark.range(60_000).selectExpr("id doc_id", "if(id % 3 = 0, '', if(id % 3 = 1, 'one and the same text', concat('text number ', id, ' of its own', id))) text")
    got = near_dups.near_duplicates(same)
    assert got.where("kept").count() == 20_000 + 1 + 20_000
    assert got.where("component_id = 1").count() == 20_000


def test_salted_buckets_change_nothing(spark, copies, monkeypatch):
    monkeypatch.setattr(near_dups, "SALT_SIZE", 3)
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()} == groups_of(copies)


def test_variants_of_one_text_are_not_compared_with_each_other(spark, monkeypatch):
    rng, base, compared = random.Random(5), [f"w{k}" for k in range(300)], []
    texts = {}
    for i in range(120):  # alike with the base, not with each other
        text = list(base)
        for k in rng.sample(range(0, 300, 6), 5):
            text[k] = f"e{rng.randint(0, 9999)}"
        texts[i] = " ".join(text)
    texts[500] = " ".join(base)

    def cut(df):
        out = kept(df)
        if out.columns == ["a", "b"]:
            compared.append(out.count())
        return out

    kept = near_dups.cut
    monkeypatch.setattr(near_dups, "cut", cut)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()} == groups_of(texts)
    assert sum(compared) < 5 * len(texts)


def test_parities_differ_by_no_more_than_their_sets(spark):
    rng = random.Random(2)
    sets = {0: set()} | {r: {rng.randrange(-(2**63), 2**63) for _ in range(rng.randint(1, 900))} for r in range(1, 12)}
    sets |= {20 + r: set(rng.sample(sorted(s), len(s) * 9 // 10)) for r, s in sets.items()}
    rows = near_dups.parities(spark.createDataFrame([(r, list(s)) for r, s in sets.items() if s], "r long, set array<long>")).collect()
    bits = {row.r: sum((v & (2**64 - 1)) << 64 * w for w, v in enumerate(row[1:])) for row in rows}
    for r, b in bits.items():
        expected = 0
        for h in sets[r]:
            expected ^= 1 << h % near_dups.PARITY_BITS
        assert b == expected
    assert all((bits[r] ^ bits[q]).bit_count() <= len(sets[r] ^ sets[q]) for r in bits for q in bits)


def test_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(empty).count() == 0
    apart = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(apart).collect()} == {1: 1, 2: 2, 3: 3}


def test_groups_of_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = near_dups.op6_minhash_near_dups(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups_of(texts)


def test_groups_like_sql(compare):
    compare(near_dups.op6_minhash_near_dups, near_dups.sql())


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (91, 100), (7, 7)], "a long, b long")
    v = spark.createDataFrame([(k,) for k in [*range(41), 90, 91, 100, 200]], "v long")
    got = {r.v: r.c for r in near_dups.components(edges, v).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 91: 90, 100: 90, 200: 200}


def test_sketch_bound_is_wide_enough():
    rng = random.Random(0)
    bound = near_dups._bound(80, 0.85, 256)
    worst = 0
    for _ in range(3000):
        differ = sum(rng.random() > 0.85 for _ in range(80))
        flips = [rng.randrange(256) for _ in range(2 * differ)]
        worst = max(worst, sum(flips.count(b) % 2 for b in set(flips)))
    assert worst <= bound


# --- decontamination ---


def test_items_like_sql(compare):
    compare(decontamination.op10_benchmark_decontamination, decontamination.sql())


def test_whole_items_are_found(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.op10_benchmark_decontamination(spark, sf).collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole <= got and len({d for d, _ in got - whole}) <= 0.02 * len(docs)


def test_slots(spark):
    item = "the train from Berlin leaves with 12 crates while another train from Berlin carries only 5 km more goods than before"
    bench = spark.createDataFrame([(1, item, "t"), (2, "short one here", "t"), (3, None, "t"), (4, "", "t"), (5, "Anna Anna Anna", "t"), (6, "yes", "t"), (7, "yes or", "t")], "item_id long, text string, doc_id string")
    other = item.replace("Berlin", "Paris").replace("12", "99").replace("km", "miles")
    mixed = other.replace("Paris carries", "Rome carries")
    rows = [(1, f"some words before {other} and after", 0), (2, mixed, 0), (3, "So SHORT one here!", 0), (4, None, 0), (None, item, 0), (5, "the train from", 0), (6, item, 0), (6, item, 0), (7, item.upper(), 0), (8, "Anna Anna Anna", 0), (9, "filler " * 20000 + item, 0), (10, "yes or no, yes", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = decontamination.contaminated(docs, bench)
    found = {(r.doc_id, r.item_id): r.exact for r in got.collect()}
    assert found == {(1, 1): False, (3, 2): True, (6, 1): True, (9, 1): True}
    assert decontamination.contaminated(docs, bench, broadcast_rows=0).count() == len(found)
    clean = decontamination.without_items(docs.withColumn("part", F.lit("clash")), bench)
    assert clean.columns == [*docs.columns, "part"]
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["10", "2", "4", "5", "7", "8"]
    no_python(got)
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs.select("doc_id", F.lit("Pure new words without any shared passage").alias("text")), bench).count() == 0


def test_items_in_another_case(spark):
    item = "The train from Berlin leaves with 12 crates while Anna in Paris carries only 5 km more goods than Straße does"
    other = "ONLY A FEW OF THESE WORDS ARE THE SAME AS IN AN ITEM, NOT ENOUGH OF THEM"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"before. {item.upper()} after"), (2, item.lower()), (3, item.title()), (4, item), (5, item.upper().replace("12", "99")), (6, other), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contaminated(docs, bench, any_case=True)
    assert {r.doc_id: (r.coverage, r.exact) for r in got.collect()} == {1: (1, True), 2: (1, True), 3: (1, True), 4: (1, True), 5: (1, False)}
    no_python(got)
    plain = {tuple(r) for r in decontamination.contaminated(docs, bench).collect()}
    assert plain <= {tuple(r) for r in got.collect()} and 1 not in {r[0] for r in plain}


def generated(df):
    """Rows that the generators of a frame's plan made when it was collected."""

    def walk(node):
        name = node.nodeName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
        return (node.metrics().apply("numOutputRows").value() if name == "Generate" else 0) + sum(map(walk, inner))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_only_texts_that_may_hold_an_item_are_cut_into_windows(spark, monkeypatch):
    item = "the train from Berlin leaves with 12 crates while another train from Berlin carries only 5 km more goods than before"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = [(n, " ".join(f"word{'abcdefghij'[(n + k) % 10]}{'xyz'[k % 3]}" for k in range(100)) + " the train from Berlin only") for n in range(200)]
    docs = spark.createDataFrame([*clean, (1000, f"before {item.upper()} after"), (1001, item), (1002, item.replace("Berlin", "Rome"))], "doc_id long, text string")
    frames = []
    monkeypatch.setattr(decontamination, "written", lambda df, written=decontamination.written: frames.append(df) or written(df))
    got = decontamination.contaminated(docs, bench, any_case=True)
    assert {r.doc_id for r in got.collect()} == {1000, 1001, 1002}
    hits = next(f for f in frames if {"t", "h", "p"} <= {*f.columns})
    assert 0 < generated(hits) < 200


def test_clearing_texts_by_pairs_loses_nothing(spark, sf):
    sides = [
        "one two three", "Eins zwei drei Straße", "ΟΔΟΣ ΟΔΟΥΣ ΛΟΓΟΣ ΤΕΛΟΣ", "İstanbul Diyarbakır ılık İĞNE DEĞİL", "a 1 b 2 c 3 d 4 e", "Anna 7 km der weg Otto 8 km die bahn Eva 9 cm das rad",
        "un deux trois quatre cinq six sept huit neuf", "x" * 300 + " yy zz " + "w" * 300, "same same same same same same same same same same",
    ]
    bench = spark.createDataFrame(list(enumerate(sides)), "item_id long, text string")
    rows = [(f"{n}{case.__name__}", f"vor {case(x)}, nach") for n, x in enumerate(sides) for case in (str, str.upper, str.lower, str.title)]
    rows += [("half", " ".join(sides[6].split()[:8])), ("none", None), ("empty", ""), ("signs", "... !"), ("copies", ". ".join(sides * 3))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    for options in ({}, {"any_case": True}, {"any_case": True, "literals": 2, "least": 1}, {"any_case": True, "coverage": 0.0}, {"any_case": True, "coverage": 1.0}, {"width": 3}):
        found = plain(decontamination.contaminated(docs, bench, **options))
        assert found and found == plain(decontamination.contaminated(docs, bench, broadcast_rows=0, **options))
    docs, bench = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    found = plain(decontamination.contaminated(docs, bench, any_case=True))
    assert found and found == plain(decontamination.contaminated(docs, bench, any_case=True, broadcast_rows=0))
