"""License scans, HTML extraction, media, quality, toxicity and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.llm import html_text, licenses, media, quality, toxicity

# --- licenses ---


def test_increasing():
    rng = random.Random(2)
    for _ in range(300):
        pairs = list(enumerate(rng.sample(range(12), rng.randint(0, 9))))
        got = licenses.increasing(pairs)
        best = [0] * len(pairs)
        for k, (_, b) in enumerate(pairs):
            best[k] = 1 + max([best[j] for j in range(k) if pairs[j][1] < b], default=0)
        assert len(got) == max(best, default=0) and all(x[1] < y[1] for x, y in zip(got, got[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=25), st.lists(st.sampled_from("abcdefg"), max_size=25))
def test_alignment_is_one(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def test_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choices("foo bar baz the of license a".split(), k=n))
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        for times in (1, 3):
            found = scanner.scan(" ".join(f"{filler(30)} {text}" for _ in range(times)) + " " + filler(20))
            assert [m.license for m in found if m.coverage == 1] == [name] * times, name
        if len(words) > 20:  # a changed copy
            changed = list(words)
            for k in rng.sample(range(len(words)), len(words) // 12):
                changed[k] = "changed"
            assert [m.license for m in scanner.scan(" ".join(changed))] == [name]
    assert scanner.scan("") == scanner.scan("the license of this software is public") == []


def test_prefilter_loses_nothing():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(7)
    for name, words in scanner.templates.items():
        for _ in range(50):
            drop = set(rng.sample(range(len(words)), int(0.2 * len(words) + 1e-9)))
            text = " ".join(w for k, w in enumerate(words) if k not in drop)
            assert any(s in text for s in scanner.stems), name


def test_alignment_covers_nearly_what_a_matcher_does():
    rng = random.Random(9)
    template = licenses.words(licenses.TEMPLATES["MIT-permission"])
    for _ in range(20):
        text = [w if rng.random() > 0.1 else "x" for w in template]
        brute = sum(b.size for b in SequenceMatcher(None, text, template, autojunk=False).get_matching_blocks())
        assert len(licenses.align(text, template)) >= 0.97 * brute


def test_notices_with_other_words_in_between():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(3)
    for name, t in scanner.templates.items():
        if len(t) < licenses.LONG:
            continue
        for times in (0.5, 1, 2, 3):
            junk = rng.choices("foo bar baz the of license a software".split(), k=int(times * len(t)))
            text = " ".join(["start", *t[: len(t) // 2], *junk, *t[len(t) // 2 :], "end"])
            assert [m.license for m in scanner.scan(text) if m.coverage >= 0.95] == [name], (name, times)
            assert len(licenses.align(licenses.words(text), t)) >= 0.8 * len(t)
        twice = " ".join([*t[: len(t) // 2], *junk, *t[len(t) // 2 :], *rng.choices("xx yy zz".split(), k=8 * len(t))] * 2)
        assert [m.license for m in scanner.scan(twice)] == [name] * 2
        far = " ".join([*t[: len(t) // 2], *rng.choices("xx yy zz".split(), k=7 * len(t)), *t[len(t) // 2 :]])
        assert scanner.scan(far) == []


def test_license_rows(spark):
    rows = [(1, "x " * 40000 + licenses.TEMPLATES["MIT"], 1), (1, licenses.TEMPLATES["MIT"], 1), (2, None, 1), (3, "", 1), (None, licenses.TEMPLATES["GPL-3.0"], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage int")
    assert sorted((str(r.doc_id), r.license) for r in licenses.license_matches(df).collect()) == [("1", "MIT"), ("1", "MIT"), ("None", "GPL-3.0")]
    assert licenses.license_matches(df.limit(0)).count() == 0


def test_licenses_of_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = {"MIT": "Released under the MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}
    expected = {(d, name) for d, t in docs.items() for name, x in plain.items() if x in t}
    assert {(r.doc_id, r.license) for r in licenses.op2_license_scans(spark, sf).collect()} == expected


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap">{open}<h1>Title &amp; more</h1><p>First <b>bold</b> and <i>it</i>alic
 text<br>next line.<p>Ti.</p><ul><li>one</li><li>two</li></ul><blockquote>Quoted &lt;words&gt;</blockquote><form><input><label>Mail</label></form><aside>Aside</aside>{close}
<div class="sidebar"><p>Popular posts</p></div></div><section id="comments"><p>Nice post!</p></section><footer>&copy; me</footer></body></html>"""
TEXT = "Title & more\n\nFirst bold and italic text next line.\n\nTi.\n\none\n\ntwo\n\nQuoted <words>"


@pytest.mark.parametrize(("begin", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_article(begin, end):
    assert html_text.main_text(PAGE.replace("{open}", begin).replace("{close}", end)) == TEXT


BLOCKS = re.compile(r"</?(?:article|div|section|p|h[1-6]|ul|ol|li|blockquote|pre|table|tr|td|hr)\b[^>]*>", re.I)


def blocks_of(markup):
    """The texts between block tags, by plain string work."""
    from html import unescape

    parts = [" ".join(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)).split()) for x in BLOCKS.split(re.sub(r"<!--.*?-->", "", markup, flags=re.S))]
    return "\n\n".join(t for t in (" ".join(unescape(x).split()) for x in parts) if t)


def test_pages_like_plain_string_work(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        pages = [r.html, r.html.replace("article>", "div>")]
        if len(article) > 400:  # beside an article of a few words a doubtful box is as good
            pages.append(r.html.replace("article>", "section>").replace('class="ad"', 'class="box-ad"'))
        for page in pages:
            assert html_text.main_text(page) == blocks_of(article), r.page_id


LINKS = "".join(f'<li><a href="/{k}"><b>Link</b> <i>{k}</i></a></li>' for k in range(12))
STORY = "".join(f"<p>A paragraph of the story, number {k}, that is long enough to be content and holds no tag at all.</p>" for k in range(6))


def test_ratios_choose_the_region(monkeypatch):
    page = f"<body><div><ul>{LINKS}</ul></div><div>{STORY}<p>End.</p></div><div><ul>{LINKS}</ul></div></body>"
    assert html_text.main_text(page) == blocks_of(STORY + "<p>End.</p>")
    lead = f"<body><ul>{LINKS}</ul><div><p>A lead of one sentence that stands before the story in a box of its own.</p></div><div>{STORY}</div><ul>{LINKS}</ul></body>"
    assert html_text.main_text(lead) == blocks_of(lead.replace(LINKS, ""))
    two = f"<body><article>{STORY}</article><article><p>Short one.</p></article><ul>{LINKS}</ul></body>"
    assert html_text.main_text(two) == blocks_of(STORY + "<p>Short one.</p>")
    monkeypatch.setattr(html_text, "smooth", lambda ratios, sigma: np.ones(len(ratios)))
    assert html_text.main_text(page) != blocks_of(STORY + "<p>End.</p>")


@pytest.mark.parametrize("name", ["share-price", "side", "comment", "notice", "related-work", "disclaimer", "search-results", "ad"])
def test_names_of_paragraphs_do_not_matter(name):
    page = f'<body><nav>Menu</nav><article>{STORY}<p class="{name}">Part of the story.</p><div class="ad"><p>Buy!</p></div></article></body>'
    assert html_text.main_text(page) == blocks_of(STORY + "<p>Part of the story.</p>")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/!-[]ap \"'=&;#x0", max_size=60))
def test_any_markup_is_read(text):
    assert isinstance(html_text.main_text(text), str)
    assert [x["position"] for x in media.sequence_of(text)] == list(range(len(media.sequence_of(text))))


def test_page_rows(spark):
    df = spark.createDataFrame([(1, None, "u", 5), (2, "", "u", 5), (3, "<p>a&nbsp;b &#228;</p>", None, 5), (3, "<p>a</p>", None, 5), (None, "<article>" + "<p>long text</p>" * 20000, None, 5)], "page_id long, html string, url string, text int")
    got = html_text.extract(df)
    assert sorted((str(r.page_id), r.n_chars) for r in got.collect()) == [("1", 0), ("2", 0), ("3", 1), ("3", 5), ("None", 20000 * 9 + 19999 * 2)]
    assert dict(got.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert html_text.extract(df.limit(0)).count() == 0


# --- media ---


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_payloads_come_back(data):
    payload = media.payload_of(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(data)
    samples = media.decode(media.encode(payload))
    assert samples.tobytes() == payload
    assert media.feature(samples) == media.feature(media.decode(media.encode(payload)))


def test_damage_is_noticed():
    stored = bytearray(media.encode(media.payload_of(b"abc")))
    stored[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(stored))
    with pytest.raises(ValueError):
        media.decode(b"GIF")


def test_sequences(spark):
    html = '<p>before <b>it</b></p><figure><img data-digest="d1" alt="x"><figcaption>Cap <i>tion</i></figcaption></figure><p>after</p><img src="u.png" alt="Alt"><script>no()</script>'
    items = media.sequence_of(html)
    assert [(x["kind"], x["text"], x["caption"]) for x in items] == [("text", "before it", None), ("media", None, "Cap tion"), ("text", "after", None), ("media", None, "Alt")]
    pages = spark.createDataFrame([(1, html), (2, None), (1, html), (None, html), (3, "<p>text</p>")], "page_id long, html string")
    payloads = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"abc"),), (None,)], "data binary")
    stored = media.store(payloads)
    rows = {r.digest: r for r in stored.collect()}
    assert set(rows) == {hashlib.sha256(b"abc").hexdigest(), hashlib.sha256(b"").hexdigest()}
    assert all(media.decode(bytes(r.media)).tobytes()[: r.n_bytes] in (b"abc", b"") for r in rows.values())
    known = media.described(stored).withColumn("digest", F.when(F.col("n_bytes") == 3, "d1").otherwise(F.col("digest")))
    found = media.resolve(media.interleave(pages), known).collect()
    assert sorted(str(r.page_id) for r in found) == ["1", "1", "2", "3", "None"] and len({r.row for r in found}) == 5
    got = {r.page_id: r["items"] for r in found}
    assert got[2] == [] and [x.text for x in got[3]] == ["text"]
    for items in (got[1], got[None]):
        assert [(x.position, x.kind, x.caption) for x in items] == [(0, "text", None), (1, "media", "Cap tion"), (2, "text", None), (3, "media", "Alt")]
        assert items[1].media_bytes and items[3].media_bytes is None
    assert media.resolve(media.interleave(pages.limit(0)), known.limit(0)).count() == 0


def samples_of(png):
    """A PNG read by the format's own rules, without the operator's code."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        assert zlib.crc32(png[at + 4 : at + 8 + size]) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
        chunks.append((png[at + 4 : at + 8], png[at + 8 : at + 8 + size]))
        at += 12 + size
    assert [n for n, _ in chunks][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    width, height = (int.from_bytes(chunks[0][1][k : k + 4], "big") for k in (0, 4))
    assert chunks[0][1][8:] == bytes([8, 2, 0, 0, 0])
    raw = zlib.decompress(b"".join(b for n, b in chunks if n == b"IDAT"))
    lines = [raw[k * (3 * width + 1) : (k + 1) * (3 * width + 1)] for k in range(height)]
    assert len(raw) == height * (3 * width + 1) and not any(x[0] for x in lines)
    return b"".join(x[1:] for x in lines), width, height


def test_images_by_another_reader():
    rng = random.Random(8)
    for n in (0, 1, 191, 192, 193, 5000):
        data = rng.randbytes(n)
        back, width, height = samples_of(media.encode(media.payload_of(data)))
        assert back == data + b" " * (len(back) - n) and width == 64 and len(back) == 192 * height == max(1, -(-n // 192)) * 192


def test_media_come_in_small_batches(spark, tmp_path, monkeypatch):
    text = F.repeat(F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") == 7, 100_000).otherwise(80))  # one of 6.4 MB, else 5 KB
    spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    notes = tmp_path / "notes"
    notes.mkdir()
    kind = type(spark.range(1))
    plain, path = kind.mapInArrow, str(notes)

    def noted(self, func, schema, *more):
        def run(batches):
            import os
            import uuid

            def note(out):
                for batch in batches:
                    out.write(f"{batch.num_rows} {batch.nbytes}\n")
                    yield batch

            with open(os.path.join(path, uuid.uuid4().hex), "w") as out:
                yield from func(note(out))

        return plain(self, run, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    got = media.op9_media_columns(spark, str(tmp_path)).select("doc_id", "n_bytes", "digest").collect()
    assert [spark.conf.get(k) for k in keys] == before
    assert {r.doc_id: r.n_bytes for r in got} == {k: 6_400_000 if k == 7 else 5120 for k in range(4000)} and len(got) == 4000
    assert all(r.digest == hashlib.sha256(hashlib.sha256(str(r.doc_id).encode()).hexdigest().encode() * (r.n_bytes // 64)).hexdigest() for r in got)
    batches = [tuple(map(int, line.split())) for p in notes.iterdir() for line in p.read_text().splitlines()]
    assert sum(rows for rows, _ in batches) >= 3 * 4000  # stored, described, put in sequences
    # a batch ends with the row that fills it
    assert all(size < 3_000_000 or size < 10_000_000 and rows < 1000 for rows, size in batches) and sum(size >= 3_000_000 for _, size in batches) <= 2


def test_media_of_documents(spark, sf):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op9_media_columns(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = docs[r.doc_id]
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        image = media.encode(p)
        assert r.media_sha256 == hashlib.sha256(image).hexdigest() and r.media_bytes == len(image)
        rows = np.frombuffer(samples_of(image)[0], dtype=np.uint8).reshape(-1, 3)
        mean, deviation = rows.mean(axis=0, dtype=float), rows.std(axis=0, dtype=float)
        assert [float(x) for x in r.feature.split(",")[:6]] == pytest.approx([*mean, *deviation], abs=1e-3)


# --- classifiers ---

AWKWARD = [(1, None, "x"), (2, "", "x"), (3, "word " * 30000, "x"), (3, "word", "x"), (None, "plain text of a few words.", "x"), (4, "\n\n", None)]


@pytest.fixture(scope="module")
def tables():
    return lambda spark, sf: (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def auc(scores, labels):
    rank = np.empty(len(scores))
    rank[np.argsort(scores)] = np.arange(len(scores))
    p = labels.sum()
    return (rank[labels == 1].sum() - p * (p - 1) / 2) / (p * (len(labels) - p))


def test_rules_compile_to_the_same_logits(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"], trees=10)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = np.array([r.l for r in df.select(model.logit({n: F.col(n) for n in "abc"}).alias("l")).collect()])
    assert ((got > 0) == (y > 0)).mean() > 0.97
    one = quality.fit_rules(x, np.ones(400), ["a", "b", "c"])
    assert one.intercept > 0 and not one.rules
    assert quality.fit_rules(np.zeros((0, 3)), np.zeros(0), ["a", "b", "c"]).intercept == 0


def test_quality_held_out(spark, tables):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out()).select("score", "predicted", "quality").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97
    assert (got.predicted == got.quality).mean() > 0.95


def test_quality_rows(spark, tables, sf):
    docs, labels = tables(spark, sf)
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, score string").withColumn("_stats", F.lit(1)).withColumn("row", F.lit(2))
    model = quality.fit(docs, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all((r._stats, r.row) == (1, 2) for r in got)
    assert quality.score(df.limit(0), model).count() == 0 and quality.accepted(df, model).columns == df.columns
    assert quality.fit(docs.limit(0), labels).rules == () and quality.fit(docs, labels.limit(0)).rules == ()
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out().alias("h")).collect()}
    assert held == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in held}


def test_toxicity_held_out(spark, tables):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    chain = toxicity.fit(docs, labels)
    assert chain.names == ("blunt", "veiled", "toxic") and np.allclose(chain.links, np.tril(chain.links, -1)) and chain.links.any()
    some = labels.where(quality.held_out())
    got = toxicity.score(docs.join(some.select("doc_id"), "doc_id", "left_semi"), chain).join(some, "doc_id").toPandas()
    caught = got[got.toxic == 1].p_toxic >= 0.5
    false = got[got.toxic == 0].p_toxic >= 0.5
    assert caught.mean() > 0.8 and false.mean() < 0.01


def test_toxicity_rows(spark, tables, sf):
    docs, labels = tables(spark, sf)
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, p_toxic string")
    chain = toxicity.fit(docs, labels)
    assert toxicity.score(df, chain).count() == len(AWKWARD) and toxicity.score(df.limit(0), chain).count() == 0
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(df, none).count() == len(AWKWARD)


def test_parts_of_the_label():
    x = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 1, 0], [1, 1, 1, 1], [0, 0, 0, 0]], dtype=bool)
    got = toxicity.weak_categories(x, np.array([True, True, True, False, True]))
    assert {k: v.tolist() for k, v in got.items()} == {"blunt": [1, 1, 0, 0, 0], "veiled": [0, 1, 1, 0, 0], "toxic": [1, 1, 1, 0, 1]}


def test_one_training_row_for_an_id(spark):
    docs = spark.range(5000).selectExpr("7L doc_id", "concat('text ', id) text", "1 y").unionByName(spark.createDataFrame([(8, "other", 1)], "doc_id long, text string, y int"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (9, None), (None, 1)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, "quality", max_rows=10)
    assert sorted((r.doc_id, r.y) for r in rows.collect()) == [(7, 0.5), (8, 1.0)]
    assert quality.training_rows(docs, labels, "quality", max_rows=1).count() == 1


def plain_statistics(text):
    import math
    import unicodedata

    words = re.split(r"[ \t\n\x0b\f\r]+", text.strip(" \t\n\r"))
    n, count = len(text), len(words)
    white, kind = set(" \t\n\x0b\f\r"), [unicodedata.category(c) for c in text]
    sign = [k[0] not in "LN" and c not in white for c, k in zip(text, kind)]
    runs = lambda marks, least: sum(1 for on, g in itertools.groupby(marks) if on and len(list(g)) >= least)
    return {
        "length": math.log1p(n), "word_length": n / max(count, 1), "distinct": len(set(words)) / max(count, 1),
        "upper": kind.count("Lu") / max(n, 1), "shouted": runs([k == "Lu" for k in kind], 2) / max(count, 1), "digits": sum(c in "0123456789" for c in text) / max(n, 1),
        "signs": sum(s and c not in ".,;:'\"()!?-" for c, s in zip(text, sign)) / max(n, 1), "sign_runs": runs(sign, 2) / max(count, 1),
        "stops": sum(c in ".!?" and (k + 1 == n or text[k + 1] in white) for k, c in enumerate(text)) / max(count, 1), "lines": text.count("\n") / max(count, 1),
        "lone_signs": sum(bool(w) and all(unicodedata.category(c)[0] not in "LN" for c in w) for w in words) / max(count, 1),
    }


def test_statistics_like_plain_python(spark, sf):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["".join(rng.choices(["a", "B", "CD", " ", "  ", "\n", "\t", "1", ".", "!!", "--", "é", "Ä", "word", "©", "'"], k=rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = df.select("k", F.struct(*[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).alias("s")).collect()
    for r in got:
        for name, value in plain_statistics(texts[r.k]).items():
            assert r.s[name] == pytest.approx(value), (name, texts[r.k])


def test_out_of_fold_links_are_learned():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 4)) < 0.3).astype(np.float32)
    labels = {"a": x[:, 0].astype(float), "b": ((x[:, 0] + x[:, 1]) > 0).astype(float)}
    chain = toxicity.fit_chain(x, labels, list("wxyz"))
    p = chain.probabilities(x @ chain.words.T)
    assert ((p[:, 1] > 0.5) == labels["b"]).mean() > 0.95
