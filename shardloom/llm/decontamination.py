"""Benchmark decontamination (operator 10), with DataFrame functions only.

Texts become template tokens: numbers, names (capitalised words) and units turn
into typed placeholders, other words are lower-cased, signs are dropped.
Windows of ``width`` template tokens are hashed and joined to the windows of
the benchmark items, of which only those with ``literals`` plain words count.
Hits on one diagonal (document position less item position) are then checked
for slot consistency: a value of the item must stand for the same value of the
document throughout, so that questions with changed numbers or names are found
and texts that only look alike are not.  A document is reported for an item if
consistent hits cover ``coverage`` of the item's windows.

With ``any_case`` items and documents are also compared by a second, case-blind
form, in which only numbers and units are slots: in a text that is all capitals,
all small or in title case names can't be told from other words.  A document is
reported if either form reaches the coverage, with the figures of the first one
that does.  The query, as its SQL, goes by the first form alone; the pipeline
by both.

Items shorter than a window are compared as a whole, in windows of their own
length, but never by fewer than ``least`` plain words: one word isn't a
question.  The benchmark's windows are broadcast only if they are few
(``broadcast_rows``, of some 60 bytes each); otherwise the join shuffles, its
hot windows salted.

Most texts share no window with any item, so where the windows are few, texts
are first cleared by pairs: each counted window marks its longest two plain
words that stand side by side, case-blind, and a text without that pair does
not hold the window in either form.  Only texts whose pairs stand for enough
windows of an item to reach the coverage are cut into windows.  If some window
has no such two words (it can't be so with the usual ``literals``), all texts
are.

Whether a text holds an item depends on the text alone, so copies of a text are
one from the hits on, and each text is judged by itself.  Slots are compared
token by token in joins on (text, position): no text is copied for its hits,
however many it has.

Rows: one per contaminated (id, item).  Null and empty texts and items, and
items with too few plain words, match nothing; rows without an id are left out
of the result, but ``without_items`` judges them too.  Of an id with several
texts, or an item with several wordings, the largest figures count.  Very long
texts give many windows, which are streamed.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import hot_keys, maybe_among, salted_join, table, text_of, without, written

TOKEN = r"\d+(?:[.,:]\d+)*|[\p{L}\p{M}]+"
NAME = r"^\p{Lu}\p{Ll}+$"
UNITS = "mm cm dm km mi ft inch inches mile miles metre metres meter meters mg kg gram grams tonne tonnes lb lbs oz ml litre litres liter liters ms sec secs second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds cent cents degree degrees kmh mph watt watts kw kwh".split()
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = "<number>", "<name>", "<unit>"
WIDTH, LITERALS, LEAST, COVERAGE = 8, 5, 3, 0.5
BROADCAST_ROWS = 1_000_000
#: Parts that the join on hot windows is spread over.
PARTS = 16


def tokens(text: Column) -> Column:
    """The tokens of a text as written."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def canonical(token: Column) -> Column:
    """A token's template form."""
    return (
        F.when(token.rlike(NAME), F.lit(NAME_SLOT))
        .when(token.rlike(r"^\d"), F.lit(NUMBER_SLOT))
        .when(F.lower(token).isin(UNITS), F.lit(UNIT_SLOT))
        .otherwise(F.lower(token))
    )


def folded(token: Column) -> Column:
    """A token without its case; ß is written SS in capitals."""
    return F.replace(F.lower(token), F.lit("ß"), F.lit("ss"))


def blind(token: Column) -> Column:
    """A token's case-blind form, in which names are words like others."""
    low = folded(token)
    return F.when(token.rlike(r"^\d"), F.lit(NUMBER_SLOT)).when(low.isin(UNITS), F.lit(UNIT_SLOT)).otherwise(low)


#: Form of a token and what its slots are compared by, by number of the form.
FORMS = ((canonical, lambda token: token), (blind, folded))


def _windows(hashes: str, width: Column, form: int = 0) -> Column:
    """Hashes of all windows of ``width`` (at most WIDTH) token hashes of a form; empty if there are fewer tokens."""
    at = lambda i: F.xxhash64(*[F.lit(form)] * (form > 0), width, F.slice(hashes, i + 1, width))
    n = F.size(hashes)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), at)).otherwise(F.array().cast("array<bigint>"))


def templates(items: DataFrame, width: int, literals: int, least: int, form: int = 0) -> DataFrame:
    """``i, q, w, h, total, k, g`` of every counted window of the items (``i, text``): first position, width, hash, the item's number of them, the form, and the hash of its marked pair, null if it has none."""
    t = items.select("i", tokens(F.col("text")).alias("raw")).withColumn("form", F.transform("raw", FORMS[form][0]))
    t = t.withColumn("hashes", F.transform("form", lambda f: F.xxhash64(f))).withColumn("w", F.least(F.lit(width), F.size("form"))).where("w > 0")
    slots = F.array(F.lit(NUMBER_SLOT), F.lit(NAME_SLOT), F.lit(UNIT_SLOT))
    is_word = lambda j: ~F.array_contains(slots, F.get("form", j))
    word = lambda j: F.get("raw", j)
    pair = lambda j: F.when(is_word(j) & is_word(j + 1), F.struct((F.length(word(j)) + F.length(word(j + 1))).alias("n"), F.xxhash64(F.xxhash64(folded(word(j))), F.xxhash64(folded(word(j + 1)))).alias("g")))
    t = t.withColumn("pairs", F.transform(F.sequence(F.lit(0), F.size("raw") - 1), pair))
    flat = t.select("i", "w", "form", "pairs", F.posexplode(_windows("hashes", F.col("w"), form)).alias("q", "h"))
    flat = flat.withColumn("g", F.array_max(F.slice("pairs", F.col("q") + 1, F.col("w") - 1))["g"])
    plain = F.size(F.filter(F.slice("form", F.col("q") + 1, F.col("w")), lambda f: ~F.array_contains(slots, f)))
    counted = flat.where(plain >= F.greatest(F.least(F.lit(literals), F.col("w")), F.lit(least))).groupBy("i", "w", "h").agg(F.min("q").alias("q"), F.min("g").alias("g"))
    total = counted.groupBy("i").agg(F.count(F.lit(1)).alias("total"))
    return counted.join(total, "i").select("i", "q", "w", "h", "total", F.lit(form).alias("k"), "g")


def may_hold(texts: DataFrame, bench: DataFrame, coverage: float) -> DataFrame:
    """The rows of ``texts`` (``t, u, text``) whose pairs allow for the coverage of an item, and few others; all rows if some window of ``bench`` has no pair."""
    if not bench.where("g is null").isEmpty():
        return texts
    # Joined by blanks, words are lower-cased as they are alone; no word holds a blank.
    words = F.split(folded(F.array_join(tokens(F.col("text")), " ")), " ")
    hashed = texts.select("t", "u", F.transform(words, lambda w: F.xxhash64(w)).alias("a"))
    zipped = F.arrays_zip(F.slice("a", 1, F.size("a") - 1).alias("a"), F.slice("a", 2, F.size("a")).alias("b"))
    pairs = hashed.select("t", "u", F.explode(zipped).alias("x")).select("t", "u", F.xxhash64("x.a", "x.b").alias("g"))
    marks = bench.groupBy("g", "i", "k", "total").agg(F.count(F.lit(1)).alias("n"))
    seen = pairs.join(F.broadcast(marks), "g").select("t", "u", "i", "k", "total", "g", "n").distinct().groupBy("t", "u", "i", "k", "total").agg(F.sum("n").alias("n"))
    able = written(seen.where(F.col("n") >= coverage * F.col("total")).select("t", "u").distinct())
    return maybe_among(texts, ["t", "u"], able).where("maybe").drop("maybe")


def _text_key(text: str) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text_of(text)).alias("t"), F.xxhash64(F.lit(7), text_of(text)).alias("u")]


def _by_form(of: list[Column]) -> Column:
    return reduce(lambda x, k: F.when(F.col("k") == k, of[k]).otherwise(x), range(1, len(of)), of[0])


def items_in_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, literals: int = LITERALS, least: int = LEAST, coverage: float = COVERAGE, broadcast_rows: int = BROADCAST_ROWS, any_case: bool = False) -> DataFrame:
    """``t, u, item, n_windows, coverage, exact`` of every distinct text (two hashes, ``t`` and ``u``) that holds an item."""
    forms = range(len(FORMS) if any_case else 1)
    # Wordings of an item are items of their own until the end.
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), text_of(item_text).alias("text"))
    items = written(items.distinct().select(F.xxhash64(F.col("item").cast("string"), "text").alias("i"), "item", "text"))
    bench = written(reduce(DataFrame.union, [templates(items, width, literals, least, k) for k in forms]))
    widths = sorted(r.w for r in bench.select("w").distinct().collect())  # at most ``width`` values
    few = bench.count() <= broadcast_rows
    d = docs.select(*_text_key(text), text_of(text).alias("text"))
    searched = may_hold(d, bench, coverage) if few else d
    bench = bench.drop("g")
    hashed = searched.select("t", "u", tokens(F.col("text")).alias("raw")).select("t", "u", *[F.transform("raw", lambda w: F.xxhash64(FORMS[k][0](w))).alias(f"hashes{k}") for k in forms])  # noqa: B023
    every = [F.transform(_windows(f"hashes{k}", F.lit(w), k), lambda h, p: F.struct(p.alias("p"), h.alias("h"))) for k in forms for w in widths]
    flat = hashed.select("t", "u", F.explode(F.concat(*every) if every else F.array().cast("array<struct<p:int,h:bigint>>")).alias("x")).select("t", "u", "x.p", "x.h")
    met = flat.join(F.broadcast(bench), "h") if few else flat.withColumn("part", F.pmod(F.xxhash64("t", "p"), F.lit(PARTS)).cast("int")).join(bench.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["h", "part"])
    hits = written(met.select("t", "u", "i", "k", "h", "p", "q", "w", "total").distinct())

    # Texts whose hits could reach the coverage at all.
    able = hits.groupBy("t", "u", "i", "k", "total").agg(F.countDistinct("h").alias("n")).where(F.col("n") >= coverage * F.col("total")).select("t", "u", "i", "k")
    lines = written(hits.join(able, ["t", "u", "i", "k"]).withColumn("diagonal", F.col("p") - F.col("q")))
    line = ["t", "u", "i", "k", "diagonal"]

    # What stands in the slots of the covered positions, in the item and in the text.
    words = items.select("i", F.posexplode(tokens(F.col("text"))).alias("pos", "raw"))
    slots = reduce(DataFrame.union, [words.select("i", F.lit(k).alias("k"), "pos", FORMS[k][1](F.col("raw")).alias("a")).where(~FORMS[k][0](F.col("a")).eqNullSafe(F.lower("a"))) for k in forms])
    covered = lines.select(*line, F.explode(F.sequence(F.col("q"), F.col("q") + F.col("w") - 1)).alias("pos")).distinct()
    asked = written(covered.join(slots, ["i", "k", "pos"]).select(*line, "a", (F.col("pos") + F.col("diagonal")).alias("at")))
    places = asked.select("t", "u", "at").distinct()
    some = maybe_among(d, ["t", "u"], asked).where("maybe").drop("maybe")
    texts = some.join(asked.select("t", "u").distinct(), ["t", "u"], "left_semi").groupBy("t", "u").agg(F.first("text").alias("text"))
    said = texts.select("t", "u", F.posexplode(tokens(F.col("text"))).alias("at", "raw")).join(places, ["t", "u", "at"], "left_semi")
    pair = asked.join(said, ["t", "u", "at"]).withColumn("b", _by_form([FORMS[k][1](F.col("raw")) for k in forms]))
    judged = pair.groupBy(*line).agg(F.size(F.collect_set("a")).alias("values"), F.size(F.collect_set(F.struct("a", "b"))).alias("pairs"), F.min(F.col("a") == F.col("b")).alias("same"))
    kept = lines.join(judged, line, "left").where(F.coalesce(F.col("values") == F.col("pairs"), F.lit(True)))
    out = kept.groupBy("t", "u", "i", "k", "total").agg(F.countDistinct("h").alias("n_windows"), F.min(F.coalesce("same", F.lit(True))).alias("exact"))
    share = F.col("n_windows") / F.col("total")
    out = out.where(share >= coverage).withColumn("coverage", F.round(share, 6))
    first = out.groupBy("t", "u", "i").agg(F.min(F.struct("k", "n_windows", "coverage", "exact")).alias("x"))
    named = first.join(items.select("i", "item"), "i")
    return named.groupBy("t", "u", "item").agg(F.max(F.struct("x.n_windows", "x.coverage", "x.exact")).alias("x")).select("t", "u", "item", "x.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", **options: object) -> DataFrame:
    """``id, item, n_windows, coverage, exact`` of every document that holds an item; ``options`` as ``items_in_texts`` has them."""
    found = written(items_in_texts(docs, benchmark, text, item, item_text, **options))
    rows = docs.select(F.col(id).alias("id"), *_text_key(text)).where("id is not null")
    out = salted_join(rows, found, ["t", "u"], ["id"], hot=hot_keys(rows, ["t", "u"], docs.count()))
    out = out.groupBy("id", "item").agg(F.max(F.struct("n_windows", "coverage", "exact")).alias("x"))
    return out.select(F.col("id").alias(id), F.col("item").alias(item), "x.*")


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs``, with or without an id, whose text holds no item."""
    found = written(items_in_texts(docs, benchmark, text, item, item_text, **options).select("t", "u").distinct())
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c != text] or [F.lit(0)]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_text_key(text)).withColumn("spread", F.xxhash64(*rest))
    return without(keyed, found, ["t", "u"], ["spread"], docs.count()).select("row.*")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with changed numbers, names or units or as they are."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql(width: int = WIDTH, literals: int = LITERALS, least: int = LEAST, coverage: float = COVERAGE) -> str:
    """The same rows in DuckDB, windows joined as strings."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    form = rf"CASE WHEN regexp_matches(x, '{NAME}') THEN '{NAME_SLOT}' WHEN regexp_matches(x, '^\d') THEN '{NUMBER_SLOT}' WHEN lower(x) IN ({units}) THEN '{UNIT_SLOT}' ELSE lower(x) END"
    slots = f"('{NUMBER_SLOT}', '{NAME_SLOT}', '{UNIT_SLOT}')"
    return f"""
WITH b0 AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') raw FROM benchmark WHERE item_id IS NOT NULL),
b1 AS (SELECT item_id, raw, [{form} FOR x IN raw] form, least({width}, len(raw)) w FROM b0 WHERE len(raw) > 0),
b2 AS (SELECT item_id, raw, w, form, unnest(range(0, len(form) - w + 1)) q FROM b1),
b3 AS (SELECT item_id, w, q, form[q + 1:q + w] g FROM b2),
b4 AS (SELECT item_id, w, g, min(q) q FROM b3 WHERE len([y FOR y IN g IF y NOT IN {slots}]) >= greatest(least({literals}, w), {least}) GROUP BY ALL),
b5 AS (SELECT *, count(*) OVER (PARTITION BY item_id) total FROM b4),
d1 AS (SELECT doc_id, raw, [{form} FOR x IN raw] form FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') raw FROM documents WHERE doc_id IS NOT NULL)),
ws AS (SELECT DISTINCT w FROM b5),
d2 AS (SELECT doc_id, w, form, unnest(range(0, len(form) - w + 1)) p FROM d1, ws WHERE len(form) >= w),
hits AS (SELECT DISTINCT doc_id, item_id, g, p, q, w, total FROM (SELECT doc_id, w, p, form[p + 1:p + w] g FROM d2) JOIN b5 USING (w, g)),
slot AS (SELECT doc_id, item_id, p - q diagonal, b1.raw[q + k + 1] a, d1.raw[p + k + 1] b, b1.form[q + k + 1] fa FROM (SELECT *, unnest(range(0, w)) k FROM hits) h JOIN b1 USING (item_id) JOIN d1 USING (doc_id)),
ok AS (SELECT doc_id, item_id, diagonal, coalesce(count(DISTINCT a) FILTER (fa IN {slots}) = count(DISTINCT (a, b)) FILTER (fa IN {slots}), true) good, coalesce(bool_and(a = b) FILTER (fa IN {slots}), true) exact FROM slot GROUP BY ALL)
SELECT doc_id, item_id, count(DISTINCT g)::BIGINT n_windows, round(count(DISTINCT g) / total, 6) coverage, bool_and(exact) exact
FROM hits JOIN ok ON ok.doc_id = hits.doc_id AND ok.item_id = hits.item_id AND ok.diagonal = p - q AND good
GROUP BY hits.doc_id, hits.item_id, total HAVING count(DISTINCT g) / total >= {coverage}""".replace("SELECT doc_id, item_id, count(DISTINCT g)", "SELECT hits.doc_id, hits.item_id, count(DISTINCT g)")
