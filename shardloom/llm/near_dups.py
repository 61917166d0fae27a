"""MinHash near-duplicates (operator 6), with DataFrame functions only.

1. A text's words become its set of distinct word shingles (64-bit hashes).
   Rows with one and the same set (size and two hashes of the sorted set) form
   a class, so copies are never compared with each other.
2. ``bands * rows`` MinHash samples (the upper 32 bits of 64-bit hashes) are
   taken in one aggregation over the exploded sets.  They are hashed by bands, and folded into an odd sketch: a
   bitmap in which each sample flips one bit, so that the bits set in the XOR
   of two sketches tell how many samples differ.
3. Classes that share a band are candidates.  Their full sets give parities, a
   bitmap in which each hash flips a bit: two of them differ in no more bits
   than their sets differ in hashes, so no link is lost by comparing parities.
4. First each class meets one leader (of the classes that lead its buckets, the
   one with the nearest sketch and parities; a bucket's leader is the class with
   the most company in all of its buckets, so that the variants of a text meet
   one in their midst); the links confirmed so merge most of a bucket.  Then the
   classes outside a bucket's largest component are compared with all of its
   other components, sketch and parities deciding inside the join: pairs within
   that component are never evaluated.  Buckets are salted by size.
5. Every link is confirmed on the full sets in whole numbers.

The sketch bound is chosen so that a pair at the threshold passes but for about
one in a million; a pair at the threshold shares no band once in two million.
Joins on buckets, leaders, components and classes spread their hot keys
(``common.salted_join``); rows with empty sets take part in none of them.

Rows: one per distinct (id, text), so repeated rows are one; an id with several
texts has a row for each.  Null and empty texts and texts without words have an
empty set and are linked with nothing.  Rows without an id are linked as others
are; an id goes before none, so a component's id is null only if no row of it
has one.  Very long texts are sets of many shingles, exploded and aggregated
with spilling like those of other texts.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import HOT_ROWS, HOT_SHARE, cut, hot_keys, maybe_among, salted_join, table, text_of, without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS, ROWS, BITS = 20, 4, 256
#: Bits of the parities of a full set.
PARITY_BITS = 512
#: Members of a bucket that one salted part compares with.
SALT_SIZE = 4096


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, cut at blanks, tabs and line ends."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    bare = F.btrim(low, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def shingles(docs: DataFrame, text: str, size: int = 3) -> DataFrame:
    """``docs`` with ``set``, the sorted distinct hashes of the text's word shingles; fewer words are one shingle."""
    w = docs.withColumn("_words", words(text_of(text)))
    n = F.size("_words")
    of = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(size)])
    short = F.array(F.xxhash64(F.lit(-1), n, F.array_join("_words", " ")))
    found = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), of)).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    return w.withColumn("set", F.array_sort(F.array_distinct(found))).drop("_words")


def _bound(samples: int, threshold: float, bits: int) -> int:
    """Bits that two sketches may differ in if the similarity is at the threshold, with five standard deviations for the samples and four for the bits."""
    differ = samples * (1 - threshold) + 5 * math.sqrt(samples * threshold * (1 - threshold))
    flips = 2 * differ
    apart = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    return math.ceil(apart + 4 * math.sqrt(max(1.0, apart * (1 - apart / bits))))


def row_key(id: str, text: str) -> Column:
    """A hash of an id and its text: tells the texts of an id apart, and finds them again."""
    return F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("\0none")), text_of(text))


def signatures(docs: DataFrame, id: str, text: str, size: int, bands: int, rows: int, bits: int) -> DataFrame:
    """``id, k, n, f1, f2, bands, sketch`` per distinct (id, text); without bands and sketch for empty sets."""
    sets = shingles(docs.select(F.col(id).alias("id"), F.col(text).alias("text"), row_key(id, text).alias("k")), "text", size).select("id", "k", "set")
    keyed = sets.select("id", "k", F.size("set").cast("long").alias("n"), F.xxhash64("set").alias("f1"), F.xxhash64(F.lit(7), "set").alias("f2"), "set")
    flat = keyed.select("id", "k", "n", "f1", "f2", F.explode_outer("set").alias("h"))
    least = flat.groupBy("id", "k", "n", "f1", "f2").agg(*[F.min(F.call_function("shiftright", F.xxhash64("h", F.lit(j)), F.lit(32)).cast("int")).alias(f"m{j}") for j in range(bands * rows)])
    signed = least.select("id", "k", "n", "f1", "f2", F.array(*[f"m{j}" for j in range(bands * rows)]).alias("s"))
    band = lambda b: F.xxhash64(b, *[F.get("s", b * rows + k) for k in range(rows)])
    places = F.transform("s", lambda m, k: F.pmod(F.xxhash64(m, k), F.lit(bits)).cast("int"))
    wide = signed.withColumn("places", places)
    word = lambda w: F.aggregate("places", F.lit(0).cast("long"), lambda acc, p: F.when(F.floor(p / 64) == w, acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64))))).otherwise(acc))
    some = F.col("n") > 0
    return wide.select("id", "k", "n", "f1", "f2", F.when(some, F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("bands"), *[F.when(some, word(w)).alias(f"s{w}") for w in range(bits // 64)])


def parities(sets: DataFrame) -> DataFrame:
    """``r, p0, p1 ..``: a bitmap of PARITY_BITS in which each hash of ``set`` flips a bit; those of two sets differ in at most as many bits as the sets in hashes."""
    flat = sets.select("r", F.explode("set").alias("h"))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
    word = F.pmod(F.call_function("shiftright", "h", F.lit(6)), F.lit(PARITY_BITS // 64)).cast("int")
    flips = flat.select("r", flag.alias("flag"), word.alias("word"))
    return flips.groupBy("r").agg(*[F.bit_xor(F.when(F.col("word") == w, F.col("flag")).otherwise(0)).alias(f"p{w}") for w in range(PARITY_BITS // 64)])


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``v, c``: of each vertex (``v``) the smallest vertex it is connected with over ``edges`` (``a, b``).

    Labels spread over edges and are then followed to their own labels, so the
    number of rounds grows with the logarithm of the longest path; each round
    is cut with a checkpoint.  Vertices with many edges and labels with many
    vertices are spread.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = cut(vertices.select("v", F.col("v").alias("c")))
    n_vertices, hubs = label.count(), hot_keys(both, ["b"], both.count())
    while True:
        near = salted_join(both, label.select(F.col("v").alias("b"), "c"), ["b"], ["a"], hot=hubs).groupBy("a").agg(F.min("c").alias("m"))
        spread = label.join(near, label["v"] == near["a"], "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old"))
        # A vertex whose label sank takes its old label with it.
        sunk = spread.where("c < old").groupBy(F.col("old").alias("v")).agg(F.min("c").alias("d"))
        spread = cut(spread.join(sunk, "v", "left").select("v", F.least("c", F.coalesce("d", "c")).alias("c"), "old"))
        target = spread.select(F.col("v").alias("c"), F.col("c").alias("d"))
        after = cut(salted_join(spread, target, ["c"], ["v"], hot=hot_keys(spread, ["c"], n_vertices)).select("v", F.col("d").alias("c"), (F.col("d") < F.col("old")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("v", "c")
        label = after.select("v", "c")


def _grouped(docs: DataFrame, id: str, text: str, size: int, inter: int, union: int, bands: int, rows: int, bits: int) -> DataFrame:
    """``id, k, n, rep, n_links`` of every distinct (id, text): ``rep`` is the first (none, id, k) of its component."""
    bound = _bound(bands * rows, union / inter, bits)
    sketch, parity = [f"s{w}" for w in range(bits // 64)], [f"p{w}" for w in range(PARITY_BITS // 64)]
    signed = written(signatures(docs, id, text, size, bands, rows, bits))
    known = signed.where("n > 0")
    first = known.groupBy("n", "f1", "f2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", *sketch, "bands")).alias("x"))
    # A class's number is fixed once its table is written.
    classes = written(first.select(F.monotonically_increasing_id().alias("r"), "n", "f1", "f2", F.struct("x.none", "x.id", "x.k").alias("row"), *[f"x.{k}" for k in sketch], "x.bands"))
    placed = classes.select("r", F.explode("bands").alias("bucket"))
    n_classes = classes.count()
    n_placed = bands * n_classes
    groups = written(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    crowded = written(groups.where(F.col("m") >= max(HOT_ROWS, n_placed / HOT_SHARE)).select("bucket"))
    crowded = None if crowded.isEmpty() else crowded
    shared = maybe_among(placed, ["bucket"], groups).where("maybe").drop("maybe")
    members = cut(salted_join(shared, groups, ["bucket"], ["r"], hot=crowded))
    # The class with the most company leads its buckets: what varies one text is mostly linked with it.
    company = members.groupBy("r").agg(F.sum("m").alias("met"))
    heads = members.join(company, "r").groupBy("bucket").agg(F.min(F.struct(-F.col("met"), "r")).alias("x")).select("bucket", F.col("x.r").alias("leader"))
    holding = cut(company.join(classes, "r").select("r", "n", F.col("row.id").alias("id"), F.col("row.k").alias("k"), *sketch))

    samples, full = range(1, len(sketch) + 1), range(len(sketch) + 1, len(sketch) + len(parity) + 1)

    def apart(x: str, y: str, of: range) -> Column:
        return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in of), F.lit(0))

    def near(x: str, y: str) -> Column:
        return apart(x, y, samples) + apart(x, y, full)

    def fits(x: str, y: str) -> Column:
        n, m = F.get(x, F.lit(0)), F.get(y, F.lit(0))
        alike = apart(x, y, full) * (inter + union) <= (n + m) * (inter - union)
        return (F.least(n, m) * inter >= F.greatest(n, m) * union) & (apart(x, y, samples) <= bound) & alike

    # The sets of those classes only, from the text of one row of each.
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), row_key(id, text).alias("k"))
    some = maybe_among(texts, ["k"], holding).where("maybe")
    # Repeated rows are one by the shuffle of the join, which a condition on ids would spread by them as well.
    own = F.when(F.col("id").eqNullSafe(F.col("of")), F.col("text"))
    holders = some.join(holding.select("k", "r", F.col("id").alias("of")), "k").groupBy("k", "r").agg(F.first(own, ignorenulls=True).alias("text"))
    sets = written(shingles(holders, "text", size).select("r", "set"))
    # One array, as Spark infers constraints for every subset of renamed columns or fields of a condition.
    marks = written(holding.select("r", "n", *sketch).join(parities(sets), "r").select("r", F.array("n", *sketch, *parity).alias("mark")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), cut, those that are linked by their full sets; many may share an ``a``."""
        right = maybe_among(sets.select(F.col("r").alias("b"), F.col("set").alias("sb")), ["b"], pairs).where("maybe").drop("maybe")
        left = maybe_among(sets.select(F.col("r").alias("a"), F.col("set").alias("sa")), ["a"], pairs).where("maybe").drop("maybe")
        hubs = hot_keys(pairs, ["a"], pairs.count())
        both = salted_join(pairs.join(right, "b"), left, ["a"], ["b"], hot=hubs).withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.where(F.col("i") * inter >= (F.size("sa") + F.size("sb") - F.col("i")) * union).select("a", "b")

    led = cut(salted_join(members, heads, ["bucket"], ["r"], hot=crowded).where("leader <> r").select("r", "leader").distinct())
    leaders = marks.select(F.col("r").alias("leader"), F.col("mark").alias("x"))
    with_leader = salted_join(led, leaders, ["leader"], ["r"], hot=hot_keys(led, ["leader"], led.count())).join(marks.select("r", F.col("mark").alias("y")), "r")
    best = with_leader.where(fits("x", "y")).groupBy("r").agg(F.min(F.struct(near("x", "y").alias("d"), F.col("leader").alias("l"))).alias("best"))
    links = cut(confirmed(cut(best.select(F.col("best.l").alias("a"), F.col("r").alias("b")))))
    vertices = marks.select(F.col("r").alias("v"))
    merged = components(links, vertices)

    labelled = cut(members.select("r", "bucket").join(merged.select(F.col("v").alias("r"), "c"), "r"))
    parts = labelled.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = written(mixed.select("bucket", F.col("top.c").alias("main"), F.ceil(F.col("m") / SALT_SIZE).cast("int").alias("salts")))
    sized = salted_join(labelled, mixed, ["bucket"], ["r"], hot=crowded).withColumn("big", F.col("c") == F.col("main")).join(marks, "r")
    one = sized.withColumn("salt", F.pmod(F.xxhash64("r"), F.col("salts")).cast("int")).alias("x")
    other = sized.where("not big").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    once = F.col("x.big") | (F.col("x.r") < F.col("y.r"))
    met = one.join(other, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.salt") == F.col("y.salt")) & once & (F.col("x.c") != F.col("y.c")) & fits("x.mark", "y.mark"))
    more = cut(confirmed(cut(met.select(F.least("x.r", "y.r").alias("a"), F.greatest("x.r", "y.r").alias("b")).distinct())))
    if not more.isEmpty():
        merged = components(links.union(more), vertices)
    every = links.union(more)
    degree = every.select(F.col("a").alias("r")).union(every.select("b")).groupBy("r").agg(F.count(F.lit(1)).alias("n_links"))

    numbered = classes.select("n", "f1", "f2", "r", "row").join(merged.withColumnRenamed("v", "r"), "r", "left").join(degree, "r", "left")
    numbered = written(numbered.select("n", "f1", "f2", "r", "row", F.coalesce("c", "r").alias("c"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    reps = numbered.groupBy("c").agg(F.min("row").alias("rep"))
    class_of = salted_join(numbered.drop("row"), reps, ["c"], ["r"], hot=hot_keys(numbered, ["c"], n_classes)).select("n", "f1", "f2", "rep", "n_links")
    copied = hot_keys(known, ["n", "f1", "f2"], signed.count())
    found = salted_join(known.select("id", "k", "n", "f1", "f2"), class_of, ["n", "f1", "f2"], ["id", "k"], hot=copied).select("id", "k", "n", "rep", "n_links")
    alone = F.struct(F.col("id").isNull().alias("none"), "id", "k").alias("rep")
    return found.unionByName(signed.where("n = 0").select("id", "k", "n", alone, F.lit(0).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, inter: int = 100, union: int = 85, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """``id, n_shingles, component_id, kept, n_links`` per document.

    Documents are linked if ``inter`` times the size of the intersection is at
    least ``union`` times that of the union.  One row of each component is
    kept, that of the smallest id.  ``n_links`` counts the confirmed links of
    the document's class, at least enough to connect its component.
    """
    found = _grouped(docs, id, text, size, inter, union, bands, rows, bits)
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("rep.id").alias("component_id"), _is_rep().alias("kept"), "n_links")


def _is_rep() -> Column:
    return F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("k") == F.col("rep.k"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, inter: int = 100, union: int = 85, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component, and one of each group of rows with the same id and text."""
    found = _grouped(docs, id, text, size, inter, union, bands, rows, bits)
    name = F.coalesce(F.col("id").cast("string"), F.lit("\0none")).alias("name")
    dropped = written(found.where(~_is_rep()).select(name, "k"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id).alias("id"), row_key(id, text).alias("k")).select("row", name, "k")
    repeated = written(keyed.groupBy("name", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "k"))
    left = without(keyed, dropped, ["name", "k"], ["k"], docs.count())
    if not repeated.isEmpty():
        again = maybe_among(left, ["name", "k"], repeated)
        once = again.where("maybe").groupBy("name", "k").agg(F.first("row").alias("row"))
        left = again.where("not maybe").select("row").union(once.select("row"))
    return left.select("row.*")


def op6_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def sql(size: int = 3, inter: int = 100, union: int = 85) -> str:
    """The same rows in DuckDB by counting common shingles of all pairs that have any, and walking the links."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\t-\r ]+') IF x <> ''] ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= {size} THEN [array_to_string(ws[i:i + {size - 1}], ' ') FOR i IN range(1, len(ws) - {size - 2})] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) sh FROM w),
e AS (SELECT doc_id, unnest(sh) h FROM s),
n AS (SELECT doc_id, len(sh)::BIGINT n FROM s),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) i FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE {inter} * i >= {union} * (nx.n + ny.n - i)),
b AS (SELECT x a, y b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id c FROM n UNION SELECT b.b, r.c FROM r JOIN b ON r.doc_id = b.a)
SELECT doc_id, n n_shingles, min(c) component_id, doc_id = min(c) kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n"""
