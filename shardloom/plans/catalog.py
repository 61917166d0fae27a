"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import decode, naming
from shardloom.operators import batching, epochs, joins, order, project, shards
from shardloom.sources import rolling
from shardloom.sources.storage import local_path, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """A global index in the order of a unique whole-number key, numbered by ranges of it."""
    return order.with_index(df, F.floor(F.col(key) / 4096), [key], name)


def _hash(seed: int | str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


# --- flagship: select, associate, shuffle, batch, collate ---

FLAGSHIP_SQL = f"""
SELECT batch, count(*)::BIGINT n, sum(n_chars)::BIGINT chars, count(quality)::BIGINT labelled, sum(quality)::BIGINT good
FROM (SELECT *, (row_number() OVER (ORDER BY {_hash(42, 'doc_id')}, doc_id) - 1) // 32 batch
      FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en') GROUP BY batch"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents with their labels, shuffled, in batches of 32."""
    docs = project.select(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), F.col("lang") == "en")
    labelled = joins.associate(docs, table(spark, sf_dir, "labels"), "doc_id")
    ranked = order.shuffled(labelled, "doc_id", 42)
    return ranked.groupBy(F.floor(F.col("rank") / 32).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.sum("quality").alias("good")
    )


QUERIES["flagship"] = flagship
ORACLES["flagship"] = FLAGSHIP_SQL

# --- shard lists, splitting, resampling (A) ---


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 shard_id, printf('nation-%06d.tar', n_nationkey) AS name FROM nation")
def directory_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory's address as a shard list (A16); other and hidden files don't count."""
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}/"
    keys = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [*[f"nation-{k:06d}.tar" for k in keys], "notes.txt", "_part.tar"]:
        files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, name)).close()
    listed = shards.shard_spec(spark, folder)
    files.delete(where, True)
    return listed.select("shard_id", F.regexp_extract("url", "([^/]+)$", 1).alias("name"))


@query(f"""WITH a AS (SELECT 0 s, 'a' "name", i draw, printf('a-%02d.tar', i) url FROM range(20) t(i) ORDER BY {_hash(3, 'i')}, i LIMIT 5),
u AS (SELECT * FROM a UNION ALL SELECT 1, 'b', i, printf('b-%02d.tar', i) FROM range(10) t(i)), k AS (SELECT *, s || ':' || draw || ':' || url k FROM u)
SELECT row_number() OVER (ORDER BY {_hash(3, 'k')}, k) - 1 AS rank, "name", url FROM k""")
def multi_source_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch over two shard sets, of one of which five shards are drawn."""
    spec = {"datasets": [{"name": "a", "shards": "a-{00..19}.tar", "choose": 5}, {"name": "b", "shards": "b-{00..09}.tar"}]}
    return shards.multi_source(spark, spec, seed=3)


@query("SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z0-9+.-]+://', ''), '([^/]+)/*$', 1) cached FROM pages")
def url_cache_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache names of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", "url", naming.cache_name_column(F.col("url")).alias("cached"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^(?:https?://www\\.)') THEN regexp_replace(url, '^(?:https?://www\\.)', 's3a://mirror/')
 WHEN regexp_matches(url, '^(?:http:)') THEN regexp_replace(url, '^(?:http:)', 'https:') ELSE url END url FROM pages""")
def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses rewritten by the first rule that matches."""
    rules = naming.parse_rewrites(r"https?://www\.=s3a://mirror/;http:=https:")
    return table(spark, sf_dir, "pages").select("page_id", naming.rewrite_column(F.col("url"), rules).alias("url"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 i FROM orders) WHERE i % 4 = 1 AND (i // 4) % 3 = 2")
def split_node_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of worker 2 of 3 on node 1 of 4."""
    rows = indexed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "shard_id")
    return shards.split_by_worker(shards.split_by_node(rows, 1, 4), 2, 3, world=4).drop("shard_id")


@query(f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY {_hash('index', 'n_nationkey')} // 4194304, n_nationkey) - 1 i FROM nation)
SELECT range draw, n_nationkey, n_name FROM range(1000) JOIN i ON i.i = {_hash(7, 'range')} % (SELECT count(*) FROM nation)""")
def resample_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 draws with replacement."""
    return shards.resampled(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 1000, "n_nationkey", seed=5, epoch=2)


@query(f"SELECT n_nationkey, n_name FROM nation ORDER BY {_hash(3, 'n_nationkey')}, n_nationkey LIMIT 10")
def choose_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 shards without replacement."""
    return shards.chosen(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10, "n_nationkey", 3)


@query("SELECT count(*)::BIGINT n FROM documents")
def non_empty_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a checked source."""
    return shards.non_empty(table(spark, sf_dir, "documents").select("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT range \"index\", 'x' \"key\", 1 cls FROM range(1000)")
def constant_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant sample, repeated."""
    return shards.constant(spark, {"key": "x", "cls": 1}, 1000)


@query("SELECT 'train-' || lpad(range::VARCHAR, 4, '0') || '.tar' url, range shard_id FROM range(100)")
def brace_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard list from braces (A1, A3, A4)."""
    return shards.shard_list(spark, "train-{0000..0049}.tar::train-{0050..0099}.tar")


# --- keys and groups (C) ---

_NAME = "CASE WHEN page_id % 7 = 0 THEN 'README' ELSE 'dir.v' || (page_id % 3)::VARCHAR || '/p' || page_id::VARCHAR || '.seg.HTML' END"


@query(f"SELECT page_id, CASE WHEN regexp_matches(p, '{naming.KEY_EXT}') THEN regexp_extract(p, '{naming.KEY_EXT}', 1) END \"key\", CASE WHEN regexp_matches(p, '{naming.KEY_EXT}') THEN lower(regexp_extract(p, '{naming.KEY_EXT}', 2)) END ext FROM (SELECT page_id, {_NAME} p FROM pages)")
def key_ext_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and extensions of file names (C4)."""
    path = F.when(F.col("page_id") % 7 == 0, F.lit("README")).otherwise(F.concat(F.lit("dir.v"), (F.col("page_id") % 3).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".seg.HTML")))
    return table(spark, sf_dir, "pages").select("page_id", naming.key_of(path).alias("key"), naming.ext_of(path).alias("ext"))


_RUNS = """WITH s AS (SELECT *, CASE WHEN lag({k}) OVER w = {k} THEN 0 ELSE 1 END st FROM {t} WINDOW w AS (PARTITION BY {p} ORDER BY {o})),
r AS (SELECT *, sum(st) OVER (PARTITION BY {p} ORDER BY {o}) run FROM s)"""


@query(_RUNS.format(k="conv_id", t="conversations", p="conv_id % 8", o="conv_id, turn") + " SELECT conv_id % 8 shard_id, run::BIGINT run, conv_id, count(*)::BIGINT n, min(turn) first_turn, max(turn) last_turn FROM r GROUP BY ALL")
def group_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as files of conversations, neighbours grouped."""
    files = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 8).alias("shard_id"))
    held = batching.runs(files, "conv_id", ["conv_id", "turn"], "shard_id")
    return held.groupBy("shard_id", "run", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(_RUNS.format(k="o_orderstatus", t="orders", p="o_orderkey // 4096", o="o_orderkey") + " SELECT o_orderkey // 4096 shard_id, run::BIGINT run, o_orderstatus, count(*)::BIGINT n, min(o_orderkey) first_key FROM r GROUP BY ALL")
def group_runs_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that comes again starts a new group."""
    files = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_orderkey") / 4096).alias("shard_id"))
    held = batching.runs(files, "o_orderstatus", ["o_orderkey"], "shard_id")
    return held.groupBy("shard_id", "run", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT (l_orderkey % 8) shard_id, l_orderkey::VARCHAR \"key\", count(*)::BIGINT n_fields, sum(p)::BIGINT parts FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) p FROM lineitem GROUP BY ALL) GROUP BY ALL")
def dup_suffix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of suffixes that come twice in a sample the first is kept."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    files = lines.select((F.col("l_orderkey") % 8).alias("shard_id"), (F.col("l_orderkey") * 100_000 + place).alias("pos"), F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").cast("string").alias("ext"), F.col("l_partkey").cast("string").cast("binary").alias("data"))
    s = batching.group_files(files, on_duplicate="first")
    parts = F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda acc, v: acc + decode.as_int(v))
    return s.select("shard_id", F.col("__key__").alias("key"), F.size("fields").cast("long").alias("n_fields"), parts.alias("parts"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def valid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without a field or marked as bad are left out."""
    bad = F.when(F.col("doc_id") % 7 == 0, F.lit(True)).when(F.col("doc_id") % 11 == 0, F.lit(False))
    d = table(spark, sf_dir, "documents").select("doc_id", bad.alias("__bad__"), F.when(F.col("doc_id") % 5 == 0, F.expr("map()").cast("map<string,binary>")).otherwise(F.create_map(F.lit("txt"), F.col("text").cast("binary"))).alias("fields"))
    return project.valid(d).select("doc_id")


@query("SELECT (conv_id % 8) shard_id, conv_id::VARCHAR \"key\", count(*)::BIGINT n_fields, string_agg(turn || '.' || role, ' ' ORDER BY turn) names FROM conversations GROUP BY ALL")
def group_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with maps of fields."""
    c = table(spark, sf_dir, "conversations")
    files = c.select((F.col("conv_id") % 8).alias("shard_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("conv_id").cast("string").alias("key"), F.concat_ws(".", F.col("turn").cast("string"), "role").alias("ext"), F.col("text").cast("binary").alias("data"))
    s = batching.group_files(files)
    return s.select("shard_id", F.col("__key__").alias("key"), F.size("fields").cast("long").alias("n_fields"), F.array_join(F.map_keys("fields"), " ").alias("names"))


# --- decoding (D) ---


@query("SELECT event_id, (props->>'k')::BIGINT k FROM events")
def decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields by a declared schema (D3)."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) number, TRY_CAST(c_mktsegment AS BIGINT) none FROM customer")
def decode_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers from bytes, null where they are none (D3)."""
    from shardloom.functions.decode import as_int

    return table(spark, sf_dir, "customer").select("c_custkey", as_int(F.substring("c_name", 10, 100).cast("binary"), "skip").alias("number"), as_int(F.col("c_mktsegment").cast("binary"), "skip").alias("none"))


@query("SELECT doc_id, length(text)::BIGINT n, md5(text) digest FROM documents")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 text from bytes, strictly (D3)."""
    from shardloom.functions.decode import as_text

    d = table(spark, sf_dir, "documents").select("doc_id", as_text(F.col("text").cast("binary")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("""SELECT p_partkey, name, CASE WHEN name LIKE '%.num' THEN (v::BIGINT + 1)::VARCHAR WHEN name LIKE '%.txt' THEN upper(v) ELSE v END value
FROM (SELECT p_partkey, unnest(['b.txt', 's.num', 't.raw']) name, unnest([p_brand, p_size::VARCHAR, p_type]) v FROM part)""")
def xdecode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoders chosen by globs."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "stack(3, 'b.txt', p_brand, 's.num', cast(p_size as string), 't.raw', p_type) as (name, v)")
    value = project.dispatch(F.col("name"), F.col("v"), ("*.txt", F.upper), ("*.num", lambda v: (F.try_to_number(v, F.lit("999999")) + 1).cast("long").cast("string")), ("*.raw", False))
    return p.select("p_partkey", "name", value.alias("value"))


@query("SELECT doc_id, json_object('doc_id', doc_id, 'lang', lang, 'n', n_chars)::VARCHAR json FROM documents")
def encode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples encoded as JSON."""
    whole = F.struct("doc_id", "lang", F.col("n_chars").alias("n"))
    return table(spark, sf_dir, "documents").select("doc_id", decode.as_text(decode.encode_column(whole, "struct", "meta.json")).alias("json"))


@query("SELECT doc_id, upper(lang) lang, n_chars::BIGINT n, lang || ':' || doc_id note FROM documents")
def decode_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields decoded by a chain: packed ones first, then handlers of one's own, then by extension."""
    from shardloom.dataset import Dataset
    from shardloom.functions import codecs

    d = table(spark, sf_dir, "documents")
    text = lambda c: F.encode(c.cast("string"), "utf-8")
    note = F.concat_ws(":", "lang", F.col("doc_id").cast("string"))
    fields = F.create_map(F.lit("lang.up"), text(F.col("lang")), F.lit("cls"), text(F.col("n_chars")), F.lit("note.txt.gz"), codecs.gzipped(text(note)))
    samples = Dataset.of(d.select(F.lit(0).alias("shard_id"), F.col("doc_id").alias("sample_no"), fields.alias("fields")), "shard_id", "sample_no")
    out = samples.decode("`lang.up` string, cls long, `note.txt.gz` string", codecs.by_suffix("up", lambda b: b.decode().upper()))
    return out.df.select(F.col("sample_no").alias("doc_id"), F.col("`lang.up`").alias("lang"), F.col("cls").alias("n"), F.col("`note.txt.gz`").alias("note"))


@query("SELECT t task, (i // 40) shard, count(*)::BIGINT n, min(doc_id) first_id, max(doc_id) last_id FROM (SELECT doc_id, doc_id % 8 t, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 i FROM documents) GROUP BY ALL")
def shard_roll_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards rolled by count in each task."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8).alias("task"), F.lit(1).alias("size"))
    return rolling.rolled(d, "task", "doc_id", "size", 40, 1e9).groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, doc_id % 8 task, strlen(text) size, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) r FROM documents),
w AS (SELECT task, r, doc_id, size, 0::BIGINT shard, size::BIGINT held, 1::BIGINT n FROM d WHERE r = 1
UNION ALL SELECT d.task, d.r, d.doc_id, d.size, CASE WHEN w.n >= 40 OR w.held >= 60000 THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.n >= 40 OR w.held >= 60000 THEN d.size ELSE w.held + d.size END, CASE WHEN w.n >= 40 OR w.held >= 60000 THEN 1 ELSE w.n + 1 END
FROM w JOIN d ON d.task = w.task AND d.r = w.r + 1)
SELECT task, shard, count(*)::BIGINT n, sum(size)::BIGINT bytes FROM w GROUP BY ALL""")
def shard_roll_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards rolled by count or size, tested before each write."""
    from shardloom.sources.rolling import rolled

    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8).alias("task"), F.octet_length("text").cast("long").alias("size"))
    return rolled(d, "task", "doc_id", "size", max_count=40, max_size=60_000).groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


# --- projections and mappings (E) ---


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' AND n_chars > 1000")
def select_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate."""
    return project.select(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), (F.col("lang") == "de") & (F.col("n_chars") > 1000))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) l_extendedprice, lower(l_returnflag) l_returnflag FROM lineitem")
def map_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields transformed by name."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_discount")
    return project.map_dict(df, l_extendedprice=lambda x: F.round(x * (1 - F.col("l_discount")), 4), l_returnflag=F.lower).drop("l_discount")


@query("SELECT c_custkey * 2 c_custkey, c_name, upper(c_mktsegment) c_mktsegment FROM customer")
def map_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields transformed by position."""
    return project.map_tuple(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), lambda x: x * 2, None, F.upper, F.upper)


@query("SELECT doc_id, quality * 10 scaled FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def map_drop_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a mapping turns into nothing are dropped."""
    df = joins.associate(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return project.map_columns(df, ["scaled"], scaled=F.col("quality") * 10).select("doc_id", "scaled")


@query("SELECT doc_id \"_0\", lang \"_1\", coalesce(quality, -1) \"_2\" FROM documents LEFT JOIN labels USING (doc_id)")
def to_tuple_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples from alternatives."""
    df = joins.associate(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return project.to_tuple(df.fillna(-1, ["quality"]), "id;doc_id language;lang score;quality")


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_name \"name\", c_mktsegment segment FROM customer")
def rename_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names, the rest kept."""
    return project.rename(table(spark, sf_dir, "customer"), name="title;c_name", segment="c_mktsegment")


@query("SELECT c_name \"name\", c_mktsegment segment FROM customer")
def rename_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names alone."""
    return project.rename(table(spark, sf_dir, "customer"), keep=False, name="title;c_name", segment="c_mktsegment")


@query("SELECT p_partkey number, p_brand brand, p_type kind FROM part")
def rename_keys_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by globs."""
    return project.rename_keys(table(spark, sf_dir, "part"), number="*_part*", brand="p_br?nd", kind="p_[st]ype")


@query("SELECT p_partkey \"_0\", p_size \"_1\" FROM part")
def extract_keys_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns picked by globs."""
    return project.extract_keys(table(spark, sf_dir, "part"), "*key", "nothing;p_si*")


@query("SELECT p_partkey, p_brand b, p_size::VARCHAR s FROM part")
def rename_map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a map renamed by globs, then projected."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("x/Brand.txt"), "p_brand", F.lit("x/Size.txt"), F.col("p_size").cast("string"), F.lit("other"), "p_type").alias("fields"))
    m = project.rename_fields(p, ("b", "brand*"), ("s", "size.*"))
    return m.select("p_partkey", project.first_field("fields", "zz;b").alias("b"), project.first_field("fields", "s").alias("s"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def slice_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice at the head."""
    return order.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100, 50)


@query("SELECT o_orderkey, i \"index\" FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 i FROM orders) WHERE i >= 10 AND (i - 10) % 7 = 0")
def slice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice with a step."""
    return order.slice_rows(indexed(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), "index", 10, None, 7)


@query(f"SELECT doc_id, lang FROM documents WHERE {_hash(1, 'doc_id')} < {int(0.25 * 2**32)}")
def rsample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that is the same every time."""
    return order.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), 0.25, "doc_id", 1)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 i, 0 worker, 3 rank, doc_id::VARCHAR \"key\" FROM documents")
def log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of keys."""
    return project.key_log(indexed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "i"), "doc_id", "i", rank=3)


# --- joins (F) ---


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE lang END lang, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def associate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side table looked up by key, its columns replacing (F1)."""
    side = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("lang"), "toxic")
    return joins.associate(table(spark, sf_dir, "documents").select("doc_id", "lang"), side, "doc_id")


@query("SELECT doc_id, lang, n_chars, source FROM documents")
def column_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column store put together (F2)."""
    d = table(spark, sf_dir, "documents").withColumn("shard_id", F.col("doc_id") % 8)
    return joins.zip_columns(d.select("shard_id", "doc_id", "lang"), d.select("shard_id", "doc_id", "n_chars", "source"), ["shard_id", "doc_id"]).drop("shard_id")


@query("SELECT i \"index\", c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 i FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 i FROM supplier) USING (i)")
def row_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets side by side."""
    return joins.zip_rows(indexed(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), indexed(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is in a list (F)."""
    return joins.members(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def membership_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not in a list (F)."""
    return joins.members(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", inside=False)


# --- batches (G) ---

_BATCH = "SELECT i // 100 batch, count(*)::BIGINT n, sum(n_chars)::BIGINT chars, string_agg(lang, '' ORDER BY i) langs FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 i FROM documents) GROUP BY ALL"


def _batches(spark: SparkSession, sf_dir: str, partial: bool) -> DataFrame:
    d = indexed(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    b = batching.batched(d, "index", 100, partial, ["lang", "n_chars"])
    return b.select("batch", F.col("n").cast("long").alias("n"), F.aggregate("n_chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"), F.array_join("lang", "").alias("langs"))


@query(_BATCH)
def batched_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 100, the last one shorter."""
    return _batches(spark, sf_dir, True)


@query(_BATCH + " HAVING count(*) = 100")
def batched_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches only (G1)."""
    return _batches(spark, sf_dir, False)


@query("SELECT w worker, min(doc_id) first_id, count(*)::BIGINT n, sum(n_chars)::BIGINT chars FROM (SELECT doc_id, doc_id % 4 w, n_chars, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 i FROM documents) GROUP BY w, i // 64")
def batched_by_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that each worker makes of its share, a partition each (G1, K4)."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("worker"), "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    held = d.repartitionById(4, F.col("worker").cast("int")).sortWithinPartitions("doc_id")

    def collate(columns: dict[str, list]) -> dict[str, int]:
        return {"worker": columns["worker"][0], "first_id": columns["doc_id"][0], "n": len(columns["doc_id"]), "chars": sum(columns["n_chars"])}

    return batching.batched_in_partitions(held, 64, collate, "worker long, first_id long, n long, chars long")


@query("SELECT i // 20 batch, string_agg(o_orderkey::VARCHAR, ',' ORDER BY i) keys, string_agg(o_orderstatus, '' ORDER BY i) states FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 i FROM orders) GROUP BY ALL")
def collate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns collated in order."""
    b = batching.batched(indexed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey"), "index", 20)
    return b.select("batch", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("keys"), F.array_join("o_orderstatus", "").alias("states"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def unbatched_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and back."""
    o = indexed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return batching.unbatched(batching.batched(o, "index", 64), ["o_orderkey", "o_custkey", "o_orderstatus"]).drop("batch", "n", "pos")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE (o_orderkey < (SELECT max(o_orderkey) FROM orders) + 1)")
def unlisted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and back."""
    o = indexed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return batching.unlisted(batching.listed(o, "index", 64)).drop("batch", "n", "pos")


@query("SELECT batch, n, \"values\", round(total, 3) total FROM (SELECT i // 50 batch, count(*)::BIGINT n, sum(len(embedding))::BIGINT \"values\", sum(list_sum(embedding::DOUBLE[])) total FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 i FROM embeddings) GROUP BY ALL)")
def tensor_stack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stacked to one tensor a batch."""
    b = batching.batched(indexed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id"), "index", 50, columns=["embedding"])
    flat = b.select("batch", F.col("n").cast("long").alias("n"), batching.stacked(F.col("embedding")).alias("t"))
    return flat.select("batch", "n", F.size("t").cast("long").alias("values"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query("SELECT c_nationkey, n, round(n * w / max(n * w) OVER (), 9) share FROM (SELECT c_nationkey, count(*)::BIGINT n, (c_nationkey % 5 + 1)::DOUBLE w FROM customer GROUP BY ALL)")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by size and factor against the largest."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("w", (F.col("c_nationkey") % 5 + 1).cast("double"))
    return batching.sample_weights(c, "n", "w").select("c_nationkey", "n", F.round("share", 9).alias("share"))


# --- shuffles (I) ---


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_hash(11, 'doc_id')}, doc_id) - 1 rank FROM documents")
def shuffle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global shuffle."""
    return order.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 11)


@query(f"SELECT doc_id, 0 epoch, row_number() OVER (ORDER BY {_hash(5, 'doc_id')}, doc_id) - 1 rank FROM documents UNION ALL SELECT doc_id, 1 epoch, row_number() OVER (ORDER BY {_hash(6, 'doc_id')}, doc_id) - 1 rank FROM documents")
def detshuffle_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of a seeded shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    one = [order.shuffled(d, "doc_id", 5, e).select("doc_id", F.lit(e).alias("epoch"), "rank") for e in (0, 1)]
    return one[0].unionByName(one[1])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in an order."""
    return order.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


# --- epochs and mixes (J) ---

_NATION = "(SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 i, count(*) OVER () c FROM nation)"


@query(f"SELECT n_nationkey, n_name, range::INT epoch, range * c + i position FROM {_NATION}, range(3) WHERE range * c + i < 60")
def repeat_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes, 60 rows in all."""
    return epochs.repeat(indexed(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey"), "index", 3, 60).drop("index")


@query(f"SELECT n_nationkey, range::INT epoch, range * c + i position FROM {_NATION}, range(10) WHERE range * c + i < 193")
def with_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many passes as 193 rows take."""
    return epochs.with_epoch(indexed(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey"), "index", 193).drop("index")


@query("""WITH b AS (SELECT i // 32 batch, count(*)::BIGINT size FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 i FROM documents) GROUP BY ALL),
r AS (SELECT *, range::INT epoch, coalesce(sum(size) OVER (ORDER BY range, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM b, range(3))
SELECT batch, size, epoch FROM r WHERE before < 2 * (SELECT count(*) FROM documents) - 100""")
def repeat_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches repeated until a number of rows is reached."""
    d = indexed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    n = d.count()
    b = d.groupBy(F.floor(F.col("index") / 32).alias("batch")).agg(F.count(F.lit(1)).alias("size"))
    return epochs.repeat_weighted(b, "batch", "size", 2 * n - 100, 3)


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    named = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey")]
    return [indexed(table(spark, sf_dir, t).select(F.col(k).cast("long").alias("k")), "k") for t, k in named]


_THREE = "(SELECT c_custkey::BIGINT k, 0 src, row_number() OVER (ORDER BY c_custkey) - 1 turn FROM customer UNION ALL SELECT s_suppkey::BIGINT, 1, row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier UNION ALL SELECT n_nationkey::BIGINT, 2, row_number() OVER (ORDER BY n_nationkey) - 1 FROM nation)"


@query(f"SELECT * FROM {_THREE}")
def round_robin_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taking turns until all are exhausted."""
    return epochs.round_robin(_three(spark, sf_dir), "index", longest=True)


@query(f"WITH t AS (SELECT * FROM {_THREE}), n AS (SELECT src, count(*) n FROM t GROUP BY src), m AS (SELECT min(n) n FROM n) SELECT t.* FROM t, m WHERE (turn, src) < (m.n, (SELECT min(src) FROM n WHERE n.n = (SELECT n FROM m)))")
def round_robin_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taking turns until the first is exhausted."""
    return epochs.round_robin(_three(spark, sf_dir), "index")


_DRAWS = """WITH t AS (SELECT * FROM {three}), n AS (SELECT src, count(*) n FROM t GROUP BY src),
d AS (SELECT range draw, {h} h FROM range((SELECT count(*) + 1 FROM t))),
s AS (SELECT draw, CASE WHEN h < {a} THEN 0 WHEN h < {b} THEN 1 ELSE 2 END src FROM d),
r AS (SELECT draw, src, row_number() OVER (PARTITION BY src ORDER BY draw) - 1 turn FROM s),
e AS (SELECT min(draw) e FROM r JOIN n USING (src) WHERE turn >= n)"""


@query(_DRAWS.format(three=_THREE, h=_hash(9, "range"), a=int(0.5 * 2**32), b=int(0.75 * 2**32)) + " SELECT draw, src, k FROM r JOIN t USING (src, turn) WHERE draw < (SELECT coalesce(e, 9223372036854775807) FROM e)")
def random_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by weight until one source is exhausted."""
    return epochs.random_mix(_three(spark, sf_dir), "index", [2.0, 1.0, 1.0], seed=9)


@query("SELECT c_custkey \"key\", c_acctbal balance, 0 src FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier")
def concat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources one after another."""
    return epochs.concatenated([table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))])


# --- statistics ---


@query("SELECT lang, count(*)::BIGINT n, sum(n_chars)::BIGINT chars, count(DISTINCT source)::BIGINT sources, max(n_chars) longest FROM documents GROUP BY lang")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a dataset by language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"), F.max("n_chars").alias("longest"))


# --- through archives and binary formats (C, D) ---


@query("SELECT doc_id, md5(text) digest, lang, n_chars FROM documents")
def tar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as shards below the shared folder and read back."""
    import glob
    import uuid

    from shardloom.functions.decode import as_json, as_text
    from shardloom.sources.tarscan import read_shards
    from shardloom.sources.tarwrite import write_shards

    path = f"{local_path(shared_dir(spark))}/shards-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("__key__"), F.col("text").alias("txt"), F.to_json(F.struct("lang", "n_chars")).alias("json"))
    write_shards(d, path, maxcount=2000)
    s = read_shards(spark, sorted(glob.glob(f"{path}/*.tar")), exts=("txt", "json"))
    fields = s.select(F.col("__key__").cast("long").alias("doc_id"), F.md5(as_text(F.col("fields")["txt"])).alias("digest"), as_json(F.col("fields")["json"], "lang string, n_chars bigint").alias("j"))
    return fields.select("doc_id", "digest", "j.lang", "j.n_chars")


_EMBEDDINGS = "SELECT vec_id, label, len(embedding)::BIGINT n, round(list_sum(embedding::DOUBLE[]), 4) total FROM embeddings"


def _embeddings(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(_EMBEDDINGS)
def npy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as npy files and back."""
    from shardloom.functions import codecs

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", codecs.tensor_npy(codecs.floats_tensor(F.col("embedding"))).alias("npy"))
    return _embeddings(e.select("vec_id", "label", codecs.tensor_floats(codecs.npy_tensor(F.col("npy"))).alias("v")))


@query(_EMBEDDINGS)
def tenbin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tensor files and back."""
    from shardloom.functions import codecs

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", codecs.list_tensor(F.array(codecs.floats_tensor(F.col("embedding")))).alias("ten"))
    back = e.select("vec_id", "label", codecs.tensor_list(F.col("ten")).alias("ts"))
    return _embeddings(back.select("vec_id", "label", codecs.tensor_floats(F.col("ts")[0]).alias("v")))


@query("SELECT doc_id, md5(text) digest FROM documents")
def gz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts packed and unpacked."""
    from shardloom.functions import codecs

    d = table(spark, sf_dir, "documents").select("doc_id", codecs.gzipped(F.col("text").cast("binary")).alias("gz"))
    return d.select("doc_id", F.md5(codecs.gunzip(F.col("gz"))).alias("digest"))


@query("SELECT doc_id, md5(text) digest FROM documents")
def directory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that come into a directory, read by a stream until it is empty."""
    import uuid

    from shardloom.sources.tarwrite import write_shards
    from shardloom.streaming.directory import drain, shard_stream

    path = f"{local_path(shared_dir(spark))}/stream-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("__key__"), F.col("text").alias("txt"))
    write_shards(d, f"{path}/in", maxcount=5000)
    out = drain(shard_stream(spark, f"{path}/in", per_trigger=4), f"{path}/checkpoint", f"{path}/out")
    return out.select(F.col("__key__").cast("long").alias("doc_id"), F.md5(F.col("fields")["txt"]).alias("digest"))
