"""Secret scans (operator 3), with DataFrame functions only.

Each rule is a regular expression.  From its syntax tree a Boolean query over
trigrams is derived: every match needs those trigrams of the lower-cased text.

1. ``postings`` builds an inverted index of the rules' trigrams: for each
   segment of the distinct texts and each trigram, the list of the texts that
   hold it.  Segments bound the lists, so no list grows with the corpus.
2. ``candidates`` evaluates the queries on the index, intersecting lists where
   all trigrams are needed and uniting them where any will do.
3. Texts are joined to their candidate rules, copies of a text being spread,
   and only candidates are verified with the expression itself.  Rules without
   a mandatory trigram (long hexadecimal runs) are run over every text.

The index goes by a hash of the text: texts that share one share their lists,
which can only add candidates.

Matches are leftmost and do not overlap within a rule; a match whose checked
group is too short is dropped after matching.  Spans are in code points, end
exclusive; their places are sums by blocks, so a text with a million matches
takes a hundred times as long as one with ten thousand.

Rows: one per input row, repeated ids included.  A null or empty text has no
spans; ``base_sha256`` is then the digest of the empty string.  Very long texts
are matched whole.  Columns of the input are held apart from those made here,
so their names can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import hot_keys, salted_join, table, text_of, written


#: Distinct texts in one segment of the index, about; matches whose places are summed up in one block.
SEGMENT, BLOCK = 10_000, 512
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length is checked, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opusr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
)

# --- Boolean trigram queries: True, a trigram, or ("and" | "or", parts) ---

Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any(parts: list[Query]) -> Query:
    if not parts or any(p is True for p in parts):
        return True
    needs = {p: {p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else {p} for p in parts}
    kept = [p for p in needs if not any(needs[q] < needs[p] for q in needs)]  # what needs more than another is covered by it
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The trigrams that the lower-cased text of any match must contain; True if there is none.

    Neighbouring parts with at most ``most`` possible strings are multiplied out.
    """

    def exact(op: object, arg: object) -> set[str] | None:
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            kinds = {str(o) for o, _ in arg}
            return {chr(a).lower() for _, a in arg} if kinds == {"LITERAL"} and len(arg) <= most else None
        if name == "SUBPATTERN":
            return strings(arg[3])
        if name == "BRANCH":
            found = [strings(x) for x in arg[1]]
            return None if any(x is None for x in found) else set().union(*found)
        if name == "MAX_REPEAT" and arg[1] <= 3:
            inner = strings(arg[2])
            return None if inner is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(sorted(inner), repeat=n)}
        return None

    def strings(items: object) -> set[str] | None:
        found = {""}
        for op, arg in items:
            part = exact(op, arg)
            if part is None or len(found) * len(part) > most:
                return None
            found = {a + b for a in found for b in part}
        return found

    def query(items: object) -> Query:
        run, parts = {""}, []
        for op, arg in items:
            part = exact(op, arg)
            if part is not None and len(run) * len(part) <= most:
                run = {a + b for a in run for b in part}
                continue
            parts.append(_of_strings(run))
            run = part if part is not None else {""}
            name = str(op)
            if part is None and name == "SUBPATTERN":
                parts.append(query(arg[3]))
            elif part is None and name == "BRANCH":
                parts.append(_any([query(x) for x in arg[1]]))
            elif part is None and name == "MAX_REPEAT" and arg[0] > 0:
                parts.append(query(arg[2]))
        return _all([*parts, _of_strings(run)])

    return query(re._parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    """All trigrams that a query names."""
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _names(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", segments: int = 1) -> DataFrame:
    """The inverted index for the rules' trigrams: ``segment, trigram, texts``, the hashes of the texts of a segment that hold it."""
    names = _names(rules)
    low = docs.select(F.xxhash64(text_of(text)).alias("t"), F.lower(text_of(text)).alias("low"))
    held = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.col("low").contains(n)) if names else F.array().cast("array<string>")
    flat = low.select("t", F.explode(held).alias("trigram"))
    return flat.groupBy(F.pmod("t", F.lit(segments)).alias("segment"), "trigram").agg(F.collect_set("t").alias("texts"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``t, rules``: of each text whose postings satisfy some rule's query, the bits of those rules; none for rules without mandatory trigrams."""
    empty = F.array().cast("array<bigint>")
    one = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("lists"))

    def satisfied(query: Query) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.try_element_at("lists", F.lit(query)), empty)
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, [satisfied(q) for q in query[1]])

    queries = {k: q for k, q in ((k, trigram_query(r.pattern)) for k, r in enumerate(rules)) if q is not True}
    found = [F.struct(F.lit(1 << k).cast("long").alias("bit"), satisfied(q).alias("texts")) for k, q in queries.items()]
    if not found:
        return index.select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("rules")).limit(0)
    each = one.select(F.explode(F.array(*found)).alias("x")).select("x.bit", F.explode("x.texts").alias("t"))
    return each.groupBy("t").agg(F.bit_or("bit").alias("rules"))


def _flagged(docs: DataFrame, rules: tuple[Rule, ...], text: str) -> DataFrame:
    """``row`` (the columns of ``docs``), ``text``, and ``rules``, the bits of the rules by whose query the text is a candidate."""
    n = docs.count()
    found = written(candidates(written(postings(docs, rules, text, -(-n // SEGMENT) or 1)), rules))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c != text] or [F.lit(0)]
    held = docs.select(row.alias("row"), text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("t"))
    joined = salted_join(held.withColumn("spread", F.xxhash64(*rest)), found, ["t"], ["spread"], "left", hot_keys(held, ["t"], n))
    return joined.select("row", "text", F.coalesce("rules", F.lit(0)).alias("rules"))


def _once(value: Column, of: object) -> Column:
    """``of(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _matches(text: Column, rule: Rule) -> Column:
    """All matches of a rule in order: array of (piece before it, match, whether it is kept)."""

    def zipped(whole: Column) -> Column:
        checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
        before = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
        return F.arrays_zip(before.alias("before"), whole.alias("match"), F.transform(checked, lambda g: F.length(g) >= rule.least).alias("kept"))

    return _once(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), zipped)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Kept spans of a rule as array of (start, kind's number, end): summed up in blocks, whose starts are then summed up."""

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["before"])
        end = start + F.length(m["match"])
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))).cast(SPANS)
        return F.struct(end.alias("at"), F.when(m["kept"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def block(ms: Column) -> Column:
        return F.aggregate(ms, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step)

    def placed(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = lambda b, by: F.transform(b["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))
        return F.flatten(F.zip_with(blocks, starts, moved))

    def located(ms: Column) -> Column:
        parts = F.sequence(F.lit(0), ((F.size(ms) - 1) / BLOCK).cast("int"))
        blocks = F.transform(parts, lambda i: block(F.slice(ms, i * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(ms) > 0, _once(blocks, placed)).otherwise(F.array().cast(SPANS))

    return _once(_matches(text, rule), located)


def _worth_it(rule: Rule, number: int, text: Column, flags: Column) -> Column:
    """Whether a text is a candidate: by the index, and for rules without mandatory trigrams if it holds the shortest run that can be kept."""
    if trigram_query(rule.pattern) is not True:
        return flags.bitwiseAND(F.lit(1 << number).cast("long")) != 0
    return text.rlike(rule.pattern if rule.group else rule.pattern.removesuffix("+") + f"{{{rule.least}}}" if rule.pattern.endswith("]+") and rule.pattern.count("[") == 1 else rule.pattern)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and ``spans``, those of all rules as array of (start, kind's number, end), by start and kind."""
    held = _flagged(docs, rules, text)
    found = [F.when(_worth_it(r, k, F.col("text"), F.col("rules")), _spans(F.col("text"), r, k)).otherwise(F.array().cast(SPANS)) for k, r in enumerate(rules)]
    return held.select("row", F.array_sort(F.flatten(F.array(*found))).alias("spans"))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, a count per base rule, ``base_sha256`` and all ``spans`` of every row; see the module."""
    base = [k for k, r in enumerate(rules) if r.base]
    found = scan(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), rules)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{rules[k].kind}") for k in base]
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(F.col("row.id").alias(id), *counts, F.sha2(_written(kept, rules), 256).alias("base_sha256"), _written(F.col("spans"), rules).alias("spans"))


def _replaced(text: Column, rule: Rule) -> Column:
    """A text with the rule's kept matches replaced."""

    def joined(ms: Column) -> Column:
        parts = F.transform(ms, lambda m: F.concat(m["before"], F.when(m["kept"], F.lit(f"[{rule.kind}]")).otherwise(m["match"])))
        tail = F.element_at(F.split(text, rule.pattern, -1), -1)
        return F.when(F.size(ms) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)

    return _once(_matches(text, rule), joined)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with every kept match replaced by ``[kind]``, rule after rule; a text without one is unchanged, null stays null.

    Each rule runs on what the rule before it left of a text that is its candidate.
    """
    out = _flagged(docs, rules, text).withColumn("now", F.col("text"))
    for number, rule in enumerate(rules):
        new = F.when(_worth_it(rule, number, F.col("now"), F.col("rules")), _replaced(F.col("now"), rule)).otherwise(F.col("now"))
        out = out.select("row", "rules", new.alias("now"))
    clean = F.when(F.col(f"row.`{text}`").isNotNull(), F.col("now"))
    return out.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_spans(table(spark, sf_dir, "documents"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows by running every expression over every text in DuckDB."""
    quoted = {r.kind: "'" + r.pattern.replace("'", "''").replace(r"\x20", " ") + "'" for r in rules}
    lists = ", ".join(f"regexp_extract_all(t, {quoted[r.kind]}) m{k}, regexp_extract_all(t, {quoted[r.kind]}, {r.group}) g{k}, string_split_regex(t, {quoted[r.kind]}) p{k}" for k, r in enumerate(rules))
    spans = ", ".join(
        f"[{{'s': coalesce(list_sum([length(x) for x in p{k}[1:i]]), 0) + coalesce(list_sum([length(x) for x in m{k}[1:i - 1]]), 0), 'k': {k}, 'n': '{r.kind}', 'l': length(m{k}[i])}} for i in range(1, len(m{k}) + 1) if length(g{k}[i]) >= {r.least}] s{k}"
        for k, r in enumerate(rules)
    )
    every = " || ".join(f"s{k}" for k in range(len(rules)))
    base = " || ".join(f"s{k}" for k, r in enumerate(rules) if r.base)
    write = lambda x: f"coalesce(list_aggregate([y.n || ':' || y.s::BIGINT || ':' || (y.s + y.l)::BIGINT for y in list_sort({x})], 'string_agg', ','), '')"
    counts = ", ".join(f"len(s{k})::BIGINT n_{r.kind}" for k, r in enumerate(rules) if r.base)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), m AS (SELECT doc_id, {lists} FROM d), s AS (SELECT doc_id, {spans} FROM m) SELECT doc_id, {counts}, sha256({write(base)}) base_sha256, {write(every)} spans FROM s"
