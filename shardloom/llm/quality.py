"""Quality classifier (operator 5): a sparse rule ensemble compiled to columns.

Small decision trees are grown on statistics of labelled texts; every path from
a root to a node is a conjunctive rule.  A logistic model with lasso weights
over all rules and the statistics' scaled values keeps a few of them, and what
is kept is compiled into one Spark column expression, so that scoring runs in
the JVM beside the scan and shuffles nothing.

Training rows: one for each of at most ``max_rows`` labelled ids, the first in
the order of a hash of the id, so that a larger corpus changes the sample but
not its size.  Of an id with several texts the one of the smallest hash counts;
repeated labels of an id are averaged; rows without an id or a label are left
out.  Rows: one per input row, repeated ids included.  A null or empty text has
the statistics of an empty text and gets a score too; a very long text is read
whole, like others.  Columns of the input are held apart from those made here,
so their names can't clash, but ``score`` and ``predicted`` replace columns of
these names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import table, text_of

#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 12_000
TREES, DEPTH, LASSO = 30, 3, 1e-3
THRESHOLD = 0.3


def split_words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\r")), r"\s+")


def statistics(text: Column, words: Column | None = None, count: Column | None = None, n: Column | None = None) -> dict[str, Column]:
    """The statistics of a text by name, all as doubles; none divides by zero.  Words, their count and the length can be given if they are there already."""
    n = F.length(text).cast("double") if n is None else n
    words = split_words(text) if words is None else words
    count = F.size(words).cast("double") if count is None else count
    of = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda x, y: x / F.greatest(y, F.lit(1.0))
    return {
        "length": F.log1p(n),
        "word_length": share(n, count),
        "distinct": share(F.size(F.array_distinct(words)).cast("double"), count),
        "pairs": share(of(r"(?<!\S)(\S+)\s+\1(?!\S)"), count),
        "upper": share(of(r"\p{Lu}"), n),
        "shouted": share(of(r"\p{Lu}{2,}"), count),
        "digits": share(of(r"[0-9]"), n),
        "signs": share(of(r"[^\p{L}\p{N}\s.,;:'\"()!?-]"), n),
        "sign_runs": share(of(r"[^\p{L}\p{N}\s]{2,}"), count),
        "stops": share(of(r"[.!?](?!\S)"), count),
        "lines": share(of(r"\n"), count),
        "lone_signs": share(of(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)"), count),
    }


@dataclass(frozen=True)
class Term:
    """A weight for rows that satisfy all conditions (statistic, whether above, bound)."""

    weight: float
    conditions: tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Model:
    """Intercept, rules, and the kept linear terms: (statistic, low, high, weight of the clipped value)."""

    intercept: float
    rules: tuple[Term, ...]
    linear: tuple[tuple[str, float, float, float], ...]

    def logit(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            holds = reduce(lambda a, b: a & b, [stats[s] > t if above else stats[s] <= t for s, above, t in rule.conditions])
            total = total + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        for name, low, high, weight in self.linear:
            total = total + F.least(F.greatest(stats[name], F.lit(low)), F.lit(high)) * weight
        return total


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: tuple, out: list[tuple]) -> None:
    """Greedy variance splits at 32 quantiles of some columns; every path is added to ``out``."""
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best: tuple[float, int, float] | None = None
    for c in columns:
        v, t = x[rows, c], y[rows]
        for bound in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 32))):
            above = v > bound
            k = int(above.sum())
            if 5 <= k <= len(rows) - 5:
                gain = t[above].sum() ** 2 / k + t[~above].sum() ** 2 / (len(rows) - k)
                if best is None or gain > best[0]:
                    best = gain, int(c), float(bound)
    if best is None:
        return
    _, c, bound = best
    above = x[rows, c] > bound
    _grow(x, y, rows[above], columns, depth - 1, (*path, (c, True, bound)), out)
    _grow(x, y, rows[~above], columns, depth - 1, (*path, (c, False, bound)), out)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty, by accelerated proximal gradient."""
    n, d = x.shape
    rate = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1.0)
    w, b, z, zb, t = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(d), 0.0, 1.0
    zb = b
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ z + zb, -30, 30))) - y
        new = z - rate * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = zb - rate * error.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO, seed: int = 1) -> Model:
    """The rule ensemble of a table of statistics and 0/1 labels; a constant model if there is one class only."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Model(float(np.log(share / (1 - share))), (), ())
    random = np.random.default_rng(seed)
    paths: list[tuple] = []
    for _ in range(trees):
        rows = random.choice(len(y), size=min(len(y), 1500), replace=False)
        columns = random.choice(x.shape[1], size=min(x.shape[1], 4), replace=False)
        _grow(x, y.astype(float), rows, columns, depth, (), paths)
    paths = list(dict.fromkeys(paths))
    hold = np.ones((len(y), len(paths)))
    for k, path in enumerate(paths):
        for c, above, bound in path:
            hold[:, k] *= x[:, c] > bound if above else x[:, c] <= bound
    low, high = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    spread = np.clip(x, low, high)
    scale = np.where(spread.std(axis=0) > 1e-9, spread.std(axis=0), np.inf)
    full = np.hstack([hold, spread / scale * 0.4])
    middle = full.mean(axis=0)
    b, w = lasso_logistic(full - middle, y.astype(float), penalty)
    w[np.abs(w) < 0.02] = 0
    b -= float(middle @ w)
    rules = tuple(Term(round(float(w[k]), 6), tuple((names[c], above, bound) for c, above, bound in path)) for k, path in enumerate(paths) if w[k])
    linear = tuple((names[c], float(low[c]), float(high[c]), float(w[len(paths) + c] * 0.4 / scale[c])) for c in range(x.shape[1]) if w[len(paths) + c])
    return Model(float(b), rules, linear)


def held_out(id: str = "doc_id") -> Column:
    """Whether the id's CRC-32 leaves no remainder by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """``id, text, y`` of at most ``max_rows`` labelled documents that are not held out, a row for each id; so many labels are broadcast."""
    known = labels.select(F.col(id).alias(id), F.col(label).cast("double").alias("y")).where(F.col(id).isNotNull() & F.col("y").isNotNull() & ~held_out(id))
    # Only the lower end of the hashes is sorted, or every partition would send max_rows rows to one task.
    share = min(1.0, 1.5 * max_rows / max(known.count(), 1))
    low = known if share >= 1 or max_rows < 1000 else known.where(F.xxhash64(id) <= int(-(2**63) + share * 2**64))
    some = low.groupBy(id).agg(F.avg("y").alias("y")).orderBy(F.xxhash64(id), id).limit(max_rows)
    found = docs.select(id, text_of("text").alias("text")).join(F.broadcast(some), id)
    return found.groupBy(id, "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """A rule ensemble for ``label``, fitted on the driver on a bounded sample."""
    rows = training_rows(docs, labels, label, id, max_rows)
    stats = statistics(F.col("text"))
    data = rows.select(F.col(id).alias("_id"), "y", *[c.alias(n) for n, c in stats.items()]).toPandas().sort_values(["_id", "y", *stats])
    return fit_rules(data[list(stats)].to_numpy(float), (data["y"].to_numpy() >= 0.5).astype(float), list(stats))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` in place of columns of these names."""
    names = list(statistics(F.lit("")))
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.struct(*[c.alias(n) for n, c in statistics(text_of(text)).items()]).alias("stats"))
    logit = model.logit({n: F.col(f"stats.{n}") for n in names})
    scored = wide.select("row", (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns."""
    # A filter is pushed below projections and would repeat the statistics in every rule; a lambda's variable is computed once.
    names = list(statistics(F.lit("")))
    one = F.transform(F.array(text_of(text)), lambda t: F.struct(t.alias("t"), split_words(t).alias("w"), F.length(t).cast("double").alias("n")))
    two = F.transform(one, lambda b: F.struct(b["t"].alias("t"), b["w"].alias("w"), b["n"].alias("n"), F.size(b["w"]).cast("double").alias("c")))
    three = F.transform(two, lambda b: F.struct(*[c.alias(k) for k, c in statistics(b["t"], b["w"], b["c"], b["n"]).items()]))
    logit = F.get(F.transform(three, lambda s: model.logit({k: s[k] for k in names})), F.lit(0))
    return docs.where(1 / (1 + F.exp(-logit)) >= threshold)
