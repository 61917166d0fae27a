"""Toxicity (operator 8): classifier chains over word features.

Categories are predicted one after another; each linear model sees the words of
a text and the probabilities of the categories before it.  For training, those
probabilities come from models that have not seen the row (out of fold), so
that a later model trusts an earlier one no more than it deserves.

Categories are 0/1 columns of the training rows.  The tables have one label for
toxicity and no finer ones, so ``weak_categories`` derives two parts of it, which
are aids to the chain and not judgements of their own: ``blunt``, toxic texts
with a feature of the more telling half, and ``veiled``, toxic texts with a
feature of the other half.  The label itself comes last in the chain.  Features
are a text's distinct words and, for lengths of ``STEMS``, word beginnings, so
that inflected and made-up forms of one stem count together; those kept are the
``max_features`` most telling of the training rows by their log-likelihood ratio
among those in ``least`` toxic rows and ``factor`` times as common there.

Training rows: one for each of at most ``max_rows`` labelled ids, by a hash of
the id; see ``quality.training_rows`` for repeated ids.  Rows of ``score``: one
per input row, repeated ids included; the query returns those flagged, with the
probability of every category.  Null and empty texts have no words and are
scored by the intercepts; of very long texts all words count.  Ties between
features go by name.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import table, text_of, written
from shardloom.llm.quality import MAX_ROWS, training_rows

#: Features kept, toxic training rows that a feature is in at least, how much commoner it is there at least, and folds.
MAX_FEATURES, LEAST, FACTOR, FOLDS = 400, 5, 3.0, 5
#: Lengths of the word beginnings.
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.5


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)]


@dataclass(frozen=True)
class Chain:
    """Names, features with their column, and of each category the intercept, word weights and weights of the categories before it."""

    names: tuple[str, ...]
    columns: dict[str, int]
    intercepts: np.ndarray
    words: np.ndarray  # category by feature
    links: np.ndarray  # category by category, below the diagonal

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Of texts given as sums of word weights (text by category), category after category."""
        out = np.zeros_like(sums)
        for k in range(len(self.names)):
            out[:, k] = _sigmoid(sums[:, k] + self.intercepts[k] + out[:, :k] @ self.links[k, :k])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(words: DataFrame, most: int = MAX_FEATURES, least: int = LEAST, factor: float = FACTOR) -> list[str]:
    """The features with the largest log-likelihood ratio, in falling order, among those of ``least`` positive rows and ``factor`` times as common there.

    ``words`` has ``y`` and ``words`` (distinct, between blanks); frequencies are
    added up by Spark, so that only the chosen features reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            names = list(inside.keys() | outside.keys())
            return pa.record_batch({"f": pa.array(names, pa.string()), "a": pa.array([inside[f] for f in names], pa.int64()), "b": pa.array([outside[f] for f in names], pa.int64())})

        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("words")):
                (inside if y >= 0.5 else outside).update({f for w in text.as_py().split() for f in _features(w)})
                if len(inside) + len(outside) > 300_000:
                    yield out()
                    inside.clear()
                    outside.clear()
        yield out()

    p, n = (max(int(x or 0), 1) for x in words.agg(F.sum((F.col("y") >= 0.5).cast("int")), F.sum((F.col("y") < 0.5).cast("int"))).first())
    sums = words.select("y", "words").mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (p + n)
    ratio = F.col("a") * F.log(F.col("a") / p / share) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n / share)).otherwise(0.0)
    good = sums.where((F.col("a") >= least) & (F.col("a") / p > factor * F.col("b") / n))
    return [r.f for r in good.select("f", ratio.alias("r")).orderBy(F.desc("r"), "f").limit(most).collect()]


def weak_categories(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Blunt and veiled columns of training rows by feature, the most telling first, and the label itself as the last; see the module."""
    half = -(-x.shape[1] // 2)
    parts = {"blunt": x[:, :half], "veiled": x[:, half:]}
    return {name: (y & part.any(axis=1)).astype(float) for name, part in parts.items()} | {"toxic": y.astype(float)}


def _merged(x: np.ndarray, y: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, labels and weights with the rows that have none of the first ``words`` features merged; most texts have none."""
    hit = x[:, :words].any(axis=1)
    rest, times = np.unique(np.column_stack([x[~hit, words:], y[~hit]]), axis=0, return_counts=True)
    empty = np.zeros((len(rest), words), dtype=np.float32)
    rows = np.vstack([x[hit], np.hstack([empty, rest[:, :-1]])]).astype(np.float32)
    return rows, np.concatenate([y[hit], rest[:, -1]]).astype(np.float32), np.concatenate([np.ones(int(hit.sum())), times]).astype(np.float32)


def _logistic(x: np.ndarray, y: np.ndarray, words: int, ridge: float = 1e-3, steps: int = 200) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic model by accelerated gradient steps."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    b = float(np.log(share / (1 - share)))
    w = np.zeros(x.shape[1], dtype=np.float32)
    if not len(y) or not x.shape[1] or y.min() == y.max():
        return b, w
    x, y, weight = _merged(x, y, words)
    weight = weight / weight.sum()
    top = np.linalg.eigvalsh(((x * weight[:, None]).T @ x).astype(float))[-1]
    rate = np.float32(4.0 / (top + 1.0))
    z, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = weight * (_sigmoid(x @ z + np.float32(zb)) - y)
        new, new_b = z - rate * (x.T @ error + np.float32(ridge) * z), zb - float(rate * error.sum())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + np.float32((t - 1) / after) * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return b, w


def fit_chain(x: np.ndarray, labels: dict[str, np.ndarray], features: list[str], folds: int = FOLDS) -> Chain:
    """A chain in the order of ``labels`` over 0/1 features; earlier categories enter by their out-of-fold probabilities."""
    names, columns = tuple(labels), {f: k for k, f in enumerate(features)}
    fold = np.arange(len(x)) % folds
    unseen = np.zeros((len(x), len(names)), dtype=x.dtype)
    intercepts, words, links = np.zeros(len(names)), np.zeros((len(names), len(features))), np.zeros((len(names), len(names)))
    for k, name in enumerate(names):
        full, y = np.hstack([x, unseen[:, :k]]), labels[name]
        for f in range(folds):
            if (fold == f).any() and (fold != f).any():
                b, w = _logistic(full[fold != f], y[fold != f], len(features))
                unseen[fold == f, k] = _sigmoid(full[fold == f] @ w + b)
        intercepts[k], w = _logistic(full, y, len(features))
        words[k], links[k, :k] = w[: len(features)], w[len(features) :]
    return Chain(names, columns, intercepts, words, links)


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of a text."""
    return set(_WORD.findall(text.lower()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, least: int = LEAST, factor: float = FACTOR, folds: int = FOLDS) -> Chain:
    """A chain for one toxicity label, fitted on the driver on a bounded sample; the texts come as their distinct words."""
    kind = docs.schema[id].dataType.simpleString()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.record_batch({"id": part.column("id"), "y": part.column("y"), "words": pa.array([" ".join(sorted(words_of(t))) for t in part.column("text").to_pylist()], pa.string())})

    sample = training_rows(docs, labels, label, id, max_rows).select(F.col(id).alias("id"), "y", "text")
    words = written(sample.mapInArrow(distinct, f"id {kind}, y double, words string"))
    features = telling(words, max_features, least, factor)
    columns = {f: k for k, f in enumerate(features)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted({columns[f] for w in text.as_py().split() for f in _features(w) if f in columns}) for text in batch.column("words")]
            yield pa.record_batch({"id": batch.column("id"), "y": batch.column("y"), "hits": pa.array(hits, pa.list_(pa.int32()))})

    rows = words.mapInArrow(found, f"id {kind}, y double, hits array<int>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.zeros((rows.num_rows, len(features)), dtype=np.float32)
    for k, hits in enumerate(rows.column("hits")):
        x[k, hits.as_py()] = 1
    y = rows.column("y").to_numpy() >= 0.5
    return fit_chain(x, weak_categories(x > 0, y), features, folds)


def score(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``p_<category>`` of every row."""
    kind = docs.schema[id].dataType.simpleString()
    width = len(chain.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}  # features of the words met
        weights = chain.words.T
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sums = np.zeros((part.num_rows, width))
                for row, content in enumerate(part.column("text").to_pylist()):
                    hit: set[int] = set()
                    for w in words_of(content):
                        if (found := known.get(w)) is None:
                            found = tuple(chain.columns[f] for f in _features(w) if f in chain.columns)
                            if len(known) < 200_000:
                                known[w] = found
                        hit.update(found)
                    if hit:
                        sums[row] = weights[sorted(hit)].sum(axis=0)
                p = chain.probabilities(sums)
                yield pa.record_batch([part.column("id"), *[pa.array(p[:, k]) for k in range(width)]], names=["id", *[f"p_{n}" for n in chain.names]])

    schema = f"id {kind}, " + ", ".join(f"p_{n} double" for n in chain.names)
    return docs.select(F.col(id).alias("id"), text_of(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the chain flags as toxic, with the probabilities of all categories."""
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).where(F.col(f"p_{chain.names[-1]}") >= THRESHOLD).withColumn("toxic", F.lit(True))
