"""Token counts (operator 1): pieces are counted once per distinct pre-token group.

1. Every task reduces its texts to distinct pre-token groups with frequencies,
   Spark adds the frequencies up, and each distinct group is encoded once: the
   dictionary, written to the shared folder.
2. The most frequent groups (``head`` at most, of UNIT_BYTES at most: some 20 MB
   as a broadcast) are added up beside the texts; the rest of a text's
   frequencies are joined to the dictionary by a shuffle, to which the rows for
   whole texts go in many parts.  No ids of a text are made but for the next case.

Rows: one per input row, repeated ids and texts included.  A null or empty text
has 0 bytes and 0 tokens.  A text with an added special token is counted by the
library itself, which turns that string into one token.  Texts with long
stretches without blanks are cut into the library's own pre-tokens; a very long
text is a chunk of its own.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import table, text_of, written
from shardloom.llm.pieces import pieces, text_chunks

#: Groups that are broadcast, and their bytes at most; about 25 bytes each.
HEAD, UNIT_BYTES = 200_000, 64
#: Parts of the rows for whole texts, which are joined to nothing.
PARTS = 4096


def dictionary(docs: DataFrame, text: str, model: str, ranks: str | None = None) -> DataFrame:
    """``unit, freq, n_pieces`` of every distinct pre-token group of the texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            _, number, units, _, _ = pieces(model, ranks).units(chunk.column("text"))
            freq = np.bincount(number, minlength=len(units))
            used = np.flatnonzero(freq)
            for at in range(0, len(used), 50_000):
                part = used[at : at + 50_000]
                yield pa.record_batch({"unit": units.take(pa.array(part)), "freq": pa.array(freq[part], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit")
            spaced = pc.match_substring_regex(units, r"^ [^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{205f}\x{3000}]").to_numpy(zero_copy_only=False)
            plain = spaced & ~_hard(units)
            order = np.argsort(~plain, kind="stable")
            batch = batch.take(pa.array(order))
            _, n = pieces(model, ranks).encode(batch.column("unit"), int(plain.sum()))
            yield pa.record_batch({"unit": batch.column("unit"), "freq": batch.column("freq"), "n_pieces": pa.array(n, pa.int64())})

    return (
        docs.select(text_of(text).alias("text"))
        .mapInArrow(distinct, "unit string, freq long")
        .groupBy("unit")
        .agg(F.sum("freq").alias("freq"))
        .mapInArrow(count, "unit string, freq long, n_pieces long")
    )


def _hard(units: pa.Array) -> np.ndarray:
    from shardloom.llm.pieces import RUNS, SETTLED

    return pc.or_(pc.match_substring_regex(units, RUNS), pc.invert(pc.match_substring_regex(units, SETTLED))).to_numpy(zero_copy_only=False)


def most_frequent(counted: DataFrame, head: int) -> DataFrame:
    """Units from the top classes of frequency (eighths of a doubling) that together hold at most ``head`` units.

    A sorted limit would send that many rows of every partition to one task;
    here a row for each class is counted, a few hundred at any size.
    """
    rank = F.floor(F.log2("freq") * 8)
    taken, lowest = 0, None
    for row in sorted(counted.groupBy(rank.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        taken += row.n
        if taken > head:
            break
        lowest = row.c
    return counted.limit(0) if lowest is None else counted.where(rank >= lowest)


def count_tokens(docs: DataFrame, model: str, ranks: str | None = None, id: str = "doc_id", text: str = "text", max_tokens: int = 1024, head: int = HEAD) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, n_units`` for every row of ``docs``; see the module."""
    spark = docs.sparkSession
    counted = written(dictionary(docs, text, model, ranks))
    frequent = most_frequent(counted.where(F.octet_length("unit") <= UNIT_BYTES), head).select("unit", "n_pieces").toArrow()
    known = spark.sparkContext.broadcast((frequent.column("unit").combine_chunks(), frequent.column("n_pieces").to_numpy()))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with its bytes and frequent groups, and one for each other group of it."""
        row, (names, sizes) = TaskContext.get().partitionId() << 40, known.value
        sizes = np.append(sizes, 0)
        for chunk in text_chunks(batches):
            texts, ids = chunk.column("text"), chunk.column("id")
            owner, number, units, _, whole = pieces(model, ranks).units(texts)
            at = pc.fill_null(pc.index_in(units, value_set=names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.bincount(owner, weights=sizes[at][number], minlength=len(texts)).astype(np.int64)
            for k, content in whole.items():
                total[k] = len(pieces(model, ranks).whole(content))
            rows = np.arange(row, row + len(texts))
            n_units = np.bincount(owner, minlength=len(texts))
            empty = pa.array([""] * len(texts), pa.string())
            yield pa.record_batch({"row": pa.array(rows), "part": pa.array(1 + rows % PARTS), "id": ids, "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_units": pa.array(n_units, pa.int64()), "n": pa.array(total), "unit": empty})
            rare = at[number] == len(names)
            pair, freq = np.unique(owner[rare] * len(units) + number[rare], return_counts=True)
            for start in range(0, len(pair), 50_000):
                part, times = pair[start : start + 50_000], freq[start : start + 50_000]
                who = part // len(units)
                zero = pa.array(np.zeros(len(part), dtype=np.int64))
                yield pa.record_batch({"row": pa.array(rows[who]), "part": zero, "id": ids.take(pa.array(who)), "n_bytes": zero, "n_units": zero, "n": pa.array(times, pa.int64()), "unit": units.take(pa.array(part % len(units)))})
            row += len(texts)

    kind = docs.schema[id].dataType.simpleString()
    found = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).mapInArrow(frequencies, f"row long, part long, id {kind}, n_bytes long, n_units long, n long, unit string")
    joined = found.join(counted.select("unit", F.lit(0).cast("long").alias("part"), "n_pieces"), ["unit", "part"], "left")
    return (
        joined.groupBy("row", "id")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("n_pieces", F.lit(1))).alias("n_tokens"), F.sum("n_units").alias("n_units"))
        .select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"), "n_units")
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public byte-level vocabulary, against a limit of 1024."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
