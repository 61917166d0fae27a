"""Rolling of shards by count and size, as a stateful pass over each task's rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


class Roller:
    """Number of the shard that the next record goes to; full shards are noticed before a write."""

    def __init__(self, max_count: int = 100_000, max_size: float = 3e9, start: int = 0):
        self.max_count, self.max_size, self.shard = max_count, max_size, start
        self.count, self.size = 0, 0.0

    def place(self, size: int) -> int:
        if self.count >= self.max_count or self.size >= self.max_size:
            self.shard, self.count, self.size = self.shard + 1, 0, 0.0
        self.count += 1
        self.size += size
        return self.shard


def rolled(df: DataFrame, task: str, order: str, size: str, max_count: int = 100_000, max_size: float = 3e9) -> DataFrame:
    """``df`` with the ``shard`` of each row, rolled inside each ``task`` in the order of ``order``.

    Rows of one task are sorted by Spark and passed through once, in batches,
    so memory does not grow with a task's rows.
    """
    import pyarrow as pa

    held = df.repartition(task).sortWithinPartitions(task, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roller = object(), Roller(max_count, max_size)
        for batch in batches:
            out = []
            for t, n in zip(batch.column(task).to_pylist(), batch.column(size).to_pylist()):
                if t != now:
                    now, roller = t, Roller(max_count, max_size)
                out.append(roller.place(n or 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "shard"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return held.mapInArrow(run, f"{kinds}, shard long")
