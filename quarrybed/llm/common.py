"""Helpers shared by the training-data operators: table access, shared scratch space, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table
from ..shared import Rounds, Scratch, drop_path, persist_shared, scratch_path, shared_dir

__all__ = [
    "Rounds", "Scratch", "drop_path", "extended", "map_texts", "persist_shared", "pieces", "restored", "scratch_path", "shared_dir", "sheltered", "small_batches", "table", "texts_of", "without",
]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names the caller's own output takes."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def sheltered(df: DataFrame, **named: str) -> DataFrame:
    """The whole row as one struct `_row`, beside the columns an operator needs: no other name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(row, *[F.col(f"`{c}`").alias(n) for n, c in named.items()])


def restored(df: DataFrame) -> DataFrame:
    """The rows of sheltered() as they were."""
    return df.select("_row.*")


def extended(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """schema with further columns (name, DDL type); a clashing name is a caller's error."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        if name in schema.names:
            raise ValueError(f"input already has a column {name}")
        out = out.add(name, T._parse_datatype_string(kind))
    return out


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text in `column` is at most `limit` bytes, or a single row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if len(col) == 0:
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start, len(sizes) - start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


#: What one Arrow batch of texts may hold; the session's own limit is 64 MB and its copies add up in a worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; a smaller limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "67108864b")).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def map_texts(df: DataFrame, column: str, schema: T.StructType, work: Callable, limit: int = 4 << 20) -> DataFrame:
    """mapInArrow where `work(batch)` sees at most `limit` bytes of text at a time and returns a batch or None."""

    def run(batches):
        for part in pieces(batches, column, limit):
            out = work(part)
            if out is not None:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
