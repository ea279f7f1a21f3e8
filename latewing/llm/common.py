"""What several operators share: table reading, Arrow batches, the training fold."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of other characters than these, in regular expressions of the JVM.
SPACE = r"\x20\x09-\x0D"

_DDL = {
    pa.int32(): "int",
    pa.int64(): "bigint",
    pa.float64(): "double",
    pa.string(): "string",
    pa.binary(): "binary",
    pa.bool_(): "boolean",
    pa.list_(pa.int32()): "array<int>",
    pa.list_(pa.int64()): "array<bigint>",
    pa.list_(pa.float64()): "array<double>",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"`{name}` {_DDL[kind]}" for name, kind in fields.items())


def batch(fields: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in fields.items()], names=list(fields))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few whole texts are Python objects at once."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def worker_state(key: tuple, build: Callable[[], object]) -> object:
    """Something costly that a Python worker keeps from task to task: a tokenizer, a memo of bounded size."""
    kept = sys.modules.setdefault("_latewing_worker_state", types.ModuleType("_latewing_worker_state")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from. A row without an id is one of them."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def share_kept(key: Column, share: Column | float) -> Column:
    """True for about that share of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) < F.lit(1 << 30) * share
