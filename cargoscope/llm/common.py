"""Small helpers shared by the text operators."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Upper to lower for A-Z only, on UTF-8 bytes.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over functions of this package; ``fn`` takes and returns record batches."""
    workers_find_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def hash_share(column: str, share: float) -> Column:
    """Whether a row is in the share of all values whose xxhash64 is least."""
    return (F.xxhash64(column).cast("double") / 2.0**64 + 0.5) < F.lit(share)


_HOLDS: dict[str, object] = {}  # what the operator now running on this worker remembers


def remembered(name: str, make):
    """An object a worker keeps from task to task.  Another name lets go of the one before, so a
    worker that runs several operators in turn holds the memory of one."""
    if name not in _HOLDS:
        _HOLDS.clear()
        _HOLDS[name] = make()
    return _HOLDS[name]


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def utf8(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII letters alone take the quick path."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
