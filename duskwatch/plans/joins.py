"""Joins whose keys may be hot, the size check behind every broadcast, and rows dealt to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16
TASKS_PER_CORE = 4


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a side before broadcasting it; reads no more than ``max_rows`` + 1 rows."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, size = (
        df.select(width.alias("w")).limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    )
    return rows <= max_rows and size <= max_bytes


def sized(df: DataFrame) -> DataFrame:
    """The right side of a join, broadcast if it was measured to fit, else never: estimates by file size do not know its rows."""
    return F.broadcast(df) if fits_broadcast(df) else df.hint("merge")


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows that each cost much, dealt to all cores: a small file is one split, however long its rows take."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE)


def as_constants(df: DataFrame) -> DataFrame:
    """A table that :func:`fits_broadcast` as constants of the plan: what made it is not planned or run again."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[str],
    salts: int = SALTS, large: bool = False,
) -> DataFrame:
    """Join a large ``left`` with a narrow ``right`` so that no key lands in one task.

    Rows of one key spread over ``salts`` buckets by the ``spread`` columns; ``right`` is repeated
    once per bucket. Catalyst still picks a broadcast when it takes ``right`` for small; its estimate
    knows nothing of the copies, so ``large`` rules that out for a side that was measured.
    """
    bucket = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if large:
        repeated = repeated.hint("merge")
    joined = left.withColumn("_salt", bucket).join(repeated, [*on, "_salt"], how)
    return joined.drop("_salt")
