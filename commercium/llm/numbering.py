"""Gapless numbers within a key without a task for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commercium.sources.staging import stage

#: A key's rows are dealt over as many blocks as the table has of this size, and at most so many.
ROWS_PER_BLOCK, MOST_BLOCKS = 2_000, 4_096


SALT = "__salt"


def salted(rows: DataFrame) -> DataFrame:
    """``rows`` with a number that tells apart rows alike in all columns; to be written before it is read."""
    return rows.withColumn(SALT, F.monotonically_increasing_id())


def number_within(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` in place of their salt: 0, 1, 2 ... within each value of ``key``, in no particular order.

    Rows are dealt into blocks by a hash of ``order`` and salt; a block numbers its rows
    and starts where the blocks before it end. A key, or a row repeated, with a third of
    all rows is spread over all blocks. ``rows`` must be a written table of ``salted`` rows:
    it is read three times.
    """
    order = [*order, SALT]
    blocks = min(max(1, rows.count() // ROWS_PER_BLOCK), MOST_BLOCKS)
    placed = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = placed.groupBy(key, "__block").agg(F.count("*").alias("__n"))
    before = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(
        F.col(key).alias("__key"), F.col("__block").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    within = F.row_number().over(W.partitionBy(key, "__block").orderBy(*order)) - 1
    numbered = placed.withColumn("__rank", within)
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of"))
    number = (F.col("__first") + F.col("__rank")).cast("long").alias(name)
    return numbered.join(first, same).select(*[c for c in rows.columns if c != SALT], number)


def staged_numbers(rows: DataFrame, key: str, order: list[str], name: str, label: str) -> DataFrame:
    return number_within(stage(salted(rows), label), key, order, name)
