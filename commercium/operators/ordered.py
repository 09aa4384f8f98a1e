"""Ranks, running totals and exact quantiles that no single task has to hold.

``Window.orderBy`` without a partition key, or with a key that owns a third of
the rows, sorts that whole group in one task.  The operators here rest on one
primitive instead, ``running_totals``: rows are range-partitioned on their
order, each slice is summed, and the totals of the earlier slices are carried
into the next as its opening balance.

Equal order keys cannot be split by a range partitioner, so callers pass keys
that are unique: ranks and quantiles first reduce the rows to distinct values
with counts, which also combines hot values on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercium.functions import null_safe_equal
from commercium.sources.staging import stage

_SLICE = "_slice"
_OPENING = "_opening"


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    measures: Sequence[str],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``<m>_before`` and ``<m>_total`` for every measure ``m``.

    ``<m>_before`` sums ``m`` over the rows that precede this one in ``order``
    inside its ``within`` group, ``<m>_total`` over the whole group.  Rows must
    be unique in (within, order).  Stages ``df`` once: the slice a row falls
    into is read back, never recomputed, so a lost executor cannot move it.
    """
    within = list(within)
    sliced = stage(
        df.repartitionByRange(*[F.col(c) for c in within], *order).withColumn(
            _SLICE, F.spark_partition_id()
        ),
        "slices",
    )
    sums = [F.sum(m).alias(m) for m in measures]
    # One row per slice and group at most slices + groups rows, whatever the input.
    slices = sliced.groupBy(*within, _SLICE).agg(*sums)
    earlier = Window.partitionBy(*within).orderBy(_SLICE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    group = Window.partitionBy(*within)
    openings = slices.select(
        *within,
        _SLICE,
        *[F.sum(m).over(earlier).alias(m) for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
        F.lit(True).alias(_OPENING),
    )
    # The opening balance enters as the first row of its slice: no join, and the
    # rows shuffle once.
    rows = sliced.withColumn(_OPENING, F.lit(False)).unionByName(
        openings, allowMissingColumns=True
    )
    slice_window = Window.partitionBy(*within, _SLICE)
    preceding = slice_window.orderBy(F.col(_OPENING).desc(), *order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0)
    return (
        rows.withColumns(
            {f"{m}_before": F.coalesce(F.sum(m).over(preceding), zero) for m in measures}
            | {f"{m}_total": F.max(f"{m}_total").over(slice_window) for m in measures}
        )
        .where(~F.col(_OPENING))
        .drop(_OPENING, _SLICE)
    )


def _attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a lookup with one row per key; NULL keys match NULL keys."""
    renamed = lookup.withColumnsRenamed({c: f"_key_{c}" for c in keys})
    condition = null_safe_equal({c: df[c] for c in keys}, {c: renamed[f"_key_{c}"] for c in keys}, keys)
    return df.join(renamed, condition).drop(*[f"_key_{c}" for c in keys])


def value_ranks(
    df: DataFrame,
    value: str,
    within: Sequence[str] = (),
    rank: str | None = None,
    dense_rank: str | None = None,
    nulls_first: bool = False,
) -> DataFrame:
    """Competition and/or dense rank by descending ``value`` inside each ``within`` group.

    The rank depends on the value alone, so it is computed on distinct values
    and joined back; a hot value meets exactly one lookup row and adaptive
    execution splits its partition.  ``value`` must be reproducible: stage rows
    whose value is a floating sum before ranking them.
    """
    within = list(within)
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_values", F.lit(1).cast("long"))
    order = F.col(value).desc_nulls_first() if nulls_first else F.col(value).desc_nulls_last()
    ranked = running_totals(counts, [order], ["_rows", "_values"], within)
    wanted = []
    if rank:
        wanted.append((F.col("_rows_before") + 1).cast("long").alias(rank))
    if dense_rank:
        wanted.append((F.col("_values_before") + 1).cast("long").alias(dense_rank))
    return _attach(df, ranked.select(*within, value, *wanted), [*within, value])


def top_ranked(
    df: DataFrame,
    value: str,
    k: int,
    within: Sequence[str] = (),
    rank: str = "rank",
) -> DataFrame:
    """Rows whose competition rank by descending ``value``, NULL first, is at most ``k``.

    Ties are kept.  Only the ``k`` best distinct values of a group can hold such a rank, so the
    window below sees at most ``k`` rows per group after the pushed group limit.
    """
    within = list(within)
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("_rows"))
    best = Window.partitionBy(*within).orderBy(F.col(value).desc_nulls_first())
    leaders = counts.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    lookup = (
        leaders.withColumn(rank, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + 1).cast("long"))
        .where(F.col(rank) <= k)
        .select(*within, value, rank)
    )
    return _attach(df, lookup, [*within, value])


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Sequential number 1..n inside each group; rows must be unique in the order."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], within)
    return counted.withColumn(name, (F.col("_one_before") + 1).cast("long")).drop(
        "_one", "_one_before", "_one_total"
    )


# Copies of one row written out by a single explode step.
_RUN_CHUNK = 100_000


def number_copies(
    df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Sequential number for rows that may repeat exactly.

    Copies are interchangeable, so they travel as one row with a count.  Each
    count is expanded in chunks that are spread over the cluster first, because
    one group of copies may be a third of all rows.  ``order`` must tell every
    two different rows apart.
    """
    runs = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    placed = running_totals(runs, order, ["_copies"], within)
    chunks = placed.withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(_RUN_CHUNK).cast("long")))
    ).withColumn("_to", F.least(F.col("_from") + _RUN_CHUNK, F.col("_copies")) - 1)
    spread = chunks.repartition(*df.columns, "_from")
    offsets = F.explode(F.sequence(F.col("_from"), F.col("_to")))
    return spread.withColumn("_offset", offsets).select(
        *df.columns, (F.col("_copies_before") + F.col("_offset") + 1).cast("long").alias(name)
    )


def quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], within: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry.

    NULLs are skipped.  The two order statistics around each position are picked
    from the distinct values by their running counts; the last aggregate is a
    partial max, so a group never gathers in one task.
    """
    within = list(within)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*within, value)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    spans = running_totals(counts, [F.col(value).asc()], ["_rows"], within)
    picks, results = [], []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_rows_total") - 1)
        low = F.floor(position)
        for side, index in (("lo", low), ("hi", F.ceil(position))):
            covers = (F.col("_rows_before") <= index) & (
                index < F.col("_rows_before") + F.col("_rows")
            )
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(position - low).alias(f"_{name}_part"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((lo + (hi - lo) * F.col(f"_{name}_part")).alias(name))
    return spans.groupBy(*within).agg(*picks).select(*within, *results)


def previous_in_order(
    df: DataFrame, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Value of the preceding row in one total order over the whole table.

    Each slice learns the last value before it from the slice summaries, again
    as an extra first row.  Rows must be unique in the order.
    """
    sliced = stage(
        df.repartitionByRange(*order).withColumn(_SLICE, F.spark_partition_id()), "slices"
    )
    inside = Window.partitionBy(_SLICE).orderBy(*order)
    numbered = sliced.withColumn("_at", F.row_number().over(inside))
    lasts = numbered.groupBy(_SLICE).agg(F.max_by(value, "_at").alias(value))
    carried = lasts.select(
        F.lead(_SLICE).over(Window.orderBy(_SLICE)).alias(_SLICE), value
    ).where(F.col(_SLICE).isNotNull())
    rows = numbered.unionByName(
        carried.withColumn("_at", F.lit(0)), allowMissingColumns=True
    )
    return (
        rows.withColumn(name, F.lag(value).over(Window.partitionBy(_SLICE).orderBy("_at")))
        .where(F.col("_at") > 0)
        .drop("_at", _SLICE)
    )


def order_breaks(df: DataFrame, order: Sequence[tuple[str, bool, bool]]) -> int:
    """Rows of ``df`` that come before the row in front of them in ``order``; 0 says that it is sorted.

    ``order`` lists (column, ascending, NULLs first). The rows are written as they come, so
    that the order checked is that of a file or an export. Neighbours are compared inside
    each slice, and across the borders of slices by their first and last rows, so no task
    sees more than a slice.
    """
    keys = [c for c, _, _ in order]
    placed = df.select(*keys).withColumns({_SLICE: F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = stage(placed, "order")
    row = F.struct(*keys)
    inside = Window.partitionBy(_SLICE).orderBy("_at")
    neighbours = placed.select(row.alias("b"), F.lag(row).over(inside).alias("a")).where("a is not null")
    borders = placed.groupBy(_SLICE).agg(F.min_by(row, "_at").alias("b"), F.max_by(row, "_at").alias("last"))
    borders = borders.select("b", F.lag("last").over(Window.orderBy(_SLICE)).alias("a")).where("a is not null")
    worse = F.lit(False)
    for c, ascending, nulls_first in reversed(list(order)):
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        wrong = (a > b) if ascending else (a < b)
        misplaced = (b.isNull() & a.isNotNull()) if nulls_first else (a.isNull() & b.isNotNull())
        worse = F.when(a.eqNullSafe(b), worse).otherwise(misplaced | F.coalesce(wrong, F.lit(False)))
    both = neighbours.select("a", "b").unionByName(borders.select("a", "b"))
    return both.where(worse).count()
