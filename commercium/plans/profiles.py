"""Data checks: missing values per column and a summary of the order fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercium.functions import count_if


def null_profile(df: DataFrame) -> DataFrame:
    """Type, missing count and row count of every column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return counts.unpivot("_rows", df.columns, "column_name", "missing_values").select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        "missing_values",
        F.col("_rows").alias("total_rows"),
    )


_COUNTED = ("sku", "region", "channel", "customer_tier", "quarter")


def fact_profile(orders: DataFrame) -> DataFrame:
    """Rows, date and index range and distinct counts of a fact joined to its index.

    Each row becomes one narrow (number of the key, value) pair for every counted key; the
    pairs are grouped once, which leaves one row a distinct value, and the groups are
    counted. The first key's groups also hold the rows and the ranges.
    """
    ranged = ("order_date", "ppi_index")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in enumerate(_COUNTED)]))
    groups = (
        orders.select(*ranged, pairs.alias("pair"))
        .groupBy("pair.key", "pair.value")
        .agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in ranged for f in (F.min, F.max)])
    )
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("key") == 0, F.col("rows"))), F.lit(0)).alias("observations"),
        F.min("min_order_date").alias("first_order"),
        F.max("max_order_date").alias("last_order"),
        F.min("min_ppi_index").alias("index_min"),
        F.max("max_ppi_index").alias("index_max"),
        *[
            count_if((F.col("key") == k) & F.col("value").isNotNull()).alias(f"{c}s")
            for k, c in enumerate(_COUNTED)
        ],
    )
