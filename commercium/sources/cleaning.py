"""Row cleaning: coercing casts, validity filters, default categories, derived money."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from commercium.functions import count_if, ratio

UNKNOWN = "Unknown"


#: Ways to write a date besides ISO that can be read in one way only.
DATE_FORMATS = ("yyyy/M/d", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")
MONTH_FIRST, DAY_FIRST = "M/d/yyyy", "d/M/yyyy"


def _date_text(df: DataFrame, column: str, wanted: str) -> bool:
    return wanted in ("date", "timestamp") and df.schema[column].dataType.simpleString() == "string"


def _reads(column: str, written: str) -> Column:
    return F.try_to_timestamp(F.trim(column), F.lit(written))


def month_first(df: DataFrame, column: str) -> Column:
    """Whether the dates with slashes of a whole text column are read month first, as one value from one pass.

    The reading under which more of them are dates holds for all of them, so that one
    cell such as 13/04/2024 beside 03/04/2024 decides for both; month first if both
    readings do equally well.
    """
    votes = df.agg((count_if(_reads(column, MONTH_FIRST).isNotNull()) >= count_if(_reads(column, DAY_FIRST).isNotNull())).alias("vote"))
    return votes.scalar()


def _coerced(df: DataFrame, column: str, wanted: str) -> Column:
    if not _date_text(df, column, wanted):
        return F.col(column).try_cast(wanted)
    slashes = F.when(month_first(df, column), _reads(column, MONTH_FIRST)).otherwise(_reads(column, DAY_FIRST))
    others = [x.cast(wanted) for x in (slashes, *[_reads(column, f) for f in DATE_FORMATS])]
    return F.coalesce(F.trim(column).try_cast(wanted), *others)


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; text that does not parse becomes NULL.

    Dates may be written in ISO or one of ``DATE_FORMATS``. Those with slashes are read
    in one order of day and month for the whole column (``month_first``); cells that do not
    fit it become NULL and count as removed.
    """
    return df.withColumns({c: _coerced(df, c, t) for c, t in types.items() if c in df.columns})


def _usable(required: Sequence[str], positive: Sequence[str]):
    condition = F.lit(True)
    for c in required:
        condition = condition & F.col(c).isNotNull()
    for c in positive:
        condition = condition & (F.col(c) > 0)
    return condition


def keep_usable(
    df: DataFrame,
    required: Sequence[str],
    positive: Sequence[str] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """Drop rows with a NULL in ``required`` or a non-positive ``positive`` column.

    With an ``observation`` the rows read and removed are counted in the same
    pass, readable after the first action.
    """
    usable = _usable(required, positive)
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows_read"),
            count_if(~F.coalesce(usable, F.lit(False))).alias("rows_removed"),
        )
    # Without a coalesce around it the condition reaches the file scan.
    return df.where(usable)


def removal_counts(
    df: DataFrame, required: Sequence[str], positive: Sequence[str] = ()
) -> DataFrame:
    """One row: rows read, kept and removed by ``keep_usable``."""
    usable = _usable(required, positive)
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        count_if(usable).alias("rows_kept"),
        count_if(~F.coalesce(usable, F.lit(False))).alias("rows_removed"),
    )


def default_category(df: DataFrame, columns: Sequence[str], default: str = UNKNOWN) -> DataFrame:
    """Fill missing or NULL categories."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in df.columns else F.lit(default)
            for c in columns
        }
    )


def derive_revenue(df: DataFrame) -> DataFrame:
    """Revenue = quantity x net price, replacing any stored revenue."""
    return df.withColumn("revenue", F.col("quantity") * F.col("net_price"))


def derive_discount(df: DataFrame) -> DataFrame:
    """Discount from the price pair, else the stored percentage, else NULL."""
    if "list_price" in df.columns:
        list_price = F.when(F.col("list_price") > 0, F.col("list_price"))
        discount = (1 - ratio(F.col("net_price"), list_price)) * 100
        return df.withColumns({"list_price": list_price, "calculated_discount_pct": discount})
    if "discount_pct" in df.columns:
        return df.withColumn("calculated_discount_pct", F.col("discount_pct").cast("double"))
    return df.withColumn("calculated_discount_pct", F.lit(None).cast("double"))


ORDER_TYPES = {
    "order_date": "date",
    "quantity": "double",
    "net_price": "double",
    "list_price": "double",
    "discount_pct": "double",
}


def clean_orders(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Typed, usable order rows with default categories."""
    typed = coerce_types(df, ORDER_TYPES)
    kept = keep_usable(
        typed,
        required=["order_date", "sku", "quantity", "net_price"],
        positive=["quantity", "net_price"],
        observation=observation,
    )
    return default_category(kept, ["region", "channel", "customer_tier"])
