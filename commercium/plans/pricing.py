"""Pricing views: realisation, discount governance, cost index and concentration.

The SQL reports sort NULL as the largest value; orders and ranks here say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercium.functions import clip, exact_mean, exact_sum, month_start, quarter_label, quarter_start, ratio, round_half_up
from commercium.operators.ordered import quantiles, running_totals, top_ranked, value_ranks
from commercium.sources.cleaning import derive_discount, derive_revenue
from commercium.sources.staging import stage

def _quarter() -> Column:
    return quarter_start(F.col("order_date")).alias("quarter")


def price_realization(orders: DataFrame) -> DataFrame:
    """Selling price, list price, discount and volume per commercial segment and quarter."""
    return orders.groupBy("business_unit", "region", "channel", "customer_tier", _quarter()).agg(
        ratio(exact_sum("revenue"), F.sum("quantity")).alias("avg_sell_price"),
        exact_mean("list_price").alias("avg_list_price"),
        exact_mean("discount_pct").alias("avg_discount_pct"),
        exact_sum("revenue").alias("total_revenue"),
        F.sum("quantity").alias("total_units"),
    )


def price_realization_preview(orders: DataFrame, rows: int = 50) -> DataFrame:
    """First rows of the realisation view by quarter and business unit."""
    view = price_realization(orders)
    keys = ["quarter", "business_unit", "region", "channel", "customer_tier"]
    return view.orderBy(*[F.asc_nulls_last(k) for k in keys]).limit(rows)


def discount_matrix(orders: DataFrame) -> DataFrame:
    """Mean and spread of the discount per channel, tier and region.

    ``discount_variance`` is a sample standard deviation; the name is the report's.
    """
    return (
        orders.groupBy("channel", "customer_tier", "region")
        .agg(
            round_half_up(exact_mean("discount_pct"), 2).alias("avg_discount_pct"),
            round_half_up(F.stddev_samp("discount_pct"), 2).alias("discount_variance"),
            F.count(F.lit(1)).alias("order_count"),
        )
        .orderBy(F.desc_nulls_first("avg_discount_pct"))
    )


def quarterly_index(index: DataFrame) -> DataFrame:
    """Quarterly mean of the monthly index, with its log and period label."""
    quarter = quarter_start(F.col("observation_date"))
    return (
        index.groupBy(quarter.alias("quarter"))
        .agg(exact_mean("ppi_index").alias("ppi_index"))
        .withColumns(
            {"quarter_label": quarter_label(F.col("quarter")), "log_ppi": F.ln("ppi_index")}
        )
    )


def monthly_index(index: DataFrame) -> DataFrame:
    """Last published value of every month; rows without a date or value are not published."""
    published = index.where(F.col("observation_date").isNotNull() & F.col("ppi_index").isNotNull())
    return published.groupBy(month_start(F.col("observation_date")).alias("month")).agg(
        F.max_by("ppi_index", "observation_date").alias("ppi_index")
    )


def price_vs_index(orders: DataFrame, index: DataFrame) -> DataFrame:
    """Average list price against the input-cost index per business unit and quarter.

    Orders are reduced to one row per unit and quarter before they meet the index.
    """
    prices = orders.groupBy("business_unit", _quarter()).agg(exact_mean("list_price").alias("avg_list_price"))
    levels = quarterly_index(index).select("quarter", "ppi_index")
    return (
        prices.join(levels, "quarter")
        .select(
            "business_unit",
            "quarter",
            round_half_up(F.col("avg_list_price"), 2).alias("avg_list_price"),
            round_half_up(F.col("ppi_index"), 2).alias("ppi_index"),
        )
        .orderBy(F.asc_nulls_last("business_unit"), F.asc_nulls_last("quarter"))
    )


def orders_with_monthly_index(orders: DataFrame, index: DataFrame) -> DataFrame:
    """Orders with the index of their month and log price, quantity and index.

    The index has one row per calendar month, under 120 000 for all dates SQL
    can express, so it is broadcast.  Orders of a month without an index go.
    """
    levels = F.broadcast(monthly_index(index).where(F.col("ppi_index").isNotNull()))
    dated = orders.withColumn("month", month_start(F.col("order_date")))
    return dated.join(levels, "month").withColumns(
        {
            "quarter": quarter_label(F.col("order_date")),
            "log_quantity": F.ln("quantity"),
            "log_net_price": F.ln("net_price"),
            "log_ppi": F.ln("ppi_index"),
        }
    )


def orders_with_quarterly_index(orders: DataFrame, index: DataFrame) -> DataFrame:
    """Orders with the mean index of their quarter; same bound, a quarter per row."""
    levels = F.broadcast(
        quarterly_index(index)
        .where(F.col("log_ppi").isNotNull())
        .select(F.col("quarter_label").alias("quarter"), F.col("ppi_index").alias("ppi"), "log_ppi")
    )
    dated = orders.withColumn("quarter", quarter_label(F.col("order_date")))
    return dated.join(levels, "quarter").withColumns(
        {"log_quantity": F.ln("quantity"), "log_net_price": F.ln("net_price")}
    )


def index_match_rate(orders: DataFrame, index: DataFrame) -> DataFrame:
    """How many orders find an index value for their month."""
    levels = F.broadcast(monthly_index(index).where(F.col("ppi_index").isNotNull()))
    dated = orders.select(month_start(F.col("order_date")).alias("month"))
    per_month = dated.groupBy("month").agg(F.count(F.lit(1)).alias("orders"))
    matched = F.col("ppi_index").isNotNull()
    return per_month.join(levels, "month", "left").agg(
        F.sum("orders").alias("orders"),
        F.coalesce(F.sum(F.when(matched, F.col("orders"))), F.lit(0)).alias("matched_orders"),
    )


def discount_creep(orders: DataFrame, changed_only: bool = False) -> DataFrame:
    """Quarterly discount per region against four quarters of rows earlier.

    The lag counts rows, so a region with a missing quarter compares unlike quarters.
    """
    quarterly = orders.groupBy("region", _quarter()).agg(exact_mean("discount_pct").alias("avg_discount"))
    earlier = F.lag("avg_discount", 4).over(Window.partitionBy("region").orderBy(F.asc_nulls_last("quarter")))
    view = quarterly.withColumn("yoy_discount_change", F.col("avg_discount") - earlier)
    if changed_only:
        view = view.where(F.col("yoy_discount_change").isNotNull())
    return view.orderBy(F.asc_nulls_last("region"), F.asc_nulls_last("quarter"))


def _sku_discounts(orders: DataFrame) -> DataFrame:
    """Average discount per region and SKU, staged because its ranks need stable values."""
    return stage(
        orders.groupBy("region", "sku", "business_unit").agg(
            # Ten decimals: summation order must not split equal averages into ranks.
            F.round(exact_mean("discount_pct"), 10).alias("avg_discount_pct"),
            F.count(F.lit(1)).alias("order_count"),
        ),
        "sku-discounts",
    )


def discount_offenders(orders: DataFrame) -> DataFrame:
    """SKUs ranked by average discount inside their region."""
    return value_ranks(
        _sku_discounts(orders),
        "avg_discount_pct",
        ["region"],
        rank="discount_rank_in_region",
        nulls_first=True,
    )


def top_discount_offenders(orders: DataFrame, worst: int = 5) -> DataFrame:
    """The worst discount ranks of every region, ties included."""
    ranked = top_ranked(
        _sku_discounts(orders), "avg_discount_pct", worst, ["region"], "discount_rank_in_region"
    )
    return ranked.orderBy("region", "discount_rank_in_region", "sku")


def asp_moving_average(orders: DataFrame) -> DataFrame:
    """Two-quarter moving average of the selling price per business unit."""
    quarterly = orders.groupBy("business_unit", _quarter()).agg(
        ratio(exact_sum("revenue"), F.sum("quantity")).alias("avg_sell_price")
    )
    recent = Window.partitionBy("business_unit").orderBy(F.asc_nulls_last("quarter")).rowsBetween(-1, 0)
    return quarterly.withColumn("asp_2q_moving_avg", F.avg("avg_sell_price").over(recent))


def sku_pareto(orders: DataFrame) -> DataFrame:
    """Revenue rank and cumulative revenue share of every SKU, ties ordered by SKU."""
    revenue = stage(
        orders.groupBy("sku", "business_unit").agg(
            F.round(exact_sum("revenue"), 6).alias("total_revenue")
        ),
        "sku-revenue",
    )
    ranked = value_ranks(revenue, "total_revenue", rank="revenue_rank", nulls_first=True)
    order = [F.col("total_revenue").desc_nulls_first(), F.col("sku").asc(), F.col("business_unit").asc()]
    running = running_totals(ranked, order, ["total_revenue"])
    share = ratio(
        F.lit(100.0) * (F.col("total_revenue_before") + F.col("total_revenue")),
        F.col("total_revenue_total"),
    )
    return running.select(
        "sku",
        "business_unit",
        "total_revenue",
        "revenue_rank",
        round_half_up(share, 1).alias("cumulative_revenue_pct"),
    )


def pricing_baseline(orders: DataFrame) -> DataFrame:
    """Order count, volume, revenue, weighted price and SKU count in one row."""
    valued = derive_revenue(orders)
    return valued.agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("quantity").alias("quantity"),
        exact_sum("revenue").alias("revenue"),
        ratio(exact_sum("revenue"), F.sum("quantity")).alias("weighted_avg_price"),
        F.countDistinct("sku").alias("skus"),
    )


def discount_profile(orders: DataFrame) -> DataFrame:
    """Mean, exact median and maximum of the realised discount per business unit.

    A NULL business unit is a group of its own.
    """
    priced = derive_discount(derive_revenue(orders)).where(
        F.col("calculated_discount_pct").isNotNull()
    )
    totals = priced.groupBy("business_unit").agg(
        F.count(F.lit(1)).alias("orders"),
        exact_sum("revenue").alias("revenue"),
        exact_mean("calculated_discount_pct").alias("avg_discount_pct"),
        F.max("calculated_discount_pct").alias("max_discount_pct"),
    )
    medians = quantiles(
        priced, "calculated_discount_pct", {"median_discount_pct": 0.5}, ["business_unit"]
    ).withColumnRenamed("business_unit", "_unit")
    return totals.join(
        medians, totals.business_unit.eqNullSafe(medians["_unit"]), "left"
    ).select(
        "business_unit",
        "orders",
        "revenue",
        "avg_discount_pct",
        "median_discount_pct",
        "max_discount_pct",
    )


def top_half_sku_orders(orders: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Orders of the best-selling fraction of SKUs, at least one SKU.

    SKUs are ordered by the plain sum of net price (no quantity), ties by SKU.
    """
    sums = stage(
        orders.where(F.col("sku").isNotNull())
        .groupBy("sku")
        .agg(F.round(exact_sum("net_price"), 6).alias("price_sum")),
        "sku-prices",
    )
    order = [F.col("price_sum").desc(), F.col("sku").asc()]
    placed = running_totals(sums.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    keep = F.greatest(F.lit(1), F.floor(F.col("_one_total") * F.lit(fraction)))
    best = placed.where(F.col("_one_before") < keep).select("sku")
    return orders.join(best, "sku", "left_semi")


def trimmed_orders(orders: DataFrame, lower: float = 0.05) -> DataFrame:
    """Orders above the given quantile of quantity (exclusive).

    The cut is one number, read once: models pass over the result repeatedly.
    """
    cut = quantiles(orders, "quantity", {"cut": lower}).first()["cut"]
    return orders.where(F.col("quantity") > F.lit(cut))


def discount_capped_orders(orders: DataFrame, cap_pct: float = 30.0) -> DataFrame:
    """Orders whose realised discount does not exceed the cap."""
    discount = (1 - ratio(F.col("net_price"), F.col("list_price"))) * 100
    return orders.withColumn("calculated_discount", discount).where(
        F.col("calculated_discount") <= cap_pct
    )


def winsorised(df: DataFrame, columns: list[str], tail: float = 0.01) -> DataFrame:
    """Clamp each column to its own lower and upper tail quantile, read once."""
    clamped = {}
    for c in columns:
        low, high = quantiles(df, c, {"low": tail, "high": 1 - tail}).first()
        if low is not None:
            clamped[c] = clip(F.col(c), low, high)
    return df.withColumns(clamped)
