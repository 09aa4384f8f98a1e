"""Initiative health scoring and the lifecycle views built on the scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercium.functions import clip, count_if, exact_mean, exact_sum, ratio, round_half_even, round_half_up
from commercium.operators.ordered import number_copies, number_rows, value_ranks
from commercium.sources.staging import stage

# Health weights, band thresholds and component scales.
HEALTH_WEIGHTS = {
    "revenue_attainment": 0.35,
    "otd_attainment": 0.20,
    "backlog_score": 0.15,
    "adoption_score": 0.10,
    "margin_score": 0.10,
    "budget_score": 0.10,
}
GREEN_FROM, AMBER_FROM = 0.90, 0.75
REVENUE_CAP, OTD_CAP = 1.25, 1.10
BACKLOG_LIMIT_DAYS, FULL_MARGIN_PCT, BUDGET_TOLERANCE_PCT = 90, 50, 50
ON_TIME_PCT = 95


def _band(score: Column, high: str, middle: str, low: str) -> Column:
    return F.when(score >= GREEN_FROM, high).when(score >= AMBER_FROM, middle).otherwise(low)


def component_scores() -> dict[str, Column]:
    """The six health components as expressions over the initiative columns."""
    budget_gap = F.abs(F.col("budget_utilization_pct") - 100)
    return {
        "revenue_attainment": clip(ratio(F.col("actual_revenue"), F.col("planned_revenue")), 0, REVENUE_CAP),
        "otd_attainment": clip(ratio(F.col("actual_otd_pct"), F.col("planned_otd_pct")), 0, OTD_CAP),
        "backlog_score": clip(1 - F.col("backlog_days") / BACKLOG_LIMIT_DAYS, 0, 1),
        "adoption_score": clip(F.col("customer_adoption_pct") / 100, 0, 1),
        "margin_score": clip(F.col("gross_margin_pct") / FULL_MARGIN_PCT, 0, 1),
        "budget_score": clip(1 - budget_gap / BUDGET_TOLERANCE_PCT, 0, 1),
    }


def health_measures(initiatives: DataFrame) -> DataFrame:
    """Unrounded components, health, execution score, variances and bands."""
    scored = initiatives.withColumns(component_scores())
    health = None
    for component, weight in HEALTH_WEIGHTS.items():
        term = F.col(component) * weight
        health = term if health is None else health + term
    planned, actual = F.col("planned_revenue"), F.col("actual_revenue")
    return scored.withColumns(
        {
            "aos_health": health,
            "execution_score": F.col("otd_attainment") * 0.5 + F.col("backlog_score") * 0.5,
            "revenue_variance_pct": ratio(actual - planned, planned) * 100,
            "otd_variance_pct": F.col("actual_otd_pct") - F.col("planned_otd_pct"),
        }
    ).withColumns(
        {
            "status": _band(F.col("aos_health"), "Green", "Amber", "Red"),
            "risk_category": _band(F.col("aos_health"), "Low", "Medium", "High"),
        }
    )


_ROUNDED = [*HEALTH_WEIGHTS, "execution_score", "aos_health"]


def _persisted(measured: DataFrame) -> DataFrame:
    """Scores as the scored table stores them: three decimals, half to even."""
    return measured.withColumns({c: round_half_even(F.col(c), 3) for c in _ROUNDED})


def scored_initiatives(initiatives: DataFrame) -> DataFrame:
    """Scored table without the quarterly rank; every view below reads these rounded scores."""
    return _persisted(health_measures(initiatives))


def initiative_scores(initiatives: DataFrame) -> DataFrame:
    """Full scored table, with the dense rank of the unrounded health in its quarter."""
    # The measures are expressions of a row, so only what they are made of is written and shuffled.
    plain = stage(initiatives, "initiatives")
    measured = health_measures(plain)
    keyed = measured.select(*plain.columns, F.col("aos_health").alias("_health"))
    ranked = value_ranks(keyed, "_health", ["quarter"], dense_rank="priority_rank")
    return _persisted(health_measures(ranked).select(*measured.columns, "priority_rank"))


def quick_risk_level(initiatives: DataFrame) -> DataFrame:
    """Coarse risk level from unclipped attainment, delivery and backlog."""
    # Weights, delivery target and backlog limit of the quick rule.
    score = (
        ratio(F.col("actual_revenue"), F.col("planned_revenue")) * 0.5
        + F.col("actual_otd_pct") / 95 * 0.3
        + (1 - F.least(F.col("backlog_days"), F.lit(90)) / 90) * 0.2
    )
    return initiatives.withColumn("risk_level", _band(score, "Low", "Medium", "High"))


def revenue_attainment(scored: DataFrame) -> DataFrame:
    """Revenue variance and unclipped attainment of every observation."""
    planned, actual = F.col("planned_revenue"), F.col("actual_revenue")
    return scored.select(
        "initiative_id",
        "initiative_name",
        "business_unit",
        "region",
        "quarter",
        "planned_revenue",
        "actual_revenue",
        round_half_up(actual - planned, 2).alias("revenue_variance"),
        round_half_up(ratio(actual, planned) * 100, 2).alias("revenue_attainment_pct"),
        "status",
        "risk_category",
    )


def _mean(column: str, digits: int = 2) -> Column:
    return round_half_up(exact_mean(column), digits)


def _attainment_pct() -> Column:
    return round_half_up(exact_mean("revenue_attainment") * 100, 2)


def _status_counts(green: str, amber: str, red: str) -> list[Column]:
    return [
        count_if(F.col("status") == band).alias(name)
        for band, name in (("Green", green), ("Amber", amber), ("Red", red))
    ]


def _initiatives() -> Column:
    return F.countDistinct("initiative_id").alias("initiatives")


def _revenue() -> Column:
    return round_half_up(exact_sum("actual_revenue"), 2).alias("total_revenue")


def aos_summary(scored: DataFrame) -> DataFrame:
    """Health summary per business unit and region."""
    return (
        scored.groupBy("business_unit", "region")
        .agg(
            _initiatives(),
            F.count(F.lit(1)).alias("observations"),
            _mean("aos_health", 3).alias("avg_aos"),
            _attainment_pct().alias("revenue_attainment_pct"),
            _mean("actual_otd_pct").alias("avg_otd_pct"),
            _mean("backlog_days").alias("avg_backlog_days"),
            _revenue(),
            *_status_counts("green_count", "amber_count", "red_count"),
        )
        .orderBy(F.desc_nulls_first("avg_aos"))
    )


def otd_analysis(scored: DataFrame) -> DataFrame:
    """On-time delivery per business unit, region and quarter."""
    return (
        scored.groupBy("business_unit", "region", "quarter")
        .agg(
            _mean("planned_otd_pct").alias("planned_otd"),
            _mean("actual_otd_pct").alias("actual_otd"),
            round_half_up(exact_mean(F.col("actual_otd_pct") - F.col("planned_otd_pct")), 2).alias("otd_variance"),
            _mean("backlog_days").alias("avg_backlog"),
            count_if(F.col("actual_otd_pct") >= ON_TIME_PCT).alias("on_time_initiatives"),
            F.count(F.lit(1)).alias("total_records"),
        )
        .orderBy(F.asc_nulls_last("quarter"), F.asc_nulls_last("business_unit"))
    )


_BACKLOG_COLUMNS = [
    "initiative_id",
    "initiative_name",
    "business_unit",
    "region",
    "quarter",
    "backlog_days",
    "status",
    "risk_category",
]


def backlog_analysis(scored: DataFrame) -> DataFrame:
    """Observations numbered by backlog inside their region.

    Backlogs are whole days and tie heavily, so the remaining columns decide;
    rows equal in all of them are interchangeable.
    """
    rows = scored.select(*_BACKLOG_COLUMNS)
    rest = [c for c in _BACKLOG_COLUMNS if c not in ("region", "backlog_days")]
    order = [F.col("backlog_days").desc_nulls_first(), *[F.col(c).asc() for c in rest]]
    ranked = number_copies(rows, order, "backlog_rank", ["region"])
    return ranked.orderBy(F.desc_nulls_first("backlog_days"), F.asc_nulls_last("region"), "backlog_rank")


def lifecycle_analysis(scored: DataFrame) -> DataFrame:
    """Portfolio measures per lifecycle stage and business unit."""
    return (
        scored.groupBy("lifecycle_stage", "business_unit")
        .agg(
            _initiatives(),
            _mean("aos_health", 3).alias("avg_aos"),
            _attainment_pct().alias("revenue_attainment_pct"),
            _mean("actual_otd_pct").alias("avg_otd"),
            _mean("backlog_days").alias("avg_backlog"),
            _mean("customer_adoption_pct").alias("avg_adoption"),
            _mean("gross_margin_pct").alias("avg_margin"),
            _revenue(),
        )
        .orderBy(F.desc_nulls_first("avg_aos"))
    )


def executive_kpis(scored: DataFrame) -> DataFrame:
    """Portfolio headline figures in one row."""
    return scored.agg(
        F.countDistinct("initiative_id").alias("total_initiatives"),
        F.count(F.lit(1)).alias("observations"),
        _mean("aos_health", 3).alias("avg_aos"),
        _mean("actual_otd_pct").alias("avg_otd"),
        _mean("backlog_days").alias("avg_backlog"),
        _revenue(),
        *_status_counts("green", "amber", "red"),
    )


def region_dashboard(scored: DataFrame) -> DataFrame:
    return (
        scored.groupBy("region")
        .agg(
            _initiatives(),
            _mean("aos_health", 3).alias("avg_aos"),
            _mean("actual_otd_pct").alias("avg_otd"),
            _mean("backlog_days").alias("avg_backlog"),
            _revenue(),
        )
        .orderBy(F.desc_nulls_first("avg_aos"))
    )


def owner_dashboard(scored: DataFrame) -> DataFrame:
    return (
        scored.groupBy("owner")
        .agg(
            _initiatives(),
            _mean("aos_health", 3).alias("avg_aos"),
            _mean("actual_otd_pct").alias("avg_otd"),
            _revenue(),
        )
        .orderBy(F.desc_nulls_first("avg_aos"))
    )


def plcm_summary(scored: DataFrame) -> DataFrame:
    """Portfolio summary with unrounded means, only the health rounded; NULL keys drop."""
    keyed = scored.where(F.col("business_unit").isNotNull() & F.col("region").isNotNull())
    return keyed.groupBy("business_unit", "region").agg(
        _initiatives(),
        F.count("initiative_id").alias("observations"),
        round_half_even(exact_mean("aos_health"), 3).alias("avg_aos"),
        exact_mean("revenue_attainment").alias("avg_revenue_attainment"),
        exact_mean("actual_otd_pct").alias("avg_otd"),
        exact_mean("backlog_days").alias("avg_backlog"),
        exact_sum("actual_revenue").alias("total_revenue"),
    )


def initiative_ranking(scored: DataFrame) -> DataFrame:
    """Initiatives numbered by average health, ties by their key columns."""
    keys = ["initiative_id", "initiative_name", "business_unit"]
    keyed = scored.where(
        F.col("initiative_id").isNotNull()
        & F.col("initiative_name").isNotNull()
        & F.col("business_unit").isNotNull()
    )
    averages = stage(
        keyed.groupBy(*keys).agg(
            F.round(exact_mean("aos_health"), 10).alias("avg_aos"),
            exact_sum("actual_revenue").alias("total_revenue"),
            exact_mean("actual_otd_pct").alias("avg_otd"),
            exact_mean("backlog_days").alias("avg_backlog"),
        ),
        "initiative-averages",
    )
    order = [F.col("avg_aos").desc(), *[F.col(k).asc() for k in keys]]
    return number_rows(averages, order, "rank").orderBy("rank")
