"""Price elasticity: headline models, robustness specifications and their summaries.

The prepared fact is staged once, narrow and clustered by SKU.  Every fit reads
the columns it needs from it, and its sums per SKU are nearly complete before
they shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commercium.functions import count_if
from commercium.operators.absorption import absorbed_ols
from commercium.operators.ordered import previous_in_order
from commercium.operators.regression import (
    Fit,
    Model,
    category_levels,
    column_means,
    fit_models,
    max_leverage,
    residuals,
)
from commercium.plans.pricing import (
    discount_capped_orders,
    orders_with_monthly_index,
    orders_with_quarterly_index,
    top_half_sku_orders,
    trimmed_orders,
    winsorised,
)
from commercium.sources.cleaning import clean_orders, keep_usable
from commercium.sources.staging import STRETCH, stage, stage_levels

PRICE, VOLUME, COST = "log_net_price", "log_quantity", "log_ppi"
COMMERCIAL = ("region", "channel", "customer_tier")
TIMED = ("quarter", *COMMERCIAL)

# Names of the specifications and the order of preference among them.
MODEL_A, MODEL_B = "A: SKU + Quarter FE", "B: SKU + PPI"
PREFERRED_MODELS = ["SKU + time + commercial controls", "SKU + quarter fixed effects"]
MEDIAN_MODEL = "Median robustness elasticity"
SIGNIFICANCE = 0.05

RESULT_SCHEMA = (
    "model string, observations bigint, elasticity double, std_error double, p_value double, "
    "ci_low double, ci_high double, r_squared double, adj_r_squared double, "
    "significant_5pct boolean, direction string"
)


def _same(data: DataFrame) -> DataFrame:
    return data


def _list_price_as_price(data: DataFrame) -> DataFrame:
    return data.where(F.col("list_price") > 0).withColumn(PRICE, F.ln("list_price"))


def _with_logs(rows: DataFrame) -> DataFrame:
    return rows.withColumns({VOLUME: F.ln("quantity"), PRICE: F.ln("net_price")})


def _higher_revenue(data: DataFrame) -> DataFrame:
    """Rows of the best-selling SKUs, staged again where they carry places: the join that picks them may shuffle."""
    if STRETCH not in data.columns:
        return top_half_sku_orders(data)
    best = top_half_sku_orders(data.select("sku", *TIMED, "quantity", "net_price"))
    return _with_logs(stage_levels(best, "elasticity-best", "sku", spread=False))


@dataclass(frozen=True)
class Specification:
    """One robustness model: sample preparation and regressors."""

    name: str
    prepare: Callable[[DataFrame], DataFrame] = _same
    model: Model = Model((PRICE,), TIMED)
    needs: tuple[str, ...] = ()


SPECIFICATIONS = [
    Specification("1. Baseline pooled OLS", model=Model((PRICE,), absorb=False)),
    Specification("2. SKU fixed effects", model=Model((PRICE,))),
    Specification("3. SKU + quarter fixed effects", model=Model((PRICE,), ("quarter",))),
    Specification("4. SKU + time + commercial controls"),
    Specification("5. SKU + PPI + commercial controls", model=Model((PRICE, COST), COMMERCIAL)),
    Specification("6. Winsorised price and quantity", lambda d: winsorised(d, [PRICE, VOLUME])),
    Specification("7. Excluding discounts above 30%", discount_capped_orders, needs=("list_price",)),
    Specification("8. List-price sensitivity", _list_price_as_price, needs=("list_price",)),
    Specification("9. Higher-revenue SKUs", _higher_revenue),
    Specification("10. Excluding bottom 5% quantity observations", trimmed_orders),
]


def quarterly_rows(orders: DataFrame, index: DataFrame) -> DataFrame:
    """Clean orders with logs, quarter label and the quarterly index, for a single reader."""
    joined = orders_with_quarterly_index(clean_orders(orders), index)
    optional = [c for c in ("list_price",) if c in joined.columns]
    return joined.select("sku", *TIMED, "quantity", "net_price", *optional, VOLUME, PRICE, COST)


def prepared_quarterly(orders: DataFrame, index: DataFrame) -> DataFrame:
    """``quarterly_rows``, staged by SKU; logs of staged columns are not staged."""
    rows = quarterly_rows(orders, index).drop(VOLUME, PRICE)
    return _with_logs(stage_levels(rows, "elasticity-quarterly", "sku"))


def prepared_monthly(orders: DataFrame, index: DataFrame) -> DataFrame:
    """Complete orders with the last index value of their month, staged."""
    complete = keep_usable(
        orders,
        required=["order_date", "business_unit", "sku", *COMMERCIAL, "net_price", "quantity"],
        positive=["net_price", "quantity"],
    )
    joined = orders_with_monthly_index(complete, index)
    return stage(
        joined.select("order_date", "order_id", "sku", *TIMED, "ppi_index", VOLUME, PRICE, COST),
        "elasticity-monthly",
        cluster_by="sku",
    )


def _direction(coefficient: float) -> str | None:
    if math.isnan(coefficient):
        return None
    return "negative" if coefficient < 0 else "positive"


def result_row(name: str, fit: Fit) -> tuple:
    """Price coefficient of a fit as one row of the results table."""
    price = fit.term(PRICE)
    return (
        name,
        fit.observations,
        price["coefficient"],
        price["std_error"],
        price["p_value"],
        price["ci_low"],
        price["ci_high"],
        fit.r_squared,
        fit.adj_r_squared,
        price["p_value"] < SIGNIFICANCE,
        _direction(price["coefficient"]),
    )


def _results(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def robustness_results(
    data: DataFrame,
    specifications: Sequence[Specification] = SPECIFICATIONS,
    concurrent_fits: int = 4,
) -> DataFrame:
    """Fit every specification on the prepared quarterly data; one row each.

    Specifications of the same sample share their passes; one that needs a
    column the data lacks is left out.  The samples are independent, so a few
    are fitted at a time and share the cluster.
    """
    specifications = [s for s in specifications if set(s.needs) <= set(data.columns)]
    used = {c for spec in specifications for c in spec.model.categoricals}
    levels = category_levels(data, [c for c in TIMED if c in used])
    centres = column_means(data, [PRICE, VOLUME, COST])
    samples: dict[Callable, list[Specification]] = {}
    for spec in specifications:
        samples.setdefault(spec.prepare, []).append(spec)

    def fit(prepare: Callable[[DataFrame], DataFrame]) -> dict[str, Fit]:
        models = {spec.name: spec.model for spec in samples[prepare]}
        return fit_models(prepare(data), VOLUME, models, "sku", levels, centres)

    with ThreadPoolExecutor(max_workers=concurrent_fits) as pool:
        groups = pool.map(inheritable_thread_target(data.sparkSession)(fit), samples)
        fits = {name: f for group in groups for name, f in group.items()}
    return _results(data.sparkSession, [result_row(s.name, fits[s.name]) for s in specifications])


def specification_result(data: DataFrame, name: str) -> DataFrame:
    """A single specification by name."""
    return robustness_results(data, [s for s in SPECIFICATIONS if s.name == name])


def absorbed_result(data: DataFrame, name: str, effects: Sequence[str]) -> DataFrame:
    """Price elasticity with the levels of several effects absorbed, none of them as dummies.

    For effects of any number of levels, the one with most of them first; equals the
    specification with their dummies. ``data`` is read once and need not be staged.
    """
    return _results(data.sparkSession, [result_row(name, absorbed_ols(data, VOLUME, [PRICE], effects, "sku"))])


# Model A has price with SKU, quarter and commercial effects; model B trades the
# quarter for the cost index.
HEADLINE_MODELS = {MODEL_A: Model((PRICE,), TIMED), MODEL_B: Model((PRICE, COST), COMMERCIAL)}


def headline_fits(data: DataFrame, names: Sequence[str] = (MODEL_A, MODEL_B)) -> dict[str, Fit]:
    """Headline models on the prepared monthly data, in shared passes."""
    return fit_models(data, VOLUME, {n: HEADLINE_MODELS[n] for n in names})


def model_terms(spark: SparkSession, name: str, fit: Fit) -> DataFrame:
    """Coefficient table of the continuous terms of a model."""
    rows = []
    for term in fit.model.x:
        t = fit.term(term)
        rows.append(
            (
                name,
                term,
                t["coefficient"],
                t["std_error"],
                t["p_value"],
                t["ci_low"],
                t["ci_high"],
                fit.r_squared,
                fit.adj_r_squared,
                fit.observations,
                _direction(t["coefficient"]),
                t["p_value"] < SIGNIFICANCE,
            )
        )
    schema = (
        "model string, term string, coefficient double, std_error double, p_value double, "
        "ci_low double, ci_high double, r_squared double, adj_r_squared double, "
        "observations bigint, direction string, significant_5pct boolean"
    )
    return spark.createDataFrame(rows, schema)


def model_comparison(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """Headline models side by side."""
    rows = [
        (
            name,
            fit.term(PRICE)["coefficient"],
            fit.term(PRICE)["p_value"],
            fit.r_squared,
            fit.adj_r_squared,
            fit.observations,
        )
        for name, fit in fits.items()
    ]
    schema = (
        "model string, price_elasticity double, price_p_value double, r_squared double, "
        "adj_r_squared double, observations bigint"
    )
    return spark.createDataFrame(rows, schema)


def unit_price_impact(comparison: DataFrame, price_change: float = 0.01) -> DataFrame:
    """Expected quantity change in percent for a small price change."""
    return comparison.select(
        "model",
        F.lit(price_change * 100).alias("price_change_pct"),
        (F.col("price_elasticity") * price_change * 100).alias("quantity_change_pct"),
    )


def model_diagnostics(data: DataFrame, fit: Fit) -> DataFrame:
    """Largest leverage, mean absolute residual and residual spread in one row."""
    spread = residuals(data, fit).agg(
        F.avg(F.abs("residual")).alias("mean_abs_residual"),
        F.stddev_pop("residual").alias("residual_std"),
    )
    return spread.withColumn("max_leverage", max_leverage(data, fit).scalar())


def durbin_watson(data: DataFrame, fit: Fit, order: Sequence[str]) -> DataFrame:
    """Serial correlation of the residuals along an explicit row order.

    Equal keys carry equal residuals when ``order`` holds every model column;
    such copies differ by zero, so distinct rows are enough for the numerator.
    """
    with_residuals = residuals(data, fit)
    # The residual is a float sum away from its inputs; ten decimals make copies equal.
    distinct = (
        with_residuals.withColumn("residual", F.round("residual", 10))
        .groupBy(*order)
        .agg(F.max("residual").alias("residual"))
    )
    steps = previous_in_order(distinct, [F.col(c).asc() for c in order], "residual", "_previous")
    jumps = steps.agg(F.sum(F.pow(F.col("residual") - F.col("_previous"), F.lit(2))).alias("jumps"))
    return jumps.select((F.col("jumps") / F.lit(fit.rss)).alias("durbin_watson"))


def model_fit_stats(data: DataFrame, fit: Fit, order: Sequence[str]) -> DataFrame:
    """Likelihood criteria and residual shape of a fitted model in one row."""
    row = (
        fit.observations,
        fit.parameters,
        fit.clusters,
        fit.log_likelihood,
        fit.aic,
        fit.bic,
        fit.skewness,
        fit.kurtosis,
        fit.jarque_bera,
    )
    schema = (
        "observations bigint, parameters bigint, clusters bigint, log_likelihood double, "
        "aic double, bic double, skewness double, kurtosis double, jarque_bera double"
    )
    stats = data.sparkSession.createDataFrame([row], schema)
    return stats.withColumn("durbin_watson", durbin_watson(data, fit, order).scalar())


def elasticity_selection(
    results: DataFrame,
    preferred: Sequence[str] = PREFERRED_MODELS,
    median_fallback: bool = True,
) -> DataFrame:
    """Estimate of the first preferred model found, else the median of all.

    Names match on a literal, case-insensitive substring.  An estimate that is
    not finite fails the query, and so does a missing model without the fallback.
    """
    name = F.lower("model")
    preference = F.when(F.lit(False), F.lit(0))
    for at, keyword in enumerate(preferred):
        preference = preference.when(name.contains(keyword.lower()), F.lit(at))
    chosen = F.min_by(
        F.struct("elasticity", "p_value", "model"),
        F.when(preference.isNotNull(), F.struct(preference, "model")),
    )
    picked = results.agg(chosen.alias("c"), F.median("elasticity").alias("median"))
    found = F.col("c").isNotNull()
    fallback = F.col("median")
    if not median_fallback:
        fallback = F.raise_error(F.lit("no preferred elasticity model found")).cast("double")
    estimate = F.when(found, F.col("c.elasticity")).otherwise(fallback)
    finite = estimate.isNotNull() & ~F.isnan(estimate) & (F.abs(estimate) < float("inf"))
    return picked.select(
        F.when(finite, estimate)
        .otherwise(F.raise_error(F.lit("no finite elasticity estimate")).cast("double"))
        .alias("elasticity"),
        F.col("c.p_value").alias("p_value"),
        F.when(found, F.col("c.model")).otherwise(F.lit(MEDIAN_MODEL)).alias("model"),
    )


def preferred_result(
    data: DataFrame, preferred: Sequence[str] = PREFERRED_MODELS, median_fallback: bool = True
) -> DataFrame:
    """``elasticity_selection`` with no more fits than it needs: of the first preferred name found, else of all."""
    usable = [s for s in SPECIFICATIONS if set(s.needs) <= set(data.columns)]
    for keyword in preferred:
        found = [s for s in usable if keyword.lower() in s.name.lower()]
        if found:
            return elasticity_selection(robustness_results(data, found), [keyword], median_fallback)
    return elasticity_selection(robustness_results(data, usable), preferred, median_fallback)


def robustness_summary(results: DataFrame) -> DataFrame:
    """Spread and sign of the elasticity over the specifications."""
    e = F.col("elasticity")
    return results.agg(
        F.count(F.lit(1)).alias("specifications"),
        F.median("elasticity").alias("median_elasticity"),
        F.min("elasticity").alias("min_elasticity"),
        F.max("elasticity").alias("max_elasticity"),
        count_if(e < 0).alias("negative"),
        count_if(e > 0).alias("positive"),
        count_if((e < 0) & F.col("significant_5pct")).alias("significant_negative"),
    )
