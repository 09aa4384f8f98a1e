"""Several absorbed effects against dense regressions, components against a union-find."""

import re

import numpy as np
import pytest

from commercium.operators import absorption, regression
from test_regression import NAMES, dense_fit, panel


@pytest.mark.parametrize("x, absorb", [(["p"], ["sku", "quarter"]), (["p", "c"], ["sku", "quarter", "region"]), (["p"], ["sku"])])
def test_equals_the_full_dummy_regression(spark, x, absorb):
    rows = panel()
    df = spark.createDataFrame([*rows, (None, "q1", "r1", 1.0, 1.0, 1.0)], NAMES).repartition(5)
    fit = absorption.absorbed_ols(df, "y", x, absorb, "sku")
    b, se, u, k, _, y = dense_fit(rows, x, absorb[1:], absorb[0])
    for at, term in enumerate(x):
        got = fit.term(term)
        assert got["coefficient"] == pytest.approx(b[at], rel=1e-8)
        assert got["std_error"] == pytest.approx(se[at], rel=1e-7)
    assert (fit.observations, fit.parameters) == (len(rows), k)
    assert fit.rss == pytest.approx(u @ u, rel=1e-9)
    assert fit.r_squared == pytest.approx(1 - u @ u / ((y - y.mean()) @ (y - y.mean())), rel=1e-9)


def test_effects_of_thousands_of_levels_that_fall_into_parts(spark):
    draw = np.random.default_rng(5)
    n, levels = 30_000, 3_000
    sku = draw.integers(0, levels, n)
    sku[: n // 3] = 0  # a third of all rows
    part = sku % 3
    store = draw.integers(0, levels // 3, n) * 3 + part  # levels of three parts never meet
    one, two = draw.normal(size=levels), draw.normal(size=levels)
    p = draw.normal(size=n) + one[sku] - two[store]
    y = -0.6 * p + one[sku] + two[store] + draw.normal(size=n) * 0.1
    rows = list(zip(sku.tolist(), store.tolist(), p.tolist(), y.tolist(), strict=True))
    df = spark.createDataFrame(rows, "sku int, store int, p double, y double")
    fit = absorption.absorbed_ols(df, "y", ["p"], ["sku", "store"], "sku")

    def rest(v):
        """What alternating means leave of a column."""
        v = v - v.mean()
        for _ in range(4000):
            before = v
            for level in (sku, store):
                counts = np.maximum(np.bincount(level, minlength=levels), 1)
                v = v - (np.bincount(level, v, levels) / counts)[level]
            if np.abs(v - before).max() < 1e-13:
                break
        return v

    px, py = rest(p), rest(y)
    b = px @ py / (px @ px)
    u = py - b * px
    scores = np.bincount(sku, px * u, levels)
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for i, j in set(zip(sku.tolist(), (store + levels).tolist(), strict=True)):
        root[find(i)] = find(j)
    parts = len({find(k) for k in list(root)})
    used = len(np.unique(sku)) + len(np.unique(store))
    groups = len(np.unique(sku))
    spread = np.sqrt(scores @ scores) / (px @ px) * np.sqrt(groups / (groups - 1) * (n - 1) / (n - (1 + used - parts)))
    assert parts >= 3 and fit.parameters == 1 + used - parts
    assert fit.term("p")["coefficient"] == pytest.approx(b, rel=1e-8)
    assert fit.term("p")["std_error"] == pytest.approx(spread, rel=1e-6)


def test_a_regressor_inside_the_effects_is_dropped(spark):
    rows = [(f"S{k % 7}", f"q{k % 5}", float(k % 7 + k % 5), float(k * k % 11), float(k % 13)) for k in range(200)]
    df = spark.createDataFrame(rows, "sku string, quarter string, flat double, p double, y double")
    fit = absorption.absorbed_ols(df, "y", ["flat", "p"], ["sku", "quarter"], "sku")
    alone = regression.fixed_effects_ols(df, "y", ["p"], "sku", ["quarter"], "sku")
    assert fit.dropped == ("flat",) and np.isnan(fit.term("flat")["coefficient"])
    assert fit.term("p")["coefficient"] == pytest.approx(alone.term("p")["coefficient"], rel=1e-8)
    assert fit.parameters == alone.parameters


def test_no_rows_are_refused(spark):
    with pytest.raises(ValueError, match="no observations"):
        absorption.absorbed_ols(spark.createDataFrame([], "sku string, q string, p double, y double"), "y", ["p"], ["sku", "q"], "sku")


@pytest.mark.parametrize("x, absorb", [(["p"], ["sku", "quarter"]), (["p", "c"], ["sku", "quarter", "region"]), (["p"], ["sku"])])
def test_few_other_levels_are_solved_without_steps(spark, monkeypatch, x, absorb):
    """The first effect is taken out in one pass; the gradients' steps, written and shuffled, come to the same."""
    df = spark.createDataFrame(panel(), NAMES)
    written, write = [], absorption.stage

    def noted(df, label, **how):
        written.append(label)
        return write(df, label, **how)

    monkeypatch.setattr(absorption, "stage", noted)
    fit = absorption.absorbed_ols(df, "y", x, absorb, "sku")
    assert written == ["absorbed-rows", "packed-levels", "within"]
    monkeypatch.setattr(absorption, "few_levels", lambda rows, effects: None)
    steps = absorption.absorbed_ols(df, "y", x, absorb, "sku")
    assert (fit.observations, fit.parameters, fit.clusters) == (steps.observations, steps.parameters, steps.clusters)
    assert fit.coefficients == pytest.approx(steps.coefficients, rel=1e-8)
    assert fit.covariance == pytest.approx(steps.covariance, rel=1e-7)
    for moment in ("rss", "tss", "third_moment", "fourth_moment"):
        assert getattr(fit, moment) == pytest.approx(getattr(steps, moment), rel=1e-7)


def test_few_levels_in_parts_that_never_meet(spark, monkeypatch):
    """A third of the rows on one level, three parts, and a cluster that is no effect."""
    draw = np.random.default_rng(7)
    sku = np.where(draw.random(6000) < 1 / 3, 0, draw.integers(0, 300, 6000))
    quarter = draw.integers(0, 6, 6000) * 3 + sku % 3
    p = draw.normal(size=6000) + sku % 7 - quarter
    y = -0.6 * p + sku % 5 + quarter + draw.normal(size=6000)
    rows = list(zip(sku.tolist(), quarter.tolist(), (draw.integers(0, 40, 6000) * 0.5).tolist(), p.tolist(), y.tolist(), strict=True))
    df = spark.createDataFrame(rows, "sku int, quarter int, store double, p double, y double").repartition(5)
    fit = absorption.absorbed_ols(df, "y", ["p"], ["sku", "quarter"], "store")
    assert fit.parameters == 1 + len(set(sku.tolist())) + 18 - 3 and fit.clusters == 40
    monkeypatch.setattr(absorption, "few_levels", lambda rows, effects: None)
    steps = absorption.absorbed_ols(df, "y", ["p"], ["sku", "quarter"], "store")
    assert fit.parameters == steps.parameters
    assert fit.coefficients == pytest.approx(steps.coefficients, rel=1e-8)
    assert fit.covariance == pytest.approx(steps.covariance, rel=1e-7)


def test_rows_shuffle_by_the_first_effect_alone(spark, monkeypatch):
    plans, write = {}, absorption.stage

    def noted(df, label, **how):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, **how)

    monkeypatch.setattr(absorption, "stage", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        absorption.absorbed_ols(spark.createDataFrame(panel(), NAMES), "y", ["p"], ["sku", "quarter", "region"], "sku")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans["within"].count("SortMergeJoin") == 1 and plans["within"].count("BroadcastHashJoin") == 2
    assert set(re.findall(r"hashpartitioning\((\w+)#", plans["within"])) == {"_a0", "_level_0"}
