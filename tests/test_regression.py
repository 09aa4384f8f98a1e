import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commercium.operators import regression
from commercium.plans import elasticity
from commercium.sources import staging


def panel(seed=0, n=900, skus=25):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        sku = int(rng.integers(0, skus)) if rng.random() > 0.3 else 0  # a hot SKU
        quarter, region = f"q{rng.integers(0, 5)}", f"r{rng.integers(0, 3)}"
        p = 2 + 0.1 * sku + rng.normal()
        y = 1 - 0.7 * p + 0.05 * sku + (0.2 if quarter == "q3" else 0) + rng.normal() * 0.5
        rows.append((f"S{sku}", quarter, region, float(p), float(0.3 * p + rng.normal()), float(y)))
    rows.append(("single", "q1", "r1", 2.5, 0.1, 0.4))
    return rows


NAMES = ["sku", "quarter", "region", "p", "c", "y"]


def dense_fit(rows, x, categoricals, absorb):
    """Full dummy regression with clustered covariance."""
    cols = {n: np.array([r[i] for r in rows]) for i, n in enumerate(NAMES)}
    X = [np.ones(len(rows))] + [cols[c].astype(float) for c in x]
    for c in [*categoricals, *([absorb] if absorb else [])]:
        X += [(cols[c] == level).astype(float) for level in sorted(set(cols[c]))[1:]]
    X, y = np.column_stack(X), cols["y"].astype(float)
    inverse = np.linalg.pinv(X.T @ X)
    b = inverse @ X.T @ y
    u = y - X @ b
    scores = np.array([X[cols["sku"] == g].T @ u[cols["sku"] == g] for g in sorted(set(cols["sku"]))])
    n, k, g = len(y), np.linalg.matrix_rank(X), len(scores)
    V = inverse @ (scores.T @ scores) @ inverse * g / (g - 1) * (n - 1) / (n - k)
    h = np.einsum("ij,jk,ik->i", X, inverse, X)
    return b[1 : 1 + len(x)], np.sqrt(np.diag(V))[1 : 1 + len(x)], u, k, h.max(), y


@pytest.mark.parametrize(
    "x, categoricals, absorb",
    [(["p"], [], None), (["p"], [], "sku"), (["p"], ["quarter", "region"], "sku"), (["p", "c"], ["region"], "sku"),
     (["p"], ["quarter"], None)],
)
def test_equals_the_full_dummy_regression(spark, x, categoricals, absorb):
    rows = panel()
    df = spark.createDataFrame(rows, NAMES).repartition(5)
    fit = regression.fixed_effects_ols(df, "y", x, absorb, categoricals, "sku")
    b, se, u, k, leverage, y = dense_fit(rows, x, categoricals, absorb)
    for at, term in enumerate(x):
        got = fit.term(term)
        assert got["coefficient"] == pytest.approx(b[at], rel=1e-9)
        assert got["std_error"] == pytest.approx(se[at], rel=1e-8)
    assert fit.observations == len(rows) and fit.parameters == k
    assert fit.rss == pytest.approx(u @ u, rel=1e-9)
    assert fit.r_squared == pytest.approx(1 - u @ u / ((y - y.mean()) @ (y - y.mean())), rel=1e-9)
    assert fit.skewness == pytest.approx((u**3).mean() / (u**2).mean() ** 1.5, rel=1e-7, abs=1e-9)
    assert fit.kurtosis == pytest.approx((u**4).mean() / (u**2).mean() ** 2, rel=1e-8)
    residual = regression.residuals(df, fit).agg(F.avg(F.abs("residual")), F.stddev_pop("residual")).first()
    assert residual[0] == pytest.approx(np.abs(u).mean(), rel=1e-9)
    assert residual[1] == pytest.approx(u.std(), rel=1e-9)
    if absorb:
        assert regression.max_leverage(df, fit).first()[0] == pytest.approx(leverage, rel=1e-8)


def test_models_of_one_sample_share_passes_and_agree_with_single_fits(spark):
    df = spark.createDataFrame(panel(), NAMES)
    models = {
        "pooled": regression.Model(("p",), absorb=False),
        "within": regression.Model(("p",), ("quarter",)),
        "wide": regression.Model(("p", "c"), ("quarter", "region")),
    }
    together = regression.fit_models(df, "y", models, "sku")
    for name, model in models.items():
        alone = regression.fit_models(df, "y", {"only": model}, "sku")["only"]
        a, b = together[name].term("p"), alone.term("p")
        assert a == {k: pytest.approx(v, rel=1e-9) for k, v in b.items()}
        assert together[name].parameters == alone.parameters
        assert together[name].rss == pytest.approx(alone.rss, rel=1e-10)


def test_levels_that_a_task_sees_whole_are_not_shuffled(spark, monkeypatch):
    gathered, original = [], getattr(regression, "_gathered", None)

    def counted(parts, *rest):
        gathered.append(parts.count())
        return original(parts, *rest)

    monkeypatch.setattr(regression, "_gathered", counted, raising=False)
    df = spark.createDataFrame(panel(), NAMES).repartition(4, "sku").sortWithinPartitions("sku")
    fit = regression.fixed_effects_ols(df, "y", ["p"], "sku", ["quarter", "region"], "sku")
    assert gathered == [0, 0]
    assert regression.max_leverage(df, fit).first()[0] == pytest.approx(dense_fit(panel(), ["p"], ["quarter", "region"], "sku")[4], rel=1e-8)
    assert gathered == [0, 0]


@pytest.mark.parametrize("advisory", ["64m", "2k"])
def test_rows_of_a_table_of_levels_are_not_joined_with_their_means(spark, monkeypatch, advisory):
    staged, original = {}, regression.stage

    def counted(df, label, *rest):
        written = original(df, label, *rest)
        staged[label] = max(staged.get(label, 0), written.count())
        return written

    monkeypatch.setattr(regression, "stage", counted)
    rows = panel(n=2000, skus=200)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        df = staging.stage_levels(spark.createDataFrame(rows, NAMES).repartition(5), "panel", "sku")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = len(df.inputFiles())
    hot = df.where(staging.SCATTERED).count()
    assert (files == 1 and hot == 0) if advisory == "64m" else (files > 5 and hot > 500)
    models = {
        "pooled": regression.Model(("p",), absorb=False),
        "within": regression.Model(("p",), ("quarter", "region")),
        "wide": regression.Model(("p", "c"), ("region",)),
    }
    fits = regression.fit_models(df, "y", models, "sku")
    for name, model in models.items():
        b, se, u, k, _, _ = dense_fit(rows, [*model.x], [*model.categoricals], "sku" if model.absorb else None)
        assert fits[name].parameters == k and fits[name].observations == len(rows) and not fits[name].dropped
        assert fits[name].rss == pytest.approx(u @ u, rel=1e-9)
        assert [fits[name].term(x)["coefficient"] for x in model.x] == pytest.approx(list(b), rel=1e-9)
        assert [fits[name].term(x)["std_error"] for x in model.x] == pytest.approx(list(se), rel=1e-8)
    # Only levels at the ends of a stretch, and those that share a file with a hot one.
    assert staged["centred"] <= (len(rows) * 0.5 if advisory == "64m" else len(rows))


def test_levels_between_batches_and_stretches(spark):
    # (level, stretch, scattered, value): a and d lie at the ends of a stretch, e is in a scattered one.
    rows = [("a", 1, False), *[("b", 1, False)] * 5, *[("c", 1, False)] * 2, ("d", 1, False), ("d", 2, False), ("e", 2, True), ("f", 2, False), ("g", 2, False)]
    schema = pa.schema([("sku", pa.string()), ("s", pa.int64()), ("x", pa.bool_()), ("v", pa.float64())])
    columns = [list(c) for c in zip(*rows, strict=True)] + [[float(i) for i in range(len(rows))]]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
    for step in (1, 2, 3, len(rows)):
        batches = [whole.slice(i, step) for i in range(0, len(rows), step)]
        got = pa.Table.from_batches(regression._with_level_means(iter(batches), 1)).to_pylist()
        assert [r["sku"] for r in got] == [r[0] for r in rows] and [r["v"] for r in got] == columns[-1]
        seen = {r["sku"]: (r["_rows"], r["_m0"]) for r in got}
        assert seen == {"a": (0, 0.0), "b": (5, 3.0), "c": (2, 6.5), "d": (0, 0.0), "e": (0, 0.0), "f": (1, 11.0), "g": (0, 0.0)}


def test_a_level_of_too_many_rows_is_not_taken_for_whole(monkeypatch):
    monkeypatch.setattr(regression, "_HELD", 3)
    keys = ["a", *["b"] * 9, "c", "d"]
    schema = pa.schema([("sku", pa.string()), ("s", pa.int64()), ("x", pa.bool_()), ("v", pa.float64())])
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([1] * 12), pa.array([False] * 12), pa.array([1.0] * 12)], schema=schema)
    for step in (1, 2, 4):
        batches = [whole.slice(i, step) for i in range(0, 12, step)]
        got = pa.Table.from_batches(regression._with_level_means(iter(batches), 1)).to_pylist()
        assert [r["sku"] for r in got] == keys
        assert all(r["_rows"] == (1 if r["sku"] == "c" else 0) or r["sku"] == "c" for r in got)


def test_collinear_regressor_lowers_the_rank(spark):
    rows = [(*r[:4], 2 * r[3], r[5]) for r in panel()]
    df = spark.createDataFrame(rows, NAMES)
    fit = regression.fixed_effects_ols(df, "y", ["p", "c"], "sku", ["quarter"], "sku")
    _, _, u, k, _, _ = dense_fit(rows, ["p", "c"], ["quarter"], "sku")
    assert fit.parameters == k and fit.rss == pytest.approx(u @ u, rel=1e-9)


def test_regressor_constant_inside_levels_is_absorbed(spark):
    rows = [(*r[:4], float(r[0].strip("S").replace("single", "7")), r[5]) for r in panel()]
    df = spark.createDataFrame(rows, NAMES)
    fit = regression.fixed_effects_ols(df, "y", ["p", "c"], "sku", [], "sku")
    b, se, _, k, _, _ = dense_fit([(*r[:4], 0.0, r[5]) for r in rows], ["p"], [], "sku")
    assert fit.parameters == k and fit.term("p")["coefficient"] == pytest.approx(b[0], rel=1e-9)
    assert fit.term("p")["std_error"] == pytest.approx(se[0], rel=1e-8)


def test_a_term_without_variation_is_named(spark):
    rows = [(*r[:4], 3e8 + len(r[0]), r[5]) for r in panel()]
    fit = regression.fixed_effects_ols(spark.createDataFrame(rows, NAMES), "y", ["p", "c"], "sku", ["quarter"], "sku")
    assert fit.dropped == ("c",)
    assert all(v != v for v in fit.term("c").values()) and fit.term("p")["coefficient"] < 0


@pytest.mark.parametrize("spread", [1.0, 1e4, 1e6])
def test_wide_levels_do_not_hide_the_slope(spark, spread):
    rng = np.random.default_rng(5)
    rows, flat = [], []
    for k in range(2000):
        u, v = rng.normal(), rng.normal() * 0.1
        sku = k % 20
        rows.append((f"S{sku}", f"q{k % 7}", "r", spread * sku + u, 0.0, -0.7 * u + 3 * spread * sku + v))
        flat.append((f"S{sku}", f"q{k % 7}", "r", u, 0.0, -0.7 * u + v))
    b, se, u, k, _, _ = dense_fit(flat, ["p"], ["quarter"], "sku")
    fit = regression.fixed_effects_ols(spark.createDataFrame(rows, NAMES), "y", ["p"], "sku", ["quarter"], "sku")
    assert fit.term("p")["coefficient"] == pytest.approx(b[0], rel=1e-7)
    assert fit.term("p")["std_error"] == pytest.approx(se[0], rel=1e-6)
    assert fit.rss == pytest.approx(u @ u, rel=1e-6) and fit.parameters == k and not fit.dropped


def test_two_thousand_levels_equal_the_dense_fit(spark):
    rng = np.random.default_rng(6)
    sku, quarter, p = rng.integers(0, 30, 6000), np.arange(6000) % 2000, rng.normal(size=6000)
    y = 0.1 * sku - 0.7 * p + rng.normal(size=2000)[quarter] + 0.3 * rng.normal(size=6000)
    X = np.zeros((6000, 1 + 30 + 1999))
    X[:, 0] = p
    X[np.arange(6000), 1 + sku] = 1
    X[quarter > 0, 30 + quarter[quarter > 0]] = 1
    inverse = np.linalg.inv(X.T @ X)
    u = y - X @ (b := inverse @ X.T @ y)
    scores = np.stack([X[sku == g].T @ u[sku == g] for g in range(30)])
    variance = (inverse @ (scores.T @ scores) @ inverse)[0, 0] * 30 / 29 * 5999 / (6000 - X.shape[1])
    rows = [(f"S{s}", f"q{q:04d}", float(a), float(c)) for s, q, a, c in zip(sku, quarter, p, y, strict=True)]
    df = spark.createDataFrame(rows, "sku string, quarter string, p double, y double")
    fit = regression.fixed_effects_ols(df, "y", ["p"], "sku", ["quarter"], "sku")
    assert fit.parameters == X.shape[1] and fit.rss == pytest.approx(u @ u, rel=1e-8)
    assert fit.term("p")["coefficient"] == pytest.approx(b[0], rel=1e-8)
    assert fit.term("p")["std_error"] == pytest.approx(np.sqrt(variance), rel=1e-7)


def test_empty_samples_are_refused(spark):
    empty = spark.createDataFrame(panel(), NAMES).where("y > 1e9")
    with pytest.raises(ValueError, match="no observations"):
        regression.fixed_effects_ols(empty, "y", ["p"], "sku", [], "sku")
    with pytest.raises(ValueError, match="clustered on the absorbed"):
        regression.fixed_effects_ols(empty, "y", ["p"], "sku", [], "region")


def test_level_names_may_hold_quotes(spark):
    rows = [(r[0], r[1] + "'\\", *r[2:]) for r in panel()]
    a = regression.fixed_effects_ols(spark.createDataFrame(rows, NAMES), "y", ["p"], "sku", ["quarter"], "sku")
    b = regression.fixed_effects_ols(spark.createDataFrame(panel(), NAMES), "y", ["p"], "sku", ["quarter"], "sku")
    assert a.coefficients == pytest.approx(b.coefficients)


# Published estimate, p value, interval and fit of two specifications.
PUBLISHED = [
    (-0.6919756483590884, 0.00019763737476792515, -1.0563606555820455, -0.3275906411361314, 0.47062875798295034, 0.4648139492408957, 53),
    (-0.0881767942257806, 0.6396673996779239, -0.45732817068358234, 0.2809745822320211, 0.4558895972587874, 0.45060920094526513, 47),
]


@pytest.mark.parametrize("b, p, low, high, r2, adjusted, k", PUBLISHED)
def test_inference_reproduces_published_figures(b, p, low, high, r2, adjusted, k):
    design = regression.Design("y", ("p",), (), "sku", {}, {"p": 0.0, "y": 0.0})
    se = (high - low) / 2 / regression.NORMAL_95
    fit = regression.Fit(design, regression.Model(("p",)), np.array([b]), np.eye(1), np.array([[se**2]]), 4787, k, 40, 1 - r2, 1.0, 0.0, 0.0)
    term = fit.term("p")
    assert term["p_value"] == pytest.approx(p, rel=1e-9)
    assert (term["ci_low"], term["ci_high"]) == (pytest.approx(low), pytest.approx(high))
    assert fit.adj_r_squared == pytest.approx(adjusted, abs=1e-12)


def test_likelihood_criteria_reproduce_published_figures():
    # Log-likelihood 158.93 with 4787 rows and 53 parameters gives AIC -211.9, BIC 131.2.
    n = 4787
    rss = n / (2 * math.pi) * math.exp(-2 * 158.93 / n - 1)
    design = regression.Design("y", ("p",), (), "sku", {}, {"p": 0.0, "y": 0.0})
    fit = regression.Fit(design, regression.Model(("p",)), np.zeros(1), np.eye(1), np.eye(1), n, 53, 40, rss, 1.0, 0.0, 0.0)
    assert fit.log_likelihood == pytest.approx(158.93)
    assert round(fit.aic, 1) == -211.9 and round(fit.bic, 1) == 131.2


def test_durbin_watson_follows_the_given_order(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"S{i % 4}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows + rows[10:20], ["i", "sku", "p", "y"]).repartition(4)
    fit = regression.fixed_effects_ols(df, "y", ["p"], "sku", [], "sku")
    got = elasticity.durbin_watson(df, fit, ["i", "sku", "p", "y"]).first()[0]
    u = [r["residual"] for r in regression.residuals(df, fit).orderBy("i").collect()]
    assert got == pytest.approx(np.sum(np.diff(u) ** 2) / np.sum(np.square(u)), rel=1e-6)


def results(spark, rows):
    return spark.createDataFrame(
        [(m, 10, e, 0.1, p, e - 0.2, e + 0.2, 0.5, 0.4, p < 0.05, "negative" if e < 0 else "positive") for m, e, p in rows],
        elasticity.RESULT_SCHEMA,
    )


def test_selection_prefers_models_in_order_else_the_median(spark):
    table = [("3. SKU + Quarter fixed effects", -3.0, 0.0), ("4. sku + TIME + commercial controls", -0.7, 0.01), ("1. x", 1.0, 0.5)]
    picked = elasticity.elasticity_selection(results(spark, table)).first()
    assert (picked["elasticity"], picked["p_value"], picked["model"]) == (-0.7, 0.01, table[1][0])
    assert elasticity.elasticity_selection(results(spark, table[::2])).first()["elasticity"] == -3.0
    fallback = elasticity.elasticity_selection(results(spark, [("a", 1.0, 0.5), ("b", -3.0, 0.1)])).first()
    assert (fallback["elasticity"], fallback["p_value"], fallback["model"]) == (-1.0, None, elasticity.MEDIAN_MODEL)
    with pytest.raises(Exception, match="no preferred elasticity model"):
        elasticity.elasticity_selection(results(spark, [("a", 1.0, 0.5)]), median_fallback=False).collect()
    with pytest.raises(Exception, match="no finite elasticity"):
        elasticity.elasticity_selection(results(spark, [("a", float("nan"), 0.5)])).collect()


def test_summary_of_published_spread(spark):
    # Published estimates and p values of the ten specifications.
    published = [-0.004031131974092072, -2.938118909403873, -3.152167243713191, -0.6919756483590884, -0.0881767942257806,
                 -0.5822075350890489, -0.6954768686338806, -0.39594068372737556, -0.8189492495507281, -0.8001114179359803]
    p_values = [0.5758, 0.0, 0.0, 0.0001976, 0.63967, 0.0016908, 0.0001876, 0.37808, 0.0000623, 0.000018]
    got = elasticity.robustness_summary(results(spark, [(str(i), e, p) for i, (e, p) in enumerate(zip(published, p_values))])).first()
    assert (got["negative"], got["positive"], got["significant_negative"]) == (10, 0, 7)
    assert got["median_elasticity"] == pytest.approx((-0.6919756483590884 - 0.6954768686338806) / 2)


def test_list_price_specifications_need_a_list_price(spark):
    import datetime

    from commercium.sources.readers import INDEX_SCHEMA

    rng = np.random.default_rng(9)
    rows = [
        (datetime.date(2024, 1 + i % 12, 1), f"S{i % 5}", f"R{i % 2}", f"C{i % 3}", "T", float(np.exp(rng.normal())), 1 + i % 40)
        for i in range(240)
    ]
    orders = spark.createDataFrame(
        rows, "order_date date, sku string, region string, channel string, customer_tier string, net_price double, quantity bigint"
    )
    index = spark.createDataFrame([(datetime.date(2024, m, 1), 100.0 + m) for m in range(1, 13)], INDEX_SCHEMA)
    results = elasticity.robustness_results(elasticity.prepared_quarterly(orders, index)).collect()
    assert [r["model"].split(".")[0] for r in results] == ["1", "2", "3", "4", "5", "6", "9", "10"]
    assert all(r["ci_low"] < r["elasticity"] < r["ci_high"] for r in results)
    assert results[-1]["observations"] < results[0]["observations"] == 240


def test_fits_without_free_rows_keep_their_coefficients(spark):
    rows = [(0, 1.0, 2.0), (1, 2.0, 4.0)]
    fit = regression.fixed_effects_ols(spark.createDataFrame(rows, "sku int, x double, y double"), "y", ["x"])
    assert fit.term("x")["coefficient"] == pytest.approx(2.0)
    assert all(v != v for v in (fit.term("x")["std_error"], fit.term("x")["p_value"], fit.adj_r_squared))
