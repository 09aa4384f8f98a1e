"""Least squares with any number of absorbed effects, whatever their number of levels.

Outcome and regressors are each split into one value per level of every effect and a rest;
the slopes of the rests are those of the regression with all dummies.

The split is a least-squares problem of its own. Where all effects but the first have few
levels together, the first is taken out of its normal equations in one pass, as the value
of each of its levels follows from theirs; the driver solves for the few that are left.

Otherwise the normal equations are never formed: conjugate gradients, scaled by the rows of
each level, multiply by them through one grouping of the distinct combinations of levels,
for all columns at once. Values of levels are rows of a table, so neither the driver nor a
task holds them; each step is a written table, and the driver sees a few sums a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercium.operators.regression import Design, Fit, Model
from commercium.sources.staging import stage

#: Conjugate gradients stop when the scaled remainder of every column is below this share of the first.
TOLERANCE, MOST_STEPS = 1e-10, 500
#: Levels of all effects but the first that are solved for on the driver; a level of the first meets no more.
MOST_SOLVED = 256
# Eigenvalues of the scaled normal equations below this are noise of the sums behind them.
_NO_LINK = 1e-12
_KEY = ["_effect", "_level"]


def _grouped(cells: DataFrame, effects: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Sums of ``values`` (SQL by name) over the cells of every level of every effect."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("_effect"), F.col(e).alias("_level")) for k, e in enumerate(effects)]))
    each = cells.select(levels.alias("_l"), *[F.expr(v).alias(name) for name, v in values.items()])
    return each.groupBy("_l._effect", "_l._level").agg(*[F.sum(name).alias(name) for name in values])


def _attached(rows: DataFrame, effects: Sequence[str], tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``<column>_<k>`` of the level of each effect k, from one table (_level, columns) per effect."""
    for k, (effect, table) in enumerate(zip(effects, tables, strict=True)):
        own = table.select(F.col("_level").alias(f"_level_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
        rows = rows.join(own, F.col(effect) == F.col(f"_level_{k}")).drop(f"_level_{k}")
    return rows


def _by_effect(state: DataFrame, effects: Sequence[str]) -> list[DataFrame]:
    return [state.where(F.col("_effect") == k) for k in range(len(effects))]


def level_values(cells: DataFrame, effects: Sequence[str], columns: Sequence[str], tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """(_effect, _level, one value per column) that fit the columns best, and the steps taken.

    ``cells`` is a written table with the effects as strings, their rows ``_n`` and the
    sums of the columns. Where levels are not identified the values are one solution.
    """
    many, p = range(len(effects)), [f"_p{c}" for c in range(len(columns))]
    first = _grouped(cells, effects, {"_d": "_n"} | {f"_r{c}": f"`{name}`" for c, name in enumerate(columns)})
    start = {f"_x{c}": F.lit(0.0) for c in range(len(columns))} | {f"_p{c}": F.col(f"_r{c}") / F.col("_d") for c in range(len(columns))}
    state = stage(first.withColumns(start), "levels")

    def sums(table: DataFrame, left: str, right: str) -> list[float]:
        parts = [F.coalesce(F.sum(F.expr(f"{left}{c} * {right}{c}" + (" / _d" if left == right else ""))), F.lit(0.0)) for c in range(len(columns))]
        return list(table.agg(*[x.alias(f"s{c}") for c, x in enumerate(parts)]).first())

    rest = sums(state, "_r", "_r")
    goal = [tolerance**2 * x for x in rest]
    steps = 0
    while any(x > g for x, g in zip(rest, goal, strict=True)) and steps < MOST_STEPS:
        steps += 1
        joined = _attached(cells.select(*effects, "_n"), effects, _by_effect(state, effects), p)
        product = _grouped(joined, effects, {f"_q{c}": "_n * (" + " + ".join(f"_p{c}_{k}" for k in many) + ")" for c in range(len(columns))})
        state = stage(state.join(product, _KEY), "levels")
        curve = sums(state, "_p", "_q")
        # A column that has arrived stands still.
        along = [r / q if r > g and q > 0 else 0.0 for r, q, g in zip(rest, curve, goal, strict=True)]
        state = state.withColumns(
            {f"_x{c}": F.expr(f"_x{c} + {a!r}D * _p{c}") for c, a in enumerate(along)}
            | {f"_r{c}": F.expr(f"_r{c} - {a!r}D * _q{c}") for c, a in enumerate(along)}
        ).drop(*[f"_q{c}" for c in range(len(columns))])
        following = sums(state, "_r", "_r")
        turn = [n / r if a else 0.0 for n, r, a in zip(following, rest, along, strict=True)]
        state = state.withColumns({f"_p{c}": F.expr(f"_r{c} / _d + {t!r}D * _p{c}") for c, t in enumerate(turn)})
        rest = [n if a else r for n, r, a in zip(following, rest, along, strict=True)]
        if not any(along):
            break
    return state.select(*_KEY, *[F.col(f"_x{c}").alias(name) for c, name in enumerate(columns)]), steps


def few_levels(rows: DataFrame, effects: Sequence[str], most: int = MOST_SOLVED) -> list[list[str]] | None:
    """Levels of every effect but the first, or None if they are more than ``most`` together."""
    found: list[list[str]] = []
    for effect in effects[1:]:
        left = most - sum(map(len, found))
        found.append(sorted(r[0] for r in rows.select(effect).distinct().limit(left + 1).collect()))
        if len(found[-1]) > left:
            return None
    return found


def solved_values(
    rows: DataFrame, effects: Sequence[str], columns: Sequence[str], levels: Sequence[Sequence[str]]
) -> tuple[list[DataFrame], int]:
    """One table (_level, one value per column) per effect that fit the columns best, and the parameters in them.

    ``levels`` names those of all effects but the first. Each level of the first is one row with
    its counts of them, at most ``MOST_SOLVED``, and its value is the mean of what they leave.
    """
    spark, many = rows.sparkSession, range(1, len(effects))
    starts = np.cumsum([0, *map(len, levels)])
    size, at = int(starts[-1]), [f"_j{k}" for k in many]
    for k, j in zip(many, at, strict=True):
        places = [(level, int(starts[k - 1]) + i) for i, level in enumerate(levels[k - 1])]
        table = spark.createDataFrame(places, f"_level string, {j} int")
        rows = rows.join(F.broadcast(table), F.col(effects[k]) == F.col("_level")).drop("_level")
    measures = [F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(c).alias(c) for c in columns]]

    cells = rows.groupBy(effects[0], *at).agg(*measures)
    if len(effects) == 2:
        counts = cells.withColumnRenamed("_j1", "_j")
    else:
        # Sums of the columns and all rows count once, with the first of the others.
        each = [F.struct(F.col(j).alias("_j"), *[(F.col(c) if j == at[0] else F.lit(0.0)).alias(c) for c in columns]) for j in at]
        each = each or [F.struct(F.lit(None).cast("int").alias("_j"), *columns)]
        cells = cells.select(effects[0], "_n", F.explode(F.array(*each)).alias("_e")).select(effects[0], "_n", "_e.*")
        counts = cells.groupBy(effects[0], "_j").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in columns])
    first_own = F.col("_j") < int(starts[1]) if size else F.lit(True)
    packed = counts.groupBy(effects[0]).agg(
        F.sum(F.when(first_own, F.col("_n"))).alias("_d"),
        *[F.sum(c).alias(c) for c in columns],
        F.collect_list(F.when(F.col("_j").isNotNull(), F.struct("_j", "_n"))).alias("_u"),
    )
    packed = stage(packed, "packed-levels")

    matrix, right, shared = np.zeros((size, size)), np.zeros((size, len(columns))), np.zeros((size, size))
    if size:
        pairs = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for p, a in enumerate(at) for b in at[p:]]
        direct = rows.groupBy(*at).agg(*measures).select("*", F.explode(F.array(*pairs)).alias("_p"))
        taken = packed.select("*", F.explode("_u").alias("_a")).select("*", F.explode(F.filter("_u", lambda e: e["_j"] >= F.col("_a._j"))).alias("_b"))
        share = F.col("_a._n") / F.col("_d")
        for table, a, b, n, weight in ((direct, "_p.a", "_p.b", F.col("_n"), F.lit(1.0)), (taken, "_a._j", "_b._j", share * F.col("_b._n"), share)):
            own = F.col(a) == F.col(b)
            sums = table.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(
                F.sum(n).alias("n"), *[F.sum(F.when(own, weight * F.col(c))).alias(c) for c in columns]
            )
            sign = 1.0 if table is direct else -1.0
            for row in sums.collect():
                i, j = row["a"], row["b"]
                matrix[i, j] += sign * row["n"]
                if i == j:
                    right[i] += sign * np.array([row[c] for c in columns])
                if table is taken:
                    shared[i, j] = shared[j, i] = row["n"]
        matrix = np.triu(matrix) + np.triu(matrix, 1).T
    scale = 1.0 / np.sqrt(np.maximum(shared.sum(axis=0), 1e-300)) if size else np.zeros(0)
    found, vectors = np.linalg.eigh(matrix * np.outer(scale, scale)) if size else (np.zeros(0), np.zeros((0, 0)))
    linked = found > _NO_LINK * max(found.max(initial=0.0), 1e-300)
    inner = (vectors[:, linked] / found[linked]) @ (vectors[:, linked].T @ (scale[:, None] * right))
    solved = scale[:, None] * inner

    def rest(c: int) -> Column:
        value = F.array(*[F.lit(v) for v in solved[:, c].tolist()]) if size else F.array(F.lit(0.0))
        return F.aggregate("_u", F.col(columns[c]), lambda left, e: left - e["_n"] * F.get(value, e["_j"])) / F.col("_d")

    tables = [packed.select(F.col(effects[0]).alias("_level"), *[rest(c).alias(name) for c, name in enumerate(columns)])]
    schema = ", ".join(["_level string", *[f"{c} double" for c in columns]])
    parameters = packed.count() + size
    for k in many:
        own = slice(int(starts[k - 1]), int(starts[k]))
        values = [(level, *v) for level, v in zip(levels[k - 1], solved[own].tolist(), strict=True)]
        tables.append(F.broadcast(spark.createDataFrame(values, schema)))
        parameters -= _parts(shared[own, own] > 0)
    return tables, parameters


def _parts(linked: np.ndarray) -> int:
    """Connected components of a few levels, from which of them occur with one level of the first effect."""
    while True:
        reached = linked.astype(float) @ linked > 0
        if (reached == linked).all():
            return len(np.unique(linked, axis=0))
        linked = reached


def count_components(pairs: DataFrame, left: str, right: str) -> int:
    """Connected components of two effects whose levels are linked by the rows of ``pairs``.

    Two star steps in turn, each tying a level's neighbours to its smallest one, until
    nothing changes: a number of steps that grows with the logarithm of the levels.
    """
    a, b = F.concat(F.lit("0:"), F.col(left)), F.concat(F.lit("1:"), F.col(right))
    links = stage(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:  # stars: every level but the smallest of its component has one link
            return links.select("b").distinct().count()
        seen = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least("n", F.min("b")).alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "links")
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(small.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "links")


def absorbed_ols(
    df: DataFrame, y: str, x: Sequence[str], absorb: Sequence[str], cluster: str, tolerance: float = TOLERANCE
) -> Fit:
    """Ordinary least squares of ``y`` on ``x`` with the levels of every column of ``absorb`` taken out.

    Equals the regression with all dummies in coefficients, clustered covariance and
    residuals. Rows with a NULL in any column are left out. Parameters are the slopes
    that vary inside the levels plus the levels less those that repeat others: with two
    effects the connected components of their levels, exactly; every further effect is
    counted against the first alone, which counts too many parameters where it also
    repeats others. A slope without variation inside the levels is named in ``dropped``.
    ``absorb`` begins with the effect of most levels. ``df`` is read once.
    """
    absorb, x = list(absorb), list(x)
    columns = [*x, y]
    effects, names = [f"_a{k}" for k in range(len(absorb))], [f"_c{k}" for k in range(len(columns))]
    # A cluster that is one of the effects does not travel twice.
    twice = cluster in absorb and dict(df.dtypes)[cluster] in ("string", "int", "bigint")
    own = [] if twice else [F.col(cluster).alias("_cluster")]
    rows = df.select(*[F.col(a).cast("string").alias(e) for a, e in zip(absorb, effects, strict=True)], *own,
                     *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)]).dropna()
    rows = stage(rows, "absorbed-rows", cluster_by=effects[0])
    if twice:
        rows = rows.withColumn("_cluster", F.col(effects[absorb.index(cluster)]))
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names], *[F.var_pop(c).alias(f"v{c}") for c in names]).first()
    if not total["n"]:
        raise ValueError("no observations to fit")
    rows = rows.withColumns({c: F.col(c) - F.lit(total[c]) for c in names})
    few = few_levels(rows, effects)
    if few is not None:
        tables, in_levels = solved_values(rows, effects, names, few)
    else:
        sums = [F.sum(c).alias(c) for c in names]
        cells = stage(rows.groupBy(*effects).agg(F.count(F.lit(1)).cast("double").alias("_n"), *sums), "absorbed-cells")
        values, _ = level_values(cells, effects, names, tolerance)
        values = stage(values, "level-values")
        tables = _by_effect(values, effects)
        in_levels = values.count() - sum(count_components(cells, effects[0], e) for e in effects[1:])
    rests = {c: F.expr(f"{c} - (" + " + ".join(f"{c}_{k}" for k in range(len(effects))) + ")") for c in names}
    within = _attached(rows, effects, tables, names)
    within = stage(within.select("_cluster", *[v.alias(c) for c, v in rests.items()]), "within")

    size = len(x)
    pairs = [(a, b) for a in range(size + 1) for b in range(a, size + 1)]
    products = within.agg(*[F.sum(F.col(names[a]) * F.col(names[b])).alias(f"p{a}_{b}") for a, b in pairs]).first()
    gram = np.zeros((size + 1, size + 1))
    for a, b in pairs:
        gram[a, b] = gram[b, a] = products[f"p{a}_{b}"]
    # What the gradients leave of a column without variation inside the levels is noise.
    flat = np.array([gram[k, k] <= 1e3 * tolerance**2 * total["n"] * max(total[f"v{c}"], 1e-300) for k, c in enumerate(names[:size])], bool)
    used = np.flatnonzero(~flat)
    coefficients, bread = np.zeros(size), np.zeros((size, size))
    bread[np.ix_(used, used)] = np.linalg.pinv(gram[np.ix_(used, used)])
    coefficients = bread @ gram[:size, size]
    rank = int(np.linalg.matrix_rank(gram[np.ix_(used, used)])) if len(used) else 0

    e = F.expr(f"{names[-1]} - (" + " + ".join(["0D", *[f"({b!r}D) * {c}" for b, c in zip(coefficients.tolist(), names, strict=False)]]) + ")")
    scored = within.withColumn("_e", e).groupBy("_cluster").agg(
        *[F.sum(F.col(c) * F.col("_e")).alias(f"s{k}") for k, c in enumerate(names[:size])],
        *[F.sum(F.pow("_e", F.lit(p))).alias(f"e{p}") for p in (2, 3, 4)],
    )
    both = [(a, b) for a in range(size) for b in range(a, size)]
    last = scored.agg(
        F.count(F.lit(1)).alias("clusters"),
        *[F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"m{a}_{b}") for a, b in both],
        *[F.sum(f"e{p}").alias(f"e{p}") for p in (2, 3, 4)],
    ).first()
    meat = np.zeros((size, size))
    for a, b in both:
        meat[a, b] = meat[b, a] = last[f"m{a}_{b}"]

    parameters = rank + in_levels
    n, clusters = int(total["n"]), int(last["clusters"])
    free = clusters > 1 and n > parameters
    correction = clusters / (clusters - 1.0) * (n - 1.0) / (n - parameters) if free else math.nan
    design = Design(y, tuple(x), (), cluster, {}, {c: float(total[k]) for c, k in zip(columns, names, strict=True)})
    return Fit(
        design=design,
        model=Model(tuple(x)),
        coefficients=coefficients,
        bread=bread,
        covariance=bread @ meat @ bread * correction,
        observations=n,
        parameters=parameters,
        clusters=clusters,
        rss=float(last["e2"]),
        tss=float(total[f"v{names[-1]}"]) * n,
        third_moment=float(last["e3"]),
        fourth_moment=float(last["e4"]),
        dropped=tuple(c for c, out in zip(x, flat, strict=True) if out),
    )
