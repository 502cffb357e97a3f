"""Model zoo: linear models from one pass of block moments, with time-ordered cross-validation.

The data is ordered and scaled once, summed once into six small matrices (one per fold block),
and every linear model, penalty, fold and feature subset is solved from those matrices.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.definitions import ELASTICNET_GRID, LASSO_GRID, RIDGE_GRID
from eventide.operators import solvers
from eventide.operators.cleaning import covered_features, median_impute
from eventide.operators.moments import gram_matrices, moment_blocks
from eventide.operators.ordering import POSITION, global_positions
from eventide.operators.signals import scaler_fit
from eventide.session import stage

MIN_ROWS, MIN_ROWS_TREES, MIN_ROWS_SELECTION = 30, 40, 50
RESULT_SCHEMA = "horizon string, model string, kind string, name string, value double"


@dataclass
class Design:
    """Ordered, scaled rows of one target: columns ``_pos``, ``_block``, ``z_*``, ``y`` and the key."""

    rows: DataFrame
    features: list[str]
    n: int
    folds: int
    means: dict[str, float]
    stds: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return [f"z_{f}" for f in self.features]


def fold_count(n: int) -> int:
    return min(5, max(2, n // 20))


def fold_block(position: Column, n: int, folds: int) -> Column:
    """0 for rows that are only ever trained on, i for the rows tested by fold i."""
    size = n // (folds + 1)
    start = n - folds * size
    return F.when(position < start, 0).otherwise(F.floor((position - start) / size) + 1).cast("int")


def fold_rows(n: int, folds: int, i: int) -> tuple[int, int]:
    """(first, behind the last) position of the rows tested by fold i; all rows before them are its training rows."""
    size = n // (folds + 1)
    first = n - (folds - i + 1) * size
    return first, first + size


def walk_forward_block(position: Column, min_train: int = 50, step: int = 10) -> Column:
    return F.when(position < min_train, 0).otherwise(F.floor((position - min_train) / step) + 1).cast("bigint")


def prepare(
    df: DataFrame, features: dict[str, str], target: str, order: list[str], impute: bool = False,
    folds: int | None = None, also: list[str] = [],
) -> Design:
    """Complete rows in time order with globally scaled features.

    ``impute=False`` drops every row with a gap. ``impute=True`` drops rows without target, keeps
    features present in more than half of the rest and fills their gaps with the median.
    ``also``: columns that are passed on as ``_y_0``, ``_y_1``, ...
    """
    more = [f"_y_{i}" for i in range(len(also))]
    wide = df.select(*order, *[F.col(c).cast("double").alias(f) for f, c in features.items()], F.col(target).cast("double").alias("y"),
                     *[F.col(c).cast("double").alias(m) for c, m in zip(also, more)]).where("y is not null")
    names = list(features)
    if impute:
        wide = stage(wide, "with_target")
        names = covered_features(wide, names)
        wide = median_impute(wide.select(*order, *names, "y", *more), names)
    else:
        wide = wide.dropna(subset=names)
    ordered = global_positions(wide, order)
    fitted = scaler_fit(ordered, {f: f for f in names}).collect()  # one row per feature
    scale = {r["feature"]: (r["mean"], r["std"]) for r in fitted}
    n = fitted[0]["n"] if fitted else 0
    k = folds or fold_count(n)
    z = [((F.col(f) - F.lit(scale[f][0])) / F.lit(scale[f][1])).alias(f"z_{f}") for f in names] if n else []
    rows = ordered.select(POSITION, *order, *z, *names, "y", *more, fold_block(F.col(POSITION), n, k).alias("_block"))
    return Design(rows, names, n, k, {f: s[0] for f, s in scale.items()}, {f: s[1] for f, s in scale.items()})


def prepare_all(df: DataFrame, features: dict[str, str], targets: dict[str, str], order: list[str], impute: bool = False) -> dict[str, Design]:
    """``prepare`` for several targets; those that are missing in the same rows share what doesn't depend on the target."""
    names = list(targets)
    gap = {h: F.col(targets[h]).cast("double").isNull() for h in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    differ = df.agg(F.lit(0), *[F.max((gap[a] != gap[b]).cast("int")) for a, b in pairs]).first()[1:]  # one row
    same = {p for p, d in zip(pairs, differ) if not d}
    out: dict[str, Design] = {}
    for h in names:
        if h not in out:
            group = [b for b in names if (h, b) in same and b not in out]
            out[h] = first = prepare(df, features, targets[h], order, impute, also=[targets[b] for b in group])
            for i, b in enumerate(group):
                out[b] = replace(first, rows=first.rows.withColumn("y", F.col(f"_y_{i}")))
    return {h: out[h] for h in names}


def fold_moments(design: Design, columns: list[str] | None = None, rows: DataFrame | None = None) -> list[np.ndarray]:
    columns = columns or design.columns
    moments = moment_blocks(rows if rows is not None else design.rows, "_block", columns, "y")
    grams = gram_matrices(moments, "_block", len(columns) + 2)
    return [grams[i] for i in range(design.folds + 1)]


def _top(weights: dict[str, float], k: int | None = None) -> list[str]:
    return sorted(weights, key=lambda f: -abs(weights[f]))[:k]


def _rows(model: str, metrics: dict, weights: dict, kind: str = "weight") -> list[tuple]:
    out = [(model, "metric", k, None if v is None else float(v)) for k, v in metrics.items()]
    return out + [(model, kind, k, float(v)) for k, v in weights.items()]


def linear_zoo(design: Design, models: set[str] | None = None, poly_top: int = 6) -> list[tuple]:
    """(model, kind, name, value) rows of the linear models, from one set of fold moments."""
    want = models or {"OLS", "Ridge", "Lasso", "ElasticNet", "Stepwise+Ridge", "Polynomial"}
    if design.n < MIN_ROWS:
        return []
    f = design.features
    blocks = fold_moments(design)
    whole = sum(blocks)
    named = lambda w: {k: round(float(v), 4) for k, v in zip(f, w)}
    out: list[tuple] = []

    # a grid is only searched for the models that are asked for, or built on it
    kept: dict[str, float] = {}
    if want & {"OLS", "Polynomial"}:
        w_ols, b_ols = solvers.weights_and_intercept(whole, solvers.ols)
    if "OLS" in want:
        cv = solvers.cross_validate(blocks, solvers.ols)
        out += _rows("OLS", {"r2_insample": solvers.r2(whole, w_ols, b_ols), "r2_cv_mean": cv["mean"], "r2_cv_std": cv["std"],
                             "rmse_cv": cv["rmse"], "intercept": round(b_ols, 4)}, named(w_ols))

    if want & {"Ridge", "Stepwise+Ridge"}:
        alpha, cv = solvers.best_of(blocks, RIDGE_GRID, solvers.ridge)
    if "Ridge" in want:
        w, _ = solvers.weights_and_intercept(whole, solvers.ridge(alpha))
        out += _rows("Ridge", {"best_alpha": alpha, "r2_cv_mean": cv["mean"], "r2_cv_std": cv["std"]}, named(w))

    if want & {"Lasso", "Polynomial"}:
        l_alpha, l_cv = solvers.best_of(blocks, LASSO_GRID, solvers.lasso)
        w, _ = solvers.weights_and_intercept(whole, solvers.lasso(l_alpha))
        kept = {k: round(float(v), 4) for k, v in zip(f, w) if abs(v) > 1e-6}
    if "Lasso" in want:
        out += _rows("Lasso", {"best_alpha": l_alpha, "r2_cv_mean": l_cv["mean"], "r2_cv_std": l_cv["std"],
                               "n_features_selected": len(kept), "n_features_eliminated": len(f) - len(kept)}, kept)

    if "ElasticNet" in want:
        best, e_cv = solvers.best_of(blocks, ELASTICNET_GRID, solvers.elastic_net)
        w, _ = solvers.weights_and_intercept(whole, solvers.elastic_net(*best))
        out += _rows("ElasticNet", {"best_alpha": best[0], "best_l1_ratio": best[1], "r2_cv_mean": e_cv["mean"]},
                     {k: round(float(v), 4) for k, v in zip(f, w) if abs(v) > 1e-6})

    # with eight features or fewer there is nothing to select
    if "Stepwise+Ridge" in want and design.n >= MIN_ROWS_SELECTION and len(f) > 8:
        fit = solvers.ridge(alpha)
        order = solvers.forward_selection(blocks, 8, fit)
        columns = sorted(order)
        cv = solvers.cross_validate([solvers.subset(m, columns) for m in blocks], fit)
        w, _ = solvers.weights_and_intercept(solvers.subset(whole, columns), fit)
        out += _rows("Stepwise+Ridge", {"n_selected": len(columns), "r2_cv_mean": cv["mean"], "r2_cv_std": cv["std"]},
                     {f[j]: round(float(v), 4) for j, v in zip(columns, w)})
        out += [("Stepwise+Ridge", "added_at", f[j], float(i + 1)) for i, j in enumerate(order)]

    if "Polynomial" in want and design.n >= MIN_ROWS_SELECTION:
        base = _top(kept, poly_top) or _top(named(w_ols), poly_top)
        if len(base) >= 2:
            out += polynomial(design, base)
    return out


def polynomial_terms(base: list[str]) -> dict[str, Column]:
    """Degree-2 terms of scaled features: linear, then squares and products, in column order."""
    z = {f: F.col(f"z_{f}") for f in base}
    terms = dict(z)
    for i, a in enumerate(base):
        terms[f"{a}^2"] = z[a] * z[a]
        for b in base[i + 1:]:
            terms[f"{a} {b}"] = z[a] * z[b]
    return terms


def polynomial(design: Design, base: list[str], alpha: float = 10.0) -> list[tuple]:
    """Ridge on degree-2 terms; a second moment pass over derived columns."""
    terms = polynomial_terms(base)
    names = [f"t{i}" for i in range(len(terms))]
    rows = design.rows.select("_block", "y", *[c.alias(n) for n, c in zip(names, terms.values())])
    blocks = fold_moments(design, names, rows)
    whole, fit = sum(blocks), solvers.ridge(alpha)
    cv = solvers.cross_validate(blocks, fit)
    w, b = solvers.weights_and_intercept(whole, fit)
    weights = dict(zip(terms, (float(v) for v in w)))
    top = {t: round(weights[t], 4) for t in _top(weights, 12)}
    metrics = {"n_poly_features": len(terms), "r2_insample": solvers.r2(whole, w, b), "r2_cv_mean": cv["mean"], "r2_cv_std": cv["std"]}
    crossed = [("Polynomial", "interaction", t, round(v, 4)) for t, v in weights.items() if " " in t and abs(v) > 0.01]
    return _rows("Polynomial", metrics, top) + crossed


def zoo_frame(spark, results: dict[str, list[tuple]]) -> DataFrame:
    """One table of all horizons; a few hundred rows at most."""
    rows = [(h, *r) for h, found in results.items() for r in found]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def zoo_models(zoo: DataFrame) -> DataFrame:
    """(horizon, model, cv_r2) of every model that was fitted."""
    return zoo.where("kind = 'metric' and name = 'r2_cv_mean'").select(
        "horizon", "model", F.round("value", 4).alias("cv_r2"))


def zoo_blend_input(zoo: DataFrame) -> DataFrame:
    """(horizon, feature, ridge, lasso): the rounded weights the blend starts from."""
    w = zoo.where("kind = 'weight' and model in ('Ridge', 'Lasso')")
    return w.groupBy("horizon", F.col("name").alias("feature")).agg(
        F.max(F.when(F.col("model") == "Ridge", F.col("value"))).alias("ridge"),
        F.max(F.when(F.col("model") == "Lasso", F.col("value"))).alias("lasso"))


def penalty_path(design: Design, grid: list[float], make) -> DataFrame:
    """(alpha, r2_cv_mean, r2_cv_std, w_<feature>...) for every penalty of a grid."""
    blocks = fold_moments(design)
    whole, rows = sum(blocks), []
    for alpha in grid:
        cv = solvers.cross_validate(blocks, make(alpha))
        w, _ = solvers.weights_and_intercept(whole, make(alpha))
        rows.append((float(alpha), cv["mean"], cv["std"], *[float(v) for v in w]))
    names = ", ".join(f"w_{f} double" for f in design.features)
    return design.rows.sparkSession.createDataFrame(rows, f"alpha double, r2_cv_mean double, r2_cv_std double, {names}")
