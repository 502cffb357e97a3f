"""Queries over splits, moments, the model zoo, training, walk-forward and explanations."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from eventide.definitions import KNOWN_FEATURES, SCORING_GRID_EARNINGS, SCORING_GRID_FILINGS
from eventide.operators import evaluation, explanation, information, neighbours, signals, solvers, trees, walkforward, zoo
from eventide.operators.moments import moment_blocks, sum_products
from eventide.operators.ordering import POSITION
from eventide.operators.scoring import rank_scores, score_events
from eventide.operators.training import train_scoring_model
from eventide.plans import flows
from eventide.plans.oracle_tables import sql
from eventide.plans.q_scoring import LIVE, PART, hand_model, model_data, scored_sql
from eventide.plans.q_signals import (FEATS, FILING_FEATS, FILING_TARGETS, PVALUE, RANKED, RETS, STAT_COLS, ic_sql,
                                      long_sql, pairs_sql, rounded_sql, stats_sql)
from eventide.plans.registry import query
from eventide.session import new_path, stage
from eventide.sources import files
from eventide.sources import warehouse as wh

KEY = ["symbol", "quarter", "year"]
ORDER = ["earnings_date", "symbol"]
TARGET = "return_5D"
COMPLETE = " and ".join(f"feat_{f} is not null" for f in KNOWN_FEATURES) + " and return_5D is not null"
BLOCK = "cast(case when pos < n - 5 * (n // 6) then 0 else 1 + (pos - (n - 5 * (n // 6))) // (n // 6) end as integer)"
PLACED = f"""select *, row_number() over (order by earnings_date, symbol) - 1 as pos, count(*) over () as n
  from (select symbol, quarter, year, earnings_date, return_5D, {', '.join(FEATS.values())} from dataset where {COMPLETE}) x"""


def design(spark, sf, features=None, target=TARGET):
    wanted = {f: c for f, c in FEATS.items() if features is None or f in features}
    data = stage(wh.dataset(spark, sf).select("earnings_date", *KEY, target, *wanted.values()), "dataset")
    return zoo.prepare(data, wanted, target, ORDER)


@query("ts_split", sql(["dataset"], f"select earnings_date, symbol, pos, {BLOCK} as block from placed", placed=PLACED))
def q_ts_split(spark, sf):
    return design(spark, sf).rows.select(*ORDER, F.col(POSITION).alias("pos"), F.col("_block").alias("block"))


@query("walk_forward_split", sql(["dataset"], "select earnings_date, symbol, cast(case when pos < 50 then 0 else (pos - 50) // 10 + 1 end as bigint) as batch from placed", placed=PLACED))
def q_wf_split(spark, sf):
    return design(spark, sf).rows.select(*ORDER, zoo.walk_forward_block(F.col(POSITION)).alias("batch"))


MOMENT_COLS = ["feat_mgmt_hedging", "feat_analyst_skepticism", "feat_pricing_power"]


def _moment_sql() -> str:
    names = ["1e0", *MOMENT_COLS, "return_5D"]
    return " union all ".join(
        f"select {BLOCK} as block, {i} as i, {j} as j, count(*) as n, round(sum({a} * {b}), 2) + 0 as s from placed group by 1"
        for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)


@query("moment_blocks", sql(["dataset"], _moment_sql(), placed=PLACED))
def q_moments(spark, sf):
    names = [c[5:] for c in MOMENT_COLS]
    m = moment_blocks(design(spark, sf).rows, "_block", names, "y")
    return m.select(F.col("_block").alias("block"), "i", "j", "n", (F.round("s", 2) + 0.0).alias("s"))


@query("moment_blocks_wide", """
  select label as block, i, j, count(*) as n, round(sum(cast(embedding[i + 1] as double) * cast(embedding[j + 1] as double)), 6) + 0 as s
  from embeddings, (select unnest(range(0, 64)) as i) a, (select unnest(range(0, 64)) as j) b where i <= j group by 1, 2, 3""")
def q_moments_wide(spark, sf):
    """Products of all 64 embedding dimensions per label."""
    df = wh.read(spark, sf, "embeddings")
    cols = [f"d{i}" for i in range(64)]
    wide = df.select(F.col("label").alias("block"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(64) for j in range(i, 64)]
    return sum_products(wide, "block", cols, pairs).withColumn("s", F.round("s", 6) + 0.0)


# --- closed forms of one- and two-feature models --------------------------------------------------------


def _path_sql(a: str, b: str, grid: list[float], kind: str) -> str:
    """Ridge on two features, or lasso on the first, with the five time-ordered folds, in SQL."""
    if kind == "ridge":
        w1 = "((s22 + alpha) * s1y - s12 * s2y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12)"
        w2 = "((s11 + alpha) * s2y - s12 * s1y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12)"
    else:
        w1, w2 = "sign(s1y) * greatest(abs(s1y) / m - alpha, 0) / (s11 / m)", "0e0"
    need = f"feat_{a} is not null and return_5D is not null" + (f" and feat_{b} is not null" if kind == "ridge" else "")
    return sql(
        ["dataset"],
        f"select r.alpha, round(avg(r2), 6) + 0 as r2_cv_mean, round(stddev_pop(r2), 6) + 0 as r2_cv_std, round(any_value(w.w1), 4) + 0 as w_{a}"
        + (f", round(any_value(w.w2), 4) + 0 as w_{b}" if kind == "ridge" else "")
        + " from scores2 r join w on w.f = 99 and w.alpha = r.alpha group by r.alpha",
        base=f"select feat_{a} as a, feat_{b} as b, return_5D as y, row_number() over (order by earnings_date, symbol) - 1 as pos, count(*) over () as n from dataset where {need}",
        sc="select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from base",
        z=f"select {BLOCK} as block, (a - ma) / sa as x1, coalesce((b - mb) / sb, 0) as x2, y from base, sc",
        fold="select unnest([1, 2, 3, 4, 5, 99]) as f",
        mom="""select f, count(*) as m, avg(x1) as m1, avg(x2) as m2, avg(y) as my, var_pop(x1) * count(*) as s11, var_pop(x2) * count(*) as s22,
          covar_pop(x1, x2) * count(*) as s12, covar_pop(x1, y) * count(*) as s1y, covar_pop(x2, y) * count(*) as s2y
          from z join fold on z.block < f group by f""",
        w=f"select *, my - w1 * m1 - w2 * m2 as b0 from (select *, {w1} as w1, {w2} as w2 from mom, (select unnest([{', '.join(f'{g}e0' for g in grid)}]) as alpha) g) q",
        scores2="select alpha, f, 1 - sum((y - b0 - w1 * x1 - w2 * x2) ** 2) / (var_pop(y) * count(*)) as r2 from z join w on z.block = w.f group by alpha, f")


def path(spark, sf, features, grid, make):
    out = zoo.penalty_path(design(spark, sf, features), grid, make)
    return out.select("alpha", *[(F.round(c, 6 if c.startswith("r2") else 4) + 0.0).alias(c) for c in out.columns[1:]])


PAIR = ["mgmt_hedging", "pricing_power"]


@query("zoo_ols_two_features", _path_sql(*PAIR, [0.0], "ridge"))
def q_ols2(spark, sf):
    return path(spark, sf, PAIR, [0.0], solvers.ridge)


@query("zoo_ridge_two_features", _path_sql(*PAIR, zoo.RIDGE_GRID, "ridge"))
def q_ridge2(spark, sf):
    return path(spark, sf, PAIR, zoo.RIDGE_GRID, solvers.ridge)


LASSO_PATH = [0.001, 1.0, 10.0, 25.0, 50.0]


@query("zoo_lasso_one_feature", _path_sql("mgmt_hedging", "pricing_power", LASSO_PATH, "lasso"))
def q_lasso1(spark, sf):
    return path(spark, sf, ["mgmt_hedging"], LASSO_PATH, solvers.lasso)


def _register_linear(name: str, model: str) -> None:
    @query(name)
    def run(spark, sf):
        results = {}
        data = stage(wh.dataset(spark, sf), "dataset")
        for h, column in RETS.items():
            results[h] = [r for r in zoo.linear_zoo(zoo.prepare(data, FEATS, column, ORDER), {model}) if r[0] == model]
        return zoo.zoo_frame(spark, results)


for _name, _model in [("zoo_ols", "OLS"), ("zoo_ridge", "Ridge"), ("zoo_lasso", "Lasso"), ("zoo_elasticnet", "ElasticNet"),
                      ("zoo_stepwise", "Stepwise+Ridge"), ("zoo_polynomial", "Polynomial")]:
    _register_linear(_name, _model)


@query("zoo_filings")
def q_zoo_filings(spark, sf):
    """All linear models on the filing features, imputed, for every target."""
    return flows.filings_zoo(spark, sf)


def _forests(spark, designs: dict) -> dict:
    """Forest rows of every target; the targets are fitted side by side."""
    found = trees.together([lambda d=d, source=source: trees.random_forest(d, source=source) for d, source in designs.values()], at_once=4)
    return dict(zip(designs, found))


def _filing_designs(spark, sf) -> dict:
    data = stage(wh.filings(spark, sf), "filings")
    return {h: (zoo.prepare(data, FILING_FEATS, c, ["filingDate", "ticker"], impute=True), "filings") for h, c in FILING_TARGETS.items()}


def _designs(spark, sf) -> dict:
    data = stage(wh.dataset(spark, sf), "dataset")
    return {h: (zoo.prepare(data, FEATS, c, ORDER), "earnings") for h, c in RETS.items()}


@query("zoo_random_forest")
def q_forest(spark, sf):
    """Forests of 200 trees for every horizon."""
    return zoo.zoo_frame(spark, _forests(spark, _designs(spark, sf)))


@query("zoo_random_forest_filings")
def q_forest_filings(spark, sf):
    """Forests of 200 trees on the filing features for every target."""
    return zoo.zoo_frame(spark, _forests(spark, _filing_designs(spark, sf)))


# A boosted round is a chain of Spark jobs: README has the seconds of the whole grids, which the operators' defaults run.
@query("zoo_gbt")
def q_gbt(spark, sf):
    return zoo.zoo_frame(spark, {"5D": trees.gradient_boosting(design(spark, sf), trees=5, rates=[0.05, 0.1], depths=[2])})


@query("boosted_variants")
def q_variants(spark, sf):
    """The default settings at their full 300 rounds."""
    return zoo.zoo_frame(spark, {"5D": trees.boosted_variants(design(spark, sf))})


@query("param_search")
def q_search(spark, sf):
    space = {**trees.SEARCH, "maxIter": (3, 8), "maxDepth": (2, 3)}
    return zoo.zoo_frame(spark, {"5D": trees.param_search(design(spark, sf), trials=2, space=space)})


@query("permutation_importance")
def q_permutation(spark, sf):
    """Drop of R² per feature of a forest of 200 trees."""
    d = design(spark, sf)
    model = trees.forest(rows=d.n).fit(trees.assembled(d))
    return spark.createDataFrame(trees.permutation_importance(d, model), "feature string, r2_drop double")


@query("model_comparison")
def q_comparison(spark, sf):
    """Linear models and forests of every horizon ranked by CV R²."""
    designs = _designs(spark, sf)
    found, forests = {h: zoo.linear_zoo(d) for h, (d, _) in designs.items()}, _forests(spark, designs)
    return evaluation.model_comparison(zoo.zoo_models(zoo.zoo_frame(spark, {h: found[h] + forests[h] for h in found})))


# --- mutual information and explanations ------------------------------------------------------------------

_BINS = long_sql("dataset", {**FEATS, **RETS}, "symbol, quarter, year", "x")


@query("mutual_information", sql(["dataset"], """
  select feature, horizon, n, round(sum(c * 1e0 / n * ln(c * 1e0 * n / (nx * ny))), 6) as mi from (
    select *, sum(c) over (partition by feature, horizon) as n, sum(c) over (partition by feature, horizon, bx) as nx,
      sum(c) over (partition by feature, horizon, by_) as ny from (
      select f.feature, h.feature as horizon, f.bin as bx, h.bin as by_, count(*) as c from binned f join binned h using (symbol, quarter, year)
      where f.feature in (""" + ", ".join(f"'{f}'" for f in KNOWN_FEATURES) + """) and h.feature in ('1D', '5D', '10D', '21D') group by 1, 2, 3, 4) j) k
  group by feature, horizon, n""",
    vals=_BINS, binned="""select symbol, quarter, year, feature,
      floor((rank() over (partition by feature order by x) - 1) * 10 / count(*) over (partition by feature)) as bin from vals where x is not null"""))
def q_mi(spark, sf):
    data = stage(wh.dataset(spark, sf).select(*FEATS.values(), *RETS.values()), "dataset")
    return signals.rounded(information.mutual_information(data, FEATS, RETS), 6)


def _psi(n: str) -> str:
    big = f"greatest({n}, 6)"
    series = f"ln({big}) - 1 / (2e0 * {big}) - 1 / (12e0 * {big} ** 2) + 1 / (120e0 * {big} ** 4) - 1 / (252e0 * {big} ** 6) + 1 / (240e0 * {big} ** 8)"
    return "(" + series + "".join(f" - case when {n} <= {m} then 1 / {m}e0 else 0 end" for m in range(1, 6)) + ")"


def _standard(table: dict[str, str], name: str) -> str:
    scaled = lambda c: f"cast(round({c} * round({neighbours.UNITS} / nullif((select stddev_pop({c}) from dataset), 0))) as bigint)"
    return " union all ".join(f"select symbol, quarter, year, '{n}' as {name}, {scaled(c)} as v from dataset where {c} is not null" for n, c in table.items())


@query("mutual_information_neighbours", sql(
    ["dataset"], f"""
  select feature, horizon, n, round(greatest({_psi('n')} + {_psi('3')} - a - b, 0), 6) + 0 as mi from (
    select feature, horizon, count(*) as n, avg({_psi('nx')}) as a, avg({_psi('ny')}) as b from (
      select p.feature, p.horizon, p.id, count(case when abs(p.x - q.x) <= greatest(p.r - 1, 0) then 1 end) as nx, count(case when abs(p.y - q.y) <= greatest(p.r - 1, 0) then 1 end) as ny
      from radius p join pairs q using (feature, horizon) group by p.feature, p.horizon, p.id) c group by feature, horizon) d""",
    fx=_standard(FEATS, "feature"), hy=_standard({"5D": RETS["5D"]}, "horizon"),
    pairs="select feature, horizon, f.v as x, h.v as y, row_number() over () as id from fx f join hy h using (symbol, quarter, year)",
    radius="""select p.feature, p.horizon, p.id, any_value(p.x) as x, any_value(p.y) as y, min(greatest(abs(p.x - q.x), abs(p.y - q.y)), 4)[4] as r
      from pairs p join pairs q using (feature, horizon) group by p.feature, p.horizon, p.id"""))
def q_mi_neighbours(spark, sf):
    """Nearest-neighbour mutual information of every feature and the five-day return."""
    data = stage(wh.dataset(spark, sf).select(*FEATS.values(), RETS["5D"]), "dataset")
    return signals.rounded(neighbours.neighbour_information(data, FEATS, {"5D": RETS["5D"]}), 6)


@query("mutual_information_neighbours_all")
def q_mi_neighbours_all(spark, sf):
    """Nearest-neighbour mutual information of every feature and horizon."""
    data = stage(wh.dataset(spark, sf).select(*FEATS.values(), *RETS.values()), "dataset")
    return signals.rounded(neighbours.neighbour_information(data, FEATS, RETS), 6)


@query("explain_features", scored_sql(
    " union all ".join(f"select '{f}' as feature, round(avg(abs({PART[f]})), 6) as mean_abs from dataset, sc" for f in LIVE)))
def q_explain(spark, sf):
    data = model_data(spark, sf)
    return signals.rounded(information.linear_explanation(data, hand_model(data, cuts=False)), 6)


def _explained_model(spark, sf):
    """A forest of 200 trees, fitted on all rows, with its design."""
    d = design(spark, sf)
    return d, explanation.explainer(trees.forest(rows=d.n).fit(trees.assembled(d)), spark)


@query("explain_trees")
def q_explain_trees(spark, sf):
    """Features by mean absolute Shapley contribution to a forest's predictions."""
    d, found = _explained_model(spark, sf)
    return signals.rounded(explanation.feature_ranking(d.rows, d.features, d.columns, found), 6)


@query("explain_interactions")
def q_explain_interactions(spark, sf):
    """The ten pairs of features with the largest mean absolute interaction values."""
    d, found = _explained_model(spark, sf)
    return signals.rounded(explanation.top_interactions(d.rows, d.features, d.columns, found), 6)


# --- walk-forward --------------------------------------------------------------------------------------------


@query("walk_forward")
def q_walk_forward(spark, sf):
    out = walkforward.walk_forward_ridge(design(spark, sf), ORDER)
    return out.select(*ORDER, "batch", F.round("predicted", 6).alias("predicted"), "actual")


@query("walk_forward_metrics")
def q_wf_metrics(spark, sf):
    out = walkforward.walk_forward_ridge(design(spark, sf), ORDER)
    return signals.rounded(evaluation.regression_metrics(out.withColumn("model", F.lit("Ridge")), ["model"]))


def _fit_trees(d, make):
    vec = VectorAssembler(inputCols=d.columns, outputCol="features")

    def fit(train):
        model = make().fit(vec.transform(train).withColumnRenamed("y", "label"))
        return lambda test: model.transform(vec.transform(test))

    return fit


@query("walk_forward_trees")
def q_wf_trees(spark, sf):
    """Boosted trees of 300 rounds, refitted over the expanding history; every row from the 51st on is predicted."""
    return walkforward.walk_forward_boosted(design(spark, sf), next(iter(trees.VARIANTS.values())), ORDER)


def walked_models(d):
    """Walk-forward metrics of ridge, refitted every ten rows, and forests; the one with the best Sharpe is promoted."""
    ridge = walkforward.walk_forward_ridge(d, ORDER).select(F.lit("Ridge").alias("model"), "predicted", "actual")
    forest = walkforward.walk_forward_estimator(d, _fit_trees(d, lambda: trees.forest(rows=d.n)), ORDER).select(F.lit("Random Forest").alias("model"), "predicted", "actual")
    table = stage(evaluation.regression_metrics(stage(ridge.unionByName(forest), "walked"), ["model"]), "metrics")
    best = walkforward.promote_best(table).select("model", F.lit(True).alias("promoted"))
    return signals.rounded(table.join(best, "model", "left").withColumn("promoted", F.coalesce("promoted", F.lit(False))))


@query("promote_walk_forward")
def q_promote_walk_forward(spark, sf):
    """Metrics of the models over all rows from the 51st on, and which of them is promoted."""
    return walked_models(design(spark, sf))


@query("experiment_record")
def q_experiment_record(spark, sf):
    """CV comparison, walk-forward metrics, promoted model and contributions of one experiment, appended as a record and read back."""
    d = design(spark, sf)
    forest = trees.random_forest(d)
    comparison = zoo.zoo_models(zoo.zoo_frame(spark, {"5D": zoo.linear_zoo(d) + forest})).drop("horizon")
    explained = explanation.explainer(trees.forest(rows=d.n).fit(trees.assembled(d)), spark)
    importance = signals.rounded(explanation.feature_ranking(d.rows, d.features, d.columns, explained)).select("feature", "mean_abs")
    record = stage(files.experiment_record(TARGET, 0, comparison, walked_models(d), importance), "record")
    path = new_path(spark, "experiments")
    files.append_experiment(record, path, dt.datetime(2025, 1, 1))
    return spark.read.schema(record.schema).json(path)


RULES = ["mgmt_hedging", "analyst_skepticism", "pricing_power"]
RULES_SQL = " union all ".join(
    f"select '{f}' as model, feat_{f} - 0.5e0 as predicted, return_5D as actual from dataset where feat_{f} is not null and return_5D is not null" for f in RULES)


@query("promote_best", sql(["dataset"], """
  select model, n, round(sharpe, 4) as sharpe, round(r2, 4) as r2, round(dir_acc, 4) as dir_acc from (
    select model, count(*) as n, avg(s) / stddev_pop(s) * sqrt(252 / 5e0) as sharpe, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) as r2,
      avg(case when (predicted > 0) = (actual > 0) then 1e0 else 0e0 end) as dir_acc
    from (select *, case when predicted > 0 then actual else -actual end as s from rules) x group by model) m order by m.sharpe desc limit 1""", rules=RULES_SQL))
def q_promote(spark, sf):
    wide = wh.dataset(spark, sf).select("return_5D", *[(F.col(f"feat_{f}") - 0.5).alias(f) for f in RULES])
    long = wide.unpivot(["return_5D"], RULES, "model", "predicted").where("predicted is not null and return_5D is not null")
    table = evaluation.regression_metrics(long.withColumnRenamed("return_5D", "actual"), ["model"])
    return signals.rounded(walkforward.promote_best(table).select("model", "n", "sharpe", "r2", "dir_acc"))


# --- training --------------------------------------------------------------------------------------------------


def model_rows(model, spark):
    """A trained model as (feature, weight, mean, std) rows with its headline numbers."""
    return spark.createDataFrame(
        [(f, model.weights[f], model.means[f], model.stds[f], model.intercept, model.lasso_alpha, model.cv_r2,
          model.n_training_samples, model.score_percentiles["p75"]) for f in model.features],
        "feature string, weight double, mean double, std double, intercept double, lasso_alpha double, cv_r2 double, n bigint, p75 double")


@query("train_scoring_model")
def q_train(spark, sf):
    data = stage(wh.dataset(spark, sf), "dataset")
    model, _ = train_scoring_model(data, FEATS, "return_1D", ORDER, SCORING_GRID_EARNINGS, "1D")
    return model_rows(model, spark)


@query("train_scoring_model_filings")
def q_train_filings(spark, sf):
    data = stage(wh.filings(spark, sf), "filings")
    model, _ = train_scoring_model(data, FILING_FEATS, FILING_TARGETS["30D_alpha"], ["filingDate", "ticker"],
                                   SCORING_GRID_FILINGS, "30D_alpha", impute=True)
    return model_rows(model, spark)


@query("combined_scores")
def q_combined(spark, sf):
    """Filings joined with transcript features: train on both families, score and rank."""
    return flows.combined(spark, sf)


@query("earnings_scores")
def q_earnings(spark, sf):
    """Train on the 1D horizon and rank every analysed event."""
    data = stage(wh.dataset(spark, sf), "dataset")
    model, _ = train_scoring_model(data, FEATS, "return_1D", ORDER, SCORING_GRID_EARNINGS, "1D")
    return rank_scores(score_events(data, model, KEY).drop("feature_contributions"), KEY)


# --- combined sources and a walk-forward that SQL can state -------------------------------------------------------

COMBINED_SQL = ("select s.symbol, s.quarter, s.year, f.actual7dReturn, f.actual30dReturn, f.actual7dAlpha, f.actual30dAlpha, "
                + ", ".join(f"f.{raw} as sec_{snake}" for snake, raw in FILING_FEATS.items()) + ", "
                + ", ".join(f"s.{f} as nlp_{f}" for f in KNOWN_FEATURES)
                + " from filings f join scores s on s.symbol = upper(f.ticker) and s.quarter = quarter(cast(f.filingDate as date))"
                  " and s.year = year(cast(f.filingDate as date))")


@query("feature_signal_table_combined", sql(
    ["filings", "scores"],
    f"select feature, horizon, {rounded_sql(STAT_COLS + ' ic ic_pvalue')}, n_observations, n_signal_triggered from stats join pv using (feature, horizon)",
    combined=COMBINED_SQL, pairs=pairs_sql("combined", flows.COMBINED, FILING_TARGETS), ranked=RANKED, ic=ic_sql(15), pv=PVALUE,
    stats=stats_sql(flows.COMBINED_BEAR, "quantile", "observed", 15)))
def q_combined_signals(spark, sf):
    """Both feature families of the joined sources against every filing target."""
    return flows.combined_signals(spark, sf)


@query("walk_forward_one_feature", sql(
    ["dataset"], "select earnings_date, symbol, batch, round(my - w * mx + w * x, 4) + 0 as predicted, y as actual from fit where batch > 0",
    base="""select earnings_date, symbol, feat_mgmt_hedging as a, return_5D as y, row_number() over (order by earnings_date, symbol) - 1 as pos from dataset
      where feat_mgmt_hedging is not null and return_5D is not null""",
    z="""select earnings_date, symbol, y, (a - (select avg(a) from base)) / (select stddev_pop(a) from base) as x,
      cast(case when pos < 50 then 0 else (pos - 50) // 10 + 1 end as bigint) as batch from base""",
    sums="select batch, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from z group by batch",
    prior="""select batch, sum(n) over w as n, sum(sx) over w as sx, sum(sy) over w as sy, sum(sxx) over w as sxx, sum(sxy) over w as sxy
      from sums window w as (order by batch rows between unbounded preceding and 1 preceding)""",
    fit="""select z.*, sx / n as mx, sy / n as my, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) as w from z join prior using (batch)"""))
def q_wf_one(spark, sf):
    out = walkforward.walk_forward_ridge(design(spark, sf, ["mgmt_hedging"]), ORDER)
    return out.select(*ORDER, "batch", (F.round("predicted", 4) + 0.0).alias("predicted"), "actual")
