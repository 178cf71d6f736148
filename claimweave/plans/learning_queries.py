"""Queries of model selection, studies over folds and seeds, clustering, and likelihoods of claim models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.functions.math import half_up
from claimweave.operators import bayes as B
from claimweave.operators import metrics as M
from claimweave.operators import models as L
from claimweave.operators import text as X
from claimweave.operators.features import min_max
from claimweave.operators.sampling import uniform_sql
from claimweave.plans.model_queries import _COLS, _features
from claimweave.session import shared_folder, table
from claimweave.sources import files
from claimweave.sources.claims import WITH, claims

QUERIES, SQL = {}, {}
r6 = lambda x: f"round({x} + 1e-9, 6)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def rounded(df, *columns):
    return df.withColumns({c: half_up(F.col(c)) for c in columns})


@query(WITH + f""", x as (select cast(pos as double) as x, cdf_exp as y from c where cdf_exp is not null), s as (select count(*) as n, avg(x) as mx, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy from x), e as (select *, (syy - b * sxy) / (n - 2) as v from s)
select 'intercept' as feature, {r6('a')} as coefficient, {r6('sqrt(v * (1 / n + mx * mx / sxx))')} as error from e union all select 'p', {r6('b')}, {r6('sqrt(v / sxx)')} from e""")
def linear_errors(spark, sf_dir):
    """Least squares of the experiment on the claim: coefficients and standard errors."""
    c = claims(spark, sf_dir).where("cdf_exp is not null").withColumn("p", F.col("pos").cast("double"))
    rows = [(n, v, s) for n, v, s, _ in L.linear_p_values(c, ["p"], "cdf_exp")]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double, error double"), "coefficient", "error")


@query()
def linear_p_values(spark, sf_dir):
    return spark.createDataFrame(L.linear_p_values(_features(spark, sf_dir), _COLS, "cdf_exp"), "feature string, coefficient double, error double, p double")


@query()
def backward_elimination(spark, sf_dir):
    return spark.createDataFrame(L.backward_elimination(_features(spark, sf_dir), _COLS, "cdf_exp", 0.05), "step int, feature string, p double")


def _r2(df, features):
    x = L.assemble(df, features, "cdf_exp")
    return float(L.fit_linear(x, 0.0).summary.r2)


@query()
def forward_selection(spark, sf_dir):
    x = _features(spark, sf_dir).cache()
    rows = L.forward_selection(x, "cdf_exp", {"claim": ["p"], "time": ["y"], "standing": ["ai", "ar"]}, 3, lambda cs: _r2(x, cs))
    x.unpersist()
    return spark.createDataFrame(rows, "feature string, r2 double")


@query()
def correlation_guided(spark, sf_dir):
    x = _features(spark, sf_dir).cache()
    rows = L.correlation_guided(x, _COLS, "cdf_exp", lambda cs: _r2(x, cs))
    x.unpersist()
    return spark.createDataFrame(rows, "feature string, r2 double")


@query()
def penalty_path(spark, sf_dir):
    """Coefficients along 40 penalties, a row per penalty and feature."""
    x = L.assemble(min_max(_features(spark, sf_dir), _COLS), _COLS, "wrong").cache()
    rows = L.lasso_path(x, [10 ** (-4 + i * 4 / 39) for i in range(40)])
    x.unpersist()
    return spark.createDataFrame([(p, n, f, c) for p, n, cs in rows for f, c in zip(_COLS, cs)], "penalty double, nonzero int, feature string, coefficient double")


@query()
def few_features(spark, sf_dir):
    """The weakest penalty that leaves two features, and the penalty of best area under the curve."""
    x = L.assemble(min_max(_features(spark, sf_dir), _COLS), _COLS, "wrong").cache()
    few = L.lasso_with(x, 2)
    best, value = L.best_penalty(x, lambda m: float(m.summary.areaUnderROC), steps=5)
    x.unpersist()
    kept = int((abs(few.coefficients.toArray()) > 1e-9).sum())
    return spark.createDataFrame([(kept, best, value)], "features int, penalty double, auc double")


@query()
def tree_and_forests(spark, sf_dir):
    """Area under the curve of a decision tree, and the fit of a regression forest, over three folds."""
    x = L.assemble(_features(spark, sf_dir), _COLS, "wrong").cache()
    tree = L.cross_validated(x, "fold", lambda t: L.fit_tree(t, 4))
    y = L.assemble(_features(spark, sf_dir), _COLS, "cdf_exp").cache()
    rows = [("tree", int(k), v) for k, v in tree]
    for k in range(3):
        m = L.fit_forest_regression(y.where(F.col("fold") != k), 10, 4)
        s = m.transform(y.where(F.col("fold") == k)).agg(F.corr("prediction", "label").alias("c")).first()["c"]
        rows.append(("forest", k, s))
    x.unpersist()
    y.unpersist()
    return spark.createDataFrame([(n, k, None if v is None else float(v)) for n, k, v in rows], "model string, fold int, value double")


@query()
def model_runs(spark, sf_dir):
    """Origins x seeds x folds of a forest: a row per fit."""
    x = L.assemble(_features(spark, sf_dir), _COLS, "wrong").cache()
    rows = L.model_runs(x, "fold", "origin", lambda t, s: L.fit_forest(t, 10, 4, seed=s), [0, 1])
    x.unpersist()
    return spark.createDataFrame(rows, "origin string, seed int, fold int, auc double")


@query()
def model_round_trip(spark, sf_dir):
    """A forest written and read back gives the same scores: the largest difference is the row."""
    from pyspark.ml.classification import RandomForestClassificationModel
    x = L.assemble(_features(spark, sf_dir), _COLS, "wrong")
    m, path = L.fit_forest(x, 5, 3), f"{shared_folder(spark)}/claimweave/{uuid.uuid4().hex}"
    files.save_model(m, path)
    again = RandomForestClassificationModel.load(path)
    a, b = (L.scored(f, x).select("claim_id", F.col("score").alias(n)) for f, n in ((m, "a"), (again, "b")))
    return a.join(b, "claim_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("difference"), F.count(F.lit(1)).alias("n"))


@query()
def cluster_counts(spark, sf_dir):
    """Cost and silhouette of k-means over two to four clusters."""
    x = _features(spark, sf_dir).select("ai", "ar").cache()
    rows = L.choose_clusters(x, ["ai", "ar"], [2, 3, 4])
    x.unpersist()
    return spark.createDataFrame(rows, "k int, cost double, silhouette double")


@query()
def gap_choice(spark, sf_dir):
    """The number of clusters by the gap statistic, with ten reference samples."""
    x = _features(spark, sf_dir).select("ai", "ar").cache()
    k = L.choose_by_gap(L.gap_statistic(x, ["ai", "ar"], [1, 2, 3, 4], 10))
    x.unpersist()
    return spark.createDataFrame([(k,)], "k int")


@query()
def merged_clusters(spark, sf_dir):
    """Clusters of organisations by first word, small ones joined to the larger one with the nearest spelling."""
    orgs = table(spark, sf_dir, "claims").select(F.explode(X.affiliation_units("affs")).alias("org")).distinct()
    return L.merged_clusters(orgs.withColumn("cluster", F.split("org", " ")[0]), "org", "cluster", 0.2)


@query(WITH + f", a as (select up, dn, list_sort(list(distinct cast(year as double))) as v from c group by up, dn) select up, dn, case when len(v) > 2 then list_transform(v, lambda x: {r6('(x - v[1]) / (v[len(v)] - v[1])')}) else v end as scaled from a")
def scaled_rows(spark, sf_dir):
    a = claims(spark, sf_dir).groupBy("up", "dn").agg(F.array_sort(F.collect_set(F.col("year").cast("double"))).alias("v"))
    return a.select("up", "dn", F.when(F.size("v") > 2, F.transform(L.scaled_rows(F.col("v")), lambda v: half_up(v))).otherwise(F.col("v")).alias("scaled"))


_MODES = [(0.6, 0.2, 0.6, 0.0), (0.4, 1.2, 0.5, 0.5)]


def _mode_sql(v, w, mu, sd, shift):
    import math
    return f"({math.log(w)!r} + case when {v} > {shift} then {-0.5 * math.log(2 * math.pi) - math.log(sd)!r} - ln({v} - {shift}) - 0.5 * pow((ln({v} - {shift}) - {mu}) / {sd}, 2) else -1000 end)"


@query(WITH + ", l as (select journal, " + ", ".join(f"{_mode_sql('ai', *m)} as l{i}" for i, m in enumerate(_MODES)) + f" from c where ai is not null) select journal, {r6('sum(greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))))')} as loglik from l group by journal")
def mixture_likelihood(spark, sf_dir):
    """Likelihood of each journal's influences under a mixture of shifted log-normal laws."""
    return rounded(B.shifted_mixture_loglik(claims(spark, sf_dir), ["journal"], "ai", _MODES), "loglik")


@query(WITH + f", a as (select up, dn, pos, (0.5 + 1.0 / (1 + exp(-0.4 * (year - 2000)))) * (cdf_exp - 0.5) + (-0.2 + 0.6 / (1 + exp(-0.2 * (year - 1995)))) * (ar / 10) as a from c where cdf_exp is not null and ar is not null) select up, dn, {r6('sum(case when pos = 1 then -ln(1 + exp(-a)) else -ln(1 + exp(a)) end) - 0.1 * 2.6')} as loglik from a group by up, dn")
def step_likelihood(spark, sf_dir):
    """Likelihood of claims logistic in two features with coefficients that step over time, with a penalty."""
    c = claims(spark, sf_dir).withColumn("e", F.col("cdf_exp") - 0.5).withColumn("r", F.col("ar") / 10)
    return rounded(B.step_logistic_loglik(c, ["up", "dn"], "year", {"e": (0.5, 1.5, 2000.0, 0.4), "r": (-0.2, 0.4, 1995.0, 0.2)}, "pos", 0.1), "loglik")


@query(WITH + f", x as (select up, dn, year >= 2000 as late, pos, 0.55 + 0.03 * coalesce(ar, 5) as p from c), g as (select up, dn, late, sum(case when pos = 1 then ln(p) else ln(1 - p) end) + max(ln(case when late then 0.7 else 0.4 end)) as a, sum(case when pos = 1 then ln(1 - p) else ln(p) end) + max(ln(case when late then 0.3 else 0.6 end)) as b from x group by up, dn, late) select up, dn, {r6('sum(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))))')} as loglik from g group by up, dn")
def change_likelihood(spark, sf_dir):
    """Likelihood of claims about a state that changes in 2000, told rightly the better the affiliation."""
    p = 0.55 + 0.03 * F.coalesce("ar", F.lit(5.0))
    return rounded(B.state_change_loglik(claims(spark, sf_dir), ["up", "dn"], "year", 2000, p, "pos", 0.4, 0.7), "loglik")


@query(WITH + f", x as (select up, dn, pos, 0.2 + 0.05 * coalesce(ar, 5) as g, 0.3 + 0.4 * coalesce(cdf_exp, 0.5) as h from c), d as (select *, g * (1 - h) + (1 - g) * h as d from x) select up, dn, {r6('sum(ln(case when pos = 1 then d else 1 - d end))')} as loglik from d group by up, dn")
def chain_likelihood(spark, sf_dir):
    """Likelihood of chains of claims given chances of guess and hidden state."""
    g, h = 0.2 + 0.05 * F.coalesce("ar", F.lit(5.0)), 0.3 + 0.4 * F.coalesce("cdf_exp", F.lit(0.5))
    return rounded(B.chain_loglik(claims(spark, sf_dir), ["up", "dn"], g, "pos", h), "loglik")


@query(WITH + """, h as (select journal, cast(floor(cdf_exp * 10) + 1 as integer) as bin, count(*) as n from c where cdf_exp >= 0 and cdf_exp < 1 group by all), p as (select journal, first(bin order by n desc, bin) as peak, max(n) as most from h group by journal),
n as (select h.journal, bin, peak, bin - row_number() over (partition by h.journal order by bin) as run from h join p using (journal) where n >= 0.5 * most), r as (select journal, peak, run, min(bin) as first, max(bin) as last from n group by all) select journal, first, last, peak from r where peak between first and last""")
def peak_neighbourhood(spark, sf_dir):
    return B.neighbourhood_of_maximum(claims(spark, sf_dir).where("cdf_exp is not null"), ["journal"], "cdf_exp", 0.0, 1.0, 10)


@query()
def citation_fit_offset(spark, sf_dir):
    """Log-normal fit of a journal's claims by year with a constant added."""
    c = claims(spark, sf_dir).groupBy("journal", "year").agg(F.count(F.lit(1)).alias("n"))
    return B.lognormal_fit(c, ["journal"], "year", "n", offset=True)


@query(WITH + ", x as (select cdf_exp as s, pos from c where cdf_exp is not null), q as (select quantile_cont(s, [" + ", ".join(f"{(i + 1) / 100}" for i in range(99)) + f"]) as q from x), t as (select l.level, count(*) filter (where s >= q[l.level]) as n, sum(pos) filter (where s >= q[l.level]) as tp, sum(pos) as p from x, q, (select unnest(range(1, 100)) as level) l group by l.level), m as (select round(tp / p, 9) as x, max(tp / n) as y from t group by round(tp / p, 9)) select {r6('sum(s)')} as area from (select (lead(x) over (order by x) - x) * (lead(y) over (order by x) + y) / 2 as s from m)")
def precision_recall_area(spark, sf_dir):
    """Area under precision over recall at the 99 percentiles."""
    c = M.curve_at_percentiles(claims(spark, sf_dir), "cdf_exp", "pos").select(F.lit(0).alias("g"), F.round("recall", 9).alias("recall"), "precision")
    return rounded(M.trapezoid(c, ["g"], "recall", "precision").select("area"), "area")


@query()
def scaled_regression(spark, sf_dir):
    """Scores per pair and cell in two columns by kind, scaled to [0, 1], against the claims' frequency: fit of a
    linear model on the folds left out."""
    from claimweave.operators.aggregates import cross_section
    from claimweave.operators.reshape import pivot_cases
    from claimweave.operators.sampling import folds
    from claimweave.sources.claims import experiments
    e = cross_section(experiments(spark, sf_dir), ["up", "dn", "pert_type"], "score", F.col("pert_type").isin("trt_kd", "trt_ov"), F.col("n") >= 1)
    wide = pivot_cases(e, ["up", "dn"], "pert_type", ["trt_kd", "trt_ov"], F.first("mean"), "est_").dropna()
    freq = claims(spark, sf_dir).groupBy("up", "dn").agg(F.avg("pos").alias("freq"))
    x = min_max(wide.join(freq, ["up", "dn"]), ["est_trt_kd", "est_trt_ov"])
    y = L.assemble(folds(x, ["up", "dn"], 3), ["est_trt_kd", "est_trt_ov"], "freq").cache()
    rows = []
    for k in range(3):
        m = L.fit_linear(y.where(F.col("fold") != k), 0.0)
        d = F.col("prediction") - F.col("label")
        r = m.transform(y.where(F.col("fold") == k)).agg(F.avg(d * d).alias("mse"), F.corr("prediction", "label").alias("corr")).first()
        rows.append((k, *[float(v) for v in m.coefficients], float(m.intercept), r["mse"], r["corr"]))
    y.unpersist()
    return spark.createDataFrame(rows, "fold int, kd double, ov double, intercept double, mse double, corr double")


@query()
def experiment_loop(spark, sf_dir):
    """History lengths x folds: a forest's claims to interactions by four estimates, each against the experiment."""
    from claimweave.operators.estimates import claim_validity, interaction_estimates
    from claimweave.operators.relational import long_histories
    rows, x = [], L.assemble(_features(spark, sf_dir), _COLS, "wrong").cache()
    truth = x.groupBy("up", "dn").agg(F.avg("cdf_exp").alias("truth"))
    names = ["mean_pos", "mean_pi", "weighted_pi", "rank_pi"]
    for longer in (1, 5):
        y = long_histories(x, longer)
        for k in range(3):
            s = L.scored(L.fit_forest(y.where(F.col("fold") != k), 10, 4), y.where(F.col("fold") == k))
            est = interaction_estimates(claim_validity(s.withColumn("p_", F.array("score", 1 - F.col("score"))), "p_"))
            r = est.join(truth, ["up", "dn"]).agg(*[F.avg(((F.col(n) > 0.5) == (F.col("truth") > 0.5)).cast("int")).alias(n) for n in names]).first()
            rows += [(longer, k, n, None if r[n] is None else float(r[n])) for n in names]
    x.unpersist()
    return spark.createDataFrame(rows, "longer_than int, fold int, estimate string, accuracy double")


@query(WITH + ", j as (select claim_id, pos, row_number() over (partition by pos order by " + uniform_sql(0, "claim_id") + ", claim_id) as at_ from c), m as (select min(n) as m from (select count(*) as n from c group by pos)), s as (select claim_id, pos from j, m where at_ <= m), r as (select *, row_number() over (partition by pos order by " + uniform_sql(1, "claim_id") + ", claim_id) as p, count(*) over (partition by pos) as n from s) select claim_id, pos, case when p <= round(n * 0.7) then 'train' else 'test' end as part from r")
def balanced_halves(spark, sf_dir):
    """Classes cut to one size, then 70 to 30 of each."""
    from claimweave.operators import sampling as P
    c = claims(spark, sf_dir).select("claim_id", "pos")
    counts = {r["pos"]: r["count"] for r in c.groupBy("pos").count().collect()}
    even = P.stratify(c, "pos", P.ratio_sizes(counts, {0: 1, 1: 1}), ["claim_id"]).drop("copy_no")
    return P.parts_by_class(even, "pos", ["claim_id"], {"train": 0.7, "test": 0.3}, 1)
