"""Queries of evaluation metrics, samples, sequential estimates, models, growth and connectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.functions.math import half_up
from claimweave.operators import bayes as B
from claimweave.operators import metrics as M
from claimweave.operators import models as L
from claimweave.operators import sampling as P
from claimweave.operators import text as X
from claimweave.operators import windows as W
from claimweave.session import shared_folder, table
from claimweave.sources import files
from claimweave.sources.claims import WITH, claims, readings
from claimweave.streaming import claim_stream

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


def _batches(spark, sf_dir):
    return W.batches(claims(spark, sf_dir), "pos")


_B = WITH + ", b as (select up, dn, year, cast(sum(pos) as bigint) as k, count(*) as n from c group by up, dn, year)"


@query(WITH + f", x as (select cdf_exp as s, pos, rank() over (order by cdf_exp) + (count(*) over (partition by cdf_exp) - 1) / 2e0 as r from c where cdf_exp is not null), t as (select count(*) as n, sum(pos) as p, sum(r) filter (where pos = 1) as s from x) select n, cast(p as bigint) as positives, {r6('(s - p * (p + 1) / 2) / (p * (n - p))')} as auc from t")
def auc_rank(spark, sf_dir):
    return rounded(M.auc(claims(spark, sf_dir), "cdf_exp", "pos"), "auc")


_CURVE = WITH + ", x as (select cdf_exp as s, pos from c where cdf_exp is not null), l as (select unnest(range(1, 20)) as level), q as (select quantile_cont(s, [" + ", ".join(f"{(i + 1) / 20}" for i in range(19)) + """]) as q from x),
k as (select level, q[level] as cutoff from l, q), t as (select level, cutoff, count(*) filter (where s >= cutoff) as n, sum(pos) filter (where s >= cutoff) as tp, count(*) as a, sum(pos) as p from k, x group by all)"""


@query(_CURVE + f" select cast(level as integer) as level, {r6('cutoff')} as cutoff, {r6('tp / n')} as precision, {r6('tp / p')} as recall, {r6('(n - tp) / (a - p)')} as fpr from t")
def topk_precision(spark, sf_dir):
    return rounded(M.curve_at_percentiles(claims(spark, sf_dir), "cdf_exp", "pos", 19), "cutoff", "precision", "recall", "fpr")


@query(_CURVE + f", r as (select tp / p as tpr, (n - tp) / (a - p) as fpr from t union all select 0, 0 union all select 1, 1), m as (select round(fpr, 9) as fpr, max(tpr) as tpr from r group by round(fpr, 9)) select {r6('sum(s)')} as area from (select (lead(fpr) over (order by fpr) - fpr) * (lead(tpr) over (order by fpr) + tpr) / 2 as s from m)")
def trapezoid_auc(spark, sf_dir):
    c = M.curve_at_percentiles(claims(spark, sf_dir), "cdf_exp", "pos", 19).select(F.round("fpr", 9).alias("fpr"), F.col("recall").alias("tpr"))
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    one = c.unionByName(ends).withColumn("g", F.lit(0))
    return rounded(M.trapezoid(one, ["g"], "fpr", "tpr").select("area"), "area")


_CURVE_99 = WITH + ", x as (select cdf_exp as s, pos from c where cdf_exp is not null), l as (select unnest(range(1, 100)) as level), q as (select quantile_cont(s, [" + ", ".join(f"{(i + 1) / 100}" for i in range(99)) + """]) as q from x),
k as (select level, q[level] as cutoff from l, q), t as (select level, cutoff, count(*) filter (where s >= cutoff) as n, sum(pos) filter (where s >= cutoff) as tp, count(*) as a, sum(pos) as p from k, x group by all)"""


@query(_CURVE_99 + f" select cast(level as integer) as level, {r6('cutoff')} as cutoff, {r6('tp / n')} as precision, {r6('tp / p')} as recall, {r6('(n - tp) / (a - p)')} as fpr from t")
def topk_precision_99(spark, sf_dir):
    """As topk_precision, at all 99 percentiles."""
    return rounded(M.curve_at_percentiles(claims(spark, sf_dir), "cdf_exp", "pos"), "cutoff", "precision", "recall", "fpr")


@query(_CURVE_99 + f", r as (select tp / p as tpr, (n - tp) / (a - p) as fpr from t union all select 0, 0 union all select 1, 1), m as (select round(fpr, 9) as fpr, max(tpr) as tpr from r group by round(fpr, 9)) select {r6('sum(s)')} as area from (select (lead(fpr) over (order by fpr) - fpr) * (lead(tpr) over (order by fpr) + tpr) / 2 as s from m)")
def trapezoid_auc_99(spark, sf_dir):
    """As trapezoid_auc, at all 99 percentiles."""
    c = M.curve_at_percentiles(claims(spark, sf_dir), "cdf_exp", "pos").select(F.round("fpr", 9).alias("fpr"), F.col("recall").alias("tpr"))
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    one = c.unionByName(ends).withColumn("g", F.lit(0))
    return rounded(M.trapezoid(one, ["g"], "fpr", "tpr").select("area"), "area")


@query(_B + f""", s as (select up, dn, year as x, cast(n as double) as y, lead(year) over w as x2, cast(lead(n) over w as double) as y2, row_number() over w = 1 as f, lead(year, 2) over w is null as l from b window w as (partition by up, dn order by year)),
g as (select unnest([1990e0, 2000e0, 2010e0]) as grid) select up, dn, grid, {r6('y + (grid - x) * (y2 - y) / (x2 - x)')} as value from s, g where x2 is not null and (grid >= x or f) and (grid < x2 or l)""")
def interp_roc(spark, sf_dir):
    b = _batches(spark, sf_dir).select("up", "dn", F.col("year").cast("double").alias("year"), F.col("n").cast("double").alias("n"))
    return rounded(M.interpolate(b, ["up", "dn"], "year", "n", [1990.0, 2000.0, 2010.0]), "value")


_PRED = WITH + ", x as (select pos as truth, cast(cdf_exp > 0.5 as integer) as predicted from c where cdf_exp is not null)"


def _predicted(spark, sf_dir):
    return claims(spark, sf_dir).where("cdf_exp is not null").select(F.col("pos").alias("truth"), (F.col("cdf_exp") > 0.5).cast("int").alias("predicted"))


@query(_PRED + " select truth, predicted, count(*) as n from x group by all")
def confusion(spark, sf_dir):
    return M.confusion(_predicted(spark, sf_dir), "truth", "predicted")


@query(_PRED + f", t as (select truth as cls, count(*) as support, sum(cast(truth = predicted as integer)) as h from x group by truth), p as (select predicted as cls, count(*) as p from x group by predicted) select cls, {r6('coalesce(h / p, 0)')} as precision, {r6('h / support')} as recall, {r6('case when h > 0 then 2 * (h / p) * (h / support) / (h / p + h / support) else 0 end')} as f1, support, {r6('(select avg(cast(truth = predicted as integer)) from x)')} as accuracy from t left join p using (cls)")
def classification_report(spark, sf_dir):
    return rounded(M.classification_report(_predicted(spark, sf_dir), "truth", "predicted"), "precision", "recall", "f1", "accuracy")


@query(WITH + f", r as (select origin, corr(pos, cdf_exp) as r, count(*) as n from c where cdf_exp is not null group by origin) select origin, {r6('tanh(atanh(r) - 1.959963985 / sqrt(n - 3))')} as low, {r6('tanh(atanh(r) + 1.959963985 / sqrt(n - 3))')} as high from r")
def corr_interval(spark, sf_dir):
    r = claims(spark, sf_dir).where("cdf_exp is not null").groupBy("origin").agg(F.corr("pos", "cdf_exp").alias("r"), F.count(F.lit(1)).alias("n"))
    low, high = M.fisher_interval(F.col("r"), F.col("n"))
    return rounded(r.select("origin", low.alias("low"), high.alias("high")), "low", "high")


@query(WITH + f"select journal, {r6('avg(ai)')} as mean, {r6('stddev_pop(ai)')} as std, {r6('quantile_cont(ai, 0.05)')} as p05, {r6('quantile_cont(ai, 0.95)')} as p95 from c where ai is not null group by journal")
def percentile_summary(spark, sf_dir):
    return rounded(M.summary(claims(spark, sf_dir).where("ai is not null"), ["journal"], "ai"), "mean", "std", "p05", "p95")


@query(WITH + f""", s as (select up, dn, sum(pos) as k, count(*) as n from c group by up, dn having count(*) >= 3), g as (select (i + 0.5) / 50e0 as x, i from range(50) r(i)), m as (select sum(k) / sum(n) as m from s),
l as (select up, dn, i, (k - 0.5) * ln(x) + (n - k - 0.5) * ln(1 - x) as la, (m * n - 0.5) * ln(x) + (n - m * n - 0.5) * ln(1 - x) as lb from s, g, m),
e as (select *, exp(la - max(la) over (partition by up, dn)) as a, exp(lb - max(lb) over (partition by up, dn)) as b from l), p as (select up, dn, i, a / sum(a) over (partition by up, dn) as a, b / sum(b) over (partition by up, dn) as b from e),
c2 as (select up, dn, abs(sum(a - b) over (partition by up, dn order by i)) as d from p) select up, dn, {r6('sum(d) / 50')} as distance from c2 group by up, dn""")
def wasserstein(spark, sf_dir):
    s = claims(spark, sf_dir).groupBy("up", "dn").agg(F.sum("pos").alias("k"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return rounded(M.beta_grid_distance(s).select("up", "dn", "distance"), "distance")


@query(WITH + f", x as (select journal, cdf_exp as v, cume_dist() over (partition by journal order by cdf_exp) as c, count(*) over (partition by journal) as n from c where cdf_exp is not null) select journal, {r6('max(greatest(abs(c - v), abs(v - (c - 1 / n))))')} as ks, count(*) as n from x group by journal")
def ks_uniform(spark, sf_dir):
    return rounded(M.ks_uniform(claims(spark, sf_dir).where("cdf_exp is not null"), ["journal"], "cdf_exp", first_of_ties=False), "ks")


@query(WITH + f", x as (select journal, cdf_exp as v, cume_dist() over (partition by journal order by cdf_exp) as c, rank() over (partition by journal order by cdf_exp) - 1 as below, count(*) over (partition by journal) as n from c where cdf_exp is not null) select journal, {r6('max(greatest(abs(c - v), abs(v - below / n)))')} as ks, count(*) as n from x group by journal")
def ks_exact(spark, sf_dir):
    """As ks_uniform, with ties counted from the first of them."""
    return rounded(M.ks_uniform(claims(spark, sf_dir).where("cdf_exp is not null"), ["journal"], "cdf_exp"), "ks")


@query(_B + f""", x as (select *, max(year) over (partition by up, dn) as last, coalesce(sum(n) over (partition by up, dn order by year desc rows between unbounded preceding and 1 preceding), 0) as newer from b)
select up, dn, cast(sum(k) as bigint) as k, cast(sum(n) as bigint) as n, min(year) as since, {r6('sum(k) / sum(n)')} as freq from x where year > last - 3 or newer < 2 group by up, dn""")
def time_interval_freq(spark, sf_dir):
    return rounded(B.terminal_interval(_batches(spark, sf_dir), 3), "freq")


@query(WITH + f", s as (select up, dn, sum(pos) as k, count(*) as n from c group by up, dn), l as (select *, ln(0.5) + k * ln(0.8) + (n - k) * ln(1 - 0.8) as a, ln(1 - 0.5) + k * ln(1 - 0.8) + (n - k) * ln(0.8) as b from s) select up, dn, {r6('greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))')} as loglik, {r6('1 / (1 + exp(greatest(-500, least(500, b - a))))')} as p_state from l")
def hidden_state(spark, sf_dir):
    return rounded(B.hidden_state_likelihood(_batches(spark, sf_dir)).select("up", "dn", "loglik", "p_state"), "loglik", "p_state")


@query(WITH + """, h as (select journal, cast(floor((cdf_exp - 0) / (1 - 0) * 10) + 1 as integer) as bin, count(*) as n from c where cdf_exp >= 0 and cdf_exp < 1 group by all), x as (select *, lag(bin) over w as lb, lag(n) over w as ln_, lead(bin) over w as rb, lead(n) over w as rn from h window w as (partition by journal order by bin))
select journal, bin, n from x where n >= (case when lb = bin - 1 then ln_ else 0 end) and n >= (case when rb = bin + 1 then rn else 0 end)""")
def local_maxima(spark, sf_dir):
    return B.local_maxima(claims(spark, sf_dir).where("cdf_exp is not null"), ["journal"], "cdf_exp", 0.0, 1.0, 10)


@query(WITH + f"select journal, {r6('quantile_cont(ai, 0.05)')} as low, {r6('quantile_cont(ai, 0.95)')} as high from c where ai is not null group by journal")
def trimmed_range(spark, sf_dir):
    return rounded(B.trimmed_range(claims(spark, sf_dir).where("ai is not null"), ["journal"], "ai", 0.1), "low", "high")


@query()
def mcmc_pi(spark, sf_dir):
    return B.mcmc_step(_batches(spark, sf_dir), 10000)


@query()
def citation_fit(spark, sf_dir):
    c = claims(spark, sf_dir).groupBy("journal", "year").agg(F.count(F.lit(1)).alias("n"))
    return B.lognormal_fit(c, ["journal"], "year", "n")


_STRAT = WITH + f", r as (select claim_id, pos, row_number() over (partition by pos order by {P.uniform_sql(0, 'claim_id')}, claim_id) as at_, count(*) over (partition by pos) as have from c), s as (select %s(n) as want from (select count(*) as n from c group by pos)), t as (select claim_id, pos, cast(floor((want - at_) / have) + 1 as integer) as times from r, s) select claim_id, pos, unnest(range(1, times + 1))::integer as copy_no from t where times > 0"


@query(_STRAT % "min")
def stratified(spark, sf_dir):
    c = claims(spark, sf_dir).select("claim_id", "pos")
    counts = {r["pos"]: r["count"] for r in c.groupBy("pos").count().collect()}
    return P.stratify(c, "pos", P.ratio_sizes(counts, {0: 1, 1: 1}), ["claim_id"])


@query(_STRAT % "max")
def oversampled(spark, sf_dir):
    c = claims(spark, sf_dir).select("claim_id", "pos")
    counts = {r["pos"]: r["count"] for r in c.groupBy("pos").count().collect()}
    return P.stratify(c, "pos", P.ratio_sizes(counts, {0: 1, 1: 1}, oversample=True), ["claim_id"])


@query(WITH + f", u as (select claim_id, up, dn, {P.uniform_sql(0, 'up', 'dn')} as u from c) select claim_id, up, dn, case when u < 0.6 then 'train' when u < 0.8 then 'valid' else 'test' end as split from u")
def group_split(spark, sf_dir):
    return P.group_split(claims(spark, sf_dir), ["up", "dn"], {"train": 0.6, "valid": 0.2, "test": 0.2}).select("claim_id", "up", "dn", "split")


_SEEDS = " union all ".join(f"select {t} as seed, claim_id, up, dn, pos, cast(floor({P.uniform_sql(t, 'up', 'dn')} * 3) as integer) as fold from c" for t in range(20))


@query(WITH + f", f as ({_SEEDS}), g as (select seed, fold, count(*) as n, count(distinct pos) as k from f group by all), v as (select seed from g group by seed having count(*) = 3 and min(k) > 1 and min(n) >= 0.2 / 3 * sum(n)) select claim_id, up, dn, pos, fold from f where seed = (select min(seed) from v)")
def kfold(spark, sf_dir):
    return P.valid_folds(claims(spark, sf_dir).select("claim_id", "up", "dn", "pos"), ["up", "dn"], 3, "pos")


@query(WITH + f", s as (select up, dn, count(*) as n from c group by up, dn), p as (select n, count(*) as c from s group by n), h as (select regr_slope(ln(c), ln(n)) as g from (select * from p order by n limit 5)), k as (select up, dn, n, -ln({P.uniform_sql(0, 'up', 'dn')} + 1e-18) / (pow(n, coalesce(g, 0)) / c) as key from s join p using (n), h), r as (select *, sum(n) over (order by key, up, dn) as upto from k) select claim_id, up, dn from c where (up, dn) in (select (up, dn) from r where upto - n < 0.3 * (select sum(n) from s))")
def sample_by_length(spark, sf_dir):
    return P.sample_by_length(claims(spark, sf_dir).select("claim_id", "up", "dn"), ["up", "dn"], 0.3)


@query(_B + f""", i as (select *, row_number() over (partition by up, dn order by year) as i, {P.uniform_sql(0, 'up', 'dn')} as u from b), s as (select *, sum(n) over (order by i, u, up, dn) as step from i)
select up, dn, year, k, n, step - n < (select sum(n) // 3 from b) as revealed, cast(step as bigint) as step from s""")
def history_growth(spark, sf_dir):
    b = _batches(spark, sf_dir)
    budget = b.agg(F.sum("n")).first()[0] // 3
    return P.grow_histories(b, ["up", "dn"], budget, "min")


def _features(spark, sf_dir):
    c = claims(spark, sf_dir).where("cdf_exp is not null and ai is not null and ar is not null")
    return P.folds(c.withColumn("wrong", (F.abs(F.col("cdf_exp") - F.col("pos")) >= 0.5).cast("int")).withColumn("y", F.col("year").cast("double")).withColumn("p", F.col("pos").cast("double")), ["up", "dn"], 3)


_COLS = ["ai", "ar", "y", "p"]


@query()
def forest_auc(spark, sf_dir):
    x = L.assemble(_features(spark, sf_dir), _COLS, "wrong").cache()
    rows = L.cross_validated(x, "fold", lambda t: L.fit_forest(t, 10, 4))
    x.unpersist()
    return spark.createDataFrame([(int(k), float(v) if v is not None else None) for k, v in rows], "fold int, auc double")


@query()
def forest_importance(spark, sf_dir):
    m = L.fit_forest(L.assemble(_features(spark, sf_dir), _COLS, "wrong"), 10, 4)
    return spark.createDataFrame(L.importances(m, _COLS), "feature string, importance double")


@query()
def lasso_path(spark, sf_dir):
    x = L.assemble(_features(spark, sf_dir), _COLS, "wrong").cache()
    rows = L.lasso_path(x, [0.1, 0.03, 0.01, 0.001])
    x.unpersist()
    return spark.createDataFrame(rows, "penalty double, nonzero int, coefficients array<double>")


@query()
def logit_p_values(spark, sf_dir):
    x = L.assemble(_features(spark, sf_dir), _COLS, "wrong")
    m = L.fit_lasso(x, 0.0)
    return spark.createDataFrame([(n, float(p)) for n, p in L.logit_p_values(x, _COLS, m.coefficients.toArray().tolist(), m.intercept)], "feature string, p double")


@query()
def linear_model(spark, sf_dir):
    m = L.fit_linear(L.assemble(_features(spark, sf_dir), _COLS, "cdf_exp"), 0.001)
    return spark.createDataFrame(list(zip(_COLS, m.coefficients.toArray().tolist())), "feature string, coefficient double")


@query()
def kmeans(spark, sf_dir):
    x = _features(spark, sf_dir).select("claim_id", "ai", "ar")
    return L.kmeans(x, ["ai", "ar"], 4)


@query()
def gap(spark, sf_dir):
    x = _features(spark, sf_dir).select("ai", "ar").cache()
    rows = L.gap_statistic(x, ["ai", "ar"], [1, 2, 3, 4], 10)
    x.unpersist()
    return spark.createDataFrame(rows, "k int, gap double, deviation double")


@query()
def leader_clusters(spark, sf_dir):
    orgs = table(spark, sf_dir, "claims").select(F.explode(X.affiliation_units("affs")).alias("org")).distinct()
    return L.leader_clusters(orgs, "org", 0.2)


@query("select claim_id, up, dn, pmid, year from claims where year > 0")
def csv_round_trip(spark, sf_dir):
    """Claims written as gzip CSV and partitioned by year as parquet, then read with a declared schema."""
    df = table(spark, sf_dir, "claims").select("claim_id", "up", "dn", "pmid", "year").where("year > 0")
    path = f"{shared_folder(spark)}/claimweave/{uuid.uuid4().hex}"
    files.write_csv(df, path + "-csv")
    files.write_keyed(files.read_csv(spark, path + "-csv", df.schema), path + "-by-year", ["year"])
    return files.read_keyed(spark, path + "-by-year").select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes])


@query("select up, dn, year, count(*) as n, cast(sum(case when pos in (0, 1) then cast(pos as bigint) end) as bigint) as k from claims where up > 0 and dn > 0 and year > 0 and pos in (0, 1) group by all")
def streamed_batches(spark, sf_dir):
    return claim_stream.batch_counts_of(spark, f"{sf_dir}/claims.parquet")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events where ts is not null group by all")
def streamed_windows(spark, sf_dir):
    return claim_stream.event_windows(spark, f"{sf_dir}/events.parquet", "1 hour")
