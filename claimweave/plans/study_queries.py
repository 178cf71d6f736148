"""Queries of studies over levels, bins and thresholds, of reports, and of estimates with their intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import math as M
from claimweave.functions.math import half_up
from claimweave.operators import aggregates as A
from claimweave.operators import estimates as E
from claimweave.operators import metrics as Q
from claimweave.operators import relational as R
from claimweave.operators import sampling as P
from claimweave.operators import windows as W
from claimweave.sources.claims import WITH, claims, experiments

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


_T = "[" + ", ".join(repr(v) for v in M.t_table()) + "]"
_Z = 1.959963984540054
_FAR = f"({_Z!r} + {(_Z**3 + _Z) / 4!r} / (n - 1) + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / pow(n - 1, 2) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / pow(n - 1, 3))"
_HALF = f"(case when n <= 201 then list_extract({_T}, cast(n - 1 as integer)) else {_FAR} end / sqrt(n - 3))"
_EXP = "e as (select * from experiments where score is not null and isfinite(score) and up > 0 and dn > 0)"


@query(WITH + f""", x as (select case when ar < 2 then 0 when ar < 4 then 1 when ar < 6 then 2 when ar < 8 then 3 else 4 end as bin, cdf_exp, cast(pos as double) as pos, ai from c where cdf_exp is not null and ar is not null and ai is not null),
g as (select bin, count(*) as n, avg(cdf_exp) as mean_cdf_exp, stddev_pop(cdf_exp) as std_cdf_exp, avg(pos) as mean_pos, stddev_pop(pos) as std_pos, avg(ai) as mean_ai, stddev_pop(ai) as std_ai, corr(cdf_exp, pos) as corr_pos, corr(cdf_exp, ai) as corr_ai from x group by bin having count(*) > 4)
select bin, n, """ + ", ".join(f"{r6(c)} as {c}" for c in ("mean_cdf_exp", "std_cdf_exp", "mean_pos", "std_pos", "mean_ai", "std_ai", "corr_pos", "corr_ai")) + ", " + ", ".join(
    f"{r6(f'tanh(atanh(corr_{c}) {s} {_HALF})')} as {b}_{c}" for c in ("pos", "ai") for b, s in (("low", "-"), ("high", "+"))) + " from g")
def binned_estimates(spark, sf_dir):
    """Per bin of the rating: correlation of the experiment with two estimates, each with its interval."""
    x = R.in_bins(claims(spark, sf_dir).where("cdf_exp is not null").withColumn("pos", F.col("pos").cast("double")), "ar", [0.0, 2.0, 4.0, 6.0, 8.0, 11.0])
    out = A.binned_estimates(x, "bin", "cdf_exp", ["pos", "ai"])
    return rounded(out, *[c for c in out.columns if c not in ("bin", "n")])


@query(WITH + f", {_EXP}, s as (select up, dn, cell_id, avg(score) as mean, stddev_pop(score) as std, count(*) as n from e where pert_type <> 'ctl' group by all having count(*) > 1), r as (select up, dn, avg(pos) as freq from c group by up, dn) select up, dn, cell_id, {r6('mean')} as mean, {r6('std')} as std, n, {r6('freq')} as freq from s join r using (up, dn)")
def cross_section(spark, sf_dir):
    """Scores per pair and cell, with conditions on rows and on groups, joined to the claims' frequency."""
    r = claims(spark, sf_dir).groupBy("up", "dn").agg(F.avg("pos").alias("freq"))
    return rounded(A.cross_section(experiments(spark, sf_dir), ["up", "dn", "cell_id"], "score", F.col("pert_type") != "ctl", F.col("n") > 1, r), "mean", "std", "freq")


@query(WITH + " select * from (" + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is not null and cdf_exp is not null) as n, {r6(f'corr({c}, cdf_exp)')} as corr from c" for c in ("pos", "ai", "ar", "year", "pmid")) + ") where abs(corr) >= 0.005")
def pairwise_correlations(spark, sf_dir):
    """Correlations with the experiment, each over the rows that have both columns."""
    c = claims(spark, sf_dir).withColumns({x: F.col(x).cast("double") for x in ("pos", "year", "pmid")})
    return rounded(A.pairwise_correlations(c, "cdf_exp", ["pos", "ai", "ar", "year", "pmid"]), "corr").where("abs(corr) >= 0.005")


@query(WITH + " select covariate, corr from (" + " union all ".join(f"select '{c}' as covariate, {r6(f'corr(ai, {c})')} as corr from c" for c in ("ar", "cdf_exp", "pos")) + ")")
def covariates(spark, sf_dir):
    """All columns that go with the article influence, from the table of all pairs."""
    c = claims(spark, sf_dir).withColumn("pos", F.col("pos").cast("double"))
    return rounded(A.covariates(A.correlation_table(c, ["ar", "ai", "cdf_exp", "pos"]), "ai"), "corr")


_LEVELS = [i / 20 for i in range(1, 21)]


@query(WITH + f", x as (select up, dn, cdf_exp as s, pos as v from c where cdf_exp is not null), g as (select min(s) as s from x group by up, dn), q as (select unnest({_LEVELS}) as level, unnest((select quantile_cont(s, {_LEVELS}) from g)) as lo) select cast(level as double) as level, count(*) as n, {r6('corr(v, s)')} as corr from x, q where s <= lo group by level having count(*) > 2")
def one_tail_sweep(spark, sf_dir):
    return rounded(A.one_tail_sweep(claims(spark, sf_dir), ["up", "dn"], "cdf_exp", "pos", _LEVELS), "corr")


@query(WITH + ", l as (select list(ai order by ai) as l, quantile_cont(ai, 0.25) as a, quantile_cont(ai, 0.75) as b from c where ai is not null), r as (select *, (1 - (select avg(pos) from c)) * (len(l) - 1) as r from l), q as (select a, b, l[cast(floor(r) as integer) + 1] + (l[cast(ceil(r) as integer) + 1] - l[cast(floor(r) as integer) + 1]) * (r - floor(r)) as m from r) select claim_id, cast(ai > a as integer) as ai_0, cast(ai > b as integer) as ai_1, cast(ai > m as integer) as ai_mean from c, q")
def threshold_flags(spark, sf_dir):
    """Flags above percentiles, one of them at the share of negative claims."""
    return A.threshold_flags(claims(spark, sf_dir), "ai", [0.25, 0.75], "pos").select("claim_id", "ai_0", "ai_1", "ai_mean")


_MA = WITH + """, x as (select *, cast(abs(cdf_exp - pos) < 0.5 as integer) as right_, cast(cdf_exp >= 0.5 as integer) as truth from c where cdf_exp is not null),
b as (select up, dn, year, sum(right_) as k, count(*) as n from x group by all), y as (select year, sum(pos) as k, count(*) as n from x group by year),
o as (select up, dn, year, sum(k) over w2 / sum(n) over w2 as r2, sum(k) over wa / sum(n) over wa as ra from b window w2 as (partition by up, dn order by year rows between 2 preceding and 1 preceding), wa as (partition by up, dn order by year rows between unbounded preceding and 1 preceding)),
g as (select year, coalesce(sum(k) over w2 / sum(n) over w2, 0.5) as c2, coalesce(sum(k) over wa / sum(n) over wa, 0.5) as ca from y window w2 as (order by year rows between 2 preceding and 1 preceding), wa as (order by year rows between unbounded preceding and 1 preceding))"""


@query(_MA + " select claim_id, " + ", ".join(f"{r6(f'coalesce(r{w}, case when (truth = 1) = (c{w} >= 0.5) then c{w} else 1 - c{w} end)')} as right_ma_{n}, {r6(f'c{w}')} as pos_ma_{n}" for w, n in (("2", "2"), ("a", "all"))) + " from x join o using (up, dn, year) join g using (year)")
def attached_averages(spark, sf_dir):
    """Moving averages of an interaction's right claims and of all claims, with the rule for first years."""
    c = claims(spark, sf_dir).where("cdf_exp is not null").withColumn("right", (F.abs(F.col("cdf_exp") - F.col("pos")) < 0.5).cast("int")).withColumn("truth", (F.col("cdf_exp") >= 0.5).cast("int"))
    x = W.attach_moving_averages(c, "right", "pos", "truth", [2, None])
    return rounded(x.select("claim_id", "right_ma_2", "pos_ma_2", "right_ma_all", "pos_ma_all"), "right_ma_2", "pos_ma_2", "right_ma_all", "pos_ma_all")


@query(WITH + f", s as (select up, dn, sum(pos) as k, count(*) as n, avg(cdf_exp) as q from c group by up, dn), t as (select q >= 0.5 as f, greatest(avg(k), 0.5) as a, greatest(avg(n - k), 0.5) as b from s where q is not null group by all), ab as (select max(a) filter (where f) as ap, max(b) filter (where f) as bp, max(a) filter (where not f) as an, max(b) filter (where not f) as bn from t), o as (select up, dn, lgamma(k + ap) + lgamma(n - k + bp) - lgamma(n + ap + bp) - (lgamma(ap) + lgamma(bp) - lgamma(ap + bp)) - (lgamma(k + an) + lgamma(n - k + bn) - lgamma(n + an + bn) - (lgamma(an) + lgamma(bn) - lgamma(an + bn))) as odds from s, ab) select up, dn, {r6('1 / (1 + exp(-greatest(-500, least(500, odds))))')} as p_positive from o")
def beta_from_split(spark, sf_dir):
    """Beta-binomial estimate with real parameters found from the interactions on either side of the experiment."""
    c = claims(spark, sf_dir)
    train = R.with_group_stats(c, ["up", "dn"], q=F.avg("cdf_exp")).withColumn("flag", (F.col("q") >= 0.5).cast("int"))
    p = A.split_beta_parameters(train, "flag")
    return rounded(A.beta_binomial_positive(A.interaction_stats(c).select("up", "dn", "k", "n"), **p).select("up", "dn", "p_positive"), "p_positive")


_GROW = WITH + f", b as (select up, dn, year, cast(sum(pos) as bigint) as k, count(*) as n from c group by up, dn, year), i as (select *, row_number() over (partition by up, dn order by year) as i, {P.uniform_sql(0, 'up', 'dn')} as u from b), s as (select *, sum(n) over (order by i, u, up, dn) as step from i), r as (select *, step - n < (select sum(n) // 3 from b) as revealed from s)"


@query(_GROW + " select up, dn, cast(coalesce(sum(n) filter (where revealed), 0) as bigint) as filled, cast(sum(n) as bigint) as potential, count(*) filter (where revealed) as batches_filled, count(*) as batches from r group by up, dn")
def filled_sizes(spark, sf_dir):
    b = W.batches(claims(spark, sf_dir), "pos")
    return A.filled_sizes(P.grow_histories(b, ["up", "dn"], b.agg(F.sum("n")).first()[0] // 3, "min"), "revealed")


@query(WITH + f", p as (select *, (0.1 + 0.8 * coalesce(cdf_exp, 0.5)) as q from c), v as (select up, dn, pos, pos * q + (1 - pos) * (1 - q) as pi from p), m as (select avg(pos) as m from v) select up, dn, {r6('avg(pos)')} as mean_pos, {r6('avg(pi)')} as mean_pi, {r6('coalesce(sum(abs(pi - m) * pi) / nullif(sum(abs(pi - m)), 0), avg(pi))')} as weighted_pi, {r6('coalesce(sum(sqrt(abs(pi - 0.5)) * pi) / nullif(sum(sqrt(abs(pi - 0.5))), 0), avg(pi))')} as rank_pi, count(*) as n from v, m group by up, dn")
def interaction_estimates(spark, sf_dir):
    q = 0.1 + 0.8 * F.coalesce("cdf_exp", F.lit(0.5))
    out = E.interaction_estimates(E.claim_validity(claims(spark, sf_dir).withColumn("p", F.array(1 - q, q)), "p"))
    return rounded(out, "mean_pos", "mean_pi", "weighted_pi", "rank_pi")


_INV = WITH + ", p as (select up, dn, claim_id, pos, [0.2 + 0.3 * coalesce(cdf_exp, 0.5), 0.3, 0.5 - 0.3 * coalesce(cdf_exp, 0.5)] as q from c)"


@query(_INV + " select claim_id, " + ", ".join(f"{r6(f'(1 - pos) * q[{j + 1}] + pos * q[{3 - j}]')} as pe_{j}" for j in range(3)) + " from p")
def inverted_bayes(spark, sf_dir):
    q = F.coalesce("cdf_exp", F.lit(0.5))
    c = claims(spark, sf_dir).withColumn("p", F.array(0.2 + 0.3 * q, F.lit(0.3), 0.5 - 0.3 * q))
    return rounded(E.invert_bayes(c, "p", 3).select("claim_id", "pe_0", "pe_1", "pe_2"), "pe_0", "pe_1", "pe_2")


@query(WITH + f", z as (select claim_id, case when cdf_exp < 0.3 then 0 else cdf_exp end as a, case when cdf_exp < 0.3 then 1 else 1 - cdf_exp end as b from c where cdf_exp is not null), y as (select claim_id, case when a <= 0 then 0.001 else a end as a, case when b <= 0 then 0.001 else b end as b from z) select claim_id, {r6('a / (a + b)')} as p from y")
def zeros_replaced(spark, sf_dir):
    c = claims(spark, sf_dir).where("cdf_exp is not null")
    low = F.col("cdf_exp") < 0.3
    p = M.replace_zeros(F.array(F.when(low, 0.0).otherwise(F.col("cdf_exp")), F.when(low, 1.0).otherwise(1 - F.col("cdf_exp"))), 1e-3)
    return rounded(c.select("claim_id", p[0].alias("p")), "p")


@query(WITH + f", p as (select up, dn, cdf_exp, case when pos = 1 then 1 - 1 / (1 + exp(-(ai - 2))) else 1 / (1 + exp(-(ai - 2))) end as p from c where ai is not null), i as (select up, dn, avg(p) as pi, avg(cdf_exp) as q from p group by up, dn), j as (select * from i where q is not null) select {r6('avg(pow(q - pi, 2))')} as mse, {r6('1 - avg(pow(q - pi, 2)) / var_pop(q)')} as r2 from j")
def score_fit(spark, sf_dir):
    """Mean probability per interaction from claim scores, and how well it meets the experiment."""
    c = claims(spark, sf_dir).where("ai is not null").withColumn("score", F.col("ai") - 2)
    q = c.groupBy("up", "dn").agg(F.avg("cdf_exp").alias("q"))
    return rounded(A.fit_quality(A.inverse_logit_means(c, "score").join(q, ["up", "dn"]), "q", "pi"), "mse", "r2")


@query(WITH + f", s as (select up, dn, sum(pos) as k, count(*) as n from c group by up, dn), m as (select sum(k) / sum(n) as m from s), g as (select (i + 0.5) / 50e0 as x, i from range(50) r(i)), l as (select up, dn, i, (k - 0.5) * ln(x) + (n - k - 0.5) * ln(1 - x) as la, (m * n - 0.5) * ln(x) + (n - m * n - 0.5) * ln(1 - x) as lb from s, g, m), t as (select *, max(la) over w as ma, max(lb) over w as mb from l window w as (partition by up, dn)), u as (select *, la - ma - ln(sum(exp(la - ma)) over w) as p, lb - mb - ln(sum(exp(lb - mb)) over w) as q from t window w as (partition by up, dn)) select up, dn, {r6('sum(exp(p) * (p - q))')} as kl from u group by up, dn")
def kl_distance(spark, sf_dir):
    s = claims(spark, sf_dir).groupBy("up", "dn").agg(F.sum("pos").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(Q.kl_distance(s).select("up", "dn", "kl"), "kl")


_FOLD = f"cast(floor({P.uniform_sql(0, 'up', 'dn')} * 4) as integer) as fold"


@query(WITH + f", f as (select *, {_FOLD} from c), r as (select origin, fold, avg(pos) as mean_pos, avg(ai) as mean_ai from f group by all), l as (select fold, 'pos' as metric, mean_pos as v from r union all select fold, 'ai', mean_ai from r where mean_ai is not null) select fold, metric, round(avg(v) + 1e-9, 4) as mean from l group by all")
def scalar_metrics(spark, sf_dir):
    r = P.folds(claims(spark, sf_dir), ["up", "dn"], 4).groupBy("origin", "fold").agg(F.avg("pos").alias("pos"), F.avg("ai").alias("ai"))
    return Q.scalar_metrics(r.unpivot(["fold"], ["pos", "ai"], "metric", "v").where("v is not null"), "fold", "metric", "v")


@query(WITH + f", f as (select *, {_FOLD} from c), r as (select fold, avg(pos) as a, avg(ai) as b, avg(ar) as d from f group by fold) select least(arg_max(fold, round(a, 9)), arg_max(fold, round(b, 9)), arg_max(fold, round(d, 9))) as run from r")
def good_run(spark, sf_dir):
    """The first of the folds that are best by one of three means."""
    r = P.folds(claims(spark, sf_dir), ["up", "dn"], 4).groupBy("fold").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("pos", "ai", "ar")])
    return spark.createDataFrame([(Q.pick_good_run(r, "fold", ["pos", "ai", "ar"]),)], "run int")


@query(WITH + f", x as (select cdf_exp as s, pos from c where cdf_exp is not null), q as (select quantile_cont(s, [{', '.join(f'{(i + 1) / 100}' for i in range(99))}]) as q from x), t as (select l.level, count(*) filter (where s >= q[l.level]) as n, sum(pos) filter (where s >= q[l.level]) as tp, sum(pos) as p from x, q, (select unnest(range(1, 100)) as level) l group by l.level), k as (select cast(level as integer) as level, tp / n as precision, tp / p as recall from t) select arg_min(level, level) as level, {r6('arg_min(precision, level)')} as precision, {r6('arg_min(recall, level)')} as recall from k where recall <= 0.8")
def recall_pick(spark, sf_dir):
    """The first percentile at which the recall is no longer above four fifths."""
    curve = Q.curve_at_percentiles(claims(spark, sf_dir), "cdf_exp", "pos")
    return rounded(Q.first_level_below(curve, 0.8), "precision", "recall")


_HB = "-(cdf_exp * ln(cdf_exp) + (1 - cdf_exp) * ln(1 - cdf_exp))"


@query(WITH + f", h as (select case when cdf_exp > 0 and cdf_exp < 1 then {_HB} else 0 end as h from c where cdf_exp is not null) select {r6('sum(h)')} as entropy, {r6('avg(h)')} as mean_entropy from h")
def claim_entropy(spark, sf_dir):
    return rounded(Q.probability_entropy(claims(spark, sf_dir).where("cdf_exp is not null"), "cdf_exp"), "entropy", "mean_entropy")


@query(WITH + f"select claim_id, {r6('exp(-0.5 * pow((ai - 2) / 1.5, 2)) / (1.5 * sqrt(2 * pi()))')} as normal, {r6('case when ai > 0.5 then exp(-0.5 * pow((ln(ai - 0.5) - 0.4) / 0.8, 2)) / ((ai - 0.5) * 0.8 * sqrt(2 * pi())) else 0 end')} as shifted, {r6('case when ai > 0 then 3 * exp(-0.5 * pow((ln(ai) - 0.4) / 0.8, 2)) / (ai * 0.8 * sqrt(2 * pi())) else 0 end + 0.25')} as curve, {r6('trunc((ai - 0.1) / 0.25 + 0.5) * 0.25 + 0.1')} as grid, {r6('ln(ar + 0.5) - ln(10.5 - ar)')} as inside, {r6('ar')} as back from c where ai is not null and ar is not null")
def densities(spark, sf_dir):
    """Normal, shifted and scaled log-normal densities, rounding to a grid, and a bounded number mapped to the line and back."""
    c = claims(spark, sf_dir).where("ai is not null and ar is not null")
    inside = M.interval_forward(F.col("ar"), -0.5, 10.5)
    x = c.select("claim_id", M.normal_density(F.col("ai"), 2.0, 1.5).alias("normal"), M.shifted_lognormal(F.col("ai"), 0.4, 0.8, 0.5).alias("shifted"), M.lognormal_curve(F.col("ai"), 0.4, 0.8, 3.0, 0.25).alias("curve"),
                 M.round_to_grid(F.col("ai"), 0.25, 0.1).alias("grid"), inside.alias("inside"), M.interval_backward(inside, -0.5, 10.5).alias("back"))
    return rounded(x, "normal", "shifted", "curve", "grid", "inside", "back")


@query(WITH + f", s as (select up, dn, sum(pos) as k, count(*) as n from c group by up, dn), p as (select up, dn, (k + 1) / (n + 3) as a, (n - k + 1) / (n + 3) as b, 1 / (n + 3) as d from s) select up, dn, {r6('ln(a / (1 - a)) + ln(2)')} as y0, {r6('ln(b / (1 - a) / (1 - b / (1 - a)))')} as y1, {r6('a')} as a, {r6('b')} as b, {r6('d')} as d from p")
def stick_breaking(spark, sf_dir):
    """Shares as free numbers by stick-breaking, and back."""
    s = claims(spark, sf_dir).groupBy("up", "dn").agg(F.sum("pos").alias("k"), F.count(F.lit(1)).alias("n"))
    shares = [(F.col("k") + 1) / (F.col("n") + 3), (F.col("n") - F.col("k") + 1) / (F.col("n") + 3), 1 / (F.col("n") + 3)]
    y = M.stick_forward(shares)
    x = s.select("up", "dn", *[v.alias(f"y{i}") for i, v in enumerate(y)], *[v.alias(n) for n, v in zip("abd", M.stick_backward(y))])
    return rounded(x, "y0", "y1", "a", "b", "d")
