"""Queries of filters, joins, windows and aggregates over the claim tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.math import half_up, norm_cdf, norm_cdf_sql, norm_ppf
from claimweave.operators import aggregates as A
from claimweave.operators import relational as R
from claimweave.operators import windows as W
from claimweave.operators.sampling import uniform_sql
from claimweave.sources.claims import READINGS_SQL, WITH, claims, experiments, readings
from claimweave.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c)) for c in columns})


def _batches(spark, sf_dir):
    return W.batches(claims(spark, sf_dir), "pos")


_B = WITH + ", b as (select up, dn, year, cast(sum(pos) as bigint) as k, count(*) as n from c group by up, dn, year)"
r6 = lambda x: f"round({x} + 1e-9, 6)"


@query(_B + f""", o as (select *, {r6('sum(k) over w / sum(n) over w')} as obs_mu from b
  window w as (partition by up, dn order by year rows between unbounded preceding and 1 preceding)),
i as (select up, dn, sum(k) / sum(n) as mu, sum(n) as n_claims, min(year) as first_year from b group by up, dn),
p as (select *, (rank() over (order by mu) + (count(*) over (partition by mu) - 1) / 2e0) / count(*) over () as pct from i)
select up, dn, year, k, n, obs_mu, year = first_year as t0, {r6('mu')} as mu, cast(n_claims as bigint) as n_claims, {r6('pct')} as pct from o join p using (up, dn)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with the running prior of earlier years, the first-year flag, and the interaction's
    mean, size and percentile rank."""
    b = _batches(spark, sf_dir)
    i = b.groupBy("up", "dn").agg((F.sum("k") / F.sum("n")).alias("mu"), F.sum("n").alias("n_claims"), F.min("year").alias("first_year"))
    i = W.percent_ranks(i, "mu", "pct")
    out = W.moving_average(b, None, "obs_mu").join(i, ["up", "dn"]).withColumn("t0", F.col("year") == F.col("first_year"))
    return rounded(out.select("up", "dn", "year", "k", "n", "obs_mu", "t0", "mu", "n_claims", "pct"), "obs_mu", "mu", "pct")


@query(WITH + "select claim_id, up, dn, pmid, year, pos from c")
def claims_dedup(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_id", "up", "dn", "pmid", "year", "pos")


@query("with " + READINGS_SQL + " select claim_id, pos, cdf_exp, ar from readings where (cdf_exp >= 0.75 or cdf_exp <= 0.25) and ar > 5")
def claims_masked(spark, sf_dir):
    return R.mask_out(readings(spark, sf_dir), 0.25, [("ar", 5.0, lambda c, t: c > t)]).select("claim_id", "pos", "cdf_exp", "ar")


@query("with " + READINGS_SQL + " select claim_id, ai from readings where ai is not null and ai <> (select ai from readings where ai is not null group by ai order by count(*) desc, ai limit 1)")
def mode_excluded(spark, sf_dir):
    return R.mode_excluded(readings(spark, sf_dir), "ai").select("claim_id", "ai")


@query("with " + READINGS_SQL + " select claim_id, ai, ar, cdf_exp from readings where ai is not null and ar is not null and cdf_exp is not null and ar > 0 and ai > 0.9")
def complete_rows(spark, sf_dir):
    return R.complete_rows(readings(spark, sf_dir), ["ai", "ar", "cdf_exp", "absent"]).where("ar > 0 and ai > 0.9").select("claim_id", "ai", "ar", "cdf_exp")


@query(WITH + "select claim_id from c where (up, dn) in (select (up, dn) from c group by up, dn having count(*) > 5)")
def long_histories(spark, sf_dir):
    return R.long_histories(claims(spark, sf_dir), 5).select("claim_id")


@query("with " + READINGS_SQL + " select claim_id from readings r where origin = 'gw' and not exists (select 1 from readings s where s.origin = 'lit' and s.up = r.up and s.dn = r.dn and s.pmid = r.pmid)")
def tuple_anti(spark, sf_dir):
    r = readings(spark, sf_dir)
    return R.member(r.where("origin = 'gw'"), r.where("origin = 'lit'"), ["up", "dn", "pmid"], negate=True).select("claim_id")


@query(WITH + "select claim_id, entrez_id as gene from c join (select distinct entrez_id from gene_ids where entrez_id is not null) g on c.up = g.entrez_id")
def known_genes(spark, sf_dir):
    g = table(spark, sf_dir, "gene_ids").select(F.col("entrez_id").alias("up")).where("up is not null")
    return R.member(claims(spark, sf_dir), g, ["up"]).select("claim_id", F.col("up").alias("gene"))


@query(WITH + "select pos <> 0 as positive, count(*) as n from c group by all")
def halves(spark, sf_dir):
    a, b = R.halves(claims(spark, sf_dir), "pos")
    return R.labelled_union({"y": a, "n": b}, "half").groupBy((F.col("half") == "y").alias("positive")).agg(F.count(F.lit(1)).alias("n"))


@query("with " + READINGS_SQL + " select claim_id, case when ai < 1 then 0 when ai < 2 then 1 when ai < 4 then 2 else 3 end as bin from readings where ai >= 0 and ai < 10")
def range_bins(spark, sf_dir):
    return R.in_bins(readings(spark, sf_dir), "ai", [0.0, 1.0, 2.0, 4.0, 10.0]).select("claim_id", "bin")


@query("with " + READINGS_SQL + " select claim_id, case when ai < 1 then 0 when ai < 2 then 1 when ai < 4 then 2 when ai < 10 then 3 else 4 end as bin from readings where ai is not null")
def range_bins_all(spark, sf_dir):
    """As range_bins, with a bin from 10 to the end of the range (40)."""
    return R.in_bins(readings(spark, sf_dir), "ai", [0.0, 1.0, 2.0, 4.0, 10.0, 41.0]).select("claim_id", "bin")


@query("with " + READINGS_SQL + " select distinct up, dn, year from readings where origin = 'gw' and pos = 0")
def equality_spec(spark, sf_dir):
    return R.matching(readings(spark, sf_dir), {"origin": "gw", "pos": 0}, ["up", "dn", "year"])


@query("select pert_type, cell_id, is_touchstone, count(*) as n from experiments group by all having count(*) > 10")
def filter_grid(spark, sf_dir):
    return R.grid_counts(table(spark, sf_dir, "experiments"), ["pert_type", "cell_id", "is_touchstone"], 10)


_TWO = "with " + READINGS_SQL + """, f as (select up, dn, pmid, pos, origin from readings qualify row_number() over (partition by origin, up, dn, pmid order by year, claim_id) = 1),
gw as (select * from f where origin = 'gw'), lit as (select * from f where origin = 'lit')"""


@query(_TWO + """, bad as (select gw.up, gw.dn, gw.pmid from gw join lit using (up, dn, pmid) where gw.pos <> lit.pos)
select up, dn, pmid, pos, 'gw' as origin from gw anti join bad using (up, dn, pmid)
union all select up, dn, pmid, pos, 'lit' from (select * from lit anti join gw using (up, dn, pmid)) anti join bad using (up, dn, pmid)""")
def conflict_union(spark, sf_dir):
    r = R.first_by(readings(spark, sf_dir), ["origin", "up", "dn", "pmid"], ["year", "claim_id"])
    return R.conflict_union(r.where("origin = 'gw'"), r.where("origin = 'lit'"), ["up", "dn", "pmid"], "pos", ("gw", "lit"))


@query(_B + ", i as (select up, dn, sum(k) / sum(n) as mu, min(year) as year from b group by up, dn) select b.up, b.dn, b.year, round(coalesce(case when i.mu >= 0.5 then i.mu end, b.k / b.n) + 1e-9, 6) as m from b left join i using (up, dn, year)")
def update_join(spark, sf_dir):
    b = _batches(spark, sf_dir)
    i = b.groupBy("up", "dn").agg((F.sum("k") / F.sum("n")).alias("m"), F.min("year").alias("year")).withColumn("m", F.when(F.col("m") >= 0.5, F.col("m")))
    return rounded(R.update_join(b.select("up", "dn", "year", (F.col("k") / F.col("n")).alias("m")), i, ["up", "dn", "year"], ["m"]), "m")


@query("with " + READINGS_SQL + """, l as (select up, dn, year, claim_id from readings where origin = 'gw'), r as (select up, dn, year, sum(pos) / count(*) as m from readings where origin = 'lit' group by all)
select l.claim_id, round(r.m + 1e-9, 6) as prior from l left join r on l.up = r.up and l.dn = r.dn and r.year < l.year qualify row_number() over (partition by l.claim_id order by r.year desc nulls last) = 1""")
def asof_prev_year(spark, sf_dir):
    r = readings(spark, sf_dir)
    right = r.where("origin = 'lit'").groupBy("up", "dn", "year").agg((F.sum("pos") / F.count("pos")).alias("m"))
    return rounded(R.asof_previous(r.where("origin = 'gw'"), right, ["up", "dn"], "year", "m", "prior").select("claim_id", "prior"), "prior")


@query(WITH + ", y as (select distinct up, dn, year as look from c) select up, dn, look, count(*) as n, cast(sum(pos) as bigint) as k from c join y using (up, dn) where year <= look and year > look - 3 group by all")
def window_value_join(spark, sf_dir):
    return R.value_windows(claims(spark, sf_dir).select("up", "dn", "year", "pos"), ["up", "dn"], "year", 3).groupBy("up", "dn", "look").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("k"))


@query(WITH + """, y as (select up, dn, year, dense_rank() over (partition by up, dn order by year) as r from (select distinct up, dn, year from c))
select a.up, a.dn, a.year as look, count(*) as n, cast(sum(pos) as bigint) as k from y a join y b on a.up = b.up and a.dn = b.dn and b.r <= a.r and b.r > a.r - 3 join c on c.up = b.up and c.dn = b.dn and c.year = b.year group by all""")
def window_rank_join(spark, sf_dir):
    return R.rank_windows(claims(spark, sf_dir).select("up", "dn", "year", "pos"), ["up", "dn"], "year", 3).groupBy("up", "dn", "look").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("k"))


@query(WITH + """, g as (select up as gene, up % 50 as comm from c union select dn, dn % 50 from c), s as (select *, count(*) over (partition by comm) as size from g)
select c.claim_id, cast(u.comm = d.comm as integer) as same_comm, round(sqrt(u.size * d.size) + 1e-9, 6) as eff_comm_size from c join s u on u.gene = c.up join s d on d.gene = c.dn""")
def two_role_community(spark, sf_dir):
    c = claims(spark, sf_dir)
    g = c.select(F.col("up").alias("gene")).union(c.select("dn")).distinct().withColumn("comm", F.col("gene") % 50)
    g = R.with_group_stats(g, ["comm"], size=F.count(F.lit(1)))
    out = R.role_join(c, g, "gene", ["comm", "size"])
    return rounded(out.select("claim_id", (F.col("comm_up") == F.col("comm_dn")).cast("int").alias("same_comm"), F.sqrt(F.col("size_up") * F.col("size_dn")).alias("eff_comm_size")), "eff_comm_size")


@query(WITH + ", g as (select gene_id from (select distinct up as gene_id from c)), e as (select distinct entrez_id as gene_id from gene_ids where entrez_id is not null) select count(*) filter (where g.gene_id is not null and e.gene_id is not null) as both, count(*) filter (where e.gene_id is null) as left_only, count(*) filter (where g.gene_id is null) as right_only from g full join e using (gene_id)")
def id_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "gene_ids").select(F.col("entrez_id").alias("g")).where("g is not null")
    return R.coverage(claims(spark, sf_dir).select(F.col("up").alias("g")), e, "g")


@query(WITH + """, q as (select claim_id, pos, case when cdf_exp > -1e-8 and cdf_exp <= 0.2 then 0 when cdf_exp > 0.2 and cdf_exp <= 0.4 then 1 when cdf_exp > 0.4 and cdf_exp <= 0.6 then 2 when cdf_exp > 0.6 and cdf_exp <= 0.8 then 3 when cdf_exp > 0.8 and cdf_exp <= 1 then 4 end as q from c where cdf_exp is not null),
n as (select count(distinct pos) - 1 as a, count(distinct q) - 1 as b from q)
select claim_id, q as quantised, cast(abs(lcm(a, b) / b * q - lcm(a, b) / a * pos) as integer) as distance from q, n""")
def quantize_distance(spark, sf_dir):
    from claimweave.operators.features import level_distance, quantize
    c = claims(spark, sf_dir).where("cdf_exp is not null")
    x = c.withColumn("quantised", quantize(F.col("cdf_exp"), [-1e-8, 0.2, 0.4, 0.6, 0.8, 1.0]).cast("int"))
    return level_distance(x, "pos", "quantised", "distance").select("claim_id", "quantised", F.col("distance").cast("int").alias("distance"))


@query(WITH + f"select claim_id, {r6('(ai - min(ai) over ()) / (max(ai) over () - min(ai) over ())')} as ai_scaled from c where ai is not null")
def minmax(spark, sf_dir):
    from claimweave.operators.features import min_max
    return rounded(min_max(claims(spark, sf_dir).where("ai is not null"), ["ai"]).select("claim_id", F.col("ai").alias("ai_scaled")), "ai_scaled")


@query(WITH + f", s as (select up, dn, avg(ai) as m, stddev_pop(ai) as d from c where ai is not null group by up, dn) select claim_id, {r6('case when d < 1e-9 then ai - m else (ai - m) / d end')} as z from c join s using (up, dn) where ai is not null")
def zscore_by_interaction(spark, sf_dir):
    from claimweave.operators.features import group_zscore
    return rounded(group_zscore(claims(spark, sf_dir).where("ai is not null"), ["up", "dn"], "ai", "z").select("claim_id", "z"), "z")


@query(WITH + f", s as (select journal, avg(ai) as m from c where ai is not null group by journal) select claim_id, {r6('coalesce(ai, m)')} as ai from c left join s using (journal) where coalesce(ai, m) is not null")
def impute_group_mean(spark, sf_dir):
    from claimweave.operators.features import impute_group_mean as impute
    return rounded(impute(claims(spark, sf_dir), "ai", ["journal"]).select("claim_id", "ai"), "ai")


@query(WITH + f", m as (select avg(ai) as m from c where ai > 1) select claim_id, {r6('case when ai > 1 then ln(1 + ai) else -1 end')} as log_ai, {r6('case when ai > 1 then (ai - m) * (ai - m) else -1 end')} as dev2 from c, m where ai is not null")
def derived_logs(spark, sf_dir):
    from claimweave.operators.features import masked_logs
    return rounded(masked_logs(claims(spark, sf_dir).where("ai is not null"), "ai", F.col("ai") > 1).select("claim_id", "log_ai", "dev2"), "log_ai", "dev2")


@query(WITH + "select up, dn, cast(sum(pos) as bigint) as k, count(*) as n, min(cdf_exp) as q, min(year) as year_min, max(year) as year_max from c group by up, dn having count(*) >= 2")
def kn_stats(spark, sf_dir):
    return A.interaction_stats(claims(spark, sf_dir), 2)


def _lf(n):
    return f"(coalesce(list_sum(list_transform(range(2, {n} + 1), lambda i: ln(i))), 0))"


def _bb(k, n, a, b):
    lb = lambda x, y: f"({_lf(f'({x}) - 1')} + {_lf(f'({y}) - 1')} - {_lf(f'({x}) + ({y}) - 1')})"
    return f"({_lf(n)} - {_lf(k)} - {_lf(f'({n} - {k})')} + {lb(f'{k} + {a}', f'{n} - {k} + {b}')} - {lb(a, b)})"


@query(WITH + f", s as (select up, dn, cast(sum(pos) as bigint) as k, count(*) as n from c group by up, dn) select up, dn, k, n, {r6('1 / (1 + exp(-greatest(-500, least(500, ' + _bb('k', 'n', 6, 3) + ' - ' + _bb('k', 'n', 3, 5) + '))))')} as p_positive from s")
def beta_binomial(spark, sf_dir):
    s = A.interaction_stats(claims(spark, sf_dir)).select("up", "dn", "k", F.col("n"))
    return rounded(A.beta_binomial_positive(s, 6, 3, 3, 5), "p_positive")


@query(WITH + f", g as (select avg(pos) as p from c) select up, dn, {r6('case when sum(abs(coalesce(ai, 0) - p)) > 0 then sum(abs(coalesce(ai, 0) - p) * pos) / sum(abs(coalesce(ai, 0) - p)) else avg(pos) end')} as estimate from c, g group by up, dn")
def weighted_pi(spark, sf_dir):
    c = claims(spark, sf_dir)
    p = c.agg(F.avg("pos")).first()[0]
    return rounded(A.weighted_interaction(c.withColumn("pos", F.col("pos").cast("double")), "pos", F.abs(F.coalesce("ai", F.lit(0.0)) - F.lit(p))), "estimate")


_PCT = "(rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2e0) / count(*) over ()"


@query(WITH + f", x as (select *, {_PCT.format('ai')} as pct from c where ai is not null) select up, dn, {r6('case when sum(sqrt(abs(pct - 0.5))) > 0 then sum(sqrt(abs(pct - 0.5)) * pos) / sum(sqrt(abs(pct - 0.5))) else avg(pos) end')} as estimate from x group by up, dn")
def rank_weighted_pi(spark, sf_dir):
    c = W.percent_ranks(claims(spark, sf_dir).where("ai is not null"), "ai", "pct")
    return rounded(A.weighted_interaction(c.withColumn("pos", F.col("pos").cast("double")), "pos", F.sqrt(F.abs(F.col("pct") - 0.5))), "estimate")


_EXP = "with e as (select * from experiments where score is not null and isfinite(score) and up > 0 and dn > 0)"


@query(_EXP + f", m as (select up, dn, cell_id, pert_type, avg(score) as m from e group by all) select up, dn, round(arg_max(m, (round(abs(m), 9), m)) + 1e-9, 6) as strongest from m group by up, dn")
def max_abs_score(spark, sf_dir):
    return rounded(A.strongest(experiments(spark, sf_dir), ["up", "dn", "cell_id", "pert_type"], ["up", "dn"], "score"), "strongest")


@query(_EXP + f", s as (select up, dn, avg(score) as m, stddev_pop(score) as d, count(*) as n from e group by up, dn) select up, dn, {r6('m')} as mean, {r6('d')} as std, n, {r6(norm_cdf_sql('m'))} as cdf_exp from s")
def truth_from_scores(spark, sf_dir):
    s = A.mean_std(experiments(spark, sf_dir), ["up", "dn"], "score")
    return rounded(s.withColumn("cdf_exp", norm_cdf(F.col("mean"))), "mean", "std", "cdf_exp")


@query(WITH + ", y as (select distinct year as look from c) select up, dn, look, count(*) as count from c join y on c.year <= y.look group by all")
def cumulative_edges(spark, sf_dir):
    return W.cumulative_by_year(claims(spark, sf_dir))


@query(WITH + f""", p as (select up, dn, 0.2 + 0.6 * pos as a, 0.5e0 as b, 0.8 - 0.6 * pos as d from c), s as (select up, dn, sum(ln(a)) as l0, sum(ln(b)) as l1, sum(ln(d)) as l2 from p group by up, dn),
m as (select *, list_sort([l0, l1, l2])[2] as mid, case when round(l0, 9) >= round(l1, 9) and round(l0, 9) >= round(l2, 9) then 0 when round(l1, 9) >= round(l2, 9) then 1 else 2 end as vote from s), e as (select up, dn, vote, exp(greatest(-20, least(20, l0 - mid))) as e0, exp(greatest(-20, least(20, l1 - mid))) as e1, exp(greatest(-20, least(20, l2 - mid))) as e2 from m)
select up, dn, {r6('e0 / (e0 + e1 + e2)')} as p0, {r6('e1 / (e0 + e1 + e2)')} as p1, {r6('e2 / (e0 + e1 + e2)')} as p2, vote from e""")
def log_vote(spark, sf_dir):
    c = claims(spark, sf_dir).withColumns({"a": 0.2 + 0.6 * F.col("pos"), "b": F.lit(0.5), "d": 0.8 - 0.6 * F.col("pos")})
    return rounded(A.log_vote(c, ["up", "dn"], ["a", "b", "d"], 20.0), "p0", "p1", "p2")


@query(WITH + f", a as (select up, dn, year, pmid % 7 as comm, avg(pos) as m from c group by all), b as (select up, dn, year, avg(m) as m from a group by all) select up, dn, {r6('avg(m)')} as m from b group by up, dn")
def mean_of_means(spark, sf_dir):
    c = claims(spark, sf_dir).withColumn("comm", F.col("pmid") % 7)
    return rounded(A.mean_of_means(c, [["up", "dn", "year", "comm"], ["up", "dn", "year"], ["up", "dn"]], "pos"), "m")


_THR = [0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9]


@query(WITH + f", t as (select unnest({_THR}) as thr) select cast(thr as double) as thr, cast(coalesce(sum(pos) filter (where cdf_exp >= thr), 0) as bigint) as sum_high, count(*) filter (where cdf_exp >= thr) as n_high, cast(coalesce(sum(pos) filter (where cdf_exp < thr), 0) as bigint) as sum_low, count(*) filter (where cdf_exp < thr) as n_low from c, t where cdf_exp is not null group by thr")
def threshold_study(spark, sf_dir):
    return A.threshold_study(claims(spark, sf_dir), "cdf_exp", "pos", _THR)


@query(WITH + """, t as (select low, high from (select unnest(range(0, 21)) / 40e0 as low), (select 0.5e0 + unnest(range(0, 21)) / 40e0 as high)) select cast(low as double) as low, cast(high as double) as high,
cast(coalesce(sum(pos) filter (where cdf_exp < low), 0) as bigint) as sum_low, count(*) filter (where cdf_exp < low) as n_low, cast(coalesce(sum(pos) filter (where cdf_exp >= low and cdf_exp < high), 0) as bigint) as sum_middle, count(*) filter (where cdf_exp >= low and cdf_exp < high) as n_middle,
cast(coalesce(sum(pos) filter (where cdf_exp >= high), 0) as bigint) as sum_high, count(*) filter (where cdf_exp >= high) as n_high from c, t where cdf_exp is not null group by low, high""")
def threshold_surface(spark, sf_dir):
    return A.threshold_surface(claims(spark, sf_dir), "cdf_exp", "pos", [i / 40 for i in range(21)], [0.5 + i / 40 for i in range(21)])


@query(WITH + f"select case when ar < 2 then 0 when ar < 4 then 1 when ar < 6 then 2 else 3 end as bin, count(*) as n, {r6('corr(pos, cdf_exp)')} as corr, {r6('avg(pos)')} as mean_pos, {r6('stddev_pop(cdf_exp)')} as std_exp from c where cdf_exp is not null and ar >= 0 and ar < 8 group by bin having count(*) > 4")
def binned_corr(spark, sf_dir):
    x = R.in_bins(claims(spark, sf_dir).where("cdf_exp is not null"), "ar", [0.0, 2.0, 4.0, 6.0, 8.0])
    out = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.corr("pos", "cdf_exp").alias("corr"), F.avg("pos").alias("mean_pos"), F.stddev_pop("cdf_exp").alias("std_exp")).where("n > 4")
    return rounded(out, "corr", "mean_pos", "std_exp")


@query(WITH + f"select case when ar < 2 then 0 when ar < 4 then 1 when ar < 6 then 2 when ar < 8 then 3 else 4 end as bin, count(*) as n, {r6('corr(pos, cdf_exp)')} as corr, {r6('avg(pos)')} as mean_pos, {r6('stddev_pop(cdf_exp)')} as std_exp from c where cdf_exp is not null and ar is not null group by bin having count(*) > 4")
def binned_corr_all(spark, sf_dir):
    """As binned_corr, with a bin from 8 to the end of the range (10)."""
    x = R.in_bins(claims(spark, sf_dir).where("cdf_exp is not null"), "ar", [0.0, 2.0, 4.0, 6.0, 8.0, 11.0])
    out = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.corr("pos", "cdf_exp").alias("corr"), F.avg("pos").alias("mean_pos"), F.stddev_pop("cdf_exp").alias("std_exp")).where("n > 4")
    return rounded(out, "corr", "mean_pos", "std_exp")


@query(WITH + "".join([", x as (select origin, year % 3 as part, pos, cdf_exp, ai, ar from c where cdf_exp is not null and ai is not null and ar is not null) "] + [" union all ".join(
    f"select origin, part, count(*) as n, '{v}' as \"column\", {r6(f'corr({v}, cdf_exp)')} as corr from x group by origin, part having count(*) >= 10" for v in ("pos", "ai", "ar"))]))
def corr_by_filter(spark, sf_dir):
    x = claims(spark, sf_dir).dropna(subset=["cdf_exp", "ai", "ar"]).withColumn("part", F.col("year") % 3).withColumn("pos", F.col("pos").cast("double"))
    return rounded(A.correlations(x, "cdf_exp", ["pos", "ai", "ar"], ["origin", "part"], 10), "corr")


@query(WITH + """, x as (select origin, year % 3 as part, pos, cdf_exp, ai, ar from c where cdf_exp is not null and ai is not null and ar is not null), k as (""" + " union all ".join(
    f"select origin || '_' || part as family, '{v}' as col, round(corr({v}, cdf_exp) + 1e-9, 6) as r from x group by origin, part having count(*) >= 10" for v in ("pos", "ai", "ar")) + """)
select family, arg_max(col, (r, col)) filter (where r > 0) as best_positive, arg_min(col, (r, col)) filter (where r < 0) as best_negative, count(*) as members, coalesce(bool_or(r > 0), false) and coalesce(bool_or(r < 0), false) as conflict from k group by family""")
def family_extremes(spark, sf_dir):
    c = corr_by_filter(spark, sf_dir).withColumn("family", F.concat_ws("_", "origin", F.col("part").cast("string")))
    return A.family_extremes(c, "family")


@query(WITH + f", s as (select up, dn, year, avg(pos) as m, stddev_pop(pos) as d, count(*) as n from c group by all) select up, dn, {r6('sum(n * m) / sum(n)')} as mean, {r6('sqrt(greatest(sum(n * (m * m + d * d)) / sum(n) - (sum(n * m) / sum(n)) * (sum(n * m) / sum(n)), 0))')} as std, cast(sum(n) as bigint) as n from s group by up, dn")
def pooled_std(spark, sf_dir):
    s = A.mean_std(claims(spark, sf_dir), ["up", "dn", "year"], "pos")
    x = A.pooled_std(s, ["up", "dn"], "n", "mean", "std")
    return rounded(x, "mean", "std")


@query(_B + f"""select up, dn, year, {r6('sum(k) over (partition by up, dn order by year rows between 2 preceding and 1 preceding) / sum(n) over (partition by up, dn order by year rows between 2 preceding and 1 preceding)')} as mu2,
{r6('sum(k) over (partition by up, dn order by year rows between unbounded preceding and 1 preceding) / sum(n) over (partition by up, dn order by year rows between unbounded preceding and 1 preceding)')} as mu_all from b""")
def moving_average(spark, sf_dir):
    b = W.moving_average(W.moving_average(_batches(spark, sf_dir), 2, "mu2"), None, "mu_all")
    return rounded(b.select("up", "dn", "year", "mu2", "mu_all"), "mu2", "mu_all")


@query(WITH + f", i as (select up, dn, sum(pos) / count(*) as mu from c group by up, dn), p as (select *, {_PCT.format('mu')} as pct from i), a as (select *, round(abs(pct - (select quantile_cont(pct, 0.5) from p)), 9) as am from p) select up, dn, {r6('pct')} as pct, {r6('am')} as absmed, {r6(_PCT.format('am'))} as absmed_pct from a")
def pct_absmed(spark, sf_dir):
    i = claims(spark, sf_dir).groupBy("up", "dn").agg((F.sum("pos") / F.count(F.lit(1))).alias("mu"))
    x = W.absolute_median_ranks(i, "mu").select("up", "dn", F.col("mu_pct").alias("pct"), F.col("mu_absmed").alias("absmed"), F.col("mu_absmed_pct").alias("absmed_pct"))
    return rounded(x, "pct", "absmed", "absmed_pct")


@query(WITH + "select claim_id, year = min(year) over (partition by up, dn) as t0, year - min(year) over (partition by up, dn) as year_off, (year - min(year) over (partition by up, dn)) ** 2 as sq from c")
def t0_flag(spark, sf_dir):
    return W.first_time(claims(spark, sf_dir)).select("claim_id", "t0", "year_off", F.col("year_off2").cast("double").alias("sq"))


@query(WITH + "select claim_id from c qualify year > min(year) over (partition by up, dn)")
def later_years(spark, sf_dir):
    return W.first_time(claims(spark, sf_dir)).where("not t0").select("claim_id")


@query(_B + f""", m as (select up, dn, year, k / n - 0.5 as v, lag(k / n - 0.5) over w as prev, count(*) over (partition by up, dn) as y from b window w as (partition by up, dn order by year))
select up, dn, year, {r6('prev')} as previous, coalesce(v * prev < 0, false) as sign_change, coalesce(round(abs(v) - abs(prev), 9) < 0, false) as decrease, {r6('coalesce(abs(v) - abs(prev), 0)')} as change, coalesce(sign(round(abs(v) - abs(prev), 9)), 0)::double as change_sign from m where y > 1""")
def transitions(spark, sf_dir):
    b = _batches(spark, sf_dir).withColumn("v", F.col("k") / F.col("n") - 0.5)
    return rounded(W.transitions(b, "v").select("up", "dn", "year", "previous", "sign_change", "decrease", "change", "change_sign"), "previous", "change")


@query(_B + "select up, dn, year, n, cast(dense_rank() over (partition by up, dn order by n desc) - 1 as integer) as rank from b")
def dense_rank0(spark, sf_dir):
    return W.dense_rank_desc(_batches(spark, sf_dir), ["up", "dn"], "n", "rank").select("up", "dn", "year", "n", "rank")


@query(_B + "select up, dn, year, n from b qualify row_number() over (partition by up, dn order by n desc, year) <= ceil(0.3 * count(*) over (partition by up, dn))")
def top_fraction(spark, sf_dir):
    return W.top_fraction(_batches(spark, sf_dir), ["up", "dn"], "n", 0.3, ["year"]).select("up", "dn", "year", "n")


@query(_B + "select up, dn, year, coalesce(sum(n) over (partition by up, dn order by year rows between unbounded preceding and 1 preceding), 0) < 0.5 * sum(n) over (partition by up, dn) or count(*) over (partition by up, dn) = 1 as accounted from b")
def chrono_flag(spark, sf_dir):
    return W.chronological_flag(_batches(spark, sf_dir), 0.5).select("up", "dn", "year", "accounted")


@query(_B + "select up, dn, year, cast(sum(n) over w as bigint) as n_before, cast(sum(k) over w as bigint) as k_before from b window w as (partition by up, dn order by year rows between unbounded preceding and 1 preceding) qualify n_before is not null")
def expanding_cuts(spark, sf_dir):
    return W.expanding_cuts(_batches(spark, sf_dir)).select("up", "dn", "year", "n_before", "k_before")


@query(_B + f" select up, dn, year, k, n from (select *, row_number() over (partition by up, dn order by {uniform_sql(17, 'up', 'dn', 'year')}, year) as r from b) where r = 1")
def one_batch_each(spark, sf_dir):
    return W.one_batch_each(_batches(spark, sf_dir), 17)


@query(WITH + ", p as (select quantile_cont(ai, [0.1, 0.25, 0.5, 0.75, 0.9]) as p from c) select claim_id, case when ai is not null then cast(len(list_filter(p, lambda v: ai > v)) as integer) end as level from c, p")
def percentile_flags(spark, sf_dir):
    return A.percentile_flags(claims(spark, sf_dir), "ai", [0.1, 0.25, 0.5, 0.75, 0.9]).select("claim_id", "level")


@query(WITH + f", x as (select cdf_exp as s, pos as v from c where cdf_exp is not null), l as (select unnest([0.05, 0.1, 0.2, 0.3]) as level), q as (select level, (select quantile_cont(s, [0.05, 0.1, 0.2, 0.3]) from x) as lo, (select quantile_cont(s, [0.95, 0.9, 0.8, 0.7]) from x) as hi, row_number() over () as i from l) select cast(level as double) as level, count(*) as n, {r6('corr(v, s)')} as corr, {r6('avg(abs(s - v))')} as distance from x, q where s <= lo[i] or s >= hi[i] group by level")
def level_sweep(spark, sf_dir):
    return rounded(A.level_sweep(claims(spark, sf_dir), "cdf_exp", "pos", [0.05, 0.1, 0.2, 0.3]), "corr", "distance")


@query("select journal, count(*) as n from claims group by journal order by n desc, journal limit 25")
def top_journals(spark, sf_dir):
    return table(spark, sf_dir, "claims").groupBy("journal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "journal").limit(25)


@query("select count(distinct pmid) as papers, count(distinct journal) as journals, count(*) as n from claims")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "claims").agg(F.countDistinct("pmid").alias("papers"), F.countDistinct("journal").alias("journals"), F.count(F.lit(1)).alias("n"))


@query("with " + READINGS_SQL + " select origin, journal, count(*) as n, cast(sum(pos) as bigint) as k from readings group by cube (origin, journal)")
def cube_counts(spark, sf_dir):
    return readings(spark, sf_dir).cube("origin", "journal").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("k"))


@query(WITH + f"select claim_id, {r6(norm_cdf_sql('(ai - 2)'))} as cdf, {r6('case when cdf_exp is not null then ln(greatest(1e-3, least(1 - 1e-3, cdf_exp)) / (1 - greatest(1e-3, least(1 - 1e-3, cdf_exp)))) end')} as logit_exp, {r6('1 + 3 / (1 + exp(-0.5 * (year - 2000)))')} as step from c where ai is not null")
def scalar_math(spark, sf_dir):
    from claimweave.functions.math import clip, logistic_step, logit
    c = claims(spark, sf_dir).where("ai is not null")
    x = c.select("claim_id", norm_cdf(F.col("ai") - 2).alias("cdf"), F.when(F.col("cdf_exp").isNotNull(), logit(clip(F.col("cdf_exp"), 1e-3, 1 - 1e-3))).alias("logit_exp"),
                 logistic_step(F.col("year"), 2000.0, 0.5, 1.0, 4.0).alias("step"))
    return rounded(x, "cdf", "logit_exp", "step")


# The quantile by Newton's method on the distribution function, from 0: on either side it is curved so that
# each step stops short of the root.
_NEWTON = "list_reduce([0e0] || list_transform(range(0, 40), lambda i: 0e0), lambda z, i: z - (" + norm_cdf_sql("z") + " - q) / (exp(-z * z / 2) / 2.5066282746310002))"


@query(WITH + f", x as (select distinct greatest(1e-6, least(1 - 1e-6, cdf_exp)) as q, cdf_exp from c where cdf_exp is not null), z as (select cdf_exp, {_NEWTON} as z from x) select claim_id, {r6('z')} as z from c join z using (cdf_exp)")
def normal_quantiles(spark, sf_dir):
    return rounded(claims(spark, sf_dir).where("cdf_exp is not null").select("claim_id", norm_ppf(F.col("cdf_exp")).alias("z")), "z")
