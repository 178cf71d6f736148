"""The three lifecycles end to end: final feature table, graph metrics with refutation, prediction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.math import half_up, norm_cdf, norm_cdf_sql
from claimweave.operators import bipartite as G
from claimweave.operators import community as C
from claimweave.operators import estimates as E
from claimweave.operators import models as L
from claimweave.operators import relational as R
from claimweave.operators import sampling as P
from claimweave.operators import windows as W
from claimweave.operators.features import error_flags, level_distance, quantize
from claimweave.operators.relational import value_windows
from claimweave.session import cut
from claimweave.sources.claims import UNITS_SQL, WITH, claims, experiments, paper_units

r6 = lambda x: f"round({x} + 1e-9, 6)"
# The bounds of the three levels of the experimental truth.
EDGES = [-1e-8, 0.305, 0.782, 1.0]


def truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experimental truth per pair: the normal CDF of the mean score of knock-downs and over-expressions of 24 hours or more."""
    e = experiments(spark, sf_dir).where(F.col("pert_type").isin("trt_kd", "trt_ov") & (F.col("hours") >= 24))
    s = e.groupBy("up", "dn").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n_exp"))
    return s.select("up", "dn", norm_cdf(F.col("m")).alias("truth"), "n_exp")


def final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lazy plan: claims joined to truth, error flags, the prior of earlier years, author concentration and offsets."""
    c = R.mask_out(claims(spark, sf_dir)).join(truth_table(spark, sf_dir), ["up", "dn"])
    c = c.withColumn("q", quantize(F.col("truth"), EDGES))
    c = error_flags(c, truth="truth", quantised="q")
    prior = W.moving_average(W.batches(c, "bdist_half"), None, "obs_mu").select("up", "dn", "year", "obs_mu")
    hi = G.concentration(c, paper_units(spark, sf_dir)).select("up", "dn", "year", F.col("previous_hi").alias("au_hi"))
    return W.first_time(c).join(prior, ["up", "dn", "year"], "left").join(hi, ["up", "dn", "year"], "left")


def pipeline_final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = final_table(spark, sf_dir).select("claim_id", "pos", "truth", "n_exp", F.col("bdist_half").alias("bdist"), "rdist", "t0", "year_off", "obs_mu", "au_hi")
    return x.withColumns({c: half_up(F.col(c)) for c in ("truth", "rdist", "obs_mu", "au_hi")})


def graph_metrics(c: DataFrame, units: DataFrame, widths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per claim, over windows of each width that end in its year: support of the interaction, affinity of
    the paper, size, number and rank of the communities detected among the window's papers, and the
    refutation vote: the majority of the claims of its community in the window's earlier years (null if
    none). Papers without units are in no community. `c` has a row per (up, dn, pmid)."""
    batch, paper, group = ["up", "dn", "look"], ["up", "dn", "look", "pmid"], ["width", "up", "dn", "look"]
    windows = cut(value_windows(c.select("up", "dn", "year", "pmid", "pos"), ["up", "dn"], "year", max(widths)))
    # A paper goes once to each group; the widths are taken apart there, and all windows' figures are found in one pass.
    members = C.measured_communities(G.stars(windows, G.unit_lists(units)), batch, "p", "u", side=True, carry=("pmid", "year", "pos"), widths=widths, degrees=True)
    age = F.col("look") - F.col("year")
    n_papers = windows.groupBy(*batch).agg(*[F.count(F.when(age < w, 1)).alias(f"n{w}") for w in widths])
    earlier = F.when(F.col("year") < F.col("look"), F.col("pos"))
    found = members.groupBy(*group, "label").agg(F.first("comm_size").alias("comm_size"), F.first("n_comms").alias("n_comms"), (F.avg(earlier) > 0.5).cast("int").alias("vote"))
    found = W.dense_rank_desc(found, group, "comm_size", "rank")
    figures = ("comm_size", "n_comms", "rank", "vote")
    own = members.where("year = look").select(*group, "pmid", "label", "shared", "degree").join(found, [*group, "label"])
    own = own.groupBy(*paper).agg(*[F.max(F.when(F.col("width") == w, F.col(n))).alias(f"{n}{w}") for w in widths for n in (*figures, "shared", "degree")])
    of_group = n_papers.join(members.groupBy(*batch).agg(*[F.max(F.when(F.col("width") == w, F.col(n))).alias(f"{n}{w}") for w in widths for n in ("squares", "others")]), batch, "left")
    out = c.select("claim_id", "up", "dn", F.col("year").alias("look"), "pmid").join(of_group, batch).join(own, paper, "left")
    for w in widths:
        n = F.col(f"n{w}")
        index = {"support": F.col(f"squares{w}") / (F.col(f"others{w}") * n * n), "affinity": F.try_divide(F.col(f"shared{w}"), F.col(f"degree{w}") * (n - 1))}
        out = out.withColumns({f"{name}{w}": F.coalesce(F.when(n > 1, x), F.lit(0.0)) for name, x in index.items()})
    return out.select(*paper, "claim_id", *[f"{n}{w}" for w in widths for n in ("support", "affinity")], *[f"{n}{w}" for w in widths for n in figures])


def pipeline_graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, affinity, ranked communities and refutation votes over windows of 1 to 3 years, joined to the claims."""
    x = graph_metrics(claims(spark, sf_dir), paper_units(spark, sf_dir))
    return x.withColumns({f"{n}{w}": half_up(F.col(f"{n}{w}")) for n in ("support", "affinity") for w in (1, 2, 3)})


def pipeline_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold forest probabilities of a claim being right, then four interaction estimates."""
    x = final_table(spark, sf_dir).na.fill({"obs_mu": 0.5, "au_hi": 0.0, "ai": 0.0, "ar": 0.0}).select(
        "claim_id", "up", "dn", "pos", "bdist_half", F.col("pos").cast("double").alias("claim"), "obs_mu", "au_hi", "ai", "ar", F.col("year_off").cast("double").alias("off"))
    x = L.assemble(P.folds(x, ["up", "dn"], 3), ["claim", "obs_mu", "au_hi", "ai", "ar", "off"], "bdist_half").cache()
    parts = []
    for k in range(3):
        model = L.fit_forest(x.where(F.col("fold") != k), 10, 4)
        parts.append(L.scored(model, x.where(F.col("fold") == k)).select("up", "dn", "pos", F.array(1 - F.col("score"), F.col("score")).alias("p")))
    scored = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return E.interaction_estimates(E.claim_validity(scored, "p"))


def level_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).join(truth_table(spark, sf_dir), ["up", "dn"]).withColumn("q", quantize(F.col("truth"), EDGES))
    return level_distance(c, "pos", "q", "d").select("claim_id", F.col("q").cast("int").alias("q"), F.col("d").cast("int").alias("d"))


def valley_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).where("ai is not null").select("claim_id", "origin", "ai")
    return E.valley_split(c, ["origin"], "ai")


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.folds(claims(spark, sf_dir), ["up", "dn"], 4).groupBy("origin", "fold").agg(F.avg("pos").alias("mean_pos"), F.avg("ai").alias("mean_ai"))
    x = E.reduce_report(c, ["origin"], ["mean_pos", "mean_ai"])
    out = E.wide_report(x, ["origin"], ["mean_pos", "mean_ai"])
    return out.withColumns({n: half_up(F.col(n)) for n in ("mean_pos", "mean_ai")})


def origin_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).withColumn("part", (F.col("year") % 3).cast("string"))
    return E.heatmap(c, "part", "origin", ["lit", "gw"], F.round(F.avg("pos") + 1e-9, 6))


def pipeline_interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the prediction lifecycle in one table: degrees of both genes in earlier years, communities of
    the genes, averages of earlier years, percentile ranks of influence and rating, offsets."""
    c = claims(spark, sf_dir)
    x = W.first_time(c).join(W.moving_average(W.moving_average(W.batches(c, "pos"), 3, "mu3"), None, "mu_all").select("up", "dn", "year", "mu3", "mu_all"), ["up", "dn", "year"])
    x = x.join(G.previous_degrees(c).select("claim_id", "up_out", "up_in", "dn_out", "dn_in"), "claim_id")
    x = W.percent_ranks(W.percent_ranks(x, "ai", "ai_pct"), "ar", "ar_pct")
    e = c.groupBy("up", "dn").agg(F.count(F.lit(1)).alias("w"))
    t = C.community_table(C.modularity_communities(e.withColumn("g", F.lit(0)), ["g"], "up", "dn", "w"), ["g"]).select(F.col("node").cast("long").alias("gene"), "label", "comm_size")
    x = R.role_join(x, t, "gene", ["label", "comm_size"]).withColumn("same_comm", F.coalesce((F.col("label_up") == F.col("label_dn")).cast("int"), F.lit(0)))
    out = x.select("claim_id", "year_off", "mu3", "mu_all", "up_out", "up_in", "dn_out", "dn_in", "ai_pct", "ar_pct", "same_comm", "comm_size_up", "comm_size_dn")
    return out.withColumns({n: half_up(F.col(n)) for n in ("mu3", "mu_all", "ai_pct", "ar_pct")})


QUERIES = {f.__name__: f for f in (pipeline_final_table, pipeline_graph_metrics, pipeline_interaction_features, pipeline_prediction, level_distances, valley_split, report_table, origin_heatmap)}

_T = WITH + f""", e as (select *, case when pert_itime like '% d' then 24 else 1 end * cast(regexp_extract(pert_itime, '[0-9]+') as double) as hours from experiments where score is not null and isfinite(score) and up > 0 and dn > 0),
tm as (select up, dn, avg(score) as m, count(*) as n_exp from e where pert_type in ('trt_kd', 'trt_ov') and hours >= 24 group by up, dn), t as (select up, dn, {norm_cdf_sql('m')} as truth, n_exp from tm)"""
_GM, _GL = C.modularity_communities_sql("bo", ["width", "up", "dn", "look"])
_CM, _CL = C.modularity_communities_sql("bo", ["g"])
_PCT = "case when {0} is not null then (rank() over (partition by {0} is null order by {0}) + (count(*) over (partition by {0}) - 1) / 2e0) / count({0}) over () end"
_KEYS = "width, up, dn, look"
SQL = {
    "pipeline_graph_metrics": WITH + f""", {UNITS_SQL}, win as materialized (select distinct n.width, c.up, c.dn, y.look, c.pmid from (select unnest([1, 2, 3]) as width) n, c join (select distinct up, dn, year as look from c) y on c.up = y.up and c.dn = y.dn where c.year <= y.look and c.year > y.look - n.width),
eu as materialized (select win.*, unit from win join units using (pmid)), dg as materialized (select {_KEYS}, unit, count(*) as deg from eu group by all), np as (select {_KEYS}, count(*) as n_papers from win group by all),
su as (select {_KEYS}, case when n_papers > 1 then sum(deg * deg) / (count(*) * n_papers * n_papers) else 0 end as support from dg join np using ({_KEYS}) group by {_KEYS}, n_papers),
af as (select {_KEYS}, pmid, case when n_papers > 1 then sum(deg - 1) / count(*) / (n_papers - 1) else 0 end as affinity from eu join dg using ({_KEYS}, unit) join np using ({_KEYS}) group by {_KEYS}, pmid, n_papers),
ed as (select {_KEYS}, 'p' || pmid as p, 'u:' || unit as u from eu), bo as materialized (select {_KEYS}, x, y, sum(w) as w from (select {_KEYS}, p as x, u as y, 1e0 as w from ed union all select {_KEYS}, u, p, 1e0 from ed) group by all), {_GM},
lab as materialized (select {_KEYS}, cast(substring(node, 2) as bigint) as pmid, label from {_GL} where node not like 'u:%'), sz as (select {_KEYS}, label, count(*) as comm_size from lab group by all), nc as (select {_KEYS}, count(*) as n_comms from sz group by all),
rk as (select *, dense_rank() over (partition by {_KEYS} order by comm_size desc) - 1 as rank from sz), mb as materialized (select lab.*, c.year, c.pos from lab join c using (up, dn, pmid)), bf as (select {_KEYS}, label, avg(pos) as m from mb where year < look group by all),
ow as materialized (select mb.width, mb.up, mb.dn, mb.look, mb.pmid, comm_size, n_comms, cast(rank as integer) as rank, cast(m > 0.5 as integer) as vote from mb join rk using ({_KEYS}, label) join nc using ({_KEYS}) left join bf using ({_KEYS}, label) where year = look),
al as (select c.claim_id, c.up, c.dn, c.year as look, c.pmid, n.width, coalesce(support, 0) as support, coalesce(affinity, 0) as affinity, comm_size, n_comms, rank, vote from c cross join (select unnest([1, 2, 3]) as width) n left join su on su.width = n.width and su.up = c.up and su.dn = c.dn and su.look = c.year left join af on af.width = n.width and af.up = c.up and af.dn = c.dn and af.look = c.year and af.pmid = c.pmid
left join ow on ow.width = n.width and ow.up = c.up and ow.dn = c.dn and ow.look = c.year and ow.pmid = c.pmid) select claim_id, up, dn, look, pmid, """ + ", ".join(f"max({e}) filter (where width = {w}) as {n}{w}" for w in (1, 2, 3) for n, e in (("support", "round(support + 1e-9, 6)"), ("affinity", "round(affinity + 1e-9, 6)"), ("comm_size", "comm_size"), ("n_comms", "n_comms"), ("rank", "rank"), ("vote", "vote"))) + " from al group by claim_id, up, dn, look, pmid",
    "pipeline_interaction_features": WITH + f""", b as (select up, dn, year, sum(pos) as k, count(*) as n from c group by all), mv as (select up, dn, year, sum(k) over w3 / sum(n) over w3 as mu3, sum(k) over wa / sum(n) over wa as mu_all, year - min(year) over (partition by up, dn) as year_off from b window w3 as (partition by up, dn order by year rows between 3 preceding and 1 preceding), wa as (partition by up, dn order by year rows between unbounded preceding and 1 preceding)),
f as (select up, dn, min(year) as year from c group by up, dn), e as (select cast(up as varchar) as a, cast(dn as varchar) as b, count(*) as w from c where up <> dn group by all), bo as materialized (select 0 as g, x, y, cast(sum(w) as double) as w from (select a as x, b as y, w from e union all select b, a, w from e) group by all), {_CM},
z as (select cast(node as bigint) as gene, label, count(*) over (partition by label) as size from {_CL}), p as (select claim_id, {_PCT.format('ai')} as ai_pct, {_PCT.format('ar')} as ar_pct from c)
select c.claim_id, year_off, {r6('mu3')} as mu3, {r6('mu_all')} as mu_all, """ + ", ".join(f"(select count(*) from f where f.{g} = c.{end} and f.year < c.year) as {end}_{k}" for end in ("up", "dn") for g, k in (("up", "out"), ("dn", "in"))) + f""", {r6('ai_pct')} as ai_pct, {r6('ar_pct')} as ar_pct, cast(coalesce(u.label = d.label, false) as integer) as same_comm, u.size as comm_size_up, d.size as comm_size_dn
from c join mv using (up, dn, year) join p using (claim_id) left join z u on u.gene = c.up left join z d on d.gene = c.dn""",
    "report_table": WITH + f", f as (select *, cast(floor({P.uniform_sql(0, 'up', 'dn')} * 4) as integer) as fold from c), r as (select origin, fold, avg(pos) as a, avg(ai) as b from f group by all) select origin, {r6('avg(a)')} as mean_pos, {r6('avg(b)')} as mean_ai from r group by origin",
    "pipeline_final_table": _T + f""", {UNITS_SQL}, ue as (select distinct x.up, x.dn, x.year, x.pmid, unit from (select c.* from c join t using (up, dn)) x join units using (pmid)), us as (select *, 1e0 / count(*) over (partition by up, dn, year, pmid) as s from ue), uy as (select distinct up, dn, year as look from ue),
ut as (select uy.up, uy.dn, uy.look, unit, sum(s) as s from uy join us on us.up = uy.up and us.dn = uy.dn and us.year <= uy.look group by all), uh as (select up, dn, look as year, case when count(*) > 1 then (sum(s * s) / (sum(s) * sum(s)) - 1e0 / count(*)) / (1 - 1e0 / count(*)) else 1 end as hi from ut group by all), up_ as (select up, dn, year, lag(hi) over (partition by up, dn order by year) as au_hi from uh), x as (select c.*, truth, n_exp, cast(abs(truth - pos) < 0.5 as integer) as bdist from c join t using (up, dn)), b as (select up, dn, year, sum(bdist) as k, count(*) as n from x group by all),
o as (select up, dn, year, sum(k) over w / sum(n) over w as obs_mu from b window w as (partition by up, dn order by year rows between unbounded preceding and 1 preceding))
select claim_id, pos, {r6('truth')} as truth, n_exp, bdist, {r6('truth - pos')} as rdist, year = min(year) over (partition by up, dn) as t0, year - min(year) over (partition by up, dn) as year_off, {r6('obs_mu')} as obs_mu, {r6('au_hi')} as au_hi from x join o using (up, dn, year) left join up_ using (up, dn, year)""",
    "level_distances": _T + """, x as (select claim_id, pos, case when truth <= 0.305 then 0 when truth <= 0.782 then 1 else 2 end as q from c join t using (up, dn)), n as (select count(distinct pos) - 1 as a, count(distinct q) - 1 as b from x)
select claim_id, q, cast(abs(lcm(a, b) / b * q - lcm(a, b) / a * pos) as integer) as d from x, n""",
    "origin_heatmap": WITH + f"select cast(year % 3 as varchar) as part, {r6('avg(pos) filter (where origin = ' + chr(39) + 'lit' + chr(39) + ')')} as lit, {r6('avg(pos) filter (where origin = ' + chr(39) + 'gw' + chr(39) + ')')} as gw from c group by part",
}
