"""Queries of samples by class and length, of growing populations, and of generated claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions.math import half_up
from claimweave.operators import sampling as P
from claimweave.operators import windows as W
from claimweave.plans.relational_queries import _NEWTON
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


_U = P.uniform_sql(0, "claim_id")
_AT = WITH + f", r as (select claim_id, pos, row_number() over (partition by pos order by {_U}, claim_id) as p, count(*) over (partition by pos) as n from c)"


@query(_AT + ", f as (select pos, n, row_number() over (order by n desc, cast(pos as varchar)) as i from (select distinct pos, n from r)), z as (select pos, case when i = 1 then 500 - cast(floor(500 * 0.25) as integer) else cast(floor(500 * 0.25) as integer) end as want from f), t as (select claim_id, r.pos, cast(floor((want - p) / n) + 1 as integer) as times from r join z on z.pos = r.pos) select claim_id, pos, unnest(range(1, times + 1))::integer as copy_no from t where times > 0")
def sized_sample(spark, sf_dir):
    """A sample of 500 claims, three of the more frequent class for each of the other."""
    c = claims(spark, sf_dir).select("claim_id", "pos")
    counts = {r["pos"]: r["count"] for r in c.groupBy("pos").count().collect()}
    return P.stratify(c, "pos", P.total_sizes(counts, 500, [3, 1]), ["claim_id"])


@query(_AT + " select claim_id, pos, case when p <= round(n * 0.6) then 'train' when p <= round(n * 0.8) then 'valid' else 'test' end as part from r")
def three_way(spark, sf_dir):
    """60, 20 and 20 of a hundred of each class."""
    return P.parts_by_class(claims(spark, sf_dir).select("claim_id", "pos"), "pos", ["claim_id"], {"train": 0.6, "valid": 0.2, "test": 0.2})


@query(WITH + f", g as (select up, dn, cast(avg(pos) >= 0.5 as integer) as l from c group by up, dn), r as (select *, row_number() over (partition by l order by {P.uniform_sql(0, 'up', 'dn')}, up, dn) as p, count(*) over (partition by l) as n from g) select claim_id, case when p <= round(n * 0.7) then 'train' else 'test' end as part from c join r using (up, dn)")
def stratified_groups(spark, sf_dir):
    """Interactions kept whole, in proportion of those with mostly positive and mostly negative claims."""
    x = P.stratified_group_split(claims(spark, sf_dir), ["up", "dn"], {"train": 0.7, "test": 0.3}, (F.avg("pos") >= 0.5).cast("int"))
    return x.select("claim_id", "part")


@query()
def length_draw(spark, sf_dir):
    return P.length_draw(claims(spark, sf_dir).select("claim_id", "up", "dn"), ["up", "dn"], 0.3, 1.5)


_B = WITH + ", b as (select up, dn, year, cast(sum(pos) as bigint) as k, count(*) as n from c group by up, dn, year)"
_GROW = _B + f", i as (select *, row_number() over (partition by up, dn order by year) as i, {P.uniform_sql(0, 'up', 'dn')} as u from b), s as (select *, sum(n) over (order by i, u, up, dn) as step from i)"


def _grown(spark, sf_dir):
    b = W.batches(claims(spark, sf_dir), "pos")
    total = b.agg(F.sum("n")).first()[0]
    return P.grow_histories(b, ["up", "dn"], total // 3, "min"), total


@query(_GROW + ", q as (select up, dn, sum(case when step - n < (select sum(n) // 3 from b) then n else 0 end) as f, sum(n) as p, count(*) filter (where step - n < (select sum(n) // 3 from b)) as b from s group by up, dn) select count(*) as histories, count(*) filter (where f > 0) as begun, count(*) filter (where f = p) as complete, cast(sum(b) as bigint) as batches, cast(sum(f) as bigint) as claims from q")
def population_stats(spark, sf_dir):
    return P.population_stats(_grown(spark, sf_dir)[0], ["up", "dn"])


_TRUTH = "tr as (select up, dn, avg(cdf_exp) as truth from c where cdf_exp is not null group by up, dn)"


def _truth(spark, sf_dir):
    return claims(spark, sf_dir).where("cdf_exp is not null").groupBy("up", "dn").agg(F.avg("cdf_exp").alias("truth"))


@query(_GROW + f", {_TRUTH}, g as (select unnest(range(1, 11)) as i), e as (select g.i, up, dn, sum(k) / sum(n) as p from s, g where step - n < (select sum(n) from b) * g.i // 10 group by all) select cast((select sum(n) from b) * i // 10 as integer) as budget, count(*) as n, {r6('avg(cast((p > 0.5) = (truth > 0.5) as integer))')} as accuracy, {r6('avg(pow(p - truth, 2))')} as mse from e join tr using (up, dn) group by i")
def populate(spark, sf_dir):
    """Estimates against the experiment as a tenth, two tenths and so on of the claims are revealed."""
    grown, total = _grown(spark, sf_dir)
    return rounded(P.populate(grown, _truth(spark, sf_dir), ["up", "dn"], [total * i // 10 for i in range(1, 11)]), "accuracy", "mse")


@query(_B + f", {_TRUTH}, y as (select distinct year as look from b), e as (select look, up, dn, sum(k) / sum(n) as p from b join y on b.year <= y.look group by all) select look, count(*) as n, {r6('avg(cast((p > 0.5) = (truth > 0.5) as integer))')} as accuracy, {r6('avg(pow(p - truth, 2))')} as mse from e join tr using (up, dn) group by look")
def populate_by_year(spark, sf_dir):
    b = W.batches(claims(spark, sf_dir), "pos")
    return rounded(P.populate_by_year(b, _truth(spark, sf_dir), ["up", "dn"]), "accuracy", "mse")


@query(WITH + ", s as (select count(*) as n from c group by up, dn), h as (select n, count(*) as k from s group by n), g as (select 1.01 + unnest(range(0, 2500)) / 500e0 as g), z as (select g, ln(sum(pow(i, -g))) as z from g, (select unnest(range(1, (select max(n) from s) + 1)) as i) group by g), l as (select g, sum(k * (g * ln(n) + z)) as l from h, z join g using (g) group by g) select round(arg_min(g, l), 1) as exponent from l")
def length_power_law(spark, sf_dir):
    """The likeliest exponent of a power law of the lengths of histories."""
    h = claims(spark, sf_dir).groupBy("up", "dn").count().groupBy("count").agg(F.count(F.lit(1)).alias("k")).collect()
    return spark.createDataFrame([(round(P.power_law_exponent({r["count"]: r["k"] for r in h}), 1),)], "exponent double")


_SYN = ", ".join(f"{P.uniform_sql(i, 'id')} as u{i}" for i in range(4))


@query(f"with i as (select range as id from range(0, 2000)), u as (select id, {_SYN} from i), m as (select *, case when u0 < 0.6 then 0 else 1 end as mode, greatest(1e-6, least(1 - 1e-6, u1)) as q from u), z as (select *, {_NEWTON} as z from m), t as (select id, mode, exp(case mode when 0 then 0.5 + 0.4 * z else 1.5 + 0.3 * z end) + case mode when 0 then 0 else 3 end as t, u2 * 2 - 1 as x, u3 from z), p as (select *, 1 / (1 + exp(-(1 + 3 / (1 + exp(-2 * (t - 5)))) * x)) as p from t) select id, mode, {r6('t')} as t, {r6('x')} as x, {r6('p')} as p, cast(u3 < p as integer) as pos from p")
def synthetic_claims(spark, sf_dir):
    """2,000 generated claims of two modes with a step in the coefficient."""
    return rounded(P.synthetic_claims(spark, 2000, [(0.6, 0.5, 0.4, 0.0), (0.4, 1.5, 0.3, 3.0)], (5.0, 2.0, 1.0, 4.0)), "t", "x", "p")


@query(WITH + f", x as (select journal, ai, count(*) over (partition by journal order by ai range between unbounded preceding and current row) as upto, count(*) over (partition by journal) as total from c where ai > 0), m as (select *, cast(floor((upto - 1) * 2 / total) as integer) as mode from x) select journal, mode, {r6('avg(ln(ai))')} as mu, {r6('sqrt(greatest(avg(ln(ai) * ln(ai)) - avg(ln(ai)) * avg(ln(ai)), 0))')} as sigma, {r6('count(*) / max(total)')} as share from m group by journal, mode")
def start_modes(spark, sf_dir):
    """Two starting modes of each journal's influence."""
    x = P.start_modes(claims(spark, sf_dir), ["journal"], "ai", 2)
    return x.select("journal", "mode", F.round(F.col("mu") + 1e-9, 6).alias("mu"), half_up(F.col("sigma")).alias("sigma"), half_up(F.col("share")).alias("share"))
