"""Queries of paper-unit graphs, communities, text and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions.math import half_up
from claimweave.operators import bipartite as G
from claimweave.operators import community as C
from claimweave.operators import reshape as S
from claimweave.operators import text as X
from claimweave.operators import windows as W
from claimweave.session import table
from claimweave.sources.claims import UNITS_SQL, WITH, claims, experiments, paper_units

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


_U = WITH + ", " + UNITS_SQL
_WIN = _U + """, p as (select distinct c.up, c.dn, y.look, c.pmid, c.year from c join (select distinct up, dn, year as look from c) y on c.up = y.up and c.dn = y.dn and c.year <= y.look and c.year > y.look - 3),
pp as (select distinct up, dn, look, pmid from p), e as (select pp.*, unit from pp join units using (pmid)), d as (select up, dn, look, unit, count(*) as deg from e group by all), s as (select up, dn, look, count(*) as n_papers from pp group by all)"""


@query(_WIN + f""", t as (select * from (select *, row_number() over w as r, count(*) over (partition by up, dn, look) as v from d window w as (partition by up, dn, look order by deg desc, unit)) where r <= ceil(0.5 * v)),
g as (select up, dn, look, sum(deg * deg) as q, count(*) as m, max(v) as v, sum(deg) as e from t group by all)
select up, dn, look, n_papers, coalesce(v, 0) as n_units, cast(coalesce(e, 0) as bigint) as n_edges, {r6('coalesce(case when n_papers > 1 then q / (m * n_papers * n_papers) end, 0)')} as support from s left join g using (up, dn, look)""")
def support_index(spark, sf_dir):
    return rounded(G.support_index(claims(spark, sf_dir), paper_units(spark, sf_dir), 3, 0.5), "support")


@query(_WIN + f""", o as (select distinct up, dn, look, pmid from p where year = look),
a as (select o.up, o.dn, o.look, o.pmid, sum(deg - 1) / count(*) as x from o join e using (up, dn, look, pmid) join d using (up, dn, look, unit) group by all)
select up, dn, look, pmid, {r6('coalesce(case when n_papers > 1 then x / (n_papers - 1) end, 0)')} as affinity from o join s using (up, dn, look) left join a using (up, dn, look, pmid)""")
def affinity_index(spark, sf_dir):
    return rounded(G.affinity_index(claims(spark, sf_dir), paper_units(spark, sf_dir), 3), "affinity")


@query(_U + """, x as (select distinct up, dn, year, pmid from c), e as (select x.*, unit from x join units using (pmid)),
n as (select up, dn, unit, year, count(*) as n from e group by all), b as (select *, coalesce(sum(n) over (partition by up, dn, unit order by year rows between unbounded preceding and 1 preceding), 0) as before from n)
select x.up, x.dn, x.year, x.pmid, cast(coalesce(max(before), 0) as bigint) as numsum from x left join e using (up, dn, year, pmid) left join b using (up, dn, unit, year) group by all""")
def batch_numsum(spark, sf_dir):
    return G.batch_numsum(claims(spark, sf_dir), paper_units(spark, sf_dir))


@query(_U + f""", e as (select distinct up, dn, year, pmid, unit from c join units using (pmid)), s as (select *, 1e0 / count(*) over (partition by up, dn, year, pmid) as s from e),
y as (select distinct up, dn, year as look from e), t as (select y.up, y.dn, y.look, unit, sum(s) as s from y join s on s.up = y.up and s.dn = y.dn and s.year <= y.look group by all),
h as (select up, dn, look as year, count(*) as n, case when count(*) > 1 then (sum(s * s) / (sum(s) * sum(s)) - 1e0 / count(*)) / (1 - 1e0 / count(*)) else 1 end as hi from t group by all)
select up, dn, year, n as n_units, {r6('hi')} as hi, {r6('lag(hi) over (partition by up, dn order by year)')} as previous_hi from h""")
def nhi(spark, sf_dir):
    x = G.concentration(claims(spark, sf_dir), paper_units(spark, sf_dir)).withColumn("n_units", F.col("n_units").cast("long"))
    return rounded(x, "hi", "previous_hi")


_CLS = _U + """, ul as (select pmid, list_sort(list(distinct unit)) as us from units group by pmid), pl as (select distinct c.up, c.dn, c.pmid, us from c join ul using (pmid)), cl as materialized (select up, dn, us, min(pmid) as pmid, count(*) as members from pl group by all)"""


@query(_CLS + f", j as (select a.up, a.dn, a.pmid as a, b.pmid as b, a.members as members_a, b.members as members_b, len(list_intersect(a.us, b.us)) as s, len(a.us) as na, len(b.us) as nb from cl a join cl b on a.up = b.up and a.dn = b.dn and a.pmid < b.pmid) select up, dn, a, b, members_a, members_b, {r6('s / (na + nb - s)')} as jaccard from j where s / (na + nb - s) >= 0.5 - 1e-12")
def jaccard(spark, sf_dir):
    return rounded(G.similar_papers(claims(spark, sf_dir), paper_units(spark, sf_dir), 0.5), "jaccard")


@query(_CLS + " select pl.up, pl.dn, pl.pmid, cl.pmid as class, members from pl join cl using (up, dn, us)")
def jaccard_members(spark, sf_dir):
    return G.class_members(claims(spark, sf_dir), paper_units(spark, sf_dir))


@query(WITH + """, f as (select up, dn, min(year) as year from c group by up, dn)
select claim_id, """ + ", ".join(f"(select count(*) from f where f.{g} = c.{end} and f.year < c.year) as {end}_{k}" for end in ("up", "dn") for g, k in (("up", "out"), ("dn", "in"))) + " from c")
def prev_degrees(spark, sf_dir):
    return G.previous_degrees(claims(spark, sf_dir)).select("claim_id", "up_out", "up_in", "dn_out", "dn_in")


@query(WITH + "select up as gene, count(distinct dn) as deg_out from c group by up")
def vertex_degrees(spark, sf_dir):
    return claims(spark, sf_dir).groupBy(F.col("up").alias("gene")).agg(F.countDistinct("dn").alias("deg_out"))


_CM, _CL = C.modularity_communities_sql("bo", ["up", "dn"])
_DET = _U + f""", ed as materialized (select up, dn, 'p' || pmid as p, 'u:' || unit as u from (select distinct up, dn, pmid from c) join units using (pmid)),
bo as materialized (select up, dn, x, y, sum(w) as w from (select up, dn, p as x, u as y, 1e0 as w from ed union all select up, dn, u, p, 1e0 from ed) group by all), {_CM},
lab as materialized (select up, dn, cast(substring(node, 2) as bigint) as pmid, label from {_CL} where node not like 'u:%'),
sz as (select up, dn, label, count(*) as comm_size from lab group by all), tt as (select up, dn, count(*) as n_comms, sum(comm_size) as n_nodes from sz group by all),
det as materialized (select lab.up, lab.dn, pmid, lab.label, comm_size, n_comms, comm_size / n_nodes as rel_size from lab join sz using (up, dn, label) join tt using (up, dn)),
rk as materialized (select det.*, rank from det join (select up, dn, label, dense_rank() over (partition by up, dn order by comm_size desc) - 1 as rank from sz) using (up, dn, label))"""


def _communities(spark, sf_dir):
    e = claims(spark, sf_dir).select("up", "dn", "pmid").distinct().join(paper_units(spark, sf_dir), "pmid").select("up", "dn", F.concat(F.lit("p"), "pmid").alias("p"), F.concat(F.lit("u:"), "unit").alias("unit"))
    labels = C.modularity_communities(e, ["up", "dn"], "p", "unit").where("node not like 'u:%'")
    return C.community_table(labels, ["up", "dn"]).withColumn("pmid", F.expr("cast(substring(node, 2) as bigint)"))


@query(_DET + f" select up, dn, pmid, label as community, comm_size, n_comms, {r6('rel_size')} as rel_size from det")
def communities(spark, sf_dir):
    x = _communities(spark, sf_dir).select("up", "dn", "pmid", F.col("label").alias("community"), "comm_size", "n_comms", "rel_size")
    return rounded(x, "rel_size")


def _ranked(spark, sf_dir):
    return C.ranked_communities(_communities(spark, sf_dir), ["up", "dn"], "label", "comm_size")


@query(_DET + " select up, dn, pmid, label, cast(rank as integer) as rank from rk where (up, dn) in (select (up, dn) from rk where rank < 2 group by up, dn having count(distinct rank) = 2)")
def community_ranks(spark, sf_dir):
    return C.lowest_ranks_present(_ranked(spark, sf_dir), ["up", "dn"], "rank", 2).select("up", "dn", "pmid", "label", F.col("rank").cast("int").alias("rank"))


@query(_DET + " select up, dn, pmid from rk where (up, dn, label) in (select (up, dn, min(label)) from rk where rank = 0 group by up, dn)")
def largest_community(spark, sf_dir):
    return C.community_of_rank(_ranked(spark, sf_dir), ["up", "dn"], "label", "rank", 0).select("up", "dn", "pmid")


@query(_DET + " select up, dn, pmid from det where n_comms between 2 and 5")
def few_communities(spark, sf_dir):
    return C.community_count_between(_communities(spark, sf_dir), ["up", "dn"], "label", 2, 5).select("up", "dn", "pmid")


@query(_DET + """, m as (select c.*, label from c join det using (up, dn, pmid)), b as (select up, dn, label, year, sum(pos) as k, count(*) as n from m group by all)
select up, dn, label, year, cast(sum(k) over w / sum(n) over w > 0.5 as integer) as vote from b window w as (partition by up, dn, label order by year rows between unbounded preceding and 1 preceding)""")
def detected_vote(spark, sf_dir):
    m = claims(spark, sf_dir).join(_communities(spark, sf_dir).select("up", "dn", "pmid", "label"), ["up", "dn", "pmid"])
    return C.earlier_majority(m, ["up", "dn"], "label")


@query(_DET + f""", m as (select c.*, label from c join det using (up, dn, pmid)), a as (select up, dn, year, label, avg(pos) as m from m group by all), b as (select up, dn, year, avg(m) as m from a group by all) select up, dn, {r6('avg(m)')} as m from b group by up, dn""")
def detected_mean_of_means(spark, sf_dir):
    """Mean over communities, then years: every detected community of a year has one voice."""
    from claimweave.operators.aggregates import mean_of_means
    m = claims(spark, sf_dir).join(_communities(spark, sf_dir).select("up", "dn", "pmid", "label"), ["up", "dn", "pmid"])
    return rounded(mean_of_means(m, [["up", "dn", "year", "label"], ["up", "dn", "year"], ["up", "dn"]], "pos"), "m")


@query(_DET + f""", m as (select c.up, c.dn, label, c.pos from c join det using (up, dn, pmid)), p as (select up, dn, label, avg(ln(0.2 + 0.6 * pos)) as l0, avg(ln(0.8 - 0.6 * pos)) as l1 from m group by all), s as (select up, dn, round(sum(l0), 9) as l0, round(sum(l1), 9) as l1 from p group by all)
select up, dn, case when l0 >= l1 then 0 else 1 end as vote from s""")
def community_log_vote(spark, sf_dir):
    """Mean log probability per detected community, summed over communities; the winning class."""
    from claimweave.operators.estimates import vote_by_community
    m = claims(spark, sf_dir).join(_communities(spark, sf_dir).select("up", "dn", "pmid", "label"), ["up", "dn", "pmid"])
    return vote_by_community(m.withColumns({"a": 0.2 + 0.6 * F.col("pos"), "d": 0.8 - 0.6 * F.col("pos")}), ["a", "d"], "label")


@query(_DET + """, m as (select c.claim_id, c.up, c.dn, c.year, c.pos, label from c join det using (up, dn, pmid)), b as (select up, dn, label, year, sum(pos) as k, count(*) as n from m group by all),
v as (select up, dn, label, year, cast(sum(k) over w / sum(n) over w > 0.5 as integer) as vote from b window w as (partition by up, dn, label order by year rows between unbounded preceding and 1 preceding))
select claim_id, cast(coalesce(pos = vote, false) as integer) as agrees from m join v using (up, dn, label, year)""")
def community_agreement(spark, sf_dir):
    """Whether the claim agrees with the earlier majority of its community; without one it does not."""
    from claimweave.operators.features import agreement
    m = claims(spark, sf_dir).join(_communities(spark, sf_dir).select("up", "dn", "pmid", "label"), ["up", "dn", "pmid"])
    votes = C.earlier_majority(m, ["up", "dn"], "label")
    return m.join(votes, ["up", "dn", "label", "year"]).select("claim_id", agreement(F.col("pos"), F.col("vote")).alias("agrees"))


_GC, _GCL = C.modularity_communities_sql("bo", ["g"])


@query(WITH + f""", e as (select cast(up as varchar) as a, cast(dn as varchar) as b, count(*) as w from c where up <> dn group by all), bo as materialized (select 0 as g, x, y, cast(sum(w) as double) as w from (select a as x, b as y, w from e union all select b, a, w from e) group by all), {_GC}
select cast(node as bigint) as gene, label, count(*) over (partition by label) as comm_size from {_GCL}""")
def global_communities(spark, sf_dir):
    e = claims(spark, sf_dir).groupBy("up", "dn").agg(F.count(F.lit(1)).alias("w"))
    return C.community_table(C.modularity_communities(e.withColumn("g", F.lit(0)), ["g"], "up", "dn", "w"), ["g"]).select(F.col("node").cast("long").alias("gene"), "label", "comm_size")


@query(WITH + f""", e as (select cast(up as varchar) as a, cast(dn as varchar) as b, count(*) as w from c where up <> dn group by all), bo as materialized (select 0 as g, x, y, cast(sum(w) as double) as w from (select a as x, b as y, w from e union all select b, a, w from e) group by all), {_GC},
z as (select cast(node as bigint) as gene, label, count(*) over (partition by label) as size from {_GCL}) select claim_id, cast(coalesce(u.label = d.label, false) as integer) as same_comm, {r6('sqrt(u.size * d.size)')} as eff_comm_size from c left join z u on u.gene = c.up left join z d on d.gene = c.dn""")
def gene_community_features(spark, sf_dir):
    """Detected communities of both genes of a claim: whether they are one, and the mean of their sizes."""
    from claimweave.operators.relational import role_join
    out = role_join(claims(spark, sf_dir), global_communities(spark, sf_dir), "gene", ["label", "comm_size"])
    same = F.coalesce((F.col("label_up") == F.col("label_dn")).cast("int"), F.lit(0))
    return rounded(out.select("claim_id", same.alias("same_comm"), F.sqrt(F.col("comm_size_up") * F.col("comm_size_dn")).alias("eff_comm_size")), "eff_comm_size")


_COMM = WITH + ", m as (select *, pmid % 3 as comm from c)"


def _mod_communities(spark, sf_dir):
    return claims(spark, sf_dir).withColumn("comm", F.col("pmid") % 3)


@query(_COMM + ", z as (select up, dn, comm, count(*) as size from m group by all), r as (select *, dense_rank() over (partition by up, dn order by size desc) - 1 as rank from z), k as (select up, dn from r where rank < 2 group by up, dn having count(distinct rank) = 2) select claim_id, rank from m join r using (up, dn, comm) join k using (up, dn)")
def min_communities(spark, sf_dir):
    m = _mod_communities(spark, sf_dir)
    size = m.groupBy("up", "dn", "comm").agg(F.count(F.lit(1)).alias("size"))
    x = C.ranked_communities(m.join(size, ["up", "dn", "comm"]), ["up", "dn"], "comm", "size")
    return C.lowest_ranks_present(x, ["up", "dn"], "rank", 2).select("claim_id", F.col("rank").cast("long").alias("rank"))


@query(_COMM + ", z as (select up, dn, comm, count(*) as size from m group by all), r as (select *, dense_rank() over (partition by up, dn order by size desc) - 1 as rank from z), f as (select up, dn, min(comm) as comm from r where rank = 0 group by up, dn) select claim_id from m join f using (up, dn, comm)")
def community_by_rank(spark, sf_dir):
    m = _mod_communities(spark, sf_dir)
    size = m.groupBy("up", "dn", "comm").agg(F.count(F.lit(1)).alias("size"))
    x = C.ranked_communities(m.join(size, ["up", "dn", "comm"]), ["up", "dn"], "comm", "size")
    return C.community_of_rank(x, ["up", "dn"], "comm", "rank", 0).select("claim_id")


@query(_COMM + "select claim_id from m where (up, dn) in (select (up, dn) from m group by up, dn having count(distinct comm) between 2 and 3)")
def interval_communities(spark, sf_dir):
    return C.community_count_between(_mod_communities(spark, sf_dir), ["up", "dn"], "comm", 2, 3).select("claim_id")


@query(_COMM + ", b as (select up, dn, comm, year, sum(pos) as k, count(*) as n from m group by all) select up, dn, comm, year, cast(sum(k) over w / sum(n) over w > 0.5 as integer) as vote from b window w as (partition by up, dn, comm order by year rows between unbounded preceding and 1 preceding)")
def community_vote(spark, sf_dir):
    return C.earlier_majority(_mod_communities(spark, sf_dir), ["up", "dn"], "comm")


@query("select claim_id, list_filter(list_distinct(list_transform(string_split(regexp_replace(affs, '\\[[^\\]]*\\]', '', 'g'), '|'), lambda p: trim(replace(lower(string_split(p, ',')[1]), '& ', '')))), lambda p: p <> '') as units from claims where affs is not null".replace("list_distinct(", "list_sort(list_distinct(").replace("lambda p: trim(replace(lower(string_split(p, ',')[1]), '& ', '')))", "lambda p: trim(replace(lower(string_split(p, ',')[1]), '& ', ''))))"))
def affiliation_tokens(spark, sf_dir):
    return table(spark, sf_dir, "claims").where("affs is not null").select("claim_id", F.array_sort(X.affiliation_units("affs")).alias("units"))


@query("select distinct journal, list_filter(string_split(lower(journal), ' '), lambda w: w not in ('a','an','and','at','by','for','from','in','of','on','or','the','to','with')) as words from claims")
def string_split(spark, sf_dir):
    j = table(spark, sf_dir, "claims").select("journal").distinct()
    return j.select("journal", X.tokens(X.split_phrases(F.col("journal"))[0]).alias("words"))


_J = "with j as (select distinct journal from claims), p as (select a.journal as a, b.journal as b from j a join j b on a.journal < b.journal and string_split(a.journal, ' ')[1] = string_split(b.journal, ' ')[1])"


def _journal_pairs(spark, sf_dir):
    j = table(spark, sf_dir, "claims").select("journal").distinct().withColumn("head", F.split("journal", " ")[0])
    return j.select("head", F.col("journal").alias("a")).join(j.select("head", F.col("journal").alias("b")), "head").where("a < b")


@query(_J + f"select a, b, {r6('levenshtein(a, b) / least(length(a), length(b))')} as ratio, {r6('list_min(list_transform(range(0, abs(length(a) - length(b)) + 1), lambda k: levenshtein(case when length(a) <= length(b) then a else b end, substring(case when length(a) <= length(b) then b else a end, k + 1, least(length(a), length(b)))))) / least(length(a), length(b))')} as root from p")
def edit_root(spark, sf_dir):
    p = _journal_pairs(spark, sf_dir)
    return rounded(p.select("a", "b", X.edit_ratio(F.col("a"), F.col("b")).alias("ratio"), X.edit_root(F.col("a"), F.col("b")).alias("root")), "ratio", "root")


@query()
def phrase_distance(spark, sf_dir):
    w = lambda c: X.tokens(F.lower(c))
    return _journal_pairs(spark, sf_dir).select("a", "b", F.round(X.word_distance(w(F.col("a")), w(F.col("b"))), 6).alias("distance"))


_ORG = "o as (select trim(replace(lower(string_split(a, ',')[1]), '& ', '')) as org from (select unnest(list_distinct(string_split(regexp_replace(affs, '\\[[^\\]]*\\]', '', 'g'), '|'))) as a from claims where affs is not null) where trim(replace(lower(string_split(a, ',')[1]), '& ', '')) <> '')"


@query(f"""with {_ORG}, i as (select distinct org from o), j as (select distinct journal as entity from claims where journal is not null), f as (select org, translate(org, '{X.ACCENTED}', '{X.PLAIN}') as x from i), e as (select entity, translate(lower(entity), '{X.ACCENTED}', '{X.PLAIN}') as y from j),
k as materialized (select org as entity, x as y from f where org in (select org from o group by org having count(*) >= 20)),
d as (select org, entity, round(levenshtein(x, y) / least(length(x), length(y)), 9) as distance from f, k where levenshtein(x, y) <= floor(0.25 * least(length(x), length(y)))), b as (select org, arg_min(struct_pack(d := distance, e := entity), struct_pack(d := distance, e := entity)) as b from d where distance < 0.25 group by org)
select org, b.e as entity, b.d as distance from i left join b using (org)""")
def nearest_entity(spark, sf_dir):
    """Each organisation as typed with the nearest frequent one (typed at least 20 times) within a quarter of its letters."""
    orgs = table(spark, sf_dir, "claims").select(F.explode(X.affiliation_units("affs")).alias("org"))
    known = orgs.groupBy("org").count().where("count >= 20").select(F.col("org").alias("entity"))
    return X.nearest_entity(orgs, known, "org", "entity", 0.25)


@query(WITH + f"select up, dn, {r6('avg(pos) filter (where origin = ' + chr(39) + 'gw' + chr(39) + ')')} as est_gw, {r6('avg(pos) filter (where origin = ' + chr(39) + 'lit' + chr(39) + ')')} as est_lit from c group by up, dn")
def pivot_case(spark, sf_dir):
    return rounded(S.pivot_cases(claims(spark, sf_dir), ["up", "dn"], "origin", ["gw", "lit"], F.avg("pos"), "est_"), "est_gw", "est_lit")


@query("with e as (select * from experiments where score is not null and isfinite(score) and up > 0 and dn > 0), m as (select up, dn, avg(score) filter (where pert_type = 'trt_kd') as kd, avg(score) filter (where pert_type = 'trt_ov') as ov from e group by up, dn), l as (select up, dn, 'kd' as kind, kd as v from m union all select up, dn, 'ov', ov from m) select up, dn, kind, round(v + 1e-9, 6) as v from l where abs(v) > 0.5")
def unpivot_edges(spark, sf_dir):
    wide = S.pivot_cases(experiments(spark, sf_dir), ["up", "dn"], "pert_type", ["trt_kd", "trt_ov"], F.avg("score"), "").withColumnsRenamed({"trt_kd": "kd", "trt_ov": "ov"})
    return rounded(S.long_edges(wide, ["up", "dn"], ["kd", "ov"], "kind", "v", 0.5), "v")


@query("select journal, dense_rank() over (order by journal) - 1 as code from (select distinct journal from claims)")
def dict_encode(spark, sf_dir):
    return W.dense_codes(table(spark, sf_dir, "claims").select("journal").distinct(), ["journal"], "code")


@query("select wos_id, list_sort(list(distinct uid)) as cited from wos_citations where wos_id is not null and uid is not null and wos_id <> uid group by wos_id")
def adjacency_lists(spark, sf_dir):
    return S.adjacency(table(spark, sf_dir, "wos_citations"), "wos_id", "uid", "cited")


@query("with p as (select distinct pmid, wos_id from publications where pmid is not null and wos_id is not null), c as (select distinct wos_id, uid from wos_citations where wos_id is not null and uid is not null and wos_id <> uid) select 'past' as kind, p.pmid, q.pmid as unit from c join p on p.wos_id = c.wos_id join p q on q.wos_id = c.uid union all select 'future', q.pmid, p.pmid from c join p on p.wos_id = c.wos_id join p q on q.wos_id = c.uid")
def paper_mapping(spark, sf_dir):
    return S.citation_units(table(spark, sf_dir, "publications"), table(spark, sf_dir, "wos_citations"))


@query("select upper(symbol) as symbol, max(entrez_id) as entrez_id from gene_ids where symbol is not null and entrez_id is not null group by all")
def gene_converter(spark, sf_dir):
    return S.id_mapping(table(spark, sf_dir, "gene_ids"), "symbol", "entrez_id", case="upper")


@query("with c as (select distinct up from claims where up > 0), m as (select entrez_id, max(upper(symbol)) as symbol from gene_ids where symbol is not null and entrez_id is not null group by all) select up, symbol from c left join m on c.up = m.entrez_id")
def gene_lookup(spark, sf_dir):
    genes = table(spark, sf_dir, "claims").select("up").where("up > 0").distinct()
    m = S.id_mapping(table(spark, sf_dir, "gene_ids").withColumn("symbol", F.upper("symbol")), "entrez_id", "symbol")
    return S.look_up(genes, m, "up", "entrez_id", "symbol")


@query("with p as (select pmid, trim(cite_count) as t from publications where cite_count is not null), n as (select pmid, cast(try_cast(replace(t, ',', '') as double) as bigint) as n from p) select pmid, max(n) as cites from n where pmid is not null and n is not null group by pmid")
def cite_counts(spark, sf_dir):
    p = table(spark, sf_dir, "publications")
    n = F.expr("cast(try_cast(replace(trim(cite_count), ',', '') as double) as bigint)")
    return p.select("pmid", n.alias("n")).where("pmid is not null and n is not null").groupBy("pmid").agg(F.max("n").alias("cites"))
