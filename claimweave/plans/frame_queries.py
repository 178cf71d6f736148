"""Queries of sources and sinks, mappings, reshaping and phrases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.functions.math import half_up, norm_cdf
from claimweave.operators import features as X
from claimweave.operators import relational as R
from claimweave.operators import reshape as S
from claimweave.operators import text as T
from claimweave.operators import windows as W
from claimweave.session import shared_folder, table
from claimweave.sources import files
from claimweave.sources.claims import READINGS_SQL, WITH, claims, experiments, readings

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


def _place(spark):
    return f"{shared_folder(spark)}/claimweave/{uuid.uuid4().hex}"


_R = "with " + READINGS_SQL
_E = "with e as (select *, case when pert_itime like '% d' then 24 else 1 end * cast(regexp_extract(pert_itime, '[0-9]+') as double) as hours from experiments where score is not null and isfinite(score) and up > 0 and dn > 0)"


@query(_R + " select claim_id, pos, origin, year % 2 as half from readings where origin in ('lit', 'gw')")
def report_grid(spark, sf_dir):
    """Report files per origin and half, written under names made of their parameters and loaded as a grid."""
    r, path = readings(spark, sf_dir).withColumn("half", F.col("year") % 2), _place(spark)
    for origin in ("lit", "gw"):
        for half in (0, 1):
            files.write_csv(r.where((F.col("origin") == origin) & (F.col("half") == half)).select("claim_id", "pos"), f"{path}/claims_{origin}_h_{half}.csv.gz")
    return files.read_grid(spark, path, "claims_{origin}_h_{half}.csv.gz", {"origin": ["lit", "gw"], "half": [0, 1]}, r.select("claim_id", "pos").schema)


@query(_E + " select sig_id, cell_id, score from e where cell_id in ('QX7', 'LB12') and sig_id like '%5'")
def matrix_scan(spark, sf_dir):
    """Part of the score matrix (signature x cell), stored as a long table: the lists are pushed to the scan."""
    path = _place(spark)
    files.write_table(experiments(spark, sf_dir).select("sig_id", "cell_id", "score"), path)
    return files.matrix_part(spark.read.parquet(path), "sig_id", "cell_id", columns=["QX7", "LB12"]).where("sig_id like '%5'")


@query("with g as (select * from gene_ids), d as (select *, row_number() over (order by hgnc_id nulls first, entrez_id nulls first, symbol nulls first) as pl from g) select lower(symbol) as symbol, arg_max(entrez_id, pl) as entrez_id from d where symbol is not null and entrez_id is not null group by lower(symbol)")
def gene_dictionary(spark, sf_dir):
    """A JSON export of gene ids read as one table; any two id types give a mapping, the last record winning."""
    path = _place(spark)
    g = table(spark, sf_dir, "gene_ids").select("hgnc_id", F.col("entrez_id").cast("string").alias("entrez_id"), "symbol", F.col("entrez_id").alias("n"))
    docs = F.transform(F.array_sort(F.collect_list(F.struct("hgnc_id", "n", "symbol"))), lambda d: F.struct(d["hgnc_id"].alias("hgnc_id"), d["n"].cast("string").alias("entrez_id"), d["symbol"].alias("symbol")))
    g.agg(F.struct(docs.alias("docs")).alias("response")).coalesce(1).write.json(path)
    ids = files.read_id_table(spark, path, ["hgnc_id", "entrez_id", "symbol"], ("entrez_id",), lower=True)
    return files.id_pairs(ids, "symbol", "entrez_id")


@query("select claim_id, up, dn, ai from claims where claim_id % 7 >= 0")
def shard_round_trip(spark, sf_dir):
    path = _place(spark)
    files.write_shards(table(spark, sf_dir, "claims").select("claim_id", "up", "dn", "ai"), path, 8, ["claim_id"])
    return spark.read.parquet(path).drop("shard")


@query(WITH + f", s as (select up, dn, avg(pos) as p, count(*) as n from c group by up, dn) select up, dn, 'pi_last' as name, {r6('p')} as value from s union all select up, dn, 'pi_first', {r6('1 - p')} from s")
def report_parsers(spark, sf_dir):
    """Reports with nested estimates, written and read as JSON; the point estimates picked by prefix."""
    path = _place(spark)
    s = claims(spark, sf_dir).groupBy("up", "dn").agg(F.avg("pos").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    files.write_report(s.select("up", "dn", F.create_map(F.lit("pi_last"), "p", F.lit("pi_first"), 1 - F.col("p"), F.lit("pi_err"), F.lit(0.0), F.lit("n"), "n").alias("estimates")), path)
    r = spark.read.schema("up bigint, dn bigint, estimates map<string, double>").json(path)
    return rounded(S.metric_rows(r, ["up", "dn"], files.chosen_parameters(F.col("estimates"), "pi", "err")).withColumnRenamed("metric", "name"), "value")


@query(_E + " select sig_id from e where pert_type in ('trt_kd', 'trt_ov') and hours >= 24 and pert_idose in ('1.5 µL', '2 µL') and is_touchstone = 1")
def experiment_conditions(spark, sf_dir):
    return experiments(spark, sf_dir).where(files.experiment_filter(["trt_kd", "trt_ov"], 24, ["1.5 µL", "2 µL"])).select("sig_id")


_LAST = WITH + ", x as (select * from c where ai is not null and ar is not null and not (up = 7157 and dn = 1026)), y as (select *, count(*) over (partition by up, dn) as n from x) "


@query(_LAST + f"select claim_id, {r6('(ai - min(ai) over ()) / (max(ai) over () - min(ai) over ())')} as ai, {r6('(ar - min(ar) over ()) / (max(ar) over () - min(ar) over ())')} as ar from y where n > 4")
def last_stage(spark, sf_dir):
    """Complete rows of long histories without the excluded pair, scaled: one composed plan."""
    x = X.last_stage(claims(spark, sf_dir), ["ai", "ar"], "lit", 4, ((7157, 1026),))
    return rounded(x.select("claim_id", "ai", "ar"), "ai", "ar")


@query(WITH + ", i as (select up, dn, avg(pos) as p from c group by up, dn) select claim_id, (cdf_exp >= 0.5) <> (p >= 0.5) as prior_wrong, (cdf_exp >= 0.5) <> (pos = 1) as guess_wrong from c join i using (up, dn) where cdf_exp is not null")
def guess_quality(spark, sf_dir):
    """Whether the majority, and whether the claim itself, misses the experiment."""
    x = R.with_group_stats(claims(spark, sf_dir), ["up", "dn"], p=F.avg("pos")).where("cdf_exp is not null")
    prior, guess = X.guess_quality(F.col("cdf_exp") >= 0.5, F.col("p") >= 0.5, F.col("pos") == 1)
    return x.select("claim_id", prior.alias("prior_wrong"), guess.alias("guess_wrong"))


@query(WITH + """, b as (select up, dn, year, avg(pos) - 0.5 as v from c group by all), t as (select up, dn, year, coalesce(v * lag(v) over (partition by up, dn order by year) < 0, false) as flag, count(*) over (partition by up, dn) as y from b)
select claim_id, coalesce(abs(cdf_exp - pos) < 0.5, false) and flag as positive_transition from c join t using (up, dn, year) where y > 1""")
def positive_transition(spark, sf_dir):
    """Claims near the truth in a year in which the mean of their interaction changed sides."""
    c = claims(spark, sf_dir)
    b = c.groupBy("up", "dn", "year").agg((F.avg("pos") - 0.5).alias("v"))
    t = W.transitions(b, "v").select("up", "dn", "year", "sign_change")
    return c.join(t, ["up", "dn", "year"]).select("claim_id", X.positive_transition(F.col("cdf_exp") - F.col("pos"), F.col("sign_change")).alias("positive_transition"))


@query(WITH + ", k as (select distinct up, dn from experiments where up > 0 and dn > 0) select k.up, k.dn, c.pmid, c.pos from c right join k on k.up = c.up and k.dn = c.dn")
def right_join(spark, sf_dir):
    """Every pair with an experiment, with its claims where there are any."""
    k = table(spark, sf_dir, "experiments").where("up > 0 and dn > 0").select("up", "dn").distinct()
    return R.right_keys(claims(spark, sf_dir).select("up", "dn", "pmid", "pos"), k, ["up", "dn"])


@query(_E + ", w as (select distinct up, dn from claims where up > 0 and dn > 0) select up, dn, count(*) as n, 'served' as part from e join w using (up, dn) group by up, dn union all select up, dn, 0, 'missing' from w anti join e using (up, dn)")
def pair_restriction(spark, sf_dir):
    """Experiments of the pairs that have claims, and the pairs that cannot be served."""
    w = table(spark, sf_dir, "claims").where("up > 0 and dn > 0").select("up", "dn")
    kept, out = R.restrict_pairs(experiments(spark, sf_dir), w)
    served = kept.groupBy("up", "dn").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("served"))
    return served.unionByName(out.select("up", "dn", F.lit(0).cast("long").alias("n"), F.lit("missing").alias("part")))


@query(_E + f", few as (select pert_type, cell_id, avg(score) as m from e group by all), many as (select pert_type, cell_id, pert_idose, hours, avg(score) as d from e group by all) select pert_type, cell_id, pert_idose, hours, {r6('d - m')} as above from few join many using (pert_type, cell_id)")
def parameter_match(spark, sf_dir):
    """Results per dose and time against those of the study with the same kind and cell, whatever the rest."""
    e = experiments(spark, sf_dir)
    few = e.groupBy("pert_type", "cell_id").agg(F.avg("score").alias("m"))
    many = e.groupBy("pert_type", "cell_id", "pert_idose", "hours").agg(F.avg("score").alias("d"))
    return rounded(R.match_parameters(few, many, ["pert_type", "cell_id"]).select("pert_type", "cell_id", "pert_idose", "hours", (F.col("d") - F.col("m")).alias("above")), "above")


@query(WITH + ", a as (select up, dn, year, avg(pos) as p from c group by all), b as (select up, dn, year, count(*) as n from c group by all), d as (select up, dn, year, count(distinct journal) as j from c group by all) select up, dn, year, round(p + 1e-9, 6) as p, n, j from a join b using (up, dn, year) join d using (up, dn, year)")
def fold_join(spark, sf_dir):
    c = claims(spark, sf_dir)
    g = lambda e, n: c.groupBy("up", "dn", "year").agg(e.alias(n))
    return rounded(R.fold_join([g(F.avg("pos"), "p"), g(F.count(F.lit(1)), "n"), g(F.countDistinct("journal"), "j")], ["up", "dn", "year"]), "p")


@query("select claim_id, cast((row_number() over (order by claim_id) - 1) % 5 as integer) as shard from claims")
def dealt_shards(spark, sf_dir):
    return R.shards(table(spark, sf_dir, "claims").select("claim_id"), 5, ["claim_id"])


@query("with p as (select distinct pmid from publications where pmid is not null), u as (select pmid, list_sort(list(distinct journal)) as journals from claims where journal is not null group by pmid) select p.pmid, coalesce(journals, []) as journals from p left join u on u.pmid = p.pmid")
def complete_lists(spark, sf_dir):
    p = table(spark, sf_dir, "publications").where("pmid is not null").select(F.col("pmid").cast("long").alias("pmid")).distinct()
    u = table(spark, sf_dir, "claims").where("journal is not null").groupBy("pmid").agg(F.array_sort(F.collect_set("journal")).alias("journals"))
    return R.complete_lists(p, u, "pmid", "journals").withColumn("pmid", F.col("pmid").cast("int"))


_G = "with m as (select upper(symbol) as symbol, max(entrez_id) as entrez_id from gene_ids where symbol is not null and entrez_id is not null group by all), x as (select 'GENE' || up as symbol, up as entrez_id from (select distinct up from claims where up > 0) union select symbol, -1 from m where symbol like 'A%')"


def _mapping(spark, sf_dir):
    m = S.id_mapping(table(spark, sf_dir, "gene_ids"), "symbol", "entrez_id", case="upper")
    up = table(spark, sf_dir, "claims").where("up > 0").select("up").distinct()
    extra = up.select(F.concat(F.lit("GENE"), F.col("up").cast("string")).alias("symbol"), F.col("up").alias("entrez_id")).unionByName(
        m.where("symbol like 'A%'").select("symbol", F.lit(-1).cast("long").alias("entrez_id")))
    return m, extra


@query(_G + " select symbol, entrez_id from m union all select symbol, entrez_id from x where symbol not in (select symbol from m)")
def mapping_extended(spark, sf_dir):
    """A mapping with the entries of another whose key it lacks."""
    return S.add_missing(*_mapping(spark, sf_dir), "symbol")


@query(_G + " select symbol, entrez_id from x union all select symbol, entrez_id from m where symbol not in (select symbol from x)")
def mapping_updated(spark, sf_dir):
    """A mapping overwritten by the entries of another."""
    return S.update_mapping(*_mapping(spark, sf_dir), "symbol")


@query(_G + ", w as (select distinct upper(symbol) as symbol from gene_ids where entrez_id % 3 = 0 and symbol is not null) select symbol, entrez_id from m where symbol in (select symbol from w)")
def mapping_view(spark, sf_dir):
    w = table(spark, sf_dir, "gene_ids").where("entrez_id % 3 = 0 and symbol is not null").select(F.upper("symbol").alias("symbol"))
    return S.gene_view(_mapping(spark, sf_dir)[0], "symbol", "entrez_id", w)


@query("select entrez_id, 'b''' || entrez_id || '''' as wrapped, entrez_id as back from gene_ids where entrez_id is not null")
def byte_texts(spark, sf_dir):
    g = table(spark, sf_dir, "gene_ids").where("entrez_id is not null").select("entrez_id", S.wrap_bytes(F.col("entrez_id")).alias("wrapped"))
    return g.withColumn("back", S.unwrap_bytes(F.col("wrapped")).cast("long"))


@query("with a as (select origin, list_sort(list(distinct year)) as years from claims where year > 0 and origin is not null group by origin) select origin as key, unnest(years) as value from a")
def map_rows(spark, sf_dir):
    c = table(spark, sf_dir, "claims").where("year > 0 and origin is not null").groupBy("origin").agg(F.array_sort(F.collect_set("year")).alias("y"))
    one = c.agg(F.map_from_entries(F.collect_list(F.struct("origin", "y"))).alias("m"))
    return S.map_rows(one, [], "m")


@query(WITH + ", s as (select up, dn, avg(pos) as p, stddev_pop(pos) as d, cast(count(*) as double) as n from c group by up, dn) select up, dn, [round(p + 1e-9, 6), round(d + 1e-9, 6)] as modes, round(n + 1e-9, 6) as n, [round(d + 1e-9, 6), round(n + 1e-9, 6), round(p + 1e-9, 6)] as in_order from s")
def parameter_maps(spark, sf_dir):
    """Maps of parameters: the numbered ones apart from the others, values in key order, two maps as one."""
    s = claims(spark, sf_dir).groupBy("up", "dn").agg(half_up(F.avg("pos")).alias("p"), half_up(F.stddev_pop("pos")).alias("d"), half_up(F.count(F.lit(1)).cast("double")).alias("n"))
    m = S.merged_maps(F.create_map(F.lit("v_0"), F.lit(-1.0), F.lit("v_1"), F.col("d")), F.create_map(F.lit("v_0"), F.col("p"), F.lit("size"), F.col("n")))
    x = s.withColumn("m", m)
    numbered, rest = S.split_by_number(F.col("m"))
    every = F.create_map(F.lit("c"), "p", F.lit("a"), "d", F.lit("b"), "n")
    return x.select("up", "dn", F.transform(S.numbered_parameters(numbered), lambda e: e["v"]).alias("modes"), rest["size"].alias("n"), S.sorted_values(every).alias("in_order"))


@query(_R + " select up, dn, cast(dense_rank() over (order by up, dn) - 1 as bigint) as code, n, negated from (select up, dn, count(*) as n, cast(sum(1 - pos) as bigint) as negated from readings group by up, dn)")
def negation_codes(spark, sf_dir):
    return S.negation_codes(readings(spark, sf_dir).withColumn("no", 1 - F.col("pos")), ["up", "dn"], "no")


@query(_E + ", m as (select up, dn, avg(score) filter (where pert_type = 'trt_kd') as kd, avg(score) filter (where pert_type = 'trt_ov') as ov from e group by up, dn), l as (select up, dn, 'kd' as kind, kd as v from m union all select up, dn, 'ov', ov from m) select up, dn, kind, round(v + 1e-9, 6) as v from l where abs(v) > 0.6744897501960817")
def quantile_edges(spark, sf_dir):
    """Edges of the score matrices beyond the normal quantile of three quarters."""
    from claimweave.functions.math import norm_ppf
    cut = spark.range(1).select(norm_ppf(F.lit(0.75)).alias("q")).first()["q"]
    wide = S.pivot_cases(experiments(spark, sf_dir), ["up", "dn"], "pert_type", ["trt_kd", "trt_ov"], F.avg("score"), "").withColumnsRenamed({"trt_kd": "kd", "trt_ov": "ov"})
    return rounded(S.long_edges(wide, ["up", "dn"], ["kd", "ov"], "kind", "v", cut), "v")


_WORDS = "list_filter(string_split(trim({0}), ' '), lambda w: w <> '' and w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_PH = f"with j as (select distinct journal from claims where journal is not null), p as (select journal, list_filter(list_transform(string_split(lower(journal), ' of '), lambda x: {_WORDS.format('x')}), lambda ws: len(ws) > 0) as found from j)"


def _phrases(spark, sf_dir):
    j = table(spark, sf_dir, "claims").where("journal is not null").select("journal").distinct()
    return j.select("journal", T.phrases(F.col("journal"), " of ").alias("found"))


@query(_PH + " select journal, found, len(found) = 0 as garbage from p")
def journal_phrases(spark, sf_dir):
    return _phrases(spark, sf_dir).select("journal", "found", (F.size("found") == 0).alias("garbage"))


@query(_PH + ", h as (select journal, found, list_transform(found, lambda ws: len(list_filter(ws, lambda w: contains(w, 'cell') or contains(w, 'signal'))) > 0) as hit, list_transform(found, lambda ws: len(list_filter(ws, lambda w: w in ('annals', 'acta'))) > 0) as own from p) select journal, list_transform(list_filter(range(1, len(found) + 1), lambda i: hit[i] or own[i] or coalesce(hit[i + 1], false)), lambda i: found[i]) as rooted from h")
def rooted_phrases(spark, sf_dir):
    """Phrases that hold a target, are a back target, or stand right before a target."""
    return _phrases(spark, sf_dir).select("journal", T.rooted_phrases(F.col("found"), ["cell", "signal"], ["annals", "acta"]).alias("rooted"))


@query("with u as (select distinct pmid, trim(x) as unit from (select pmid, unnest(string_split(lower(aus), '|')) as x from claims where pmid is not null) where trim(x) <> ''), k as (select unit, dense_rank() over (order by unit) - 1 as code from u) select pmid, list_sort(list(distinct code)) as units from u join k using (unit) group by pmid")
def author_lists(spark, sf_dir):
    """Papers with the dense codes of their authors."""
    return T.unit_lists(table(spark, sf_dir, "claims"), "pmid", F.transform(F.split(F.lower("aus"), r"\|"), lambda x: F.trim(x)))


@query("with u as (select distinct pmid, trim(replace(lower(string_split(a, ',')[1]), '& ', '')) as unit from (select pmid, unnest(string_split(regexp_replace(affs, '\\[[^\\]]*\\]', '', 'g'), '|')) as a from publications where affs is not null and pmid is not null)), v as (select * from u where unit <> ''), p as (select distinct pmid from publications where pmid is not null) select p.pmid, coalesce(list_sort(list(unit) filter (where unit is not null)), []) as units from p left join v using (pmid) group by p.pmid")
def affiliation_mapping(spark, sf_dir):
    """Every paper with its affiliations, the empty list where it has none."""
    p = table(spark, sf_dir, "publications").where("pmid is not null")
    u = p.where("affs is not null").select("pmid", F.explode(T.affiliation_units("affs")).alias("unit")).groupBy("pmid").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    return R.complete_lists(p.select("pmid").distinct(), u, "pmid", "units")


_JP = """with j as (select distinct journal from claims where journal is not null), t as (select journal, list_filter(string_split(lower(journal), ' '), lambda w: w <> '' and w not in (""" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + """)) as ws from j),
p as (select a.journal as a, b.journal as b, case when len(a.ws) <= len(b.ws) then a.ws else b.ws end as s, case when len(a.ws) <= len(b.ws) then b.ws else a.ws end as l from t a join t b on a.journal < b.journal and string_split(a.journal, ' ')[1] = string_split(b.journal, ' ')[1]),
d as (select a, b, i, j, len(s) as n, len(l) as m, round(levenshtein(s[i], l[j]) / greatest(length(s[i]), length(l[j]), 1), 9) as d from p, range(1, 40) r(i), range(1, 40) q(j) where i <= len(s) and j <= len(l))"""


def _journal_words(spark, sf_dir):
    from claimweave.plans.graph_queries import _journal_pairs
    w = lambda c: T.tokens(F.lower(c))
    return _journal_pairs(spark, sf_dir).select("a", "b", w(F.col("a")).alias("wa"), w(F.col("b")).alias("wb"))


@query(_JP + f""", nr as (select a, b, i, any_value(n) as n, min(d) as d, arg_min(j, d * 1000 + j / 1000) as j from d group by a, b, i), pl as (select *, row_number() over (partition by a, b order by j, i) - 1 as k from nr),
ag as (select nr.a, nr.b, nr.i, arg_min(pl.k, x.d * 1000 + pl.k / 1000) as k from nr join pl on pl.a = nr.a and pl.b = nr.b join d x on x.a = nr.a and x.b = nr.b and x.i = nr.i and x.j = pl.j group by all),
z as (select a, b, n, sum(d * d) / n as v from nr group by a, b, n), o as (select a, b, sum((k - (i - 1)) * (k - (i - 1))) as mv from ag group by a, b)
select a, b, {r6("least(1, sqrt((v + case when n > 1 then mv / (case when n % 2 = 1 then floor(4 * (n // 2) * (n // 2 + 1) * (2 * (n // 2) + 1) / 3) else floor(2 * (n // 2) * (2 * (n // 2) + 1) * (2 * (n // 2) - 1) / 3) end) else 0 end) / 2))")} as distance from z join o using (a, b)""")
def phrase_metric(spark, sf_dir):
    """Distance of journal names by the nearest words and their order."""
    x = _journal_words(spark, sf_dir)
    return rounded(x.select("a", "b", T.phrase_metric(F.col("wa"), F.col("wb")).alias("distance")), "distance")


@query(_JP + f""", nr as (select a, b, j, any_value(n) as n, any_value(m) as m, min(d) as d, arg_min(i, d * 1000 + i / 1000) as i from d group by a, b, j),
w as (select a, b, any_value(n) as n, any_value(m) as m, sqrt(sum(d * d) / count(*)) as words, string_agg(chr(cast(97 + case when d < 0.1 then i - 1 else n + j - 1 end as integer)), '' order by j) as second from nr group by a, b),
y as (select *, array_to_string(list_transform(range(0, n), lambda i: chr(cast(97 + i as integer))), '') as first from w)
select a, b, {r6("sqrt((words * words + pow(levenshtein(first, second) / greatest(n, m), 2)) / 2)")} as distance from y""")
def word_phrase_distance(spark, sf_dir):
    """Distance of journal names with like words taken as one letter."""
    x = _journal_words(spark, sf_dir)
    return rounded(x.select("a", "b", T.word_phrase_distance(F.col("wa"), F.col("wb")).alias("distance")), "distance")


@query("select claim_id, list_sort(list_filter(list_distinct(regexp_extract_all(translate(lower(journal), '" + T.ACCENTED + "', '" + T.PLAIN + "'), '(\\w+)', 1)), lambda w: w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))) as words from claims where journal is not null")
def clean_tokens(spark, sf_dir):
    j = table(spark, sf_dir, "claims").where("journal is not null")
    return j.select("claim_id", F.array_sort(T.clean_tokens(F.col("journal"))).alias("words"))


@query(WITH + f", g as (select gene, count(*) as n from (select up as gene from c union all select dn from c) group by gene) select gene, n, {r6('(n - (select min(n) from g)) / ((select max(n) from g) - (select min(n) from g)) * 0.998 + 0.001')} as p from g")
def bounded_vector(spark, sf_dir):
    """Counts expanded to log odds of [eps, 1 - eps], and back."""
    c = claims(spark, sf_dir)
    g = c.select(F.col("up").alias("gene")).unionByName(c.select(F.col("dn").alias("gene"))).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    x = X.expand_bounded(g, "n", "z")
    return rounded(x.select("gene", "n", (1 / (1 + F.exp(-F.col("z")))).alias("p")), "p")


@query(_E + f", s as (select up, dn, avg(score) as m, count(*) as n from e group by up, dn) select up, dn, n from s where m > 0")
def positive_scores(spark, sf_dir):
    """Pairs whose mean score lies above the middle of the normal distribution."""
    s = experiments(spark, sf_dir).groupBy("up", "dn").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n"))
    return s.where(norm_cdf(F.col("m")) > 0.5).select("up", "dn", "n")


@query()
def least_phrase_distance(spark, sf_dir):
    """The least distance of any phrase of one journal's name to any of another's with the same first word."""
    from claimweave.plans.graph_queries import _journal_pairs
    p = _journal_pairs(spark, sf_dir)
    return rounded(p.select("a", "b", T.least_phrase_metric(T.phrases(F.col("a"), " of "), T.phrases(F.col("b"), " of ")).alias("distance")), "distance")
