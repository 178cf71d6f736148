"""Queries of the training-data problems over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.clean import authors, finite, organisations, polarity
from claimweave.llm import langid, linked_splits, mixing, names, target_sample, tokenize
from claimweave.session import cut, table


def _whole(c: str, low: int, high: int):
    x = finite(c)
    return F.when((x >= low) & (x <= high) & (x == F.floor(x)), x.cast("int"))


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return target_sample.sample_to_targets(
        table(spark, sf_dir, "claims"), table(spark, sf_dir, "sample_targets"),
        {"pos": polarity().cast("int"), "dist": _whole("dist", 0, 4)}, ["claim_id"])


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[0]


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[1]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_report(spark, sf_dir).where("cannot_be_met").select("set_id", "pos", "dist")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = linked_splits.related_roots(table(spark, sf_dir, "claims"), "up", "dn")
    return roots.select(F.col("node").alias("gene"), F.col("root").alias("root_gene"))


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    claims = table(spark, sf_dir, "claims").select("claim_id", "up", "dn")
    roots = linked_splits.related_roots(claims, "up", "dn")
    shares = {r["split_name"]: r["share"] for r in table(spark, sf_dir, "split_targets").orderBy(F.desc("share"), "split_name").collect()}
    return linked_splits.assign_splits(claims, roots, shares, "up", "dn", ["claim_id"]), shares


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir)[0].select("claim_id", "root", "split")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_splits.split_report(*_splits(spark, sf_dir))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "claims").select("aus", "affs")
    counts = cut(names.spelling_counts(claims, {"aus": authors("aus"), "affs": organisations("affs")}))
    return names.link_variants(counts.where("field = 'aus'"), counts.where("field = 'affs'"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_names(spark, sf_dir))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    return sized, mixing.mix_rates(sized, table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("falls_short").select("mix_id", "source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw_mix(*_mix(spark, sf_dir), ["doc_id"])


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(*_mix(spark, sf_dir), ["doc_id"])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.detect(docs, langid.fit(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = lambda start, lang: F.struct(start.cast("int").alias("seg_start"), lang.alias("lang"))
    label = F.when(F.col("label_wrong"), case(F.lit(-1), F.col("main_lang")))
    parts = F.when(F.size("segments") > 1, F.transform("segments", lambda s: case(s["seg_start"], s["lang"])))
    cases = F.concat(F.array_compact(F.array(label)), F.coalesce(parts, F.array().cast("array<struct<seg_start:int,lang:string>>")))
    return _languages(spark, sf_dir).select("doc_id", F.explode(cases).alias("c")).select("doc_id", "c.seg_start", "c.lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("doc_id", "main_lang", F.round("main_confidence", 4).alias("confidence"), "label_wrong", "segments")


QUERIES = {f.__name__: f for f in (p1_found, p1_sample, p1_report, p2_found, p2_splits, p2_report, p3_found, p3_entities, p6_ids, p7_found, p7_mix, p7_report, p8_found, p8_languages)}

SQL = {
    "p1_found": """
with e as (select cast(pos as int) as pos, cast(dist as int) as dist from claims where pos in (0, 1) and dist in (0, 1, 2, 3, 4)),
n as (select count(*) as n from e), c as (select pos, dist, count(*) as have from e group by pos, dist),
s as (select set_id, sum(share) as total from sample_targets group by set_id)
select t.set_id, t.pos, t.dist from sample_targets t join s using (set_id) cross join n left join c using (pos, dist)
where coalesce(have, 0) < greatest(t.min_rows, t.share / total * t.draw_frac * n.n)""",
    "p2_found": """
with recursive e as (
  select distinct case when up > 0 then up end as a, case when dn > 0 then dn end as b from claims),
l as (select a, b from e where a is not null and b is not null union select b, a from e where a is not null and b is not null),
g as (select a as gene from e where a is not null union select b from e where b is not null),
r as (select gene, gene as root from g union select l.b, r.root from r join l on l.a = r.gene where r.root < l.b)
select gene, min(root) as root_gene from r group by gene""",
}
