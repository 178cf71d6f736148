"""Queries of the general record problems: missing values (p4) and hot keys (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.clean import finite, gene, known_year, measured, organisations, polarity
from claimweave.operators.impute import Fill, fill_from_similar, most_frequent
from claimweave.operators.skew import balanced_levels
from claimweave.session import table

AI_MAX, AR_MAX = 40.0, 10.0
LEVELS = {"up": ["up"], "dn": ["dn"], "up_dn": ["up", "dn"], "up_dn_year": ["up", "dn", "year"]}


def fill_claims(claims: DataFrame) -> DataFrame:
    """Claims with `ai` and `ar` filled. No measurement: null, not finite, below zero, above the
    maximum, and in `ai` the most frequent number of the column (imputed upstream)."""
    mode = most_frequent(claims, finite("ai"))
    ai = measured("ai", 0, AI_MAX)
    if mode is not None:
        ai = F.when(ai != mode, ai)
    ar = measured("ar", 0, AR_MAX)
    year = known_year()
    org = F.lower(F.get(organisations(), F.lit(0)))
    keys = ("paper", "journal", "organisation", "year")
    return fill_from_similar(
        claims, [Fill("ai", ai, keys), Fill("ar", ar, keys)],
        keys={"paper": F.col("pmid"), "journal": F.col("journal"), "organisation": org, "year": year},
        numeric={"ai": F.log1p(ai), "ar": ar, "year": year},
        categorical={"journal": F.col("journal"), "organisation": org, "origin": F.col("origin")},
    )


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_claims(table(spark, sf_dir, "claims")).select(
        "claim_id", "ai_filled", "ai_was_missing", "ai_method", "ar_filled", "ar_was_missing", "ar_method")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(*[F.when(F.col(f"{f}_was_missing"), F.lit(f)) for f in ("ai", "ar")])
    return p4_filled(spark, sf_dir).select("claim_id", F.explode(F.array_compact(fields)).alias("field"))


def hot_keys(claims: DataFrame) -> DataFrame:
    x = claims.select(gene("up").alias("up"), gene("dn").alias("dn"), known_year().alias("year"), polarity().alias("pos"))
    return balanced_levels(x, LEVELS, F.col("pos"))


def p5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "claims")).select(
        "key_level", "key_text", "n_rows", "n_values", F.round(F.col("mean_value") + 1e-9, 6).alias("mean_pos"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "claims")).where("row_share >= 0.02").select("key_level", "key_text")


QUERIES = {f.__name__: f for f in (p4_filled, p4_found, p5_keys, p5_found)}

_KEYS = """
with c as (
  select case when up > 0 then up end as up, case when dn > 0 then dn end as dn,
         case when year > 0 then year end as year, case when pos in (0, 1) then pos end as pos from claims),
k as (
  select 'up' as key_level, cast(up as varchar) as key_text, pos from c
  union all select 'dn', cast(dn as varchar), pos from c
  union all select 'up_dn', cast(up as varchar) || '|' || cast(dn as varchar), pos from c
  union all select 'up_dn_year', cast(up as varchar) || '|' || cast(dn as varchar) || '|' || cast(year as varchar), pos from c)
"""
_AI = "(ai is null or isnan(ai) or isinf(ai) or ai < 0 or ai > 40 or ai = (select ai from claims where ai is not null and not isnan(ai) and not isinf(ai) group by ai order by count(*) desc, ai limit 1))"
_AR = "(ar is null or isnan(ar) or isinf(ar) or ar < 0 or ar > 10)"
SQL = {
    "p4_found": f"select claim_id, 'ai' as field from claims where {_AI} union all select claim_id, 'ar' from claims where {_AR}",
    "p5_keys": _KEYS + "select key_level, key_text, count(*) as n_rows, count(pos) as n_values, round(avg(pos) + 1e-9, 6) as mean_pos from k where key_text is not null group by all",
    "p5_found": _KEYS + "select key_level, key_text from k where key_text is not null group by all having count(*) >= 0.02 * (select count(*) from claims)",
}
