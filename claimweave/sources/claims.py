"""Adapters from the raw tables to the logical tables the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.clean import finite, gene, known_year, measured, polarity
from claimweave.operators.relational import first_by
from claimweave.session import table


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved readings: both genes and the year known, `pos` 0 or 1; unmeasured numbers are null."""
    c = table(spark, sf_dir, "claims")
    return c.select(
        "claim_id", gene("up").alias("up"), gene("dn").alias("dn"), "pmid", known_year().alias("year"), polarity().cast("int").alias("pos"),
        measured("ai", 0, 40).alias("ai"), measured("ar", 0, 10).alias("ar"), measured("cdf_exp", 0, 1).alias("cdf_exp"), finite("qcdf_exp").alias("qcdf_exp"),
        "origin", "journal", "aus", "affs").dropna(subset=["up", "dn", "year", "pos"])


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim (up, dn, pmid): the first reading by year and id."""
    return first_by(readings(spark, sf_dir), ["up", "dn", "pmid"], ["year", "claim_id"])


READINGS_SQL = """readings as (
  select claim_id, up, dn, pmid, year, cast(pos as integer) as pos,
    case when not isnan(ai) and ai between 0 and 40 then ai end as ai, case when not isnan(ar) and ar between 0 and 10 then ar end as ar,
    case when not isnan(cdf_exp) and cdf_exp between 0 and 1 then cdf_exp end as cdf_exp,
    case when isfinite(qcdf_exp) then qcdf_exp end as qcdf_exp, origin, journal, aus, affs
  from claims where up > 0 and dn > 0 and year > 0 and pos in (0, 1))"""
CLAIMS_SQL = READINGS_SQL + """,
c as (select * from readings qualify row_number() over (partition by up, dn, pmid order by year, claim_id) = 1)"""
WITH = "with " + CLAIMS_SQL


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments with a finite score and resolved genes; the time in hours (`1 d` = 24 h, minutes / 60)."""
    e = table(spark, sf_dir, "experiments").withColumn("score", finite("score")).where("score is not null and up > 0 and dn > 0")
    amount = F.regexp_extract("pert_itime", r"([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.lower(F.regexp_extract("pert_itime", r"[0-9]\s*([A-Za-z]+)", 1))
    hours = F.when(amount != "", amount.cast("double") * F.when(unit.startswith("d"), 24.0).when(unit.startswith("m"), 1 / 60).otherwise(1.0))
    return e.withColumn("hours", hours)


def paper_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pmid`, `unit`: distinct lower-case authors of each paper, from the claims."""
    c = table(spark, sf_dir, "claims").select("pmid", F.explode(F.split(F.lower("aus"), r"\|")).alias("unit"))
    return c.select("pmid", F.trim("unit").alias("unit")).where("unit <> ''").distinct()


UNITS_SQL = """units as (select distinct pmid, trim(u) as unit from (select pmid, unnest(string_split(lower(aus), '|')) as u from claims) where trim(u) <> '')"""
