"""Mixing sources to target weights.

Tokens are summed per source once. A source's repetition rate in a mix is its target size over its
tokens, capped at the allowed repeats. Each document is then emitted floor(rate) times plus one more
copy if a hash of its id, the mix and the seed falls below the fraction: a Bernoulli draw that any
executor repeats alike. There is no shuffle but the sum per source, which is combined on the map
side, so a source with a third of the rows costs nothing extra; the rates, one row a source, are
joined so that those of the large sources reach its rows by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.tokenize import count_tokens
from claimweave.operators.skew import skew_join
from claimweave.session import cut


def source_name(c: str = "source") -> Column:
    """Source names compared trimmed and lower case; null is no source."""
    return F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))


def sized_documents(docs: DataFrame, ids: list[str], text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """The ids, `source` and `n_tokens` of the documents that have a source. Null and empty texts have 0 tokens."""
    x = docs.select(*ids, source_name(source).alias("source"), F.col(text).alias("__cw_t")).where("source is not null")
    return cut(count_tokens(x, "__cw_t", path).select(*ids, "source", "n_tokens"))


def mix_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per mix and source: `target_tokens`, `source_tokens` (0 for an absent source), `rate`
    (repetitions, capped) and `falls_short`.

    `targets`: `mix_id`, `source`, `weight`, `max_repeats`, `mix_frac`; weights are relative to the
    sum of their mix. A source listed twice in a mix has its weights added and its larger repeats.
    Null weights count 0; a mix whose weights sum to 0 wants nothing. No documents: all rates 0.
    """
    per = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    t = targets.withColumn("source", source_name()).groupBy("mix_id", "source").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("mix_frac").alias("mix_frac"))
    sums = t.groupBy("mix_id").agg(F.sum("weight").alias("__cw_sum"))
    t = t.join(sums, "mix_id").join(per, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    want = F.coalesce(F.when(F.col("__cw_sum") > 0, F.col("weight") / F.col("__cw_sum") * F.col("mix_frac") * F.lit(total)), F.lit(0.0))
    t = t.withColumn("target_tokens", want)
    rate = F.when(F.col("source_tokens") > 0, F.col("target_tokens") / F.col("source_tokens")).otherwise(F.lit(0.0))
    return cut(t.select(
        "mix_id", "source", "weight", F.try_divide("weight", "__cw_sum").alias("target_share"), "max_repeats", "target_tokens", "source_tokens",
        F.greatest(F.lit(0.0), F.least(rate, F.col("max_repeats").cast("double"))).alias("rate"),
        (F.col("max_repeats") * F.col("source_tokens") < F.col("target_tokens")).alias("falls_short")))


def copies(sized: DataFrame, rates: DataFrame, ids: list[str], seed: int = 11) -> DataFrame:
    """`sized` per mix with `n_copies` (0 included): floor(rate) and one hash-seeded Bernoulli draw."""
    per = rates.groupBy("source").agg(F.collect_list(F.struct("mix_id", "rate")).alias("__cw_r"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", *ids), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    every = skew_join(sized, per, "source", "inner").withColumn("__cw_r", F.explode("__cw_r")).select(*sized.columns, "__cw_r.*")
    return every.withColumn("n_copies", (whole + (u < F.col("rate") - whole).cast("long")).cast("int")).drop("rate")


def draw_mix(sized: DataFrame, rates: DataFrame, ids: list[str], seed: int = 11) -> DataFrame:
    """One row per emitted copy: the ids, `mix_id`, `source`, `n_tokens` and `copy_no` from 1."""
    c = copies(sized, rates, ids, seed).where("n_copies > 0")
    return c.select(*ids, "mix_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))


def mix_report(sized: DataFrame, rates: DataFrame, ids: list[str], seed: int = 11) -> DataFrame:
    """`mix_rates` with `drawn_tokens` and `drawn_share`, the share reached in the mix (null for an empty mix)."""
    got = copies(sized, rates, ids, seed).groupBy("mix_id", "source").agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("drawn_tokens"))
    full = rates.join(got, ["mix_id", "source"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    sums = full.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("__cw_sum"))
    return full.join(sums, "mix_id").withColumn("drawn_share", F.when(F.col("__cw_sum") > 0, F.col("drawn_tokens") / F.col("__cw_sum"))).drop("__cw_sum")
