"""Derived features: quantisation, distances, scaling, imputation by group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.relational import with_group_stats


def quantize(c: Column, edges: list[float]) -> Column:
    """Index i with edges[i] < c <= edges[i+1]; a value outside all bins is left as it is."""
    out = c
    for i in reversed(range(len(edges) - 1)):
        out = F.when((c > edges[i]) & (c <= edges[i + 1]), F.lit(float(i))).otherwise(out)
    return out


def level_distance(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """abs(m_b * b - m_a * a) with the two scales stretched to their least common multiple; null
    where a column has a single value."""
    n = df.agg(F.countDistinct(a).alias("a"), F.countDistinct(b).alias("b")).first()
    na, nb = n["a"] - 1, n["b"] - 1
    if na < 1 or nb < 1:
        return df.withColumn(out, F.lit(None).cast("double"))
    lcm = math.lcm(na, nb)
    return df.withColumn(out, F.abs(F.lit(lcm / nb) * F.col(b) - F.lit(lcm / na) * F.col(a)))


def min_max(df: DataFrame, columns: list[str], scaler: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Columns scaled to [0, 1] (constant ones to 0), with the given bounds if any."""
    if scaler is None:
        row = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
        scaler = {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in columns}
    exprs = {}
    for c in columns:
        lo, hi = scaler[c]
        known = lo is not None and hi > lo
        exprs[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if known else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return df.withColumns(exprs)


def group_zscore(df: DataFrame, keys: list[str], c: str, out: str) -> DataFrame:
    """(value - group mean) / population deviation; only centred where the group does not vary."""
    x = with_group_stats(df, keys, __cw_m=F.avg(c), __cw_d=F.stddev_pop(c))
    z = F.col(c) - F.col("__cw_m")
    return x.withColumn(out, F.when(F.col("__cw_d") < 1e-9, z).otherwise(z / F.col("__cw_d"))).drop("__cw_m", "__cw_d")


def impute_group_mean(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """Nulls take the mean of their group; rows of groups without a value are left out."""
    x = with_group_stats(df, keys, __cw_m=F.avg(c))
    return x.withColumn(c, F.coalesce(c, "__cw_m")).drop("__cw_m").where(F.col(c).isNotNull())


def masked_logs(df: DataFrame, c: str, mask: Column, absent: float = -1.0) -> DataFrame:
    """`log_<c>` and squared deviation from the masked mean where the mask holds, else `absent`."""
    m = df.where(mask).agg(F.avg(c)).first()[0] or 0.0
    return df.withColumn(f"log_{c}", F.when(mask, F.log1p(c)).otherwise(absent)).withColumn("dev2", F.when(mask, (F.col(c) - m) * (F.col(c) - m)).otherwise(absent))


def error_flags(df: DataFrame, pos: str = "pos", truth: str = "cdf_exp", quantised: str = "qcdf_exp") -> DataFrame:
    """The three measures of a wrong claim, under three names: `bdist_levels` (0 where 2 * pos is the
    quantised truth), `bdist_half` (1 where pos is within 0.5 of the truth) and `rdist` (difference)."""
    return df.withColumn("bdist_levels", (F.col(quantised) != 2 * F.col(pos)).cast("int")).withColumn("rdist", F.col(truth) - F.col(pos)) \
        .withColumn("bdist_half", (F.abs(F.col(truth) - F.col(pos)) < 0.5).cast("int"))


def agreement(a: Column, b: Column) -> Column:
    """1 where both are known and equal, else 0."""
    return F.coalesce((a == b).cast("int"), F.lit(0))


def guess_quality(truth: Column, prior: Column, guess: Column) -> tuple[Column, Column]:
    """(whether the prior differs from the truth, whether the guess does): exclusive or of flags; null if one is."""
    return truth != prior, truth != guess


def positive_transition(rdist: Column, flag: Column) -> Column:
    """Whether a claim is near the truth and its batch has the flag; null distances are not near."""
    return F.coalesce((F.abs(rdist) < 0.5) & flag, F.lit(False))


def expand_bounded(df: DataFrame, c: str, out: str, eps: float = 1e-3) -> DataFrame:
    """The column scaled to [eps, 1 - eps] and taken to log odds; a constant column goes to 0."""
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None or lo == hi:
        return df.withColumn(out, F.when(F.col(c).isNotNull(), F.lit(0.0)))
    p = F.lit(eps) + (F.col(c) - F.lit(lo)) / F.lit(hi - lo) * F.lit(1 - 2 * eps)
    return df.withColumn(out, F.log(p / (F.lit(1.0) - p)))


def last_stage(df: DataFrame, features: list[str], origin: str, longer_than: int, excluded: tuple[tuple[int, int], ...] = (), normalise: bool = True) -> DataFrame:
    """The rows a model is trained on: complete in the features, without the excluded pairs (kept under
    origin `gw`), of interactions with more rows than `longer_than`, the features scaled to [0, 1]."""
    from claimweave.operators.relational import complete_rows, long_histories

    x = complete_rows(df, features)
    if origin != "gw":
        for up, dn in excluded:
            x = x.where((F.col("up") != up) | (F.col("dn") != dn))
    x = long_histories(x, longer_than)
    return min_max(x, [f for f in features if f in df.columns]) if normalise else x
