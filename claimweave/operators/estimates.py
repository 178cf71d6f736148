"""From claim probabilities to interactions, reports of runs, and one-dimensional splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.math import replace_zeros

PAIR = ["up", "dn"]


def claim_validity(df: DataFrame, probabilities: str, pos: str = "pos", least: float = 1e-3) -> DataFrame:
    """From [p_wrong, p_right] of a claim: `correct` as given, and `pi_pos`, the chance that the
    interaction is positive: p_right for a positive claim, p_wrong for a negative one (zeros raised)."""
    p = replace_zeros(F.col(probabilities), least)
    return df.withColumn("correct", F.col(probabilities)[1]).withColumn("pi_pos", F.col(pos) * p[1] + (1 - F.col(pos)) * p[0])


def invert_bayes(df: DataFrame, probabilities: str, classes: int, pos: str = "pos") -> DataFrame:
    """`pe_j`: class probabilities as they are for negative claims and mirrored for positive ones."""
    p = F.col(probabilities)
    return df.withColumns({f"pe_{j}": (1 - F.col(pos)) * p[j] + F.col(pos) * p[classes - 1 - j] for j in range(classes)})


def vote_by_community(df: DataFrame, probabilities: list[str], community: str, keys: list[str] = PAIR) -> DataFrame:
    """Mean log probability per community, summed over communities; `vote` is the winning class."""
    per = df.groupBy(*keys, community).agg(*[F.avg(F.log(p)).alias(p) for p in probabilities])
    x = per.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in probabilities])
    arr = F.array(*[F.round(p, 9) for p in probabilities])
    return x.select(*keys, (F.array_position(arr, F.array_max(arr)) - 1).cast("int").alias("vote"))


def interaction_estimates(df: DataFrame, value: str = "pos", pi: str = "pi_pos") -> DataFrame:
    """Four estimates of an interaction: mean claim, mean probability, probability weighted by its
    distance from the mean claim, and weighted by its distance from one half."""
    m = df.agg(F.avg(value)).first()[0]
    w1, w2 = F.abs(F.col(pi) - F.lit(m)), F.sqrt(F.abs(F.col(pi) - 0.5))
    weighted = lambda w: F.coalesce(F.try_divide(F.sum(w * F.col(pi)), F.sum(w)), F.avg(pi))
    return df.groupBy(*PAIR).agg(F.avg(value).alias("mean_pos"), F.avg(pi).alias("mean_pi"), weighted(w1).alias("weighted_pi"), weighted(w2).alias("rank_pi"), F.count(F.lit(1)).alias("n"))


def reduce_report(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over runs, long."""
    long = runs.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("runs"))


def wide_report(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("metric", metrics).agg(F.first("mean"))


def heatmap(df: DataFrame, row: str, column: str, columns: list[str], value: Column) -> DataFrame:
    """Matrix with the columns in a fixed order."""
    return df.groupBy(row).pivot(column, columns).agg(value).select(row, *columns)


def moved_right(columns: list[str], last: list[str]) -> list[str]:
    return [c for c in columns if c not in last] + [c for c in columns if c in last]


def valley_split(df: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """Two parts of each group's values, cut at the lowest histogram bin between the two highest
    peaks, and z-scores within the part. The cut needs the histogram only, `bins` rows a group."""
    span = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = df.join(span, keys)
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    x = x.withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")).withColumn("width", width)
    hist = x.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(bins)
        h[pdf["bin"]] = pdf["n"]
        best = None
        for i in range(bins):
            for j in range(i + 2, bins):
                v = i + 1 + int(h[i + 1 : j].argmin())
                depth = min(h[i], h[j]) - h[v]
                if depth > 0 and (best is None or depth > best[0]):
                    best = (depth, v)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "valley": [best[1] if best else bins]})

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    cuts = hist.groupBy(*keys).applyInPandas(cut, f"{kinds}, valley int")
    y = x.join(cuts, keys).withColumn("part", (F.col("bin") >= F.col("valley")).cast("int"))
    stats = y.groupBy(*keys, "part").agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return y.join(stats, [*keys, "part"]).withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.col("__m"), "__s"), F.lit(0.0))).select(*df.columns, "part", "z")


def feature_families(columns: list[str], families: dict[str, list[str]], exclude: str = "dyn") -> dict[str, list[str]]:
    """Columns that hold all substrings of a family and not the exclusion, by family; families
    without columns are left out."""
    found = {f: [c for c in columns if all(p in c for p in parts) and exclude not in c] for f, parts in families.items()}
    return {f: cs for f, cs in found.items() if cs}
