"""Aggregations of claims to interactions and batches, and studies over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.math import beta_binomial_log, clip
from claimweave.operators.windows import exact_quantiles

PAIR = ["up", "dn"]


def interaction_stats(df: DataFrame, at_least: int = 0) -> DataFrame:
    """Per interaction: k positives, n claims, q the experimental truth, first and last year."""
    return df.groupBy(*PAIR).agg(F.sum("pos").alias("k"), F.count(F.lit(1)).alias("n"), F.min("cdf_exp").alias("q"),
                                 F.min("year").alias("year_min"), F.max("year").alias("year_max")).where(F.col("n") >= at_least)


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def strongest(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean per inner group, then per outer group the signed mean of largest magnitude."""
    m = df.groupBy(*inner).agg(F.avg(value).alias("m"))
    return m.groupBy(*outer).agg(F.max_by("m", F.struct(F.round(F.abs("m"), 9), F.col("m"))).alias("strongest"))


def beta_binomial_positive(stats: DataFrame, alpha_p: float, beta_p: float, alpha_n: float, beta_n: float, prior: float = 0.5) -> DataFrame:
    """Probability that an interaction is positive: beta-binomial odds of its k of n under the two classes."""
    a = lambda v: F.lit(v)
    odds = beta_binomial_log(F.col("k"), F.col("n"), a(alpha_p), a(beta_p)) - beta_binomial_log(F.col("k"), F.col("n"), a(alpha_n), a(beta_n))
    return stats.withColumn("p_positive", F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(odds, -500.0, 500.0)) * F.lit((1 - prior) / prior)))


def weighted_interaction(df: DataFrame, value: str, weight: Column) -> DataFrame:
    """Weighted mean of a value per interaction; the plain mean where all weights are 0."""
    x = df.withColumn("__cw_w", weight)
    return x.groupBy(*PAIR).agg(F.sum(F.col("__cw_w") * F.col(value)).alias("s"), F.sum("__cw_w").alias("w"), F.avg(value).alias("plain")) \
        .select(*PAIR, F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("plain")).alias("estimate"))


def log_vote(df: DataFrame, keys: list[str], probabilities: list[str], barrier: float) -> DataFrame:
    """Sums of log probabilities per group, centred on the middle one, clipped, and as shares; `vote` the winner."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.log(p)).alias(f"l{i}") for i, p in enumerate(probabilities)])
    arr = F.array(*[F.col(f"l{i}") for i in range(len(probabilities))])
    middle = F.sort_array(arr)[len(probabilities) // 2]
    e = F.transform(arr, lambda x: F.exp(clip(x - middle, -barrier, barrier)))
    # Rounded, so that classes whose sums differ by the order of addition only are ties, which the first wins.
    near = F.transform(arr, lambda v: F.round(v, 9))
    x = sums.withColumn("__cw_e", e).withColumn("vote", (F.array_position(near, F.array_max(near)) - 1).cast("int"))
    total = F.aggregate("__cw_e", F.lit(0.0), lambda a, v: a + v)
    return x.select(*keys, *[(F.col("__cw_e")[i] / total).alias(f"p{i}") for i in range(len(probabilities))], "vote")


def mean_of_means(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Means of means: the first level averages the value, each further one the means below it."""
    out = df.withColumnRenamed(value, "m").select(*levels[0], "m")
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg("m").alias("m"))
    return out


def threshold_study(df: DataFrame, score: str, value: str, thresholds: list[float]) -> DataFrame:
    """Sum and count of the value in each tail per threshold, in one pass: partial sums per slot
    between thresholds first, then the few slots are accumulated."""
    t = F.array(*[F.lit(x) for x in thresholds])
    x = df.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    slots = x.groupBy(F.size(F.filter(t, lambda v: v <= F.col(score))).alias("slot")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    grid = df.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(thresholds)], "i int, thr double")
    high, low = F.col("slot") >= F.col("i"), F.col("slot") < F.col("i")
    # At most thresholds + 1 slots, times the thresholds.
    return slots.crossJoin(F.broadcast(grid)).groupBy("thr").agg(
        F.coalesce(F.sum(F.when(high, F.col("s"))), F.lit(0)).cast("long").alias("sum_high"), F.coalesce(F.sum(F.when(high, F.col("c"))), F.lit(0)).alias("n_high"),
        F.coalesce(F.sum(F.when(low, F.col("s"))), F.lit(0)).cast("long").alias("sum_low"), F.coalesce(F.sum(F.when(low, F.col("c"))), F.lit(0)).alias("n_low"))


def threshold_surface(df: DataFrame, score: str, value: str, lows: list[float], highs: list[float]) -> DataFrame:
    """Sum and count of the value in the low tail, the middle and the high tail over a grid of two
    thresholds: rows are summed once per grid slot, the few slots carry the grid."""
    a, b = F.array(*[F.lit(x) for x in lows]), F.array(*[F.lit(x) for x in highs])
    x = df.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    slots = x.groupBy(F.size(F.filter(a, lambda v: v <= F.col(score))).alias("sa"), F.size(F.filter(b, lambda v: v <= F.col(score))).alias("sb")) \
        .agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    grid = df.sparkSession.createDataFrame([(i + 1, j + 1, p, q) for i, p in enumerate(lows) for j, q in enumerate(highs)], "i int, j int, low double, high double")
    is_low, is_high = F.col("sa") < F.col("i"), F.col("sb") >= F.col("j")
    def part(cond: Column, name: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(cond, F.col("s"))), F.lit(0)).cast("long").alias("sum_" + name), F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).alias("n_" + name)]
    # At most (lows + 1) * (highs + 1) slots, times the grid of lows * highs.
    return slots.crossJoin(F.broadcast(grid)).groupBy("low", "high").agg(*part(is_low, "low"), *part(~is_low & ~is_high, "middle"), *part(is_high, "high"))


def correlations(df: DataFrame, target: str, columns: list[str], keys: list[str] = (), at_least: int = 2) -> DataFrame:
    """Pearson correlation of each column with the target, long: one aggregate for all columns."""
    aggs = [F.corr(c, target).alias(c) for c in columns]
    wide = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count(F.lit(1)).alias("n"), *aggs).where(F.col("n") >= at_least)
    return wide.unpivot([*keys, "n"], columns, "column", "corr")


def family_extremes(corr: DataFrame, family: str, name: str = "column", value: str = "corr") -> DataFrame:
    """Per family the member of largest positive and of smallest negative correlation, and the size;
    `conflict` where it has both signs."""
    pos, neg = F.col(value) > 0, F.col(value) < 0
    return corr.groupBy(family).agg(
        F.max_by(F.when(pos, F.col(name)), F.struct(F.when(pos, F.col(value)), F.col(name))).alias("best_positive"),
        F.min_by(F.when(neg, F.col(name)), F.struct(F.coalesce(F.when(neg, F.col(value)), F.lit(9.0)), F.col(name))).alias("best_negative"), F.count(F.lit(1)).alias("members"),
        (F.coalesce(F.max(pos), F.lit(False)) & F.coalesce(F.max(neg), F.lit(False))).alias("conflict"))


def pooled_std(df: DataFrame, keys: list[str], n: str, mean: str, std: str) -> DataFrame:
    m = F.sum(F.col(n) * F.col(mean)) / F.sum(n)
    e2 = F.sum(F.col(n) * (F.col(mean) * F.col(mean) + F.col(std) * F.col(std))) / F.sum(n)
    return df.groupBy(*keys).agg(m.alias("mean"), F.sqrt(F.greatest(e2 - m * m, F.lit(0.0))).alias("std"), F.sum(n).alias("n"))


def percentile_flags(df: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """Number of global percentiles of the column that the row's value exceeds."""
    cuts = exact_quantiles(df, column, percents)
    out = F.lit(0)
    for v in cuts:
        out = out + (F.col(column) > F.lit(v)).cast("int")
    return df.withColumn("level", F.when(F.col(column).isNotNull(), out))


def level_sweep(df: DataFrame, score: str, value: str, percents: list[float]) -> DataFrame:
    """For each level both tails of the score: rows, correlation of score and value, mean distance."""
    x = df.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    cuts = exact_quantiles(x, score, [*percents, *[1 - p for p in percents]])
    tails = list(zip(percents, cuts[: len(percents)], cuts[len(percents) :]))
    levels = F.array(*[F.when((F.col(score) <= F.lit(a)) | (F.col(score) >= F.lit(b)), F.lit(p)) for p, a, b in tails], F.lit(None).cast("double"))
    return x.withColumn("level", F.explode(F.array_compact(levels))).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.corr(score, value).alias("corr"), F.avg(F.abs(F.col(score) - F.col(value))).alias("distance"))


def split_beta_parameters(train: DataFrame, flag: str, value: str = "pos") -> dict[str, float]:
    """`alpha_p, beta_p, alpha_n, beta_n`: positive and negative claims of the interactions with and without
    the flag, each over their number of interactions, at least one half: parameters for `beta_binomial_positive`."""
    per = train.where(F.col(flag).isNotNull()).groupBy(*PAIR).agg(F.max(flag).alias("f"), F.sum(value).alias("k"), F.count(value).alias("n"))
    out = {"alpha_p": 0.5, "beta_p": 0.5, "alpha_n": 0.5, "beta_n": 0.5}
    for r in per.groupBy("f").agg(F.avg("k").alias("a"), F.avg(F.col("n") - F.col("k")).alias("b")).collect():
        side = "p" if r["f"] else "n"
        out |= {f"alpha_{side}": max(float(r["a"]), 0.5), f"beta_{side}": max(float(r["b"]), 0.5)}
    return out


def filled_sizes(batches: DataFrame, revealed: str) -> DataFrame:
    """Per interaction: claims revealed so far, claims there are, and batches of either kind."""
    on = F.col(revealed)
    return batches.groupBy(*PAIR).agg(F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias("filled"), F.sum("n").alias("potential"),
                                      F.count(F.when(on, 1)).alias("batches_filled"), F.count(F.lit(1)).alias("batches"))


def binned_estimates(df: DataFrame, bin_: str, truth: str, estimates: list[str], more_than: int = 4, confidence: float = 0.95) -> DataFrame:
    """Per bin of a level: rows, mean and deviation of the truth and of each estimate, the correlation of
    truth and estimate and its interval. Bins of few rows, or in which a column does not vary, are left out."""
    from claimweave.functions.math import correlation_interval

    x = df.dropna(subset=[bin_, truth, *estimates])
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in [truth, *estimates]:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    aggs += [F.corr(truth, c).alias(f"corr_{c}") for c in estimates]
    out = x.groupBy(bin_).agg(*aggs).where(F.col("n") > more_than)
    for c in [truth, *estimates]:
        out = out.where(F.round(f"std_{c}", 12) > 0)
    for c in estimates:
        low, high = correlation_interval(F.col(f"corr_{c}"), F.col("n"), confidence)
        out = out.withColumns({f"low_{c}": low, f"high_{c}": high})
    return out


def cross_section(scores: DataFrame, keys: list[str], value: str, before: Column, after: Column, reports: DataFrame | None = None, on: list[str] = PAIR) -> DataFrame:
    """Mean, deviation and number of the value per key over the rows that hold `before`; of the groups those
    that hold `after` (over `mean`, `std`, `n`); joined to reports if there are any."""
    out = mean_std(scores.where(before), keys, value).where(after)
    return out.join(reports, on) if reports is not None else out


def pairwise_correlations(df: DataFrame, target: str, columns: list[str], least: float = 0.0) -> DataFrame:
    """Correlation of each column with the target over the rows that have both, one pass for all columns,
    with the number of those rows; those below the threshold in size are left out."""
    aggs = [e for c in columns for e in (F.corr(c, target).alias(c), F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1)).alias("n_" + c))]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n_" + c).alias("n"), F.col(c).alias("corr")) for c in columns])
    return wide.select(F.explode(rows).alias("x")).select("x.*").where(F.abs("corr") >= least)


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every pair of columns once, `a`, `b`, `corr`: one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def covariates(table: DataFrame, key: str) -> DataFrame:
    """The rows of a correlation table that have the key on either side: the other column and the correlation, in its order."""
    x = table.where((F.col("a") == key) | (F.col("b") == key))
    return x.select(F.when(F.col("a") == key, F.col("b")).otherwise(F.col("a")).alias("covariate"), "corr").orderBy("corr", "covariate")


def one_tail_sweep(df: DataFrame, keys: list[str], score: str, value: str, levels: list[float], lower: bool = True, more_than: int = 2) -> DataFrame:
    """For each level the rows in one tail of the score, cut at the percentile of the groups' scores (the
    least of each group): rows, correlation of score and value. Tails of few rows are left out."""
    x = df.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    cuts = exact_quantiles(x.groupBy(*keys).agg(F.min(score).alias("s")), "s", [p if lower else 1 - p for p in levels])
    inside = [F.when((F.col(score) <= F.lit(c)) if lower else (F.col(score) >= F.lit(c)), F.lit(p)) for p, c in zip(levels, cuts)]
    out = x.withColumn("level", F.explode(F.array_compact(F.array(*inside, F.lit(None).cast("double")))))
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.corr(score, value).alias("corr")).where(F.col("n") > more_than)


def threshold_flags(df: DataFrame, column: str, percents: list[float], pos: str | None = None) -> DataFrame:
    """A 0/1 column `<column>_<i>` per global percentile, 1 above it, and with `pos` one more, `<column>_mean`,
    at the percentile that leaves as many rows above as are positive."""
    share = df.agg(F.avg(pos)).first()[0] if pos else None
    every = [*percents, *([1 - share] if share is not None else [])]
    cuts = exact_quantiles(df, column, every) or [None] * len(every)
    names = [f"{column}_{i}" for i in range(len(percents))] + ([f"{column}_mean"] if share is not None else [])
    return df.withColumns({n: (F.col(column) > F.lit(c)).cast("int") for n, c in zip(names, cuts)})


def inverse_logit_means(df: DataFrame, score: str, pos: str = "pos", keys: list[str] = PAIR) -> DataFrame:
    """Per interaction the mean of its claims' probabilities of being positive: the inverse logit of the
    score, turned round for positive claims."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(score)))
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(pos) == 1, 1 - p).otherwise(p)).alias("pi"))


def fit_quality(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """`mse` and `r2` of an estimate."""
    d = F.col(truth) - F.col(estimate)
    x = df.dropna(subset=[truth, estimate])
    return x.agg(F.avg(d * d).alias("mse"), F.var_pop(truth).alias("v")).select("mse", (1 - F.col("mse") / F.when(F.col("v") > 0, F.col("v"))).alias("r2"))
