"""Sequential estimates per interaction. Inputs are batches (a row per interaction and year with k
of n positive), so a group has as many rows as years, however many claims it has."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.windows import group_quantiles

PAIR = ["up", "dn"]


def mcmc_step(batches: DataFrame, draws: int = 400, burn: float = 0.5, seed: int = 0) -> DataFrame:
    """Posterior of a step model (rate p0 before t0, p1 from t0 on, uniform priors) by Metropolis from
    the best grid point over all step years; mean and deviation of p0, p1 and the step year per
    interaction. Each chain is seeded by its interaction; chains of a batch step together, and the claims
    before a step are read from running totals by year, so a draw costs the same for any history."""
    rates = np.array([(a, b) for a in (0.2, 0.5, 0.8) for b in (0.2, 0.5, 0.8)])

    def loglik(x, k0, n0, k, n):
        return k0 * np.log(x[..., 0]) + (n0 - k0) * np.log1p(-x[..., 0]) + (k - k0) * np.log(x[..., 1]) + (n - n0 - (k - k0)) * np.log1p(-x[..., 1])

    def chains(rows) -> pd.DataFrame:
        m = len(rows)
        first, span = np.empty(m), np.empty(m)
        longest = max(max(y["year"] for y in h) - min(y["year"] for y in h) for _, _, h in rows) + 2
        K, N, x = np.zeros((m, longest + 1)), np.zeros((m, longest + 1)), np.empty((m, 3))
        for i, (_, _, h) in enumerate(rows):
            t = np.array([y["year"] for y in h])
            first[i], span[i] = t.min(), t.max() - t.min() + 1
            at = t - t.min()
            # K[i, j], N[i, j]: positive and all claims before the year first + j
            np.add.at(K[i], at + 1, [y["k"] for y in h])
            np.add.at(N[i], at + 1, [y["n"] for y in h])
            K[i], N[i] = K[i].cumsum(), N[i].cumsum()
            steps = np.unique(np.append(at, at.max() + 1))
            score = loglik(rates[:, None, :], K[i][steps], N[i][steps], K[i][-1], N[i][-1])
            r, s = np.unravel_index(score.argmax(), score.shape)
            x[i] = [*rates[r], steps[s]]
        each, total, trials = np.arange(m), K[:, -1], N[:, -1]

        def logp(x):
            inside = (x[:, 0] > 0) & (x[:, 0] < 1) & (x[:, 1] > 0) & (x[:, 1] < 1) & (x[:, 2] >= 0) & (x[:, 2] <= span)
            z = np.where(inside[:, None], x, 0.5)
            j = np.ceil(z[:, 2]).astype(int)
            return np.where(inside, loglik(z, K[each, j], N[each, j], total, trials), -np.inf)

        rngs = [np.random.default_rng([seed, int(up), int(dn)]) for up, dn, _ in rows]
        scale = np.stack([np.full(m, 0.1), np.full(m, 0.1), np.maximum(1.0, (span - 1) / 4)], 1)
        now, start, kept, one, two = logp(x), x.copy(), 0, np.zeros((m, 3)), np.zeros((m, 3))
        for block in range(0, draws, 500):
            size = min(500, draws - block)
            noise = np.stack([g.normal(size=(size, 3)) for g in rngs], 1)
            accept = np.log(np.stack([g.random(size) for g in rngs], 1))
            for i in range(size):
                y = x + noise[i] * scale
                v = logp(y)
                yes = v - now > accept[i]
                x, now = np.where(yes[:, None], y, x), np.where(yes, v, now)
                if block + i >= burn * draws:
                    kept, one, two = kept + 1, one + (x - start), two + (x - start) ** 2
        mean = one / kept
        sd = np.sqrt(np.maximum(two / kept - mean * mean, 0))
        mean += start
        return pd.DataFrame({"up": [r[0] for r in rows], "dn": [r[1] for r in rows], "p0": mean[:, 0], "p1": mean[:, 1], "t0": mean[:, 2] + first, "p0_sd": sd[:, 0], "p1_sd": sd[:, 1], "t0_sd": sd[:, 2]})

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i:i + 500]
                yield chains(list(zip(part["up"], part["dn"], part["h"])))

    tasks = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    h = batches.groupBy(*PAIR).agg(F.collect_list(F.struct("year", "k", "n")).alias("h")).repartition(tasks)
    return h.mapInPandas(run, "up long, dn long, p0 double, p1 double, t0 double, p0_sd double, p1_sd double, t0_sd double")


def hidden_state_likelihood(batches: DataFrame, guess: float = 0.8, prior: float = 0.5) -> DataFrame:
    """Log likelihood of each interaction's claims when each guesses a hidden state rightly with
    probability `guess`: log(prior * g^k (1-g)^(n-k) + (1-prior) * (1-g)^k g^(n-k)), and the posterior of the state."""
    s = batches.groupBy(*PAIR).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    k, m = F.col("k"), F.col("n") - F.col("k")
    a = F.log(F.lit(prior)) + k * F.log(F.lit(guess)) + m * F.log(F.lit(1 - guess))
    b = F.log(F.lit(1 - prior)) + k * F.log(F.lit(1 - guess)) + m * F.log(F.lit(guess))
    top = F.greatest(a, b)
    return s.withColumn("loglik", top + F.log(F.exp(a - top) + F.exp(b - top))).withColumn("p_state", F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), b - a)))))


def terminal_interval(batches: DataFrame, width: int, least: int = 2) -> DataFrame:
    """Frequency of positives in the last `width` years of each interaction; if that has fewer than
    `least` claims the interval reaches back batch by batch until it has."""
    w = Window.partitionBy(*PAIR)
    x = batches.withColumn("last", F.max("year").over(w))
    x = x.withColumn("newer", F.coalesce(F.sum("n").over(w.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = x.where((F.col("year") > F.col("last") - width) | (F.col("newer") < least))
    return kept.groupBy(*PAIR).agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.min("year").alias("since")).withColumn("freq", F.col("k") / F.col("n"))


def local_maxima(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Histogram bins of each group that are at least as high as both neighbours."""
    b = df.where((F.col(value) >= low) & (F.col(value) < high)).withColumn("bin", F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int"))
    h = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("bin")
    side = lambda f, d: F.when(f("bin").over(w) == F.col("bin") + d, f("n").over(w)).otherwise(0)
    return h.withColumn("left", side(F.lag, -1)).withColumn("right", side(F.lead, 1)).where((F.col("n") >= F.col("left")) & (F.col("n") >= F.col("right"))).select(*keys, "bin", "n")


def trimmed_range(df: DataFrame, keys: list[str], value: str, tail: float) -> DataFrame:
    """Exact range of each group without `tail / 2` of its values at either end."""
    return group_quantiles(df, keys, value, {"low": tail / 2, "high": 1 - tail / 2})


def lognormal_fit(counts: DataFrame, keys: list[str], time: str, value: str, steps: int = 60, offset: bool = False) -> DataFrame:
    """Least-squares fit of A * lognormal(t - t_first + 1; mu, sigma) (+ `base` with an offset) to the yearly
    counts of each key (a row a year), by damped Gauss-Newton; `err` is the mean squared error."""
    def curve(t, p):
        z = (np.log(t) - p[0]) / p[1]
        return p[2] * np.exp(-0.5 * z * z) / (t * p[1] * np.sqrt(2 * np.pi)) + (p[3] if offset else 0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        t = pdf[time].to_numpy(float) - pdf[time].min() + 1
        y, p, damp = pdf[value].to_numpy(float), np.array([np.log(t).mean(), 0.7, pdf[value].sum(), *([0.0] if offset else [])], float), 1e-2
        err = ((curve(t, p) - y) ** 2).mean()
        for _ in range(steps):
            j = np.stack([(curve(t, p + d) - curve(t, p - d)) / 2e-5 for d in np.eye(len(p)) * 1e-5], 1)
            a = j.T @ j
            q = p - np.linalg.solve(a + damp * (np.diag(np.diag(a)) + 1e-9 * np.eye(len(p))), j.T @ (curve(t, p) - y))
            q[1] = np.clip(q[1], 0.05, 5)
            e = ((curve(t, q) - y) ** 2).mean()
            p, err, damp = (q, e, damp / 3) if e < err else (p, err, damp * 4)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "mu": [p[0]], "sigma": [p[1]], "A": [p[2]], **({"base": [p[3]]} if offset else {}), "err": [err], "years": [len(t)]})

    kinds = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    return counts.groupBy(*keys).applyInPandas(run, f"{kinds}, mu double, sigma double, A double, {'base double, ' if offset else ''}err double, years long")



def shifted_mixture_loglik(df: DataFrame, keys: list[str], value: str, modes: list[tuple[float, float, float, float]]) -> DataFrame:
    """`loglik` of each group's values under a mixture of shifted log-normal laws (weight, mu, sigma, shift). A value
    at or left of a shift has a very low likelihood under that mode, not none."""
    parts = []
    for weight, mu, sigma, shift in modes:
        d = F.when(F.col(value) > shift, F.log(F.col(value) - F.lit(shift)))
        z = (d - F.lit(mu)) / F.lit(sigma)
        parts.append(F.lit(float(np.log(weight))) + F.coalesce(F.lit(-0.5 * np.log(2 * np.pi) - np.log(sigma)) - d - F.lit(0.5) * z * z, F.lit(-1e3)))
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(top + F.log(total)).alias("loglik"))


def step_logistic_loglik(df: DataFrame, keys: list[str], time: str, features: dict[str, tuple[float, float, float, float]], claim: str, penalty: float = 0.0) -> DataFrame:
    """`loglik` of each group's claims when a claim is a Bernoulli draw, logistic in features whose coefficients
    step over time (before, after, centre, steepness); less a penalty on the size of all coefficients."""
    from claimweave.functions.math import logistic_step

    arg = sum((logistic_step(F.col(time), c, s, low, high) * F.col(f) for f, (low, high, c, s) in features.items()), F.lit(0.0))
    # log p and log (1 - p) without overflow
    lp, lq = -F.log1p(F.exp(-F.abs(arg))) + F.least(arg, F.lit(0.0)), -F.log1p(F.exp(-F.abs(arg))) - F.greatest(arg, F.lit(0.0))
    size = penalty * sum(abs(low) + abs(high) for low, high, _, _ in features.values())
    return df.dropna(subset=[time, claim, *features]).groupBy(*keys).agg((F.sum(F.when(F.col(claim) == 1, lp).otherwise(lq)) - F.lit(size)).alias("loglik"))


def state_change_loglik(df: DataFrame, keys: list[str], time: str, change: float, p_right, claim: str, before: float, after: float) -> DataFrame:
    """`loglik` of each group's claims when the hidden state is positive with probability `before`, up to the time
    of change, and `after` from it on, and a claim tells it rightly with probability `p_right`."""
    x = df.withColumn("__cw_p", p_right).withColumn("__cw_late", (F.col(time) >= change).cast("int"))
    hit = F.when(F.col(claim) == 1, F.log("__cw_p")).otherwise(F.log1p(-F.col("__cw_p")))
    miss = F.when(F.col(claim) == 1, F.log1p(-F.col("__cw_p"))).otherwise(F.log("__cw_p"))
    per = x.groupBy(*keys, "__cw_late").agg(F.sum(hit).alias("a"), F.sum(miss).alias("b"))
    pi = F.when(F.col("__cw_late") == 1, F.lit(after)).otherwise(F.lit(before))
    a, b = F.col("a") + F.log(pi), F.col("b") + F.log(1 - pi)
    top = F.greatest(a, b)
    return per.withColumn("l", top + F.log(F.exp(a - top) + F.exp(b - top))).groupBy(*keys).agg(F.sum("l").alias("loglik"))


def chain_loglik(df: DataFrame, keys: list[str], guess, claim: str, state) -> DataFrame:
    """`loglik` of chains of claims: the product over a chain's claims of the chance of seeing each, which is that
    of guess and hidden state differing, summed over both; `guess` and `state` are the chances of either being 1."""
    x = df.withColumn("__cw_g", guess).withColumn("__cw_h", state)
    g, h = F.col("__cw_g"), F.col("__cw_h")
    differ = g * (1 - h) + (1 - g) * h
    return x.groupBy(*keys).agg(F.sum(F.log(F.when(F.col(claim) == 1, differ).otherwise(1 - differ))).alias("loglik"))


def neighbourhood_of_maximum(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, share: float = 0.5) -> DataFrame:
    """Per group: the fullest histogram bin (the first on ties) and how far the bins on either side that hold at
    least `share` of its height reach without a break: `first`, `last`, `peak`."""
    b = df.where((F.col(value) >= low) & (F.col(value) < high)).withColumn("bin", F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int"))
    h = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    top = h.groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col("n"), F.col("bin"))).alias("peak"), F.max("n").alias("most"))
    near = h.join(top, keys).where(F.col("n") >= F.lit(share) * F.col("most"))
    # Bins in a row have a constant difference of bin and place.
    w = Window.partitionBy(*keys).orderBy("bin")
    runs = near.withColumn("run", F.col("bin") - F.row_number().over(w))
    ends = runs.groupBy(*keys, "peak", "run").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    return ends.where((F.col("first") <= F.col("peak")) & (F.col("peak") <= F.col("last"))).select(*keys, "first", "last", "peak")
