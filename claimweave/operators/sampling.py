"""Samples, splits, folds and history growth, deterministic by hash on any partitioning.

Whoever is drawn is decided by hash order. Exact sizes come from `running_totals`, a distributed
prefix sum, so neither a class nor a history list is gathered in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.relational import member
from claimweave.operators.windows import running_totals


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of a hash of the columns, which SQL can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: int, *columns: str) -> str:
    text = f"concat_ws('|', '{seed}', {', '.join(f'cast({c} as varchar)' for c in columns)})"
    return f"(cast(cast('0x' || substr(md5({text}), 1, 13) as bigint) as double) / {float(1 << 52)!r})"


def _ordered(df: DataFrame, key: str, ids: list[str], seed: int) -> DataFrame:
    """Rows with `__cw_at`, their place from 1 among the rows of their class in hash order."""
    x = df.withColumn("__cw_u", uniform(seed, *ids)).withColumn("__cw_one", F.lit(1))
    before, run = [], 0
    for r in df.groupBy(key).count().where(F.col(key).isNotNull()).orderBy(key).collect():
        before += [F.lit(r[key]), F.lit(run)]
        run += r["count"]
    x = running_totals(x.where(F.col(key).isNotNull()), [key, "__cw_u", *ids], "__cw_one", "__cw_at")
    return x.withColumn("__cw_at", F.col("__cw_at") - F.create_map(*before)[F.col(key)]) if before else x


def stratify(df: DataFrame, key: str, sizes: dict, ids: list[str], seed: int = 0) -> DataFrame:
    """So many rows per class; a class with fewer repeats whole rounds of its rows (with replacement
    in the sense that each is used as evenly as possible). Classes not listed are left out."""
    counts = {r[key]: r["count"] for r in df.groupBy(key).count().collect()}
    want = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v)])
    have = F.create_map(*[F.lit(x) for k in sizes for x in (k, max(counts.get(k, 0), 1))])
    x = _ordered(member(df, df.sparkSession.createDataFrame([(k,) for k in sizes], [key]).withColumn(key, F.col(key).cast(df.schema[key].dataType)), [key]), key, ids, seed)
    times = F.floor((want[F.col(key)] - F.col("__cw_at")) / have[F.col(key)]) + 1
    return x.withColumn("__cw_times", times).where("__cw_times > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__cw_times").cast("int")))).select(*df.columns, "copy_no")


def ratio_sizes(counts: dict, ratios: dict, oversample: bool = False) -> dict:
    """Class sizes in the given ratios: the largest that need no repeats, or (oversampling) the
    smallest that leave out no row."""
    shares = {k: v / sum(ratios.values()) for k, v in ratios.items()}
    fits = [counts[k] / s for k, s in shares.items() if s > 0]
    total = max(fits) if oversample else min(fits)
    return {k: round(total * s) for k, s in shares.items()}


def group_split(df: DataFrame, keys: list[str], shares: dict[str, float], seed: int = 0) -> DataFrame:
    """`split` by hash of the group, so that a group is never divided."""
    u, edge, out = uniform(seed, *keys), 0.0, None
    whole = sum(shares.values())
    for name, s in shares.items():
        edge += s / whole
        out = F.when(u < edge, F.lit(name)) if out is None else out.when(u < edge, F.lit(name))
    return df.withColumn("split", out.otherwise(F.lit(list(shares)[-1])))


def folds(df: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(uniform(seed, *keys) * k).cast("int"))


def valid_folds(df: DataFrame, keys: list[str], k: int, label: str, least: float = 0.2, tries: int = 20, seed: int = 0) -> DataFrame:
    """Folds with both classes and at least `least` / k of the rows each: the first seed that gives them."""
    for t in range(tries):
        x = folds(df, keys, k, seed + t)
        rows = x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("c")).collect()
        total = sum(r["n"] for r in rows)
        if len(rows) == k and all(r["n"] >= least / k * total and r["c"] > 1 for r in rows):
            return x
    raise ValueError(f"no valid folds in {tries} tries")


def length_exponent(sizes: DataFrame, head: int) -> float:
    """Slope of log(number of histories) on log(length) over the `head` shortest lengths."""
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy("n").limit(head)
    row = counts.agg(F.regr_slope(F.log("c"), F.log("n"))).first()
    return row[0] if row[0] is not None else 0.0


def power_law_exponent(counts: dict[int, int], low: float = 1.01, high: float = 6.0) -> float:
    """Maximum-likelihood exponent of a discrete power law, by golden section on the few distinct lengths."""
    top = max(counts)
    def loss(g: float) -> float:
        z = sum(i**-g for i in range(1, top + 1))
        return sum(c * (g * math.log(n) + math.log(z)) for n, c in counts.items())
    inv = (math.sqrt(5) - 1) / 2
    while high - low > 1e-5:
        a, b = high - inv * (high - low), low + inv * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return (low + high) / 2


def sample_by_length(df: DataFrame, keys: list[str], share: float, exponent: float | None = None, head: int = 5, seed: int = 0) -> DataFrame:
    """Whole histories whose lengths follow a power law, up to a share of the rows.

    Each history gets the key log(u) / w with w its length's target density over the number of
    histories of that length, so that taking them by key is a weighted draw without replacement.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    g = length_exponent(sizes, head) if exponent is None else exponent
    per = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    x = sizes.join(per, "n").withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(g))) / F.col("c"))
    x = x.withColumn("key", F.log(uniform(seed, *keys) + 1e-18) / F.col("w") * -1)
    run = running_totals(x, ["key", *keys], "n", "upto")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return member(df, run.where(F.col("upto") - F.col("n") < share * total), keys)


def grow_histories(batches: DataFrame, keys: list[str], budget: int, direction: str = "min", seed: int = 0, time: str = "year") -> DataFrame:
    """Batches revealed in order until the budget of claims is used, as `revealed` and `step`.

    `min`: all histories get their i-th batch before any gets its next; `max`: the longest history is
    finished before the next begins; `random`: histories advance at random. The order is a sort, so
    the loop that takes one history at a time becomes one prefix sum.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    x = batches.withColumn("i", F.row_number().over(w.orderBy(time))).withColumn("size", F.sum("n").over(w)).withColumn("u", uniform(seed, *keys))
    if direction == "min":
        order = ["i", "u", *keys]
    elif direction == "max":
        x = x.withColumn("size", -F.col("size"))
        order = ["size", "u", *keys, "i"]
    elif direction == "random":
        # The i-th batch's key is the i-th record of a running maximum, so a history stays in order.
        x = x.withColumn("r", F.max(uniform(seed, *keys, "i")).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
        order = ["r", *keys, "i"]
    else:
        raise ValueError(direction)
    out = running_totals(x, order, "n", "step")
    return out.withColumn("revealed", F.col("step") - F.col("n") < budget).select(*batches.columns, "revealed", "step")


def total_sizes(counts: dict, size: int, ratios: list[float] | None = None) -> dict:
    """Rows per class for a sample of `size`, in the ratios given in order of frequency (equal ones if none);
    what rounding leaves goes to the most frequent class."""
    order = sorted((k for k in counts if k is not None), key=lambda k: (-counts[k], str(k)))
    shares = ratios if ratios and len(ratios) == len(order) else [1.0] * len(order)
    sizes = {k: int(size * r / sum(shares)) for k, r in zip(order, shares)}
    if order:
        sizes[order[0]] += size - sum(sizes.values())
    return sizes


def parts_by_class(df: DataFrame, label: str, ids: list[str], shares: dict[str, float], seed: int = 0) -> DataFrame:
    """`part`: in each class the rows in hash order are cut at the shares, so that every part has the classes
    in proportion, to a row. Rows without a class are left out."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return df.withColumn("part", F.lit(None).cast("string")).limit(0)
    x, names, edge, out = _ordered(df, label, ids, seed), list(shares), 0.0, None
    n = F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, c)])[F.col(label)]
    for name in names[:-1]:
        edge += shares[name] / sum(shares.values())
        cond = F.col("__cw_at") <= F.round(n * F.lit(edge))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return x.withColumn("part", out.otherwise(F.lit(names[-1])) if out is not None else F.lit(names[0])).select(*df.columns, "part")


def stratified_group_split(df: DataFrame, keys: list[str], shares: dict[str, float], label: Column, seed: int = 0) -> DataFrame:
    """`part` of each row by its group: groups of one class, the value of the aggregate `label`, are cut at the
    shares, so that no group is divided and every part has the classes in proportion."""
    groups = parts_by_class(df.groupBy(*keys).agg(label.alias("__cw_label")), "__cw_label", keys, shares, seed)
    return df.join(groups.select(*keys, "part"), keys)


def length_draw(df: DataFrame, keys: list[str], share: float, exponent: float, seed: int = 0) -> DataFrame:
    """Rows of whole histories whose lengths are drawn from a power law until a share of the rows is reached.

    The draws are made on the few distinct lengths: each goes to the nearest length of which a history is
    left. Which histories of a length are taken is decided by hash, so only counts come to the driver.
    """
    import numpy as np

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    have = {r["n"]: r["c"] for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not have:
        return df
    rng, lengths = np.random.default_rng(seed), np.array(sorted(have))
    left, due, top = np.array([have[n] for n in lengths]), share * sum(n * c for n, c in have.items()), lengths.max()
    taken, a = np.zeros(len(lengths), np.int64), 1.0 - exponent
    while due > 0 and left.sum():
        u = rng.random(int(min(max(due / lengths.mean(), 1), 100_000)))
        want = ((top**a - 1) * u + 1) ** (1 / a) if abs(a) > 1e-9 else top**u
        for w in want:
            open_ = np.flatnonzero(left)
            if due <= 0 or not len(open_):
                break
            i = open_[np.abs(lengths[open_] - w).argmin()]
            left[i], taken[i], due = left[i] - 1, taken[i] + 1, due - lengths[i]
    chosen = {int(n): int(t) for n, t in zip(lengths, taken) if t}
    if not chosen:
        return df.limit(0)
    at = _ordered(sizes, "n", keys, seed)
    most = F.create_map(*[F.lit(v) for k, t in chosen.items() for v in (k, t)])[F.col("n")]
    return member(df, at.where(F.col("__cw_at") <= most), keys)


def population_stats(grown: DataFrame, keys: list[str]) -> DataFrame:
    """Of a growing population: histories, those begun and those complete, batches and claims revealed."""
    per = grown.groupBy(*keys).agg(F.sum(F.when(F.col("revealed"), F.col("n")).otherwise(0)).alias("f"), F.sum("n").alias("p"), F.count(F.when(F.col("revealed"), 1)).alias("b"))
    return per.agg(F.count(F.lit(1)).alias("histories"), F.count(F.when(F.col("f") > 0, 1)).alias("begun"), F.count(F.when(F.col("f") == F.col("p"), 1)).alias("complete"),
                   F.coalesce(F.sum("b"), F.lit(0)).alias("batches"), F.coalesce(F.sum("f"), F.lit(0)).alias("claims"))


def populate(grown: DataFrame, truth: DataFrame, keys: list[str], budgets: list[int]) -> DataFrame:
    """For each budget of revealed claims: interactions begun, accuracy and mean squared error of their
    positive share against the truth. The order of growth is one column, so the budgets need no loop: a
    batch counts for every budget that reaches it."""
    b = F.array(*[F.lit(int(x)) for x in budgets])
    x = grown.withColumn("budget", F.explode(F.filter(b, lambda v: F.col("step") - F.col("n") < v)))
    return _scored(x.groupBy("budget", *keys).agg((F.sum("k") / F.sum("n")).alias("p")), truth, keys, "budget")


def populate_by_year(batches: DataFrame, truth: DataFrame, keys: list[str], time: str = "year") -> DataFrame:
    """As `populate`, with the years as budgets: each history up to the year, carried forward to years it has no batch in."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    years = sorted(r[0] for r in batches.select(time).distinct().collect())
    every = F.array(*[F.lit(y).cast(batches.schema[time].dataType) for y in years])
    x = batches.withColumn("p", F.sum("k").over(run) / F.sum("n").over(run)).withColumn("__cw_next", F.lead(time).over(w))
    x = x.withColumn("look", F.explode(F.filter(every, lambda y: (y >= F.col(time)) & (F.col("__cw_next").isNull() | (y < F.col("__cw_next"))))))
    return _scored(x.select("look", *keys, "p"), truth, keys, "look")


def _scored(estimates: DataFrame, truth: DataFrame, keys: list[str], by: str) -> DataFrame:
    x = estimates.join(truth.select(*keys, "truth"), keys)
    d = F.col("p") - F.col("truth")
    right = ((F.col("p") > 0.5) == (F.col("truth") > 0.5)).cast("int")
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(d * d).alias("mse"))


def synthetic_claims(spark, n: int, modes: list[tuple[float, float, float, float]], step: tuple[float, float, float, float], seed: int = 0) -> DataFrame:
    """Claims of known laws: `mode` drawn by weight, time `t` of the mode's shifted log-normal law (weight, mu,
    sigma, shift), a feature `x` of a uniform law, `p` logistic in x with a coefficient that steps over time
    (centre, steepness, before, after), and `pos` a Bernoulli draw. By hash of the row's number, so the
    same on any partitioning."""
    from claimweave.functions.math import inv_logit, norm_ppf

    u = lambda i: uniform(seed + i, "id")
    df, whole, edge, mode = spark.range(n), sum(m[0] for m in modes), 0.0, None
    for i, m in enumerate(modes[:-1]):
        edge += m[0] / whole
        mode = F.when(u(0) < edge, F.lit(i)) if mode is None else mode.when(u(0) < edge, F.lit(i))
    df = df.withColumn("mode", mode.otherwise(F.lit(len(modes) - 1)) if mode is not None else F.lit(0))
    at = lambda j: F.get(F.array(*[F.lit(float(m[j])) for m in modes]), F.col("mode"))
    df = df.withColumn("t", F.exp(at(1) + at(2) * norm_ppf(u(1))) + at(3)).withColumn("x", u(2) * 2 - 1)
    centre, steep, before, after = step
    beta = F.lit(before) + F.lit(after - before) * inv_logit(F.lit(steep) * (F.col("t") - F.lit(centre)))
    return df.withColumn("p", inv_logit(beta * F.col("x"))).withColumn("pos", (u(3) < F.col("p")).cast("int"))


def start_modes(df: DataFrame, keys: list[str], value: str, modes: int) -> DataFrame:
    """Starting points of a mixture per group: its values in order are cut into equal parts; the mean and
    deviation of the logs of each, and its share. A value that repeats is in the part of its last place."""
    from claimweave.operators.windows import group_value_ranks

    x = group_value_ranks(df.where(F.col(value) > 0), keys, value)
    part = F.floor((F.col("__cw_upto") - 1) * modes / F.col("__cw_total")).cast("int")
    l, w = F.log(value), F.col("__cw_n")
    out = x.withColumn("mode", part).groupBy(*keys, "mode").agg(F.sum(w).alias("n"), F.sum(w * l).alias("s"), F.sum(w * l * l).alias("q"), F.max("__cw_total").alias("t"))
    mu = F.col("s") / F.col("n")
    return out.select(*keys, "mode", mu.alias("mu"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mu * mu, F.lit(0.0))).alias("sigma"), (F.col("n") / F.col("t")).alias("share"))
