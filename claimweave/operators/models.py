"""Supervised models and clustering on pyspark.ml; loops over settings run on the driver, data stay put."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.metrics import auc
from claimweave.operators.sampling import uniform
from claimweave.session import cut, drop_cuts


def assemble(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Rows with a `features` vector; rows with a null or NaN among them are left out."""
    x = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    return x.withColumn("label", F.col(label).cast("double")).where("label is not null") if label else x


def fit_forest(train: DataFrame, trees: int = 20, depth: int = 4, leaf: int = 1, seed: int = 0):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(train)


def fit_tree(train: DataFrame, depth: int = 4, seed: int = 0):
    return DecisionTreeClassifier(maxDepth=depth, seed=seed).fit(train)


def fit_lasso(train: DataFrame, penalty: float):
    return LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=50).fit(train)


def fit_linear(train: DataFrame, penalty: float = 0.0, l1: float = 1.0):
    return LinearRegression(elasticNetParam=l1, regParam=penalty, standardization=False).fit(train)


def fit_forest_regression(train: DataFrame, trees: int = 20, depth: int = 4, seed: int = 0):
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(train)


def scored(model, test: DataFrame) -> DataFrame:
    return model.transform(test).withColumn("score", vector_to_array("probability")[1])


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, (float(v) for v in model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def cross_validated(df: DataFrame, fold: str, fit: Callable[[DataFrame], object]) -> list[tuple[int, float | None]]:
    """AUC of the held-out fold for each fold."""
    out = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        model = fit(df.where(F.col(fold) != k))
        out.append((k, auc(scored(model, df.where(F.col(fold) == k)), "score", "label").first()["auc"]))
    return out


def lasso_path(train: DataFrame, penalties: list[float]) -> list[tuple[float, int, list[float]]]:
    """Penalty, number of non-zero coefficients, coefficients."""
    out = []
    for p in penalties:
        c = fit_lasso(train, p).coefficients.toArray()
        out.append((p, int((np.abs(c) > 1e-9).sum()), c.tolist()))
    return out


def lasso_with(train: DataFrame, most: int, low: float = 1e-5, high: float = 1.0, steps: int = 12):
    """The weakest penalty (bisected on its logarithm) that leaves at most so many coefficients."""
    best = fit_lasso(train, high)
    for _ in range(steps):
        mid = float(np.sqrt(low * high))
        m = fit_lasso(train, mid)
        if (np.abs(m.coefficients.toArray()) > 1e-9).sum() <= most:
            best, high = m, mid
        else:
            low = mid
    return best


def forward_selection(df: DataFrame, label: str, families: dict[str, list[str]], most: int, evaluate: Callable[[list[str]], float]) -> list[tuple[str, float]]:
    """Greedy forward selection, one feature per family, until nothing improves."""
    chosen, score, left = [], -np.inf, dict(families)
    while left and len(chosen) < most:
        trials = [(evaluate([c for c, _ in chosen] + [c]), c, f) for f, cs in sorted(left.items()) for c in cs]
        value, column, family = max(trials, key=lambda t: (t[0], t[1]))
        if value <= score:
            break
        chosen.append((column, value))
        score = value
        del left[family]
    return chosen


def logit_p_values(df: DataFrame, features: list[str], coefficients: list[float], intercept: float) -> list[tuple[str, float]]:
    """Wald p-values from the Fisher information, a sum of outer products taken in one aggregate."""
    names = ["__one", *features]
    x = df.withColumn("__one", F.lit(1.0))
    z = F.lit(intercept)
    for f, c in zip(features, coefficients):
        z = z + F.col(f) * F.lit(c)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    w = p * (F.lit(1.0) - p)
    m = len(names)
    row = x.agg(*[F.sum(F.col(names[i]) * F.col(names[j]) * w).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    info = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
    sd = np.sqrt(np.diag(np.linalg.pinv(info)))
    from math import erfc, sqrt
    stats = np.array([intercept, *coefficients]) / np.where(sd > 0, sd, np.inf)
    return [(n, erfc(abs(s) / sqrt(2))) for n, s in zip(["intercept", *features], stats)]


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = 0) -> DataFrame:
    """`cluster` and the standardised distance to its centre (distance over the mean of the cluster)."""
    x = assemble(df, features)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(x).transform(x)
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(scaled)
    y = model.transform(scaled).withColumn("__cw_a", vector_to_array("scaled"))
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    d = F.sqrt(F.aggregate(F.zip_with("__cw_a", centres[F.col("cluster")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    y = y.withColumn("distance", d)
    mean = y.groupBy("cluster").agg(F.avg("distance").alias("__cw_m"))
    return y.join(F.broadcast(mean), "cluster").withColumn("distance", F.coalesce(F.try_divide("distance", "__cw_m"), F.lit(0.0))).select(*df.columns, "cluster", "distance")


def gap_statistic(df: DataFrame, features: list[str], ks: list[int], references: int = 3, seed: int = 0) -> list[tuple[int, float, float]]:
    """(k, gap, deviation): log dispersion of uniform samples over the data's box less that of the data."""
    spark, x = df.sparkSession, assemble(df, features).select("features", *features)
    box = x.agg(*[f(c).alias(f"{c}_{n}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    n = x.count()
    def loss(frame, k):
        if k == 1:  # one cluster: the variance around the mean
            parts = frame.select(vector_to_array("features").alias("a")).agg(*[F.var_pop(F.col("a")[i]).alias(f"v{i}") for i in range(len(features))]).first()
            return np.log(max(n * sum(v or 0.0 for v in parts), 1e-12))
        return np.log(max(KMeans(k=k, seed=seed).fit(frame).summary.trainingCost, 1e-12))
    refs = []
    for r in range(references):
        cols = [(F.lit(float(box[f"{c}_lo"])) + uniform(seed * 1000 + r * 50 + i, "id") * F.lit(float(box[f"{c}_hi"] - box[f"{c}_lo"]))).alias(c) for i, c in enumerate(features)]
        refs.append(assemble(spark.range(n).select(*cols), features).select("features"))
    out = []
    for k in ks:
        values = [loss(ref, k) for ref in refs]
        out.append((k, float(np.mean(values) - loss(x, k)), float(np.std(values) * np.sqrt(1 + 1 / references))))
    return out


def near_pairs(df: DataFrame, item: str, threshold: float, other: DataFrame | None = None) -> DataFrame:
    """All pairs of distinct strings within the edit ratio: `first` is the longer one, or of equal
    length the one that sorts first. With `other` (same column) the pairs between the two tables, as
    `item` and `other`.

    Exact: at most k = threshold * n edits turn the shorter string, of n letters, into the longer one.
    So of k + 1 parts of the shorter one at least one stands unchanged in the longer one, moved by no
    more than the edits beside it allow. Only strings that share such a part are compared.
    """
    import pandas as pd

    allowed = lambda n: int(threshold * max(1, n) + 1e-9)
    parts = lambda n: [(n * i // (allowed(n) + 1), n * (i + 1) // (allowed(n) + 1)) for i in range(allowed(n) + 1)]

    def of_shorter(frames):
        for pdf in frames:
            rows = [(s, len(s), i, s[a:b]) for s in pdf[item] for i, (a, b) in enumerate(parts(len(s)))]
            yield pd.DataFrame(rows, columns=["second", "n", "i", "part"])

    def of_longer(frames):
        for pdf in frames:
            rows = set()
            for s in pdf[item]:
                n = len(s)
                while n >= 0 and (more := len(s) - n) <= (k := allowed(n)):
                    for i, (a, b) in enumerate(parts(n)):
                        rows.update((s, n, i, s[a + x:b + x]) for x in range(-((k - more) // 2), (k + more) // 2 + 1) if a + x >= 0 and b + x <= len(s))
                    n -= 1
            yield pd.DataFrame(list(rows), columns=["first", "n", "i", "part"])

    # Few bytes, much work: dealt in turn, as a shuffle by the string would be one with that of the distinct and shrink with it.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings = lambda f: f.select(F.col(item).cast("string").alias(item)).dropna().distinct().repartition(tasks)
    x, y = strings(df), strings(df if other is None else other)
    short = lambda f: f.mapInPandas(of_shorter, "second string, n int, i int, part string")
    long = lambda f: f.mapInPandas(of_longer, "first string, n int, i int, part string")
    longer = (F.length("first") > F.col("n")) | (F.col("first") < F.col("second"))
    near = F.call_function("levenshtein", "first", "second", F.floor(F.lit(threshold) * F.greatest(F.lit(1), F.col("n")) + 1e-9).cast("int")) >= 0
    met = lambda a, b: long(a).join(short(b), ["n", "i", "part"]).where(longer & near)
    if other is None:
        return met(x, x).select("first", "second").distinct()
    both = met(x, y).select(F.col("first").alias("item"), F.col("second").alias("other")).unionByName(met(y, x).select(F.col("second").alias("item"), F.col("first").alias("other")))
    return both.distinct()


def leader_clusters(df: DataFrame, item: str, threshold: float) -> DataFrame:
    """Leader clustering: longest item first, each joins the first leader within the edit ratio, else leads.

    The greedy order is kept without one task for all: in a round every item whose earlier neighbours
    are all settled as followers leads, and its later neighbours follow, until no pair is open.
    """
    items = cut(df.select(F.col(item).cast("string").alias(item)).dropna().distinct())
    pairs = cut(near_pairs(items, item, threshold))
    still, followers = pairs, items.select(item).limit(0)
    while not still.isEmpty():
        leads = still.select("first").join(still.select(F.col("second").alias("first")), "first", "left_anti").distinct()
        follow = cut(still.join(leads, "first", "left_semi").select(F.col("second").alias(item)).distinct())
        last, still = still, cut(still.join(follow.withColumnRenamed(item, "second"), "second", "left_anti").join(follow.withColumnRenamed(item, "first"), "first", "left_anti"))
        followers = followers.unionByName(follow)
        if last is not pairs:
            drop_cuts(df.sparkSession, last)
    followers = cut(followers)
    first = pairs.join(followers.withColumnRenamed(item, "first"), "first", "left_anti").groupBy(F.col("second").alias(item)).agg(
        F.min_by("first", F.struct(-F.length("first"), F.col("first"))).alias("leader"))
    return items.join(followers.join(first, item), item, "left").select(item, F.coalesce("leader", item).alias("leader"))


def linear_p_values(df: DataFrame, features: list[str], label: str) -> list[tuple[str, float, float, float]]:
    """(name, coefficient, standard error, p) of least squares with an intercept, from one aggregate of
    products; p by Student's t. Rows with a null are left out; a singular matrix gives the shortest solution."""
    from claimweave.functions.math import _t_tail

    names = ["__one", *features]
    x = df.dropna(subset=[*features, label]).withColumn("__one", F.lit(1.0))
    m = len(names)
    row = x.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)],
                *[F.sum(F.col(n) * F.col(label)).alias(f"b{i}") for i, n in enumerate(names)], F.sum(F.col(label) * F.col(label)).alias("yy")).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)], float)
    b = np.array([row[f"b{i}"] or 0.0 for i in range(m)], float)
    inverse = np.linalg.pinv(a)
    c, free = inverse @ b, max(int(a[0, 0]) - m, 1)
    sse = max((row["yy"] or 0.0) - c @ b, 0.0)
    se = np.sqrt(np.maximum(np.diag(inverse), 0) * sse / free)
    t = [abs(v) / s if s > 0 else np.inf for v, s in zip(c, se)]
    return [(n, float(v), float(s), float(2 * _t_tail(z, free)) if 0 < z < 1e6 else float(z == 0)) for n, v, s, z in zip(["intercept", *features], c, se, t)]


def backward_elimination(df: DataFrame, features: list[str], label: str, most_p: float = 0.05, least: int = 1) -> list[tuple[int, str, float]]:
    """(step, dropped feature, its p-value): the feature of largest p-value goes while that is above `most_p`."""
    left, out = list(features), []
    while len(left) > least:
        p = {n: v for n, _, _, v in linear_p_values(df, left, label)[1:]}
        worst = max(left, key=lambda f: (p[f], f))
        if p[worst] <= most_p:
            break
        out.append((len(out), worst, p[worst]))
        left.remove(worst)
    return out


def correlation_guided(df: DataFrame, features: list[str], label: str, evaluate: Callable[[list[str]], float], rounds: int = 4, candidates: int = 3) -> list[tuple[str, float]]:
    """Features chosen one a round: of the first candidates, those most correlated with the label, of later ones,
    those that go most against the features chosen, the one with which the evaluation is best. All
    correlations come from one aggregate."""
    from claimweave.operators.aggregates import correlation_table

    table = {frozenset((r["a"], r["b"])): r["corr"] or 0.0 for r in correlation_table(df, [*features, label]).collect()}
    r = lambda a, b: table.get(frozenset((a, b)), 0.0)
    chosen, out = [], []
    for _ in range(min(rounds, len(features))):
        left = [f for f in features if f not in chosen]
        order = sorted(left, key=(lambda f: (sum((r(f, c) + 1) ** 2 for c in chosen), f)) if chosen else (lambda f: (-abs(r(f, label)), f)))
        trials = [(evaluate([*chosen, f]), f) for f in order[:candidates]]
        value, best = max(trials, key=lambda t: (t[0], t[1]))
        chosen.append(best)
        out.append((best, value))
    return out


def best_penalty(train: DataFrame, metric: Callable[[object], float], low: float = 1e-4, high: float = 1.0, steps: int = 10) -> tuple[float, float]:
    """(penalty, metric): golden section on the logarithm of the L1 penalty for the largest metric of the model."""
    phi, a, b, seen = (np.sqrt(5) - 1) / 2, np.log(low), np.log(high), {}
    def value(x: float) -> float:
        key = round(float(x), 9)
        if key not in seen:
            seen[key] = metric(fit_lasso(train, float(np.exp(x))))
        return seen[key]
    for _ in range(steps):
        c, d = b - phi * (b - a), a + phi * (b - a)
        a, b = (a, d) if value(c) >= value(d) else (c, b)
    x = max(seen, key=lambda k: (seen[k], -k))
    return float(np.exp(x)), seen[x]


def choose_by_gap(rows: list[tuple[int, float, float]], least: float = 0.05) -> int:
    """The first k whose gap is not beaten by the next one less its deviation, by more than `least`; -1 if there is none."""
    d = [g0 - g1 + s1 for (_, g0, _), (_, g1, s1) in zip(rows, rows[1:])]
    if not any(x > 0 for x in d):
        return -1
    return next((rows[i][0] for i, x in enumerate(d) if x > least), rows[0][0])


def choose_clusters(df: DataFrame, features: list[str], ks: list[int], seed: int = 0) -> list[tuple[int, float, float]]:
    """(k, cost, silhouette) of k-means over a range of k."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    x = assemble(df, features)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(x).transform(x).select("scaled")
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(scaled)
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(model.transform(scaled)))))
    return out


def merged_clusters(clusters: DataFrame, item: str, cluster: str, threshold: float, small: int = 3) -> DataFrame:
    """Clusters of at most `small` items joined to the larger one that has the nearest item within the edit
    ratio (the first on ties); every pair within the ratio is looked at, none is sampled."""
    from claimweave.operators.text import edit_ratio

    size = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    x = clusters.select(item, cluster).join(size, cluster)
    pairs = near_pairs(clusters, item, threshold)
    both = pairs.unionByName(pairs.select(F.col("second").alias("first"), F.col("first").alias("second")))
    a = x.where(F.col("n") <= small).select(F.col(item).alias("first"), F.col(cluster).alias("from"))
    b = x.where(F.col("n") > small).select(F.col(item).alias("second"), F.col(cluster).alias("to"))
    best = both.join(a, "first").join(b, "second").groupBy("from").agg(F.min_by("to", F.struct(F.round(edit_ratio(F.col("first"), F.col("second")), 9), F.col("to"))).alias("to"))
    out = clusters.select(item, cluster).join(best, F.col(cluster) == F.col("from"), "left")
    return out.select(item, F.coalesce("to", cluster).alias(cluster))


def scaled_rows(values) -> F.Column:
    """An array of more than two numbers scaled to [0, 1] by its own least and largest; shorter ones as they are."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.when((F.size(values) > 2) & (hi > lo), F.transform(values, lambda v: (v - lo) / (hi - lo))).otherwise(values)


def model_runs(df: DataFrame, fold: str, group: str | None, fit: Callable[[DataFrame, int], object], seeds: list[int]) -> list[tuple[str, int, int, float | None]]:
    """(group, seed, fold, AUC of the held-out fold) for every group, seed and fold: the loops of a study are
    driver loops over fits, the data stay where they are."""
    out = []
    groups = [None] if group is None else sorted(r[0] for r in df.select(group).distinct().collect() if r[0] is not None)
    for g in groups:
        x = df if g is None else df.where(F.col(group) == g)
        for s in seeds:
            out += [(str(g), s, int(k), None if v is None else float(v)) for k, v in cross_validated(x, fold, lambda t, s=s: fit(t, s))]
    return out
