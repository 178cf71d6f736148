"""Filling missing values from similar records.

K-prototypes (numeric distance plus categorical mismatches, over the features a record has) gives
each record a cluster. A missing value takes the median (numeric) or mode (categorical) of the
narrowest group that has one: the records of its cluster within a grouping key, else the parent,
which is all records of that key, else the next key, else the cluster at large, else all records.
Keys are tried in the order of the spread that is left within their groups, measured on the data,
so that a field is filled from the paper, journal, organisation or year that determines it best.

Scale: a k-prototypes round is one scan with typed partial aggregates, a row a cluster; only the k
prototypes and one dispersion figure a key come to the driver. Medians are `percentile_approx`
sketches, which merge and stay bounded on a group that holds a third of the rows; modes come from
counts per category. Lookups have one row a group, with at most k cluster entries, and are joined to
the rows with a gap only, the hot groups apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.skew import heavy_keys, salted_join
from claimweave.session import cut

P = "__cw_"
CLUSTER = P + "cluster"
#: Accuracy of the median sketches: relative rank error 1 / 2000.
ACCURACY = 2000
#: Categories a cluster's frequent-items sketch tracks: the mode is exact up to 3/4 of so many, and
#: beyond it for any category of more than about 3.5 / TRACKED of the cluster.
TRACKED = 4096


@dataclass(frozen=True)
class Fill:
    """A field to fill. `valid` gives the observed value or null; it must have the field's type.
    `keys` names the grouping keys the field may be filled from."""

    name: str
    valid: Column
    keys: tuple[str, ...]
    kind: str = "numeric"


@dataclass
class Prototypes:
    numeric: list[str]
    categorical: list[str]
    means: list[list[float | None]]
    modes: list[list[str | None]]
    scales: list[float] = field(default_factory=list)


def _distances(p: Prototypes, gamma: float) -> list[Column]:
    """Mean squared standardised difference and mismatch over the features observed in the row. A feature
    the prototype does not know costs what it costs on average: 1, the mean squared standardised
    difference to the mean, or `gamma`, a mismatch. So not knowing is never nearer than knowing well."""
    out = []
    for means, modes in zip(p.means, p.modes):
        parts, known = [], []
        for c, mean, scale in zip(p.numeric, means, p.scales):
            d = F.pow((F.col(c) - F.lit(mean)) / F.lit(scale), F.lit(2.0)) if mean is not None else F.lit(1.0)
            parts.append(F.when(F.col(c).isNotNull(), d).otherwise(F.lit(0.0)))
            known.append(F.col(c).isNotNull().cast("int"))
        for c, mode in zip(p.categorical, modes):
            miss = F.col(c) != mode if mode is not None else F.col(c).isNotNull()
            parts.append(F.when(miss, F.lit(gamma)).otherwise(F.lit(0.0)))
            known.append(F.col(c).isNotNull().cast("int"))
        total = reduce(Column.__add__, parts) if parts else F.lit(0.0)
        count = reduce(Column.__add__, known) if known else F.lit(0)
        out.append(total / F.greatest(count, F.lit(1)))
    return out


def _assign(df: DataFrame, p: Prototypes, gamma: float) -> DataFrame:
    d = F.array(*_distances(p, gamma))
    return df.withColumn(CLUSTER, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _start(df: DataFrame, numeric: list[str], categorical: list[str], k: int, seed: int) -> Prototypes:
    """k distinct rows of lowest hash, those with most features first, and the scale of each number: one
    scan, in which every task keeps its k lowest only."""
    cols = [*numeric, *categorical]
    gaps = reduce(Column.__add__, [F.col(c).isNull().cast("int") for c in cols])
    hashed = df.select(gaps.alias("g"), F.xxhash64(F.lit(seed), *cols).alias("h"), *cols)
    # Equal rows have equal hashes; where they repeat so often that the lowest hold too few, all are told apart first.
    lowest = hashed.orderBy("g", "h").limit(8 * k).collect()
    rows = list({(r["g"], r["h"]): r for r in lowest}.values())[:k]
    if len(rows) < k and len(lowest) == 8 * k:
        rows = hashed.distinct().orderBy("g", "h").limit(k).collect()
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first() if numeric else {}
    scales = [float(spread[c]) if spread[c] else 1.0 for c in numeric]
    return Prototypes(numeric, categorical, [[r[c] for c in numeric] for r in rows] or [[None] * len(numeric)],
                      [[r[c] for c in categorical] for r in rows] or [[None] * len(categorical)], scales)


def k_prototypes(df: DataFrame, numeric: list[str], categorical: list[str], k: int = 8, rounds: int = 4,
                 gamma: float = 1.0, seed: int = 7, settled: float = 0.05) -> Prototypes:
    """Fit k prototypes over all rows; `numeric` columns are doubles, `categorical` strings, nulls
    are features not observed. Starts from k distinct rows, complete ones first. Ends when no mean
    moves by more than `settled` of its feature's deviation and no mode changes, or after so many
    rounds. Ties go to the lower cluster and the alphabetically first category. Fewer than k distinct
    rows give fewer prototypes; none, one empty. A feature no row of a cluster has keeps its value."""
    p = _start(df, numeric, categorical, k, seed)
    if all(v is None for row in (*p.means, *p.modes) for v in row):
        return p
    # One aggregate a round: a sum and a count of each number, a sketch of the categories, a row a cluster.
    aggs = [F.avg(c).alias(c) for c in numeric] + [F.expr(f"approx_top_k(`{c}`, 16, {TRACKED})").alias(c) for c in categorical]
    for _ in range(rounds):
        moved = False
        for r in _assign(df, p, gamma).groupBy(CLUSTER).agg(*aggs).collect():
            means, modes = p.means[r[CLUSTER]], p.modes[r[CLUSTER]]
            for i, c in enumerate(numeric):
                if r[c] is not None:
                    moved |= means[i] is None or abs(r[c] - means[i]) > settled * p.scales[i]
                    means[i] = r[c]
            for i, c in enumerate(categorical):
                seen = [(-x["count"], x["item"]) for x in r[c] or [] if x["item"] is not None]
                if seen:
                    moved |= modes[i] != min(seen)[1]
                    modes[i] = min(seen)[1]
        if not moved:
            break
    return p


def _numeric_groups(seen: DataFrame, kc: str, key: str, wanted: list[Fill]) -> DataFrame:
    """Per value of the key: medians of its clusters and of all of it, with count and variance. Both
    levels in one shuffle: the key's clusters, and (cluster null) all of it."""
    aggs = [x for f in wanted for v in [f"{P}v_{f.name}"] for x in (
        F.percentile_approx(v, 0.5, ACCURACY).alias("m_" + f.name), F.count(v).alias("n_" + f.name), F.var_pop(v).alias("s_" + f.name))]
    both = seen.groupingSets([[kc, CLUSTER], [kc]], kc, CLUSTER).agg(*aggs)
    whole, parts = F.col(CLUSTER).isNull(), []
    for f in wanted:
        m = F.col("m_" + f.name)
        parts += [
            F.map_from_entries(F.collect_list(F.when(~whole & m.isNotNull(), F.struct(CLUSTER, m)))).alias(f"{P}{key}_c_{f.name}"),
            *[F.max(F.when(whole, F.col(a + f.name))).alias(f"{P}{key}_{b}_{f.name}") for a, b in (("m_", "w"), ("n_", "n"), ("s_", "s"))]]
    return both.groupBy(kc).agg(*parts)


def _category_groups(seen: DataFrame, kc: str, key: str, f: Fill) -> DataFrame:
    """As `_numeric_groups` for a categorical field: modes (the first on ties) from counts per category,
    and for the spread the share of values that differ from the mode. No group's categories are gathered."""
    v = f"{P}v_{f.name}"
    counts = seen.where(F.col(v).isNotNull()).groupBy(kc, CLUSTER, v).agg(F.count(F.lit(1)).alias("n"))
    mode = lambda: F.min_by(v, F.struct(-F.col("n"), F.col(v)))
    clusters = counts.groupBy(kc, CLUSTER).agg(mode().alias("m")).groupBy(kc).agg(F.map_from_entries(F.collect_list(F.struct(CLUSTER, "m"))).alias(f"{P}{key}_c_{f.name}"))
    whole = counts.groupBy(kc, v).agg(F.sum("n").alias("n")).groupBy(kc).agg(
        mode().alias(f"{P}{key}_w_{f.name}"), F.sum("n").alias(f"{P}{key}_n_{f.name}"), (1 - F.max("n") / F.sum("n")).alias(f"{P}{key}_s_{f.name}"))
    return clusters.join(whole, kc)


def fill_from_similar(df: DataFrame, fills: list[Fill], keys: dict[str, Column], numeric: dict[str, Column],
                      categorical: dict[str, Column], k: int = 8, rounds: int = 4, gamma: float = 1.0) -> DataFrame:
    """All rows and columns of `df`, with three columns added for each fill:

    `<name>_filled` the observed or filled value, `<name>_was_missing` the mark, and `<name>_method`:
    `observed`, `<key>+cluster`, `<key>`, `cluster`, `overall`, or `none` where no row has a value.

    A value for which `valid` is null is missing. Rows keep their number: repeats stay, nothing is
    collapsed. Null keys are no group. An empty table gives an empty table. Columns already named
    like an added one are replaced.
    """
    internal = {f"{P}k_{n}": e.cast("string") for n, e in keys.items()}
    internal |= {f"{P}n_{n}": e.cast("double") for n, e in numeric.items()}
    internal |= {f"{P}c_{n}": e.cast("string") for n, e in categorical.items()}
    internal |= {f"{P}v_{f.name}": f.valid for f in fills}
    added = [f"{f.name}{s}" for f in fills for s in ("_filled", "_was_missing", "_method")]
    own = [c for c in df.columns if c not in added]
    narrow = cut(df.select(*[e.alias(n) for n, e in internal.items()]))
    p = k_prototypes(narrow, [f"{P}n_{n}" for n in numeric], [f"{P}c_{n}" for n in categorical], k, rounds, gamma)

    seen = _assign(narrow, p, gamma)
    lookups, order = {}, {f.name: [] for f in fills}
    for key in keys:
        kc, wanted = f"{P}k_{key}", [f for f in fills if key in f.keys]
        if not wanted:
            continue
        keyed, numbers = seen.where(F.col(kc).isNotNull()), [f for f in wanted if f.kind == "numeric"]
        groups = ([_numeric_groups(keyed, kc, key, numbers)] if numbers else []) + [_category_groups(keyed, kc, key, f) for f in wanted if f.kind != "numeric"]
        lookups[key] = cut(reduce(lambda a, b: a.join(b, kc, "full"), groups))
        left = lookups[key].agg(*[x for f in wanted for x in (
            (F.sum(F.col(f"{P}{key}_n_{f.name}") * F.col(f"{P}{key}_s_{f.name}"))).alias("w_" + f.name),
            F.sum(F.when(F.col(f"{P}{key}_n_{f.name}") > 1, F.col(f"{P}{key}_n_{f.name}") - 1)).alias("d_" + f.name),
        )]).first()
        for f in wanted:
            w, d = left["w_" + f.name], left["d_" + f.name]
            order[f.name].append((w / d if w is not None and d else float("inf"), f.keys.index(key), key))

    by_cluster, overall = _centres(seen, fills)
    rows = _assign(df.select(*own, *[e.alias(n) for n, e in internal.items()]), p, gamma)
    for f in fills:
        rows = rows.withColumn(f"{f.name}_was_missing", F.col(f"{P}v_{f.name}").isNull())
    gap = reduce(Column.__or__, [F.col(f"{f.name}_was_missing") for f in fills])
    full, part = rows.where(~gap), rows.where(gap)
    for f in fills:
        full = full.withColumn(f"{f.name}_filled", F.col(f"{P}v_{f.name}")).withColumn(f"{f.name}_method", F.lit("observed"))
    missing = reduce(Column.__or__, [F.col(f"{P}v_{f.name}").isNull() for f in fills])
    heavy = heavy_keys(narrow.where(missing), {key: F.col(f"{P}k_{key}") for key in lookups}, 0.02, 1000)[0] if lookups else {}
    for key, lookup in lookups.items():
        part = salted_join(part, lookup, f"{P}k_{key}", heavy[key])
    for f in fills:
        v, kind = F.col(f"{P}v_{f.name}"), df.select(f.valid.alias("v")).schema["v"].dataType
        chain = [(v, F.lit("observed"))]
        for _, _, key in sorted(order[f.name]):
            chain.append((F.col(f"{P}{key}_c_{f.name}")[F.col(CLUSTER)], F.lit(f"{key}+cluster")))
            chain.append((F.col(f"{P}{key}_w_{f.name}"), F.lit(key)))
        cluster = F.lit(None).cast(kind)
        for c, m in by_cluster[f.name].items():
            cluster = F.when(F.col(CLUSTER) == c, F.lit(m).cast(kind)).otherwise(cluster)
        chain += [(cluster, F.lit("cluster")), (F.lit(overall[f.name]).cast(kind), F.lit("overall"))]
        method = F.coalesce(*[F.when(x.isNotNull(), m) for x, m in chain], F.lit("none"))
        part = part.withColumn(f"{f.name}_filled", F.coalesce(*[x.cast(kind) for x, _ in chain])).withColumn(f"{f.name}_method", method)
    return full.select(*own, *added).unionByName(part.select(*own, *added))


def _centres(seen: DataFrame, fills: list[Fill]) -> tuple[dict[str, dict], dict]:
    """({field: {cluster: centre}}, {field: centre of all rows}); clusters are at most k."""
    by, overall = {f.name: {} for f in fills}, {f.name: None for f in fills}
    numbers = [f for f in fills if f.kind == "numeric"]
    if numbers:
        sketch = [F.percentile_approx(f"{P}v_{f.name}", 0.5, ACCURACY).alias(f.name) for f in numbers]
        rows = seen.groupBy(CLUSTER).agg(*sketch).collect()
        for f in numbers:
            by[f.name] = {r[CLUSTER]: r[f.name] for r in rows if r[f.name] is not None}
        # A centre of all rows is asked for only where a cluster has none.
        if any(r[f.name] is None for r in rows for f in numbers):
            whole = seen.agg(*sketch).first()
            overall |= {f.name: whole[f.name] for f in numbers}
    for f in fills:
        if f.kind == "numeric":
            continue
        v = f"{P}v_{f.name}"
        counts = seen.where(F.col(v).isNotNull()).groupBy(CLUSTER, v).agg(F.count(F.lit(1)).alias("n"))
        mode = F.min_by(v, F.struct(-F.col("n"), F.col(v))).alias("m")
        by[f.name] = {r[CLUSTER]: r["m"] for r in counts.groupBy(CLUSTER).agg(mode).collect()}
        overall[f.name] = counts.groupBy(v).agg(F.sum("n").alias("n")).agg(mode).first()["m"]
    return by, overall


def most_frequent(df: DataFrame, value: Column):
    """The most frequent non-null value, the lowest on ties; None if there is none."""
    row = df.select(value.alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").first()
    return row["v"] if row else None
