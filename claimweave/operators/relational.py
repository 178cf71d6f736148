"""Filters, joins and set operations on claim tables.

Group statistics are joined back from an aggregate instead of taken from a window over the group, so
a group with a third of the rows is combined on the map side and its join is split by AQE.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["up", "dn"]


def conjunction(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)


def mask_out(df: DataFrame, cutoff: float | None = None, extra: list[tuple[str, float, Callable[[Column, float], Column]]] = (),
             truth: str = "cdf_exp", pos: str = "pos") -> DataFrame:
    """Rows with `pos` >= 0, in either tail of `truth` (a cutoff of None or 0 is off), that hold the
    extra masks (column, threshold, predicate)."""
    masks = [(F.col(pos) >= 0) & ~F.isnan(F.col(pos).cast("double"))]
    if cutoff:
        masks.append((F.col(truth) >= 1 - cutoff) | (F.col(truth) <= cutoff))
    masks += [fn(F.col(c), thr) for c, thr, fn in extra]
    return df.where(conjunction(masks))


def mode_excluded(df: DataFrame, c: str) -> DataFrame:
    """Rows that do not hold the most frequent value of the column (lowest value on ties) nor null."""
    top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).select(F.col(c).alias("__cw_mode"))
    return df.join(F.broadcast(top), F.col(c) == F.col("__cw_mode"), "left_anti").where(F.col(c).isNotNull())


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null in those of the columns that are there."""
    return df.dropna(subset=[c for c in columns if c in df.columns])


def with_group_stats(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """`df` with aggregates of its group; groups with a null key have no statistics."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return df.join(stats, keys, "left")


def long_histories(df: DataFrame, more_than: int, keys: list[str] = PAIR) -> DataFrame:
    """Rows of groups with more than so many rows."""
    keep = df.groupBy(*keys).count().where(F.col("count") > more_than).select(*keys)
    return df.join(keep, keys, "left_semi")


def member(df: DataFrame, keys: DataFrame, on: list[str], negate: bool = False) -> DataFrame:
    """Rows whose key tuple is (not) among those of `keys`."""
    return df.join(keys.select(*on), on, "left_anti" if negate else "left_semi")


def halves(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """(rows with c <> 0, rows with c = 0)."""
    return df.where(F.col(c) != 0), df.where(F.col(c) == 0)


def in_bins(df: DataFrame, c: str, edges: list[float]) -> DataFrame:
    """Rows in [edges[i], edges[i+1]) with the bin's number in `bin`."""
    spec = [(F.col(c) >= lo) & (F.col(c) < hi) for lo, hi in zip(edges, edges[1:])]
    bin_ = reduce(lambda acc, x: acc.when(x[1], F.lit(x[0])), list(enumerate(spec))[1:], F.when(spec[0], F.lit(0)))
    return df.withColumn("bin", bin_).where("bin is not null")


def matching(df: DataFrame, spec: dict, columns: list[str]) -> DataFrame:
    """Distinct `columns` of the rows that equal the specification."""
    return df.where(conjunction([F.col(c) == v for c, v in spec.items()])).select(*columns).dropDuplicates()


def grid_counts(df: DataFrame, dims: list[str], more_than: int) -> DataFrame:
    """Every combination of the dimensions with more than so many rows: one aggregate, no loop."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given total order."""
    cols = df.columns
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__cw_rn", F.row_number().over(w)).where("__cw_rn = 1").select(*cols)


def conflict_union(a: DataFrame, b: DataFrame, keys: list[str], value: str, labels: tuple[str, str]) -> DataFrame:
    """Union of two sources: keys whose value differs between them are left out of both; a key in
    both with one value is kept once, from `a`."""
    x, y = a.select(*keys, value), b.select(*keys, value)
    both = x.join(y.withColumnRenamed(value, "__cw_other"), keys)
    conflict = both.where(F.col(value) != F.col("__cw_other")).select(*keys).distinct()
    rest = y.join(x.select(*keys), keys, "left_anti")
    united = x.withColumn("origin", F.lit(labels[0])).unionByName(rest.withColumn("origin", F.lit(labels[1])))
    return united.join(conflict, keys, "left_anti")


def update_join(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cells overwritten by the matching non-null cells of `changes` (one row a key)."""
    new = changes.select(*keys, *[F.col(c).alias("__cw_" + c) for c in columns])
    out = df.join(new, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce("__cw_" + c, c))
    return out.drop(*["__cw_" + c for c in columns])


def asof_previous(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """`left` with the value `right` had at its latest time strictly before the row's (null if none)."""
    l = left.select(*keys, time).distinct().withColumn("__cw_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__cw_side", F.lit(0))
    r = right.select(*keys, time, F.col(value).alias("__cw_v")).withColumn("__cw_side", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(time, "__cw_side").rowsBetween(Window.unboundedPreceding, -1)
    # A row of the right side at the same time sorts after the left one, so only earlier ones are seen.
    seen = l.unionByName(r).withColumn(out, F.last("__cw_v", ignorenulls=True).over(w)).where("__cw_side = 0").select(*keys, time, out)
    return left.join(seen, [*keys, time], "left")


def value_windows(df: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """Each row once for every distinct time t of its group with t - width < time <= t, as `look`.
    Each row goes to `width` possible times and is kept where its group has that time: no range join."""
    looks = df.select(*keys, F.col(time).alias("look")).distinct()
    spread = df.withColumn("look", F.explode(F.sequence(F.col(time), F.col(time) + (width - 1)))).withColumn("look", F.col("look").cast(df.schema[time].dataType))
    return spread.join(looks, [*keys, "look"], "left_semi")


def rank_windows(df: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """Each row once for every distinct time of its group whose last `width` distinct times hold it."""
    times = df.select(*keys, time).distinct()
    w = Window.partitionBy(*keys).orderBy(time)
    times = times.withColumn("__cw_looks", F.array_compact(F.array(*[F.lead(time, i).over(w) if i else F.col(time) for i in range(width)])))
    return df.join(times, [*keys, time]).withColumn("look", F.explode("__cw_looks")).drop("__cw_looks")


def role_join(pairs: DataFrame, attributes: DataFrame, key: str, columns: list[str], roles: tuple[str, ...] = ("up", "dn")) -> DataFrame:
    """Attributes of both ends of a pair, as `<column>_<role>`."""
    out = pairs
    for role in roles:
        out = out.join(attributes.select(F.col(key).alias(role), *[F.col(c).alias(f"{c}_{role}") for c in columns]), role, "left")
    return out


def fold_join(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, how), frames)


def complete_lists(ids: DataFrame, units: DataFrame, key: str, column: str) -> DataFrame:
    """Every id with its list of units, the empty one where it has none."""
    empty = F.array().cast(units.schema[column].dataType)
    return ids.join(units, key, "left").withColumn(column, F.coalesce(column, empty))


def labelled_union(frames: dict[str, DataFrame], label: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(label, F.lit(n)) for n, f in frames.items()])


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are on both sides, only left and only right."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    both = l.withColumn("a", F.lit(1)).join(r.withColumn("b", F.lit(1)), key, "full")
    return both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"),
                    F.count(F.when(F.col("b").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("a").isNull(), 1)).alias("right_only"))


def restrict_pairs(df: DataFrame, wanted: DataFrame, keys: list[str] = PAIR) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted key tuples, wanted tuples that have no row)."""
    w = wanted.select(*keys).distinct()
    return df.join(w, keys, "left_semi"), w.join(df.select(*keys), keys, "left_anti")


def match_parameters(few: DataFrame, many: DataFrame, parameters: list[str]) -> DataFrame:
    """Results of two studies that agree in the parameters of the smaller set: one equi-join on those."""
    return few.join(many, parameters)


def right_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Every row of `keys` with the matching rows of `df`, if any."""
    return df.join(keys, on, "right")


def shards(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """`shard` 0..n-1, dealt in turn along the order, so that sizes differ by one at most."""
    from claimweave.operators.windows import running_totals

    x = running_totals(df.withColumn("__cw_one", F.lit(1)), order, "__cw_one", "__cw_at")
    return x.withColumn("shard", F.pmod(F.col("__cw_at") - 1, F.lit(n)).cast("int")).select(*df.columns, "shard")
