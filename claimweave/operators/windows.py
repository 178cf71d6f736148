"""Ranking and running figures. Windows are partitioned by interaction over batches (a row per
interaction and year); global ranks go through a distributed prefix sum instead of a window over one
partition."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.session import cut

PAIR = ["up", "dn"]


def batches(df: DataFrame, value: str, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """Sum and count of the value per key and time."""
    return df.groupBy(*keys, time).agg(F.sum(value).alias("k"), F.count(value).alias("n"))


def running_totals(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """`df` with the sum of `value` (null counts 0) over all rows up to and including the row, in the
    (total) order.

    One shuffle by range; each task sums its sorted rows as they stream by, and each partition's total
    goes to the driver (one number a partition) and comes back as a small table of offsets."""
    long = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    kind, part = ("bigint", pa.int64()) if long else ("double", pa.float64()), "__cw_part"
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType() if long else T.DoubleType()), T.StructField(part, T.IntegerType())])
    at = df.columns.index(value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, me = 0, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                sums = np.cumsum(b.column(at).cast(kind[1]).fill_null(0).to_numpy(zero_copy_only=False)) + run
                run = sums[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, kind[1]), pa.array(np.full(b.num_rows, me, np.int32))], names=[*b.schema.names, out, part])

    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema))
    rows, run = [], 0
    for r in parts.groupBy(part).agg(F.sum(value).alias("s")).orderBy(part).collect():
        rows.append((r[part], run))
        run += r["s"] or 0
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, f"{part} int, __cw_offset {kind[0]}"))
    return parts.join(offsets, part).withColumn(out, F.col(out) + F.col("__cw_offset")).select(*df.columns, out)


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """A row per distinct value (null excluded): `column`, its rows `__cw_n`, and the rows up to it `__cw_upto`."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__cw_n"))
    return running_totals(counts, [column], "__cw_n", "__cw_upto")


def _between(lo: float, hi: float, part: float) -> float:
    return lo if lo == hi else lo + (hi - lo) * part


def exact_quantiles(df: DataFrame, column: str, percents: list[float]) -> list[float]:
    """Interpolated quantiles of all rows, exact: the values at the two places beside each are read off
    the running counts of distinct values, so no task holds the column. Empty for no values."""
    ranks = value_ranks(df, column)
    total = ranks.agg(F.max("__cw_upto")).first()[0]
    if not total:
        return []
    places = [p * (total - 1) for p in percents]
    wanted = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    row = ranks.agg(*[F.min(F.when(F.col("__cw_upto") > i, F.col(column))).alias(f"v{i}") for i in wanted]).first()
    return [_between(float(row[f"v{math.floor(x)}"]), float(row[f"v{math.ceil(x)}"]), x - math.floor(x)) for x in places]


def group_value_ranks(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row per group and distinct value (null excluded): keys, `column`, `__cw_n` rows, `__cw_upto` rows
    of the group up to it, `__cw_total` rows of the group. One running count over all groups, less what comes before
    the group: a hot group is spread over as many tasks as it needs."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__cw_n"))
    run = running_totals(counts, [*keys, column], "__cw_n", "__cw_upto")
    group = run.groupBy(*keys).agg(F.min(F.col("__cw_upto") - F.col("__cw_n")).alias("__cw_before"), F.sum("__cw_n").alias("__cw_total"))
    same = reduce(Column.__and__, [F.col("r." + k).eqNullSafe(F.col("g." + k)) for k in keys])
    return run.alias("r").join(group.alias("g"), same).select(*["r." + k for k in keys], "r." + column, "r.__cw_n", (F.col("r.__cw_upto") - F.col("g.__cw_before")).alias("__cw_upto"), "g.__cw_total")


def group_quantiles(df: DataFrame, keys: list[str], column: str, percents: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, named as in `percents`; from running counts of values."""
    aggs, out = [], []
    for name, p in percents.items():
        place = F.lit(p) * (F.col("__cw_total") - 1)
        aggs += [F.min(F.when(F.col("__cw_upto") > F.floor(place), F.col(column))).alias("lo_" + name),
                 F.min(F.when(F.col("__cw_upto") > F.ceil(place), F.col(column))).alias("hi_" + name), F.max(place - F.floor(place)).alias("at_" + name)]
        lo, hi = F.col("lo_" + name), F.col("hi_" + name)
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col("at_" + name)).alias(name))
    return group_value_ranks(df, keys, column).groupBy(*keys).agg(*aggs).select(*keys, *out)


def percent_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank of the value among all rows divided by their number (ties share a rank); null for null."""
    ranked = value_ranks(df, column)
    total = ranked.agg(F.max("__cw_upto")).first()[0] or 1
    rank = (F.col("__cw_upto") - (F.col("__cw_n") - 1) / F.lit(2.0)) / F.lit(float(total))
    return df.join(ranked.select(column, rank.alias(out)), column, "left")


def absolute_median_ranks(df: DataFrame, column: str) -> DataFrame:
    """Adds `<c>_pct`, `<c>_absmed` (distance of the rank from the median rank) and `<c>_absmed_pct`.
    All three are found on the table of distinct values, which is joined to the rows once."""
    pct, off, again = f"{column}_pct", f"{column}_absmed", f"{column}_absmed_pct"
    ranked = value_ranks(df, column)
    total = ranked.agg(F.max("__cw_upto")).first()[0] or 1
    ranked = ranked.withColumn(pct, (F.col("__cw_upto") - (F.col("__cw_n") - 1) / F.lit(2.0)) / F.lit(float(total)))
    # Ranks grow with the value, so the median rank is that of the middle places.
    row = ranked.agg(*[F.min(F.when(F.col("__cw_upto") > f((total - 1) / 2), F.col(pct))).alias(n) for n, f in (("lo", math.floor), ("hi", math.ceil))]).first()
    median = _between(row["lo"], row["hi"], (total - 1) / 2 % 1) if row["lo"] is not None else 0.5
    # Rounded, so that ranks as far on either side of the median are ties.
    ranked = ranked.withColumn(off, F.round(F.abs(F.col(pct) - F.lit(median)), 9))
    far = running_totals(ranked.groupBy(off).agg(F.sum("__cw_n").alias("__cw_m")), [off], "__cw_m", "__cw_sum")
    far = far.select(off, ((F.col("__cw_sum") - (F.col("__cw_m") - 1) / F.lit(2.0)) / F.lit(float(total))).alias(again))
    return df.join(ranked.select(column, pct, off).join(far, off), column, "left")


def dense_codes(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Dense codes from 0 in the order of the distinct tuples."""
    distinct = df.select(*columns).distinct().withColumn("__cw_one", F.lit(1))
    codes = running_totals(distinct, columns, "__cw_one", "__cw_code").select(*columns, (F.col("__cw_code") - 1).cast("long").alias(out))
    return df.join(codes, columns, "left")


def moving_average(b: DataFrame, width: int | None, out: str, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """Ratio of sums k / n over the previous `width` batches (None: all), the current one excluded."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding if width is None else -width, -1)
    return b.withColumn(out, F.sum("k").over(w) / F.sum("n").over(w))


def first_time(df: DataFrame, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """Adds `first_year`, `t0` (row of the first year) and the offset and its square."""
    low = df.groupBy(*keys).agg(F.min(time).alias("first_year"))
    off = F.col(time) - F.col("first_year")
    return df.join(low, keys).withColumn("t0", off == 0).withColumn("year_off", off).withColumn("year_off2", off * off)


def transitions(b: DataFrame, value: str, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """Change against the previous batch: sign change, decrease, sign and size of the change of the
    absolute value, previous value. First batches: false, false, 0, 0, null. Interactions with one
    batch only are left out."""
    w = Window.partitionBy(*keys).orderBy(time)
    prev, size = F.lag(value).over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    x = b.withColumn("previous", prev).withColumn("__cw_n", size).where("__cw_n > 1").drop("__cw_n")
    change = F.round(F.abs(F.col(value)) - F.abs("previous"), 12)
    return x.withColumn("sign_change", F.coalesce(F.col(value) * F.col("previous") < 0, F.lit(False))) \
        .withColumn("decrease", F.coalesce(change < 0, F.lit(False))) \
        .withColumn("change_sign", F.coalesce(F.signum(change), F.lit(0.0))).withColumn("change", F.coalesce(change, F.lit(0.0)))


def dense_rank_desc(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Zero-based dense rank, largest first."""
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(value))) - 1)


def top_fraction(df: DataFrame, keys: list[str], value: str, fraction: float, tie: list[str]) -> DataFrame:
    """The ceil(fraction * rows) largest rows of each group."""
    w = Window.partitionBy(*keys)
    return df.withColumn("__cw_r", F.row_number().over(w.orderBy(F.desc(value), *tie))).withColumn("__cw_n", F.count(F.lit(1)).over(w)) \
        .where(F.col("__cw_r") <= F.ceil(F.lit(fraction) * F.col("__cw_n"))).drop("__cw_r", "__cw_n")


def chronological_flag(b: DataFrame, fraction: float, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """`accounted`: the batches up to the one at which the running size reaches the fraction of the
    interaction's claims; all batches of an interaction with one year."""
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn("accounted", (F.coalesce(upto, F.lit(0)) < F.lit(fraction) * F.sum("n").over(w)) | (F.count(F.lit(1)).over(w) == 1))


def one_batch_each(b: DataFrame, seed: int, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """One batch per interaction, chosen by hash: the same on any partitioning."""
    cols = b.columns
    from claimweave.operators.sampling import uniform

    w = Window.partitionBy(*keys).orderBy(uniform(seed, *keys, time), time)
    return b.withColumn("__cw_r", F.row_number().over(w)).where("__cw_r = 1").select(*cols)


def cumulative_by_year(df: DataFrame, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """For every year of the data: rows with an earlier or the same year per key, where there are any.
    Years are few; each key's batches are summed once and carried forward to the years without any."""
    b = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(time)
    run = b.withColumn("count", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__cw_next", F.lead(time).over(w))
    years = sorted(r[0] for r in df.select(time).distinct().collect() if r[0] is not None)
    every = F.array(*[F.lit(y).cast(df.schema[time].dataType) for y in years])
    return run.withColumn("look", F.explode(F.filter(every, lambda y: (y >= F.col(time)) & (F.col("__cw_next").isNull() | (y < F.col("__cw_next")))))).select(*keys, "look", "count")


def expanding_cuts(b: DataFrame, keys: list[str] = PAIR, time: str = "year") -> DataFrame:
    """For every later year of an interaction as cutoff: claims and positives before it."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("n_before", F.sum("n").over(w)).withColumn("k_before", F.sum("k").over(w)).where("n_before is not null")


def attach_moving_averages(df: DataFrame, correct: str, claim: str, truth: str, widths: list[int | None], first: float = 0.5) -> DataFrame:
    """Three averages of earlier years on each row, per width: of the correct claims of the interaction
    (`<correct>_ma_<w>`), and of the claims of all interactions by year (`<claim>_ma_<w>`, the first year of all
    having `first`). In the interaction's first year, where it has no own past, the first is replaced by how
    near the general average is to its truth: the average where both lie on one side of one half, else one less it."""
    name = lambda c, w: f"{c}_ma_{'all' if w is None else w}"
    own, every = batches(df, correct), batches(df, claim, keys=[])
    for w in widths:
        own, every = moving_average(own, w, name(correct, w)), moving_average(every, w, name(claim, w), keys=[])
    own = own.select(*PAIR, "year", *[name(correct, w) for w in widths])
    every = every.select("year", *[F.coalesce(name(claim, w), F.lit(first)).alias(name(claim, w)) for w in widths])
    # A row a year: broadcast, and one partition for its window.
    out = df.join(own, [*PAIR, "year"], "left").join(F.broadcast(every), "year", "left")
    for w in widths:
        c, t = F.col(name(claim, w)), F.col(truth)
        near = F.when(((t == 1) & (c >= 0.5)) | ((t == 0) & (c < 0.5)), c).otherwise(1 - c)
        out = out.withColumn(name(correct, w), F.coalesce(name(correct, w), F.when(t.isNotNull(), near)))
    return out
