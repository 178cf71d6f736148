"""Per-key results and joins in which a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch over all rows (`approx_top_k`), so a
key above `min_share` is never missed: the sketch's error is about 3.5 / `tracked` of all rows, far
below any share worth treating apart, and at most 1 / `min_share` keys can qualify, which bounds the
broadcast. Heavy keys then take the broadcast path, all others an ordinary shuffle, and the two
results are united. The sketch decides only the path; results are exact on both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "__cw_key"
HEAVY = "__cw_heavy"
SALT = "__cw_salt"
#: Items the sketch tracks: error about 3.5 / 16384 = 0.02 % of the rows.
TRACKED = 12_000


def key_text(columns: list[str]) -> Column:
    """The key as text, values joined by `|`; null when a value is null."""
    return F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit("|")] if i else []) + [F.col(c).cast("string")]])


def heavy_keys(df: DataFrame, keys: dict[str, Column], min_share: float = 0.01, tracked: int = TRACKED) -> tuple[dict[str, list[str]], int]:
    """For each named key expression, the values that may hold `min_share` of the rows or more; and
    the number of rows.

    One pass for all names. The lists hold every key above the share, possibly a few just below it,
    and never more than 2 / `min_share` entries. Null keys are no keys. An empty table gives empty lists.
    """
    top = min(tracked, int(2 / min_share) + 1)
    row = df.select(*[e.cast("string").alias(n) for n, e in keys.items()]).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.expr(f"approx_top_k(`{n}`, {top}, {max(tracked, top)})").alias(n) for n in keys],
    ).first()
    least = min_share * row["__n"] * 0.98
    return {n: [x["item"] for x in row[n] or [] if x["item"] is not None and x["count"] >= max(1, least)] for n in keys}, row["__n"]


def _stats(x: DataFrame, keys: list[str], heavy: DataFrame | None, salts: int) -> DataFrame:
    """Sums of `__cw_value` per key; the keys of `heavy` by broadcast and in `salts` parts, the others by a shuffle."""
    part = [F.count(F.lit(1)).alias("n"), F.count("__cw_value").alias("m"), F.sum("__cw_value").alias("s")]
    merge = [F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s")]
    if heavy is None:
        united = x.groupBy(*keys).agg(*part)
    else:
        tagged = x.join(F.broadcast(heavy.withColumn(HEAVY, F.lit(True))), keys, "left")
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
        hot = tagged.where(F.col(HEAVY)).withColumn(SALT, salt).groupBy(*keys, SALT).agg(*part).groupBy(*keys).agg(*merge)
        united = hot.unionByName(tagged.where(F.col(HEAVY).isNull()).groupBy(*keys).agg(*part))
    return united.select(
        *[c for c in keys if c != KEY], F.col(KEY).alias("key_text"), F.col("n").alias("n_rows"), F.col("m").alias("n_values"),
        F.when(F.col("m") > 0, F.col("s") / F.col("m")).alias("mean_value"),
    )


def balanced_stats(df: DataFrame, key: list[str], value: Column, heavy: list[str], salts: int = 64) -> DataFrame:
    """Rows and mean value of each key, as `key_text`, `n_rows`, `n_values`, `mean_value`.

    `heavy` (of `heavy_keys`) are matched by broadcast join and aggregated in `salts` parts a key
    before they are merged; the others take an ordinary shuffle. Rows whose key has a null are no
    key's rows. Null values count in `n_rows` only; a key without values has a null mean. Values are
    summed as doubles; for 0/1 flags every sum is exact, so both paths give the same figure.
    """
    x = df.select(key_text(key).alias(KEY), value.cast("double").alias("__cw_value")).where(F.col(KEY).isNotNull())
    return _stats(x, [KEY], df.sparkSession.createDataFrame([(v,) for v in heavy], f"{KEY} string") if heavy else None, salts)


def balanced_levels(df: DataFrame, levels: dict[str, list[str]], value: Column, min_share: float = 0.01, salts: int = 64) -> DataFrame:
    """`balanced_stats` at several key levels at once, with the level's name in `key_level` and the share
    of all rows of `df` (whether they have a key or not) in `row_share`. The table is read once to find
    the heavy keys of all levels, and once for each of the two paths. An empty table gives no rows."""
    names = {n: key_text(c) for n, c in levels.items()}
    heavy, rows = heavy_keys(df, names, min_share)
    keys = F.array(*[F.when(e.isNotNull(), F.struct(F.lit(n).alias("key_level"), e.alias(KEY))) for n, e in names.items()])
    x = df.select(value.cast("double").alias("__cw_value"), F.explode(F.array_compact(keys)).alias("__cw_k")).select("__cw_value", "__cw_k.*")
    hot = [(n, v) for n, vs in heavy.items() for v in vs]
    found = _stats(x, ["key_level", KEY], df.sparkSession.createDataFrame(hot, f"key_level string, {KEY} string") if hot else None, salts)
    return found.withColumn("row_share", F.col("n_rows") / F.lit(rows).cast("double"))


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", min_share: float = 0.01, merge: bool = False) -> DataFrame:
    """Equi-join of a skewed `left` with a `right` that has one row a key at most.

    The rows of `right` for the heavy keys of `left` (2 / `min_share` at most) are broadcast to
    theirs; the remaining rows of both sides take an ordinary join, with `merge` one that shuffles
    however small `right` is now. `how` is `left` or `inner`. A null key matches nothing, and
    null-keyed rows take part in no join: they are left out or, in a left join, added as they are.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how}")
    values = heavy_keys(left, {"k": F.col(on)}, min_share)[0]["k"]
    other = right.hint("merge") if merge else right
    known, kind = left.where(F.col(on).isNotNull()), left.schema[on].dataType
    if how == "left":
        absent = left.where(F.col(on).isNull()).select(on, *[c for c in left.columns if c != on], *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != on])
    if not values:
        out = known.join(other, on, how)
        return out.unionByName(absent) if how == "left" else out
    marks = left.sparkSession.createDataFrame([(v,) for v in values], f"{KEY} string").select(F.col(KEY).cast(kind).alias(on))
    is_heavy = F.col(on).isin([v for v in values]) if kind.typeName() == "string" else F.col(on).cast("string").isin(values)
    heavy = known.where(is_heavy).join(F.broadcast(right.join(F.broadcast(marks), on, "left_semi")), on, how)
    out = heavy.unionByName(known.where(~is_heavy).join(other, on, how))
    return out.unionByName(absent) if how == "left" else out


def salted_join(left: DataFrame, right: DataFrame, on: str, heavy: list[str], salts: int = 16) -> DataFrame:
    """Left join of a `left` whose keys in `heavy` (of `heavy_keys`) hold many rows each with a `right` that
    has one row a key at most: those rows of `right` are repeated `salts` times and the heavy rows of
    `left` meet them in as many tasks. Null keys match nothing and are spread likewise. One join, no
    union, so that many can follow one another without the plan growing by branches."""
    key = F.col(on).cast("string")
    hot = key.isin(heavy) if heavy else F.lit(False)
    salt = F.when(F.col(on).isNull() | hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return left.withColumn(SALT, salt).join(right.withColumn(SALT, every), [on, SALT], "left").drop(SALT)
