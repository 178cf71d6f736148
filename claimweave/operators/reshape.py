"""Pivot, unpivot, adjacency, id mappings and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_cases(df: DataFrame, keys: list[str], case: str, values: list[str], agg: Column, prefix: str) -> DataFrame:
    """One row per key with a column per case; the cases are given, so no pass is spent to find them."""
    out = df.groupBy(*keys).pivot(case, values).agg(agg)
    return out.withColumnsRenamed({v: prefix + v for v in values})


def long_edges(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str, above: float) -> DataFrame:
    """Matrix columns to rows, keeping magnitudes above a threshold."""
    return wide.unpivot(keys, columns, name, value).where(F.abs(value) > above)


def adjacency(edges: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """Distinct neighbours per node, without loops and nulls."""
    e = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target))).select(source, target).distinct()
    return e.groupBy(source).agg(F.array_sort(F.collect_list(target)).alias(out))


def citation_units(publications: DataFrame, citations: DataFrame) -> DataFrame:
    """Papers with the papers they cite (`past`) and that cite them (`future`), as pmids."""
    p = publications.where("pmid is not null and wos_id is not null").select("pmid", "wos_id").distinct()
    c = citations.where("wos_id is not null and uid is not null and wos_id <> uid").select("wos_id", "uid").distinct()
    pairs = c.join(p, "wos_id").join(p.select(F.col("pmid").alias("cited"), F.col("wos_id").alias("uid")), "uid")
    kinds = F.array(F.struct(F.lit("past").alias("kind"), F.col("pmid"), F.col("cited").alias("unit")), F.struct(F.lit("future").alias("kind"), F.col("cited").alias("pmid"), F.col("pmid").alias("unit")))
    return pairs.select(F.explode(kinds).alias("x")).select("x.*")


def id_mapping(ids: DataFrame, source: str, target: str, case: str | None = None) -> DataFrame:
    """One target per source id (the largest where there are several); `case` folds text ids."""
    key = {"upper": F.upper, "lower": F.lower}.get(case, lambda c: c)(F.col(source))
    x = ids.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    return x.groupBy(key.alias(source)).agg(F.max(target).alias(target))


def look_up(df: DataFrame, mapping: DataFrame, key: str, source: str, target: str) -> DataFrame:
    return df.join(mapping.select(F.col(source).alias(key), target), key, "left")


def add_missing(mapping: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Mapping with the entries of `extra` whose key is not in it yet."""
    return mapping.unionByName(extra.join(mapping, key, "left_anti"))


def unwrap_bytes(c: Column) -> Column:
    """The text in `b'...'` (or the text itself)."""
    return F.regexp_replace(c, "^b'(.*)'$", "$1")


def numbered_parameters(params: Column) -> Column:
    """A map of `name_index` to value as an array of maps, one per index, in index order."""
    entries = F.map_entries(params)
    index = F.array_sort(F.array_distinct(F.transform(entries, lambda e: F.regexp_extract(e["key"], r"_(\d+)$", 1).cast("int"))))
    part = lambda i: F.transform(F.filter(entries, lambda e: F.regexp_extract(e["key"], r"_(\d+)$", 1).cast("int") == i), lambda e: F.struct(F.regexp_replace(e["key"], r"_\d+$", "").alias("k"), e["value"].alias("v")))
    return F.transform(index, lambda i: F.map_from_entries(part(i)))


def order_modes(modes: Column, by: str) -> Column:
    """Modes sorted by one of their parameters."""
    return F.array_sort(modes, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def relative_difference(a: Column, b: Column) -> Column:
    """abs(a - b) / abs(a) per key of two maps; null where a key is missing or a is 0."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x != 0, F.abs(x - y) / F.abs(x)))


def wrap_bytes(c: Column) -> Column:
    """The text as `b'...'`."""
    return F.concat(F.lit("b'"), c.cast("string"), F.lit("'"))


def map_rows(df: DataFrame, keys: list[str], column: str, name: str = "key", value: str = "value") -> DataFrame:
    """A map of arrays as rows: one per entry and element, with the entry's key."""
    x = df.select(*keys, F.explode(column).alias(name, "__cw_v"))
    return x.select(*keys, name, F.explode("__cw_v").alias(value))


def split_by_number(params: Column) -> tuple[Column, Column]:
    """(entries whose name ends in `_number`, the other entries) of a map."""
    numbered = lambda k, _: F.rlike(k, F.lit(r"_\d+$"))
    return F.map_filter(params, numbered), F.map_filter(params, lambda k, v: ~numbered(k, v))


def sorted_values(params: Column) -> Column:
    """The values of a map in the order of its keys."""
    return F.transform(F.array_sort(F.map_entries(params)), lambda e: e["value"])


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps as one; `b` wins where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def metric_rows(df: DataFrame, keys: list[str], metrics: Column) -> DataFrame:
    """A map of metrics as rows (`metric`, `value`)."""
    return df.select(*keys, F.explode(metrics).alias("metric", "value"))


def negation_codes(df: DataFrame, keys: list[str], negated: str) -> DataFrame:
    """Rows that say the same of a key tuple counted once, with `code`, a dense number of the tuple from 0,
    the number of rows `n` and how many of them are negated."""
    from claimweave.operators.windows import dense_codes

    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(negated).cast("long").alias("negated"))
    return dense_codes(per, keys, "code")


def gene_view(mapping: DataFrame, source: str, target: str, wanted: DataFrame | None = None) -> DataFrame:
    """Entries of a mapping: all, or those of the wanted ids, in the order of ids."""
    x = mapping if wanted is None else mapping.join(wanted.select(source).distinct(), source, "left_semi")
    return x.select(source, target).orderBy(source)


def update_mapping(mapping: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """The mapping with the entries of `new`, which win."""
    return mapping.join(new, source, "left_anti").unionByName(new)
