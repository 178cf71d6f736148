"""File sources and sinks: CSV, keyed parquet, tagged text exports, gene dictionaries, matrices."""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.clean import finite

# The fields of a tagged bibliographic export and the columns they become.
TAGS = {"PM": "pmid", "TC": "cite_count", "UT": "wos_id", "AU": "authors", "C1": "affs"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV or TSV, plain or gzip, with a declared schema (no inference pass)."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").option("sep", sep).csv(path)


def write_keyed(df: DataFrame, path: str, keys: list[str]) -> None:
    """A partition folder per key value, as a store with one key per year has. Rows of a key are
    brought together first, so that no task writes a file in every folder."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("compression", "zstd").partitionBy(*keys).parquet(path)


def read_keyed(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """The keyed store, with partitions pruned to the wanted values."""
    df = spark.read.parquet(path)
    for k, v in wanted.items():
        df = df.where(F.col(k).isin(v) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df


def read_tagged(spark: SparkSession, folder: str, pattern: str = "sav*txt") -> DataFrame:
    """Bibliographic records of tagged text files: `XX value` lines, continued by indented lines, up
    to a line `ER`. Lists (authors, affiliations) are joined by `|`. Records are split by the reader,
    so a file is never held whole."""
    lines = spark.read.option("lineSep", "\nER").option("pathGlobFilter", pattern).text(folder)
    record = F.regexp_replace("value", r"\r", "")
    def field(tag: str) -> F.Column:
        body = F.regexp_extract(F.concat(F.lit("\n"), record), rf"\n{tag} ((?:[^\n]*)(?:\n   [^\n]*)*)", 1)
        return F.when(body != "", F.regexp_replace(F.trim(body), r"\n +", "|"))
    out = lines.select(*[field(t).alias(c) for t, c in TAGS.items()])
    return out.where("wos_id is not null or pmid is not null").withColumn("pmid", F.expr("try_cast(pmid as int)"))


def read_gene_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`hgnc_id`, `entrez_id`, `symbol` of a JSON export with the records under response.docs."""
    doc = T.StructType([T.StructField("hgnc_id", T.StringType()), T.StructField("entrez_id", T.StringType()), T.StructField("symbol", T.StringType())])
    schema = T.StructType([T.StructField("response", T.StructType([T.StructField("docs", T.ArrayType(doc))]))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("response.docs").alias("d")).select("d.hgnc_id", F.expr("try_cast(d.entrez_id as bigint)").alias("entrez_id"), "d.symbol")


def read_reports(spark: SparkSession, folder: str, contains: str, excludes: tuple[str, ...] = (), schema: T.StructType | None = None) -> DataFrame:
    """JSON report lines of the files whose name holds a parameter string and none of the exclusions."""
    df = (spark.read.schema(schema) if schema else spark.read).json(folder).withColumn("file", F.input_file_name())
    df = df.where(F.col("file").contains(contains))
    for x in excludes:
        df = df.where(~F.col("file").contains(x))
    return df


def matrix_part(long: DataFrame, row: str, column: str, rows: list | None = None, columns: list | None = None) -> DataFrame:
    """Cells of a long matrix for the given rows and columns; the lists are pushed to the scan."""
    if rows is not None:
        long = long.where(F.col(row).isin(rows))
    if columns is not None:
        long = long.where(F.col(column).isin(columns))
    return long


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_report_frame(spark: SparkSession, folder: str, template: str, schema: T.StructType, **parameters) -> DataFrame:
    """The CSV whose name is the template filled with the parameters, which become columns."""
    df = read_csv(spark, f"{folder}/{template.format(**parameters)}", schema)
    return df.withColumns({n: F.lit(v) for n, v in parameters.items() if n not in df.columns})


def read_grid(spark: SparkSession, folder: str, template: str, grid: dict[str, list], schema: T.StructType) -> DataFrame:
    """The report frames of every combination of the parameters, as one table; files must be there."""
    cases = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return reduce(DataFrame.unionByName, [read_report_frame(spark, folder, template, schema, **c) for c in cases])


def read_config(path: str) -> dict | list[str]:
    """A JSON configuration, or a text file as its lines without blanks: small files, read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return json.loads(text) if path.endswith(".json") else [line.strip() for line in text.splitlines() if line.strip()]


def read_id_table(spark: SparkSession, path: str, types: list[str], whole: tuple[str, ...] = (), lower: bool = False) -> DataFrame:
    """One row per record of a JSON export (under response.docs) with its id of each type and its place
    `at`; `whole` types become numbers, null where they are none, texts are folded with `lower`."""
    doc = T.StructType([T.StructField(t, T.StringType()) for t in types])
    schema = T.StructType([T.StructField("response", T.StructType([T.StructField("docs", T.ArrayType(doc))]))])
    x = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("response.docs").alias("at", "d"))
    as_type = lambda t: F.expr(f"try_cast(d.`{t}` as bigint)") if t in whole else (F.lower(f"d.{t}") if lower else F.col(f"d.{t}"))
    return x.select("at", *[as_type(t).alias(t) for t in types])


def id_pairs(ids: DataFrame, source: str, target: str) -> DataFrame:
    """One target per source id, for any two types of an id table; of several the last record's."""
    x = ids.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    return x.groupBy(source).agg(F.max_by(target, "at").alias(target))


def write_shards(df: DataFrame, path: str, shards: int, keys: list[str]) -> None:
    """A folder per shard, rows dealt by the hash of the keys."""
    df.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")).repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines; small, so one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def chosen_parameters(report: Column, prefix: str, without: str | None = None) -> Column:
    """The entries of a report's map whose name begins with the prefix (and does not hold `without`)."""
    keep = lambda k, _: F.startswith(k, F.lit(prefix)) & (~F.contains(k, F.lit(without)) if without else F.lit(True))
    return F.map_filter(report, keep)


def experiment_filter(types: list[str], hours: float, doses: list[str], touchstone: bool = True) -> Column:
    """The conditions on an experiment: kind of perturbation, least hours, one of the doses, a touchstone or not."""
    cond = F.col("pert_type").isin(types) & (F.col("hours") >= hours) & F.col("pert_idose").isin(doses)
    return cond & (F.col("is_touchstone") == 1) if touchstone else cond
