import pytest
from pyspark.sql import functions as F

from claimweave.operators import skew as S


@pytest.fixture(scope="module")
def rows(spark):
    hot = [(7, 1.0 if i % 3 else 0.0, "x") for i in range(4000)]
    cold = [(100 + i % 900, float(i % 2), "y") for i in range(2000)]
    return spark.createDataFrame(hot + cold + [(None, 1.0, "z")] * 5 + [(7, None, "x")] * 3, "k long, v double, key_text string")


def test_heavy_keys_are_never_missed(spark, rows):
    heavy, n = S.heavy_keys(rows, {"k": F.col("k")}, 0.02)
    assert heavy == {"k": ["7"]} and n == 6008
    assert S.heavy_keys(rows.limit(0), {"k": F.col("k")}, 0.02) == ({"k": []}, 0)


def test_balanced_stats_equal_a_plain_group_by(rows):
    want = {(str(r["k"]), r["n"], r["m"], r["a"]) for r in rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("m"), F.avg("v").alias("a")).collect()}
    for heavy in (["7"], [], ["7", "100", "not there"]):
        got = {tuple(r) for r in S.balanced_stats(rows, ["k"], F.col("v"), heavy).collect()}
        assert got == want


def test_levels_and_empty(spark, rows):
    out = S.balanced_levels(rows, {"k": ["k"], "kk": ["k", "key_text"]}, F.col("v"))
    assert {r["key_text"] for r in out.where("row_share >= 0.5").collect()} == {"7", "7|x"}
    assert S.balanced_levels(rows.limit(0), {"k": ["k"]}, F.col("v")).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_equals_join(spark, rows, how):
    right = spark.createDataFrame([(7, "hot"), (101, "cold"), (5000, "unused"), (None, "null")], "k long, name string")
    got, want = S.skew_join(rows, right, "k", how), rows.join(right, "k", how)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    assert S.skew_join(rows.limit(0), right, "k", how).count() == 0


def test_salted_join_equals_join_and_splits_the_hot_key(spark, rows):
    right = spark.createDataFrame([(7, "hot"), (101, "cold"), (5000, "unused")], "k long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, want = S.salted_join(rows, right, "k", ["7"]), rows.join(right, "k", "left")
        parts = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
        assert parts[-1] < 3 * parts[len(parts) // 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert S.salted_join(rows, right, "k", []).count() == want.count()
