from pyspark.sql import functions as F

from claimweave.functions.clean import measured
from claimweave.operators.impute import Fill, fill_from_similar, k_prototypes, most_frequent
from claimweave.plans.record_queries import fill_claims


def run(df, k=2):
    keys = {"paper": F.col("paper"), "journal": F.col("journal")}
    return fill_from_similar(df, [Fill("x", measured("x", 0, 40), ("paper", "journal")), Fill("kind", F.col("kind"), ("journal",), "categorical")], keys,
                             {"x": measured("x", 0, 40), "year": F.col("year")}, {"journal": F.col("journal")}, k=k)


SCHEMA = "id long, paper long, journal string, year int, x double, kind string, x_filled string"


def frame(spark):
    rows = [(i, i // 2, "A" if i % 4 < 2 else "B", 2000 + i % 5, 1.0 + i % 4 // 2 * 10, "u" if i % 4 < 2 else "v", "clash") for i in range(80)]
    rows += [(100, 0, "A", 2001, None, None, "c"), (101, 999, "B", 2001, float("nan"), "v", "c"), (102, None, None, None, -5.0, None, "c"), (102, None, None, None, -5.0, None, "c"), (103, 500, "A", None, 99.0, "u", "c")]
    return spark.createDataFrame(rows, SCHEMA)


def test_values_come_from_the_narrowest_group_and_are_marked(spark):
    out = run(frame(spark))
    got = {r["id"]: r for r in out.collect()}
    assert out.count() == 85 and [c for c in out.columns if c == "x_filled"] == ["x_filled"]
    assert got[100]["x_filled"] == 1.0 and got[100]["x_was_missing"] and got[100]["x_method"].startswith("paper")
    assert got[100]["kind_filled"] == "u" and got[100]["kind_method"].startswith("journal")
    assert got[101]["x_filled"] == 11.0 and got[101]["x_method"].startswith("journal") and not got[101]["kind_was_missing"]
    assert got[103]["x_filled"] == 1.0
    assert got[102]["x_filled"] in (1.0, 11.0) and got[102]["x_method"] in ("cluster", "overall")
    assert got[5]["x_filled"] == got[5]["x"] and got[5]["x_method"] == "observed"


def test_empty_and_all_missing(spark):
    assert run(frame(spark).limit(0)).count() == 0
    gone = run(frame(spark).withColumn("x", F.lit(None).cast("double")).withColumn("kind", F.lit(None).cast("string")))
    assert gone.where("x_method = 'none' and x_filled is null and x_was_missing").count() == 85


def test_prototypes_and_mode(spark):
    df = spark.createDataFrame([(float(i % 2 * 100), "p" if i % 2 else "q") for i in range(40)] + [(None, None)], "x double, c string")
    p = k_prototypes(df, ["x"], ["c"], k=2)
    assert sorted(m[0] for m in p.means) == [0.0, 100.0] and {m[0] for m in p.modes} == {"p", "q"}
    assert most_frequent(spark.createDataFrame([(2.0,), (1.0,), (1.0,), (2.0,), (None,)], "v double"), F.col("v")) == 1.0
    assert most_frequent(df.limit(0), F.col("x")) is None


def test_held_out_values_are_recovered(spark):
    claims = spark.read.parquet("/root/testdata/sf0.01/claims.parquet")
    held = F.pmod(F.xxhash64("pmid"), F.lit(10)) == 0
    out = fill_claims(claims.withColumn("truth", F.col("ai")).withColumn("ai", F.when(~held, F.col("ai")))).where(held & F.col("truth").between(0, 40) & (F.col("truth") != 0.7712))
    error, spread = out.agg(F.avg(F.abs(F.col("ai_filled") - F.col("truth"))), F.stddev("truth")).first()
    assert error < 0.25 * spread


def test_held_out_ratings_and_categories_are_recovered(spark):
    claims = spark.read.parquet("/root/testdata/sf0.01/claims.parquet")
    held = F.pmod(F.xxhash64("pmid"), F.lit(10)) == 0
    out = fill_claims(claims.withColumn("truth", F.col("ar")).withColumn("ar", F.when(~held, F.col("ar")))).where(held & F.col("truth").between(0, 10))
    error, spread = out.agg(F.avg(F.abs(F.col("ar_filled") - F.col("truth"))), F.stddev("truth")).first()
    assert error < 0.6 * spread
    # A categorical field: the journal of a claim from other claims of the paper, else of the pair.
    some = F.pmod(F.xxhash64("claim_id"), F.lit(10)) == 0
    fill = Fill("journal", F.when(~some, F.col("journal")), ("paper", "pair"), "categorical")
    x = fill_from_similar(claims, [fill], {"paper": F.col("pmid"), "pair": F.concat_ws("|", "up", "dn")}, {"year": F.col("year")}, {"origin": F.col("origin")})
    hit = F.avg((F.col("journal_filled") == F.col("journal")).cast("int"))
    known = x.where(some & F.col("journal").isNotNull())
    assert known.where("journal_method like 'paper%'").agg(hit).first()[0] > 0.9 and x.where(~some & (F.col("journal_filled") != F.col("journal"))).count() == 0


def test_a_prototype_that_knows_little_draws_no_rows(spark):
    from claimweave.operators.impute import CLUSTER, Prototypes, _assign
    p = Prototypes(["x", "y"], ["c"], [[None, None], [0.0, 0.0]], [["a"], ["a"]], [1.0, 1.0])
    df = spark.createDataFrame([(5.0, 5.0, "a"), (0.1, 0.1, "a"), (None, None, "a")], "x double, y double, c string")
    got = [r[CLUSTER] for r in _assign(df, p, 1.0).collect()]
    assert got == [0, 1, 0]
    rows = [(None, None, "a")] * 50 + [(float(i % 2 * 9), float(i % 2 * 9), "a") for i in range(40)]
    q = k_prototypes(spark.createDataFrame(rows, "x double, y double, c string"), ["x", "y"], ["c"], k=2)
    assert sorted(m[0] for m in q.means) == [0.0, 9.0]


def test_hot_group_and_null_keys_keep_all_rows(spark):
    rows = [(i, 1 if i % 2 else (None if i % 3 else i), "A", 2000, None if i % 5 == 0 else 1.0, "u" if i % 7 else None, "c") for i in range(3000)]
    out = run(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 3000 and out.where("x_filled is null or kind_filled is null").count() == 0
    assert out.where("x_was_missing").count() == 600
