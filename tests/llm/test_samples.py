import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import mixing as M
from claimweave.llm import target_sample as T

def cell():
    return {"pos": F.col("pos"), "dist": F.col("dist")}

TARGETS = "set_id int, pos int, dist int, share double, min_rows int, draw_frac double"


def claims(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("claim_id"), F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 3 > 0).cast("int")).alias("pos"),
                                 (F.col("id") % 7 % 4).cast("int").alias("dist"), F.lit("clash").alias("set_id"))


def test_sample_has_shares_floors_and_report(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_RANKED", 20)
    df = claims(spark)
    t = spark.createDataFrame([(1, 0, 0, 1.0, 3, 0.1), (1, 1, 0, 2.0, 3, 0.1), (1, 1, 3, 1.0, 3, 0.1), (2, 0, 1, 1.0, 2, 0.2), (2, 0, 9, 1.0, 2, 0.2)], TARGETS)
    sample, report = T.sample_to_targets(df, t, cell(), ["claim_id"])
    rows = {(r["set_id"], r["pos"], r["dist"]): r for r in report.collect()}
    total = df.where("pos is not null").count()
    drawn = {(r["set_id"], r["pos"], r["dist"]): r["count"] for r in sample.groupBy("set_id", "pos", "dist").count().collect()}
    assert {k: r["drawn"] for k, r in rows.items() if r["drawn"]} == drawn
    assert abs(drawn[1, 1, 0] / (0.1 * total) - 0.5) < 0.01 and not rows[1, 1, 0]["cannot_be_met"]
    assert rows[2, 0, 9]["cannot_be_met"] and rows[2, 0, 9]["drawn"] == 0
    assert sample.where("set_id = 1").select("claim_id").distinct().count() == sample.where("set_id = 1").count()
    again, _ = T.sample_to_targets(df.repartition(13), t, cell(), ["claim_id"])
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.collect()))


def test_sample_of_nothing_and_null_ids(spark):
    t = spark.createDataFrame([(1, 0, 0, 1.0, 3, 0.1)], TARGETS)
    sample, report = T.sample_to_targets(claims(spark).limit(0), t, cell(), ["claim_id"])
    assert sample.count() == 0 and report.first()["cannot_be_met"]
    df = spark.createDataFrame([(None, 0, 0)] * 30, "claim_id long, pos int, dist int")
    assert T.sample_to_targets(df, t, cell(), ["claim_id"])[0].count() == 3


def test_swap_repair_ends_in_the_best_counts():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = int(rng.integers(2, 5))
        avail, target = rng.integers(0, 12, s), rng.integers(0, 12, s).astype(float)
        floors, size = np.minimum(rng.integers(0, 3, s), avail), int(min(avail.sum(), 10))
        size = max(size, int(floors.sum()))
        got = T.swap_repair(T.random_start(avail, floors, size, rng), avail, np.eye(s), target, floors)
        assert got.sum() == size and (got >= floors).all() and (got <= avail).all()
        grids = np.stack(np.meshgrid(*[np.arange(f, a + 1) for f, a in zip(floors, avail)]), -1).reshape(-1, s)
        best = min(((g - target) ** 2).sum() for g in grids if g.sum() == size)
        assert ((got - target) ** 2).sum() == best


def docs(spark):
    rows = [(i, f"words of document {i} in a row", ["Alpha ", "beta", "gamma"][i % 3] if i % 10 else None) for i in range(600)] + [(1000, "", "alpha"), (1001, None, "beta")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_reaches_shares_within_repeats(spark):
    t = spark.createDataFrame([(1, "ALPHA", 3.0, 4, 0.9), (1, "beta", 1.0, 4, 0.9), (2, "gamma", 1.0, 1, 2.0), (2, "absent", 1.0, 5, 2.0), (3, "beta", 0.0, 2, 1.0)],
                              "mix_id int, source string, weight double, max_repeats int, mix_frac double")
    sized = M.sized_documents(docs(spark), ["doc_id"])
    rates = M.mix_rates(sized, t)
    mix, report = M.draw_mix(sized, rates, ["doc_id"]), {(r["mix_id"], r["source"]): r for r in M.mix_report(sized, rates, ["doc_id"]).collect()}
    assert abs(report[1, "alpha"]["drawn_share"] - 0.75) < 0.03
    assert report[2, "gamma"]["falls_short"] and report[2, "absent"]["falls_short"] and not report[1, "alpha"]["falls_short"]
    assert mix.agg(F.max("copy_no")).first()[0] <= 4 and mix.where("mix_id = 2").agg(F.max("copy_no")).first()[0] == 1
    assert report[3, "beta"]["drawn_tokens"] == 0
    assert sized.where("doc_id in (1000, 1001)").agg(F.sum("n_tokens")).first()[0] == 0


def test_mix_of_nothing(spark):
    t = spark.createDataFrame([(1, "a", 1.0, 2, 0.5)], "mix_id int, source string, weight double, max_repeats int, mix_frac double")
    sized = M.sized_documents(docs(spark).limit(0), ["doc_id"])
    rates = M.mix_rates(sized, t)
    assert rates.first()["rate"] == 0 and M.draw_mix(sized, rates, ["doc_id"]).count() == 0
    assert M.mix_report(sized, rates, ["doc_id"]).count() == 1


def test_exchange_over_overlapping_categories_and_many_signatures():
    rng = np.random.default_rng(5)
    member = (rng.random((300, 12)) < 0.3).astype(float)
    member[member.sum(1) == 0, 0] = 1
    avail = rng.integers(1, 30, 300)
    start = T.random_start(avail, np.zeros(300, int), 1000, rng)
    target = rng.dirichlet(np.ones(12)) * 1000
    got = T.swap_repair(start, avail, member, target, np.zeros(12))
    loss = lambda c: ((c @ member - target) ** 2).sum()
    assert got.sum() == 1000 and (got >= 0).all() and (got <= avail).all() and loss(got) < loss(start)
    best = loss(got)
    for a in range(0, 300, 7):
        for b in range(300):
            if a != b and got[a] > 0 and got[b] < avail[b]:
                x = got.copy()
                x[a], x[b] = x[a] - 1, x[b] + 1
                assert loss(x) >= best - 1e-6


def test_text_sets_and_hot_sources_are_stable(spark):
    t = spark.createDataFrame([("first", 0, 0, 1.0, 3, 0.1), ("second", 1, 1, 1.0, 3, 0.1)], "set_id string, pos int, dist int, share double, min_rows int, draw_frac double")
    sample, _ = T.sample_to_targets(claims(spark), t, cell(), ["claim_id"])
    assert {r["set_id"] for r in sample.select("set_id").distinct().collect()} == {"first", "second"}
    rates = spark.createDataFrame([(m, "hot" if s else "cold", 1.5) for m in (1, 2) for s in (0, 1)], "mix_id int, source string, rate double")
    sized = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("source"), F.lit(1).alias("n_tokens"))
    got = {(r["mix_id"], r["source"]): r["n"] for r in M.copies(sized, rates, ["doc_id"]).groupBy("mix_id", "source").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "hot"): 2700, (2, "hot"): 2700, (1, "cold"): 300, (2, "cold"): 300}
