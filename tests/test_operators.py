"""Micro frames with hand-computed results, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions import math as X
from claimweave.operators import bayes, community, features, metrics, reshape, sampling, text, windows
from claimweave.operators import relational as R


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.fixture(scope="module")
def batches(spark):
    return spark.createDataFrame([(1, 2, 2000, 0, 4), (1, 2, 2001, 1, 4), (1, 2, 2005, 4, 4), (3, 4, 2001, 1, 1)], "up long, dn long, year int, k long, n long")


def test_moving_average_of_earlier_batches(batches):
    out = windows.moving_average(windows.moving_average(batches, 2, "two"), None, "all").orderBy("up", "year")
    assert values(out, "two", "all") == [(None, None), (0.0, 0.0), (0.125, 0.125), (None, None)]
    assert windows.moving_average(batches.limit(0), 2, "m").count() == 0


def test_percent_rank_shares_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "i int, v double")
    assert values(windows.percent_ranks(df, "v", "p").orderBy("i"), "p") == [(0.875,), (0.25,), (0.875,), (None,), (0.5,)]
    assert windows.percent_ranks(df.limit(0), "v", "p").count() == 0


def test_running_totals_over_many_partitions(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("o"), F.lit(1).alias("v"))
    assert windows.running_totals(df.repartition(17), ["o"], "v", "s").where("s <> o + 1").count() == 0


def test_dense_rank_of_docstring(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), ("d", 3)], "k string, v int").withColumn("g", F.lit(0))
    assert dict(values(windows.dense_rank_desc(df, ["g"], "v", "r"), "k", "r")) == {"a": 0, "b": 1, "d": 1, "c": 2}


def test_windows_by_value_and_by_rank(spark):
    df = spark.createDataFrame([(1, 2000), (1, 2001), (1, 2005)], "g int, year int")
    assert sorted(values(R.value_windows(df, ["g"], "year", 3), "look", "year")) == [(2000, 2000), (2001, 2000), (2001, 2001), (2005, 2005)]
    assert sorted(values(R.rank_windows(df, ["g"], "year", 2), "look", "year")) == [(2000, 2000), (2001, 2000), (2001, 2001), (2005, 2001), (2005, 2005)]


def test_conflicts_leave_both_sources(spark):
    a = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "k int, pos int")
    b = spark.createDataFrame([(1, 1), (2, 1), (4, 0)], "k int, pos int")
    assert sorted(values(R.conflict_union(a, b, ["k"], "pos", ("a", "b")), "k", "pos", "origin")) == [(1, 1, "a"), (3, 1, "a"), (4, 0, "b")]


def test_asof_is_strictly_earlier(spark):
    left = spark.createDataFrame([(1, 2000), (1, 2003), (1, 2003), (2, 2000)], "g int, year int")
    right = spark.createDataFrame([(1, 2000, 0.5), (1, 2002, 0.7), (1, 2003, 0.9)], "g int, year int, v double")
    assert sorted(values(R.asof_previous(left, right, ["g"], "year", "v", "p"), "g", "year", "p"), key=str) == [(1, 2000, None), (1, 2003, 0.7), (1, 2003, 0.7), (2, 2000, None)]


def test_first_by_mode_and_bins(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 4.0), (2, 4.0), (3, None)], "k int, v double")
    assert sorted(values(R.first_by(df, ["k"], ["v"]), "k", "v"), key=str) == [(1, 4.0), (2, 4.0), (3, None)]
    assert values(R.mode_excluded(df, "v"), "v") == [(5.0,)]
    assert R.mode_excluded(df.limit(0), "v").count() == 0
    assert sorted(values(R.in_bins(df, "v", [0.0, 4.5, 9.0]), "bin")) == [(0,), (0,), (1,)]


def test_quantise_distance_scale(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (1.0, 1), (1.7, 0)], "q double, pos int")
    x = df.withColumn("b", features.quantize(F.col("q"), [-1e-8, 0.3, 0.6, 1.0]))
    assert [r[0] for r in values(x, "b")] == [0.0, 1.0, 2.0, 1.7]
    y = features.level_distance(x.where("q <= 1"), "pos", "b", "d")
    assert [r[0] for r in values(y, "d")] == [0.0, 1.0, 0.0]
    assert values(features.level_distance(x.limit(1), "pos", "b", "d"), "d") == [(None,)]
    assert [r[0] for r in values(features.min_max(df.limit(1), ["q"]), "q")] == [0.0]


def test_normal_distribution(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.96,), (3.0,)], "z double")
    for z, p, q in values(df.withColumn("p", X.norm_cdf(F.col("z"))).withColumn("q", X.norm_ppf(X.norm_cdf(F.col("z")))), "z", "p", "q"):
        assert abs(p - {0.0: 0.5, 1.0: 0.841344746, -1.96: 0.0249979, 3.0: 0.9986501}[z]) < 1e-6 and abs(q - z) < 1e-9


def test_stick_breaking_round_trip(spark):
    df = spark.createDataFrame([(0.2, 0.3, 0.5)], "a double, b double, c double")
    back = X.stick_backward(X.stick_forward([F.col("a"), F.col("b"), F.col("c")]))
    assert values(df.select(*[F.round(v, 9).alias(n) for v, n in zip(back, "abc")]), "a", "b", "c") == [(0.2, 0.3, 0.5)]


def test_auc_trapezoid_interpolation(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (None, 1)], "s double, y int")
    assert values(metrics.auc(df, "s", "y"), "auc") == [(0.75,)]
    assert values(metrics.auc(df.where("y = 0"), "s", "y"), "auc") == [(None,)]
    pts = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 1.0), (0, 2.0, 5.0), (0, 2.0, 1.0)], "g int, x double, y double")
    assert values(metrics.trapezoid(pts, ["g"], "x", "y"), "area") == [(3.5,)]
    assert sorted(values(metrics.interpolate(pts, ["g"], "x", "y", [-1.0, 0.5, 3.0]), "grid", "value")) == [(-1.0, -1.0), (0.5, 0.5), (3.0, 9.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("[x] Univ. & Lab of Örebro, Dept|Univ. & lab of örebro |", "kitten", "sitting"), (None, "", "a")], "affs string, a string, b string")
    assert values(df.select(text.affiliation_units("affs").alias("u")), "u")[0][0] == ["univ. lab of örebro"]
    assert values(df.select(text.clean_tokens(F.lit("The Öl-Lab of the lab")).alias("t")), "t")[0][0] == ["ol", "lab"]
    assert values(df.select(text.edit_ratio(F.col("a"), F.col("b")).alias("r"), text.edit_root(F.col("a"), F.col("b")).alias("q")), "r", "q") == [(0.5, 2 / 6), (None, None)]
    w = F.split(F.lit("gene lab"), " ")
    assert values(df.limit(1).select(text.word_distance(w, w).alias("d")), "d") == [(0.0,)]


def test_communities_of_two_cliques(spark):
    e = [(0, f"p{a}", f"u{a // 4}") for a in range(8)]
    labels = community.label_propagation(spark.createDataFrame(e, "g int, p string, u string"), ["g"], "p", "u", bipartite=True)
    t = community.community_table(labels, ["g"]).where("node like 'p%'")
    assert t.select("label").distinct().count() == 2 and t.select("n_comms").distinct().collect()[0][0] == 2


def test_growth_orders(batches):
    for direction, want in (("min", {(3, 4, 2001), (1, 2, 2000)}), ("max", {(1, 2, 2000), (1, 2, 2001)})):
        out = sampling.grow_histories(batches, ["up", "dn"], 5, direction)
        assert {(r["up"], r["dn"], r["year"]) for r in out.where("revealed").collect()} == want
    random = sampling.grow_histories(batches, ["up", "dn"], 5, "random").where("up = 1").orderBy("year").collect()
    assert [r["step"] for r in random] == sorted(r["step"] for r in random)


def test_stratified_sizes(spark):
    df = spark.range(100).select("id", (F.col("id") % 10 == 0).cast("int").alias("c"))
    out = sampling.stratify(df, "c", {0: 20, 1: 25}, ["id"])
    assert dict(values(out.groupBy("c").count(), "c", "count")) == {0: 20, 1: 25}
    assert out.where("c = 1").groupBy("id").count().agg(F.max("count"), F.min("count")).first()[:] == (3, 2)


def test_terminal_interval_reaches_back(batches):
    out = {r["up"]: r for r in bayes.terminal_interval(batches, 1, 5).collect()}
    assert (out[1]["k"], out[1]["n"], out[1]["since"]) == (5, 8, 2001) and out[3]["freq"] == 1.0


def test_step_model_finds_the_step(spark):
    rows = [(1, 2, 2000 + i, 2 if i < 5 else 18, 20) for i in range(10)]
    out = bayes.mcmc_step(spark.createDataFrame(rows, "up long, dn long, year int, k long, n long"), 2000).first()
    assert abs(out["p0"] - 0.1) < 0.07 and abs(out["p1"] - 0.9) < 0.07 and 2003.5 < out["t0"] < 2006


def test_parameter_maps(spark):
    df = spark.sql("select map('mu_0', 2.0D, 't_0', 9.0D, 'mu_1', 3.0D, 't_1', 1.0D) as m, map('a', 2.0D, 'b', 0.0D) as x, map('a', 3.0D, 'b', 1.0D) as y")
    r = df.select(reshape.order_modes(reshape.numbered_parameters(F.col("m")), "t").alias("o"), reshape.relative_difference(F.col("x"), F.col("y")).alias("d"), reshape.unwrap_bytes(F.lit("b'12'")).alias("u")).first()
    assert [m["mu"] for m in r["o"]] == [3.0, 2.0] and r["d"] == {"a": 0.5, "b": None} and r["u"] == "12"


def test_estimates_and_splits(spark):
    from claimweave.operators import estimates as E
    df = spark.createDataFrame([(1, 2, 1, [0.0, 1.0], 7), (1, 2, 0, [0.25, 0.75], 8)], "up long, dn long, pos int, p array<double>, comm int")
    v = E.claim_validity(df, "p").orderBy("pos")
    assert [round(r["pi_pos"], 3) for r in v.collect()] == [0.25, 0.999]
    assert values(E.invert_bayes(df, "p", 2).orderBy("pos"), "pe_0", "pe_1") == [(0.25, 0.75), (1.0, 0.0)]
    assert E.interaction_estimates(v).first()["mean_pos"] == 0.5
    assert values(E.vote_by_community(E.invert_bayes(df.where("pos = 0"), "p", 2), ["pe_0", "pe_1"], "comm"), "vote") == [(1,)]
    two = spark.createDataFrame([(0, float(v)) for v in [1, 1.1, 1.2, 1, 1.1, 9, 9.1, 9.2, 9, 9.1]], "g int, v double")
    out = E.valley_split(two, ["g"], "v")
    assert out.where("(v < 5) <> (part = 0)").count() == 0 and abs(out.agg(F.avg("z")).first()[0]) < 1e-9
    assert E.valley_split(two.limit(0), ["g"], "v").count() == 0
    assert E.feature_families(["a_hi", "a_dyn_hi", "b"], {"hi": ["a", "hi"], "none": ["zz"]}) == {"hi": ["a_hi"]}
    assert E.moved_right(["a", "b", "c"], ["a"]) == ["b", "c", "a"]


def test_numerics_against_known_values(spark):
    import math
    from statistics import NormalDist
    df = spark.createDataFrame([(v,) for v in (-20.0, -7.5, -3.0, 0.3, 2.0, 6.0)], "z double")
    for z, p in values(df.withColumn("p", X.norm_cdf(F.col("z"))), "z", "p"):
        want = 0.5 * math.erfc(-z / math.sqrt(2))
        assert abs(p - want) <= 1e-7 * want
    for p, z in values(spark.createDataFrame([(v,) for v in (1e-5, 0.02, 0.5, 0.6, 0.999)], "p double").withColumn("z", X.norm_ppf(F.col("p"))), "p", "z"):
        assert abs(z - NormalDist().inv_cdf(p)) < 1e-9
    big = spark.createDataFrame([(1_000_000_000, 3_000_000_000)], "k long, n long").select(X.log_choose(F.col("n"), F.col("k")).alias("v")).first()["v"]
    assert abs(big - (math.lgamma(3e9 + 1) - math.lgamma(1e9 + 1) - math.lgamma(2e9 + 1))) < 1e-4
    t = X.t_table()
    assert abs(t[9] - 2.2281388520) < 1e-8 and abs(t[0] - 12.7062047362) < 1e-7 and abs(t[119] - 1.9799304051) < 1e-8
    far = spark.range(1).select(X.t_quantile(F.lit(1000)).alias("t")).first()["t"]
    assert abs(far - 1.9623390808) < 1e-8
    assert X.whole_step(0, 10, 4) == 2 and X.whole_step(0, 1, 10) == 1 and X.axis_end(37) == 50 and X.axis_end(0.2) == 0.2 and X.axis_end(0) == 0


def test_exact_quantiles_of_all_and_of_groups(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 1, 2, 10]] + [("b", 5.0), ("c", None), (None, 7.0), (None, 9.0)], "g string, v double")
    assert windows.exact_quantiles(df, "v", [0.0, 0.5, 1.0]) == [1.0, 5.0, 10.0]
    assert windows.exact_quantiles(df.limit(0), "v", [0.5]) == []
    got = {r["g"]: (r["lo"], r["mid"]) for r in windows.group_quantiles(df, ["g"], "v", {"lo": 0.0, "mid": 0.5}).collect()}
    assert got == {"a": (1.0, 1.5), "b": (5.0, 5.0), None: (7.0, 8.0)}


def test_growth_draws_and_parts(spark):
    df = spark.createDataFrame([(i, i % 30 if i < 300 else i, i % 3 > 0) for i in range(400)], "id long, h long, y boolean")
    parts = sampling.parts_by_class(df, "y", ["id"], {"a": 0.5, "b": 0.5})
    assert {(r["y"], r["part"]): r["count"] for r in parts.groupBy("y", "part").count().collect()} == {(True, "a"): 133, (True, "b"): 133, (False, "a"): 67, (False, "b"): 67}
    drawn = sampling.length_draw(df, ["h"], 0.25, 1.5)
    assert 100 <= drawn.count() <= 110 and drawn.join(df.groupBy("h").count(), "h").groupBy("h").agg(F.count("id").alias("a"), F.first("count").alias("b")).where("a <> b").count() == 0
    assert sampling.parts_by_class(df.limit(0), "y", ["id"], {"a": 1.0}).count() == 0 and sampling.length_draw(df.limit(0), ["h"], 0.5, 1.5).count() == 0
    assert sampling.total_sizes({0: 70, 1: 30}, 11) == {0: 6, 1: 5}


def test_selection_and_clusters(spark):
    from claimweave.operators import models
    rows = [(float(i), float(i * 7 % 11), float(2 * i + 3 + (i % 3 - 1) * 0.01)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    p = {n: (c, v) for n, c, _, v in models.linear_p_values(df, ["a", "b"], "y")}
    assert abs(p["a"][0] - 2) < 1e-3 and p["a"][1] < 1e-6 and p["b"][1] > 0.01
    assert [f for _, f, _ in models.backward_elimination(df, ["a", "b"], "y", 0.01)] == ["b"]
    assert models.correlation_guided(df, ["b", "a"], "y", lambda cs: float("a" in cs), 1)[0][0] == "a"
    assert models.choose_by_gap([(1, 0.1, 0.0), (2, 0.9, 0.01), (3, 0.8, 0.01), (4, 0.9, 0.01)]) == 2 and models.choose_by_gap([(1, 0.0, 0.0), (2, 1.0, 0.0)]) == -1
    c = spark.createDataFrame([("university of gorland", "A"), ("university of gorlund", "A"), ("univ gorland", "A"), ("universty gorland", "A"), ("university of gorlandt", "B"), ("zzz", "C")], "s string, c string")
    assert {r["s"]: r["c"] for r in models.merged_clusters(c, "s", "c", 0.2).collect()}["university of gorlandt"] == "A"


def test_phrase_metrics(spark):
    a, b, e = (F.split(F.lit(x), " ") if x else F.array().cast("array<string>") for x in ("gene lab north", "lab gene north", ""))
    r = spark.range(1).select(text.phrase_metric(a, a).alias("same"), text.phrase_metric(a, b).alias("moved"), text.phrase_metric(a, e).alias("none"), text.word_phrase_distance(a, a).alias("w"),
                              text.least_phrase_metric(F.array(a, b), F.array(b)).alias("least")).first()
    assert r["same"] == 0 and 0 < r["moved"] < 1 and r["none"] == 1 and r["w"] == 0 and r["least"] == 0
