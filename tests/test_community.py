"""Communities by modularity moves against the best of all partitions, and components."""

import itertools
import random

from pyspark.sql import functions as F

from claimweave.operators import bipartite as G
from claimweave.operators import community as C


def quality(edges, part):
    m = sum(edges.values())
    k = {}
    for (a, b), w in edges.items():
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(w for (a, b), w in edges.items() if part[a] == part[b])
    return inside / m - sum((sum(v for n, v in k.items() if part[n] == c) / (2 * m)) ** 2 for c in set(part.values()))


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def test_modularity_is_near_the_best_there_is(spark):
    rng, rows, graphs = random.Random(4), [], {}
    for g in range(12):
        n = rng.randint(5, 8)
        edges = {}
        for a, b in itertools.combinations(range(n), 2):
            near = (a < n // 2) == (b < n // 2)
            if rng.random() < (0.8 if near else 0.2):
                edges[f"v{a}", f"v{b}"] = float(rng.randint(1, 3))
        if not edges:
            continue
        graphs[g] = edges
        rows += [(g, a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "g int, a string, b string, w double")
    labels = C.modularity_communities(df, ["g"], "a", "b", "w")
    got = {r["g"]: r["modularity"] for r in C.modularity(df, labels, ["g"], "a", "b", "w").collect()}
    part = {}
    for r in labels.collect():
        part.setdefault(r["g"], {})[r["node"]] = r["label"]
    total = best_total = 0
    for g, edges in graphs.items():
        assert abs(got[g] - quality(edges, part[g])) < 1e-9
        nodes = sorted(part[g])
        best = max(quality(edges, {n: i for i, c in enumerate(p) for n in c}) for p in partitions(nodes))
        total, best_total = total + got[g], best_total + best
        assert got[g] >= best - 0.1
    assert total >= 0.95 * best_total
    assert C.modularity_communities(df.limit(0), ["g"], "a", "b", "w").count() == 0


def test_components_of_groups(spark):
    e = [(1, "a", "b"), (1, "b", "c"), (1, "x", "y"), (2, "a", "y"), (2, "y", "z"), (2, "z", "q"), (2, "q", "m"), (2, "m", "k")]
    got = {(r["g"], r["node"]): r["component"] for r in C.graph_components(spark.createDataFrame(e, "g int, s string, t string"), ["g"], "s", "t").collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "x"): "x", (1, "y"): "x", **{(2, n): "a" for n in "ayzqmk"}}


def test_projection_and_refutation(spark):
    c = spark.createDataFrame([(i, 1, 2, i, 2000 + i, p) for i, p in enumerate([1, 1, 0, 1])], "claim_id long, up long, dn long, pmid long, year int, pos int")
    u = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "z")], "pmid long, unit string")
    w = {(r["a"], r["b"]): r["weight"] for r in G.projected_weights(c, u).collect()}
    assert w == {(0, 1): 1.0, (0, 2): 1 / 3, (1, 2): 1 / 3}
    assert G.summed_weights([G.projected_weights(c, u)] * 2).agg(F.max("weight")).first()[0] == 1.0
    # Two groups of authors; the claim of 2001 is in the first, whose earlier claims are positive.
    rows = [(0, 2000, 1, "ab"), (1, 2000, 1, "ab"), (2, 2001, 0, "ab"), (5, 2000, 0, "xy"), (6, 2000, 0, "xy"), (7, 2001, 1, "xy"), (8, 2001, 1, "")]
    c = spark.createDataFrame([(i, 1, 2, i, y, p) for i, y, p, _ in rows], "claim_id long, up long, dn long, pmid long, year int, pos int")
    u = spark.createDataFrame([(i, x) for i, _, _, xs in rows for x in xs], "pmid long, unit string")
    out = {r["claim_id"]: r["vote_x9"] for r in C.refutation(c, {"x": u}, [9]).collect()}
    assert out == {0: None, 1: None, 2: 1, 5: None, 6: None, 7: 0, 8: None}
    assert C.refutation(c.limit(0), {"x": u}, [9]).count() == 0


def test_groups_too_large_for_a_task_take_the_same_steps(spark):
    rng = random.Random(7)
    rows = [(g, f"p{rng.randint(0, n)}", f"u:{rng.choice('äbz')}{rng.randint(0, n)}", rng.choice([0.5, 1.0, None])) for g, n in ((1, 3), (2, 20), (3, 60), (4, 9)) for _ in range(3 * n)]
    df = spark.createDataFrame(rows, "g int, p string, u string, w double")
    cells = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    for weight, side in ((None, True), ("w", False)):
        small, large = (C.measured_communities(df, ["g"], "p", "u", weight, 3, side=side, most=m) for m in (10**6, 0))
        assert cells(small) == cells(large.select(small.columns))
    dated = df.select("g", F.lit(2005).alias("look"), F.substring("p", 2, 1).cast("int").alias("age"), "p", "u").distinct().withColumn("year", F.col("look") - F.col("age"))
    small, large = (C.measured_communities(dated, ["g", "look"], "p", "u", None, 3, side=True, carry=("year",), widths=(1, 4), degrees=True, most=m) for m in (10**6, 0))
    assert cells(small) == cells(large.select(small.columns)) and {r["width"] for r in small.collect()} == {1, 4}
    one = C.measured_communities(dated.where("age < 4"), ["g", "look"], "p", "u", None, 3, side=True, carry=("year",), degrees=True)
    assert cells(small.where("width = 4").drop("width")) == cells(one)
    voted = dated.withColumn("pos", F.length("p") % 2)
    small, large = (C.measured_communities(voted, ["g", "look"], "p", "u", None, 3, side=True, carry=("year", "pos"), widths=(2, 4), lag=1, most=m) for m in (10**6, 0))
    assert cells(small) == cells(large.select(small.columns)) and small.where("year < look").isEmpty()
    assert cells(C.graph_components(df, ["g"], "p", "u", most=0)) == cells(C.graph_components(df, ["g"], "p", "u"))
    lists = df.groupBy("g", "p").agg(F.collect_set("u").alias("u"))
    assert cells(C.modularity_communities(lists, ["g"], "p", "u")) == cells(C.modularity_communities(df.distinct().select("g", "p", "u").distinct(), ["g"], "p", "u"))


def test_small_graphs_take_no_job_a_step(spark):
    """At a job or more for each of 16 steps, a query of small graphs was over its time at 0.1 GB."""
    df = spark.createDataFrame([(g, f"p{g % 7}", f"u:{g % 5}") for g in range(40)], "g int, p string, u string")
    for call in (C.modularity_communities, C.graph_components):
        spark.sparkContext.setJobGroup("few", "few")
        call(df, ["g"], "p", "u").count()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 15
        spark.sparkContext.setJobGroup("few", "")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_are_counted_where_they_are_found(spark):
    """A row a node was written for each window, and over the disk at 30 GB."""
    e = spark.createDataFrame([(1, "p1", ["u:a", "u:b"]), (1, "p2", ["u:b"]), (1, "p3", ["u:c"]), (2, "p1", ["u:a"]), (3, "p9", [])], "g int, p string, u array<string>")
    for most in (10**6, 0):
        got = C.component_counts(e, ["g"], "p", "u", most=most)
        assert sorted(map(tuple, got.collect())) == [(1, 2, 3, 3), (2, 1, 1, 1)]


def test_only_the_papers_of_the_year_are_written(spark):
    """All papers of a window were written, to be left out when read again."""
    rows = [(2003, y, f"p{y}{i}", [f"u:{i % 2}", f"u:{y}"]) for y in (2001, 2002, 2003) for i in range(4)] + [(2009, 2008, "p1", ["u:1"])]
    e = spark.createDataFrame(rows, "look int, year int, p string, u array<string>")
    cells = lambda d: sorted(map(str, d.collect()))
    every = C.measured_communities(e, ["look"], "p", "u", side=True, carry=("year",))
    for most in (10**6, 0):
        now = C.measured_communities(e, ["look"], "p", "u", side=True, carry=("year",), now=True, most=most)
        assert now.count() == 4 and cells(now.select(every.columns)) == cells(every.where("year = look"))
        assert {r["n_nodes"] for r in now.collect()} == {12}


def test_pairs_of_windows_are_those_of_the_projections(spark):
    """Each projection sent its pairs through eight joins, twice; that was over the time at 1 GB."""
    rng = random.Random(3)
    c = spark.createDataFrame([(1, 2 + i % 2, 2000 + rng.choice([0, 1, 2, 5, 9]), i) for i in range(60)], "up long, dn long, year int, pmid long")
    units = [spark.createDataFrame(sorted({(i, f"{n}{rng.randint(0, k)}") for i in range(0, 60, n) for _ in range(3)}), "pmid long, unit string") for n, k in ((1, 25), (2, 9))]
    slow = G.window_pairs(G.summed_weights([G.projected_weights(c, u) for u in units]), G.rank_windowed(c, 3))
    fast = G.windowed_similarities(c, units, 3)
    cells = lambda d: sorted((*r[:5], round(r[5], 12)) for r in d.collect())
    assert cells(fast) == cells(slow.select(fast.columns)) and fast.count() > 100
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(fast) < joins(slow) / 4
