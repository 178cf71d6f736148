"""Operators that must not leave out part of their job."""

import random

from pyspark.sql import functions as F

from claimweave.operators import bayes, bipartite, models
from claimweave.plans import model_queries, pipelines_queries, relational_queries
from claimweave.sources.claims import claims, readings


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_leader_clusters_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    orgs = {"braagamere university hospital", "bragamere university hospital", "casligrad biosciences ltd", "casligrad biosoiences ltd", "ab", "éa"}
    for base in ["abcdefghij klm", "bcabcaabcb", "aabbccddee ff gg university", "abcde"]:
        for _ in range(40):
            s = list(base)
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(s))
                s[k:k + 1] = rng.choice(["", "a", "b", s[k] + "c"])
            orgs.add("".join(s) or "x")
    want, leaders = {}, []
    for s in sorted(orgs, key=lambda s: (-len(s), s)):
        want[s] = next((x for x in leaders if edits(x, s) / max(1, min(len(x), len(s))) <= 0.2), s)
        if want[s] == s:
            leaders.append(s)
    got = models.leader_clusters(spark.createDataFrame([(s,) for s in orgs], "org string"), "org", 0.2)
    assert {r["org"]: r["leader"] for r in got.collect()} == want
    assert want["bragamere university hospital"] == "braagamere university hospital"
    assert models.leader_clusters(got.select("org").limit(0), "org", 0.2).count() == 0


def test_jaccard_and_members_give_all_pairs(spark):
    sets = {1: "ab", 2: "ab", 3: "abc", 4: "xy", 5: "xy", 6: "xy", 7: "q", 8: "abc"}
    c = spark.createDataFrame([(1, 2, p) for p in sets] + [(3, 4, 1), (3, 4, 9)], "up long, dn long, pmid long")
    u = spark.createDataFrame([(p, x) for p, s in sets.items() for x in s], "pmid long, unit string")
    members = {}
    for r in bipartite.class_members(c, u).collect():
        members.setdefault((r["up"], r["dn"], r["class"]), []).append(r["pmid"])
        assert r["members"] == (1 if r["up"] == 3 else sum(set(s) == set(sets[r["pmid"]]) for s in sets.values()))
    got = {(m[0], a, b): 1.0 for m, ps in members.items() for a in ps for b in ps if a < b}
    for r in bipartite.similar_papers(c, u, 0.5).collect():
        got |= {(r["up"], *sorted((a, b))): r["jaccard"] for a in members[r["up"], r["dn"], r["a"]] for b in members[r["up"], r["dn"], r["b"]]}
    j = {(1, a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in j.items() if v >= 0.5}


def test_graph_metrics_have_communities_and_votes_per_claim(spark):
    rows = [(10, 2000, 1, "ab"), (11, 2000, 1, "ab"), (12, 2000, 0, "x"), (13, 2001, 0, "ab"), (14, 2001, 1, "x"), (15, 2001, 1, ""), (16, 2003, 1, "ab")]
    c = spark.createDataFrame([(p, 1, 2, p, y, v) for p, y, v, _ in rows], "claim_id long, up long, dn long, pmid long, year int, pos int")
    u = spark.createDataFrame([(p, x) for p, _, _, s in rows for x in s], "pmid long, unit string")
    got = {r["pmid"]: r for r in pipelines_queries.graph_metrics(c, u).collect()}
    assert len(got) == len(rows)
    # 13 is with 10 and 11, both positive; 14 with 12, negative; 15 has no units; 16 sees 13 only at width 3.
    assert [got[p]["vote2"] for p in (10, 13, 14, 15, 16)] == [None, 1, 0, None, None] and got[16]["vote3"] == 0
    assert [(got[p]["comm_size2"], got[p]["n_comms2"], got[p]["rank2"]) for p in (13, 14, 15)] == [(3, 2, 0), (2, 2, 1), (None, None, None)]
    assert [round(got[p]["affinity2"], 6) for p in (13, 14, 15)] == [0.4, 0.2, 0.0] and all(got[p]["vote1"] is None for p in got)
    assert got[13]["support1"] == got[14]["support1"] == got[15]["support1"] > 0


def test_step_model_starts_at_late_years_too(spark):
    years = [(1, 2, 1970 + i, 0 if i < 35 else 20, 20) for i in range(40)] + [(3, 4, 1999, 1, 1)]
    b = spark.createDataFrame(years, "up long, dn long, year int, k long, n long")
    # After one draw the chain is where it starts, or one accepted move on.
    out = {r["up"]: r for r in bayes.mcmc_step(b, 1, 0.0).collect()}
    assert len(out) == 2 and 2003 < out[1]["t0"] < 2007 and out[1]["p0"] < 0.4 and out[1]["p1"] > 0.6
    long = {r["up"]: r for r in bayes.mcmc_step(b, 4000).collect()}
    assert long[1]["p0"] < 0.05 and long[1]["p1"] > 0.9 and 2004 < long[1]["t0"] <= 2005
    assert 0.4 < long[3]["p0"] < 0.8 and 0.3 < long[3]["p1"] < 0.7


def test_bins_hold_every_measured_value(spark):
    sf = "/root/testdata/sf0.01"
    n = claims(spark, sf).where("cdf_exp is not null and ar is not null").count()
    assert relational_queries.QUERIES["binned_corr_all"](spark, sf).agg(F.sum("n")).first()[0] == n
    n = readings(spark, sf).where("ai is not null").count()
    assert relational_queries.QUERIES["range_bins_all"](spark, sf).count() == n


def test_curves_have_all_percentiles(spark):
    sf = "/root/testdata/sf0.01"
    curve = model_queries.QUERIES["topk_precision_99"](spark, sf)
    assert sorted(r["level"] for r in curve.collect()) == list(range(1, 100))
    area, coarse = (model_queries.QUERIES[n](spark, sf).first()["area"] for n in ("trapezoid_auc_99", "trapezoid_auc"))
    assert abs(area - coarse) < 0.05 and area != coarse
