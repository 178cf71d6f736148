"""Splits that keep related records together.

Components come from a frontier breadth-first search with many seeds at once. Adjacency rows are
hash-partitioned by node; a node whose neighbours are many has them spread over several partitions.
Every node that beats all its neighbours in a seeded hash order is a seed (so each component has
one and no two seeds touch). Frontiers expand level by level, a reached node taking the lowest label
offered. Edges between nodes of different labels are collisions; they make the next, smaller graph
of seed labels, which is solved in the same way, and by one task once it is proven small. Splits are
then cut along the hash order of the components, large and small alike.

A hub node, and the label of a component that holds most nodes, are hot join keys: joins on them go
through `skew_join`. The other joins have one row a node on both sides and are hinted to merge, so that
nothing that grows with the data is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.skew import skew_join
from claimweave.session import cut, drop_cuts

#: Edges of the label graph that one task may solve (two longs each).
SMALL_GRAPH = 1_000_000
#: Neighbours per partition of a node's adjacency rows.
ADJACENCY = 10_000
#: Nodes with spread neighbours that may be broadcast (16 bytes each).
MOST_WIDE = 100_000


def _solve_small(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        root = a
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[a] != root:
            parent[a], a = root, parent[a]
        return root

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return pd.DataFrame({"node": list(parent), "root": [find(n) for n in parent]}, dtype="int64")


def components(edges: DataFrame, seed: int = 3, small: int = SMALL_GRAPH) -> DataFrame:
    """`node`, `root` for the nodes of `edges` (long columns `a`, `b`); `root` is the lowest node of
    the component. Null ends, self loops and repeated edges are allowed: a row with a null end ties
    nothing and its other end is not listed; a self loop alone lists its node as its own root."""
    spark = edges.sparkSession
    known = edges.where("a is not null and b is not null")
    pairs = cut(known.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loops = known.where("a = b").select(F.col("a").alias("node")).distinct()
    tied = _components(spark, pairs, seed, small)
    alone = loops.join(tied, "node", "left_anti").select("node", F.col("node").alias("root"))
    return tied.unionByName(alone)


def _components(spark, pairs: DataFrame, seed: int, small: int, depth: int = 0) -> DataFrame:
    n = pairs.count()
    if n <= small and depth:
        whole = pairs.select(F.lit(0).alias("g"), "a", "b")
        return whole.groupBy("g").applyInPandas(lambda pdf: _solve_small(pdf), "node long, root long")
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # A seed beats all neighbours; the degree decides over how many partitions a node's rows go.
    order = lambda c: F.struct(F.xxhash64(F.lit(seed + depth), c), F.col(c))
    nodes = cut(both.groupBy("a").agg(F.count(F.lit(1)).alias("deg"), F.min(order("b")).alias("best")).select(
        F.col("a").alias("node"), (order("a") < F.col("best")).alias("is_seed"), F.ceil(F.col("deg") / ADJACENCY).cast("int").alias("parts")))
    wide = nodes.where("parts > 1").select(F.col("node").alias("a"), "parts") if n > ADJACENCY else None
    if wide is not None and wide.count() <= MOST_WIDE:
        wide = F.broadcast(wide)
    adjacency = both.withColumn("part", F.lit(0)) if wide is None else both.join(wide, "a", "left").withColumn(
        "part", F.coalesce(F.pmod(F.hash("b"), F.col("parts")), F.lit(0))).drop("parts")
    adjacency = cut(adjacency.repartition("a", "part"))
    labels = nodes.where("is_seed").select("node", F.col("node").alias("label"), "parts")
    frontier = cut(labels)
    done, past = [frontier], []
    while True:
        spread = frontier.select(F.col("node").alias("a"), "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        offered = adjacency.join(spread.hint("merge"), ["a", "part"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        for old in done:
            offered = offered.join(old.select("node").hint("merge"), "node", "left_anti")
        reached = cut(offered.join(nodes.select("node", "parts").hint("merge"), "node"))
        drop_cuts(spark, *past)
        past = []
        if reached.isEmpty():
            drop_cuts(spark, reached)
            break
        done.append(reached)
        if len(done) > 3:
            merged = cut(_union(done))
            drop_cuts(spark, *done[:-1])
            past, done = done[-1:], [merged]
        frontier = reached
    labelled = done[0].select("node", "label") if len(done) == 1 else cut(_union(done).select("node", "label"))
    l, r = labelled.select(F.col("node").alias("a"), F.col("label").alias("la")), labelled.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    met = skew_join(skew_join(pairs, l, "a", "inner", merge=True), r, "b", "inner", merge=True).where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    met = cut(met)
    if met.isEmpty():
        out = _lowest(labelled.withColumnRenamed("label", "root"))
        drop_cuts(spark, adjacency, nodes, met, *done, *([] if len(done) == 1 else [labelled]))
        return out
    roots = _components(spark, met, seed, small, depth + 1).select(F.col("node").alias("label"), "root")
    joined = skew_join(labelled, roots, "label", merge=True).select("node", F.coalesce("root", "label").alias("root"))
    out = _lowest(joined)
    drop_cuts(spark, adjacency, nodes, met, *done, *([] if len(done) == 1 else [labelled]))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _lowest(members: DataFrame) -> DataFrame:
    """Roots renamed to the lowest node of their component, which may hold most nodes."""
    low = members.groupBy("root").agg(F.min("node").alias("low"))
    return cut(skew_join(members, low, "root", "inner", merge=True).select("node", F.col("low").alias("root")))


def related_roots(records: DataFrame, a: str, b: str, seed: int = 3, small: int = SMALL_GRAPH) -> DataFrame:
    """`node`, `root` for every id > 0 in the columns `a` or `b`, alone ones included."""
    x = records.select(F.when(F.col(a) > 0, F.col(a)).cast("long").alias("a"), F.when(F.col(b) > 0, F.col(b)).cast("long").alias("b")).distinct()
    x = cut(x.where("a is not null or b is not null"))
    return components(x.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")), seed, small)


def assign_splits(records: DataFrame, roots: DataFrame, shares: dict[str, float], a: str, b: str, ids: list[str], seed: int = 3) -> DataFrame:
    """`records` with `root` (null without a resolved id) and `split`.

    All components are laid end to end in one hash order, weighted by their records, and each goes to
    the split its middle falls in; a component is treated alike whatever its size, and what a giant one
    makes unreachable is in `split_report`. A record without a resolved id is its own unit and is
    placed by the hash of its ids. Equal ids get equal splits. Shares are relative to their sum. An
    empty table gives an empty table.
    """
    spark = records.sparkSession
    key = F.coalesce(F.when(F.col(a) > 0, F.col(a)), F.when(F.col(b) > 0, F.col(b))).cast("long")
    own = [c for c in records.columns if c not in ("root", "split")]
    keyed = cut(skew_join(records.select(*own, key.alias("node")), roots, "node", merge=True).drop("node"))
    weight = keyed.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    weight = cut(weight.withColumn("h", F.xxhash64(F.lit(seed), "root")).withColumn("bucket", F.shiftright("h", 52).cast("int")))
    before, run = [], 0
    for r in weight.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect():
        before.append((r["bucket"], run))
        run += r["n"]
    whole = sum(shares.values())
    offset = F.broadcast(spark.createDataFrame(before, "bucket int, before long"))
    w = Window.partitionBy("bucket").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("n").over(w) - F.col("n") / 2
    placed = weight.join(offset, "bucket").select("root", _cut_at(middle, shares, run / whole).alias("split"))
    loose = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) / F.lit(float(1 << 53))
    lone = keyed.where("root is null").withColumn("split", _cut_at(loose, shares, 1 / whole))
    tied = skew_join(keyed.where("root is not null"), placed, "root", "inner", merge=True)
    return tied.select(*own, "root", "split").unionByName(lone.select(*own, "root", "split"))


def split_report(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per split: `records`, `share` reached, `target_share`, and `largest_component`, the share of all
    records in its largest component. A target below that share cannot be met by this split, nor can
    shares be nearer than half of it to a cut that falls into that component."""
    whole = sum(shares.values())
    per = assigned.groupBy("split", "root").agg(F.count(F.lit(1)).alias("n"))
    got = per.groupBy("split").agg(F.sum("n").alias("records"), F.max(F.when(F.col("root").isNotNull(), F.col("n"))).alias("top"))
    total = got.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0] or 1
    wanted = assigned.sparkSession.createDataFrame([(s, v / whole) for s, v in shares.items()], "split string, target_share double")
    return wanted.join(F.broadcast(got), "split", "left").select(
        "split", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / total).alias("share"), "target_share",
        (F.coalesce("top", F.lit(0)) / total).alias("largest_component"))


def _cut_at(position, shares: dict[str, float], scale: float):
    edge, out, names = 0.0, None, list(shares)
    for s in names[:-1]:
        edge += shares[s] * scale
        out = F.when(position < edge, F.lit(s)) if out is None else out.when(position < edge, F.lit(s))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))
