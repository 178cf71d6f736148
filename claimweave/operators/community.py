"""Communities over edge rows, for all groups at once: by modularity moves, or by label propagation.

Groups of up to `MOST_EDGES` edges are shuffled and sorted once, and a task takes many of them at a time
through all steps in arrays (`operators.graphs`). A larger group would be too much for a task: its rows
pass through as they are, and a step is an aggregation over (group, node, label) for a part of the nodes:
with all at once, neighbours would swap labels for ever. Both take the same steps. Labels are node ids; ties
go to the present label, then to the lowest, so results do not depend on partitioning. The number of steps is
a parameter; labels of a step are cut from lineage, and the tables of the step before are deleted. A hub's
edges meet one label row; adaptive execution splits that join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.operators import graphs
from claimweave.session import cut, drop_cuts

#: Edges of a group that one task may hold (some 200 bytes each).
MOST_EDGES = 1_000_000


def _moving(c: Column, step: int) -> Column:
    """Whether a node moves in a step: a third of the nodes does, another one each time, by the step's digit
    of a hash, which SQL can repeat. Fixed halves would leave neighbours that always move together."""
    return F.conv(F.substring(F.md5(c), step + 1, 1), 16, 10).cast("int") % 3 == 0


def _both_ways(edges: DataFrame, group: list[str], a: str, b: str, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select(*group, F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"), w.cast("double").alias("w")).where("x <> y")
    return e.unionByName(e.select(*group, F.col("y").alias("x"), F.col("x").alias("y"), "w")).groupBy(*group, "x", "y").agg(F.sum("w").alias("w"))


def _moves(both: DataFrame, nodes: DataFrame, total: DataFrame, group: list[str], steps: int) -> DataFrame:
    """`nodes` (group, node, k) with a label each; in each step some move to the neighbouring community of
    largest gain in modularity, w(node, C) - k * k(C without the node) / total."""
    spark, labels, last = both.sparkSession, cut(nodes.withColumn("label", F.col("node"))), None
    own = F.col("label") == F.col("now")
    for step in range(steps):
        now = labels.where(_moving(F.col("node"), step))
        sums = labels.groupBy(*group, "label").agg(F.sum("k").alias("kc"))
        near = both.join(now.select(*group, F.col("node").alias("x")), [*group, "x"], "left_semi") \
            .join(labels.select(*group, F.col("node").alias("y"), "label"), [*group, "y"]).select(*group, F.col("x").alias("node"), "label", "w")
        offers = near.unionByName(now.select(*group, "node", "label", F.lit(0.0).alias("w"))).groupBy(*group, "node", "label").agg(F.sum("w").alias("w"))
        x = offers.join(now.select(*group, "node", "k", F.col("label").alias("now")), [*group, "node"]).join(sums, [*group, "label"]).join(total, group)
        gain = F.round(F.col("w") - F.col("k") * (F.col("kc") - F.when(own, F.col("k")).otherwise(0.0)) / F.col("total"), 9)
        best = x.groupBy(*group, "node", "k").agg(F.min_by("label", F.struct(-gain, (~own).cast("int"), F.col("label"))).alias("label"))
        last, labels = labels, cut(labels.where(~_moving(F.col("node"), step)).unionByName(best.select(*labels.columns)))
        drop_cuts(spark, last)
    return labels


def _solved(edges: DataFrame, group: list[str], a: str, b: str, weight: str | None, carry: tuple[str, ...], fields: list[T.StructField], solve) -> tuple[DataFrame, DataFrame | None]:
    """(`group`, `carry`, `node` and `fields` of the groups that `solve` took, edge rows x, y, w and `carry` of those too large for it).
    Rows with a null key of the group are in neither."""
    many = isinstance(edges.schema[b].dataType, T.ArrayType)
    w = (F.col(weight) if weight else F.lit(None)).cast("double").alias("w")
    rows = edges.select(*group, *carry, F.col(a).alias("x"), F.col(b).alias("y"), w).dropna(subset=[*group, "x", "y"])
    kept = [rows.schema[c] for c in [*group, *carry]]
    left = [rows.schema[c] for c in "xyw"]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField("node", T.StringType()), *fields] + [T.StructField(f.name, f.dataType) for f in left])
    sorted_ = rows.repartition(*group).sortWithinPartitions(*group)
    out = cut(sorted_.mapInArrow(solve(len(group), len(carry), weight is not None), schema))
    large = out.where("node is null")
    if large.isEmpty():
        return out.drop("x", "y", "w"), None
    y = F.explode("y").alias("y") if many else F.col("y")
    one = F.coalesce("w", F.lit(1.0)) if weight is None else F.col("w")
    return out.where("node is not null").drop("x", "y", "w"), large.select(*group, *carry, F.col("x").cast("string").alias("x"), y, one.alias("w")).withColumn("y", F.col("y").cast("string"))


_SIZES = [T.StructField("label", T.StringType()), T.StructField("comm_size", T.LongType()), T.StructField("n_comms", T.LongType()), T.StructField("n_nodes", T.LongType()), T.StructField("modularity", T.DoubleType())]


_DEGREES = [T.StructField(n, T.DoubleType()) for n in ("shared", "degree", "squares", "others")]


def measured_communities(edges: DataFrame, group: list[str], a: str, b: str, weight: str | None = None, steps: int = 8, levels: int = 2,
                         side: bool = False, carry: tuple[str, ...] = (), widths: tuple[int, ...] = (), degrees: bool = False, lag: int | None = None, now: bool = False, most: int = MOST_EDGES) -> DataFrame:
    """As `modularity_communities`, with the columns of `community_table` and the `modularity` of the group.

    `side`: only the nodes of `a` are listed and counted, each with the columns `carry` of its edges. `b` may hold
    arrays, of all the neighbours of an `a`. `widths`: edges with a `year` (carried) before the group's `look` are taken as a
    graph for each `width`, of those with look - width < year. `degrees` (of a graph without weights, with `side`): also `shared`, the degrees
    less one of the node's neighbours together, its `degree`, and of the group `squares` and `others`, the squared degrees and the number of `b`. `lag` (with `side`, and `year` and `pos`
    carried): only the nodes of the year `look` are listed, with `earlier`, the mean `pos` of those of their community that are at least `lag` years older. `now` (with `side`, and `year`
    carried): only the nodes of the year `look` are listed, all are counted."""
    fields = [*_SIZES, *(_DEGREES if degrees else []), *([T.StructField("earlier", T.DoubleType())] if lag is not None else []), *([T.StructField("width", T.IntegerType())] if widths else [])]
    kinds = [*graphs.SIZES, *(graphs.DEGREES if degrees else []), *(graphs.DEGREES[:1] if lag is not None else [])]
    at = (group.index("look"), len(group) + carry.index("year")) if widths or now or lag is not None else (0, 0)
    at = (*at, len(group) + carry.index("pos")) if lag is not None else at
    found, large = _solved(edges, group, a, b, weight, carry, fields, lambda g, c, w: graphs.solver(graphs.communities(steps, levels, degrees, lag), kinds, g, c, w, side, most, widths, at, lag, now))
    if large is None:
        return found
    if widths:
        large, group = cut(large.withColumn("width", F.explode(F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: w > F.col("look") - F.col("year"))))), [*group, "width"]
    labels = _stepwise(large, group, "x", "y", "w", steps, levels)
    listed = labels
    if side:
        listed = labels.join(large.select(*group, *carry, F.col("x").alias("node")).dropDuplicates([*group, "node"]), [*group, "node"])
    listed = community_table(listed, group).drop("rel_size").join(modularity(large, labels, group, "x", "y", "w"), group)
    if degrees:
        both = large.select(*group, "x", "y").distinct()
        deg = both.groupBy(*group, "y").agg(F.count(F.lit(1)).cast("double").alias("d"))
        own = both.join(deg, [*group, "y"]).groupBy(*group, F.col("x").alias("node")).agg(F.sum(F.col("d") - 1).alias("shared"), F.count(F.lit(1)).cast("double").alias("degree"))
        listed = listed.join(own, [*group, "node"]).join(deg.groupBy(*group).agg(F.sum(F.col("d") * F.col("d")).alias("squares"), F.count(F.lit(1)).cast("double").alias("others")), group)
    if now:
        listed = listed.where("year = look")
    if lag is not None:
        before = listed.where(F.col("year") <= F.col("look") - lag).groupBy(*group, "label").agg(F.avg("pos").alias("earlier"))
        listed = listed.where("year = look").join(before, [*group, "label"], "left")
    return found.unionByName(cut(listed.select(*found.columns)))


def modularity_communities(edges: DataFrame, group: list[str], a: str, b: str, weight: str | None = None, steps: int = 8, levels: int = 2, most: int = MOST_EDGES) -> DataFrame:
    """`group`, `node`, `label`: communities of large modularity, in the manner of Louvain's method.

    On the first level single nodes move, on each further one whole communities. Nodes without an edge
    are not listed. Weights must be positive; null weights and loops count nothing."""
    return measured_communities(edges, group, a, b, weight, steps, levels, most=most).select(*group, "node", "label")


def _stepwise(edges: DataFrame, group: list[str], a: str, b: str, weight: str | None, steps: int, levels: int) -> DataFrame:
    both = cut(_both_ways(edges, group, a, b, weight).where("w > 0"))
    total = both.groupBy(*group).agg(F.sum("w").alias("total"))
    degree = both.groupBy(*group, F.col("x").alias("node")).agg(F.sum("w").alias("k"))
    found = _moves(both, degree, total, group, steps).select(*group, "node", "label", "k")
    for _ in range(levels - 1):
        name = lambda n, l: found.select(*group, F.col("node").alias(n), F.col("label").alias(l))
        upper = cut(both.join(name("x", "lx"), [*group, "x"]).join(name("y", "ly"), [*group, "y"]).where("lx <> ly")
                    .groupBy(*group, F.col("lx").alias("x"), F.col("ly").alias("y")).agg(F.sum("w").alias("w")))
        nodes = found.groupBy(*group, F.col("label").alias("node")).agg(F.sum("k").alias("k"))
        moved = _moves(upper, nodes, total, group, steps).select(*group, F.col("node").alias("label"), F.col("label").alias("upper"))
        found = cut(found.join(moved, [*group, "label"]).select(*group, "node", F.col("upper").alias("label"), "k"))
        drop_cuts(both.sparkSession, upper)
    drop_cuts(both.sparkSession, both)
    return found.select(*group, "node", "label")


def modularity_communities_sql(edges: str, group: list[str], steps: int = 8, levels: int = 2) -> tuple[str, str]:
    """(common table expressions, name of the result) that do the same in SQL on a relation `edges` of
    group, x, y (text), w with both directions of each edge."""
    g, using = ", ".join(group), lambda *more: f"using ({', '.join([*group, *more])})"
    moving = lambda node, step: f"cast('0x' || substr(md5({node}), {step + 1}, 1) as integer) % 3"
    ctes = [f"mt as materialized (select {g}, sum(w) as total from {edges} group by {g})",
            f"mn0 as materialized (select {g}, x as node, sum(w) as k, node as label from {edges} group by {g}, x)"]
    flat, n, both, level_of = "mn0", 0, edges, None
    for level in range(levels):
        now = f"mn{n}"
        if level:
            ctes.append(f"mu{level} as materialized (select {', '.join('b.' + c for c in group)}, p.label as x, q.label as y, sum(b.w) as w from {edges} b join {flat} p on {' and '.join(f'b.{c} = p.{c}' for c in group)} and b.x = p.node "
                        f"join {flat} q on {' and '.join(f'b.{c} = q.{c}' for c in group)} and b.y = q.node where p.label <> q.label group by {', '.join('b.' + c for c in group)}, p.label, q.label)")
            both, n = f"mu{level}", n + 1
            ctes.append(f"mn{n} as materialized (select {g}, label as node, sum(k) as k, label from {flat} group by {g}, label)")
            now = f"mn{n}"
        for step in range(steps):
            n += 1
            ctes += [
                f"mo{n} as materialized (select {g}, node, label, sum(w) as w from (select {', '.join('b.' + c for c in group)}, b.x as node, l.label, b.w from {both} b join {now} l on {' and '.join(f'b.{c} = l.{c}' for c in group)} and b.y = l.node union all select {g}, node, label, 0e0 from {now}) group by {g}, node, label)",
                f"ms{n} as materialized (select {g}, label, sum(k) as kc from {now} group by {g}, label)",
                f"mx{n} as materialized (select {', '.join('o.' + c for c in group)}, o.node, o.label, c.k, c.label as present, round(o.w - c.k * (s.kc - case when o.label = c.label then c.k else 0 end) / t.total, 9) as gain from mo{n} o join {now} c {using('node')} join ms{n} s on {' and '.join(f'o.{c} = s.{c}' for c in group)} and o.label = s.label join mt t {using()} where {moving('o.node', step)} = 0)",
                f"mn{n} as materialized (select {g}, node, k, label from {now} where {moving('node', step)} <> 0 union all select {g}, node, k, label from (select *, row_number() over (partition by {g}, node order by gain desc, label <> present, label) as r from mx{n}) where r = 1)"]
            now = f"mn{n}"
        if level:
            ctes.append(f"mf{level} as materialized (select {', '.join('f.' + c for c in group)}, f.node, u.label, f.k from {flat} f join {now} u on {' and '.join(f'f.{c} = u.{c}' for c in group)} and f.label = u.node)")
            flat = f"mf{level}"
        else:
            flat = now
    return ", ".join(ctes), flat


def modularity(edges: DataFrame, labels: DataFrame, group: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """`modularity` of each group under the labels: the share of weight inside communities less what it would be at random."""
    both = _both_ways(edges, group, a, b, weight).where("w > 0")
    name = lambda n, l: labels.select(*group, F.col("node").alias(n), F.col("label").alias(l))
    x = both.join(name("x", "lx"), [*group, "x"]).join(name("y", "ly"), [*group, "y"])
    per = x.groupBy(*group, "lx").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("lx") == F.col("ly"), F.col("w")).otherwise(0.0)).alias("inside"))
    m = F.sum("k")
    return per.groupBy(*group).agg((F.sum("inside") / m - F.sum(F.col("k") * F.col("k")) / (m * m)).alias("modularity"))


def graph_components(edges: DataFrame, group: list[str], a: str, b: str, most: int = MOST_EDGES) -> DataFrame:
    """`group`, `node`, `component` (its lowest node). `b` may hold arrays, of all the neighbours of an `a`."""
    found, large = _solved(edges, group, a, b, None, (), [T.StructField("component", T.StringType())], lambda g, c, w: graphs.solver(graphs.components, graphs.LOWEST, g, c, w, False, most))
    return found if large is None else found.unionByName(_spread(large, group, "x", "y"))


def component_counts(edges: DataFrame, group: list[str], a: str, b: str, most: int = MOST_EDGES) -> DataFrame:
    """`group`, `n_components`, `n_a` and `n_b`, the nodes of either side, of which no node may be on both."""
    names = ["n_components", "n_a", "n_b"]
    found, large = _solved(edges, group, a, b, None, (), [T.StructField(n, T.LongType()) for n in names], lambda g, c, w: graphs.solver(graphs.component_counts, graphs.COUNTS, g, c, w, False, most))
    found = found.select(*group, *names)
    if large is None:
        return found
    left = F.col("left").isNotNull()
    nodes = _spread(large, group, "x", "y").join(large.select(*group, F.col("x").alias("node"), F.lit(1).alias("left")).distinct(), [*group, "node"], "left")
    return found.unionByName(nodes.groupBy(*group).agg(F.count(F.when(F.col("component") == F.col("node"), 1)).alias("n_components"), F.count(F.when(left, 1)).alias("n_a"), F.count(F.when(~left, 1)).alias("n_b")))


def _spread(edges: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Lowest labels spread along the edges, and along the labels' own labels, until none changes."""
    both, spark = cut(_both_ways(edges, group, a, b, None)), edges.sparkSession
    labels = cut(both.groupBy(*group, F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("component")))
    while True:
        own = labels.select(*group, F.col("node").alias("y"), "component")
        near = both.join(own, [*group, "y"]).select(*group, F.col("x").alias("node"), "component").unionByName(labels)
        low = near.groupBy(*group, "node").agg(F.min("component").alias("component"))
        jump = low.join(own.select(*group, F.col("y").alias("component"), F.col("component").alias("next")), [*group, "component"], "left")
        new = cut(jump.select(*group, "node", F.least("component", F.coalesce("next", "component")).alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), [*group, "node"]).where("component <> old")
        done, last, labels = changed.isEmpty(), labels, new
        drop_cuts(spark, last)
        if done:
            drop_cuts(spark, both)
            return labels


def refutation(claims: DataFrame, sources: dict[str, DataFrame], widths: list[int], lag: int = 1) -> DataFrame:
    """Per claim, source of units and width: `vote_<source><width>`, 1 if most claims of its community, found
    among the papers of the last `width` years, that are at least `lag` years older are positive, else 0;
    null without such claims or without units. `claims` has a row per (up, dn, pmid). All graphs are solved in one pass."""
    from claimweave.operators.bipartite import stars, unit_lists
    from claimweave.operators.relational import value_windows

    key, batch = ["source", "width", "up", "dn", "look"], ["up", "dn", "look", "pmid"]
    windows = value_windows(claims.select("up", "dn", "year", "pmid", "pos"), ["up", "dn"], "year", max(widths))
    lists = reduce(DataFrame.unionByName, [unit_lists(u).withColumn("source", F.lit(n)) for n, u in sources.items()])
    voted = measured_communities(stars(windows, lists), [k for k in key if k != "width"], "p", "u", side=True, carry=("pmid", "year", "pos"), widths=tuple(widths), lag=lag)
    vote = (F.col("earlier") > 0.5).cast("int")
    wide = voted.groupBy(*batch).agg(*[F.max(F.when((F.col("source") == n) & (F.col("width") == w), vote)).alias(f"vote_{n}{w}") for n in sources for w in widths])
    out = claims.select("claim_id", "up", "dn", F.col("year").alias("look"), "pmid").join(wide, batch, "left")
    return out.select("claim_id", *[f"vote_{n}{w}" for n in sources for w in widths])


def label_propagation(edges: DataFrame, group: list[str], a: str, b: str, weight: str | None = None, rounds: int = 3, bipartite: bool = False) -> DataFrame:
    """`group`, `node`, `label` for a bipartite or plain graph with nodes in `a` and `b` (strings).
    The halves are the two sides of a bipartite graph, else halves of the nodes by hash."""
    w = F.col(weight) if weight else F.lit(1.0)
    half = lambda c, side: F.lit(side) if bipartite else F.pmod(F.xxhash64(c), F.lit(2)).cast("int")
    e = edges.select(*group, F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"), w.cast("double").alias("w")).where("x <> y")
    one = e.withColumn("half", half("x", 0))
    other = e.select(*group, F.col("y").alias("x"), F.col("x").alias("y"), "w", half("y", 1).alias("half"))
    both = cut(one.unionByName(other).groupBy(*group, "half", "x", "y").agg(F.sum("w").alias("w")))
    labels = cut(both.select(*group, "half", F.col("x").alias("node"), F.col("x").alias("label")).distinct())
    for step in range(2 * rounds):
        now = F.col("half") == step % 2
        near = both.where(now).join(labels.select(*group, F.col("node").alias("y"), "label"), [*group, "y"]).groupBy(*group, "half", F.col("x").alias("node"), "label").agg(F.sum("w").alias("w"))
        best = near.groupBy(*group, "half", "node").agg(F.min_by("label", F.struct(-F.round("w", 6), F.col("label"))).alias("label"))
        labels = cut(labels.where(~now).unionByName(best))
    return labels.drop("half")


def community_table(labels: DataFrame, group: list[str]) -> DataFrame:
    """Adds the size of the node's community, the number of communities and nodes, and the relative size."""
    size = labels.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("comm_size"))
    total = size.groupBy(*group).agg(F.count(F.lit(1)).alias("n_comms"), F.sum("comm_size").alias("n_nodes"))
    return labels.join(size, [*group, "label"]).join(total, group).withColumn("rel_size", F.col("comm_size") / F.col("n_nodes"))


def ranked_communities(df: DataFrame, keys: list[str], community: str, size: str) -> DataFrame:
    """Zero-based dense rank of communities by size within each group, joined back to the rows."""
    distinct = df.select(*keys, community, size).dropDuplicates([*keys, community])
    w = Window.partitionBy(*keys).orderBy(F.desc(size))
    return df.join(distinct.select(*keys, community, (F.dense_rank().over(w) - 1).alias("rank")), [*keys, community])


def lowest_ranks_present(df: DataFrame, keys: list[str], rank: str, k: int) -> DataFrame:
    """Rows of groups whose k smallest distinct ranks are 0..k-1."""
    have = df.where(F.col(rank) < k).groupBy(*keys).agg(F.countDistinct(rank).alias("__cw_n")).where(F.col("__cw_n") == k)
    return df.join(have.select(*keys), keys, "left_semi")


def community_of_rank(df: DataFrame, keys: list[str], community: str, rank: str, wanted: int) -> DataFrame:
    """Rows of the lowest community id that has the wanted rank, one community per group."""
    first = df.where(F.col(rank) == wanted).groupBy(*keys).agg(F.min(community).alias(community))
    return df.join(first, [*keys, community], "left_semi")


def community_count_between(df: DataFrame, keys: list[str], community: str, low: int, high: int) -> DataFrame:
    """Rows of groups with low to high distinct communities."""
    n = df.groupBy(*keys).agg(F.countDistinct(community).alias("__cw_n")).where(F.col("__cw_n").between(low, high))
    return df.join(n.select(*keys), keys, "left_semi")


def earlier_majority(df: DataFrame, keys: list[str], community: str, pos: str = "pos", time: str = "year") -> DataFrame:
    """Per community and year of its claims: 1 if more than half of the community's earlier claims
    are positive, else 0; null if it has none. Running sums per community, no rescans."""
    b = df.groupBy(*keys, community, time).agg(F.sum(pos).alias("k"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, community).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("vote", (F.sum("k").over(w) / F.sum("n").over(w) > 0.5).cast("int")).select(*keys, community, time, "vote")
