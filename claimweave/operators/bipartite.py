"""Paper-unit graphs of interactions (units: authors, affiliations, cited papers) in relational form.

Edges are rows (up, dn, year, pmid, unit); look-back windows multiply them by the window's width at
most. Everything is grouped by (interaction, year, unit), so no interaction's graph is gathered in a
task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.relational import rank_windows, value_windows
from claimweave.session import cut

PAIR = ["up", "dn"]


def windowed(claims: DataFrame, width: int) -> DataFrame:
    """Distinct papers of each interaction in the years (look - width, look]."""
    return value_windows(claims.select(*PAIR, "year", "pmid").distinct(), PAIR, "year", width).select(*PAIR, "look", "year", "pmid")


def rank_windowed(claims: DataFrame, width: int) -> DataFrame:
    """Distinct papers of each interaction in its last `width` years that have any."""
    return rank_windows(claims.select(*PAIR, "year", "pmid").distinct(), PAIR, "year", width).select(*PAIR, "look", "year", "pmid")


def unit_lists(units: DataFrame) -> DataFrame:
    """A row per paper with its distinct units, as text that no paper has."""
    return units.groupBy("pmid").agg(F.collect_set(F.concat(F.lit("u:"), "unit")).alias("u"))


def stars(windows: DataFrame, lists: DataFrame) -> DataFrame:
    """The paper-unit graphs of `windows`, a row `p`, `u` for each paper with all its units."""
    return windows.join(lists, "pmid").withColumn("p", F.concat(F.lit("p"), "pmid"))


def _graph(claims: DataFrame, units: DataFrame, width: int, windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers = windowed(claims, width) if windows is None else windows
    key = [*PAIR, "look"]
    edges = papers.select(*key, "pmid").distinct().join(units, "pmid")
    degrees = edges.groupBy(*key, "unit").agg(F.count(F.lit(1)).alias("deg"))
    size = papers.groupBy(*key).agg(F.countDistinct("pmid").alias("n_papers"))
    return papers, edges, degrees.join(size, key)


def support_index(claims: DataFrame, units: DataFrame, width: int, fraction: float = 1.0, squared: bool = True, windows: DataFrame | None = None) -> DataFrame:
    """Per interaction and year: sum of the (squared) unit degrees over the top fraction of units, against
    the most it could be; 0 without units or with one paper.

    Degrees are few, so the top is taken off the histogram of degrees and no group's units are sorted.
    `windows` replaces the look-back by years with others, of the columns of `windowed`.
    """
    key = [*PAIR, "look"]
    papers, _, deg = _graph(claims, units, width, windows)
    hist = deg.groupBy(*key, "deg").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*key)
    hist = hist.withColumn("v", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.ceil(F.lit(fraction) * F.col("v")) - (F.col("upto") - F.col("c"))))
    size = lambda c: c * c if squared else c
    got = hist.withColumn("t", taken).where("t > 0").groupBy(*key).agg(
        F.sum(F.col("t") * size(F.col("deg"))).alias("s"), F.sum("t").alias("m"), F.max("v").alias("n_units"), F.sum(F.col("t") * F.col("deg")).alias("n_edges"))
    every = papers.groupBy(*key).agg(F.countDistinct("pmid").alias("n_papers"))
    index = F.when(F.col("n_papers") > 1, F.col("s") / (F.col("m") * size(F.col("n_papers"))))
    return every.join(got, key, "left").select(*key, "n_papers", F.coalesce("n_units", F.lit(0)).alias("n_units"),
                                               F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce(index, F.lit(0.0)).alias("support"))


def affinity_index(claims: DataFrame, units: DataFrame, width: int) -> DataFrame:
    """Per paper of the year: mean share of the window's other papers that share each of its units."""
    key = [*PAIR, "look"]
    papers, edges, deg = _graph(claims, units, width)
    own = papers.where("year = look").select(*key, "pmid").distinct()
    per = own.join(edges, [*key, "pmid"]).join(deg, [*key, "unit"]).groupBy(*key, "pmid").agg(
        F.try_divide(F.sum(F.col("deg") - 1), F.count(F.lit(1)) * F.first(F.col("n_papers") - 1)).alias("a"), F.first("n_papers").alias("p"))
    out = own.join(per, [*key, "pmid"], "left")
    return out.select(*key, "pmid", F.coalesce(F.when(F.col("p") > 1, F.col("a")), F.lit(0.0)).alias("affinity"))


def batch_numsum(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Per claim: the most papers any of its units had on the interaction in strictly earlier years (0 without units)."""
    c = claims.select(*PAIR, "year", "pmid").distinct()
    e = c.join(units, "pmid")
    per = e.groupBy(*PAIR, "unit", "year").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*PAIR, "unit").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    best = e.join(before, [*PAIR, "unit", "year"]).groupBy(*PAIR, "year", "pmid").agg(F.max("before").alias("numsum"))
    return c.join(best, [*PAIR, "year", "pmid"], "left").withColumn("numsum", F.coalesce("numsum", F.lit(0)))


def concentration(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Per interaction and year: normalised sum of squared unit shares over all papers so far, where a
    paper gives each of its units 1 / their number. 1: one unit has all; 1 / units: all alike.

    The sum of squares after each year is carried by differences: a unit's total changes only in the
    years it publishes, so each (unit, year) adds new^2 - old^2 and no year is rescanned.
    """
    e = claims.select(*PAIR, "year", "pmid").distinct().join(units, "pmid")
    share = e.withColumn("s", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "year", "pmid")))
    per = share.groupBy(*PAIR, "unit", "year").agg(F.sum("s").alias("s"))
    w = Window.partitionBy(*PAIR, "unit").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    new = F.sum("s").over(w)
    grown = per.withColumn("new", new).withColumn("first", F.row_number().over(Window.partitionBy(*PAIR, "unit").orderBy("year")) == 1)
    old = F.col("new") - F.col("s")
    delta = grown.groupBy(*PAIR, "year").agg(F.sum(F.col("new") * F.col("new") - old * old).alias("d2"), F.sum("s").alias("d"), F.sum(F.col("first").cast("long")).alias("du"))
    run = Window.partitionBy(*PAIR).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    x = delta.withColumns({"q": F.sum("d2").over(run), "t": F.sum("d").over(run), "n_units": F.sum("du").over(run)})
    raw = F.col("q") / (F.col("t") * F.col("t"))
    x = x.withColumn("hi", F.when(F.col("n_units") > 1, (raw - F.lit(1.0) / F.col("n_units")) / (F.lit(1.0) - F.lit(1.0) / F.col("n_units"))).otherwise(F.lit(1.0)))
    return x.withColumn("previous_hi", F.lag("hi").over(Window.partitionBy(*PAIR).orderBy("year"))).select(*PAIR, "year", "n_units", "hi", "previous_hi")


def unit_classes(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Papers of an interaction with the same set of units, as classes: representative (lowest pmid), size and units."""
    lists = units.groupBy("pmid").agg(F.sort_array(F.collect_set("unit")).alias("units"))
    c = claims.select(*PAIR, "pmid").distinct().join(lists, "pmid")
    return c.groupBy(*PAIR, "units").agg(F.min("pmid").alias("pmid"), F.count(F.lit(1)).alias("members"))


def class_members(claims: DataFrame, units: DataFrame) -> DataFrame:
    """One row per paper of an interaction with its class of equal unit sets (`class`: lowest pmid) and
    the class's size. Papers of a class have similarity 1; with the pairs of classes that gives all pairs."""
    lists = units.groupBy("pmid").agg(F.sort_array(F.collect_set("unit")).alias("units"))
    papers = claims.select(*PAIR, "pmid").distinct().join(lists, "pmid")
    classes = unit_classes(claims, units).withColumnRenamed("pmid", "class")
    return papers.join(classes, [*PAIR, "units"]).select(*PAIR, "pmid", "class", "members")


def similar_papers(claims: DataFrame, units: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of unit-set classes of an interaction with Jaccard similarity >= least, with class sizes.

    Prefix filter: in the order from rare to frequent units, two sets that similar share one of the
    first n - ceil(least * n) + 1 units of each, so only those are joined on. Copies are not expanded;
    `class_members` has them.
    """
    classes = cut(unit_classes(claims, units).withColumn("id", F.struct(*PAIR, "pmid")))
    freq = classes.select(*PAIR, F.explode("units").alias("unit")).groupBy(*PAIR, "unit").agg(F.count(F.lit(1)).alias("f"))
    exploded = classes.select(*PAIR, "pmid", F.explode("units").alias("unit")).join(freq, [*PAIR, "unit"])
    w = Window.partitionBy(*PAIR, "pmid")
    ranked = exploded.withColumn("r", F.row_number().over(w.orderBy("f", "unit"))).withColumn("n", F.count(F.lit(1)).over(w))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select(*PAIR, "unit", "pmid", "n")
    a, b = prefix.withColumnRenamed("pmid", "a").withColumnRenamed("n", "na"), prefix.withColumnRenamed("pmid", "b").withColumnRenamed("n", "nb")
    long_enough = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    pairs = a.join(b, [*PAIR, "unit"]).where((F.col("a") < F.col("b")) & long_enough).select(*PAIR, "a", "b").distinct()
    u = lambda n: classes.select(*PAIR, F.col("pmid").alias(n), F.col("units").alias("u" + n), F.col("members").alias("members_" + n))
    full = pairs.join(u("a"), [*PAIR, "a"]).join(u("b"), [*PAIR, "b"])
    j = F.size(F.array_intersect("ua", "ub")) / F.size(F.array_union("ua", "ub"))
    return full.withColumn("jaccard", j).where(F.col("jaccard") >= least - 1e-12).select(*PAIR, "a", "b", "members_a", "members_b", "jaccard")


def projected_weights(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Weighted projection of each interaction's papers: Jaccard similarity of the unit sets of every two
    papers that share a unit, `up, dn, a < b, weight`. (Others have weight 0, and papers without units no
    row.) Found from the units, so no two unrelated papers meet; it does not depend on the window."""
    e = claims.select(*PAIR, "pmid").distinct().join(units, "pmid")
    size = units.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"))
    a, b = e.withColumnRenamed("pmid", "a"), e.withColumnRenamed("pmid", "b")
    shared = a.join(b, [*PAIR, "unit"]).where("a < b").groupBy(*PAIR, "a", "b").agg(F.count(F.lit(1)).alias("s"))
    full = shared.join(size.select(F.col("pmid").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("pmid").alias("b"), F.col("n").alias("nb")), "b")
    return full.select(*PAIR, "a", "b", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("weight"))


def summed_weights(parts: list[DataFrame]) -> DataFrame:
    """Several projections as one: weights added, divided by the largest of the interaction."""
    every = reduce(DataFrame.unionByName, parts).groupBy(*PAIR, "a", "b").agg(F.sum("weight").alias("weight"))
    top = every.groupBy(*PAIR).agg(F.max("weight").alias("__cw_top"))
    return every.join(top, PAIR).withColumn("weight", F.col("weight") / F.col("__cw_top")).drop("__cw_top")


def window_pairs(weights: DataFrame, windows: DataFrame) -> DataFrame:
    """The projection inside each window: pairs of which both papers are in it."""
    key = [*PAIR, "look"]
    a, b = windows.select(*key, F.col("pmid").alias("a")).distinct(), windows.select(*key, F.col("pmid").alias("b")).distinct()
    return weights.join(a, [*PAIR, "a"]).join(b, [*key, "b"]).select(*key, "a", "b", "weight")


def windowed_similarities(claims: DataFrame, sources: list[DataFrame], width: int) -> DataFrame:
    """As `window_pairs` of `summed_weights` of `projected_weights` of each source of units, over the windows of `rank_windowed`:
    `up, dn, look, a, b, weight`. A paper carries its number of units and the rank of its year, so each pair is summed up once
    for all sources, and meets the looks it is in without its papers' rows. `claims` has a row per (up, dn, pmid)."""
    papers = claims.select(*PAIR, "year", "pmid").distinct()
    years = papers.select(*PAIR, "year").distinct().withColumn("r", F.row_number().over(Window.partitionBy(*PAIR).orderBy("year")))
    ranked = papers.join(years, [*PAIR, "year"]).select(*PAIR, "r", "pmid")
    sized = [u.join(u.groupBy("pmid").agg(F.count(F.lit(1)).alias("n")), "pmid").withColumn("source", F.lit(i)) for i, u in enumerate(sources)]
    e = ranked.join(reduce(DataFrame.unionByName, sized), "pmid")
    end = lambda x: e.select(*PAIR, "source", "unit", F.col("pmid").alias(x), F.col("n").alias("n" + x), F.col("r").alias("r" + x))
    met = end("a").join(end("b"), [*PAIR, "source", "unit"]).where("a < b")
    parts = []
    for i in range(len(sources)):
        mine = F.col("source") == i
        s, n = F.count(F.when(mine, 1)), F.max(F.when(mine, F.col("na") + F.col("nb")))
        parts.append(F.coalesce(s / (n - s), F.lit(0.0)))
    pairs = cut(met.groupBy(*PAIR, "a", "b", "ra", "rb").agg(reduce(lambda x, y: x + y, parts).alias("weight")))
    top = pairs.groupBy(*PAIR).agg(F.max("weight").alias("__cw_top"))
    near = pairs.where(F.abs(F.col("ra") - F.col("rb")) < width).withColumn("r", F.explode(F.sequence(F.greatest("ra", "rb"), F.least("ra", "rb") + (width - 1))))
    looks = years.withColumnRenamed("year", "look").join(top, PAIR)
    return near.join(looks, [*PAIR, "r"]).select(*PAIR, "look", "a", "b", (F.col("weight") / F.col("__cw_top")).alias("weight"))


def previous_degrees(claims: DataFrame) -> DataFrame:
    """Degrees of both ends of each claim in the graph of all earlier years (0 where a gene is new).

    A neighbour counts from the first year it is seen, so degrees are running counts of first years:
    no yearly graph is built.
    """
    first = claims.groupBy(*PAIR).agg(F.min("year").alias("year"))
    def grown(gene: str, name: str) -> DataFrame:
        per = first.groupBy(F.col(gene).alias("gene"), "year").agg(F.count(F.lit(1)).alias("n"))
        return per.withColumn(name, F.sum("n").over(Window.partitionBy("gene").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))).select("gene", "year", name)
    from claimweave.operators.relational import asof_previous
    out = claims.select("claim_id", *PAIR, "year")
    for end in PAIR:
        for gene, kind in (("up", "out"), ("dn", "in")):
            name = f"{end}_{kind}"
            right = grown(gene, name).withColumnRenamed("gene", end)
            out = asof_previous(out, right, [end], "year", name, name).withColumn(name, F.coalesce(name, F.lit(0)))
    return out
