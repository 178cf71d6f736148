"""Samples that match target category proportions, by swap repair.

Records are grouped by category signature. For each target set the counts to draw per signature
start from a random sample that satisfies the floors; then the exchange of k records of one
signature for k of another that lowers the squared deviation from the targets most is made until
none improves. Only counts per signature are handled there, so the work depends on the number of
targets and not of records. The counts are then materialised: within each set and cell the rows of
lowest seeded hash are drawn, found through a histogram of the hash that is refined in the one
bucket that is split, so that no task ranks more than `MOST_RANKED` rows of a cell.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket of the hash that may be ranked in a task.
MOST_RANKED = 50_000
HASH_BITS = 60
#: Rows of a histogram of the hash that may come to the driver; more draws mean fewer buckets each.
MOST_BUCKETS = 1 << 18
#: Signatures of steepest and of flattest slope whose exchanges are tried first; cells of one block of all others.
STEEPEST, BLOCK = 64, 1 << 20
HASH, SET = "__cw_h", "__cw_set"


def random_start(available: np.ndarray, floors: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Random counts per signature that hold the floors: floors first, the rest drawn in proportion
    to what is left of each signature."""
    counts = np.minimum(floors, available).astype(np.int64)
    while (rest := size - counts.sum()) > 0 and (left := available - counts).sum() > 0:
        more = np.minimum(rng.multinomial(min(rest, left.sum()), left / left.sum()), left)
        counts += more
    return counts


def swap_repair(counts: np.ndarray, available: np.ndarray, member: np.ndarray, targets: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Exchange signature counts until no exchange lowers the squared deviation of the category counts.

    member: [signature, category] 0/1, so categories may overlap (marginal targets) or be the
    signatures themselves; targets and floors: rows per category. Exchanges are looked for among the
    signatures of steepest and flattest slope, which hold the best one where categories do not
    overlap; before it stops all exchanges are tried, block by block.
    """
    counts, member = counts.astype(np.int64).copy(), member.astype(np.float64)
    norms = (member**2).sum(1)

    def best(give: np.ndarray, take: np.ndarray, slope: np.ndarray, spare: np.ndarray) -> tuple[float, int, int, int]:
        cost = norms[give, None] + norms[None, take] - 2 * member[give] @ member[take].T
        cost[(give[:, None] == take[None, :]) | (cost == 0)] = np.inf
        most = np.minimum(np.minimum(counts[give], spare[give])[:, None], (available - counts)[None, take])
        gain = slope[give, None] - slope[None, take]
        k = np.clip(np.round(gain / cost), 0, most)
        change = k * k * np.where(np.isinf(cost), 0, cost) - 2 * k * gain
        a, b = np.unravel_index(np.argmin(change), change.shape)
        return float(change[a, b]), int(give[a]), int(take[b]), int(k[a, b])

    every = np.arange(len(counts))
    while len(counts) > 1:
        per = counts @ member
        slope = member @ (per - targets)
        spare = np.array([np.floor(np.maximum(per - floors, 0)[m > 0].min()) if (m > 0).any() else np.inf for m in member])
        order = np.argsort(-slope, kind="stable")
        give, take = order[np.minimum(counts, spare)[order] > 0], order[(available - counts)[order] > 0]
        if not len(give) or not len(take):
            break
        found = best(give[:STEEPEST], take[::-1][:STEEPEST], slope, spare)
        if found[0] >= -1e-9 and max(len(give), len(take)) > STEEPEST:
            step = max(BLOCK // len(every), 1)
            found = min(best(give[i : i + step], take, slope, spare) for i in range(0, len(give), step))
        change, a, b, k = found
        if change >= -1e-9:
            break
        counts[a] -= k
        counts[b] += k
    return counts


def plan(available: DataFrame, targets: DataFrame, cell: list[str], total: int, seed: int = 5) -> list[dict]:
    """Counts to draw per set and cell. `available`: cell and `count`; `targets`: `set_id`, cell,
    `share`, `min_rows`, `draw_frac`. Targets are a report's rows, stated by hand, and are held here."""
    rows = targets.collect()
    have = {tuple(r[c] for c in cell): r["count"] for r in available.collect()}
    sets, out = defaultdict(list), []
    for r in rows:
        sets[r["set_id"]].append(r)
    for set_id, members in sorted(sets.items()):
        share = np.array([r["share"] or 0.0 for r in members])
        share = share / share.sum() if share.sum() > 0 else share
        least = np.array([r["min_rows"] or 0 for r in members], np.int64)
        frac = max(r["draw_frac"] or 0.0 for r in members)
        avail = np.array([have.get(tuple(r[c] for c in cell), 0) for r in members], np.int64)
        floors = np.minimum(least, avail)
        size = int(min(max(round(frac * total), floors.sum()), avail.sum()))
        start = random_start(avail, floors, size, np.random.default_rng([seed, zlib.crc32(str(set_id).encode())]))
        drawn = swap_repair(start, avail, np.eye(len(members)), share * size, floors)
        for r, s, a, n in zip(members, share, avail, drawn):
            needed = max(float(r["min_rows"] or 0), s * frac * total)
            out.append({"set_id": set_id} | {c: r[c] for c in cell} | {
                "target_share": float(s), "available": int(a), "needed": float(needed), "drawn": int(n),
                "drawn_share": float(n / drawn.sum()) if drawn.sum() else 0.0, "cannot_be_met": bool(a < needed)})
    return out


REPORT = "target_share double, available long, needed double, drawn long, drawn_share double, cannot_be_met boolean"


def sample_to_targets(records: DataFrame, targets: DataFrame, cell: dict[str, Column], ids: list[str], seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    `cell` names the category columns and gives them for a record; a record for which one is null is
    not eligible. The sample has the ids, `set_id` and the cell; the report a row per target with the
    rows available, needed (`greatest(min_rows, share * draw_frac * eligible rows)`), drawn, and
    whether the target cannot be met. Where cells fall short the others fill up in proportion to
    what lowers the deviation, as long as there are rows. Repeated rows count as rows; rows with
    equal ids rank arbitrarily among each other. No records: an empty sample, every target unmet
    that needs a row. Duplicate targets of a cell in a set are drawn as separate targets of it only
    for their report; give each cell once.
    """
    names = list(cell)
    x = records.select(*ids, *[e.alias(n) for n, e in cell.items()]).dropna(subset=names)
    counted = x.groupBy(*names).count()
    counted.cache()
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    kinds = ", ".join(f"{n} {x.schema[n].dataType.simpleString()}" for n in names)
    t = targets.select("set_id", *[F.col(n).cast(x.schema[n].dataType) for n in names], "share", "min_rows", "draw_frac")
    wanted = F.broadcast(t.select(*names).distinct())
    rows = plan(counted.join(wanted, names, "left_semi"), t, names, total, seed)
    counted.unpersist()
    kind = t.schema["set_id"].dataType.simpleString()
    report = records.sparkSession.createDataFrame([tuple(r.values()) for r in rows], f"set_id {kind}, {kinds}, {REPORT}")
    return _draw(x, rows, names, ids, kind, kinds, seed), report


def _draw(x: DataFrame, rows: list[dict], names: list[str], ids: list[str], kind: str, kinds: str, seed: int) -> DataFrame:
    spark = x.sparkSession
    keyed = {(r["set_id"], *[r[n] for n in names]): r["drawn"] for r in rows if r["drawn"]}
    # Each draw is an interval of the hash that is open (`low`, whole buckets below it are in) and
    # how many rows of the bucket [low, low + width) are still due.
    have = {(r["set_id"], *[r[n] for n in names]): r["available"] for r in rows}
    open_ = {k: {"low": 0, "bits": HASH_BITS, "due": n, "rows": have[k], "done": have[k] <= MOST_RANKED} for k, n in keyed.items()}
    cells = spark.createDataFrame([k for k in keyed], f"{SET} {kind}, {kinds}")
    hashed = x.join(F.broadcast(cells), names).withColumn(
        HASH, F.shiftrightunsigned(F.xxhash64(F.lit(seed), SET, *ids), 64 - HASH_BITS))
    while todo := {k: v for k, v in open_.items() if not v["done"]}:
        # As many buckets as bring the fullest cell's down to a quarter of what a task may rank.
        wanted = (4 * max(v["rows"] for v in todo.values()) // MOST_RANKED).bit_length()
        fine = max(min(wanted, (MOST_BUCKETS // len(todo)).bit_length() - 1), 1)
        bits = max(max(v["bits"] for v in todo.values()) - fine, 0)
        bounds = spark.createDataFrame([(*k, v["low"], v["low"] + (1 << v["bits"])) for k, v in todo.items()], f"{SET} {kind}, {kinds}, __cw_low long, __cw_high long")
        hist = hashed.join(F.broadcast(bounds), [SET, *names]).where((F.col(HASH) >= F.col("__cw_low")) & (F.col(HASH) < F.col("__cw_high"))) \
            .groupBy(SET, *names, F.shiftright(HASH, bits).alias("__cw_b")).count().collect()
        per = defaultdict(list)
        for r in hist:
            per[(r[SET], *[r[n] for n in names])].append((r["__cw_b"], r["count"]))
        for k, v in todo.items():
            for b, n in sorted(per[k]):
                if n >= v["due"]:
                    v |= {"low": b << bits, "bits": bits, "rows": n, "done": n <= MOST_RANKED or bits == 0}
                    break
                v["due"] -= n
    limits = spark.createDataFrame([(*k, v["low"], v["low"] + (1 << v["bits"]), v["due"]) for k, v in open_.items()],
                                   f"{SET} {kind}, {kinds}, __cw_low long, __cw_high long, __cw_due long")
    held = hashed.join(F.broadcast(limits), [SET, *names])
    out = [*ids, F.col(SET).alias("set_id"), *names]
    whole = held.where(F.col(HASH) < F.col("__cw_low")).select(*out)
    w = Window.partitionBy(SET, *names).orderBy(HASH, *ids)
    edge = held.where((F.col(HASH) >= F.col("__cw_low")) & (F.col(HASH) < F.col("__cw_high"))) \
        .withColumn("__cw_rank", F.row_number().over(w)).where(F.col("__cw_rank") <= F.col("__cw_due")).select(*out)
    return whole.unionByName(edge)
