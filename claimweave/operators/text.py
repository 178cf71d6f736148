"""Strings: affiliation and author lists, tokens, edit distances, nearest entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented Latin letters and what they are folded to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēęěğīłńňōőŕřśšşťţūůűźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeegilnnoorrsssttuuuzzz"
#: English words without meaning of their own.
STOP_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]


def ascii_lower(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def affiliation_units(c: str = "affs") -> Column:
    """Organisations of an affiliation field: bracketed text dropped, split at pipes, first comma
    part, "& " dropped, trimmed, lower case, distinct, empty ones dropped."""
    text = F.regexp_replace(F.col(c), r"\[[^\]]*\]", "")
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(F.replace(F.lower(F.split(p, ",")[0]), F.lit("& "), F.lit(""))))
    return F.filter(F.array_distinct(parts), lambda p: p != "")


def split_phrases(c: Column, sep: str = ",", fold: bool = True, cut_brackets: bool = True) -> Column:
    text = ascii_lower(c) if fold else F.lower(c)
    text = F.regexp_replace(text, r"\[[^\]]*\]|\([^)]*\)", "") if cut_brackets else text
    return F.transform(F.split(F.regexp_replace(text, " +", " "), sep), lambda p: F.trim(p))


def tokens(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of a phrase in order, without stop words and enclosing marks."""
    words = F.transform(F.split(c, " "), lambda w: F.regexp_replace(w, "^[.\"']+|[.\"']+$", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(stop))


def clean_tokens(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct lower-case ASCII words in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(ascii_lower(c), F.lit(r"(\w+)"), 1), lambda w: ~w.isin(stop)))


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the shorter length; null where one is empty."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.levenshtein(a, b) / n)


def edit_root(a: Column, b: Column) -> Column:
    """Smallest edit distance of the shorter string to an equally long part of the longer one, over its length."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n, d = F.length(short), F.length(long) - F.length(short)
    return F.when(n > 0, F.array_min(F.transform(F.sequence(F.lit(0), d), lambda k: F.levenshtein(short, F.substring(long, k + 1, n)))) / n)


def word_distance(a: Column, b: Column) -> Column:
    """Phrase distance: for each word of `a` the best edit ratio among words of `b` with its place;
    root mean square of the value part and the order part, capped at 1. Empty phrases: 1."""
    na, nb = F.size(a), F.size(b)

    def best(w: Column, i: Column) -> Column:
        options = F.transform(b, lambda v, j: F.struct(F.coalesce(edit_ratio(w, v), F.lit(1.0)).alias("d"), F.abs(i - j).alias("o")))
        return F.array_min(options)

    # An expression of two nested lambdas: words of a phrase are few.
    found = F.transform(a, best)
    value = F.aggregate(found, F.lit(0.0), lambda s, x: s + F.least(x["d"], F.lit(1.0)) * F.least(x["d"], F.lit(1.0))) / na
    order = F.aggregate(found, F.lit(0.0), lambda s, x: s + x["o"] * x["o"]) / (na * F.greatest(na, nb) * F.greatest(na, nb))
    return F.when((na > 0) & (nb > 0), F.least(F.lit(1.0), F.sqrt(value + order))).otherwise(F.lit(1.0))


def nearest_entity(items: DataFrame, entities: DataFrame, item: str, entity: str, accept: float, unknown: str | None = None) -> DataFrame:
    """Each distinct item with its nearest entity by edit ratio (accents and case apart), accepted below
    `accept` (ties: first in order), else `unknown`.

    Exact: of an entity within the ratio at least one of the item's, or entity's, parts stands unchanged
    in the other (`near_pairs`), so only those are compared and no item meets all entities.
    """
    from claimweave.operators.models import near_pairs

    i = items.select(item).distinct().where(F.col(item).isNotNull())
    folded = lambda df, c, n: df.select(F.col(c).alias(n), ascii_lower(F.col(c)).alias("__cw_" + n)).distinct()
    a, b = folded(i, item, "i"), folded(entities.where(F.col(entity).isNotNull()), entity, "e")
    close = near_pairs(a.select(F.col("__cw_i").alias("s")), "s", accept, b.select(F.col("__cw_e").alias("s")))
    pairs = a.join(close.select(F.col("item").alias("__cw_i"), F.col("other").alias("__cw_e")), "__cw_i").join(b, "__cw_e") \
        .unionByName(a.join(b.withColumn("__cw_i", F.col("__cw_e")), "__cw_i"))
    d = F.round(edit_ratio(F.col("__cw_i"), F.col("__cw_e")), 9)
    best = pairs.withColumn("d", d).where(F.col("d") < accept).groupBy("i").agg(F.min(F.struct(F.col("d").alias("distance"), F.col("e"))).alias("b"))
    return i.join(best.select(F.col("i").alias(item), "b"), item, "left").select(
        item, F.coalesce(F.col("b.e"), F.lit(unknown)).alias(entity), F.col("b.distance").alias("distance"))


def phrases(c: Column, sep: str = ",", stop: list[str] = STOP_WORDS) -> Column:
    """Phrases of a string as arrays of words, without those that have none left: an empty array is garbage."""
    return F.filter(F.transform(split_phrases(c, sep), lambda p: tokens(p, stop)), lambda ws: F.size(ws) > 0)


def rooted_phrases(found: Column, targets: list[str], back: list[str]) -> Column:
    """Phrases with a word that holds a target, with a word that is a back target, or right before one of the first."""
    t = F.array(*[F.lit(x) for x in targets])
    hit = lambda p: F.exists(p, lambda w: F.exists(t, lambda x: F.contains(w, x)))
    own = lambda p: F.exists(p, lambda w: w.isin(back))
    return F.filter(found, lambda p, i: hit(p) | own(p) | F.coalesce(hit(F.get(found, i + 1)), F.lit(False)))


def unit_lists(df: DataFrame, key: str, units: Column) -> DataFrame:
    """`key` with the dense codes of its distinct units, ascending; keys without units are left out."""
    from claimweave.operators.windows import dense_codes

    e = df.select(key, F.explode(units).alias("unit")).where(F.col(key).isNotNull() & (F.col("unit") != "")).distinct()
    codes = dense_codes(e.select("unit").distinct(), ["unit"], "code")
    return e.join(codes, "unit").groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("units"))


def phrase_metric(a: Column, b: Column) -> Column:
    """Distance of two phrases (arrays of words): each word of the shorter one goes to its nearest word of the
    longer one by the edit ratio over the longer length; root of the mean of the mean squared ratio and of
    the squared displacement of their order over the largest there can be. 1 where one is empty.

    Ties go to the first word. Words of a phrase are few; the phrase is one expression.
    """
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    ratio = lambda v, w: F.round(F.levenshtein(v, w) / F.greatest(F.length(v), F.length(w), F.lit(1)), 9)
    # Ratio and place of the nearest word of each, in the order of the shorter phrase.
    near = F.transform(short, lambda v: F.array_min(F.transform(long, lambda w, j: F.struct(ratio(v, w).alias("d"), j.alias("j")))))
    n = F.size(short)
    value = F.aggregate(near, F.lit(0.0), lambda s, x: s + x["d"] * x["d"]) / n
    places = F.array_sort(F.transform(near, lambda x: x["j"]))
    again = F.transform(short, lambda v: F.array_min(F.transform(places, lambda j, k: F.struct(ratio(v, F.get(long, j)).alias("d"), k.alias("k"))))["k"])
    moved = F.aggregate(F.transform(again, lambda k, i: (k - i) * (k - i)), F.lit(0).cast("int"), lambda s, x: s + x)
    k = F.floor(n / 2)
    worst = F.when(n % 2 == 1, F.floor(4 * k * (k + 1) * (2 * k + 1) / 3)).otherwise(F.floor(2 * k * (2 * k + 1) * (2 * k - 1) / 3))
    order = F.when(n > 1, moved / worst).otherwise(F.lit(0.0))
    return F.when(n > 0, F.least(F.lit(1.0), F.sqrt((value + order) / 2))).otherwise(F.lit(1.0))


def least_phrase_metric(a: Column, b: Column) -> Column:
    """The least distance of any phrase of one list to any of the other, at most 1."""
    every = F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: phrase_metric(p, q))))
    return F.least(F.lit(1.0), F.coalesce(F.array_min(every), F.lit(1.0)))


def word_phrase_distance(a: Column, b: Column, same: float = 0.1) -> Column:
    """Distance of phrases by words: words closer than `same` count as one letter, the two phrases of such
    letters are compared by the edit ratio over the longer one, and the root mean square is taken of that and
    of the words' own distances. Not symmetric where lengths are equal, as words are matched from `b`."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    ratio = lambda v, w: F.round(F.levenshtein(v, w) / F.greatest(F.length(v), F.length(w), F.lit(1)), 9)
    near = F.transform(long, lambda w: F.array_min(F.transform(short, lambda v, i: F.struct(ratio(v, w).alias("d"), i.alias("i")))))
    letter = lambda i: F.char(i + F.lit(97))
    first = F.array_join(F.transform(short, lambda _, i: letter(i)), "")
    second = F.array_join(F.transform(near, lambda x, j: F.when(x["d"] < same, letter(x["i"])).otherwise(letter(F.size(short) + j))), "")
    words = F.sqrt(F.aggregate(near, F.lit(0.0), lambda s, x: s + x["d"] * x["d"]) / F.size(near))
    letters = F.levenshtein(first, second) / F.greatest(F.length(first), F.length(second))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.sqrt((words * words + letters * letters) / 2)).otherwise(F.lit(1.0))
