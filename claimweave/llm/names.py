"""Variant spellings of names, by noisy-channel attribution.

A spelling is read as a form: for persons (surname, given name, initial, middle initial) whatever the
order, case, accents and separators; for organisations (name words, kind words), where kind words
are those many organisations share, with their abbreviations and typing errors resolved against that
learned list. A word is an abbreviation of a kind word that it begins if a dot marks it, if it is
listed, or if it was seen in its place beside the names of several organisations; else it is a name
("Tech Institute" is not the "Institute of Technology"). Spellings of one form belong together. Forms are then ranked by frequency and fullness
as canonical forms, and each form is attached to the candidate of highest posterior: the candidate's
frequency prior times the likelihood of what separates the two: an initial for a name, a short form
of it, a dropped middle initial, accented letters written as two (oe, ue, aa), one typing error (insertion, deletion, substitution or swap) in the
given name or in the surname. A form that is explained by no candidate stays by itself.

Scale: everything happens on distinct spellings. Candidates come from equal keys (surname or one
letter less of it, with the given name, its short forms, one letter less of it, or the initial; of a
long word both ends in place of one letter less, as one error leaves an end as it is), so a key's
block holds namesakes only and no pairs of unrelated names are made. In a block only forms of
initials meet all the given names of a surname; they are as many as there are initials. Attribution is one
`max_by` a form; links form trees, which are resolved with the frontier components operator.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.linked_splits import components
from claimweave.session import cut

# Short forms in use, with the given names they stand for.
SHORT_FORMS = {
    "alex": "alexander aleksandr alexandra", "andy": "andrew anders", "beppe": "giuseppe", "becky": "rebecca", "bella": "isabella",
    "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "bob": "robert", "cathy": "catherine katherine",
    "chris": "christopher christian christine", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "dima": "dmitri dmitry",
    "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward", "ferdi": "ferdinand", "fran": "francisco francesca",
    "fred": "frederick alfred", "fritz": "friedrich", "gabi": "gabriella gabriele", "greg": "gregory", "hans": "johannes", "jackie": "jacqueline",
    "jake": "jacob", "jan": "johannes", "jeff": "jeffrey", "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan",
    "kate": "katherine catherine", "kathy": "katherine", "katya": "ekaterina", "ken": "kenneth", "larry": "lawrence", "lena": "magdalena helena",
    "liz": "elizabeth", "lucy": "lucia", "maggie": "margaret", "magda": "magdalena", "meg": "margaret", "mike": "michael", "misha": "mikhail",
    "nacho": "ignacio", "ned": "edward", "nick": "nicholas", "paco": "francisco", "pat": "patricia patrick", "peggy": "margaret",
    "pepe": "jose", "pete": "peter", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "sam": "samuel samantha",
    "sasha": "aleksandr alexander", "sepp": "josef", "steve": "stephen steven", "sue": "susanna susan", "susie": "susanna susan", "ted": "theodore edward",
    "theo": "theodore", "tim": "timothy", "toby": "tobias", "tom": "thomas tomas", "tony": "anthony antonio", "trish": "patricia",
    "vicky": "victoria", "volodya": "vladimir", "vova": "vladimir", "will": "william", "wolf": "wolfgang",
}
# Abbreviations of kind words in common use, known without being marked by a dot.
ABBREVIATIONS = {"u", "univ", "inst", "institut", "hosp", "bio", "biosci", "biochem", "biol", "genet", "immunol", "lab", "neurosci", "oncol", "pharmacol", "physiol"}
# Words that do not tell organisations apart (articles, links, legal forms).
EMPTY_WORDS = {"of", "the", "and", "for", "de", "la", "di", "du", "der", "die", "und", "et", "at", "in", "ltd", "limited", "inc", "llc", "plc", "gmbh", "ag", "co", "corp", "sa"}
#: Share of all organisation spellings from which a word is a kind word. It bounds their list.
KIND_SHARE = 0.01
#: Organisations beside which a word must be seen in place of the kind word it begins to abbreviate it.
SEEN_SHORT = 3
#: Log likelihoods of the channels.
TYPO_SURNAME, TYPO_GIVEN, SHORT, INITIAL, PAIRED, NO_MIDDLE, ADDED_MIDDLE = -5.0, -4.5, -3.0, -2.0, -1.5, -1.0, -6.0
#: A typed error is rarer than the form it comes from by this factor at least.
RARER = 0.2

_FOLD = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ı": "i"})
_LETTERS = re.compile(r"[^\W\d_]+")
# Two-letter spellings of accented letters, and what the first group of each stands for.
PAIRS = "(a)[ae]+|(o)e+|(u)e+"
#: Words with more letters have their two ends as keys in place of one letter less.
LONG = 16


@lru_cache(100_000)
def fold(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_FOLD)) if not unicodedata.combining(c))


def person_readings(spelling: str) -> list[tuple[str, str, str, str]]:
    """(surname, given, initial, middle) the spelling can stand for, lower case without accents; middle
    are all initials after the first; given is empty where there are only initials. Without a comma two long words give two readings.
    A spelling without letters reads as itself."""
    text = fold(spelling)
    caps = text.upper() == text
    surname, comma, rest = text.partition(",")

    def given_part(words: list[str]) -> tuple[str, str, str]:
        given, initials = "", ""
        for w in words:
            if not given and not initials and (len(w) > 2 if caps else len(w) > 3 or (len(w) > 1 and not w.isupper())):
                given = w.lower()
            else:
                initials += w.lower() if len(w) <= 3 and (w.isupper() or len(w) == 1) else w[0].lower()
        if given:
            return given, given[0], initials
        return "", initials[:1], initials[1:]

    if comma and _LETTERS.search(surname) and _LETTERS.search(rest):
        return [(" ".join(_LETTERS.findall(surname)).lower(), *given_part(_LETTERS.findall(rest)))]
    words = _LETTERS.findall(text)
    long = [i for i, w in enumerate(words) if (len(w) > 2 if caps else len(w) > 3 or (len(w) > 1 and not w.isupper()))]
    if not words:
        return [(spelling.strip().lower(), "", "", "")]
    if len(long) < 2:
        at = long[0] if long else 0
        return [(words[at].lower(), *given_part(words[:at] + words[at + 1 :]))]
    out = []
    for i in (long[-1], long[0]):
        out.append((words[i].lower(), *given_part(words[:i] + words[i + 1 :])))
    return out


def organisation_words(spelling: str) -> list[str]:
    """Lower-case words without accents; parts joined by a hyphen stay joined by one."""
    return [w for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", fold(spelling).lower())]


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i + 1 : i - 1 if i else None : -1] and a[i + 2 :] == b[i + 2 :])


def marked_short(spelling: str) -> set[str]:
    """The words a dot marks as cut short."""
    return set(re.findall(r"[^\W\d_]+(?=\.)", fold(spelling).lower()))


def organisation_form(words: list[str], kinds: dict[str, int], short: set[str] = frozenset()) -> tuple[str, str]:
    """(name words, kind words), each sorted; `kinds` are the learned kind words with frequencies,
    `short` the words that may abbreviate them."""
    known = frozenset(kinds)
    full = sorted(kinds, key=lambda k: (-kinds[k], k))

    def resolve(w: str) -> str | None:
        if w in EMPTY_WORDS:
            return ""
        if w in short:
            longer = [k for k in full if len(k) > len(w) and k.startswith(w) and kinds[k] > kinds.get(w, 0) * 0.2]
            if longer:
                return resolve(longer[0]) or longer[0] if longer[0] != w else w
        if w in known:
            return w
        if len(w) >= 4:
            close = [k for k in full if len(k) >= 4 and near(w, k)]
            if close:
                return resolve(close[0])
        return None

    names, kind = [], []
    for w in words:
        parts = [w]
        if "-" in w:
            joined = w.replace("-", "")
            parts = [joined] if resolve(joined) else w.split("-")
        for p in parts:
            r = resolve(p)
            if r is None:
                names.append(p)
            elif r:
                kind.append(r)
    return " ".join(sorted(names)), " ".join(sorted(set(kind)))


def spelling_counts(lists: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """`field`, `spelling`, `n` over the array expressions in `fields`; null and empty lists give none."""
    def named(field: str, spellings: Column) -> Column:
        return F.transform(F.coalesce(spellings, F.array().cast("array<string>")), lambda s: F.struct(F.lit(field).alias("field"), s.alias("spelling")))

    parts = F.array(*[named(f, e) for f, e in fields.items()])
    return lists.select(F.explode(F.flatten(parts)).alias("x")).groupBy("x.field", "x.spelling").agg(F.count(F.lit(1)).alias("n"))


FORM = "field string, spelling string, n long, head string, body string, init string, mid string"


def person_forms(counts: DataFrame) -> DataFrame:
    """A row per spelling with its form. Of two readings the one is taken whose surname and given
    name are better known from the spellings that have a comma or one reading only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, s, n, i, len(r), *x) for f, s, n in zip(pdf["field"], pdf["spelling"], pdf["n"])
                    for r in [person_readings(s)] for i, x in enumerate(r)]
            yield pd.DataFrame(rows, columns=["field", "spelling", "n", "at", "readings", "head", "body", "init", "mid"])

    read = cut(counts.mapInPandas(run, "field string, spelling string, n long, at int, readings int, head string, body string, init string, mid string"))
    sure, open_ = read.where("readings = 1"), read.where("readings > 1")
    known = sure.where("body <> ''")
    heads = known.groupBy("field", "head").agg(F.sum("n").alias("head_n"))
    bodies = known.groupBy("field", "body").agg(F.sum("n").alias("body_n"))
    shorts = F.array_contains(F.array(*[F.lit(x) for x in SHORT_FORMS]), F.col("body")).cast("int")
    fit = F.log1p(F.coalesce("head_n", F.lit(0))) + F.log1p(F.coalesce("body_n", F.lit(0))) + shorts
    chosen = open_.join(heads.hint("merge"), ["field", "head"], "left").join(bodies.hint("merge"), ["field", "body"], "left").groupBy("field", "spelling", "n").agg(
        F.max_by(F.struct("head", "body", "init", "mid"), F.struct(fit, -F.col("at"))).alias("f")).select("field", "spelling", "n", "f.*")
    return sure.select("field", "spelling", "n", "head", "body", "init", "mid").unionByName(chosen)


def seen_short(counts: DataFrame, kinds: dict[str, int]) -> set[str]:
    """Words seen in place of a kind word that they begin, beside the same name words, for at least
    `SEEN_SHORT` sets of name words. There are at most as many as the kind words have letters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf["spelling"]:
                words = {p for w in organisation_words(s) for p in w.split("-")} - EMPTY_WORDS
                begins = {w: [k for k in kinds if len(k) > len(w) and k.startswith(w)] for w in words}
                names = " ".join(sorted(w for w in words if w not in kinds and not begins[w]))
                if names:
                    rows += [(k, names, "") for k in words if k in kinds] + [(k, names, w) for w, ks in begins.items() for k in ks]
            yield pd.DataFrame(rows, columns=["kind", "names", "short"], dtype="object")

    if not kinds:
        return set()
    seen = counts.mapInPandas(run, "kind string, names string, short string").groupBy("kind", "names").agg(F.collect_set("short").alias("shorts"))
    both = seen.where(F.array_contains("shorts", "")).select("kind", F.explode("shorts").alias("short")).where("short <> ''")
    return {r["short"] for r in both.groupBy("kind", "short").count().where(F.col("count") >= SEEN_SHORT).select("short").distinct().collect()}


def organisation_forms(counts: DataFrame) -> DataFrame:
    """A row per spelling with its form: head the name words, body the kind words."""
    total = counts.count()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [{p for w in organisation_words(s) for p in w.split("-")} for s in pdf["spelling"]]
            yield pd.DataFrame({"word": [w for ws in words for w in ws]}, dtype="object")

    # Spellings have few words, so at most words / KIND_SHARE of them reach the share: a short list.
    share = counts.mapInPandas(split, "word string").groupBy("word").count().where(F.col("count") >= F.lit(max(KIND_SHARE * total, 4)))
    kinds = {r["word"]: r["count"] for r in share.collect() if r["word"] not in EMPTY_WORDS}
    short = ABBREVIATIONS | seen_short(counts, kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            forms = [organisation_form(organisation_words(s), kinds, short | marked_short(s)) for s in pdf["spelling"]]
            heads = [h or k for h, k in forms]
            yield pdf[["field", "spelling", "n"]].assign(head=heads, body=[k for _, k in forms], init="", mid="")

    return counts.mapInPandas(run, FORM)


def _deletes(c: str) -> Column:
    """Keys of which two words one error apart share one, as do equal words.

    Short words: the word and the word with each one of its letters left out. Words of more than
    `LONG` letters: their first and last h letters. With h half the length less one, an error (which
    touches two neighbouring letters at most) leaves one of the two as it is. Lengths differ by one at
    most, so the ends are taken for h of the length, and of one less where that differs; around
    `LONG` a word has keys of both sorts.
    """
    size = F.length(c)
    gone = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, size)))
    # The h of a word of n letters and of the one that is longer by one are both among those of n - 1 and n.
    ends = F.flatten(F.transform(F.array_distinct(F.array(F.floor((size - 1) / 2), F.floor(size / 2))), lambda half: F.array(
        F.concat(F.lit("<"), F.substring(F.col(c), F.lit(1), half.cast("int") - 1)), F.concat(F.lit(">"), F.substring(F.col(c), size - half.cast("int") + 2, size)))))
    none = F.array().cast("array<string>")
    return F.concat(F.array(F.col(c)), F.when((size > 0) & (size <= LONG + 1), gone).otherwise(none), F.when(size > LONG, ends).otherwise(none))


def _near(a: str, b: str) -> Column:
    x, y, size = F.col(a), F.col(b), F.length(a)
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.concat(
        F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, size)) == y)
    return (x != y) & ((F.levenshtein(x, y) == 1) | ((size == F.length(b)) & (F.levenshtein(x, y) == 2) & swapped))


def _keys(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), "field", *parts)


def attribute(forms: DataFrame) -> DataFrame:
    """`id`, `parent`: each form that a candidate explains, with the candidate of maximal posterior.

    `forms`: distinct `id`, `field`, `head`, `body`, `init`, `mid`, `n`, `lexical` (1 where bodies
    are given names and may be short, abbreviated or mistyped).
    """
    heads = forms.groupBy("field", "head").agg(F.sum("n").alias("head_n"))
    bodies = forms.where("body <> ''").groupBy("field", "body").agg(F.sum("n").alias("body_n"))
    short = F.create_map(*[F.lit(x) for k, v in SHORT_FORMS.items() for x in (k, v)])
    x = forms.join(heads.hint("merge"), ["field", "head"]).join(bodies.hint("merge"), ["field", "body"], "left").withColumn(
        "fulls", F.when(F.col("lexical") == 1, F.split(F.coalesce(short[F.col("body")], F.lit("")), " ")).otherwise(F.array(F.lit(""))))
    x = cut(x.withColumn("flat", F.regexp_replace("head", PAIRS, "$1$2$3")))
    full, lexical = F.col("body") != "", F.col("lexical") == 1
    none = F.array().cast("array<bigint>")
    each = lambda a, make: F.transform(a, make)
    names = F.array_append(F.filter("fulls", lambda s: s != ""), F.col("body"))
    typed = F.when(full & lexical, each(_deletes("body"), lambda d: _keys("t", F.col("head"), d))).otherwise(none)
    of_initial = F.when(lexical & (F.col("init") != ""), F.concat(each(_deletes("head"), lambda d: _keys("x", d, F.col("init"))), F.array(_keys("i", F.col("head"), F.col("init")), _keys("j", F.col("flat"), F.col("init"))))).otherwise(none)
    of_name = lambda ns: F.when(full, F.concat(each(ns, lambda g: _keys("g", F.col("head"), g)), each(ns, lambda g: _keys("f", F.col("flat"), g)), F.flatten(each(ns, lambda g: each(_deletes("head"), lambda d: _keys("s", d, g)))))).otherwise(none)
    own = ["id", "field", "head", "flat", "body", "init", "mid", "n", "head_n", "body_n", "fulls", "lexical"]
    as_variant = F.concat(of_name(names), typed, F.when(~full, of_initial).otherwise(none))
    as_canonical = F.concat(of_name(F.array(F.col("body"))), typed, of_initial)
    v = x.select(*[F.col(c).alias("v_" + c) for c in own], F.explode(F.array_distinct(as_variant)).alias("key"))
    c = x.select(*[F.col(c).alias("c_" + c) for c in own if c not in ("fulls", "lexical")], F.explode(F.array_distinct(as_canonical)).alias("key"))
    # Hinted: the planner takes the exploded rows for as small as the forms and would broadcast them.
    pairs = v.join(c.hint("merge"), "key").where("v_id <> c_id and v_field = c_field")
    same_head, typo_head = F.col("v_head") == F.col("c_head"), _near("v_head", "c_head")
    initials, whole = F.col("v_body") == "", F.col("c_body") != ""
    # The mistyped side is known by its surname's rarity, its own, or by having initials only.
    less = (F.col("v_n") < F.col("c_n")) | ((F.col("v_n") == F.col("c_n")) & (F.col("v_head") > F.col("c_head")))
    rare_head = (F.col("v_head_n") - F.col("v_n") <= RARER * F.col("c_head_n")) & (less | (F.col("v_head_n") < RARER * F.col("c_head_n")) | (initials & whole & (F.col("v_lexical") == 1)))
    paired = F.col("v_flat") == F.col("c_flat")
    head = F.when(same_head, F.lit(0.0)).when(paired, F.lit(PAIRED)).when(typo_head & rare_head, F.lit(TYPO_SURNAME))
    same_body = F.col("v_body") == F.col("c_body")
    typo_body = same_head & (F.col("v_lexical") == 1) & _near("v_body", "c_body") & (F.col("v_body_n") < RARER * F.col("c_body_n")) & ~initials & whole
    body = F.when(initials & whole & (F.col("v_init") == F.col("c_init")) & (F.col("v_lexical") == 1), F.lit(INITIAL)) \
        .when(initials & ~whole & (F.col("v_init") == F.col("c_init")), F.lit(2 * INITIAL)) \
        .when(same_body, F.lit(0.0)).when(F.array_contains("v_fulls", F.col("c_body")), F.lit(SHORT)).when(typo_body, F.lit(TYPO_GIVEN))
    # Middle initials agree as far as both have them: one is the beginning of the other.
    same_mid = F.col("v_mid") == F.col("c_mid")
    mid = F.when(same_mid, F.lit(0.0)).when(F.startswith("c_mid", "v_mid"), F.lit(NO_MIDDLE)).when(F.startswith("v_mid", "c_mid") & ~(same_head & same_body), F.lit(ADDED_MIDDLE))
    likelihood = head + body + mid
    # What leaves both equal but in frequency (one typing error either way) goes to the more frequent one.
    posterior = F.log(F.col("c_n").cast("double")) + likelihood
    return pairs.where(likelihood.isNotNull() & (likelihood < 0)).groupBy(F.col("v_id").alias("id")).agg(
        F.max_by("c_id", F.struct(posterior, -F.col("c_id"))).alias("parent"))


def link_variants(people: DataFrame | None, organisations: DataFrame | None, seed: int = 13) -> DataFrame:
    """`field`, `spelling`, `n`, `entity` for the spelling counts (`field`, `spelling`, `n`) of names
    of people and of organisations.

    Spellings are kept exactly as typed. Equal spellings are one row. Empty tables give no rows;
    spellings without letters are entities by themselves.
    """
    parts = []
    if people is not None:
        parts.append(person_forms(people).withColumn("lexical", F.lit(1)))
    if organisations is not None:
        parts.append(organisation_forms(organisations).withColumn("lexical", F.lit(0)))
    spelled = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    key = ["field", "head", "body", "init", "mid"]
    spelled = cut(spelled.withColumn("id", F.xxhash64(F.lit(seed), *key)))
    forms = spelled.groupBy("id", "lexical", *key).agg(F.sum("n").alias("n"))
    links = cut(attribute(forms))
    roots = components(links.select(F.col("id").alias("a"), F.col("parent").alias("b")))
    return spelled.join(roots.hint("merge"), spelled["id"] == roots["node"], "left").select(
        "field", "spelling", "n", F.coalesce("root", "id").alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """`field`, `name_a` < `name_b` (byte order): pairs of spellings of one entity. A report: its rows
    grow with the square of an entity's spellings. `link_variants` has one row a spelling instead."""
    a = linked.select("field", "entity", F.col("spelling").alias("name_a"))
    b = linked.select("field", "entity", F.col("spelling").alias("name_b"))
    return a.join(b.hint("merge"), ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b")
