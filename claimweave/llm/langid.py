"""Languages of documents and of the segments in them.

Multinomial naive Bayes over hashed character 2- to 4-grams of sentences. The languages are those the
labels at hand name; notations are taken from the runtime's table of ISO 639 codes and names and from
a dictionary of further ones. The model is fitted on a bounded sample of labelled documents in two
rounds: first each sentence counts for its document's label, then for the language the first model
gives it, so that wrong labels and mixed documents drop out; a label whose documents another language
explains as well as its own is no language. The matrix of log probabilities is broadcast (its size is
fixed by `BUCKETS` and the languages); a batch of sentences is scored by gathering its rows at the
hashes of all grams and summing them per sentence. A document far less likely than documents held out
of the fit were under the same language is of a language not known here: `und`. Text is compared
without markup, markers, soft and line-end hyphens, accents, case and words with digits, so none of
these changes a language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.session import cut, drop_cuts

# Language codes with notations that name them, beside their ISO 639 codes and names.
LANGUAGES = {
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english", "englisch"],
    "es": ["es", "spa", "esp", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
    "sv": ["sv", "swe", "swedish", "svenska"],
    "zh": ["zh", "zho", "chi", "chinese", "mandarin", "中文", "汉语", "漢語"],
}
UNKNOWN = "und"
BUCKETS, GRAMS, SMOOTH = 1 << 16, (2, 3, 4), 0.2
_MULT, _SHIFT = np.uint32(0x9E3779B1), np.uint32(16)
#: Labelled documents per language in the fit, about.
FIT_DOCS = 1500
#: Parts of the sample, one of which is held out to see how likely documents are; fewer than LEAST_HELD
#: held-out documents of a language give no bound for it.
PARTS, LEAST_HELD = 10, 30
#: Deviations below the held-out mean log probability a gram at which a document's language is unknown.
FAR = 8.0
#: A label is no language if another explains its documents this well (log probability a gram short of its own documents').
ALIKE = 0.1
#: Least gain in log probability per gram for which a sentence leaves the main language of its document.
LEAVE = 0.15
#: Grams scored at once.
CHUNK = 1 << 17

_END = re.compile(r"[.!?…]+(?:</?\w+>|[\"'»”’)\]])*(?=\s|&nbsp;|$)|[。！？｡]+(?:</?\w+>|[”’」』）])*")
_MARK = re.compile(r"<[/!?|]?[A-Za-z][^<>]*>|\[[A-Z]{2,}\]|&#?\w+;|https?://\S+")
_BREAK = re.compile(r"[-‐]\s*\r?\n[-‐]?\s*|[­​‌‍⁠﻿]")
_DIGITS = re.compile(r"(?<![A-Za-z_\-])[A-Za-z_\-]*\d[\w\-]*", re.ASCII)
_LETTERS = re.compile(r"[^\W\d_]+")
_ACCENT = re.compile(r"[\u0300-\u036f\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_CJK = re.compile(r"[㐀-鿿]")
_DIGIT = re.compile(r"\d", re.ASCII)
#: ASCII letters in lower case, all else a space.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 32 for c in range(256))


def _label_text(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))


def label_code(c: str = "lang", languages: dict[str, list[str]] = LANGUAGES):
    """The language a delivered label names, as a two-letter code, or null: case, spaces, regions
    (`en_US`, `pt-BR`), three-letter codes and names count as notations of it."""
    text = _label_text(c)
    plain = F.split(text, "[-_]")[0]
    pairs = [F.lit(x) for code, names in languages.items() for n in names for x in (n, code)]
    if not pairs:
        return F.lit(None).cast("string")
    named = F.create_map(*pairs)
    return F.coalesce(named[text], named[plain])


def notations(spark: SparkSession, further: dict[str, list[str]] = LANGUAGES) -> dict[str, list[str]]:
    """Two-letter codes with their notations: of every ISO 639-1 language the codes of two and three
    letters and the English and own name, as the Java runtime has them, and `further` ones, which win."""
    locale = spark.sparkContext._jvm.java.util.Locale
    taken = {n: code for code, names in further.items() for n in names}
    for code in sorted(locale.getISOLanguages()):
        x = locale(code)
        try:
            names = [code, x.getISO3Language(), x.getDisplayLanguage(locale.ENGLISH), x.getDisplayLanguage(x)]
        except Exception:  # noqa: BLE001, a code without three letters
            names = [code]
        for n in names:
            if n:
                taken.setdefault(n.lower(), code)
    out: dict[str, list[str]] = {}
    for n, code in taken.items():
        out.setdefault(code, []).append(n)
    return out


def labelled_languages(docs: DataFrame, lang: str = "lang") -> tuple[dict[str, list[str]], dict[str, int]]:
    """(languages that labels name, with their notations; documents of each). Reads the labels only; the
    labels are counted before they are matched, and at most one row a language comes back."""
    known = notations(docs.sparkSession)
    names = F.broadcast(docs.sparkSession.createDataFrame([(n, code) for code, ns in known.items() for n in ns], "name string, code string"))
    text = docs.select(_label_text(lang).alias("name")).where("name is not null").groupBy("name").count()
    plain = text.withColumnRenamed("name", "whole").withColumn("name", F.split("whole", "[-_]")[0])
    found = plain.join(names.withColumnsRenamed({"name": "whole", "code": "a"}), "whole", "left").join(names, "name", "left")
    rows = found.select(F.coalesce("a", "code").alias("code"), "count").where("code is not null").groupBy("code").agg(F.sum("count").alias("n")).collect()
    sizes = {r["code"]: r["n"] for r in sorted(rows, key=lambda r: r["code"])}
    return {c: known[c] for c in sizes}, sizes


@dataclass
class Model:
    """Log probabilities [BUCKETS, language], the languages with their notations, and the log probability
    a gram of a document below which it is of none of them."""

    weights: np.ndarray
    languages: dict[str, list[str]]
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def codes(self) -> list[str]:
        return list(self.languages)

    @property
    def fitted(self) -> bool:
        return self.weights.size > 0 and self.weights.max() > -1e3


def normalise(text: str) -> str:
    """Lower-case letters without accents, words parted by one space; CJK signs are kept."""
    # Most texts hold none of what the patterns take out, and a look for a character is far cheaper.
    if "-" in text or "‐" in text or not text.isascii():
        text = _BREAK.sub("", text)
    if "&" in text or "<" in text or "[" in text or "http" in text:
        text = _MARK.sub("", text.replace("&nbsp;", " "))
    if _DIGIT.search(text):
        text = _DIGITS.sub(" ", text)
    if text.isascii():
        return f" {b' '.join(text.encode().translate(_PLAIN).split()).decode()} "
    text = _ACCENT.sub("", unicodedata.normalize("NFKD", text))
    return f" {' '.join(_LETTERS.findall(text)).lower()} "


def _is_sentence(plain: str) -> bool:
    words = 0
    for w in plain.split():
        if len(w) > 1:
            words += 1
            if words == 3:
                return True
    return not plain.isascii() and len(_CJK.findall(plain)) >= 4


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of the sentences: start is the first character that is no space.
    A piece with fewer than three words and four CJK signs is a list of symbols or names: no sentence."""
    return [(start, end, plain) for start, end, plain, _ in sized_sentences(text)]


def sized_sentences(text: str | None) -> list[tuple[int, int, str, int]]:
    """`sentences` with their characters. A piece that is too short for a sentence but has a word counts
    for the sentence before it, or the first one where none is before it."""
    if not text:
        return []
    out, at, before = [], 0, 0
    ends = [m.end() for m in _END.finditer(text)]
    for end in [*ends, len(text)]:
        piece = text[at:end]
        start = at + len(piece) - len(piece.lstrip())
        at, piece = end, piece.strip()
        if piece:
            plain = normalise(piece)
            if _is_sentence(plain):
                out.append((start, end, plain, end - start + before))
                before = 0
            elif any(len(w) > 1 for w in plain.split()):
                if out:
                    out[-1] = (*out[-1][:3], out[-1][3] + end - start)
                else:
                    before += end - start
    return out


def _grams(plain: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: (bucket of each gram, in order; grams of each sentence). Sentences are at
    least as long as the largest gram."""
    lengths = np.array([len(s) for s in plain])
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    run = codes
    for n in range(2, max(GRAMS) + 1):
        run = run[: len(codes) - n + 1] * _MULT + codes[n - 1 :]
        if n in GRAMS:
            inside = np.ones(len(codes), bool)
            for k in range(1, n):
                inside[ends - k] = False
            yield ((run + np.uint32(n)) * _MULT >> _SHIFT)[inside[: len(run)]], lengths - (n - 1)


def score(plain: list[str], model: Model | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood [sentence, language], grams per sentence)."""
    weights = model.weights if isinstance(model, Model) else model
    total = np.zeros((len(plain), weights.shape[1]))
    grams = np.zeros(len(plain))
    at = 0
    while at < len(plain):
        size, low = 0, at
        while at < len(plain) and (at == low or size + len(plain[at]) < CHUNK):
            size += len(plain[at])
            at += 1
        for bucket, counts in _grams(plain[low:at]):
            total[low:at] += np.add.reduceat(weights[bucket], np.cumsum(counts) - counts, axis=0)
            grams[low:at] += counts
    return total, grams


SAMPLE = "part int, code int, plain array<string>"


def _sampled(docs: DataFrame, languages: dict[str, list[str]]) -> DataFrame:
    """The normalised sentences of the sampled documents (text, code), cut, so that both rounds of the
    fit read them and no text is read twice."""
    codes = list(languages)
    schema = pa.schema([("part", pa.int32()), ("code", pa.int32()), ("plain", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            plain = [[p for _, _, p in sentences(t)] for t in batch.column("text").to_pylist()]
            code = [codes.index(c) for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(code, pa.int32()), pa.array(plain, pa.list_(pa.string()))], schema=schema)

    return cut(docs.select("part", "code", "text").mapInArrow(run, SAMPLE))


def _counts(sample: DataFrame, langs: int, model) -> tuple[np.ndarray, np.ndarray]:
    """(gram counts [bucket, language] of the sampled sentences outside the held-out part, fit
    [label, language]: the log probability a gram of the label's sentences). Without a model a sentence
    counts for its document's label, with one for the language the model gives it."""
    cells = BUCKETS * langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, fit_, size = np.zeros(cells, np.int64), np.zeros((langs, langs)), np.zeros(langs)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            lists = batch.column("plain").to_pylist()
            plain = [p for ps in lists for p in ps]
            if not plain:
                continue
            own = np.repeat(np.array(batch.column("code").to_pylist()), [len(ps) for ps in lists])
            if model is not None:
                total, grams = score(plain, model.value)
                np.add.at(fit_, own, total)
                np.add.at(size, own, grams)
                own = total.argmax(1)
            for bucket, counts in _grams(plain):
                found += np.bincount(bucket.astype(np.int64) * langs + np.repeat(own, counts), minlength=cells)
        at = np.flatnonzero(found)
        more = np.concatenate([fit_.ravel(), size])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, cells + np.arange(len(more))])), pa.array(np.concatenate([found[at].astype(float), more]))], names=["cell", "n"])

    rows = sample.where("part > 0").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(cells + langs * langs + langs)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    fit_, size = out[cells : cells + langs * langs].reshape(langs, langs), out[cells + langs * langs :]
    return out[:cells].reshape(BUCKETS, langs), fit_ / np.maximum(size, 1)[:, None]


def _weights(counts: np.ndarray) -> np.ndarray:
    """Log probabilities; a language without a fitted gram gets no sentence."""
    sums = counts.sum(0)
    out = np.log((counts + SMOOTH) / (sums + SMOOTH * BUCKETS))
    out[:, sums == 0] = -1e3
    return np.ascontiguousarray(out.astype(np.float32))


def _floors(sample: DataFrame, langs: int, model) -> np.ndarray:
    """Per language the bound of a document's log probability a gram, from the held-out documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((langs, 3))
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            for ps in batch.column("plain").to_pylist():
                if ps:
                    total, grams = score(ps, model.value)
                    x = total.sum(0) / grams.sum()
                    found[x.argmax()] += 1, x.max(), x.max() ** 2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(langs)), *[pa.array(found[:, i]) for i in range(3)]], names=["code", "n", "s", "q"])

    rows = sample.where("part = 0").mapInArrow(run, "code long, n double, s double, q double").groupBy("code").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    out = np.full(langs, -np.inf)
    for r in rows:
        if r["n"] >= LEAST_HELD:
            mean = r["s"] / r["n"]
            out[r["code"]] = mean - FAR * max(np.sqrt(max(r["q"] / r["n"] - mean * mean, 0.0)), 0.05)
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """A model from about `fit_docs` labelled documents a language, those of lowest text hash. Labels
    that name no language are left out. Without labels the model knows no language."""
    languages, sizes = labelled_languages(docs, lang)
    codes = list(languages)
    if not codes:
        return Model(np.zeros((BUCKETS, 0), np.float32), {})
    code = label_code(lang, languages)
    u = F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 11) / F.lit(float(1 << 53))
    labelled = docs.where(code.isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), code.alias("code"), u.alias("u"))
    part = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(PARTS)).cast("int")
    keep = F.lit(False)
    for c in codes:
        keep = keep | ((F.col("code") == c) & (F.col("u") < fit_docs / sizes[c]))
    # A language with few documents is fitted on all of them.
    few = F.col("code").isin([c for c in codes if sizes[c] < PARTS * LEAST_HELD])
    sample = _sampled(labelled.where(keep).select(F.when(few, F.lit(1)).otherwise(part).alias("part"), "code", "text"), languages)
    sc, langs = docs.sparkSession.sparkContext, len(codes)
    first = sc.broadcast(_weights(_counts(sample, langs, None)[0]))
    counts, alike = _counts(sample, langs, first)
    first.unpersist()
    own = np.diag(alike)
    wrong = [i for i in range(langs) if any(j != i and sizes[codes[j]] > sizes[codes[i]] and alike[i, j] >= own[j] - ALIKE for j in range(langs))]
    weights = _weights(counts)
    weights[:, wrong] = -1e3
    second = sc.broadcast(weights)
    floors = _floors(sample, langs, second)
    second.unpersist()
    drop_cuts(docs.sparkSession, sample)
    return Model(weights, languages, floors)


SEGMENTS = T.ArrayType(T.StructType([
    T.StructField("seg_start", T.IntegerType()), T.StructField("seg_end", T.IntegerType()),
    T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))
_SEGMENTS = pa.list_(pa.struct([("seg_start", pa.int32()), ("seg_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def analyse(texts: list[str | None], model: Model) -> list[pa.Array]:
    """Main language, its confidence, and the segments of each text; all texts of a batch at once."""
    fitted = model.fitted
    found = [sized_sentences(t) if fitted else [] for t in texts]
    flat = [x for f in found for x in f]
    codes, langs = pa.array([*model.codes, UNKNOWN], pa.string()), len(model.codes)
    count = np.array([len(f) for f in found], np.int64)
    none = pa.array(count == 0)
    if not flat:
        return [pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.float64()), pa.array([[]] * len(texts), _SEGMENTS)]
    start, end, sizes = (np.array([x[i] for x in flat], np.float64 if i == 3 else np.int32) for i in (0, 1, 3))
    doc, each = np.repeat(np.arange(len(texts)), count), np.arange(len(flat))
    total, grams = score([x[2] for x in flat], model)
    per = total / np.maximum(grams, 1)[:, None]
    # A sentence's evidence is tempered: neighbouring grams overlap and are far from independent.
    soft = np.exp((total - total.max(1, keepdims=True)) / 6.0)
    soft /= soft.sum(1, keepdims=True)
    most = lambda best: np.bincount(doc * langs + best, sizes, len(texts) * langs).reshape(-1, langs).argmax(1)
    per_doc = lambda x: np.bincount(doc, x, len(texts))
    best = per.argmax(1)
    main = most(best)
    best = np.where(per.max(1) - per[each, main[doc]] < LEAVE, main[doc], best)
    main = most(best)
    own = best == main[doc]
    sure = per_doc(soft[each, main[doc]] * sizes) / np.maximum(per_doc(sizes), 1)
    if model.floor.size:
        # Far from all that is known: no language is more than a guess.
        far = per_doc(np.where(own, total[each, main[doc]], 0)) / np.maximum(per_doc(np.where(own, grams, 0)), 1) < model.floor[main]
        main, sure = np.where(far, langs, main), np.where(far, 0.0, sure)
        best = np.where(far[doc], langs, best)
        soft = np.column_stack([soft, np.zeros(len(flat))])
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])])
    last = np.r_[first[1:], len(flat)] - 1
    weight = np.add.reduceat(soft[each, best] * sizes, first) / np.add.reduceat(sizes, first)
    runs = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(end[last]), codes.take(pa.array(best[first])), pa.array(weight)], fields=list(_SEGMENTS.value_type))
    offsets = np.searchsorted(doc[first], np.arange(len(texts) + 1)).astype(np.int32)
    null = lambda a: pc.if_else(none, pa.nulls(len(a), a.type), a)
    return [null(codes.take(pa.array(main))), null(pa.array(sure)), pa.ListArray.from_arrays(pa.array(offsets), runs).cast(_SEGMENTS)]


def detect(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with `main_lang`, `main_confidence`, `segments` (start, end, language, confidence) and
    `label_wrong`.

    The main language is the one with most characters; segments are longest runs of sentences of one
    language, starting at the first character that is no space, in code points. `label_wrong`: the
    label is missing, names no single language, or not the main one. A document unlike all languages of
    the model is `und` with confidence 0, and its label is not called wrong. Null, empty and blank texts and
    texts without sentences have a null main language, no segments, and no wrong label; so has every
    text under a model that no labelled document was there to fit. Whole texts are read. A narrow operation; same-named columns are replaced.
    """
    names = ["main_lang", "main_confidence", "segments"]
    own = [c for c in docs.columns if c not in (*names, "label_wrong")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*own, F.col(text).cast("string").alias("__cw_text"))
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField("main_lang", T.StringType()),
                           T.StructField("main_confidence", T.DoubleType()), T.StructField("segments", SEGMENTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                more = analyse(part.column(part.num_columns - 1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*part.schema.names[:-1], *names])

    out = source.mapInArrow(run, schema)
    code = label_code(lang, model.languages)
    return out.withColumn("label_wrong", F.col("main_lang").isNotNull() & (F.col("main_lang") != UNKNOWN) & ~code.eqNullSafe(F.col("main_lang")))
