"""Encoding of a corpus with a byte-level BPE vocabulary, without regular expressions.

Pre-tokenisation works on a whole batch of texts at once. Each code point has a class (letter,
number, space, other white space, anything else); a few vectorised look-aheads refine it to a
symbol. Each symbol is a transition function over the states of the open slice. Functions compose
associatively, so the state before every character comes from a blocked scan: compositions run down
the rows of a (block, position) array for all blocks at once, block totals are scanned the same way,
and a table over (state, symbol) says where a slice begins. The slices then go through pair merging
with a bounded cache, and repeats within a batch are merged once.

Slices are those of the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+`.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Cached slices per worker; the cache is emptied beyond that. Longer slices are never cached.
CACHE_SLICES, CACHE_BYTES = 200_000, 64
#: Characters handled in one scan, which bounds its memory whatever the texts' lengths.
SCAN_CHARS = 1 << 20

# Character classes.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# Symbols: class refined by look-ahead. *_LAST: the last white space before a character that is none.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE_LAST, S_WHITE_LAST, S_WHITE_MORE, S_SHORT, S_LONG = range(8)
SYMBOLS = 8
# States: what the open slice is. *_SHORT and *_LONG: letters still due after an apostrophe.
(Q_NONE, Q_LETTER, Q_NUMBER, Q_OTHER, Q_SPACE, Q_WHITE, Q_DUE1, Q_DUE2) = range(8)
STATES = 8


def default_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
        elif kind == "Z":
            table[cp] = WHITE
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = WHITE
    table[0x20] = SPACE
    return table


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, slice begins) by [state, symbol]; symbols from SYMBOLS on begin a text."""
    after = np.zeros((STATES, 2 * SYMBOLS), np.uint8)
    begins = np.zeros((STATES, 2 * SYMBOLS), bool)
    fresh = {S_LETTER: Q_LETTER, S_NUMBER: Q_NUMBER, S_OTHER: Q_OTHER, S_SPACE_LAST: Q_SPACE, S_WHITE_LAST: Q_NONE,
             S_WHITE_MORE: Q_WHITE, S_SHORT: Q_DUE1, S_LONG: Q_DUE2}
    joins = {Q_LETTER: {S_LETTER}, Q_NUMBER: {S_NUMBER}, Q_OTHER: {S_OTHER, S_SHORT, S_LONG}, Q_WHITE: {S_WHITE_MORE},
             Q_SPACE: {S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG}}
    for q in range(STATES):
        for s in range(SYMBOLS):
            after[q, SYMBOLS + s], begins[q, SYMBOLS + s] = fresh[s], True
            if q in (Q_DUE1, Q_DUE2):  # the letter of a contraction, whatever its symbol
                after[q, s] = Q_NONE if q == Q_DUE1 else Q_DUE1
            elif s in joins.get(q, ()):
                after[q, s] = {S_SHORT: Q_OTHER, S_LONG: Q_OTHER}.get(s, fresh[s])
            else:
                after[q, s], begins[q, s] = fresh[s], True
    return after, begins


def _scan(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The state before each symbol, from the composition of transition functions."""
    after, _ = _automaton()
    return _prefix(after.T[symbols], block)


def _prefix(functions: np.ndarray, block: int) -> np.ndarray:
    """functions: [n, STATES]. The state before each one, starting in Q_NONE."""
    n = len(functions)
    if n <= 64:
        out, q = np.empty(n, np.uint8), Q_NONE
        for i in range(n):
            out[i] = q
            q = functions[i, q]
        return out
    rows = -(-n // block)
    padded = np.empty((rows * block, STATES), np.uint8)
    padded[:n], padded[n:] = functions, np.arange(STATES, dtype=np.uint8)
    cells = padded.reshape(rows, block, STATES)
    at, run = np.arange(rows)[:, None], np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for i in range(block):
        run = cells[at, i, run]  # compose: position i after what came before in its block
    entry = _prefix(np.ascontiguousarray(run), block)
    out, at = np.empty((rows, block), np.uint8), np.arange(rows)
    for i in range(block):
        out[:, i] = entry
        entry = cells[at, i, entry]
    return out.reshape(-1)[:n]


def _in(codes: np.ndarray, letters: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(x) for x in letters], codes.dtype))


def slice_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions at which slices begin. codes: code points of texts joined without separator;
    firsts: the positions at which non-empty texts begin."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[codes]
    new = np.zeros(n + 3, bool)
    new[firsts] = True
    new[n:] = True
    white = np.ones(n + 1, bool)
    white[:n] = kind >= SPACE
    last = (kind >= SPACE) & ~white[1:] & ~new[1 : n + 1]
    symbols = np.select([last & (kind == SPACE), last, kind >= SPACE], [S_SPACE_LAST, S_WHITE_LAST, S_WHITE_MORE], kind.astype(np.int64)).astype(np.uint8)
    tick = np.flatnonzero((codes == 0x27) & ~new[1 : n + 1])
    if len(tick):
        one = codes[tick + 1]
        symbols[tick[_in(one, "stmd")]] = S_SHORT
        tick, one = tick[~new[tick + 2]], one[~new[tick + 2]]
        two = codes[tick + 2]
        long = (_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbols[tick[long]] = S_LONG
    symbols[firsts] += SYMBOLS
    _, begins = _automaton()
    return np.flatnonzero(begins[_scan(symbols), symbols])


class Codec:
    """A byte-level BPE vocabulary: encoding with offsets, and decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the adjacent pair of lowest rank is merged until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 128:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if at < 0:
                return tuple(ranks[p] for p in parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and a linked list, n log n for slices of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def slice_ids(self, text: str) -> tuple[int, ...]:
        ids = self.cache.get(text)
        if ids is None:
            raw = text.encode("utf-8", "replace")
            ids = self.merge(raw)
            if len(raw) <= CACHE_BYTES:
                if len(self.cache) >= CACHE_SLICES:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def encode_batch(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """(ids, slice offsets in characters) of each text; both empty for null and empty texts."""
        out: list[tuple[list[int], list[int]]] = [([], []) for _ in texts]
        at = 0
        while at < len(texts):
            chosen, size = [], 0
            while at < len(texts) and (not chosen or size + len(texts[at] or "") <= SCAN_CHARS):
                if texts[at]:
                    chosen.append(at)
                    size += len(texts[at])
                at += 1
            self._encode(texts, chosen, out)
        return out

    def _encode(self, texts, chosen, out) -> None:
        joined = "".join(texts[i] for i in chosen)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(texts[i]) for i in chosen], np.int64)
        ends = np.cumsum(lengths)
        starts = slice_starts(codes, ends - lengths)
        stops = np.append(starts[1:], len(codes))
        cuts = np.searchsorted(starts, ends)
        ids_of, first = self.slice_ids, 0
        a, b = starts.tolist(), stops.tolist()
        for i, begin, cut in zip(chosen, (ends - lengths).tolist(), cuts.tolist()):
            ids: list[int] = []
            for k in range(first, cut):
                ids += ids_of(joined[a[k] : b[k]])
            out[i] = (ids, [x - begin for x in a[first:cut]])
            first = cut

    def count_batch(self, texts: list[str | None]) -> list[int]:
        return [len(ids) for ids, _ in self.encode_batch(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """The vocabulary at `path`, loaded once per Python worker."""
    return Codec(path)


def _append(df: DataFrame, text: str, fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """`df` with columns made from the texts of each Arrow batch; same-named columns are replaced."""
    names = [n for n, _, _ in fields]
    keep = [c for c in df.columns if c not in names]
    source = df.select(*keep, F.col(text).cast("string").alias("__cw_text"))
    schema = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                columns = make(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(v, t) for v, (_, _, t) in zip(columns, fields)]],
                    names=[*part.schema.names[:-1], *names])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """`df` with `ids` (token ids without special tokens) and, if asked for, `offsets`: the position
    in characters at which each slice begins, for decoding spans.

    An empty or null text gives empty lists. Strings of special tokens are ordinary text. Rows keep
    their number and other columns; whole texts are encoded, whatever their length. A narrow
    operation without shuffle. `path` must exist on every executor.
    """
    path = path or default_path()
    fields = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]
    if offsets:
        fields.append(("offsets", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))

    def make(texts):
        pairs = codec(path).encode_batch(texts)
        return [[p[0] for p in pairs], [p[1] for p in pairs]][: len(fields)]

    return _append(df, text, fields, make)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """`df` with the number of tokens of each text (0 for null and empty ones)."""
    path = path or default_path()
    return _append(df, text, [(name, T.LongType(), pa.int64())], lambda texts: [codec(path).count_batch(texts)])


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, name: str = "decoded") -> DataFrame:
    """`df` with the text of each id list; null for null. Encoding and decoding give the text back."""
    path = path or default_path()

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        c = codec(path)
        return lists.map(lambda x: None if x is None else c.decode([int(i) for i in x]))

    return df.withColumn(name, run(ids))
