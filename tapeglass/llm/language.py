"""Language identification by cross-parsing entropy.

Training: for every language, a sample of labelled texts, whole ones, is normalised to letters and single spaces and a
suffix automaton of it is built.  Prediction: a text is parsed greedily into the longest phrases that occur in a
language's sample; phrases a symbol, times the bits that name a place in the sample, estimate the cross entropy.  The
language with the fewest normalised phrases wins.

The sample is bounded: of each language at most ``TRAIN_ROWS`` rows, taken in the order of a hash of their keys while
their texts, whole, fit ``TRAIN_SYMBOLS`` characters (texts longer than a share of that come last, the shortest first; one
text is always taken).  The automata are tables over all letters of the samples.  Texts are parsed in blocks of ``BLOCK``
symbols, all blocks of a chunk in step, so a long text costs what its length says; a block's start costs every language
the same one phrase.

Cases: a null text, or one without a letter, is ``und`` with score 0; a letter is any code point that Unicode calls one;
ties go to the language first in order; repeated rows get equal answers; without labelled rows every text is ``und``;
columns other than those named are not read.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import bounded, chunks, lean

UNKNOWN = "und"
#: The sample of a language: at most this many labelled rows, and characters of their whole texts; a text longer than the
#: share of those is taken only where there are too few others.
TRAIN_ROWS, TRAIN_SYMBOLS, LONG_SHARE = 96, 30_000, 4
#: Letters (the most frequent first) whose transitions are in the dense table, and columns of it over all languages: the
#: more languages, the fewer letters.  The transitions of all other letters are in a sorted one.
DENSE_LETTERS, DENSE_COLUMNS = 62, 4096
#: Letters are in the planes 0 to 3; the last code point of these is none and stands for all beyond.
CODES = 0x40000
BLOCK = 1024
CHUNK = 1 << 20
#: Bits a symbol beyond which a text may be in none of the languages; it is rejected only if all its symbols together are so
#: many bits beyond, and it is nearly as surprising (by this share) as its own letters in random order.
MAX_SURPRISE, EVIDENCE, RANDOM_SHARE = 4.5, 128, 0.9
SPACE_SYMBOL, OTHER_SYMBOL = 0, 1


def _letter_table() -> np.ndarray:
    """The lower-case form of each letter, 0 for what is no letter."""
    lower = np.zeros(CODES, np.uint32)
    for c in range(CODES):
        if unicodedata.category(chr(c)).startswith("L"):
            lower[c] = ord(chr(c).lower()[0])
    return lower


_tables: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _tables:
        _tables.append(_letter_table())
    return _tables[0]


def decode(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (from ``CODES`` on as the last one below) of UTF-8 bytes, and the byte at which each starts."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.uint32)
    code = lead.copy()
    if len(buf) and buf.max() >= 0x80:
        padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
        two = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0))
        code[two] = ((lead[two] & 0x1F) << 6) | (padded[at[two] + 1] & 0x3F)
        three = np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
        code[three] = ((lead[three] & 0x0F) << 12) | ((padded[at[three] + 1] & 0x3F) << 6) | (padded[at[three] + 2] & 0x3F)
        four = np.flatnonzero(lead >= 0xF0)
        long = ((lead[four] & 0x07) << 18) | ((padded[at[four] + 1] & 0x3F) << 12) | ((padded[at[four] + 2] & 0x3F) << 6) | (padded[at[four] + 3] & 0x3F)
        code[four] = np.minimum(long, CODES - 1)
    return code, at


def normalised(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of texts, 0 for each run of others, and the texts' offsets among these symbols."""
    code, at = decode(buf)
    low = letters()[code]
    keep = low > 0
    first = np.empty_like(keep)
    first[1:] = keep[:-1]
    first[:1] = False
    where = np.searchsorted(at, cuts)
    first[where[:-1][where[:-1] < len(first)]] = False
    keep |= first  # one space after each word
    index = np.flatnonzero(keep)
    return low[index], np.searchsorted(index, where)


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each code point
    width: int  # of the dense table, which has the symbols below
    step: np.ndarray  # (states * width): twice the next state, plus 1 where a phrase ends
    keys: np.ndarray  # the other symbols' transitions: state * (number of symbols) + symbol, ascending
    moves: np.ndarray  # and twice the next state
    start: np.ndarray  # (languages, other symbols): where a phrase starts that begins with one
    symbols: int
    roots: np.ndarray  # per language
    bits: np.ndarray  # per language: log2 of the sample's length


def automaton(symbols: list[int], width: int) -> tuple[np.ndarray, dict[int, dict[int, int]]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root.

    Those of the first ``width`` symbols are a table (-1: none), those of all others a dictionary a state.
    """
    none = array("i", [-1]) * width
    steps, rare = none * (2 * len(symbols) + 1), {}
    link, length = array("i", [-1]), array("i", [0])
    last = 0

    def to(p: int, s: int) -> int:
        return steps[p * width + s] if s < width else rare.get(p, {}).get(s, -1)

    def lead(p: int, s: int, state: int) -> None:
        if s < width:
            steps[p * width + s] = state
        else:
            rare.setdefault(p, {})[s] = state

    for s in symbols:
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(link) - 1, last
        while p >= 0 and to(p, s) < 0:
            lead(p, s, new)
            p = link[p]
        if p >= 0:
            q = to(p, s)
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                link.append(link[q])
                length.append(length[p] + 1)
                copy = len(link) - 1
                steps[copy * width : (copy + 1) * width] = steps[q * width : (q + 1) * width]
                if q in rare:
                    rare[copy] = dict(rare[q])
                while p >= 0 and to(p, s) == q:
                    lead(p, s, copy)
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.frombuffer(steps, np.int32)[: len(link) * width].reshape(-1, width), rare


@dataclass(frozen=True)
class Samples:
    """What a model is made of: the symbols of each language.  This is sent to the workers, which build the tables."""

    coded: tuple[tuple[str, bytes], ...]

    def model(self) -> Model:
        if self not in _models:
            _models.clear()
            _models[self] = tables({k: np.frombuffer(v, np.uint32) for k, v in self.coded})
        return _models[self]


_models: dict[Samples, Model] = {}


def symbols_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return normalised(raw, np.array([0, len(raw)]))[0]


def build(samples: dict[str, list[str]]) -> Samples:
    """The samples of whole texts by language."""
    coded = {lang: np.concatenate([symbols_of(t) for t in samples[lang]]) for lang in sorted(samples) if samples[lang]}
    return Samples(tuple((k, v.astype(np.uint32).tobytes()) for k, v in coded.items() if len(v)))


def tables(coded: dict[str, np.ndarray]) -> Model:
    """One pair of tables, dense and sorted, of the automata of all languages."""
    symbol = np.full(CODES, OTHER_SYMBOL, np.int32)
    symbol[0] = SPACE_SYMBOL
    symbols = 2
    if coded:
        found, counts = np.unique(np.concatenate(list(coded.values())), return_counts=True)
        found, counts = found[found > 0], counts[found > 0]
        symbol[found[np.argsort(-counts, kind="stable")]] = 2 + np.arange(len(found))
        symbols += len(found)
    width = min(symbols, 2 + min(DENSE_LETTERS, DENSE_COLUMNS // max(len(coded), 1)))
    tables, roots, keys, to_states = [], [], [], []
    first = np.zeros((len(coded), symbols - width), np.int32)
    base = 0
    for nth, v in enumerate(coded.values()):
        steps, rare = automaton(symbol[v].tolist(), width)
        # What cannot go on ends a phrase: the next one starts with this symbol, from the root.  A symbol that the sample
        # lacks is a phrase by itself: its state (the last one) has no way on at all.
        start = np.full(symbols, 2 * (base + len(steps)) + 1, np.int32)
        from_root = np.flatnonzero(steps[0] >= 0)
        start[from_root] = 2 * (base + steps[0][from_root]) + 1
        for s, state in rare.get(0, {}).items():
            start[s] = 2 * (base + state) + 1
        first[nth] = start[width:]
        table = np.tile(start[:width], (len(steps) + 1, 1))
        table[0] -= 1  # at a block's start no phrase is open
        np.copyto(table[:-1], 2 * (base + steps), where=steps >= 0)
        for i, moves in rare.items():
            for s, state in moves.items():
                keys.append((base + i) * symbols + s)
                to_states.append(2 * (base + state))
        tables.append(table)
        roots.append(base)
        base += len(steps) + 1
    step = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    bits = np.array([np.log2(len(v) + 2) for v in coded.values()])
    return Model(list(coded), symbol, width, step, np.array(keys, np.int64)[order], np.array(to_states, np.int32)[order], first, symbols, np.array(roots, np.int32), bits)


def _rare_steps(model: Model, state: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The steps from states (texts, languages) by symbols that the dense table does not have."""
    key = state.astype(np.int64) * model.symbols + s[:, None]
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    return np.where(model.keys[at] == key, model.moves[at], model.start[:, s - model.width].T - (state == model.roots))


def entropies(model: Model, buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits a symbol, (texts, languages), the same without the phrases that blocks' ends cut, and letters of each text."""
    n, langs = len(cuts) - 1, len(model.languages)
    low, at = normalised(buf, cuts)
    sizes = np.diff(at)
    spaces = np.zeros(len(low) + 1, np.int64)
    np.cumsum(low == 0, out=spaces[1:])
    n_letters = sizes - (spaces[at[1:]] - spaces[at[:-1]])
    codes = model.symbol[low]
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(n), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = at[:-1][owner] + nth * BLOCK
    length = np.minimum(BLOCK, at[1:][owner] - start)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    width = model.width
    rare = codes >= width
    near = np.where(rare, OTHER_SYMBOL, codes) if rare.any() else codes
    state = np.tile(model.roots, (len(start), 1)) * 2
    phrases = np.zeros((len(start), langs), np.int32)
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")  # blocks longer than i
    for i in range(longest):
        m = alive[i]
        s = near[start[:m] + i]
        here = model.step[(state[:m] >> 1) * width + s[:, None]]
        if near is not codes and len(other := np.flatnonzero(rare[start[:m] + i])):
            here[other] = _rare_steps(model, state[other] >> 1, codes[start[other] + i])
        phrases[:m] += here & 1
        state[:m] = here
    total = np.zeros((n, langs))
    np.add.at(total, owner, phrases)
    scale = model.bits / np.maximum(sizes, 1)[:, None]
    return (total + blocks[:, None]) * scale, total * scale, n_letters


def decide(model: Model, buf: np.ndarray, cuts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and surprise (the winner's bits a symbol) of each text.  The score is the winner's share under weights 2 ** -(bits a symbol), sharpened."""
    bits, surprise, n_letters = entropies(model, buf, cuts)
    n = len(cuts) - 1
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    best = bits.argmin(axis=1)
    weight = np.exp2(-4.0 * (bits - bits.min(axis=1, keepdims=True)))
    score = 1.0 / weight.sum(axis=1)
    known = n_letters > 0
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), surprise[np.arange(n), best]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = TRAIN_ROWS, train_symbols: int = TRAIN_SYMBOLS) -> Samples:
    """Samples from labelled rows, in the order that this module's description gives; every label is learned.

    Two passes: the first reads labels, keys and lengths and finds the last place in the order for each language (the
    window keeps ``train_rows`` a language before its shuffle); the second fetches the few texts up to there.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(key), F.lit(17)).alias("h"), F.col(text).cast("string").alias("t"))
    size = F.length("t").cast("long")
    long = size * LONG_SHARE > train_symbols
    place = F.struct(long.alias("long"), F.when(long, size).otherwise(F.col("h")).alias("first"), F.col("h"))
    rows = rows.withColumn("o", place)
    top = rows.select("l", "o").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("o"))).where(F.col("r") <= train_rows)
    limits = [(r["l"], r["m"]) for r in top.groupBy("l").agg(F.max("o").alias("m")).collect()]
    if not limits:
        return build({})
    schema = T.StructType([T.StructField("l2", T.StringType()), T.StructField("m", rows.schema["o"].dataType)])
    wanted = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(limits, schema)), F.col("l") == F.col("l2")).where("o <= m")
    # Texts arrive language by language, in order, and only what a language's sample takes is held.
    samples: dict[str, list[str]] = {}
    taken, had = 0, None
    for r in wanted.select("l", "o", "t").distinct().orderBy("l", "o", "t").toLocalIterator():
        if r["l"] != had:
            taken, had = 0, r["l"]
        own = samples.setdefault(had, [])
        if not own or (len(own) < train_rows and taken + len(r["t"]) <= train_symbols):
            own.append(r["t"])
            taken += len(r["t"])
    return build(samples)


def predict(docs: DataFrame, model: Samples, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score and surprise of every whole text: one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = len(keep)
    rows = bounded(docs).select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.model()
        for batch in batches:
            for c in chunks(batch.column(at), CHUNK):
                langs, score, surprise = decide(own, c.buf, c.cuts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(c.first, c.n) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(surprise, pa.float64())], names=[*keep, "lang_pred", "score", "surprise"])

    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("surprise", "double")
    return rows.mapInArrow(lean(run), schema)


def familiar(model: Model, buf: np.ndarray, cuts: np.ndarray, max_surprise: float = MAX_SURPRISE) -> np.ndarray:
    """Which texts have letters and are not as surprising as their letters at random; without languages, all with letters."""
    low, at = normalised(buf, cuts)
    counts = np.zeros(len(low) + 1, np.int64)
    np.cumsum(low > 0, out=counts[1:])
    keep = counts[at[1:]] > counts[at[:-1]]
    if not model.languages:
        return keep
    _, _, surprise = decide(model, buf, cuts)
    suspects = np.flatnonzero(keep & ((surprise - max_surprise) * np.diff(at) > EVIDENCE))
    if len(suspects):
        mixed = []
        for i in suspects:
            own = low[at[i] : at[i + 1]].copy()
            own[own > 0] = np.random.default_rng(len(own)).permutation(own[own > 0])  # words keep their lengths
            mixed.append(np.frombuffer("".join(chr(c or 32) for c in own.tolist()).encode(), np.uint8))
        _, _, random = decide(model, np.concatenate(mixed), np.concatenate([[0], np.cumsum([len(m) for m in mixed])]))
        keep[suspects] = surprise[suspects] < RANDOM_SHARE * random
    return keep


def accepted(docs: DataFrame, model: Samples, text: str = "text", max_surprise: float = MAX_SURPRISE) -> DataFrame:
    """The rows of ``docs`` whose text has letters and is not as surprising as letters at random in every language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.model()
        for batch in batches:
            for c in chunks(batch.column(at), CHUNK):
                yield batch.slice(c.first, c.n).filter(pa.array(familiar(own, c.buf, c.cuts, max_surprise)))

    plain = bounded(docs).toDF(*(f"c{i}" for i in range(len(docs.columns))))  # the call takes no column name with a back-tick
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)
