"""Benchmark decontamination by spaced-seed hashing.

Words are runs of Unicode letters, marks and digits, in lower case.  Fixed masks pick some word positions of a span and
ignore the others; a document position and a benchmark position whose masked words hash alike are a hit; around each hit
the two word sequences are aligned and every window of ``WINDOW`` words is counted.  A document overlaps an item if some
aligned window has at most ``SUBSTITUTIONS`` differing words.  The masks hit every such window: for any two substituted
positions of 13, one of the masks has a placement that avoids both (tests check this).

Items shorter than a window have windows and masks of their own length: from ``SHORT`` words on, one word may differ (one
mask takes the even positions, one the odd ones, so a substitution leaves one of them); from ``LEAST`` words on, they must
occur whole and unchanged (a solid mask).  Items of fewer words match nothing: a word or two are no evidence of a leak.

Positions of one text that have the same words all around them give the same windows, so only the first is aligned: a text
or an item of repeated words costs what its distinct contexts do.

The benchmark is read in blocks of bounded size and sent to the executors; the documents are passed once a block, whole
texts in one piece, without a shuffle.  Where there are several blocks, each one's rows are written and its copy on the
executors dropped before the next.

Cases: a null text has no words and overlaps nothing; repeated rows are reported each; a null id, of a document or an
item, stays null; of windows with equally many equal words the first is reported; items without words match nothing; an
empty table on either side gives no rows; columns other than those named are not read.  A text is held whole while it is
hashed (some 60 bytes a byte of it).
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Chunk, bounded, chunks, lean, mix, value_hashes
from .language import CODES, decode
from .shared import written

WINDOW, SUBSTITUTIONS = 13, 2
#: Words of the items in which one word may differ, and of the shortest items.
SHORT, LEAST = 8, 3
#: Fixed masks: the offsets whose words count.
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 7, 8))
#: Of the benchmark that is sent at once: texts and characters.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4 << 20
FILTER_BITS = 20
HITS = 1 << 15

_values: list[np.ndarray] = []


def character_values() -> np.ndarray:
    """A random value for the lower-case form of each letter, mark and digit; 0 for all else."""
    if not _values:
        lower = np.zeros(CODES, np.int64)
        for c in range(CODES):
            if unicodedata.category(chr(c))[0] in "LMN":
                lower[c] = ord(chr(c).lower()[0])
        values = mix(lower.astype(U), 9) | U(1)
        values[lower == 0] = 0
        _values.append(values)
    return _values[0]


def words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and the texts' offsets among them."""
    code, at = decode(c.buf)
    values = character_values()[code]
    inside = values > 0
    edge = np.zeros(len(inside) + 1, bool)
    cuts = np.searchsorted(at, c.cuts)
    edge[cuts] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return value_hashes(values, starts, ends), np.searchsorted(starts, cuts)


def masks_of(n: int) -> list[tuple[int, ...]]:
    """The masks of items of n words."""
    if n >= WINDOW:
        return list(MASKS)
    if n >= SHORT:
        return [tuple(range(0, n, 2)), tuple(range(1, n, 2))]
    return [tuple(range(n))] if n >= LEAST else []


def tolerated(n: int) -> int:
    return SUBSTITUTIONS if n >= WINDOW else 1 if n >= SHORT else 0


def masked(hashes: np.ndarray, mask: tuple[int, ...], nth: int) -> np.ndarray:
    """The hash of a mask at every position at which it fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for i, o in enumerate(mask):
        total += hashes[o : o + n] * U(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64))
    return mix(total, nth)


def first_contexts(hashes: np.ndarray, cuts: np.ndarray, owner: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Those of the positions ``at`` (ascending) that are the first of their text with the same ``reach`` words on either side.

    Positions nearer to an end of their text are all kept.
    """
    if len(at) < 2:
        return at
    near = (at - reach < cuts[owner[at]]) | (at + reach >= cuts[owner[at] + 1])
    far = at[~near]
    if len(far) < 2:
        return at
    rows = np.concatenate([owner[far][:, None].astype(U), hashes[far[:, None] + np.arange(-reach, reach + 1)]], axis=1)
    _, first = np.unique(rows, axis=0, return_index=True)
    return np.sort(np.concatenate([at[near], far[first]]))


@dataclass
class Block:
    items: pa.Array  # item ids
    hashes: np.ndarray  # of the words of all items
    cuts: np.ndarray  # items among them
    windows: list[int]  # per mask: the words of a window
    masks: list[tuple[int, ...]]
    keys: list[np.ndarray]  # per mask: sorted hashes
    places: list[np.ndarray]  # per mask: the positions they have
    seen: list[np.ndarray]  # per mask: which leading bits occur


def block(items: list[int | None], texts: list[str]) -> Block:
    parts, cuts = [], [0]
    for c in chunks(pa.array(texts, pa.string())):
        h, k = words(c)
        parts.append(h)
        cuts += (cuts[-1] + k[1:]).tolist()
    hashes, cuts = np.concatenate(parts), np.array(cuts)
    size = np.minimum(np.diff(cuts), WINDOW)
    owner = np.repeat(np.arange(len(size)), np.diff(cuts))
    windows, masks, keys, places, seen = [], [], [], [], []
    for n in sorted(set(size.tolist()), reverse=True):
        for mask in masks_of(n):
            got = masked(hashes, mask, len(masks))
            at = np.arange(len(got))
            at = at[(owner[at] == owner[at + mask[-1]]) & (size[owner[at]] == n)]
            if n < WINDOW:
                at = at[at - cuts[owner[at]] == 0]
            at = first_contexts(hashes, cuts, owner, at, WINDOW + mask[-1])
            order = at[np.argsort(got[at], kind="stable")]
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(got[order] >> U(64 - FILTER_BITS)).astype(np.int64)] = True
            for to, value in zip((windows, masks, keys, places, seen), (n, mask, got[order], order, bits), strict=True):
                to.append(value)
    return Block(pa.array(items, pa.int64()), hashes, cuts, windows, masks, keys, places, seen)


def overlaps(b: Block, hashes: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, equal words, window words, first word) of the best window of each overlapping text and item."""
    owner = np.repeat(np.arange(len(b.cuts) - 1), np.diff(b.cuts))
    text_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, (mask, w) in enumerate(zip(b.masks, b.windows, strict=True)):
        got = masked(hashes, mask, i)
        at = np.flatnonzero(b.seen[i][(got >> U(64 - FILTER_BITS)).astype(np.int64)])
        at = at[text_of[at] == text_of[at + mask[-1]]]
        lo = np.searchsorted(b.keys[i], got[at], "left")
        at = at[(lo < len(b.keys[i])) & (b.keys[i][np.minimum(lo, len(b.keys[i]) - 1)] == got[at])] if len(b.keys[i]) else at[:0]
        at = first_contexts(hashes, cuts, text_of, at, WINDOW + mask[-1])
        lo, hi = np.searchsorted(b.keys[i], got[at], "left"), np.searchsorted(b.keys[i], got[at], "right")
        n = hi - lo
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        # Windows that hold the masked words start up to so many words before these.
        back = w - 1 - mask[-1] if w == WINDOW else 0  # a shorter item is one window
        for first in range(0, total, HITS):  # pairs of positions, a bounded number at once
            pair = np.arange(first, min(first + HITS, total))
            k = np.searchsorted(ends, pair, "right")
            x = at[k]
            y = b.places[i][lo[k] + pair - (ends[k] - n[k])]
            text, item = text_of[x], owner[y]
            offsets = np.arange(-back, w)
            p, q = x[:, None] + offsets, y[:, None] + offsets
            valid = (p >= cuts[text][:, None]) & (p < cuts[text + 1][:, None]) & (q >= b.cuts[item][:, None]) & (q < b.cuts[item + 1][:, None])
            same = valid & (hashes[np.where(valid, p, 0)] == b.hashes[np.where(valid, q, 0)])
            run = lambda m: np.concatenate([np.zeros((len(m), 1), np.int64), np.cumsum(m, axis=1)], axis=1)
            equal = run(same)[:, w:] - run(same)[:, :-w]
            equal = np.where(run(valid)[:, w:] - run(valid)[:, :-w] == w, equal, -1)
            top = equal.argmax(axis=1)
            for r in np.flatnonzero(equal.max(axis=1) >= w - tolerated(w)):
                key = (int(text[r]), int(item[r]))
                new = (int(equal[r, top[r]]), w, -int(x[r] - back + top[r] - cuts[text[r]]))
                if key not in best or new > best[key]:
                    best[key] = new
    return [(t, i, e, w, -s) for (t, i), (e, w, s) in sorted(best.items())]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Block]:
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    items: list[int | None] = []
    texts: list[str] = []
    size = 0
    for r in itertools.chain(rows.toLocalIterator(), [None]):
        if r is None or len(items) >= BLOCK_ITEMS or size >= BLOCK_CHARS:
            if items:
                yield block(items, texts)
            items, texts, size = [], [], 0
        if r is not None:
            items.append(r["i"])
            texts.append(r["t"])
            size += len(r["t"])


SCHEMA = "doc_id long, item_id long, equal_words long, window_words long, first_word long"


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, equal_words, window_words, first_word: the best overlap of every overlapping document and item."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out: DataFrame | None = None
    own, following = None, blocks(benchmark, item_id, item_text)
    for b in following:
        if own is not None:  # several blocks: the one before is done with first
            out, own = _done(out, rows, own), None
        own = spark.sparkContext.broadcast(b)
    if own is None:
        return spark.createDataFrame([], SCHEMA)
    return rows.mapInArrow(lean(_find(own)), SCHEMA) if out is None else _done(out, rows, own)


def _done(out: DataFrame | None, rows: DataFrame, sent) -> DataFrame:
    """``out`` and the rows of a block, which are written; the block is dropped."""
    part = written(rows.mapInArrow(lean(_find(sent)), SCHEMA))
    sent.unpersist()
    return part if out is None else out.unionAll(part)


def _find(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for c in chunks(batch.column(1)):
                found = overlaps(own, *words(c))
                if found:
                    t, i, e, w, s = (np.array(v, np.int64) for v in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n).take(pa.array(t)), own.items.take(pa.array(i)), pa.array(e), pa.array(w), pa.array(s)], names=["doc_id", "item_id", "equal_words", "window_words", "first_word"])

    return run
