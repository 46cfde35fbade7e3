"""Exact n-gram Jaccard join and its components, by skipping over set relations.

A document's set is its distinct shingles, each told apart by two independent 64-bit hashes.  Equal sets are one class.
Two indexes lead to the pairs that may be linked.

* Index of blocks.  Hashing deals a set's shingles over p positions (p by size group: one more than two linked sets of
  these sizes can differ in, plus a spare for positions that stay empty), and a list holds the classes whose whole block of
  shingles at one position is equal.  Two linked sets share a block, so sets that share none are never read.  The class
  with the least fingerprint is a list's hub.
* Index of differences.  A set is compared with its hub once, in full, and from then on stands for itself by its
  difference from it: with d shingles of the hub missing and i others added,

    A and B are linked  <=>  (den - num) * |H| + (den + num) * s >= cost(A) + cost(B),    cost = den * d + num * i,

  s being the shingles that both differences share.  So answers among the sets around a hub are derived from their
  answers to the hub: sets linked to the hub need no comparison with each other; for a set that is not, inverted lists
  over the prefixes of the differences are read.  A list is kept in blocks by how many shingles follow an entry's
  position in its difference (and by cost); a block whose position leaves too few shingles in common is skipped whole.

Before texts are compared, bitmaps of the sets are: where these differ in more bits than linked sets may in shingles, the
sets are not linked.

A class is compared with one hub first, that with which it shares most lists.  Lists whose classes are then in one
component, or were all compared with the list's own hub, are settled; classes go to further hubs only for the other lists.
Differences are made only for sets on a list with several sets, one of which is not linked to the hub.  No pairs of a
group are spelled out; hubs with many sets are dealt over salts and blocks.

Cases: a null or empty text has an empty set and is its own component; a text of fewer words than a shingle has one
shingle, its whole sequence; where ids are null or repeated, each row is a document of its own (so rows that share an id
but not a text are linked each by its own text); a row without an id never names a component that has one (a component
without any id is null); an empty table gives no rows; columns other than those named are not read.  A text is held whole
while its shingles are hashed (some 60 bytes a byte of it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BYTE2, U, Chunk, chunks, lean, mix, window_hashes, windows_inside
from .shared import Scratch, components, identified, key_filter, marked, offered, passes, written
from .textstats import tagged

WORDS, NUM, DEN = 3, 90, 100
#: Sets of one hub that one task compares, and that one block of differences indexes.
SALT_SETS, BLOCK_SETS = 2000, 4000
#: Shingles behind an entry's position that one block of an inverted list spans.
BLOCK_POSITIONS = 4
#: The share of sets, at most, that have more empty positions than are spare (those have them indexed, too).
MANY_EMPTY = 1e-6
#: Fingerprints that a task remembers, so that it indexes a copy once.
REMEMBERED = 1 << 20


def spare_positions(differ: int, n: int) -> int:
    """The least spare such that a set of n shingles rarely has more empty ones of differ + 1 + spare positions."""
    for spare in range(n + differ + 2):
        p, k = differ + 1 + spare, spare + 1
        if k >= p:
            return spare
        most = math.lgamma(p + 1) - math.lgamma(k + 1) - math.lgamma(p - k + 1) + n * math.log1p(-k / p)
        if most <= math.log(MANY_EMPTY):
            return spare
    return n


class Sizes:
    """Size classes, by which linked sets are in the same or adjacent ones, and the positions of each size group.

    Group g covers the classes g and g + 1; a set of class k is in the groups k - 1 and k.
    """

    def __init__(self, num: int, den: int, most: int = 1 << 31):
        low, high = [1], [den // num]
        while high[-1] < most:
            low.append(high[-1] + 1)
            high.append(low[-1] * den // num)
        self.low = np.array(low)
        high = np.array([*high, high[-1] * den // num])
        self.differ = (high[:-1] + high[1:]) * (den - num) // (den + num)  # most by which two linked sets differ
        self._spare: dict[int, int] = {}

    def groups(self, n: np.ndarray) -> list[np.ndarray]:
        k = np.searchsorted(self.low, n, "right") - 1
        return [k, np.maximum(k - 1, 0)]

    def spare(self, group: np.ndarray) -> np.ndarray:
        out = np.zeros(len(group), np.int64)
        for g in np.unique(group).tolist():
            if g not in self._spare:
                self._spare[g] = spare_positions(int(self.differ[g]), int(self.low[g])) if self.differ[g] else 0
            out[group == g] = self._spare[g]
        return out

    def positions(self, group: np.ndarray) -> np.ndarray:
        return np.where(self.differ[group] > 0, self.differ[group] + 1 + self.spare(group), 0)


_sizes: dict[tuple[int, int], Sizes] = {}


def sizes_of(num: int, den: int) -> Sizes:
    return _sizes.setdefault((num, den), Sizes(num, den))


def shingle_sets(c: Chunk, words: int, both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text (a hash, by which they ascend, and an independent one) and the texts' offsets.

    Without ``both`` the second hash is not made: enough to find candidates, which are then compared by both.
    """
    _, _, cuts = c.words()
    n = np.diff(cuts)
    first = c.hashes(lower=True)
    second = c.hashes(lower=True, byte=BYTE2) if both else first
    owner = c.owner(n)
    found, again, of = [], [], []
    for k in range(1, words + 1):
        which = (n >= words) if k == words else (n == k)
        if not which.any():
            continue
        at = np.flatnonzero(windows_inside(cuts, k))
        at = at[which[owner[at]]]
        found.append(window_hashes(first, k)[at])
        again.append(window_hashes(second, k)[at] if both else found[-1])
        of.append(owner[at])
    if not found:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(c.n + 1, np.int64)
    h1, h2, of = np.concatenate(found), np.concatenate(again), np.concatenate(of)
    keys = tagged(of, h1)
    order = np.argsort(keys)
    near = keys[order[1:]] == keys[order[:-1]]
    h1, h2, of = h1[order], h2[order], of[order]
    if (near & ((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))).any():  # shingles that differ beyond the first 48 bits only
        order = np.lexsort((h2, h1, of))
        h1, h2, of = h1[order], h2[order], of[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (of[1:] != of[:-1])
    return h1[new], h2[new], np.searchsorted(of[new], np.arange(c.n + 1))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                h1, h2, cuts = shingle_sets(c, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(np.diff(cuts)), _long(_sums(mix(h1, 21), cuts)), _long(_sums(mix(h2, 22), cuts)), sketches(h1, cuts)], names=["doc", "n", "f1", "f2", "sketch"])

    return run


def sketches(sets: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A bitmap of each set, about a bit a shingle: each shingle flips one bit.

    The bits in which two bitmaps differ are at most the shingles in which their sets do.  Sizes are powers of two, so the
    larger of two is folded onto the smaller.
    """
    n = np.diff(cuts)
    size = np.where(n > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)), 0)
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(n)), n)
    cell = base[owner] + (mix(sets, 41) & (size[owner] - 1).astype(U)).astype(np.int64)
    flipped = (np.bincount(cell, minlength=int(size.sum())) & 1).astype(np.uint8)
    edges = np.concatenate([[0], np.cumsum(size // 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(np.packbits(flipped, bitorder="little"))])


def folded(sketch: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sketch, U).reshape(-1, size // 8), axis=0)


def may_link(n: int, sketch: bytes, sizes: np.ndarray, others: list[bytes], num: int, den: int) -> np.ndarray:
    """Which of other sets (sizes and bitmaps) may be linked with a set: no set is told apart that is linked."""
    ok = np.zeros(len(others), bool)
    kinds = np.array([len(o) for o in others])
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        small = min(kind, len(sketch))
        rest = np.frombuffer(b"".join([others[i] for i in at]), U).reshape(len(at), -1, small // 8)
        apart = np.bitwise_count(np.bitwise_xor.reduce(rest, axis=1) ^ folded(sketch, small)).sum(axis=1, dtype=np.int64)
        ok[at] = (den + num) * apart <= (den - num) * (n + sizes[at])
    return ok


def _likely(num: int, den: int):
    """Of rows (doc, hub, n, sketch, hub's n, hub's sketch) those that may be linked: (doc, hub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sketch, m, other = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [bool(may_link(n[i], sketch[i], np.array([m[i]]), [other[i]], num, den)[0]) for i in range(batch.num_rows)]
            yield batch.select(["doc", "hub"]).filter(pa.array(keep, pa.bool_()))

    return run


def _close(num: int, den: int):
    """Streams sorted (hub, block, kind, doc, open, n, sketch): the sets that may be linked with another one around the hub.

    Two sets that are both linked to the hub need not be.
    """

    def found(hub: int, members: list[tuple], probes: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, sizes, others = [m[0] for m in members], np.array([m[2] for m in members]), [m[3] for m in members]
        out: set[int] = set()
        for row in chain((m for m in members if m[1]), probes):
            near = [docs[i] for i in np.flatnonzero(may_link(row[2], row[3], sizes, others, num, den)) if docs[i] != row[0]] if docs else []
            if near:
                out.update(near)
                out.add(row[0])
        if out:
            yield _batch([(hub, d) for d in sorted(out)], "hub long, doc long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, probes = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if row[:2] != at:
                    if at is not None:
                        yield from found(at[0], members, probes)
                    at, members, probes = row[:2], [], []
                (probes if row[2] else members).append(row[3:])
                if len(probes) >= BLOCK_SETS:
                    yield from found(at[0], members, probes)
                    probes = []
        if at is not None:
            yield from found(at[0], members, probes)

    return run


def blocks_of(sets: np.ndarray, cuts: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every list that a set is on.

    Empty blocks are left out unless a set has more of them than are spare: two linked sets that agree in empty blocks
    only would both have more.
    """
    n = np.diff(cuts)
    owner = np.repeat(np.arange(len(n)), n)
    place, value = mix(sets, 31), mix(sets, 32)
    texts, keys = [], []
    own, below = sizes.groups(n)
    for group, of in ((own, n > 0), (below, (n > 0) & (below != own))):
        p = np.where(of, sizes.positions(group), 0)
        if not p.any():
            continue
        base = np.cumsum(p) - p
        mine = p[owner] > 0
        cell = base[owner[mine]] + (place[mine] >> U(20)).astype(np.int64) % p[owner[mine]]
        total = np.zeros(int(p.sum()), U)
        np.add.at(total, cell, value[mine])
        full = np.bincount(cell, minlength=len(total)) > 0
        text = np.repeat(np.arange(len(n)), p)
        empty = np.bincount(text[~full], minlength=len(n))
        keep = full | (empty > sizes.spare(group))[text]
        position = np.arange(len(total)) - base[text]
        texts.append(text[keep])
        keys.append(mix(total + mix((group[text] * (1 << 32) + position).astype(U), 33), 34)[keep])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(texts), np.concatenate(keys)


def _index(words: int, num: int, den: int, filter_=None):
    """(key, print) of the lists of every text; a task leaves out copies of sets that it had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = sizes_of(num, den)
        bits = None if filter_ is None else filter_.value
        had: set[int] = set()
        for batch in batches:
            for c in chunks(batch.column(0)):
                h1, _, cuts = shingle_sets(c, words, both=False)
                prints = _sums(mix(h1, 21), cuts)
                new = np.zeros(c.n, bool)
                for i, f in enumerate(prints.tolist()):
                    if f not in had:
                        had.add(f)
                        new[i] = True
                if len(had) > REMEMBERED:
                    had.clear()
                text, key = blocks_of(h1, cuts, sizes)
                keep = new[text] if bits is None else new[text] & passes(bits, key)
                yield pa.RecordBatch.from_arrays([_long(key[keep]), _long(prints[text[keep]])], names=["key", "print"])

    return run


#: A shingle of a difference: its two hashes.
TOKEN = 16


def _packed(h1: np.ndarray, h2: np.ndarray) -> bytes:
    return np.stack([h1, h2], axis=1).astype("<u8").tobytes()


def _tokens(data: bytes) -> list[bytes]:
    return [data[i : i + TOKEN] for i in range(0, len(data), TOKEN)]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(col, _TYPES[t]) for col, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


COST = "hub long, doc long, size long, cost long"
DELTA = COST + ", gone binary, added binary"


def _compare(words: int, num: int, den: int, deltas: bool):
    """Streams sorted (hub, salt, kind, doc): the hub's text comes first, then each member's; one set is held at a time.

    Gives each member's cost, and with ``deltas`` its difference from the hub.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            heads = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for c in chunks(batch.column(4)):
                h1, h2, cuts = shingle_sets(c, words)
                rows = []
                for i, (h, s, kind, doc) in enumerate(heads[c.first : c.first + c.n]):
                    own = slice(cuts[i], cuts[i + 1])
                    if kind == 0:
                        at, hub = (h, s), (h1[own], h2[own])
                        continue
                    if at != (h, s):
                        raise ValueError(f"no set of hub {h}")
                    place = np.minimum(np.searchsorted(hub[0], h1[own]), len(hub[0]) - 1)
                    both = (hub[0][place] == h1[own]) & (hub[1][place] == h2[own])
                    missing = np.ones(len(hub[0]), bool)
                    missing[place[both]] = False
                    inter = int(both.sum())
                    cost = den * (len(hub[0]) - inter) + num * (len(both) - inter)
                    row = (h, doc, len(hub[0]), cost)
                    rows.append((*row, _packed(hub[0][missing], hub[1][missing]), _packed(h1[own][~both], h2[own][~both])) if deltas else row)
                if rows:
                    yield _batch(rows, DELTA if deltas else COST)

    return run


class Lists:
    """Inverted lists over the prefixes of differences, in blocks by the shingles that follow an entry's position.

    Of two differences whose first common shingle is at positions i and j, at most min(len - i, len - j) are shared; so a
    block all of whose entries leave too few, given the least cost among them, is skipped.
    """

    def __init__(self, slack: int, num: int, den: int):
        self.slack, self.both, self.den = slack, den + num, den
        self.lists: dict[bytes, dict[int, list]] = {}
        self.read = self.skipped = 0

    def prefix(self, tokens: list[bytes], cost: int) -> list[bytes]:
        need = -(-(cost - self.slack) // self.den)
        return tokens[: len(tokens) - need + 1] if need > 0 else tokens

    def add(self, member: int, tokens: list[bytes], cost: int) -> None:
        for i, x in enumerate(self.prefix(tokens, cost)):
            left = (len(tokens) - i) // BLOCK_POSITIONS
            block = self.lists.setdefault(x, {}).get(left)
            if block is None:
                self.lists[x][left] = [cost, [member]]
            else:
                block[0] = min(block[0], cost)
                block[1].append(member)

    def candidates(self, tokens: list[bytes], cost: int) -> Iterator[int]:
        tried: set[int] = set()
        for i, x in enumerate(self.prefix(tokens, cost)):
            left = len(tokens) - i
            for blocks, (least, members) in self.lists.get(x, {}).items():
                most = min(left, (blocks + 1) * BLOCK_POSITIONS - 1)
                if self.slack + self.both * most < cost + least:
                    self.skipped += 1
                    continue
                self.read += 1
                for m in members:
                    if m not in tried:
                        tried.add(m)
                        yield m


def linked_around(members: list[tuple[int, int, int, bytes, bytes]], probes: list[tuple[int, int, int, bytes, bytes]], num: int, den: int) -> list[tuple[int, int]]:
    """Links (reduced to a forest) that members of one hub have among each other or with probes, besides those by the hub.

    Members and probes: (doc, size of the hub, cost, gone, added).
    """
    if not members:
        return []
    slack = (den - num) * members[0][1]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent.setdefault(parent[x], parent[x])
        return x

    hub = -(1 << 62)
    lists = Lists(slack, num, den)
    differences = []
    for i, row in enumerate(members):
        t = _tokens(row[4]) + _tokens(row[3])  # added ones first, each part in order of hashes: an order that all share
        differences.append(frozenset(t))
        lists.add(i, t, row[2])
        if row[2] <= slack:
            parent[row[0]] = hub
            parent.setdefault(hub, hub)
    out = []
    for row in chain((m for m in members if m[2] > slack), probes):
        t = _tokens(row[4]) + _tokens(row[3])
        own = frozenset(t)
        for i in lists.candidates(t, row[2]):
            other = members[i][0]
            if other == row[0] or root(other) == root(row[0]):
                continue
            if slack + (den + num) * len(own & differences[i]) >= row[2] + members[i][2]:
                parent[root(row[0])] = root(other)
                out.append((row[0], other))
    return out


def _around(num: int, den: int):
    """Streams sorted (hub, block, kind, doc): a block's members are held (at most about ``BLOCK_SETS``), probes pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, probes = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if members and (found := linked_around(members, probes, num, den)):
                yield _batch(found, "a long, b long")

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if row[:2] != at:
                    yield from flush()
                    at, members, probes = row[:2], [], []
                (probes if row[2] else members).append(row[3:])
                if len(probes) >= BLOCK_SETS:
                    yield from flush()
                    probes = []
        yield from flush()

    return run


def _compared(rows: DataFrame, pairs: DataFrame, words: int, num: int, den: int, deltas: bool, tmp: Scratch) -> DataFrame:
    """The sets in ``pairs`` (written: doc, hub) compared with their hubs.

    A text crosses the shuffle once for each of its hubs, a hub's once a salt.
    """
    counts = tmp.written(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT_SETS).cast("int").alias("salts")))
    place = lambda hub, salt, kind: F.struct(hub.alias("hub"), salt.cast("int").alias("salt"), F.lit(kind).alias("kind"))
    member = pairs.join(offered(counts, 32), "hub").select("doc", place(F.col("hub"), F.pmod(F.xxhash64("doc"), F.col("salts")), 1).alias("to"))
    hubs = counts.select(F.col("hub").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s")).select("doc", place(F.col("doc"), F.col("s"), 0).alias("to"))
    wanted = tmp.written(member.unionAll(hubs).groupBy("doc").agg(F.collect_list("to").alias("to")))
    texts = marked(rows.select("doc", "text"), wanted, tmp).where("maybe").join(offered(wanted, F.size("to") * 24 + 64), "doc")
    bodies = texts.select(F.explode("to").alias("to"), "doc", "text").select("to.hub", "to.salt", "to.kind", "doc", "text")
    return bodies.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind", "doc").mapInArrow(lean(_compare(words, num, den, deltas)), DELTA if deltas else COST)


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows (hub, doc, open) dealt over blocks of their hub: one row in a set's own block (kind 0) and, of an open set, one in each other (kind 1)."""
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    place = F.struct(F.col("own").alias("block"), F.lit(0).alias("kind"))
    to = F.concat(F.array(place), F.when(~F.col("open"), F.array().cast("array<struct<block:int,kind:int>>")).otherwise(F.transform(others, lambda b: F.struct(b.alias("block"), F.lit(1).alias("kind")))))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.select("hub", F.explode(to).alias("to"), "doc", *columns).select("hub", "to.block", "to.kind", "doc", *columns)
    return rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "kind", "doc")


def _with_blocks(pairs: DataFrame, tmp: Scratch) -> DataFrame:
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    return offered(tmp.written(blocks), 32)


def links_by_hubs(rows: DataFrame, lists: DataFrame, named, marks: DataFrame, words: int, num: int, den: int, tmp: Scratch) -> DataFrame:
    """(a, b): links of the sets on ``lists`` (written: key, print, hub) with their hubs and with each other around a hub.

    ``named`` gives (doc, hub) and the fingerprints of pairs (print, hub); ``marks`` (written) has doc, n, sketch.  Texts
    are compared only where bitmaps leave a link possible.  The result is written (not in ``tmp``).
    """
    marks, pair = offered(marks, F.octet_length("sketch") + 48), ["doc", "hub"]
    pairs = tmp.written(named(lists.select("print", "hub").distinct()))
    hubs = marks.select(F.col("doc").alias("hub"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    likely = tmp.written(pairs.select(*pair).join(marks, "doc").join(hubs, "hub").select("doc", "hub", "n", "sketch", "m", "other").mapInArrow(lean(_likely(num, den)), "doc long, hub long"))
    costs = tmp.written(_compared(rows, likely, words, num, den, False, tmp))
    linked = tmp.written(costs.where(F.col("cost") <= (den - num) * F.col("size")).select(*pair))
    direct = linked.select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    # Sets that are not linked to their hub may be linked to others of a list that they share; sets of other lists need no
    # second look.
    out = tmp.written(pairs.join(offered(linked, 32), pair, "left_anti").select("print", F.col("hub_print").alias("hub")))
    keys = tmp.written(lists.join(offered(out, 32), ["print", "hub"]).select("key").distinct())
    some = tmp.written(lists.join(offered(keys, 24), "key", "left_semi"))
    several = tmp.written(some.groupBy("key").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select("key"))
    again = tmp.written(named(some.join(offered(several, 24), "key", "left_semi").select("print", "hub").distinct()).select(*pair))
    again = again.join(offered(linked.withColumn("to_hub", F.lit(True)), 32), pair, "left").select(*pair, F.col("to_hub").isNull().alias("open"))
    near = _dealt(again.join(marks, "doc").join(_with_blocks(again, tmp), "hub"), "open", "n", "sketch").mapInArrow(lean(_close(num, den)), "hub long, doc long")
    near = tmp.written(near.distinct().select(*pair))
    if near.isEmpty():
        return written(direct)
    deltas = _compared(rows, near, words, num, den, True, tmp).withColumn("open", F.col("cost") > (den - num) * F.col("size"))
    more = _dealt(deltas.join(_with_blocks(near, tmp), "hub"), "size", "cost", "gone", "added").mapInArrow(lean(_around(num, den)), "a long, b long")
    return written(direct.unionAll(more))


def linked_components(rows: DataFrame, classes: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, component) of the linked classes.  ``rows``: doc, text; ``classes`` (written): print, doc (one row a class);
    ``sets`` (written): doc, n, sketch."""
    spark = rows.sparkSession
    with Scratch(spark) as tmp:
        texts = rows.select("text")
        index = texts.mapInArrow(lean(_index(words, num, den)), "key long, print long")
        lists = tmp.written(index.groupBy("key").agg(F.min("print").alias("hub"), F.max("print").alias("last")).where("hub <> last").select("key", "hub"))
        bits = spark.sparkContext.broadcast(key_filter(lists, "key"))
        index = texts.mapInArrow(lean(_index(words, num, den, bits)), "key long, print long")
        entries = tmp.written(index.join(lists, "key").select("key", "print", "hub"))
        bits.unpersist()
        shared = tmp.written(entries.where("print <> hub").groupBy("print", "hub").agg(F.count(F.lit(1)).alias("n")))
        seen = shared.select("print").union(shared.select("hub")).distinct()
        nodes = tmp.written(classes.join(offered(tmp.written(seen), 24), "print", "left_semi").select("print", "doc"))
        hubs = nodes.select(F.col("print").alias("hub"), F.col("doc").alias("h"))
        named = lambda pairs: pairs.join(offered(nodes, 32), "print").join(offered(hubs, 32), "hub").select("doc", F.col("h").alias("hub"), "print", F.col("hub").alias("hub_print"))
        marks = tmp.written(sets.join(offered(nodes.select("doc"), 24), "doc", "left_semi").select("doc", "n", "sketch"))
        main = tmp.written(shared.groupBy("print").agg(F.max_by("hub", F.struct("n", "hub")).alias("main")))
        lists = entries.join(offered(main.withColumnRenamed("main", "hub"), 32), ["print", "hub"])
        first = links_by_hubs(rows, tmp.written(lists.select("key", "print", "hub")), named, marks, words, num, den, tmp)
        found = components(first)
        # Settled lists: one component, or all compared with the list's own hub.
        state = nodes.join(offered(main, 32), "print", "left").join(found.withColumnRenamed("node", "doc"), "doc", "left")
        state = tmp.written(state.select("print", F.coalesce("main", "print").alias("main"), F.coalesce("component", "doc").alias("label")))
        with_hub = (F.col("print") == F.col("hub")) | (F.col("main") == F.col("hub"))
        lists = entries.join(offered(state, 40), "print").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(with_hub.cast("int")).alias("all_with_hub"))
        unsettled = tmp.written(lists.where("low <> high and all_with_hub = 0").select("key"))
        if unsettled.isEmpty():
            return found
        rest = entries.where("print <> hub").join(offered(unsettled, 24), "key", "left_semi").select("key", "print", "hub")
        second = links_by_hubs(rows, tmp.written(rest), named, marks, words, num, den, tmp)
        label = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}0"))
        known = second.join(offered(label("a"), 32), "a", "left").join(offered(label("b"), 32), "b", "left")
        above = components(known.select(F.coalesce("a0", "a").alias("a"), F.coalesce("b0", "b").alias("b")))
        up = above.select(F.col("node").alias("component"), F.col("component").alias("up"))
        lower = found.join(offered(up, 32), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        fresh = above.join(found.select("node"), "node", "left_anti")
        return written(lower.unionByName(fresh))


def join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when den * (size of the intersection) >= num * (size of the union) and neither set is empty.
    """
    rows, numbered = identified(docs, text, doc_id)
    sets = written(rows.select("doc", "text").mapInArrow(lean(_prints(words)), "doc long, n long, f1 long, f2 long, sketch binary"))
    classes = written(sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("copies")))
    same = linked_components(rows, classes.select(F.col("f1").alias("print"), F.col("node").alias("doc")), sets, words, num, den)
    node = sets.drop("sketch").join(offered(classes.where("copies > 1").select("n", "f1", "f2", "node"), 56), ["n", "f1", "f2"], "left").withColumn("node", F.coalesce("node", "doc"))
    out = node.join(offered(same, 32), "node", "left").select("doc", "n", F.coalesce("component", "node").alias("component"))
    if not numbered:
        return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    # Numbers ascend with ids but for null ones, which come first: a component's name is the least id in it.
    out = out.join(rows.select("doc", "id"), "doc")
    named = written(out.groupBy("component").agg(F.min("id").alias("least")))
    return out.join(offered(named, 32), "component").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
