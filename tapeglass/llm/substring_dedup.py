"""Substring dedup: repeated word windows by De Bruijn compaction.

Windows of ``WINDOW`` words are the edges of a De Bruijn graph whose nodes are the (WINDOW - 1)-mers at their ends.

1. Partition.  Consecutive windows of a text that share their least ``SEED``-mer (its hash picks it, so equal windows pick
   alike) are one path around that seed.  Seeds that occur once anywhere hold no repeated edge and are dropped by a count;
   of the others, equal paths meet in one row with their earliest source coordinate.  A seed with one path only is one
   edge of several windows; where a seed has several different paths, they are opened into their windows.
2. Graph.  Edges that occur twice or more are kept, each with its earliest source coordinate and the hashes of the two
   nodes it joins.  In- and out-degrees of the nodes are counted; at a node with one edge in and one out, whose sources are
   adjacent too, the two edges are linked, and joins that double the links' reach compact each nonbranching chain into one
   path with one source coordinate.
3. Sources.  An edge of a text is a repeat if that earliest coordinate is not its own.  Runs of repeats along one
   compacted path are one span; the path's words are read at its source coordinate, once, and sent to its spans; a span
   is removed only if the words at both coordinates are equal.

Counts and minima are combined before each shuffle; a passage in a third of all documents is one edge row after the first
aggregate, and one row of words; adaptive execution splits the joins that bring it back to its sources.

Cases: a null or empty text has no words; earlier means smaller (id, start); a null id comes first; texts that share an id
but differ are sources of their own, in the order of their hashes; repeated rows (same id, same text) count as one source
and are treated alike; an empty table gives an empty table; columns other than those named are not read.  A text is held
whole while it is hashed (some 80 bytes a byte of it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import U, Chunk, chunks, lean, mix, run_hashes, window_hashes
from .shared import Scratch, identified, key_filter, marked, offered, passes, written

WINDOW, SEED = 20, 8
#: Windows of one source within which chains are compacted by one aggregate, before the joins.
STRETCH = 256


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the least value of each ``width`` consecutive ones, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        size += step
    return best[:n]


def paths(c: Chunk, window: int, seed: int) -> dict[str, np.ndarray]:
    """The compacted paths of all texts of a chunk: per path its text, first window, number of windows and seed hash.

    ``start`` is the window's position within the text, ``at`` that within the chunk's words.
    """
    _, _, cuts = c.words()
    n = np.diff(cuts)
    hashes = c.hashes()
    seeds = window_hashes(hashes, seed)
    pick = _least(seeds, window - seed + 1)
    owner = c.owner(n)
    at = np.arange(len(pick))
    at = at[owner[at] == owner[at + window - 1]] if len(at) else at
    if not len(at):
        z = np.zeros(0, np.int64)
        return {"text": z, "at": z, "count": z, "seed": np.zeros(0, U), "hashes": hashes, "cuts": cuts}
    mine = pick[at]
    new = np.ones(len(at), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (owner[at][1:] != owner[at][:-1])
    first = np.flatnonzero(new)
    return {"text": owner[at[first]], "at": at[first], "count": np.diff(np.append(first, len(at))), "seed": seeds[mine[first]], "hashes": hashes, "cuts": cuts}


def path_hashes(p: dict[str, np.ndarray], window: int) -> list[np.ndarray]:
    """Two hashes of each path's words (all words of its windows)."""
    return [run_hashes(mix(p["hashes"], salt), p["at"], p["count"] + window - 1) for salt in (41, 42)]


def _ids(batch: pa.RecordBatch, c: Chunk) -> np.ndarray:
    return batch.column(0).slice(c.first, c.n).to_numpy(zero_copy_only=False)


def _seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                found, counts = np.unique(paths(c, window, seed)["seed"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["seed", "n"])

    return run


def _paths(window: int, seed: int, filter_):
    names = ["seed", "p1", "p2", "windows", "doc", "start", "leads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for batch in batches:
            for c in chunks(batch.column(1)):
                p = paths(c, window, seed)
                seen = passes(bits, p["seed"])
                p = {**p, **{k: p[k][seen] for k in ("text", "at", "count", "seed")}}
                h1, h2 = path_hashes(p, window)
                start = p["at"] - p["cuts"][:-1][p["text"]]
                order = np.lexsort((h2, h1, p["text"]))
                leads = np.ones(len(order), bool)
                leads[order[1:]] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]]) | (p["text"][order[1:]] != p["text"][order[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(p["seed"].view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(p["count"].astype(np.int32)), pa.array(_ids(batch, c)[p["text"]]), pa.array(start.astype(np.int32)), pa.array(leads)], names=names)

    return run


def _open(window: int, seed: int):
    """The edges of the wanted paths, from the text that has them first: path hashes, position in the path, windows, edge
    hashes, nodes, occurrences of the path, and the source coordinate."""
    names = ["p1", "p2", "k", "w", "e1", "e2", "l", "r", "n", "doc", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                p = paths(c, window, seed)
                start = p["at"] - p["cuts"][:-1][p["text"]]
                wanted = batch.column(2).slice(c.first, c.n).to_pylist()
                keep, times = [], []
                edges = np.searchsorted(p["text"], np.arange(c.n + 1))
                for i, w in enumerate(wanted):
                    keep += (edges[i] + np.searchsorted(start[edges[i] : edges[i + 1]], [x["start"] for x in w])).tolist()
                    times += [x["n"] for x in w]
                if not keep:
                    continue
                p = {**p, **{k: p[k][keep] for k in ("text", "at", "count", "seed")}}
                start, times = start[keep], np.array(times)
                whole, times = times < 0, np.abs(times)  # a path that is not opened has its number negated
                h1, h2 = path_hashes(p, window)
                n = np.where(whole, 1, p["count"])
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(np.arange(len(n)), n)
                at, w = p["at"][of] + k, np.where(whole, p["count"], 1)[of]
                e = [np.where(whole[of], h[of], window_hashes(mix(p["hashes"], salt), window)[at]) for salt, h in ((43, h1), (44, h2))]
                node = window_hashes(mix(p["hashes"], 45), window - 1)
                ids = _ids(batch, c)[p["text"]]
                cols = (h1[of], h2[of], k.astype(np.int32), w.astype(np.int32), *e, node[at], node[at + w], times[of], ids[of], (start[of] + k).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == U else x) for x in cols], names=names)

    return run


def compacted(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """doc, start, head of every edge: the first window of the nonbranching chain that holds it.  Written.

    ``edges`` (written): doc, start (source coordinate, unique), w (windows), l, r (nodes).
    """
    ends = edges.select(F.col("l").alias("v"), F.lit(0).alias("into"), "doc", "start", "w").unionAll(edges.select(F.col("r").alias("v"), F.lit(1).alias("into"), "doc", "start", "w"))
    side = lambda i: F.max(F.when(F.col("into") == i, F.struct("doc", "start", "w")))
    nodes = ends.groupBy("v").agg(F.sum("into").alias("in"), F.sum(1 - F.col("into")).alias("out"), side(1).alias("a"), side(0).alias("b"))
    plain = nodes.where("`in` = 1 and out = 1 and a.doc = b.doc and a.start + a.w = b.start")
    before = plain.select("b.doc", "b.start", F.col("a.start").alias("up"))
    linked = edges.select("doc", "start").join(before, ["doc", "start"], "left")
    # Within a stretch of a source (a bounded number of rows) the chain's first window is the last one without a link.
    near = Window.partitionBy("doc", "stretch").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    linked = linked.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    opens = F.col("up").isNull() | (F.floor(F.col("up") / STRETCH) < F.col("stretch"))
    local = tmp.written(linked.select("doc", "start", "up", F.last(F.when(opens, F.col("start")), ignorenulls=True).over(near).alias("local"), (opens & F.col("up").isNotNull()).alias("walks")))
    # A chain that comes from another stretch: the reach of its links doubles with every join.
    at = local.where("local = start").select("doc", "start", "up", "walks")
    walking = tmp.written(local.where("walks").select("doc", "start", F.col("up").alias("to")).join(local.select("doc", F.col("start").alias("to"), "local"), ["doc", "to"]).select("doc", "start", F.col("local").alias("to")))
    found = at.where("not walks").select("doc", "start", F.col("start").alias("head"))
    while not walking.isEmpty():
        above = found.select("doc", F.col("start").alias("to"), "head", F.lit(None).cast("int").alias("next")).unionAll(walking.select("doc", F.col("start").alias("to"), F.lit(None).cast("int").alias("head"), F.col("to").alias("next")))
        step = tmp.written(above.join(offered(walking, 24), ["doc", "to"]).select("doc", "start", "head", F.col("next").alias("to")))
        found = found.unionAll(step.where("head is not null").select("doc", "start", "head"))
        walking = step.where("head is null").select("doc", "start", "to")
    heads = found.select("doc", F.col("start").alias("local"), "head")
    return tmp.written(local.select("doc", "start", "local").join(heads, ["doc", "local"]).select("doc", "start", "head"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, stretch, from, words) of the wanted stretches of texts: (doc, text, array of stretch, from, number of words)."""
    for batch in batches:
        for c in chunks(batch.column(1)):
            starts, ends, cuts = c.words()
            found: list[tuple] = []
            raw = c.buf.tobytes()
            for i, (doc, wanted) in enumerate(zip(_ids(batch, c).tolist(), batch.column(2).slice(c.first, c.n).to_pylist(), strict=True)):
                for x in wanted:
                    at = slice(cuts[i] + x["from"], cuts[i] + x["from"] + x["words"])
                    found.append((doc, x["stretch"], x["from"], " ".join([raw[p:q].decode() for p, q in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])))
            cols = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["source", "stretch", "from", "words"])


def repeated_spans(rows: DataFrame, several_rows: bool, *, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc, spans: for each document with repeats, its runs of windows (a, w) that start earlier, and the words there.  Written.

    ``rows``: doc, text; ``several_rows``: whether a doc may have several (equal) rows.
    """
    spark = rows.sparkSession
    once = lambda df, *key: df.dropDuplicates([*key]) if several_rows else df
    with Scratch(spark) as tmp:
        seeds = rows.select("doc", "text").mapInArrow(lean(_seeds(window, seed)), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")
        shared = tmp.written(seeds.select("seed"))
        bits = spark.sparkContext.broadcast(key_filter(shared, "seed"))
        sources = rows.select("doc", "text").mapInArrow(lean(_paths(window, seed, bits)), "seed long, p1 long, p2 long, windows int, doc long, start int, leads boolean")
        # What the filter lets through besides is a path by itself, which the next steps drop.
        sources = tmp.written(once(sources, "doc", "start"))
        bits.unpersist()
        # Equal paths meet: one row a path, with its earliest source (of one text's, that which leads).
        merged = tmp.written(sources.groupBy("p1", "p2", "windows").agg(F.min("doc").alias("doc"), F.min_by("start", F.when(F.col("leads"), F.col("doc"))).alias("start"), F.count(F.lit(1)).alias("n"), F.min("seed").alias("seed")))
        several = tmp.written(merged.groupBy("seed").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1").select("seed", F.lit(True).alias("opened")))
        known = merged.join(offered(several, 24), "seed", "left").where("opened or n > 1")
        n = F.when(F.col("opened"), F.col("n")).otherwise(-F.col("n"))
        wanted = tmp.written(known.groupBy("doc").agg(F.collect_list(F.struct("start", n.alias("n"))).alias("starts")))
        texts = marked(rows.select("doc", "text"), wanted, tmp).where("maybe").join(wanted, "doc").select("doc", "text", "starts")
        edges = texts.mapInArrow(lean(_open(window, seed)), "p1 long, p2 long, k int, w int, e1 long, e2 long, l long, r long, n long, doc long, start int")
        edges = tmp.written(once(edges, "p1", "p2", "k"))
        graph = edges.groupBy("e1", "e2").agg(F.min(F.struct("doc", "start")).alias("first"), F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("w", "l", "r"))).where("n > 1")
        graph = tmp.written(graph.select("e1", "e2", "first.doc", "first.start", "w", "l", "r"))
        chains = chained(graph, compacted(graph, tmp))
        # The pieces of each path that lie on one stretch of a source.
        on = edges.select("p1", "p2", "k", "w", "e1", "e2").join(tmp.written(chains), ["e1", "e2"])
        pieces = _runs(on, ("p1", "p2"), "k")
        pieces = tmp.written(pieces.groupBy("p1", "p2").agg(F.collect_list(F.struct("k", "w", "source", "at", "stretch")).alias("pieces")))
        hits = sources.select("p1", "p2", "doc", "start").join(pieces, ["p1", "p2"]).select("doc", "start", F.explode("pieces").alias("s"))
        hits = hits.select("doc", (F.col("start") + F.col("s.k")).alias("a"), "s.w", "s.source", "s.at", "s.stretch").where("doc <> source or a <> at")
        # Repeats that go on along the source are one span.
        spans = tmp.written(_runs(hits, ("doc",), "a"))
        # The words of each stretch that has spans, at its source coordinate.
        used = spans.groupBy("source", "stretch").agg(F.min("at").alias("from"), F.max(F.col("at") + F.col("w")).alias("to"))
        wanted = tmp.written(used.groupBy(F.col("source").alias("doc")).agg(F.collect_list(F.struct("stretch", "from", (F.col("to") - F.col("from") + window - 1).alias("words"))).alias("stretches")))
        words = marked(rows.select("doc", "text"), wanted, tmp).where("maybe").join(wanted, "doc").select("doc", "text", "stretches").mapInArrow(lean(_words), "source long, stretch int, from int, words string")
        words = tmp.written(once(words, "source", "stretch"))
        part = F.array_join(F.slice(F.split("words", " "), F.col("at") - F.col("from") + 1, F.col("w") + window - 1), " ")
        checked = spans.join(words, ["source", "stretch"]).select("doc", F.struct("a", "w", part.alias("words")).alias("s"))
        return written(checked.groupBy("doc").agg(F.collect_list("s").alias("spans")))


def chained(graph: DataFrame, heads: DataFrame) -> DataFrame:
    """e1, e2, source, at, stretch of every edge: chains that follow each other in one source are a stretch of it.

    ``stretch`` is its first window.  The chains of a source are ordered in one task: they are no more than its windows.
    """
    placed = graph.select("e1", "e2", "doc", "start", "w").join(heads, ["doc", "start"])
    chains = placed.groupBy("doc", "head").agg(F.max(F.col("start") + F.col("w")).alias("end"))
    order = Window.partitionBy("doc").orderBy("head")
    first = F.when(F.coalesce(F.lag("end").over(order) != F.col("head"), F.lit(True)), F.col("head"))
    stretches = chains.select("doc", "head", first.alias("first")).select("doc", "head", F.last("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return placed.join(stretches, ["doc", "head"]).select("e1", "e2", F.col("doc").alias("source"), F.col("start").alias("at"), "stretch")


def _runs(rows: DataFrame, by: tuple[str, ...], place: str) -> DataFrame:
    """Rows (``place``, w windows) that follow each other both here and in their source, as one: by, place, w, source, at, stretch."""
    order = Window.partitionBy(*by).orderBy(place)
    goes_on = (F.lag(F.col(place) + F.col("w")).over(order) == F.col(place)) & (F.lag("source").over(order) == F.col("source")) & (F.lag(F.col("at") + F.col("w")).over(order) == F.col("at"))
    rows = rows.withColumn("new", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "run").agg(F.min(place).alias(place), F.sum("w").cast("int").alias("w"), F.first("source").alias("source"), F.min("at").alias("at"), F.first("stretch").alias("stretch"))


def joined(c: Chunk, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words joined by one space, text by text without a break, and the words' starts among them.

    ``starts`` and ``ends`` are of words in ``c.buf``, ``cuts`` the texts' offsets among the words.
    """
    size = (ends - starts).astype(np.int64)
    spaced = np.ones(len(size), np.int64)
    spaced[cuts[:-1][cuts[:-1] < len(size)]] = 0  # no space before a text's first word
    at = np.cumsum(size + spaced) - size
    out = np.full(int((size + spaced).sum()), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + inside] = c.buf[np.repeat(starts, size) + inside]
    return out, at


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            having, edges = lists.is_valid().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            a, w, words = (lists.values.field(k) for k in ("a", "w", "words"))
            a, w = a.to_numpy(), w.to_numpy()
            words_at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
            there = memoryview(words.buffers()[2]).cast("B") if len(words) and words.buffers()[2] is not None else memoryview(b"")
            for c in chunks(batch.column(1)):
                starts, ends, cuts = c.words()
                n = np.diff(cuts)
                gone = np.zeros(len(starts), bool)
                own = np.flatnonzero(having[c.first : c.first + c.n])
                if len(own):
                    out, at = joined(c, starts, ends, cuts)
                    here, last = memoryview(out), at + (ends - starts)
                    cover = np.zeros(len(starts) + 1, np.int64)
                    of = np.concatenate([np.arange(edges[c.first + i], edges[c.first + i + 1]) for i in own])
                    first = np.repeat(cuts[own], edges[c.first + own + 1] - edges[c.first + own]) + a[of]
                    behind = first + w[of] + window - 1
                    # Of the spans those whose words are the ones at their source.
                    same = [here[x:y] == there[u:v] for x, y, u, v in zip(at[first].tolist(), last[behind - 1].tolist(), words_at[of].tolist(), words_at[of + 1].tolist(), strict=True)]
                    np.add.at(cover, first[same], 1)
                    np.add.at(cover, behind[same], -1)
                    gone = np.cumsum(cover)[:-1] > 0
                total = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=total[1:])
                kept = cuts - total[cuts]
                out, at = joined(c, starts[~gone], ends[~gone], kept)
                # A text's bytes end where the next one's begin.
                places = np.append(at, len(out))[kept] if len(at) else np.zeros(c.n + 1, np.int64)
                texts = pa.Array.from_buffers(pa.large_string(), c.n, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(n), pa.array(total[cuts[1:]] - total[cuts[:-1]]), texts], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words kept, joined by one space) of every document.

    Texts without a repeat are passed by; the others are joined with their spans.
    """
    rows, numbered = identified(docs, text, doc_id, merged=True)
    spans = repeated_spans(rows, numbered, window=window, seed=seed)
    rows = marked(rows, spans.select("doc"), Scratch(docs.sparkSession))  # its filter stays: the result reads it
    found = rows.where("maybe").join(spans, "doc", "left").select("id", "text", "spans")
    rest = rows.where("not maybe").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return found.unionAll(rest).mapInArrow(lean(_kept(window)), "doc_id long, n_words long, n_removed long, kept string")
