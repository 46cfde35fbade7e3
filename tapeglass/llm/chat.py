"""Chat formatting from reply trees.

Messages form trees by their parent's id.  Self-joins with pointer doubling (2, 4, 8 ... steps up) find each message's
root, depth and the summed score of its path; leaves are ranked within their tree by that score; the messages on the
chosen leaves' paths are marked by walking the same jumps down again, and each chosen path is written as one conversation.
The number of joins grows with the logarithm of the depth.

Template: ``<s>`` then, for each turn, ``[role]`` text ``[/role]``, and ``</s>``.  In roles and texts ``\\``, ``<``, ``[`` and
``]`` are preceded by ``\\``, so a control string inside a text cannot be taken for one of the template's, and :func:`parse`
gives every text back.  The loss mask is an output: the spans (code points of the formatted string, end exclusive) of the
assistant's texts, in order; :func:`unescape` of a span is that text.

Ids may be of any type that joins can compare; those of :func:`linear_nodes` are pairs of conversation and place, so no two
messages share one.  The table of conversations has one row a turn and no parents, so its trees are chains and the best
branch is the only one; trees that branch come from a source with parents and scores.

Cases: a null text or role is empty; a null score is 0; a message whose parent is not in the table is a root; messages
that reach no root (a cycle) belong to no path and are left out; of several rows with one id the least by parent, role,
text and score is the message; rows of a conversation that are equal, or equal in turn, are turns of their own (ordered by
turn, role, text); an empty table formats nothing; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import bounded, lean
from .shared import offered, written

START, STOP = "<s>", "</s>"
LEARNED = "assistant"
TURN = re.compile(r"\[((?:[^\\<\[\]]|\\.)*)\]((?:[^\\<\[]|\\.)*)\[/\1\]", re.S)


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<\[\]])", r"\\$1")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; raises ValueError if it is not one."""
    if not (formatted.startswith(START) and formatted.endswith(STOP)):
        raise ValueError("not a conversation")
    turns, at, end = [], len(START), len(formatted) - len(STOP)
    while at < end:
        m = TURN.match(formatted, at, end)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def ranked_leaves(nodes: DataFrame, top: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """(root, leaf, path_score, depth, rank) of the ``top`` best branches of each tree, and the jump tables.

    ``nodes`` has id, parent, score; ids are unique.  Equal scores: the deeper path, then the lower leaf id.
    """
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    known = nodes.select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).join(ids, "parent", "left")
    own = written(known.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), "score"))
    # top_id: the highest message reached; up: the next jump from it; total: the scores passed.  Only messages that have
    # not reached their root yet go through a round; those that have are kept aside, as targets of the others' jumps.
    first = own.select("id", F.col("id").alias("top_id"), "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    done, walking = first.where("up is null"), first.where("up is not null")
    jumps: list[DataFrame] = []
    n = None
    while (left := walking.count()) and left != n:  # no message arrived: what is left walks in circles
        n = left
        jumps.append(walking.select("id", "up"))
        above = done.unionByName(walking).select(F.col("id").alias("up"), F.col("top_id").alias("a_top"), F.col("up").alias("a_up"), F.col("total").alias("a_total"), F.col("depth").alias("a_depth"))
        step = written(above.join(offered(walking, 96), "up").select("id", F.col("a_top").alias("top_id"), F.col("a_up").alias("up"), (F.col("total") + F.col("a_total")).alias("total"), (F.col("depth") + F.col("a_depth")).alias("depth")))
        done, walking = done.unionByName(step.where("up is null")), step.where("up is not null")
    parents = own.where("up is not null").select(F.col("up").alias("id")).distinct()
    leaves = done.join(parents, "id", "left_anti")
    # Rank 1 needs no window: a minimum that is combined before the shuffle.
    if top == 1:
        best = leaves.groupBy("top_id").agg(F.min(F.struct((-F.col("total")).alias("total"), (-F.col("depth")).alias("depth"), "id")).alias("b"))
        chosen = best.select(F.col("top_id").alias("root"), F.col("b.id").alias("leaf"), (-F.col("b.total")).alias("path_score"), (-F.col("b.depth")).alias("depth"), F.lit(1).alias("rank"))
    else:
        w = Window.partitionBy("top_id").orderBy(F.desc("total"), F.desc("depth"), "id")
        chosen = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(F.col("top_id").alias("root"), F.col("id").alias("leaf"), F.col("total").alias("path_score"), "depth", "rank")
    return written(chosen), jumps


def path_nodes(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, id, steps) for every message on the chosen leaves' paths; steps counts from the leaf up."""
    on = chosen.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("steps"))
    for k in reversed(range(len(jumps))):
        up = on.join(jumps[k], "id").select("leaf", F.col("up").alias("id"), (F.col("steps") + (1 << k)).alias("steps"))
        on = written(on.union(up))
    return on


def linear_nodes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations without branches: each row's parent is the row before it (by turn, role, text).

    Gives id, parent, score, conv, turn, role, text.  A null conversation id is a conversation of its own.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(w).cast("long"))
    # A null conversation's places are negative: a pair of its own.
    known = F.col("conv").isNotNull()
    key = lambda n: F.struct(F.coalesce("conv", F.lit(0)).alias("conv"), F.when(known, n).otherwise(-n).alias("n"))
    return rows.select(key(F.col("n")).alias("id"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent"), F.lit(1.0).alias("score"), "conv", "turn", "role", "text")


def format_paths(nodes: DataFrame, top: int = 1, *, unique: bool = False) -> DataFrame:
    """conv, leaf, rank, n_turns, formatted, loss_mask of the ``top`` best branches of every tree of ``nodes`` (written once).

    ``unique``: ids are known to be unique, and are not checked.
    """
    nodes = written(bounded(nodes).select("id", "parent", F.col("score").cast("double").alias("score"), "conv", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("id is not null"))
    if not unique and nodes.count() > nodes.select("id").distinct().count():
        least = nodes.groupBy("id").agg(F.min(F.struct("parent", "role", "text", "score", "conv")).alias("m"))
        nodes = written(least.select("id", "m.*"))
    chosen, jumps = ranked_leaves(nodes.select("id", "parent", "score"), top)
    path = path_nodes(chosen, jumps).join(nodes.select("id", "conv", "role", "text"), "id")
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    turns = path.select("leaf", "conv", "steps", (F.col("role") == LEARNED).alias("learned"), F.concat(F.lit("["), role, F.lit("]")).alias("head"), text.alias("body"), F.concat(F.lit("[/"), role, F.lit("]")).alias("tail"))
    # Where each turn starts: the lengths of those before it on its path.
    size = F.length("head") + F.length("body") + F.length("tail")
    before = Window.partitionBy("leaf").orderBy(F.desc("steps")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.lit(len(START)) + F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learned"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    turns = turns.select("leaf", "conv", F.struct((-F.col("steps")).alias("o"), F.concat("head", "body", "tail").alias("t"), span.alias("loss")).alias("turn"))
    grouped = turns.groupBy("leaf").agg(F.first("conv").alias("conv"), F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("ts"))
    body = F.concat(F.lit(START), F.array_join(F.transform("ts", lambda x: x["t"]), ""), F.lit(STOP))
    mask = F.filter(F.transform("ts", lambda x: x["loss"]), lambda x: x.isNotNull())
    return grouped.join(chosen.select("leaf", "rank"), "leaf").select("conv", "leaf", "rank", "n_turns", body.alias("formatted"), mask.alias("loss_mask"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for s, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse(s)
            all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
            loss = "".join(unescape(s[m["start"] : m["end"]]) for m in mask)
            rows.append((len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    """What :func:`parse` and the loss mask give back of each formatted conversation, as counts and digests."""
    return formatted.select("conv", "formatted", "loss_mask").mapInArrow(lean(_read_back), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
