"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Words of a line are its runs of other than space, tab, vertical tab, form feed and carriage return.  A line (of at least
``min_words`` words) is dropped if an earlier line has the same words, or (from ``near_words`` words on) has them but for
one word that is replaced, added or missing.  Earlier means smaller (doc_id, text hash, line number); all lines are judged
on the input, whether or not the earlier line is itself dropped.

Plan.  Equal lines are aggregated first, so everything after sees distinct lines.  Two lines one edit apart agree on the
first or on the last half of the shorter one, so only lines that share such a half (four keys a line) go on.  Of those,
all variants with one word deleted are hashed (from running sums over the words: linear in a line's length), and equal
variants joined: deletions at one place are a replacement, a deletion equal to a whole line is an added word.  Of a key's
lines only the earliest is kept as partner, by an aggregate: no pairs within a group are made, and a key that many lines
share needs no large task.  Partners are verified word by word.

Cases: a null text stays null; blank and short lines stay; a repeated row (same id, same text) is treated like the first;
rows with a null id come before all others; an empty table gives an empty table; the other columns are passed through
whatever their names; the counts of lines and of dropped lines are added, as __n_lines and __n_dropped (with more
underscores behind where the table has such a column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, offered, written

MIN_WORDS, NEAR_WORDS = 4, 8
KEY = ["__h1", "__h2"]
ORD = ["__doc", "__th", "__line"]
LOW40 = (1 << 40) - 1


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def count_names(columns: list[str]) -> tuple[str, str]:
    """The names of the two counts beside these columns."""
    names = ["__n_lines", "__n_dropped"]
    while {n.lower() for n in names} & {c.lower() for c in columns}:
        names = [n + "_" for n in names]
    return names[0], names[1]


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\x0b\f\r", "    "), " "), "")


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body, own = F.col(quoted(text)), F.col(quoted(doc_id)).cast("long")
    return docs.where(body.isNotNull()).select(F.coalesce(own, F.lit(-(1 << 63))).alias("__doc"), F.xxhash64(body).alias("__th"), body.alias("__text"))


def _canonical(line: Column) -> Column:
    """A line's words joined by one space (``line`` without other white space): most lines are that already."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.array_join(words_of(line), " ")).otherwise(line)


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """ORD, the joined words, n and the hash of every line that may be dropped.

    Lines are made canonical before they become rows, so that the filter on their words does not repeat that.
    """
    text, other = F.col("__text"), "\t\x0b\f\r"
    has = F.contains(text, F.lit(other[0]))
    for c in other[1:]:
        has = has | F.contains(text, F.lit(c))
    plain = F.when(has, F.translate(text, other, "    ")).otherwise(text)
    lines = rows.select("__doc", "__th", F.posexplode(F.transform(F.split(plain, "\n"), _canonical)).alias("__line", "__c"))
    n = F.when(F.col("__c") != "", F.octet_length("__c") - F.octet_length(F.replace("__c", F.lit(" "), F.lit(""))) + 1).otherwise(0)
    return lines.where(n >= min_words).select(*ORD, "__c", n.alias("__n"), F.xxhash64("__c").alias("__h1"), F.xxhash64(F.lit(7), "__c").alias("__h2"))


def _half_keys(near_words: int) -> Column:
    """The keys of a line's halves: as the shorter (or equal) line of a pair, and as the longer one."""
    c, n = F.col("__c"), F.col("__n")
    keys = []
    for small in (n, n - 1):
        h = F.floor(small / 2).cast("int")
        ok = small >= near_words
        keys.append(F.when(ok, F.xxhash64(F.lit(1), small, F.call_function("substring_index", c, F.lit(" "), h))))
        keys.append(F.when(ok, F.xxhash64(F.lit(2), small, F.call_function("substring_index", c, F.lit(" "), h - small))))
    return F.array(*keys)


def _variants(lines: DataFrame) -> DataFrame:
    """vkey, pos (the deleted word, -1: none), n of the variant, and the line's keys."""
    words = lines.select(*KEY, *ORD, "__n", F.posexplode("__w").alias("__p", "__word"))
    at = F.xxhash64("__word", "__p")
    moved = F.xxhash64("__word", F.col("__p") - 1)
    parts = {"a": F.shiftrightunsigned(at, 24), "b": at.bitwiseAND(F.lit(LOW40)), "c": F.shiftrightunsigned(moved, 24), "d": moved.bitwiseAND(F.lit(LOW40))}
    words = words.select(*KEY, *ORD, "__n", "__p", *(c.alias(f"__{k}") for k, c in parts.items()))
    w = Window.partitionBy(*KEY)
    run = w.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    for k in parts:
        words = words.withColumn(f"__run_{k}", F.sum(f"__{k}").over(run))
    for k in ("c", "d"):
        words = words.withColumn(f"__all_{k}", F.sum(f"__{k}").over(w))
    c = F.col
    one = words.select(*KEY, *ORD, c("__p").alias("__pos"), c("__n"), (c("__run_a") - c("__a") + c("__all_c") - c("__run_c")).alias("__x"), (c("__run_b") - c("__b") + c("__all_d") - c("__run_d")).alias("__y"), c("__run_a"), c("__run_b"))
    # The last word's row stands for the whole line, too.
    own = F.struct(c("__pos"), F.xxhash64("__x", "__y", c("__n") - 1).alias("__v"))
    whole = F.struct(F.lit(-1).alias("__pos"), F.xxhash64("__run_a", "__run_b", "__n").alias("__v"))
    return one.select(*KEY, *ORD, F.explode(F.when(c("__pos") == c("__n") - 1, F.array(own, whole)).otherwise(F.array(own))).alias("__e")).select(*KEY, *ORD, "__e.__pos", "__e.__v")


def _one_apart(x: Column, y: Column) -> Column:
    """Whether two arrays of words differ in one word: replaced, added or missing."""

    def longer(a: Column, b: Column) -> Column:  # b has one word more than a
        n = F.size(a)
        first = F.array_position(F.zip_with(a, F.slice(b, F.lit(1), n), lambda p, q: p != q), True)
        i = F.when(first == 0, n).otherwise(first - 1).cast("int")
        return F.slice(b, i + 2, n - i) == F.slice(a, i + 1, n - i)

    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d)) <= 1
    return F.when(F.size(x) == F.size(y), same).when(F.size(y) == F.size(x) + 1, longer(x, y)).when(F.size(x) == F.size(y) + 1, longer(y, x)).otherwise(False)


def near_lines(distinct: DataFrame, rows: DataFrame, near_words: int, tmp: Scratch) -> DataFrame:
    """KEY of the distinct lines that have an earlier line one word apart.

    ``distinct`` (written) has KEY, ORD of the first occurrence and the half keys; ``rows`` has the texts, of which only
    those with a line that goes on are split again.
    """
    halves = distinct.where(F.size("__keys") > 0).select(*KEY, *ORD, F.explode("__keys").alias("__k")).where("__k is not null")
    shared = tmp.written(halves.groupBy("__k").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__k"))
    some = tmp.written(halves.join(offered(shared, 24), "__k", "left_semi").select(*KEY, *ORD).distinct())
    holders = tmp.written(some.select("__doc", "__th").distinct())
    split = rows.join(offered(holders, 40), ["__doc", "__th"], "left_semi").select("__doc", "__th", F.posexplode(F.split("__text", "\n")).alias("__line", "__s"))
    texts = split.join(offered(some, 64), ORD).select(*KEY, *ORD, words_of(F.col("__s")).alias("__w"))
    texts = tmp.written(texts.withColumn("__n", F.size("__w")).dropDuplicates([*KEY]))
    variants = tmp.written(_variants(texts))
    me = F.struct(*ORD, *KEY)
    cells = tmp.written(variants.groupBy("__v", "__pos").agg(F.min(me).alias("__m"), F.count(F.lit(1)).alias("__c")))
    whole = F.col("__pos") == -1
    across = cells.groupBy("__v").agg(F.min(F.when(whole, F.col("__m"))).alias("__full"), F.min(F.when(~whole, F.col("__m"))).alias("__cut"), F.sum("__c").alias("__all")).where("__all > 1")
    partner = F.when(whole, F.col("__cut")).otherwise(F.least(F.col("__m"), F.coalesce("__full", "__m")))
    table = tmp.written(cells.join(across, "__v").select("__v", "__pos", partner.alias("__partner")).where("__partner is not null"))
    pairs = variants.select("__v", "__pos", *KEY, *ORD).join(offered(table, 96), ["__v", "__pos"])
    pairs = pairs.where(F.col("__partner") < me).select(*KEY, F.col("__partner.__h1").alias("__p1"), F.col("__partner.__h2").alias("__p2")).distinct()
    mine = texts.select(*KEY, F.col("__w").alias("__x"))
    other = texts.select(F.col("__h1").alias("__p1"), F.col("__h2").alias("__p2"), F.col("__w").alias("__y"))
    checked = pairs.join(mine, KEY).join(other, ["__p1", "__p2"]).where(_one_apart(F.col("__x"), F.col("__y")))
    return checked.select(*KEY).distinct()


def dropped_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(__doc, __th, __drop): the numbers of the lines of each text that are dropped, ascending.  Written."""
    rows = _rows(docs, text, doc_id)
    with Scratch(docs.sparkSession) as tmp:
        # The hashes of all lines are written (some 70 bytes a line), so that texts are split and hashed once.
        lines = tmp.written(_lines(rows, min_words).select(*KEY, *ORD, F.when(F.col("__n") >= near_words, _half_keys(near_words)).alias("__keys")))
        distinct = lines.groupBy(*KEY).agg(F.min(F.struct(*ORD)).alias("__o"), F.count(F.lit(1)).alias("__c"), F.first("__keys").alias("__keys"))
        distinct = tmp.written(distinct.select(*KEY, *(F.col(f"__o.{o}") for o in ORD), "__c", "__keys"))
        near = tmp.written(near_lines(distinct, rows, near_words, tmp).withColumn("__near", F.lit(True)))
        verdict = distinct.select(*KEY, *(F.col(o).alias(f"{o}0") for o in ORD), "__c").join(offered(near, 40), KEY, "left")
        verdict = tmp.written(verdict.where("__c > 1 or __near").withColumn("__near", F.coalesce("__near", F.lit(False))))
        first = (F.col("__doc") == F.col("__doc0")) & (F.col("__th") == F.col("__th0")) & (F.col("__line") == F.col("__line0"))
        hits = lines.select(*KEY, *ORD).join(offered(verdict, 96), KEY).where(F.col("__near") | ~first)
        return written(hits.groupBy("__doc", "__th").agg(F.array_sort(F.collect_set("__line")).alias("__drop")))


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``, and the two counts (:func:`count_names`) of each row.

    The line numbers join the texts by broadcast while their counted size is under the bound, else by a shuffle.
    """
    drops = dropped_lines(docs, text=text, doc_id=doc_id, min_words=min_words, near_words=near_words)
    drops = offered(drops, F.size("__drop") * 8 + 80)
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("__row")
    body, own = F.col(quoted(text)), F.col(quoted(doc_id)).cast("long")
    keyed = docs.select(row, F.coalesce(own, F.lit(-(1 << 63))).alias("__doc"), F.xxhash64(body).alias("__th"), F.split(body, "\n").alias("__lines"))
    out = keyed.join(drops, ["__doc", "__th"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    old = F.col(f"__row.{quoted(text)}")
    new = F.when(F.col("__drop").isNull(), old).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    columns = [new.alias(c) if c == text else F.col(f"__row.{quoted(c)}").alias(c) for c in docs.columns]
    counts = F.coalesce(F.size("__lines"), F.lit(0)).cast("long"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    return out.select(*columns, *(c.alias(n) for c, n in zip(counts, count_names(docs.columns), strict=True)))
