"""Packing, chat formatting and the pipeline."""

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeglass.llm import chat, language, packing, queries
from tapeglass.llm.kernel import chunks
from tapeglass.llm.tokens import encoder
from tests.conftest import DATA

from . import brute
from .conftest import odd_documents

HARD = ["", "a", "  ", "\n\n x", "don't  won't'll 'll ' s x's\n's", "it''s !'s 's'", "a　b", "日本 語 12³½ x²", "\t\tfoo  \n bar   ", "😀 hi", "<|endoftext|> ok", "\x85a\xa0b\xa0 c", "١٢ a'reb a'lla 'r", "'", "' ", "a'", "_a_ b_c", "\x1c\x1da", "x'veal 'tis I'm'd"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_are_the_librarys(spark, library):
    texts = HARD + [r["text"] for r in queries.table(spark, DATA, "documents").limit(80).collect()]
    e = encoder(queries.tokenizer_path())
    for most in (50, 1 << 20):
        got = []
        for c in chunks(pa.array(texts), most):
            ids, cuts = e.texts(c)
            got += [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == [library(t) for t in texts]


def check_packing(rows, docs, library):
    """Every id of every document lies in one piece; sequences are full from 0 without gaps."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for s in by_seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    for d, t in docs:
        raw = np.array([*library(t or ""), 1], "<u4")
        mine = sorted(by_doc[d], key=lambda r: r["start"])
        copies = sum(x == d for x, _ in docs)
        for i, r in enumerate(mine[::copies]):
            assert r["start"] == i * 2048 and r["doc_tokens"] == len(raw) and r["ids_crc32"] == zlib.crc32(raw[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in mine) == copies * len(raw)


def test_packing(spark, odd, none, library):
    rows = packing.packed(odd, queries.tokenizer_path()).collect()
    check_packing(rows, [(d, t) for d, t, *_ in odd_documents()], library)
    assert packing.packed(none, queries.tokenizer_path()).count() == 0
    table = queries.op7_packing(spark, DATA)
    check_packing(table.collect(), [(r["doc_id"], r["text"]) for r in queries.table(spark, DATA, "documents").collect()], library)
    one = table.agg(F.count_distinct("sequence_id").alias("n"), F.sum("length").alias("t")).first()
    assert one["t"] / (2048 * one["n"]) > 0.95


def test_plan_uses_each_item_once():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 5000):
        sizes, counts = np.unique(rng.integers(1, 129, n), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        used = dict.fromkeys(histogram, 0)
        bins = 0
        for pattern, times in packing.plan(histogram, 128):
            assert sum(k * v for k, v in pattern.items()) <= 128
            bins += times
            for k, v in pattern.items():
                used[k] += v * times
        assert used == histogram and bins <= -(-sum(k * v for k, v in histogram.items()) // 128) * 1.12 + 60


def test_chat_round_trip(spark):
    hard = "\\ [user]x[/user] </s><s> \\[ a\\\\] \n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (2, 5, None, None), (None, 1, "we[ird]\\role", ""), (3, None, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: chat.parse(r["formatted"]) for r in chat.format_paths(chat.linear_nodes(df)).collect()}
    assert got == {1: [("user", "hi"), ("assistant", hard), ("assistant", hard)], 2: [("", "")], None: [("we[ird]\\role", "")], 3: [("user", "x" * 100_000)]}
    assert chat.format_paths(chat.linear_nodes(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("<s>[user]a[/user]b</s>")


def test_reply_trees(spark):
    #  1 - 2 - 4 - 7    scores: the best branch of tree 1 is 1-3-6 (0 + 5 + 1), then 1-2-4-7 (0 + 1 + 1 + 3)
    #    \ 3 - 5
    #       \ 6          tree 10 has one message; 20 and 21 point at each other; 30's parent is not in the table
    rows = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 1.0), (5, 3, 0.0), (6, 3, 1.0), (7, 4, 3.0), (10, None, None), (20, 21, 1.0), (21, 20, 1.0), (30, 999, 2.0)]
    nodes = spark.createDataFrame([(*r, 0, "user", str(r[0])) for r in rows], "id long, parent long, score double, conv long, role string, text string")
    read = lambda top: sorted("-".join(t for _, t in chat.parse(r["formatted"])) for r in chat.format_paths(nodes, top).collect())
    assert read(1) == ["1-3-6", "10", "30"]
    assert read(2) == ["1-2-4-7", "1-3-6", "10", "30"] or read(2) == ["1-3-5", "1-3-6", "10", "30"]
    assert "]1[" in (one := next(r["formatted"] for r in chat.format_paths(nodes).collect() if r["leaf"] == 6)) and one.endswith("</s>")
    again = nodes.unionByName(nodes.where("id in (2, 7)").withColumn("text", F.lit("zz")))
    assert sorted("-".join(t for _, t in chat.parse(r["formatted"])) for r in chat.format_paths(again).collect()) == read(1)


def test_the_loss_mask_covers_the_assistants_texts(spark):
    hard = "\\ [assistant]x[/assistant] </s>\n"
    #  two branches below 2, each with an answer; the better one by score ends in 5
    rows = [(1, None, 0.0, "system", "[s]"), (2, 1, 0.0, "user", "a<b"), (3, 2, 1.0, "assistant", "worse"), (4, 2, 2.0, "assistant", hard), (5, 4, 0.0, "assistant", ""), (6, None, 0.0, "assistant", "😀[")]
    nodes = spark.createDataFrame([(*r[:3], 0, *r[3:]) for r in rows], "id long, parent long, score double, conv long, role string, text string")
    for top, want in ((1, {5: [hard, ""], 6: ["😀["]}), (2, {5: [hard, ""], 3: ["worse"], 6: ["😀["]})):
        got = {r["leaf"]: [chat.unescape(r["formatted"][m["start"] : m["end"]]) for m in r["loss_mask"]] for r in chat.format_paths(nodes, top).collect()}
        assert got == want


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in queries.op9_chat_format(spark, DATA).collect()}
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_sha256"] == brute.sha("</s>[INST] ok [/INST]") and got[-1]["loss_chars"] == 21


def test_pipeline_stages(spark):
    docs = queries.table(spark, DATA, "documents").limit(120).cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    extra = docs.unionByName(spark.createDataFrame([(9000, "123 !!", None, None, 6), (9001, None, None, None, None), (9002, "qzxjkvbw fjwqpxz zzkqjx vvwqkjzx xqjz kqzvxw jjqxk wvzqx " * 5, None, None, 300)], docs.schema))
    out = stage["language_id"](spark, extra, DATA)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d: t for d, (_, dropped, t) in brute.lines(texts).items() if not (dropped and not brute.WORD.search(t))}
    out = stage["line_dedup"](spark, docs, DATA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()} and out.columns == docs.columns
    comp = brute.jaccard(texts, 5, 80, 100)
    got = {r["doc_id"] for r in stage["jaccard_join"](spark, docs, DATA).collect()}
    assert got == {d for d, (_, c) in comp.items() if c == d}
    items = {r["item_id"]: r["text"] for r in queries.table(spark, DATA, "benchmark").collect()}
    few = {d: t for d, t in texts.items() if len(t) < 2500 or any(s in t for s in items.values())}
    got = {r["doc_id"] for r in stage["decontaminate"](spark, docs.where(F.col("doc_id").isin(list(few))), DATA).collect()}
    leaks = {d for d, t in few.items() if any(s in t for s in items.values())}
    assert got.isdisjoint(leaks) and len(got) >= len(few) - len(leaks) - 3
    assert language.UNKNOWN == "und"


def test_pipeline_from_end_to_end(spark, library):
    """``run`` on the whole smallest table against the stages' plain versions, packing included."""
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, DATA, "documents").collect()}
    texts = {d: t for d, t in texts.items() if any(unicodedata.category(c)[0] == "L" for c in t or "")}
    texts = {d: t for d, (_, dropped, t) in brute.lines(texts).items() if not (dropped and not brute.WORD.search(t))}
    texts = {d: texts[d] for d, (_, c) in brute.jaccard(texts, 5, 80, 100).items() if c == d}
    items = {r["item_id"]: r["text"] for r in queries.table(spark, DATA, "benchmark").collect()}
    leaks = {d for d, _ in brute.fast_overlaps(texts, items)}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert leaks and {r["doc_id"] for r in rows} == set(texts) - leaks
    check_packing(rows, [(d, t) for d, t in texts.items() if d not in leaks], library)


def test_stages_with_odd_rows_and_columns(spark, odd, none):
    """Nulls, repeats and other columns with names of the operators' own, on every stage but the last, and none at all."""
    extra = odd.select("*", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("a.b"), F.lit(2).alias("__n_dropped"), F.lit(3).alias("c`d"), F.lit(4).alias("maybe"), F.lit(5).alias("component"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, DATA)
        assert out.columns == extra.columns and 0 < out.count() <= extra.count(), name
        assert stage(spark, extra.where("false"), DATA).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, extra, DATA).count() > 0
