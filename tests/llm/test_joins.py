"""Operators across documents: Jaccard join, substring and line dedup."""

import random

import pytest

from tapeglass.llm import jaccard, line_dedup, substring_dedup
from tapeglass.llm.shared import components

from . import brute
from .conftest import odd_documents, prose


def family(seed, size, n, edits):
    """A text and copies of it with words changed, added and removed."""
    r = random.Random(seed)
    base = prose(n, seed)
    out = [base]
    for _ in range(size):
        w = [*r.choice(out[:3])]
        for _ in range(r.randint(0, edits)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = prose(r.randint(0, 2), r.random())
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_equals_brute_force(spark, k, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_SETS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    texts = [t for s, (size, n, e) in enumerate([(40, 120, 6), (25, 60, 3), (30, 15, 2), (10, 400, 30), (10, 3, 1), (5, 1, 1)]) for t in family(s, size, n, e)]
    random.Random(1).shuffle(texts)
    docs = dict(enumerate([*texts, None, "", "  "]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), words=k, num=num, den=den).collect()}
    want = brute.jaccard(docs, k, num, den)
    assert got == want and len({c for _, c in want.values()}) < len(docs) - 20


def test_linked_around_equals_all_pairs():
    r = random.Random(5)
    for num, den in ((90, 100), (80, 100)):
        for _ in range(30):
            hub = set(r.sample(range(1000), 60))
            sets = [hub]
            for _ in range(25):
                s = set(r.choice(sets))
                s -= set(r.sample(sorted(s), r.randint(0, 8)))
                s |= set(r.sample(range(1000), r.randint(0, 8)))
                sets.append(s)
            import numpy as np

            pack = lambda s: jaccard._packed(*[np.array(sorted(s), np.uint64)] * 2)
            rows = [(i, len(hub), den * len(hub - s) + num * len(s - hub), pack(hub - s), pack(s - hub)) for i, s in enumerate(sets) if i and s != hub]
            links = [(i, 0) for i, _, c, _, _ in rows if c <= (den - num) * len(hub)]
            links += jaccard.linked_around(rows[::2], [], num, den) + jaccard.linked_around(rows[1::2], [x for x in rows[::2] if x[2] > (den - num) * len(hub)], num, den)
            links += jaccard.linked_around(rows[::2], [x for x in rows[1::2] if x[2] > (den - num) * len(hub)], num, den)
            ids = [0, *(x[0] for x in rows)]
            pairs = [(a, b) for a in ids for b in ids if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
            assert brute.components(ids, links) == brute.components(ids, pairs)


def test_positions_exceed_differences():
    for num in (80, 90):
        sizes = jaccard.Sizes(num, 100)
        for n in range(1, 400):
            for m in range(n, n * 100 // num + 1):
                most = max(d for d in range(n + m + 1) if (n + m - d) % 2 == 0 and 100 * ((n + m - d) // 2) >= num * ((n + m + d) // 2))
                groups = [{int(g[0]) for g in sizes.groups(jaccard.np.array([x]))} for x in (n, m)]
                common = jaccard.np.array(sorted(groups[0] & groups[1]))
                assert len(common) and (most == 0 or (sizes.positions(common) >= most + 1 + sizes.spare(common)).any())


def test_sets_that_agree_in_empty_blocks_share_a_list():
    r = random.Random(8)
    sizes = jaccard.Sizes(80, 100)
    for n in (4, 5, 6, 9, 20, 60, 400):
        for _ in range(200):
            a = r.sample(range(1 << 60), n)
            b = a[: n - r.randint(0, n // 9)]
            b += r.sample(range(1 << 60), r.randint(0, n // 9))
            if 100 * len(set(a) & set(b)) < 80 * len(set(a) | set(b)):
                continue
            both = jaccard.np.array(sorted(a) + sorted(b), jaccard.np.uint64)
            text, key = jaccard.blocks_of(both, jaccard.np.array([0, len(a), len(both)]), sizes)
            assert set(a) == set(b) or set(key[text == 0].tolist()) & set(key[text == 1].tolist())


def test_blocks_of_lists_are_skipped():
    """Of lists by position, blocks that leave too few shingles are skipped, and no pair that is linked is lost."""
    r = random.Random(6)
    tokens = [bytes([i // 256, i % 256]) * 8 for i in range(3000)]
    read = skipped = 0
    for num, den in ((90, 100), (80, 100)):
        lists = jaccard.Lists((den - num) * 200, num, den)
        rows = []
        for i in range(120):
            gone, added = r.randint(0, 30), r.randint(0, 60)
            t = sorted(r.sample(tokens[:150], added)) + sorted(r.sample(tokens[2000:2080], gone))
            rows.append((t, den * gone + num * added))
            lists.add(i, *rows[-1])
        for t, cost in rows:
            got = set(lists.candidates(t, cost))
            linked = {j for j, (u, c) in enumerate(rows) if lists.slack + (den + num) * len(set(t) & set(u)) >= cost + c}
            shared = {j for j, (u, c) in enumerate(rows) if set(lists.prefix(t, cost)) & set(lists.prefix(u, c))}
            assert {j for j in linked if set(t) & set(rows[j][0])} <= got <= shared
        read, skipped = read + lists.read, skipped + lists.skipped
    assert skipped > 100 and read > 100


def test_bitmaps_tell_no_linked_sets_apart():
    r = random.Random(12)
    np = jaccard.np
    told = 0
    for num, den in ((90, 100), (80, 100)):
        sets = []
        for n in (1, 3, 20, 63, 64, 65, 300, 700):
            base = r.sample(range(1 << 62), n)
            for _ in range(12):
                gone = r.randint(0, n // 4)
                sets.append(sorted(base[gone:] + r.sample(range(1 << 62), r.randint(0, n // 4))))
        cuts = np.cumsum([0, *map(len, sets)])
        marks = jaccard.sketches(np.array([x for s in sets for x in s], np.uint64), cuts).to_pylist()
        sizes = np.array([len(s) for s in sets])
        for i, a in enumerate(sets):
            ok = jaccard.may_link(len(a), marks[i], sizes, marks, num, den)
            linked = np.array([den * len({*a} & {*b}) >= num * len({*a} | {*b}) for b in sets])
            assert (ok | ~linked).all()
            told += int((~ok).sum())
    assert told > 10_000


def test_jaccard_by_shuffles_only(spark, monkeypatch):
    """Nothing is broadcast and no filter helps: the same rows."""
    from tapeglass.llm import shared

    docs = dict(enumerate(t for s, (size, n, e) in enumerate([(20, 90, 9), (15, 40, 6)]) for t in family(s, size, n, e)))
    rows = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(shared, "FILTER_LEAST", 13)
    monkeypatch.setattr(shared, "FILTER_MOST", 13)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(rows, words=5, num=80, den=100).collect()}
    assert got == brute.jaccard(docs, 5, 80, 100)


def test_texts_under_one_id_are_linked_each(spark):
    a, b = (" ".join(prose(60, s)) for s in (1, 2))
    rows = [(2, a), (2, b), (1, a), (3, b), (3, b)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 2)]


def test_jaccard_cases(spark, odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(odd).collect()}
    docs = {d: t for d, t, *_ in odd_documents() if d is not None}
    want = brute.jaccard(docs, 3, 90, 100)
    assert {d: v for d, v in got.items() if d is not None} == want and got[None] == (6, None)
    assert jaccard.join(odd).count() == odd.count() and jaccard.join(none).count() == 0


def test_components(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 260)]
    nodes = sorted({x for e in chain for x in e if e[0] != e[1]})
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {n: c for n, c in brute.components(nodes, [e for e in chain if e[0] != e[1]]).items()}


def test_substrings_equal_brute_force(spark):
    r = random.Random(2)
    passages = [prose(n, 900 + n) for n in (20, 23, 31, 60)]
    docs = {}
    for d in range(60):
        w = prose(r.randint(0, 60), d)
        for _ in range(r.randint(0, 3)):
            p = [*r.choice(passages)]
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "swap"
            w += p + prose(r.randint(0, 5), r.random())
        docs[d] = " ".join(w)
    docs |= {100: "same " * 90, 101: "same " * 25, 102: "ab cd " * 40, 103: None}
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in substring_dedup.dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute.substrings(docs)


def test_substring_cases(spark, odd, none):
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup.dedup(odd).collect()}
    want = brute.substrings({d: t for d, t, *_ in odd_documents() if d is not None})
    assert {d: v for d, v in got.items() if d is not None} == {d: v[:2] for d, v in want.items()}
    assert substring_dedup.dedup(none).count() == 0


def test_substrings_of_texts_under_one_id(spark):
    a, b, c, d = (prose(40, 70 + i) for i in range(4))
    rows = [(1, a), (2, c + a), (2, b + d), (3, d + b[:25]), (3, d + b[:25])]
    out = substring_dedup.dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"]) for x in out) == [(1, 40, 0), (2, 80, 0), (2, 80, 40), (3, 65, 65), (3, 65, 65)]


def test_chains_are_compacted_and_verified(spark, monkeypatch):
    """Edges of a nonbranching chain share its first window; a branch, a gap or another source starts a new chain."""
    from tapeglass.llm.shared import Scratch

    #  source 1: windows 0..9 in a row; the node between 4 and 5 has a second edge out; source 2: 0..699; 800 alone
    rows = [(1, k, 1, 100 + k, 101 + k) for k in range(10)] + [(3, 7, 1, 105, 9000)]
    rows += [(2, 3 * k, 3, 10_000 + k, 10_001 + k) for k in range(700)] + [(2, 2500, 1, 5, 6)]
    edges = spark.createDataFrame(rows, "doc long, start int, w int, l long, r long")
    for stretch in (4, 256):
        monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
        with Scratch(spark) as tmp:
            got = {(x["doc"], x["start"]): x["head"] for x in substring_dedup.compacted(edges, tmp).collect()}
        assert got == {(d, s): {1: 0 if s < 5 else 5, 3: 7, 2: 0 if s < 2100 else 2500}[d] for d, s, *_ in rows}


def test_spans_are_removed_only_if_their_words_are_those_at_the_source():
    import pyarrow as pa

    spans = pa.list_(pa.struct([("a", pa.int32()), ("w", pa.int32()), ("words", pa.string())]))
    rows = [("x  a bb\tc d e f", [{"a": 1, "w": 1, "words": "a bb"}, {"a": 3, "w": 2, "words": "c d X"}]), ("", None), ("q r s", None), ("ä b c", [{"a": 0, "w": 1, "words": "ä b"}, {"a": 1, "w": 1, "words": "b c"}]), (None, None), ("one two", [])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["cut off", *(t for t, _ in rows)]), pa.array([None, *(s for _, s in rows)], spans)], names=["id", "text", "spans"])
    out = pa.Table.from_batches(substring_dedup._kept(2)([batch, batch.slice(1)])).to_pylist()
    assert out[7:] == out[1:7] and out[0]["kept"] == "cut off"
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in out[1:7]] == [(7, 2, "x c d e f"), (0, 0, ""), (3, 0, "q r s"), (3, 3, ""), (0, 0, ""), (2, 0, "one two")]


def test_substrings_by_shuffles_only(spark, monkeypatch):
    from tapeglass.llm import shared

    passage = prose(60, 5)
    docs = {d: " ".join(prose(30, d) + passage[d % 7 : 60 - d % 5] + prose(9, 200 + d)) for d in range(25)}
    for name, value in (("BROADCAST_BYTES", 0), ("FILTER_LEAST", 13), ("FILTER_MOST", 13)):
        monkeypatch.setattr(shared, name, value)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in substring_dedup.dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute.substrings(docs)


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    pool = [prose(n, 50 + n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 12, 20, 40)]
    docs = {}
    for d in range(50):
        out = []
        for _ in range(r.randint(1, 8)):
            w = [*r.choice(pool)]
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = prose(r.randint(0, 1), r.random())
            out.append(r.choice([" ", "\t", "  "]).join(w))
        docs[d] = "\n".join(out)
    got = {x["doc_id"]: (x["__n_lines"], x["__n_dropped"], x["text"]) for x in line_dedup.dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute.lines(docs)


def test_lines_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three four\none two three four", 5, "a", True, 7)], ["doc_id", "text", "__n_lines", "a.b", "c`d", "__doc"])
    out = line_dedup.dedup(df)
    assert out.columns == [*df.columns, "__n_lines_", "__n_dropped_"]
    assert tuple(out.first()) == (1, "one two three four", 5, "a", True, 7, 2, 1)
    odd = df.withColumnsRenamed({"text": "te`x.t", "doc_id": "i.d"})
    assert line_dedup.dedup(odd, text="te`x.t", doc_id="i.d").first()["te`x.t"] == "one two three four"


def test_line_cases(spark, odd, none):
    out = line_dedup.dedup(odd)
    assert out.columns == [*odd.columns, "__n_lines", "__n_dropped"] and out.count() == odd.count()
    got = {x["doc_id"]: x["text"] for x in out.collect()}
    assert got[5] is None and got[6] == "" and got[2] == "" and got[14].count("line two") == 1 and got[18].startswith("first line of eight words is this\n")
    assert line_dedup.dedup(none).count() == 0
