"""Operators that look at one text at a time: language, secrets, quality, hosts, decontamination."""

import base64
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapeglass.llm import decontaminate, host_rules, language, queries, rule_ensemble, secrets
from tapeglass.llm.kernel import chunks
from tests.conftest import DATA

from .brute import WORD, fast_overlaps, overlaps, sha
from .conftest import odd_documents, prose


def plain_phrases(sample, text):
    """Greedy longest matches, counted as ended phrases."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at : at + 1] in sample:
            size += 1
        at += size
        n += at < len(text)
    return n


def symbols(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return "".join(map(chr, language.normalised(raw, np.array([0, len(raw)]))[0]))


def test_cross_parsing_is_the_greedy_parse():
    train = {"a": [" ".join(prose(300, 1))], "b": ["zig zag zug zog " * 40]}
    model = language.build(train).model()
    for seed in range(5):
        text = " ".join(prose(60, seed + 10)) + " zig zagzog"
        raw = np.frombuffer(text.encode(), np.uint8)
        _, plain, _ = language.entropies(model, raw, np.array([0, len(raw)]))
        for i, lang in enumerate(model.languages):
            want = plain_phrases(symbols(train[lang][0]), symbols(text)[:1024])
            assert round(plain[0, i] * len(symbols(text)) / model.bits[i]) == want


def test_the_winner_of_long_texts_by_a_plain_parse():
    """Blocks start again, and each counts the phrase that its end cuts: bits, winner and score are those of the plain sums."""
    train = {"a": [" ".join(prose(400, 1))], "b": ["zig zag zug zog " * 40], "c": [" ".join(prose(150, 3)) + " ÄÖ ßü"]}
    model = language.build(train).model()
    texts = [" ".join(prose(n, n)) + tail for n, tail in ((3, ""), (400, " zig"), (900, " zug" * 300))] + ["", "12 ?", "Zig ZAG"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    langs, score, _ = language.decide(model, np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for t, got, s in zip(texts, langs, score.tolist(), strict=True):
        own = symbols(t)
        if not own.strip():
            assert (got, s) == ("und", 0.0)
            continue
        pieces = [own[i : i + 1024] for i in range(0, len(own), 1024)]
        bits = {k: sum(plain_phrases(symbols(v[0]), p) + 1 for p in pieces) * np.log2(len(symbols(v[0])) + 2) / len(own) for k, v in train.items()}
        assert got == min(bits, key=bits.get)
        assert abs(s - 1 / sum(2 ** (-4 * (b - min(bits.values()))) for b in bits.values())) < 1e-9


def test_samples_are_whole_texts(spark):
    texts = ["aa bb cc " * 5, "dd ee " * 4, "ff gg hh " * 40, "ii " * 30]
    rows = [(i, "xx", t) for i, t in enumerate(texts)] + [(9, "yy", "jj kk " * 900), (10, "yy", "ll mm " * 800)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = dict(language.train(df, train_symbols=200).coded)
    size = lambda t: len(symbols(t)) * 4
    assert len(got["yy"]) == size("ll mm " * 800)  # only long texts: the shortest, whole
    whole = {sum(c) for n in range(1, 5) for c in itertools.combinations([size(t) for t in texts], n)}
    assert len(got["xx"]) in whole and len(got["xx"]) <= 4 * 200


def test_a_row_without_an_id_is_not_held_out(spark):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(doc_id=None), Row(doc_id=5)], "doc_id long")
    assert [r["h"] for r in df.select(queries.held_out(5, 0).alias("h")).collect()] in ([False, True], [False, False])


def test_language_accuracy(spark):
    got = queries.op1_language_id(spark, DATA).join(queries.table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("s"), F.max("score").alias("t")).first()
    assert r["a"] >= 0.97 and 0 <= r["s"] <= r["t"] <= 1


def test_language_cases(spark, odd, none):
    model = language.train(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, model).collect()}
    assert got[5] == got[6] == got[7] == got[16] == "und" and got[1] == "en"
    assert language.predict(none, model).count() == 0
    empty = language.train(none)
    assert {r["lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and {5, 6, 7, 16}.isdisjoint({r["doc_id"] for r in kept.collect()})


def plain_spans(text):
    out = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 20]
    import re

    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.ORDER[s[0]]))


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_base_spans_are_the_patterns():
    texts = ["secret=token:abcdefgh", "PASSWORD = 'abc123'", "api_key:\"abcdefg\" apikey=short", "token = " + "0af" * 10, "AKIA" + "A1" * 8 + " AKIAshort", "é😀 passwd=éabcdef Passwd : abcdef", "x" + "ab12" * 6 + "g" + "0" * 23, "ſecret=abcdefgh toKen=abcdefgh"]
    for t in texts:
        assert [s for s in secrets.spans(t) if s[0] in secrets.KINDS[:3]] == plain_spans(t)


def test_structural_confirmation():
    rng = np.random.default_rng(3)
    num = lambda k: der(2, b"\x01" + rng.bytes(k))
    rsa = der(0x30, der(2, b"\0") + b"".join(num(64) for _ in range(8)))
    ec = der(0x30, der(2, b"\1") + der(4, rng.bytes(32)))
    ssh = secrets.SSH_MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b""))
    b64 = lambda b: base64.b64encode(b).decode()
    wrap = lambda s: "\n".join(s[i : i + 64] for i in range(0, len(s), 64))
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub":1}', rng.bytes(32)))
    kinds = lambda t: [s[0] for s in secrets.spans(t) if s[0] not in secrets.KINDS[:3]]
    assert kinds("a " + b64(rsa) + " b") == ["der_key"]
    assert kinds("-----BEGIN KEY-----\n" + wrap(b64(rsa)) + "\n-----END KEY-----") == ["der_key"]
    assert kinds("words\n" + wrap(b64(rsa)) + "\nThe next line") == ["der_key"]
    assert kinds(rsa.hex()) == ["der_key"] and kinds(b64(ec)) == ["der_key"]
    assert kinds(b64(ssh + rng.bytes(20))) == ["ssh_key"]
    assert kinds("Bearer " + token + " end") == ["signed_token"]
    broken = bytearray(rsa)
    broken[3] ^= 1
    assert kinds(b64(bytes(broken))) == [] and kinds(b64(rng.bytes(200))) == [] and kinds("eyJub25l.abc.def") == []


def test_keys_in_odd_places():
    rng = np.random.default_rng(4)
    num = lambda k: der(2, b"\x01" + rng.bytes(k))
    rsa = der(0x30, der(2, b"\0") + b"".join(num(64) for _ in range(8)))
    many = der(0x30, der(2, b"\0") + b"".join(num(3) for _ in range(200)))
    b64 = base64.b64encode(rsa).decode()
    own = lambda t: [(k, t[a:b]) for k, a, b in secrets.spans(t) if k not in secrets.KINDS[:3]]
    lines = [b64[i : i + 64] for i in range(0, len(b64), 64)]
    for sep in ("\n    ", "\r\n\t", "\\n", " \n", "\\r\\n"):
        key = sep.join(lines)
        assert own("key: |\n    " + key + "\nend") == [("der_key", key)]
    hexed = rsa.hex()
    mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(hexed))
    assert own(mixed) == [("der_key", mixed)] and own("f" + hexed) == [("der_key", hexed)] and own("F0" + hexed.upper()) == [("der_key", hexed.upper())]
    for junk in ("x", "xy", "xyz", "QUJD"):
        assert own(junk + b64.rstrip("=")) == [("der_key", b64.rstrip("="))]
    assert own(base64.b64encode(many).decode()) == [("der_key", base64.b64encode(many).decode())]
    for n in range(1, 6):
        block = "\n".join(["Wood" * 10] * n + lines + ["word" * 9] * n)
        assert [k for k, _ in own(block)] == ["der_key"]
    assert own("30" * 400) == [] and own("MIIB" * 300) == [] and own("A" * 5000) == []


def test_secret_query(spark, odd, none):
    got = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, DATA).collect()}
    for r in queries.table(spark, DATA, "documents").collect():
        want = plain_spans(r["text"])
        g = got[r["doc_id"]]
        assert g["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(k == x for k, _, _ in want) for x in secrets.KINDS[:3])
    assert secrets.digest(secrets.scan(odd)).count() == odd.count() and secrets.scan(none).count() == 0


def test_quality(spark, odd, none):
    got = queries.op4_quality_rules(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").toPandas()
    rank = got["score"].rank()
    pos = got["quality"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97 and ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = rule_ensemble.train(odd, labels)
    assert rule_ensemble.scored(odd, model).where("score between 0 and 1").count() == odd.count()
    assert rule_ensemble.scored(odd, rule_ensemble.train(none, labels.where("false"))).count() == odd.count()
    assert rule_ensemble.scored(none, model).count() == 0


def plain_statistics(text):
    """The statistics of a text, one by one, by their definitions on bytes and words."""
    from collections import Counter
    from math import log1p, log2

    w, raw = WORD.findall(text or ""), (text or "").encode()
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    n, size, nl = max(len(w), 1), max(sum(map(len, w)), 1), max(len(lines), 1)
    inside = lambda chars: sum(b in chars.encode() for b in raw)
    spots = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + j for i in range(len(w) - 7) if spots[tuple(w[i : i + 8])] > 1 for j in range(8)}
    counts = Counter(w)
    symbols, upper = "#*$%&|<>", "".join(map(chr, range(65, 91)))
    return {
        "log_words": log1p(len(w)), "mean_word": sum(map(len, w)) / n, "long_words": sum(len(x.encode()) > 15 for x in w) / n, "short_words": sum(len(x.encode()) <= 3 for x in w) / n,
        "symbol_share": inside(symbols) / size, "upper_share": inside(upper) / size, "digit_share": inside("0123456789") / size,
        "letter_share": sum(b >= 128 or chr(b).isalpha() for b in raw) / max(len(raw), 1), "stop_share": inside(".!?") / n, "bang_share": inside("!") / n, "comma_share": inside(",;:") / n,
        "pipe_share": inside("|") / n, "symbol_ends": sum(x[-1] in symbols for x in w) / n, "upper_starts": sum(x[0] in upper for x in w) / n, "distinct_share": len(counts) / n,
        "word_entropy": log2(n) - sum(k * log2(k) for k in counts.values()) / n, "repeat_share": len(again) / n, "dup_line_share": (len(lines) - len(set(lines))) / nl, "words_a_line": len(w) / nl,
    }


def test_statistics_are_those_of_a_plain_count(spark):
    texts = [t for _, t, *_ in odd_documents()] + [r["text"] for r in queries.table(spark, DATA, "documents").collect()]
    got = rule_ensemble.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        assert set(want) == set(rule_ensemble.FEATURES) and all(abs(got.loc[i, k] - v) < 1e-9 for k, v in want.items()), i


def test_a_split_is_the_best_one():
    """One level of a tree cuts where the squared error falls most, by trying every cut."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = (x[:, 1] > 0.3) * 1.0 + 0.1 * rng.normal(size=200)
    binned, edges = rule_ensemble._bins(x)
    rules, value = rule_ensemble._grow(binned, edges, y, np.ones(200), np.arange(3), 1)

    def error(j, at):
        parts = [y[x[:, j] <= at], y[x[:, j] > at]]
        return sum(((p - p.mean()) ** 2).sum() for p in parts) if min(map(len, parts)) >= rule_ensemble.MIN_LEAF else np.inf

    best = min((error(j, at), j) for j in range(3) for at in edges[j])
    (j, _, at) = rules[0][0]
    assert abs(error(j, at) - best[0]) < 1e-9 and abs(((y - value) ** 2).sum() - best[0]) < 1e-9


def test_lasso_meets_its_conditions():
    """At the optimum the gradient is within the penalty, and at it where a weight is not zero."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(500, 6))
    y = (z[:, 0] - z[:, 1] + 0.5 * rng.normal(size=500) > 0).astype(float)
    w = np.full(500, 0.7)
    b0, beta = rule_ensemble._lasso(z, y, w, 0.05, 4000)
    r = w * (1 / (1 + np.exp(-(z @ beta + b0))) - y) / w.sum()
    slope = z.T @ r
    used = np.abs(beta) > 1e-6
    assert used[0] and used[1] and not used.all() and (np.abs(slope) <= 0.05 + 1e-4).all() and np.allclose(slope[used], -0.05 * np.sign(beta[used]), atol=1e-4) and abs(r.sum()) < 1e-4


def test_labels_that_disagree(spark, odd):
    labels = spark.createDataFrame([(d, q) for d in range(1, 19) for q in (0, d % 2)], "doc_id long, quality int")
    one = rule_ensemble.train(odd, labels)
    assert one.rules == [] and one.intercept < 0  # of two labels the least: one class only


def test_compiled_rules_equal_the_ensemble(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0.2)).astype(float)
    model = rule_ensemble.fit(x, y)
    z = model.intercept + sum(w * rule_ensemble._holds(r, x) for r, w in model.rules)
    names = tuple("abcd")
    got = spark.createDataFrame([tuple(map(float, r)) for r in x], list(names)).select(model.score(names).alias("s")).toPandas()["s"]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-z)))) and (((z > 0) == (y == 1)).mean()) > 0.97


def test_hosts(spark, odd, none):
    got = {r["doc_id"]: r for r in host_rules.judge(odd).collect()}
    for d, t, _, host in odd_documents():
        w = WORD.findall(t or "")
        assert got[d]["n_words"] == len(w) and got[d]["base_failed"] == (len(w) < 20 or 100 * got[d]["n_repeat_words"] > 30 * len(w))
        if host is None:
            assert not got[d]["host_failed"]
    assert host_rules.judge(none).count() == 0
    rows = [(i, " ".join(prose(30, i)) if i % 50 else "x", "good") for i in range(200)] + [(1000 + i, "bad" if i % 10 else " ".join(prose(30, i)), "bad") for i in range(100)]
    out = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.where("host = 'good' and host_failed").count() == 0 and out.where("host = 'bad' and kept").count() == 0


def test_masks_hit_every_tolerated_window():
    n, placements = decontaminate.WINDOW, [{o + p for o in m} for m in decontaminate.MASKS for p in range(decontaminate.WINDOW - m[-1])]
    for subs in itertools.combinations(range(n), decontaminate.SUBSTITUTIONS):
        assert any(not s & set(subs) for s in placements)


def test_decontamination(spark, odd, none):
    item = prose(30, 77)
    swap = lambda w, at: [("zzz" if i in at else x) for i, x in enumerate(w)]
    texts = {
        1: " ".join(prose(50, 4) + item + prose(20, 5)), 2: " ".join(prose(9, 6) + swap(item, {3, 8, 13, 18, 23, 28})), 3: " ".join(prose(80, 7) + swap(item, set(range(0, 30, 4)))),
        4: " ".join(prose(60, 8)), 5: None, 6: "", 7: " ".join(item[:13]).upper() + "!", 8: " ".join(item[:12]), 9: "some Short, item!", 10: "some other item",
    }
    items = {100: " ".join(item), 101: "some short item", 102: "", 103: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontaminate.find(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == overlaps(texts, items) and {(1, 100), (2, 100), (7, 100), (9, 101)} <= {(r["doc_id"], r["item_id"]) for r in got}
    assert decontaminate.find(docs, bench.where("false")).count() == 0 and decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(odd, bench).count() == 0


def test_masks_of_short_items_hit_every_tolerated_one():
    for n in range(decontaminate.LEAST, decontaminate.WINDOW):
        for sub in range(n):
            assert decontaminate.tolerated(n) == 0 or any(sub not in m for m in decontaminate.masks_of(n))


def test_decontamination_of_short_odd_and_repeated_texts(spark, monkeypatch):
    short = [prose(n, 300 + n) for n in range(1, 13)]
    swap = lambda w, *at: [("zzz" if i in at else x) for i, x in enumerate(w)]
    items = {n + 1: " ".join(w) for n, w in enumerate(short)} | {50: "same " * 60, 51: "ab cd " * 40, 52: "Ünïcode “quoted words” — and a dash, ٣٤ Ελλάδα ΣΟΦΟΣ then more words here to reach thirteen"}
    texts = {100 + n: " ".join(prose(9, n) + w + prose(7, 50 + n)) for n, w in enumerate(short)}
    texts |= {200 + n: " ".join(prose(9, n) + swap(w, n // 2) + prose(7, 50 + n)) for n, w in enumerate(short)}
    texts |= {300 + n: " ".join(prose(9, n) + swap(w, 0, n) + prose(7, 50 + n)) for n, w in enumerate(short)}
    texts |= {400: "same " * 2000, 401: "ab cd " * 700, 402: "x " * 30 + "same " * 12 + "y", 403: "same " * 11 + "else same", 404: "ünïcode quoted WORDS and a dash ٣٤ ελλάδα σοφοσ then more words here to reach thirteen", 405: "cd ab " * 6 + "cd"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = overlaps(texts, items)
    assert {(400, 50), (401, 51), (404, 52), (403, 50), (207, 8), (107, 8), (105, 6)} <= want and (205, 6) not in want and (307, 8) not in want
    for size in (decontaminate.BLOCK_ITEMS, 4):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        got = decontaminate.find(docs, bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {r["first_word"] for r in got if r["doc_id"] in (400, 401)} == {0}
    nameless = spark.createDataFrame([(None, items[9]), (-1, items[9])], "item_id long, text string")
    assert sorted(str(r["item_id"]) for r in decontaminate.find(docs.where("doc_id = 108"), nameless).collect()) == ["-1", "None"]


def test_repeated_words_cost_little():
    import time

    b = decontaminate.block([1, 2], ["same " * 3000, "ab cd " * 1500])
    for text in ("same " * 20_000, "ab cd " * 10_000, "ab cd ef " * 6000):
        start = time.perf_counter()
        decontaminate.overlaps(b, *decontaminate.words(next(chunks(pa.array([text])))))
        assert time.perf_counter() - start < 5


def test_decontamination_of_a_whole_table(spark):
    """Both directions, every document and every item."""
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, DATA, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in queries.table(spark, DATA, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, DATA).collect()}
    assert got == fast_overlaps(docs, items)


def test_decontamination_on_tables(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, DATA, "documents").limit(60).collect()}
    items = {r["item_id"]: r["text"] for r in queries.table(spark, DATA, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, DATA).collect()}
    full = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    assert full <= got
