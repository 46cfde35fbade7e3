"""Cases in which an operator once did less than its whole job."""

import base64

import numpy as np

import corpus_pipeline
from tapeglass.llm import jaccard, language, queries, secrets
from tests.conftest import DATA

from . import brute
from .conftest import prose
from .test_scans import der, plain_phrases, symbols


def test_rows_without_an_id_join_their_group(spark):
    a, b, c = (prose(60, s) for s in (1, 2, 3))
    near = [*a]
    near[30] = "changed"
    texts = [(7, a), (None, a), (3, near), (None, near), (5, b), (None, c), (None, c), (None, prose(60, 4))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = jaccard.join(docs, words=5, num=80, den=100).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0)] * 3 + [(0, 3)] * 2 + [(3, 3), (5, 5), (7, 3)]


def test_stages_remove_rows_without_an_id(spark):
    item = next(r["text"] for r in queries.table(spark, DATA, "benchmark").collect() if r["text"] and len(brute.WORD.findall(r["text"])) > 15)
    a, b, c = (" ".join(prose(60, s)) for s in (1, 2, 3))
    rows = [(9, a), (4, a), (None, a), (None, b), (None, b), (6, c), (6, c), (6, c + " " + item), (None, item), (None, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)
    order = lambda out: sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect())))
    want = lambda rows: sorted(map(str, rows))
    sets = brute.jaccard({1: c, 2: c + " " + item}, 5, 80, 100)
    far = [(6, c + " " + item)] if sets[2][1] == 2 else []
    got = stage["jaccard_join"](spark, docs, DATA)
    assert got.columns == docs.columns and order(got) == want([(4, a), (None, b), (6, c), *far, (None, item), (None, None), (None, None), (None, "")])
    got = stage["decontaminate"](spark, docs, DATA)
    assert got.columns == docs.columns and order(got) == want([r for r in rows if not (r[1] or "").endswith(item)])


def test_every_key_of_a_base64_block():
    rng = np.random.default_rng(8)
    b64 = lambda b: base64.b64encode(b).decode().rstrip("=")
    counted = lambda *x: b"".join(len(b).to_bytes(4, "big") + b for b in x)
    spki = lambda n: der(0x30, der(0x30, der(6, rng.bytes(9)) + b"\5\0") + der(3, b"\0" + rng.bytes(n)))
    pkcs8 = lambda: der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, rng.bytes(32))))
    ssh = lambda: counted(b"ssh-ed25519", rng.bytes(32))
    private = secrets.SSH_MAGIC + counted(b"none", b"none", b"") + b"\0\0\0\1" + counted(rng.bytes(51), rng.bytes(136))
    assert len(b64(pkcs8())) == 64
    wrap = lambda s: "\n".join(s[i : i + 64] for i in range(0, len(s), 64))
    for make, kind in ((lambda: spki(270), "der_key"), (pkcs8, "der_key"), (lambda: der(0x30, der(2, b"\1") + der(4, rng.bytes(32))), "der_key"), (ssh, "ssh_key"), (lambda: private, "ssh_key")):
        for n in (1, 2, 5, 6, 40):
            for shape in (str, wrap):
                for before, after in (([], []), (["A" * 40], ["one", "word", "a", "line"]), (["Mr"] * 9, ["MA"] * 9)):
                    keys = [shape(b64(make())) for _ in range(n)]
                    text = "words!\n" + "\n".join([*before, *keys, *after]) + "\nend."
                    assert [(k, text[a:b]) for k, a, b in secrets.spans(text)] == [(kind, k) for k in keys]
                    text = text.replace("\n", "\r\n")
                    assert [k for k, _, _ in secrets.spans(text)] == [kind] * n


def test_token_headers_with_white_space():
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{\n "alg": "HS256"}', b'[1, 2, 3]', b"\1" * 32))
    assert "ey" not in token and [s[0] for s in secrets.spans(token)] == ["signed_token"]
    at = len("download.")
    assert secrets.spans("download." + token + ".") == [("signed_token", at, at + len(token))]


def scripts(first, n, seed):
    """A text of words over so many letters from a code point on."""
    r = np.random.default_rng(seed)
    vocabulary = ["".join(map(chr, first + np.random.default_rng(first + i).integers(0, n, 3))) for i in range(80)]
    return " ".join(r.choice(vocabulary, 200))


def test_languages_of_many_letters_and_labels(spark):
    starts = {"zh": 0x4E00, "ko": 0xAC00, "xa": 0x20000, "xb": 0x20800, "ru": 0x430, "el": 0x3B1, "en": 0x61}
    samples = {k: [scripts(c, 700 if c > 0x3000 else 17, s) for s in range(3)] for k, c in starts.items()}
    model = language.build(samples).model()
    raw = [np.frombuffer(scripts(c, 700 if c > 0x3000 else 17, 99).encode(), np.uint8) for c in starts.values()]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    langs, _, surprise = language.decide(model, np.concatenate(raw), cuts)
    assert langs == list(starts) and (surprise < language.MAX_SURPRISE).all()
    _, plain, _ = language.entropies(model, np.concatenate(raw), cuts)
    for t, c in enumerate(starts.values()):
        text = symbols(scripts(c, 700 if c > 0x3000 else 17, 99))
        for i, k in enumerate(model.languages):
            want = plain_phrases("".join(symbols(x) for x in samples[k])[:24_000], text)
            assert round(plain[t, i] * len(text) / model.bits[i]) == want
    rows = [(i, f"l{i:03}", " ".join(prose(40, i)) + chr(0x4E00 + i) * 9) for i in range(70)]
    got = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert [k for k, _ in got.coded] == [k for _, k, _ in rows] and len(got.model().languages) == 70


def test_only_evidence_rejects_a_text(spark):
    model = language.build({"en": [" ".join(prose(2000, 1))], "xx": ["zig zag zug zog " * 400]})
    key = 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" '
    r = np.random.default_rng(5)
    noise = "".join(r.choice([*"abcdefghijklmnopqrstuvwxyz    "], 300))
    texts = [key + "the green house", "Kowalczyk", "Zbigniew Brzeziński", "B.\nquay", noise, "123", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {x["doc_id"] for x in language.accepted(docs, model).collect()} == {0, 1, 2, 3}
    assert {x["doc_id"] for x in language.accepted(docs, language.build({})).collect()} == {0, 1, 2, 3, 4}
