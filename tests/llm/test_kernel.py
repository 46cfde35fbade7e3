import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeglass.llm.kernel import chunks, window_hashes, windows_inside
from tapeglass.llm.textstats import basic

from .brute import WORD

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x0c\U0001f600#", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([1, 8, 1000]))
def test_words_and_hashes(texts, most):
    found = []
    for c in chunks(pa.array(texts, pa.string()), most):
        a, b, cuts = c.words()
        raw = c.buf.tobytes()
        h = c.hashes()
        found += [[(raw[x:y].decode(), int(v)) for x, y, v in zip(a[i:j], b[i:j], h[i:j], strict=True)] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    assert [[w for w, _ in t] for t in found] == [WORD.findall(t or "") for t in texts]
    seen = {}
    for t in found:
        for w, v in t:
            assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_statistics(texts):
    for c in chunks(pa.array(texts, pa.string())):
        got = basic(c)
        for i, t in enumerate(texts):
            t = t or ""
            w = WORD.findall(t)
            rows = [x for x in t.split("\n") if WORD.search(x)]
            runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            covered = {k + j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(8)}
            want = (len(w), sum(map(len, w)), t.count("#"), len(rows) - len(set(rows)), len(covered))
            assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_windows():
    v = np.arange(10, dtype=np.uint64) % 3
    h = window_hashes(v, 3)
    assert len(set(h.tolist())) == 3 and h[0] == h[3]
    assert windows_inside(np.array([0, 4, 4, 10]), 3).tolist() == [True, True, False, False, True, True, True, True]
