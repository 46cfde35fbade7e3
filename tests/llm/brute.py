"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import unicodedata
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard(docs, k, num, den):
    """{id: (shingles, component)}; docs: {id: text}."""
    sets = {}
    for d, t in docs.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {d: (len(sets[d]), comp[d]) for d in ids}


def substrings(docs, k=20):
    seen, out = {}, {}
    for d in sorted(docs):
        w = WORD.findall(docs[d] or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen.setdefault(tuple(w[i : i + k]), (d, i)) != (d, i):
                gone[i : i + k] = [True] * k
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def line_words(line):
    return tuple(x for x in re.split(r"[ \t\x0b\f\r]+", line) if x)


def apart(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def lines(docs, least=4, near=8):
    """{id: (lines, dropped, kept text)}."""
    rows = sorted((d, i, line_words(s)) for d, t in docs.items() for i, s in enumerate(t.split("\n")))
    first = {}
    for d, i, w in rows:
        if len(w) >= least:
            first.setdefault(w, (d, i))
    distinct = sorted(first.items(), key=lambda x: x[1])
    near_drop = {w for i, (w, _) in enumerate(distinct) if len(w) >= near and any(len(v) >= near and abs(len(v) - len(w)) < 2 and apart(v, w) for v, _ in distinct[:i])}
    gone = defaultdict(set)
    for d, i, w in rows:
        if len(w) >= least and (first[w] != (d, i) or w in near_drop):
            gone[d].add(i)
    return {d: (len(t.split("\n")), len(gone[d]), "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone[d])) for d, t in docs.items()}


def plain_words(text):
    """Runs of letters, marks and digits, each in its lower-case form."""
    low = lambda ch: ch.lower()[0] if unicodedata.category(ch)[0] in "LMN" else " "
    return "".join(map(low, text or "")).split(" ")


def overlaps(docs, items, window=13, subs=2, short=8, least=3):
    """{(id, item)}."""
    split = lambda t: [w for w in plain_words(t) if w]
    out = set()
    for d, t in docs.items():
        w = split(t)
        for i, s in items.items():
            b = split(s)
            n, most = (window, subs) if len(b) >= window else (len(b), 1 if len(b) >= short else 0)
            if n >= least and any(sum(x != y for x, y in zip(w[p : p + n], b[q : q + n], strict=True)) <= most for p in range(len(w) - n + 1) for q in range(len(b) - n + 1)):
                out.add((d, i))
    return out


def fast_overlaps(docs, items, window=13, subs=2, short=8, least=3):
    """:func:`overlaps` by comparing whole windows as arrays."""
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in plain_words(t) if w])
    names, parts = [], {}
    for i, s in items.items():
        b = coded(s)
        n, most = (window, subs) if len(b) >= window else (len(b), 1 if len(b) >= short else 0)
        if n >= least:
            names.append((i, n, most))
            parts[i] = np.lib.stride_tricks.sliding_window_view(b, n)
    out = set()
    for d, t in docs.items():
        w = coded(t)
        for i, n, most in names:
            if len(w) >= n and np.isin(w, parts[i]).sum() >= n - most:
                own = np.lib.stride_tricks.sliding_window_view(w, n)
                if any((n - (own == p).sum(axis=1)).min() <= most for p in parts[i]):
                    out.add((d, i))
    return out
