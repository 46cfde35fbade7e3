"""Statistics of whole texts that the quality operators share, a chunk of texts at a time."""

from __future__ import annotations

import numpy as np

from .kernel import SPACE, Chunk, U, span_hashes, window_hashes, windows_inside


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Characters that count as symbols.
SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
DIGIT = _table(bytes(range(48, 58)))
STOP = _table(b".!?")
BANG = _table(b"!")
COMMA = _table(b",;:")
PIPE = _table(b"|")
REPEAT_WORDS = 8


def per_text(marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``marks`` between consecutive cuts."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def tagged(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes (48 bits of them) that differ between texts of a chunk."""
    return (owner.astype(U) << U(48)) | (hashes >> U(16))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of the \\n-split lines that have a word."""
    feed = np.flatnonzero(c.buf == 10)
    feed_owner = np.searchsorted(c.cuts, feed, "right") - 1
    starts = np.sort(np.concatenate([c.cuts[:-1], feed + 1]), kind="stable")
    ends = np.sort(np.concatenate([c.cuts[1:], feed]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(c.n), feed_owner]), kind="stable")
    total = np.zeros(len(c.buf) + 1, np.int64)
    np.cumsum(~SPACE[c.buf], out=total[1:])
    full = (ends > starts) & (total[np.maximum(ends, starts)] > total[starts])
    return starts[full], ends[full], owner[full]


def basic(c: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    starts, ends, cuts = c.words()
    points = (c.buf & 0xC0) != 0x80
    out = {"n_words": np.diff(cuts), "word_chars": per_text(points & ~SPACE[c.buf], c.cuts), "n_symbols": per_text(SYMBOL[c.buf], c.cuts)}
    a, b, owner = lines(c)
    keys = np.sort(tagged(owner, span_hashes(c.buf, a, b)))
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    out["n_dup_lines"] = np.bincount((keys[again] >> U(48)).astype(np.int64), minlength=c.n)
    out["n_lines"] = np.bincount(owner, minlength=c.n)
    hashes = window_hashes(c.hashes(), REPEAT_WORDS)
    inside = windows_inside(cuts, REPEAT_WORDS)
    at = np.flatnonzero(inside)
    word_owner = c.owner(np.diff(cuts))
    at = at[repeated(tagged(word_owner[at], hashes[at]))]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WORDS, -1)
    out["n_repeat_words"] = per_text(np.cumsum(cover)[:-1] > 0, cuts)
    return out


def rich(c: Chunk) -> dict[str, np.ndarray]:
    """The basic statistics and shares of characters, words and lines, as doubles."""
    out = basic(c)
    starts, ends, cuts = c.words()
    words = np.maximum(out["n_words"], 1).astype(float)
    size = np.maximum(out["word_chars"], 1).astype(float)
    n = {k: per_text(t[c.buf], c.cuts) for k, t in (("upper", UPPER), ("letter", LETTER), ("digit", DIGIT), ("stop", STOP), ("bang", BANG), ("comma", COMMA), ("pipe", PIPE))}
    last = c.buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = c.buf[starts] if len(starts) else np.zeros(0, np.uint8)
    hashes = c.hashes()
    keys = np.sort(tagged(c.owner(np.diff(cuts)), hashes))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> U(48)).astype(np.int64), minlength=c.n)
    length = (ends - starts).astype(np.int64)
    # The words' average self-information under the text's own word counts.
    runs = np.diff(np.append(np.flatnonzero(new), len(keys)))
    entropy = np.bincount((keys[new] >> U(48)).astype(np.int64), weights=runs * np.log2(np.maximum(runs, 1)), minlength=c.n)
    features = {
        "log_words": np.log1p(out["n_words"]),
        "mean_word": out["word_chars"] / words,
        "long_words": per_text(length > 15, cuts) / words,
        "short_words": per_text(length <= 3, cuts) / words,
        "symbol_share": out["n_symbols"] / size,
        "upper_share": n["upper"] / size,
        "digit_share": n["digit"] / size,
        "letter_share": n["letter"] / np.maximum(np.diff(c.cuts), 1),
        "stop_share": n["stop"] / words,
        "bang_share": n["bang"] / words,
        "comma_share": n["comma"] / words,
        "pipe_share": n["pipe"] / words,
        "symbol_ends": per_text(SYMBOL[last], cuts) / words,
        "upper_starts": per_text(UPPER[first], cuts) / words,
        "distinct_share": distinct / words,
        "word_entropy": np.log2(words) - entropy / words,
        "repeat_share": out["n_repeat_words"] / words,
        "dup_line_share": out["n_dup_lines"] / np.maximum(out["n_lines"], 1),
        "words_a_line": out["n_words"] / np.maximum(out["n_lines"], 1),
    }
    return {k: np.asarray(v, float) for k, v in features.items()}


FEATURES = ("log_words", "mean_word", "long_words", "short_words", "symbol_share", "upper_share", "digit_share", "letter_share", "stop_share", "bang_share", "comma_share", "pipe_share", "symbol_ends", "upper_starts", "distinct_share", "word_entropy", "repeat_share", "dup_line_share", "words_a_line")
