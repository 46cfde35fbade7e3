"""Token ids of whole texts under a byte-level BPE vocabulary file, a chunk of texts at a time.

Texts are cut into the vocabulary's pre-tokens with array operations on character classes; each distinct pre-token is
encoded once a worker and found again by its hash.  A text with a character outside the classes known exactly is encoded
by the tokenizer library as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np

from .kernel import Chunk, U, span_hashes
from .language import decode

#: Most pre-tokens remembered by a worker; beyond it the memory is emptied.
REMEMBERED = 1 << 20
OTHER, LETTER, NUMBER, SPACE, UNSURE = 0, 1, 2, 3, 4
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point of the basic plane; those first assigned lately are UNSURE."""
    if not _classes:
        table = np.full(0x10000, UNSURE, np.uint8)
        for c in range(0x3000):
            cat = unicodedata.ucd_3_2_0.category(chr(c))
            if cat != unicodedata.category(chr(c)) or cat == "Cn":
                continue
            table[c] = LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else OTHER
        for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F):
            table[c] = SPACE
        table[0x180E] = UNSURE
        _classes.append(table)
    return _classes[0]


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def boundaries(code: np.ndarray, cuts: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, given code points, texts' offsets among them and their classes.

    Runs of a class are pre-tokens; one plain space before a run belongs to it; of other white space before a run the
    last character stands alone; an apostrophe alone takes a following s, t, m, d, re, ve or ll.
    """
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[cuts[:-1]] = True  # of a text (n stands for empty texts at the end)
    first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= first[:n]
    space = kind == SPACE
    # A white-space character right before a run, in the same text.
    lead = np.zeros(n, bool)
    lead[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= lead
    joined = np.flatnonzero(lead & (code == 0x20)) + 1
    start[joined] = False
    apostrophe = np.flatnonzero((code == 0x27) & start)
    apostrophe = apostrophe[apostrophe < n - 1]
    apostrophe = apostrophe[start[apostrophe + 1] & ~first[apostrophe + 1] & (kind[apostrophe + 1] == LETTER)]
    if len(apostrophe):
        padded = np.concatenate([code, np.zeros(3, code.dtype)])
        a, b = padded[apostrophe + 1], padded[apostrophe + 2]
        same = ~first[np.minimum(apostrophe + 2, n)]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = same & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for which, size in ((one, 2), (two, 3)):
            at = apostrophe[which]
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of pre-tokens by their hashes, in an open table of fixed size."""

    def __init__(self, path: str):
        import tiktoken

        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        special = {t for t, i in vocabulary.items() if t.startswith("<|") and t.endswith("|>")}
        ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self.whole = None
        self.forget()

    def forget(self) -> None:
        self.bits = REMEMBERED.bit_length()  # twice as many places as entries
        self.keys = np.zeros(1 << self.bits, U)
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.n = 0
        self.offset, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        at = (hashes >> U(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            place = self.place[at]
            hit = (place >= 0) & (self.keys[at] == hashes[left])
            out[left[hit]] = place[hit]
            go = (place >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if self.n + len(pieces) > REMEMBERED:
            self.forget()
        encoded = [self.bpe._encode_single_piece(p) for p in pieces]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(counts.sum()))
        while self.n + len(pieces) > len(self.offset):
            self.offset, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.count))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        entry = np.arange(self.n, self.n + len(pieces))
        self.offset[entry] = self.used + np.cumsum(counts) - counts
        self.count[entry] = counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += len(pieces)
        at, mask = (hashes >> U(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(entry):
            free = self.place[at] < 0
            self.place[at[free]] = entry[free]  # of several that want one place the last gets it
            lost = self.place[at] != entry
            self.keys[at[~lost]] = hashes[~lost]
            entry, hashes, at = entry[lost], hashes[lost], (at[lost] + 1) & mask

    def whole_text(self, text: str) -> np.ndarray:
        if self.whole is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def texts(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk one after the other, and the texts' offsets among them."""
        code, at = decode(c.buf)
        kind = classes()[np.minimum(code, 0xFFFF)]  # beyond the basic plane: unsure, as its last code point is
        where = np.searchsorted(at, c.cuts)
        starts = boundaries(code, where, kind)
        owner_cuts = np.searchsorted(starts, where)
        a = at[starts]
        b = np.append(a[1:], len(c.buf)).astype(np.int64)
        hashes = span_hashes(c.buf, a, b)
        entry = self.find(hashes)
        if (entry < 0).any():
            new, index = np.unique(hashes[entry < 0], return_index=True)
            index = np.flatnonzero(entry < 0)[index]
            room = self.n + len(new) <= REMEMBERED
            for i in range(0, len(new), REMEMBERED):  # a chunk has fewer than that
                part = index[i : i + REMEMBERED]
                self.learn(new[i : i + REMEMBERED], [c.buf[x:y].tobytes() for x, y in zip(a[part], b[part], strict=True)])
            if not room:  # the memory was emptied: what the chunk needs besides is learned again
                entry = self.find(hashes)
                missing, index = np.unique(hashes[entry < 0], return_index=True)
                index = np.flatnonzero(entry < 0)[index]
                self.learn(missing, [c.buf[x:y].tobytes() for x, y in zip(a[index], b[index], strict=True)])
            entry = self.find(hashes)
        count = self.count[entry].astype(np.int64)
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.pool[np.repeat(self.offset[entry] - total[:-1], count) + np.arange(total[-1])]
        cuts = total[owner_cuts]
        unsure = np.flatnonzero(kind == UNSURE)
        if len(unsure):
            parts = [ids[cuts[i] : cuts[i + 1]] for i in range(c.n)]
            for i in np.unique(np.searchsorted(where, unsure, "right") - 1):
                parts[i] = self.whole_text(c.buf[c.cuts[i] : c.cuts[i + 1]].tobytes().decode())
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, cuts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
