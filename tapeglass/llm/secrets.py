"""Secret scan with structural confirmation.

Patterns give candidates; base64 and hex candidates are decoded, and a span is reported only if the bytes have the
structure of a key or token: nested lengths of a DER key that fill their parents exactly, the OpenSSH container with its
counted strings, or a signed token whose header is a JSON object naming an algorithm.  A key may start anywhere in a run
of base64 (its lines may be indented, and broken by line ends or by these written as ``\\n``) or of hex digits of either
case, at any alignment, and ends where its outer length says.  Spans of plain assignments, cloud access ids and long hex
runs are always reported.  Positions are code points, ends exclusive.

Cases: a null or empty text has no spans; repeated rows are scanned each; a table without rows gives none; columns other
than the two named are not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import bounded, lean

#: Fixed patterns of the plain kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Candidates that are decoded: runs of one alphabet; those of the first may go on over several lines.
BREAK = r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*"
BASE64 = re.compile(rf"[A-Za-z0-9+/]{{32,}}(?:{BREAK}[A-Za-z0-9+/]+)*={{0,2}}|[A-Za-z0-9_-]{{32,}}={{0,2}}")
BREAKS = re.compile(BREAK)
#: A JSON object's first two bytes are "{" and a quote or white space: "ey" or "ew" in base64.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
ANY_HEX = re.compile(r"[0-9a-fA-F]{48,}")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{32}")
#: How the base64 of a DER key, a container of private keys or a public key may start, and the bytes that a DER key starts with.
KEY_START = re.compile(r"M(?=[A-I])|b(?=3BlbnNzaC1rZXktdjEA)|A(?=AAA[A-Z](?:3NzaC1|2VjZHNh))")
DER_HEAD = re.compile(rb"\x30(?:[\x10-\x7f]|\x81.|\x82..|\x83...)(?:\x02\x01[\x00\x01]|\x30(?:[\x03-\x7f]|\x81.|\x82..)\x06)", re.S)
HEX_HEAD = re.compile(rb"\x30(?=[\x10-\x83])|openssh-key-v1\0|\0\0\0.(?=ssh-|ecdsa-)", re.S)
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "signed_token")
ORDER = {k: i for i, k in enumerate(KINDS)}


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or not data[at]:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a content exactly."""
    out = []
    while at < end:
        e = _element(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1 and SEC 1 private keys, PKCS#8 and SubjectPublicKeyInfo, by their nested lengths."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or len(data) - top[2] > 2:
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags[:9] == [0x02] * 9 and data[parts[0][1] : parts[0][2]] in (b"\0", b"\1"):
        return True  # RSA: version and eight numbers
    if tags[:2] == [0x02, 0x04] and data[parts[0][1] : parts[0][2]] == b"\1" and 16 <= parts[1][2] - parts[1][1] <= 72:
        return True  # elliptic curve: version 1 and the secret
    at = 1 if tags[:1] == [0x02] else 0
    if tags[at : at + 1] == [0x30] and tags[at + 1 : at + 2] in ([0x04], [0x03]):
        inner = _children(data, parts[at][1], parts[at][2])
        return bool(inner) and inner[0][0] == 0x06 and inner[0][2] - inner[0][1] >= 3
    return False


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SSH_MAGIC = b"openssh-key-v1\0"
#: How many counted strings follow the name of each sort of public key.
SSH_STRINGS = ((b"ssh-rsa", 2), (b"ssh-ed25519", 1), (b"ecdsa-sha2-", 2), (b"ssh-dss", 4))


def is_ssh_key(data: bytes) -> bool:
    """The container of private keys, or a public key: counted strings, the first of which names a known sort."""
    private = data[: len(SSH_MAGIC)] == SSH_MAGIC
    at = len(SSH_MAGIC) if private else 0
    found = []
    while at + 4 <= len(data) and len(found) < 3:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        found.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if private:
        return len(found) == 3
    return len(found) >= 2 and len(found[0]) <= 40 and bytes(found[0]).startswith(tuple(p for p, _ in SSH_STRINGS))


def _skip(data: memoryview, at: int, strings: int) -> int | None:
    """The end of so many counted strings."""
    for _ in range(strings):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def _sizes(data: memoryview) -> tuple[int, ...]:
    """The bytes that a key at the start of ``data`` has, by its outer length; a container of private keys may have a 16-byte tag."""
    if data[:1] == b"0":
        top = _element(data, 0, len(data))
        return () if top is None else (top[2],)
    if data[: len(SSH_MAGIC)] == SSH_MAGIC:
        at = _skip(data, len(SSH_MAGIC), 3)
        if at is None or (end := _skip(data, at + 4, int.from_bytes(data[at : at + 4], "big") + 1)) is None:
            return ()
        return end, end + 16
    name = _skip(data, 0, 1)
    if name is None or name > 44:
        return ()
    strings = next((k for p, k in SSH_STRINGS if bytes(data[4:name]).startswith(p)), None)
    end = None if strings is None else _skip(data, name, strings)
    return () if end is None else (end,)


def _b64(s: str) -> bytes | None:
    s = re.sub(r"[\r\n=]", "", s).translate({ord("-"): "+", ord("_"): "/"})
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(part: str) -> bool:
    data = _b64(part)
    if not data or data[:1] != b"{":
        return False
    try:
        head = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _key_kind(data: bytes | memoryview | None) -> str | None:
    if not data or len(data) < 24:
        return None
    return "der_key" if data[0] == 0x30 and is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def _key_at(data: memoryview) -> tuple[str, int] | None:
    """Kind and size of the key that ``data`` starts with; a container of private keys without a known size takes it all."""
    if data[:1] == b"0" and not DER_HEAD.match(data[:16]):
        return None
    sizes = _sizes(data)
    for size in (*sizes, len(data)) if data[: len(SSH_MAGIC)] == SSH_MAGIC else sizes[:1]:
        if size <= len(data) and (kind := _key_kind(data[:size])):
            return kind, size
    return None


def _base64_keys(run: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of all keys in a run of base64 of one or more lines.

    At every character that may begin a key, the run is cut behind the outer length that the bytes there name, and the
    search goes on behind a key.  The run is decoded once for each place modulo 4, so the work is linear.
    """
    breaks = [m.span() for m in BREAKS.finditer(run)]
    if breaks:
        edges = [0, *(x for span in breaks for x in span), len(run)]
        lines = list(zip(edges[::2], edges[1::2], strict=True))
        flat = "".join(run[a:b] for a, b in lines)
        before = list(itertools.accumulate((b - a for a, b in lines), initial=0))

        def place(i: int) -> int:
            k = bisect.bisect_right(before, i) - 1
            return lines[k][0] + i - before[k]
    else:
        flat, place = run, int
    size = len(flat.rstrip("="))
    flat = flat[:size].translate({ord("-"): "+", ord("_"): "/"}) + "=" * (len(flat) - size)
    decoded: dict[int, memoryview] = {}
    at = 0
    while m := KEY_START.search(flat, at, size):
        at = m.start()
        turn = at % 4
        if turn not in decoded:
            n = (size - turn) // 4 * 4
            rest = flat[turn + n : size]
            data = binascii.a2b_base64(flat[turn : turn + n])
            decoded[turn] = memoryview(data + (binascii.a2b_base64(rest + "=" * (4 - len(rest))) if len(rest) > 1 else b""))
        found = _key_at(decoded[turn][at // 4 * 3 :])
        if found is None:
            at += 1
            continue
        end = min(at - (-found[1] * 4 // 3), size)
        if end == size:
            end = len(flat)
        yield found[0], place(at), place(end - 1) + 1
        at = end


def _hex_keys(run: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of all keys in a run of hex digits, at either alignment."""
    found = []
    for turn in (0, 1):
        data = bytes.fromhex(run[turn : turn + (len(run) - turn) // 2 * 2])
        at = 0
        while m := HEX_HEAD.search(data, at):
            at = m.start()
            if key := _key_at(memoryview(data)[at:]):
                found.append((key[0], turn + 2 * at, turn + 2 * (at + key[1])))
                at += key[1]
            else:
                at += 1
    out: list[tuple[str, int, int]] = []
    for key in sorted(found, key=lambda k: (k[1], -k[2])):
        if not out or key[1] >= out[-1][2]:  # what lies within a key is part of it
            out.append(key)
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if LONG_RUN.search(text):
        for m in BASE64.finditer(text):
            out += [(kind, m.start() + a, m.start() + b) for kind, a, b in _base64_keys(m[0])]
        for m in ANY_HEX.finditer(text):
            out += [(kind, m.start() + a, m.start() + b) for kind, a, b in _hex_keys(m[0])]
    if "." in text and ("ey" in text or "ew" in text):
        at = 0
        while m := SIGNED.search(text, at):
            header = is_token_header(m[1])
            if header:
                out.append(("signed_token", m.start(), m.end()))
            at = m.end(0 if header else 1)
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["doc_id", "spans"])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every whole text.  No shuffle: one pass over the two columns."""
    rows = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(_scan), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of :func:`scan`'s rows, by built-in functions."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))

