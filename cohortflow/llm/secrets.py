"""Secret scans with structural confirmation (operator 9).

Base patterns name spans; longer base64, hex, key-block and signed-token
candidates are reported only after their inner structure has been decoded.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortflow.llm.texts import map_texts

# Kinds in the order in which spans of equal start are listed: the base ones, then the confirmed ones.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "jwt", "sshkey")

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]+)-----"
    r"((?:(?:\s|\\[nr])*[A-Z][A-Za-z-]*:\x20?[\x20A-Za-z0-9,-]+(?=\s|\\[nr]))*)"
    r"((?:[A-Za-z0-9+/=\s]|\\[nr])+?)-----END \1-----"
)
_ESCAPED = re.compile(r"\\[nr]")
_JWT_PART = re.compile(r"[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
# Lines of base64 of one width, the last of which may be shorter, with or without escapes for line ends.
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/]+)+={0,2}"
)
_LONG_HEX = re.compile(r"(?:[0-9A-Fa-f]{2}){32,}")
_SSH_KEY = b"openssh-key-v1\x00"
# A line of a wrapped block, and how the base64 of a SEQUENCE or of an SSH key begins.
_LINE = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/\\]))[A-Za-z0-9+/]+={0,2}")
_KEY_HEADS = ("MA", "MB", "MC", "MD", "ME", "MF", "MG", "MH", "MI", "b3Blbn")

Span = tuple[int, int, str]


def secret_form(tags: list[int]) -> bool:
    """True if a SEQUENCE of such members is a private key, plain or encrypted.

    Private keys begin with a version, an INTEGER; two or three INTEGERs alone
    are a public key, a signature or parameters.  An encrypted key is an
    algorithm and an OCTET STRING.  Public keys, certificates and requests begin
    with a SEQUENCE and end with a BIT STRING.
    """
    if tags == [0x30, 0x04]:
        return True
    return tags[:1] == [0x02] and tags not in ([0x02] * 2, [0x02] * 3)


def der_ok(raw: bytes) -> bool:
    """True if the bytes are one ASN.1 SEQUENCE whose nested lengths all fit, in the form of a private key."""
    if len(raw) < 16 or raw[0] != 0x30:
        return False
    top: list[int] = []

    def header(at: int, end: int) -> tuple[int, int, int] | None:
        """Tag, start and end of the value at ``at``; None if it doesn't fit in ``end``."""
        if at + 2 > end:
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        return (tag, at, at + n) if at + n <= end else None

    first = header(0, len(raw))
    if first is None or first[2] != len(raw):
        return False
    todo = [(first[1], first[2])]
    whole = todo[0]
    while todo:
        at, end = span = todo.pop()
        while at < end:
            got = header(at, end)
            if got is None:
                return False
            tag, start, at = got
            if span == whole:
                top.append(tag)
            if tag in (0x30, 0x31):
                todo.append((start, at))
    return secret_form(top)


def decoded(text: str, url: bool = False) -> bytes | None:
    """Base64 bytes, or None if the text isn't base64."""
    text = "".join(text.split())
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(
            body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True
        )
    except (binascii.Error, ValueError):
        return None


def jwt_ok(token: str) -> bool:
    """True if header and payload of a signed token are JSON objects and the header names an algorithm."""
    head, body, _ = token.split(".")
    try:
        h = json.loads(decoded(head, url=True) or b"")
        return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(
            json.loads(decoded(body, url=True) or b""), dict
        )
    except (ValueError, RecursionError):
        return False


def key_ok(raw: bytes | None) -> str | None:
    """The kind of key that the bytes hold."""
    if raw is None:
        return None
    if raw.startswith(_SSH_KEY):
        return "sshkey"
    return "der" if der_ok(raw) else None


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            raw = decoded(_ESCAPED.sub("", m[3]))
            # Headers of an encrypted block: what they say is the cipher's, a whole number of its blocks.
            hidden = "ENCRYPTED" in m[2] and m[1].endswith("PRIVATE KEY") and raw and len(raw) % 8 == 0
            if hidden or key_ok(raw):
                found.append((m.start(), m.end(), "pem"))
    found += signed_tokens(text)
    for m in _BASE64.finditer(text):
        if kind := key_ok(decoded(m[0])):
            found.append((m.start(), m.end(), kind))
    for m in _WRAPPED.finditer(text):
        found += wrapped_keys(m[0], m.start())
    for m in _LONG_HEX.finditer(text):
        if m[0][:2] in ("30", "6f") and (kind := key_ok(bytes.fromhex(m[0]))):
            found.append((m.start(), m.end(), kind))
    return found


def signed_tokens(text: str) -> list[Span]:
    """Signed tokens: three parts that begin with the base64 of ``{"``; each part of the text is read once."""
    found: list[Span] = []
    at = text.find("eyJ")
    while at >= 0:
        ends = [_JWT_PART.match(text, at).end()]
        while len(ends) < 3 and text[ends[-1] : ends[-1] + 1] == ".":
            ends.append(_JWT_PART.match(text, ends[-1] + 1).end())
        if len(ends) == 3 and ends[0] - at >= 13 and ends[1] - ends[0] >= 5:
            if jwt_ok(text[at : ends[2]]):
                found.append((at, ends[2], "jwt"))
            at = text.find("eyJ", ends[2])
        else:
            at = text.find("eyJ", ends[0])
    return found


def wrapped_keys(block: str, start: int) -> list[Span]:
    """Keys in adjoining base64 lines: from a line that may begin one to the first line of another width."""
    lines = [(m.start(), m.end()) for m in _LINE.finditer(block)]
    found: list[Span] = []
    at = 0
    while at < len(lines):
        a, b = lines[at]
        to = at + 1
        if block.startswith(_KEY_HEADS, a):
            while to < len(lines) and lines[to - 1][1] - lines[to - 1][0] == b - a >= lines[to][1] - lines[to][0]:
                to += 1
            raw = decoded("".join(block[x:y] for x, y in lines[at:to])) if to > at + 1 else None
            if kind := key_ok(raw):
                found.append((start + a, start + lines[to - 1][1], kind))
                at = to
                continue
        at += 1
    return found


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs`` (doc_id, text).

    Spans count code points, their end is exclusive.  Null and empty texts have
    no spans and the hash of the empty string.  Rows are taken one by one: a
    repeated row gives a repeated result, a null doc_id stays null, an empty
    table gives no row, other columns are not read.
    """

    def make():
        def run(texts: list) -> list[list]:
            out: list[list] = [[] for _ in range(5)]
            for text in texts:
                base = base_spans(text or "")
                kinds = [k for _, _, k in base]
                row = [
                    *[kinds.count(k) for k in BASE_KINDS],
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(base + confirmed_spans(text or "")),
                ]
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_texts(docs, make, fields)
