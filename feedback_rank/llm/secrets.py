"""Secrets in whole texts, candidates confirmed by their structure.

Base spans are what three patterns find: assignments, access keys and long runs of hex
digits. On top of them come spans that are reported only after decoding: a base64 or hex
run must decode, and the bytes must be a private key (a DER or OpenSSH encoding whose
nested lengths add up to the last byte) or, for three dotted parts, a signed token whose
header is a JSON object that names an algorithm. Such runs may be wrapped, escaped or
quoted, or stand behind a path; a PEM body that its headers call encrypted must decode to
whole blocks.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_rank.llm.tokens import in_small_batches

# fixed values: the base patterns, their shortest findings, and the kinds in the order they are listed
BASE = {
    "assign": re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token")

# candidates that have to be decoded
_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_BEFORE, _BEHIND = " \t>|#*\"'`", " \t,;\\\"'`"  # around a line of a PEM body
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_KEY_START = re.compile(r"M(?=[A-P][A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXktdjE")  # a sequence, or OpenSSH's mark
_RUN = re.compile(r"[A-Za-z0-9+/_-]++")
# between two lines of base64: an end of line, plain or escaped, with quotes and indents around it
_WRAP = re.compile(
    r"""["'`]?+[ \t]*+(?:(?:\\++[nr])++["'`]?+(?:[ \t]*+\+(?=[ \t]*+\r?\n))?+|(?:\+(?=[ \t]*+\r?\n))?+\\?+[ \t]*+\r?\n)[\s>|#*"'`]*+"""
)
_KEY_LEAST = 40  # base64 characters
_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")

_SEQUENCE, _INTEGER, _OCTETS = 0x30, 0x02, 0x04
_OPENSSH = b"openssh-key-v1\0"


def _decoded(text: str) -> bytes | None:
    """The bytes of a base64 text, of either alphabet, padded or not; None if it is none."""
    text = "".join(text.split()).rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the DER element at ``at``; None if it does not fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        length = int.from_bytes(data[at:at + size], "big")
        if length < 0x80 or data[at] == 0:  # DER takes the shortest form
            return None
        at += size
    return (tag, at, at + length) if at + length <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements from ``at``, which must fill the space up to ``end``."""
    found = []
    while at < end:
        element = _element(data, at, end)
        if element is None:
            return None
        found.append(element)
        at = element[2]
    return found


def is_der_key(data: bytes) -> bool:
    """A private key in DER: PKCS#1 or DSA (integers only), SEC 1, or PKCS#8 around one of them.

    The outer sequence must end with the last byte, and the elements in it fill it exactly.
    """
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != _SEQUENCE or outer[2] != len(data):
        return False
    parts = _elements(data, outer[1], outer[2])
    if not parts or parts[0][0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [tag for tag, _, _ in parts]
    if version > 1:
        return False
    if len(tags) >= 6 and all(tag == _INTEGER for tag in tags):
        return True
    if len(tags) >= 2 and tags[1] == _OCTETS and version == 1:  # SEC 1: a scalar of a curve
        return 16 <= parts[1][2] - parts[1][1] <= 72
    if len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:  # PKCS#8
        algorithm = _elements(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][2] > parts[2][1]
    return False


def is_openssh_key(data: bytes) -> bool:
    """A private key as OpenSSH writes it: cipher, derivation, options, keys, each with its length."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    for field in range(3):
        if at + 4 > len(data):
            return False
        length = int.from_bytes(data[at:at + 4], "big")
        if length > len(data) - at - 4 or field < 2 and not data[at + 4:at + 4 + length].isascii():
            return False
        at += 4 + length
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    for _ in range(min(keys, len(data)) + 1):  # the public keys and the private part
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return keys >= 1 and at == len(data)


def is_signed_token(text: str) -> bool:
    """Three dotted parts; the first is a JSON object that names its algorithm, the second decodes."""
    header, body, signature = text.split(".")
    decoded = _decoded(header)
    try:
        parsed = json.loads(decoded) if decoded else None
    except ValueError:
        return False
    if not isinstance(parsed, dict) or not isinstance(parsed.get("alg"), str) or not parsed["alg"]:
        return False
    if _decoded(body) is None:
        return False
    return parsed["alg"].lower() == "none" or bool(signature) and _decoded(signature) is not None


def _key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None


def _is_pem_body(label: str, body: str) -> bool:
    """Whether a body between marks is a key, under escapes, quotes and header lines; an encrypted one can only decode."""
    body = re.sub(r"(?<!\\)\\++[nr]", "\n", body).replace("\\t", " ").replace("\\/", "/")
    body = re.sub(r"""["'`]\s*\+\s*["'`]""", "\n", body)  # strings that are added up
    lines = [line.lstrip(_BEFORE).rstrip(_BEHIND) for line in body.splitlines()]
    headers = [i for i, line in enumerate(lines) if _HEADER.match(line)]
    texts = ["".join(line for line in lines if not _HEADER.match(line))]
    if headers and "" in lines[headers[0]:]:  # headers with continued lines end at an empty one
        texts.append("".join(lines[lines.index("", headers[0]):]))
    encrypted = "ENCRYPTED" in label
    cipher = any("4,ENCRYPTED" in lines[i] for i in headers) and any(lines[i].startswith("DEK-Info:") for i in headers)
    for data in map(_decoded, texts):
        if _key_kind(data) or data and (encrypted or cipher and len(data) % 8 == 0):
            return True
    return False


def _pem_spans(text: str) -> list[tuple[int, int]]:
    """Blocks of two marks of one label that follow each other, around a key."""
    found, begin = [], None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin:
            if begin[2] == m[2] and _is_pem_body(m[2], text[begin.end():m.start()]):
                found.append((begin.start(), m.end()))
            begin = None
    return found


class _Chain:
    """Runs of base64 that follow each other as wrapped lines, from ``start`` on."""

    def __init__(self, text: str, start: int):
        self.places, self.offsets, parts, size = [], [], [], 0
        at = start
        while m := _RUN.match(text, at):
            self.places.append(m.start())
            self.offsets.append(size)
            parts.append(m[0])
            size += len(m[0])
            self.end = m.end()
            wrap = _WRAP.match(text, m.end())
            if not wrap:
                break
            at = wrap.end()
        self.chars = "".join(parts).translate({ord("-"): "+", ord("_"): "/"})
        self.ends = {o: p + o - b for p, b, o in zip(self.places, self.offsets, [*self.offsets[1:], size])}

    def offset(self, place: int) -> int:
        line = bisect_right(self.places, place) - 1
        return self.offsets[line] + place - self.places[line]

    def read(self, offset: int, first: int, count: int) -> bytes:
        """Bytes of what is encoded from ``offset`` on; fewer where it ends."""
        part = self.chars[offset + first // 3 * 4:offset + -(-(first + count) // 3) * 4]
        part = part[:-1] if len(part) % 4 == 1 else part
        return base64.b64decode(part + "=" * (-len(part) % 4))[first % 3:first % 3 + count]


def _key_length(chain: _Chain, offset: int) -> int | None:
    """The bytes that a key at ``offset`` must have, by its own lengths."""
    head = chain.read(offset, 0, 15)
    if head == _OPENSSH:
        at, most = len(_OPENSSH), len(chain.chars) - offset
        for _ in range(3):
            at += 4 + int.from_bytes(chain.read(offset, at, 4), "big")
        keys, at = int.from_bytes(chain.read(offset, at, 4), "big"), at + 4
        for _ in range(min(keys, most) + 1):
            if at > most:
                return None
            at += 4 + int.from_bytes(chain.read(offset, at, 4), "big")
        return at
    if len(head) < 15 or head[0] != _SEQUENCE:
        return None
    size = head[1] & 0x7F if head[1] >= 0x80 else 0
    if size > 4 or head[2 + size:4 + size] != b"\2\1" or head[4 + size] > 1:  # all keys begin with a version
        return None
    return 2 + size + (int.from_bytes(head[2:2 + size], "big") if size else head[1])


def _base64_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 at any start that no letter or digit precedes; they end where a run or a wrapped line does."""
    found, chain, upto = [], None, 0
    for m in _KEY_START.finditer(text):
        start = m.start()
        before = text[start - 1:start]
        escaped = before in ("n", "r", "t") and text[start - 2:start - 1] == "\\"
        if start < upto or before.isascii() and before.isalnum() and not escaped:
            continue
        if chain is None or start >= chain.end:
            chain = _Chain(text, start)
        offset = chain.offset(start)
        length = _key_length(chain, offset)
        chars = -(-4 * length // 3) if length else 0
        end = chain.ends.get(offset + chars)
        if chars < _KEY_LEAST or end is None:
            continue
        if kind := _key_kind(_decoded(chain.chars[offset:offset + chars])):
            upto = end + len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))
            found.append((start, upto, kind))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, in code points, ends exclusive."""
    found = []
    if ":" in text or "=" in text:  # an assignment has one of them, and most texts neither
        found += [
            (m.start(), m.end(), "assign") for m in BASE["assign"].finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
        ]
    found += [(m.start(), m.end(), "access") for m in BASE["access"].finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in BASE["hex"].finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the structure confirms; a key within a PEM block counts once, as the block."""
    taken = _pem_spans(text) if "-----BEGIN " in text else []
    found = [(a, b, "pem") for a, b in taken]
    for start, end, kind in _base64_spans(text):
        at = bisect_right(taken, (start, len(text))) - 1
        if at < 0 or start >= taken[at][1]:
            found.append((start, end, kind))
    for m in _HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), m.end(), kind))
    return found + [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if is_signed_token(m[0])]


def digest(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then by the order of KINDS, joined by commas."""
    order = sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


_SPANS = "array<struct<start: bigint, end: bigint, kind: string, base: boolean>>"


def _scanned(batches: Iterator[pa.RecordBatch], text_at: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kind = schema.field("spans").type
    for batch in batches:
        spans = []
        for text in batch.column(text_at):
            text = text.as_py() or ""
            found = [(a, b, k, True) for a, b, k in base_spans(text)] + [(a, b, k, False) for a, b, k in confirmed_spans(text)]
            found.sort(key=lambda span: (span[0], KINDS.index(span[2]), span[1]))
            spans.append([{"start": a, "end": b, "kind": k, "base": base} for a, b, k, base in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], schema=schema)


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every document with its findings, by start, then by the order of KINDS.

    ``spans`` are structs (start, end, kind, base), in code points, ends exclusive; ``base``
    tells the patterns' own findings from the confirmed ones. A document without findings,
    without text or with an empty one has an empty list. Repeated rows stay repeated, other
    columns are left out, and nothing is shuffled: each task scans its own texts whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = narrow.select("doc_id", F.lit(None).cast(_SPANS).alias("spans")).schema
    arrow = to_arrow_schema(schema)
    return narrow.mapInArrow(lambda batches: _scanned(batches, 1, arrow), schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): the findings of each document in short.

    ``spans`` joins all findings as kind:start:end with commas; ``base_sha256`` is the
    SHA-256 of the base ones joined likewise, of the empty text if there are none.
    """
    found = secret_spans(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
