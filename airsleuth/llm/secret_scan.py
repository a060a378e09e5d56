"""Operator 11: secrets in texts, with structural confirmation of encoded keys and signed tokens.

Three plain patterns find assignments, access key ids and long hex strings. Beyond them
a base64 or hex string is reported only if what it decodes to has the structure of a secret:
the nested lengths of a private key (DER or OpenSSH) must fit to the byte, an armoured key must
hold one, and a token's header must name an algorithm whose signature has the length found.
Public keys, certificates, unsigned tokens and strings that merely look random are left alone.

Every document is scanned by itself where it is read; nothing is shuffled. A run of base64
or hex is cleaned of line ends once, and structures are read by decoding the few bytes at
their heads, so work grows with the text even if it is all candidates.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from airsleuth.llm.tables import table

# --- fixed values: patterns and kinds in the order they are listed -----------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# Runs of these are maximal, so a lower limit in the pattern drops the same ones as a look at the length.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "private_key", "signed_token")
#: Bytes of a signature by algorithm; RSA's depend on the key.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64}
RSA_SIGNATURE_BYTES = (128, 192, 256, 384, 512, 1024)

_LINE_END = r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*"
#: Runs of base64 over line ends, real ones or escaped as in JSON.
_BASE64_RUN = re.compile(rf"[A-Za-z0-9+/]{{16,}}(?:{_LINE_END}[A-Za-z0-9+/]+)*={{0,2}}")
_HEX_RUN = re.compile(rf"[0-9A-Fa-f]{{32,}}(?:{_LINE_END}[0-9A-Fa-f]+)*")
_BREAK = re.compile(_LINE_END)
# Where structures can start: a DER sequence (30, length), OpenSSH's magic, an armour line.
_BASE64_START = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)")
_HEX_START = re.compile(r"30|6f70656e7373682d6b65792d763100|2d2d2d2d2d424547494e20", re.IGNORECASE)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){2,4}")
_MAGIC, _ARMOUR = b"openssh-key-v1\0", b"-----BEGIN "
_ARMOURED = re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(.*?)-----END \1-----", re.DOTALL)

Read = Callable[[int, int], bytes]


class Span(NamedTuple):
    """Code points ``start`` to ``end`` (exclusive) of a secret; ``kind`` is its place in KINDS."""

    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


# --- nested lengths ------------------------------------------------------------------


class Value(NamedTuple):
    """A DER value: its tag, and where its content starts and ends."""

    tag: int
    start: int
    end: int


def value_at(read: Read, at: int, limit: int) -> Value | None:
    """The DER value whose tag stands at ``at``, or None if it does not end by ``limit``."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    size, used = head[1], 2
    if size >= 0x80:
        n = size & 0x7F
        # DER takes the shortest form, and no key needs more than four bytes of length.
        if not 1 <= n <= 4 or len(head) < 2 + n or head[2] == 0:
            return None
        size, used = int.from_bytes(head[2:2 + n]), 2 + n
        if size < 0x80:
            return None
    start = at + used
    return Value(head[0], start, start + size) if start + size <= limit else None


def values_within(read: Read, outer: Value, most: int = 12) -> list[Value] | None:
    """The values that fill ``outer`` to its last byte, or None."""
    found, at = [], outer.start
    while at < outer.end:
        inner = value_at(read, at, outer.end)
        if inner is None or len(found) == most:
            return None
        found.append(inner)
        at = inner.end
    return found


_SEQUENCE, _INTEGER, _BITS, _OCTETS, _OID = 0x30, 0x02, 0x03, 0x04, 0x06


def _small(read: Read, value: Value) -> int:
    """A version number, or -1."""
    return read(value.start, 1)[0] if value.tag == _INTEGER and value.end == value.start + 1 else -1


def _is_algorithm(read: Read, value: Value) -> bool:
    parts = values_within(read, value) if value.tag == _SEQUENCE else None
    return bool(parts) and parts[0].tag == _OID and parts[0].end - parts[0].start >= 3 and read(parts[0].end - 1, 1)[0] < 0x80


def is_private_key(read: Read, outer: Value) -> bool:
    """Whether a DER sequence is a private key of RSA, DSA, an elliptic curve, PKCS 8, or an encrypted one."""
    parts = values_within(read, outer)
    if not parts:
        return False
    tags, sizes = [p.tag for p in parts], [p.end - p.start for p in parts]
    version = _small(read, parts[0])
    if tags == [_INTEGER] * 9 and version in (0, 1):
        # The modulus is the product of two primes of about half its length.
        return sizes[1] >= 32 and abs(sizes[4] + sizes[5] - sizes[1]) <= 3 and sizes[3] <= sizes[1]
    if tags == [_INTEGER] * 6 and version == 0:
        return sizes[1] >= 32 and sizes[2] <= sizes[1] and sizes[5] <= sizes[2] + 1
    if version == 1 and tags[1:2] == [_OCTETS] and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) <= 4:
        return 16 <= sizes[1] <= 72 and all(values_within(read, p) is not None for p in parts[2:])
    if version in (0, 1) and len(parts) >= 3 and tags[2] == _OCTETS and _is_algorithm(read, parts[1]):
        inner = value_at(read, parts[2].start, parts[2].end)
        return inner is not None and inner.end == parts[2].end and inner.tag in (_SEQUENCE, _OCTETS, _INTEGER)
    if tags == [_SEQUENCE, _OCTETS] and _is_algorithm(read, parts[0]):
        return sizes[1] >= 32 and sizes[1] % 8 == 0
    return False


def openssh_end(read: Read, at: int, limit: int) -> int | None:
    """Where an OpenSSH private key that starts at ``at`` ends, or None.

    After the magic: cipher, derivation and its options, the number of keys, that many
    public keys and the private part, each behind its length.
    """
    def size_at(place: int) -> int | None:
        head = read(place, 4)
        size = int.from_bytes(head)
        return size if len(head) == 4 and place + 4 + size <= limit else None

    at += len(_MAGIC)
    for i in range(3):
        size = size_at(at)
        if size is None or (i < 2 and not 1 <= size <= 64):
            return None
        at += 4 + size
    keys = int.from_bytes(read(at, 4))
    if not 1 <= keys <= 16:
        return None
    at += 4
    for _ in range(keys + 1):
        size = size_at(at)
        if size is None or size < 16:
            return None
        at += 4 + size
    return at


# --- encoded candidates --------------------------------------------------------------


def structure_end(read: Read, size: int) -> int | None:
    """Bytes of the private key that the ``size`` decoded bytes start with, or None."""
    head = read(0, len(_MAGIC))
    if head == _MAGIC:
        return openssh_end(read, 0, size)
    if head.startswith(_ARMOUR):
        armoured = _ARMOURED.match(read(0, size))
        if armoured is None:
            return None
        body = re.sub(rb"\s+", b"", armoured[2].rpartition(b"\n\n")[2])
        try:
            inner = base64.b64decode(body, validate=True)
        except binascii.Error:
            return None
        took = None if inner.startswith(_ARMOUR) else structure_end(lambda at, n: inner[at:at + n], len(inner))
        return armoured.end() if took is not None else None
    if head[:1] == b"\x30":
        outer = value_at(read, 0, size)
        if outer is not None and is_private_key(read, outer):
            return outer.end
    return None


def _cleaned(run: str) -> tuple[str, Callable[[int], int]]:
    """A run without its line ends, and a function from places in it to places in the run."""
    if "\n" not in run and "\\" not in run:
        return run, lambda place: place
    pieces, starts, at, clean = [], [], 0, [0]
    for cut in _BREAK.finditer(run):
        pieces.append(run[at:cut.start()])
        starts.append(at)
        clean.append(clean[-1] + cut.start() - at)
        at = cut.end()
    pieces.append(run[at:])
    starts.append(at)

    def place_in_run(place: int) -> int:
        piece = bisect.bisect_right(clean, place) - 1
        return starts[piece] + place - clean[piece]

    return "".join(pieces), place_in_run


def _base64_reader(text: str, start: int) -> Read:
    def read(at: int, n: int) -> bytes:
        first = at // 3
        last = -(-(at + n) // 3)
        piece = text[start + 4 * first:start + 4 * last]
        piece = piece[:len(piece) - (len(piece) % 4 == 1)]
        return base64.b64decode(piece + "=" * (-len(piece) % 4))[at - 3 * first:at - 3 * first + n]
    return read


def _hex_reader(text: str, start: int) -> Read:
    def read(at: int, n: int) -> bytes:
        piece = text[start + 2 * at:start + 2 * (at + n)]
        return bytes.fromhex(piece[:len(piece) & ~1])
    return read


def encoded_keys(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of private keys that stand in the text as base64 or hex."""
    for run_pattern, start_pattern, reader, per3 in (
            (_BASE64_RUN, _BASE64_START, _base64_reader, 4), (_HEX_RUN, _HEX_START, _hex_reader, 6)):
        for run in run_pattern.finditer(text):
            if start_pattern.search(run[0]) is None:
                continue
            clean, place = _cleaned(run[0])
            body, after = len(clean.rstrip("=")), 0
            for candidate in start_pattern.finditer(clean):
                at = candidate.start()
                # No border within hex shows where a structure starts, and an armour is read whole: only a run's own start counts.
                if at and (per3 == 6 or candidate[0][0] == "L"):
                    continue
                if at < after:
                    continue
                took = structure_end(reader(clean, at), (body - at) * 3 // per3)
                if took is None:
                    continue
                after = at + -(-took * per3 // 3)
                while after < len(clean) and clean[after] == "=" and (after - at) % 4:
                    after += 1
                yield run.start() + place(at), run.start() + place(after - 1) + 1


def _part(text: str) -> bytes | None:
    """Decoded base64url without padding."""
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True) if len(text) % 4 != 1 else None
    except binascii.Error:
        return None


def _object(data: bytes | None) -> dict | None:
    try:
        found = json.loads(data) if data is not None else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(parts: list[str]) -> bool:
    """Whether the parts are a token whose header names how it is signed or encrypted, and the rest fits that."""
    header = _object(_part(parts[0]))
    algorithm = header.get("alg") if header else None
    if not isinstance(algorithm, str):
        return False
    if len(parts) == 5:
        return isinstance(header.get("enc"), str) and all(_part(p) for p in parts[2:])
    if len(parts) != 3 or _object(_part(parts[1])) is None:
        return False
    signature = _part(parts[2])
    if not signature or algorithm.lower() == "none":
        return False
    if algorithm in SIGNATURE_BYTES:
        return len(signature) == SIGNATURE_BYTES[algorithm]
    return len(signature) in RSA_SIGNATURE_BYTES if algorithm[:2] in ("RS", "PS") else len(signature) >= 32


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    for found in _TOKEN.finditer(text):
        parts = found[0].split(".")
        # A full stop of the sentence, and what follows it, is no part.
        for take in (5, 3):
            if len(parts) >= take and is_signed_token(parts[:take]):
                yield found.start(), found.start() + len(".".join(parts[:take]))
                break


# --- documents -----------------------------------------------------------------------


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns, each kind leftmost and without overlaps; too short ones are dropped after matching."""
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and all spans, both in order of start, then kind."""
    base = base_spans(text)
    more = [Span(a, 3, b) for a, b in encoded_keys(text)] + [Span(a, 4, b) for a, b in signed_tokens(text)]
    return base, sorted({*base, *more})


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_private_key``, ``n_signed_token``.

    One row for every row, also for rows that repeat an id or have none. A null text counts as
    empty: no spans, and the hash of an empty string. ``spans`` are ``kind:start:end`` in code points,
    joined by commas, in order of start and then kind; ``base_sha256`` is the hash of those of the patterns.
    Other columns than ``doc_id`` and ``text`` are ignored, so their names may be any.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
        ("spans", pa.string()), ("n_private_key", pa.int64()), ("n_signed_token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = find_secrets(text.as_py() or "")
                counts = [0] * len(KINDS)
                for span in spans:
                    counts[span.kind] += 1
                digest = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                rows.append((*counts[:3], digest, ",".join(map(str, spans)), *counts[3:]))
            columns = zip(*rows) if rows else [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
             "n_private_key long, n_signed_token long")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
