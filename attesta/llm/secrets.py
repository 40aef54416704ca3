"""Secret scans: patterns, and candidates confirmed by the structure they decode to."""
from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from attesta.llm.common import table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der-key", "openssh-key", "pem-key")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s+((?:(?!-----)[A-Za-z0-9+/=\s:,.-])*)-----END \1-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Za-z])")
_SSH = b"openssh-key-v1\0"


def decode64(text: str) -> bytes | None:
    """Bytes of base64 or base64url text, padded or not; None if it is neither."""
    body = re.sub(r"\s+", "", text).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at `at`; None if its length is not minimal or leaves the data."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at:at + size], "big"), at + size
        if n < 0x80 or (size > 1 and n < 1 << 8 * (size - 1)):
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_key(data: bytes) -> bool:
    """A private key in DER: one sequence that fills the data, its values nested without a gap, in a key's order."""
    top = tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts, at = [], top[1]
    while at < top[2]:
        part = tlv(data, at, top[2])
        if not part:
            return False
        parts.append(part)
        at = part[2]
    tags = [p[0] for p in parts]
    if len(parts) < 2 or tags[0] != 0x02 or data[parts[0][1]:parts[0][2]] not in (b"\0", b"\1"):
        return False
    if len(parts) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True  # modulus, exponents, primes
    if len(parts) >= 6 and len(parts) < 9 and all(t == 0x02 for t in tags):
        return True  # p, q, g, public, private
    if tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16:
        return True  # version 1, key octets, [curve]
    if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        inner = tlv(data, parts[1][1], parts[1][2])
        return bool(inner and inner[0] == 0x06)  # algorithm identifier, wrapped key
    return False


def openssh_key(data: bytes) -> bool:
    """The OpenSSH private key container: magic, three strings, a count of keys, that many public keys, one private part."""
    if not data.startswith(_SSH):
        return False
    at, seen = len(_SSH), 0

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n:at]

    for _ in range(3):
        if string() is None:
            return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    while seen < keys + 1:
        if seen > 64 or string() is None:
            return False
        seen += 1
    return keys >= 1


def is_object(data: bytes | None, key: str | None = None) -> bool:
    if not data or data[:1] != b"{":
        return False
    try:
        got = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and (key is None or isinstance(got.get(key), str))


def key_kind(data: bytes | None, depth: int = 2) -> str | None:
    """What key the bytes hold, looking through `depth` more layers of base64, hex or PEM."""
    if not data or len(data) < 16:
        return None
    if der_key(data):
        return "der-key"
    if openssh_key(data):
        return "openssh-key"
    if depth and data.isascii():
        text = data.decode("ascii").strip()
        pem = _PEM.search(text)
        if pem:
            return key_kind(decode64(pem[2]), depth - 1) and "pem-key"
        if _ANY_HEX.fullmatch(text):
            return key_kind(bytes.fromhex(text), depth - 1)
        if _BASE64.fullmatch(text):
            return key_kind(decode64(text), depth - 1)
    return None


def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, evidence) of every secret in code points, by start and kind as listed."""
    t = text or ""
    out = [("assign", m.start(), m.end(), m[1].lower()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    if "AKIA" in t:
        out += [("access", m.start(), m.end(), "prefix") for m in _ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), "digits") for m in _HEX.finditer(t)]
    if "eyJ" in t:
        for m in _JWT.finditer(t):
            if is_object(decode64(m[1]), "alg") and is_object(decode64(m[2])):
                out.append(("jwt", m.start(), m.end(), "signed header and claims"))
    taken = []
    if "-----BEGIN" in t:
        for m in _PEM.finditer(t):
            kind = key_kind(decode64(m[2]))
            if kind:
                out.append(("pem-key", m.start(), m.end(), kind))
                taken.append((m.start(), m.end()))
    for rx, decode in ((_BASE64, decode64), (_ANY_HEX, bytes.fromhex)):
        for m in rx.finditer(t):
            if rx is _BASE64 and _ANY_HEX.fullmatch(m[0]):
                continue
            kind = None if any(a <= m.start() < b for a, b in taken) else key_kind(decode(m[0]))
            if kind:
                out.append((kind, m.start(), m.end(), "base64" if rx is _BASE64 else "hexadecimal"))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("evidence", T.StringType())]))


@F.pandas_udf(SPANS)
def secret_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "evidence"), s)) for s in find(t)] for t in texts], dtype=object)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, secrets) for every row of docs: an array of kind, start, end (code points, end exclusive) and evidence.

    Pattern kinds (assign, access, hex) are matched leftmost and without overlap, each kind by itself.
    The other kinds are reported only after their structure holds: a signed token's header and claims are
    JSON objects and the header names its algorithm; a key is DER whose lengths nest without a gap, or an
    OpenSSH container, in base64, hex or PEM, also one inside another.
    Null and empty text: an empty array.  Null ids and repeated rows: one row each.  Empty table: no rows.
    Nothing is shuffled; other columns are not read.
    """
    return docs.select(id_col, secret_spans(text_col).alias("secrets"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets of every document."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"))
