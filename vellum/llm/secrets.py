"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, then checksums.

One automaton finds every keyword in a single pass over a text. Only where it hits is the expression of
that keyword tried, anchored at the hit. Runs of hex digits have no keyword; they are found as runs.
The method adds tokens that carry their own checksum: the last six base-62 digits hold the CRC-32 of
the thirty before, and a token whose checksum is wrong is dropped.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.shared import pieces, table

#: Keywords and expressions of the base kinds.
ASSIGN_KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS_KEYWORDS = ["akia"]
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Prefixes of tokens with an embedded CRC-32.
CHECKED_KEYWORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

BASE_KINDS = ["assign", "access", "hex"]
ORDER = {kind: i for i, kind in enumerate([*BASE_KINDS, "checked"])}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def base62(number: int, width: int) -> str:
    digits = ""
    for _ in range(width):
        number, rest = divmod(number, 62)
        digits = BASE62[rest] + digits
    return digits


def checksum_holds(payload: str, check: str) -> bool:
    return base62(zlib.crc32(payload.encode()), 6) == check


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for kind, keywords in (("assign", ASSIGN_KEYWORDS), ("access", ACCESS_KEYWORDS), ("checked", CHECKED_KEYWORDS)):
        for word in keywords:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def lowered(text: str) -> str:
    """text with A-Z in lower case at least, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def scan(text: str, keywords) -> list[tuple[str, int, int]]:
    """The spans of one text, by start, then kind."""
    hits: dict[str, list[int]] = {"assign": [], "access": [], "checked": []}
    for end, (kind, n) in keywords.iter(lowered(text)):
        hits[kind].append(end - n + 1)
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    done = 0
    for at in sorted(hits["assign"]):
        if at >= done and (m := ASSIGN.match(text, at)):
            done = m.end()
            if len(m[1]) >= 6:
                found.append(("assign", *m.span()))
    done = 0
    for at in hits["access"]:
        if at >= done and (m := ACCESS.match(text, at)):
            done = m.end()
            if len(m[0]) >= 20:
                found.append(("access", *m.span()))
    for at in hits["checked"]:
        if (m := CHECKED.match(text, at)) and checksum_holds(m[1], m[2]):
            found.append(("checked", *m.span()))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in pieces(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            spans = scan(text or "", keywords)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == kind for s in spans) for kind in ORDER]
            rows.append([*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each row of docs (doc_id, text): counts by kind, a digest of the base spans, all spans.

    One row for each row of docs, repeated ones included; a null doc_id stays null; a null or empty
    text has no spans, and so the digest of the empty string. Other columns are not read. Each text is
    scanned whole, by itself: nothing is shuffled. An empty table gives an empty result.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan_batches, SCHEMA)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
