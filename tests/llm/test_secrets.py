import hashlib
import re
import zlib
from collections import Counter

from vellum.llm.secrets import base62, find_secrets

RULES = [
    ("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p, good) in enumerate(RULES) for m in re.finditer(p, text or "") if good(m)]
    said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
    counts = Counter(s[3] for s in spans)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(said.encode()).hexdigest(), said


def test_base_spans_equal_brute_force(spark, edge_docs, small_docs):
    seen = 0
    for docs in (edge_docs, small_docs):
        want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
        got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in find_secrets(docs).collect())
        assert got == want
        seen += sum(n[1] + n[2] + n[3] for n in want)
    assert seen > 5


def test_long_s_and_kelvin_sign_are_not_letters_of_keywords(spark):
    docs = spark.createDataFrame([(1, "paſsword = abcdefgh toKen = abcdefgh İİ token = abcdefgh")], "doc_id long, text string")
    row = find_secrets(docs).first()
    assert (row.n_assign, row.spans) == (1, "assign:40:56")


def test_embedded_checksum_decides(spark):
    payload = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + payload + base62(zlib.crc32(payload.encode()), 6)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    docs = spark.createDataFrame([(1, f"x {good} y"), (2, f"x {bad} y")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in find_secrets(docs).collect()} == {1: "checked:2:42", 2: ""}


def test_empty_table(empty_docs):
    assert find_secrets(empty_docs).count() == 0
