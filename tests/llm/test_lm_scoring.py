import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import lm_scoring
from vellum.llm.lm_scoring import ORDER, Lookup, SCORED, bucket_count, code_lengths, from_planes, grams_of, op13_lm_scoring, pack_keys, planes, score_texts, segments, unpack_keys

COLUMNS = [c.split()[0] for c in SCORED.split(", ")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


class Ppm:
    """The same model, one byte at a time, with a dictionary for each context."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.symbols(text):
                self.seen[context][symbol] += 1
        for k in range(order, 0, -1):
            for context in [c for c in self.seen if len(c) == k]:
                for symbol in self.seen[context]:
                    self.seen[context[1:]][symbol] += 1

    def symbols(self, text):
        data = b"\xfe" * self.order + " ".join(words_of(text)).encode("utf-8", "surrogatepass") + b"\xff"
        for i in range(self.order, len(data)):
            yield data[i - self.order : i], data[i]

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = self.seen.get(context[self.order - k :])
            if not counts:
                continue
            left = {s: n for s, n in counts.items() if s not in excluded}
            if left:
                total = 2 * sum(left.values())
                if symbol in left:
                    return p * (2 * left[symbol] - 1) / total
                p *= len(left) / total
            excluded |= set(counts)
        return p / (255 - len(excluded))

    def score(self, text):
        return sum(math.log10(self.probability(c, s)) for c, s in self.symbols(text))


def brute_scores(docs, order):
    held = lambda doc: zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0
    training = [t for d, t in docs if not held(d)]
    model, counts = Ppm(training, order), Counter()
    for t in training:
        counts.update(words_of(t))
        counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc, text in docs:
        tokens = [*words_of(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        out.append((doc, held(doc), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, model.score(text)))
    return out


def same(df, want):
    assert df.columns == COLUMNS
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-6)


@pytest.mark.parametrize("order", [1, 5])
def test_scores_equal_brute_force(spark, small_docs, order):
    docs = small_docs.limit(60)
    same(score_texts(docs, order), brute_scores([(r.doc_id, r.text) for r in docs.collect()], order))


def test_edges(spark, edge_docs):
    same(score_texts(edge_docs), brute_scores([(r.doc_id, r.text) for r in edge_docs.collect()], ORDER))


def test_texts_cut_into_parts_and_blocks(spark, small_docs, monkeypatch):
    """Parts of a text overlap by the context, so cuts change nothing; one text is longer than a part, many make a block."""
    docs = [(r.doc_id, r.text) for r in small_docs.limit(20).collect()] + [(1000, "A long text of many words. " * 100_000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same(score_texts(rows), brute_scores(docs, ORDER))
    parts = [(p, o) for ps, os_ in segments([b"x" * (lm_scoring.CHUNK + 1), b"", b"y"], 5) for p, o in zip(ps, os_, strict=True)]
    assert [o for _, o in parts] == [0, 0, 1, 2] and sum(len(p) - 5 for p, _ in parts) == lm_scoring.CHUNK + 2 + 1 + 2


def test_no_training_documents(spark):
    """All rows held out: bytes are uniform, words unknown."""
    docs = [(None, "some words"), (None, None)]
    rows = score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    same(score_texts(spark.createDataFrame(docs, "doc_id long, text string")), brute_scores(docs, ORDER))
    assert {round(r["score"], 6) for r in rows} == {round(-11 * math.log10(255), 6), round(-math.log10(255), 6)}


def test_all_symbols_of_a_context_sum_to_one(spark):
    """Escapes and exclusions leave a probability distribution in contexts that were seen, in part or not at all."""
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "abracadabra"]
    grams = Counter()
    for parts, _ in segments([t.encode() for t in texts], 3):
        grams.update(map(int, grams_of(parts, 3)[0]))
    contexts = [b"the", b"at ", b"e c", b"zzt", b"\xfe\xfe\xfe", b"qqq", b"bra"]
    asked = {int.from_bytes(c + bytes([s]), "big") for c in contexts for s in range(256) if s != 0xFE}
    rows = [(g, grams.get(g, 0)) for g in asked | set(grams)]
    found = dict(map(tuple, code_lengths(spark.createDataFrame(rows, "gram long, n long"), 3).collect()))
    for c in contexts:
        assert sum(10 ** found[int.from_bytes(c + bytes([s]), "big")] for s in range(256) if s != 0xFE) == pytest.approx(1, abs=1e-12)


def test_packing_and_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    assert (unpack_keys(pack_keys(keys)) == keys).all()
    values = rng.random(len(keys))
    assert (from_planes(planes(values), np.float64) == values).all()
    at = rng.integers(0, len(keys), 200_000)
    assert (Lookup(keys, values)(keys[at]) == values[at]).all()
    assert all(all(n % k for k in range(2, int(n**0.5) + 1)) for n in map(bucket_count, (0, 10**9, 10**12, 10**14)))


def test_empty(spark, empty_docs):
    same(score_texts(empty_docs), [])


def test_query(spark, small):
    """On 181 training documents a character of the held-out ones takes 0.75 decimal digits; it would take 2.4 without a model."""
    rows = op13_lm_scoring(spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) / sum(len(docs[r["doc_id"]] or "") for r in held) > -0.75
