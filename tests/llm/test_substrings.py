import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import substrings
from vellum.llm.substrings import GRAM, WINDOW, minimizer_runs, refine, remove_repeats


def brute(docs):
    """docs: (doc_id, text) -> Counter of (doc_id, n_bytes, n_removed, n_spans, sha256 of what is left)."""
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - WINDOW + 1) if d is not None else ():
            w = b[p : p + WINDOW]
            first[w] = min(first.get(w, d), d)
    out = Counter()
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - WINDOW + 1) if d is not None else ():
            if first[b[p : p + WINDOW]] < d:
                gone[p : p + WINDOW] = True
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[(d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())] += 1
    return out


def texts_with_passages(seed):
    rng = random.Random(seed)
    letters = "abcdé \n"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.choice([30, 48, 49, 50, 51, 52, 70, 200, 400])) for _ in range(15)] + ["z" * 120, "ab" * 60]
    docs = []
    for d in range(70):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [make(rng.choice([0, 1, 5, 60])), p[cut:] if rng.random() < 0.4 else p]
        docs.append((d * 3, "".join(parts) + make(rng.choice([0, 3, 80]))))
    docs += [(1000 + i, docs[i * 7][1]) for i in range(8)]
    rng.shuffle(docs)
    return docs


def got(df, **how):
    rows = remove_repeats(df, **how).drop("removed").collect()
    return Counter(map(tuple, rows))


def test_equals_brute_force(spark):
    docs = texts_with_passages(1)
    docs += [docs[4], docs[9], (docs[2][0], docs[3][1] + "x" * 60), (None, docs[5][1]), (5001, None), (5002, "")]
    want = brute([x for x in docs if x[0] != docs[2][0]])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = got(df)
    assert sum(w[2] > 0 for w in want) > 20
    # the doc_id with two texts is left out of both sides; its texts remove from others what they hold
    two = {docs[2][0]}
    assert Counter({k: n for k, n in found.items() if k[0] not in two}) == Counter({k: n for k, n in brute(docs).items() if k[0] not in two})


def common_passages(n=90):
    """A long passage, and one of WINDOW bytes in ever other surroundings, each in most documents."""
    rng = random.Random(4)
    make = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    long, short = make(300), "s" + "".join(rng.choice("uvwxyz") for _ in range(WINDOW - 1))
    return [(d, make(rng.randint(0, 90)) + rng.choice([long, long[rng.randint(1, 99) :], ""]) + make(60) + short + make(rng.randint(0, 60))) for d in range(n)]


def test_common_passages_equal_brute_force(spark):
    docs = texts_with_passages(2) + [(d + 2000, t) for d, t in common_passages()] + [(None, "z" * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert got(df, common=3) == want
    assert got(df, common=40) == want  # some are common and others aren't


def test_no_group_holds_all_of_a_common_passage(spark, monkeypatch):
    docs = spark.createDataFrame(common_passages(), "doc_id long, text string")
    firsts = docs.withColumn("key", F.xxhash64("text"))
    hashes, n = substrings.common_minimizers(firsts, 20)
    bits = substrings.common_filter(hashes, n)
    rows = firsts.select("doc_id", "text").mapInArrow(substrings.minimizers(64, bits), "bucket int, hashes binary, docs binary").collect()
    left = Counter(h for r in rows for h in np.frombuffer(r.hashes, np.uint32))
    assert n > 5 and max(left.values()) < 20
    monkeypatch.setattr(substrings, "FEW_WINDOWS", 0)
    monkeypatch.setattr(substrings, "FEW_RUNS", 0)
    assert got(docs, common=20) == brute(common_passages())


def test_minimizers_of_few_documents_with_many_places_are_common(spark):
    line = "the very same line of a text that repeats itself, over and over\n"
    docs = [(d, f"{d:05d}" * 12 + line * 30) for d in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, n = substrings.common_minimizers(df, 40)
    assert n > 2  # some stand 120 times in 4 documents
    assert got(df, common=40) == brute(docs)


def test_filter_of_common_minimizers(spark, monkeypatch):
    rng = np.random.default_rng(3)
    own, others = rng.integers(0, 1 << 63, 40_000, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, 40_000, np.uint64) * np.uint64(2)
    table = spark.createDataFrame([(int(h),) for h in own.view(np.int64)], "hash long").repartition(8)
    bits = substrings.common_filter(table, len(own))
    assert len(bits) == 2 * substrings.SEGMENT_BITS // 8  # two segments
    assert substrings.among(own, bits).all() and not substrings.among(others[:100], np.empty(0, np.uint8)).any()
    assert substrings.among(others, bits).mean() < 0.001
    monkeypatch.setattr(substrings, "MOST_SEGMENTS", 1)
    full = substrings.common_filter(table, len(own))
    assert len(full) == substrings.SEGMENT_BITS // 8 and substrings.among(own, full).all()


def test_minimizers_taken_for_common_by_chance_change_nothing(spark, monkeypatch):
    docs = texts_with_passages(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    some = np.random.default_rng(1).integers(0, 256, substrings.SEGMENT_BITS // 8).astype(np.uint8) | 0b01010111
    for bits in (some, np.full(substrings.SEGMENT_BITS // 8, 255, np.uint8)):  # many pass, then all
        monkeypatch.setattr(substrings, "common_filter", lambda hashes, n, bits=bits: bits)
        assert got(df) == brute(docs)


def test_packed_ids():
    ranges = ([5], [-3, 9], [7, 7, 7 + 255, 7 + 256], [1, 1 << 16, 2 << 16], [7, 7 + (1 << 32) - 1], [0, 1 << 32], [-(1 << 63), 0, (1 << 63) - 1], [-(1 << 63), (1 << 63) - 1])
    for ids in ranges:
        ids = np.array(ids)
        assert (substrings.unpacked_ids(substrings.packed_ids(ids)) == ids).all()
    assert len(substrings.packed_ids(np.arange(100))) == 108


def test_one_id_with_two_texts(spark):
    a, b = "a" * 30 + "first passage here" * 4, "other beginning " + "first passage here" * 4 + " end"
    docs = [(1, a), (2, a[10:]), (2, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)


def test_small_table(small_docs):
    some = small_docs.where("n_chars < 4000")
    assert got(some, bucket_bytes=20_000) == brute([(r.doc_id, r.text) for r in some.collect()])


def test_edges(edge_docs, empty_docs):
    assert got(edge_docs) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert remove_repeats(empty_docs).count() == 0


def test_every_window_is_in_one_run_of_its_leftmost_least_gram():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (50, 51, 130, 300)]
    starts = np.cumsum([0, *map(len, texts)])
    text, first, last, _ = minimizer_runs(starts, np.frombuffer(b"".join(texts), np.uint8))
    windows = [(t, p) for t, a, b in zip(text, first, last) for p in range(a, b + 1)]
    assert windows == [(t, starts[t] + p) for t in range(4) for p in range(len(texts[t]) - WINDOW + 1)]
    assert all(b - a <= WINDOW - GRAM for a, b in zip(first, last))


def test_refined_buckets_are_equal_strings():
    data = np.frombuffer(b"abc" * 60 + b"abd" * 60 + b"abc" * 30, np.uint8)
    numbers, raw = refine(data, np.arange(len(data) - WINDOW + 1)), data.tobytes()
    groups = {}
    for p, k in enumerate(numbers):
        assert groups.setdefault(raw[p : p + WINDOW], k) == k
    assert len(groups) == len(set(numbers.tolist()))
