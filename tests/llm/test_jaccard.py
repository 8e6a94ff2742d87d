import math
import random
import re
from collections import Counter

import pytest

from vellum.llm.components import components, contractions
from vellum.llm.hashing import shingle_sets
from vellum.llm.jaccard import join_ngrams

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text, width):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(docs, width, percent):
    """docs: (doc_id, text) -> Counter of (doc_id, n_shingles, component_id)."""
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, brute_set(t, width)) for d, t in docs]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


def groups_of_copies(seed, n_groups=12, copies=14):
    """Groups of near copies with more and more words changed, some with a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(900)
    passage = [word() for _ in range(14)]
    texts = []
    for g in range(n_groups):
        first = [word() for _ in range(rng.choice([3, 9, 25, 60]))]
        for c in range(rng.randint(1, copies)):
            text = list(first)
            for _ in range(rng.choice([0, 0, 1, 1, 1, 2, 3]) * (len(text) > 5)):
                text[rng.randrange(len(text))] = word()
            texts.append(" ".join(text + passage * (g % 3 == 0)))
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return Counter(map(tuple, join_ngrams(df, **how).select("doc_id", "n_shingles", "component_id").collect()))


@pytest.mark.parametrize("heavy", [2, 5, 40])
def test_equals_brute_force_whatever_is_heavy(spark, heavy):
    docs = groups_of_copies(heavy)
    want = brute(docs, 4, 85)
    assert len({c for _, _, c in want}) < len(docs) - 20
    assert result(spark, docs, width=4, percent=85, heavy=heavy) == want


def test_small_table_and_default_threshold(spark, small_docs):
    docs = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    assert result(spark, docs) == brute(docs, 5, 80)


def test_edges(spark, edge_docs, empty_docs):
    got = Counter(map(tuple, join_ngrams(edge_docs, width=4, percent=85).collect()))
    assert got == brute([(r.doc_id, r.text) for r in edge_docs.collect()], 4, 85)
    assert join_ngrams(empty_docs).count() == 0


def test_one_id_with_two_texts_joins_their_groups(spark):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z"), (4, "k")]
    assert {(d, c) for d, _, c in result(spark, docs)} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_shingle_hashes_are_equal_just_as_shingles_are():
    rng = random.Random(5)
    texts = [" \t".join(rng.choice(["a", "B", "b", "çé", "dd"]) for _ in range(rng.randint(0, 9))) + rng.choice(["", "\n"]) for _ in range(300)]
    seen = {}
    for text, got in zip(texts, shingle_sets(texts, 3), strict=True):
        want = brute_set(text, 3)
        assert len(got) == len(want) and got.tolist() == sorted(set(got.tolist()))
        if len(want) == 1:
            assert seen.setdefault(next(iter(want)), got[0]) == got[0]


def test_versions_numbered_at_random_form_one_group(spark):
    """Each text is like its neighbours in the chain only; the numbering doesn't follow the chain."""
    words = ["w%d" % i for i in range(100 + 4 * 300)]
    ids = random.Random(3).sample(range(10_000), 300)
    docs = [(ids[i], " ".join(words[4 * i : 4 * i + 100])) for i in range(300)]
    want = brute(docs, 4, 85)
    assert {c for _, _, c in want} == {min(ids)}
    assert result(spark, docs, width=4, percent=85) == want


def test_two_texts_of_one_id_with_equally_many_shingles(spark):
    rng = random.Random(8)
    first, second = (["%s%d" % (x, rng.randrange(10**6)) for _ in range(60)] for x in "ab")
    near = lambda w, k: [*w[: 59 - k], "other", *w[60 - k :]]
    docs = [(9, " ".join(first)), (9, " ".join(second))] + [(20 + k, " ".join(near(first, k))) for k in range(4)]
    docs += [(40 + k, " ".join(near(second, k))) for k in range(4)]
    for heavy in (2, 40):
        assert {c for _, _, c in result(spark, docs, width=4, percent=85, heavy=heavy)} == {9}


def graph(name, n):
    ids = random.Random(n).sample(range(10 * n), n)
    pairs = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(n // 2, i) for i in range(n)],
        "grid": [(i, j) for i in range(n) for j in (i + 1, i + 40) if j < n and (j > i + 1 or j % 40)],
        "pairs": [(i, i + 1) for i in range(0, n - 1, 2)],
    }[name]
    return ids, [(ids[a], ids[b]) for a, b in pairs]


@pytest.mark.parametrize("name, n", [("path", 1000), ("star", 3000), ("grid", 1600), ("pairs", 500)])
def test_components_of_graphs_numbered_at_random(spark, name, n):
    ids, links = graph(name, n)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    if name == "pairs":
        assert found == {x: min(ids[i & ~1], ids[i | 1]) for i, x in enumerate(ids)}
    else:
        assert found == dict.fromkeys(ids, min(ids))


def test_components_take_logarithmic_rounds(spark):
    n = 10_000
    rounds = len(list(contractions(spark.createDataFrame(graph("path", n)[1], "a long, b long"))))
    assert rounds <= math.log2(n)
    assert len(list(contractions(spark.createDataFrame(graph("star", 3000)[1], "a long, b long")))) <= 2


def test_components_of_loops_nulls_and_nothing(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (5, 5), (7, 7), (200, 200), (None, 3), (4, None), (100, 101)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 102, 103: 102, 200: 200}
    loops = spark.createDataFrame([(5, 5), (6, 6), (6, 6)], "a long, b long")
    assert sorted(map(tuple, components(loops).collect())) == [(5, 5), (6, 6)] and components(loops.limit(0)).count() == 0
