import random
import re
from collections import Counter

from vellum.llm.decontaminate import contained_items, decontaminate

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    found = set()
    for d, text in docs:
        have = brute_shingles(text)
        for i, item in items:
            want = brute_shingles(item)
            if want and 5 * len(want & have) >= 4 * len(want):
                found.add((d, i, len(want), len(want & have)))
    return found


def planted(seed=3):
    """Items with none to many of their words changed, inside documents long and short."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 6, 12, 30, 70])))) for i in range(40)]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rng.choice([0, 4, 40, 600]))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                part[rng.randrange(len(part))] = word().upper()
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = planted()
    docs, items = docs + [docs[5], (900, None), (901, "")], items + [items[7], (77, None), (78, "")]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 40 and any(w[3] < w[2] for w in want)
    got = contained_items(ddf, idf)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    hit = {w[0] for w in want}
    assert Counter(map(tuple, decontaminate(ddf, idf).collect())) == Counter(d for d in docs if d[0] not in hit)


def test_null_and_reused_item_ids(spark):
    text = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    items = [(None, text("x", 20)), (1, text("s", 14)), (1, text("l", 104)), (2, None)]
    docs = [(1, "so " + text("x", 20)), (2, text("s", 14) + " end"), (3, text("l", 104)), (4, text("l", 50)), (5, text("s", 14) + " " + text("l", 104))]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, None, 16, 16), (2, 1, 10, 10), (3, 1, 100, 100), (5, 1, 100, 100)}
    assert Counter(map(tuple, contained_items(ddf, idf).collect())) == Counter(want)
    assert [tuple(r) for r in decontaminate(ddf, idf).collect()] == [docs[3]]


def test_edges(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "the word word word WORD word"), (2, "a row without id but with")], "item_id long, text string").selectExpr("*", "1 as hash", "2 as key")
    assert {(r.doc_id, r.item_id) for r in contained_items(edge_docs, items).collect()} == {(None, 2)}
    kept = decontaminate(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1
    assert contained_items(empty_docs, items).count() == 0
    assert contained_items(edge_docs, items.limit(0)).count() == 0
    assert decontaminate(edge_docs, items.limit(0)).count() == edge_docs.count()
