"""Stages against brute force on the small table and on edge texts."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from test_decontaminate import brute as brute_contained
from test_jaccard import brute as brute_components
from test_pii import brute as brute_pii

STAGES = dict(pipeline.STAGES)
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources"]


def test_each_stage_on_the_small_table(spark, small, small_docs):
    quality = STAGES["quality rules"](spark, small_docs, small)
    assert quality.columns == DOCUMENTS
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    before, after = dict(pairs(small_docs)), dict(pairs(quality))
    short = {d for d, t in before.items() if len(re.findall("[^\x20\x09-\x0d]+", t)) < 50}
    assert not short & set(after)
    assert all(d in after for d, q in labels.items() if q == 1 and d not in short)

    unique = STAGES["n-gram Jaccard join"](spark, small_docs, small)
    assert unique.columns == DOCUMENTS
    assert sorted(d for d, _ in pairs(unique)) == sorted({c for _, _, c in brute_components(list(before.items()), 5, 80)})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = STAGES["benchmark decontamination"](spark, small_docs, small)
    dirty = {w[0] for w in brute_contained(list(before.items()), items)}
    assert clean.columns == DOCUMENTS and set(dict(pairs(clean))) == set(before) - dirty and dirty

    masked = dict(pairs(STAGES["PII"](spark, small_docs, small)))
    assert set(masked) == set(before)
    for d, text in before.items():
        base = brute_pii(text)
        if not sum(base[:4]):
            assert masked[d] == text or "[CONTEXT]" in masked[d]
        else:
            assert masked[d] != text and not sum(brute_pii(masked[d])[:4])


def test_whole_run(spark, small):
    mixed = pipeline.run(spark, small)
    rows = mixed.collect()
    assert mixed.columns[:5] == DOCUMENTS and rows
    assert all(0 < r.copies <= 3 and r.taken == r.copies * r.size for r in rows)


CLASHING = {"_key": "'k1'", "row_key": "'k2'", "node": "-1", "copies": "'c'", "kept": "'yes'", "_spans": "2", "_cut": "3", "pii_cut": "4", "component_id": "5", "key": "'k3'", "votes": "6"}


def test_clashing_columns_stay_what_they_are(spark, small, edge_docs):
    docs = edge_docs.selectExpr("*", *(f"{value} as {name}" for name, value in CLASHING.items()))
    before = docs.collect()
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    bag = lambda rows, names: Counter(tuple(r[c] for c in names) for r in rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    dirty = {w[0] for w in brute_contained([(r.doc_id, r.text) for r in before], items)}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns
        rows = after.collect()
        assert not bag(rows, others) - bag(before, others)
        if name == "quality rules":
            assert all(words(r.text) >= 50 for r in rows)
        if name == "n-gram Jaccard join":  # one row of each text with words
            assert bag(rows, ["text"]) == Counter({(t,): 1 if words(t) else n for (t,), n in bag(before, ["text"]).items()})
        if name == "benchmark decontamination":
            assert bag(rows, docs.columns) == bag([r for r in before if r.doc_id not in dirty], docs.columns)
        if name == "PII":
            assert bag(rows, others) == bag(before, others)
    mixed = pipeline.STAGES[-1][1](spark, docs, small)
    assert mixed.columns == [c for c in docs.columns if c not in pipeline.MIXED] + pipeline.MIXED
    rows = mixed.collect()
    assert rows and all(r.size == words(r.text) and r.taken == r.copies * r.size and r._key == "k1" for r in rows)
    assert max(bag(rows, ["doc_id", "source", "text"]).values()) == 1


def test_empty_tables_pass_every_stage(spark, small, empty_docs):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty_docs, small).count() == 0


def test_repeated_ids_with_different_texts_lose_nothing(spark, small):
    one, other, near = ("".join(f"{w}{i} " for i in range(80)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, one, "a"), (1, other, "b"), (1, other, "b"), (2, one, "c"), (None, near, "d"), (None, near + "end", "e"), (7, other + "end", "f"), (8, None, "g"), (None, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = STAGES["n-gram Jaccard join"]
    for _ in range(2):
        kept = Counter((r.doc_id, r.text, r.source) for r in stage(spark, docs, small).collect())
        assert sorted((r for r in kept if r[1]), key=str) == sorted([r for r in kept if r[1] and r[2] in "abde"], key=str)
        assert Counter((r[0], r[1]) for r in kept if r[0]) == Counter([(1, one), (1, other), (8, None)])
        assert sum(r[0] is None and r[1] != "" for r in kept) == 1 and (None, "", "h") in kept and max(kept.values()) == 1
    kept = STAGES["quality rules"](spark, docs, small).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t, _ in rows if t)
    assert {r.source for r in STAGES["mixing sources"](spark, docs, small).collect()} <= set("abcdef")


def test_mix_of_the_last_stage_comes_near_its_targets(spark, small, small_docs):
    rows = STAGES["mixing sources"](spark, small_docs, small).collect()
    taken, largest = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[r.source] - r.target) <= 3 * largest[r.source] + 1 for r in rows)
