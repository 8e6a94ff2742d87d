from collections import defaultdict

from pyspark.sql import functions as F

from vellum.llm.mixing import mix_sources


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source -> words. Pours what is left by weight, round by round, until no source is above what it may hold."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        left = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s: float(most * sizes[s]) for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return full | share
        full |= above


def check(rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    targets = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * (1 + targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 3 * largest[s] + 1e-6
    return sizes, taken, targets


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (i * 37 % 90 + 1), ["a", "b", "c", "d", None][min(i % 7, 4)]) for i in range(900)]
    rows += [(1000 + i, "tiny", "e") for i in range(3)] + [(2000, None, "f"), (2001, "", "f"), (None, "x y", "a"), (5, "w w", "a"), (5, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cell in (2048, 50):
        mixed = mix_sources(df, cell=cell).collect()
        assert len(mixed) == len(rows)
        sizes, taken, targets = check(mixed)
        assert targets["e"] == 9.0 and taken["e"] == 9 and taken["f"] == 0
        for s in ("a", "b", "c", "d", None):
            assert abs(taken[s] - targets[s]) < 0.05 * targets[s] + 200
    again = mix_sources(df.orderBy(F.desc("doc_id")).repartition(3), cell=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_edges(edge_docs, empty_docs):
    assert len(check(mix_sources(edge_docs).collect())[0]) > 3
    assert mix_sources(empty_docs).count() == 0
