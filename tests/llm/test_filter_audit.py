import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from vellum.llm.filter_audit import COUNTED, Diagram, audit_filters, failure_masks, op11_filter_audit, swaps

COLUMNS = ["part", "filter_order", "step", *COUNTED]


def brute_masks(docs, labels):
    """A list of (part, mask, good, toxic)."""
    said = defaultdict(lambda: [False, False])
    for doc, quality, toxic in labels:
        if doc is not None:
            said[doc][0] |= quality == 1
            said[doc][1] |= toxic == 1
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    out = []
    for doc, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = (
            (len(words) < 200)
            | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) << 2
            | bool(re.search("[#$%&*|]", text)) << 3
            | (doc is not None and doc > first[text]) << 4
        )
        out.append((source or "", mask, *(said[doc] if doc is not None else (False, False))))
    return out


def brute_audit(masks, names):
    found, shapley = {}, Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        fails = lambda mask, letter: mask >> names.index(letter) & 1
        for order in permutations(names):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if fails(m[1], letter)]
                left = [m for m in left if not fails(m[1], letter)]
                all_failing = sum(fails(m[1], letter) for m in own)
                alone = sum(m[1] == 1 << names.index(letter) for m in own)
                shapley[part, letter] += len(gone)
                found[part, "".join(order), step] = [len(left), len(gone), all_failing - len(gone), alone, sum(m[2] for m in gone), sum(m[3] for m in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in found.items()}


def as_dict(df):
    rows = df.select(*COLUMNS).collect()
    assert len({tuple(r)[:3] for r in rows}) == len(rows)
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6])
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for k in swaps(n):
        order[k : k + 2] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


def test_diagram_shares_equal_nodes_and_survives_swaps():
    alike = Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert len(alike.nodes) == 6  # one node a level
    rng = random.Random(3)
    masks = {m: (rng.randint(0, 3), 0, 0) for m in range(16)}
    diagram = Diagram(masks, 4)
    for _ in range(50):
        diagram.swap(rng.randint(0, 2))
        assert diagram.weights[diagram.root][0] == sum(n for n, _, _ in masks.values())
        kept = [m for m in masks]
        for variable, left, _, _ in diagram.steps():
            kept = [m for m in kept if not m >> variable & 1]
            assert left[0] == sum(masks[m][0] for m in kept)


def test_audit_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"p{min(rng.randint(0, 9), 2)}", rng.choice([0, 0, rng.randrange(8)]), rng.random() < 0.5, rng.random() < 0.1) for _ in range(300)]
    made = audit_filters(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), "XYZ")
    assert as_dict(made) == brute_audit(rows, "XYZ")


def test_edges(spark, edge_docs):
    labels = [(1, 1, 0), (1, 0, 1), (5, None, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "1 as mask")
    docs = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    made = failure_masks(edge_docs, frame)
    want = brute_masks(docs, labels)
    assert Counter(map(tuple, made.collect())) == Counter(want)
    assert as_dict(audit_filters(made)) == brute_audit(want, "ABCDE")


def test_long_text_and_copies(spark):
    texts = ["word " * 300_000, "Ab#" * 400_000, *["same text"] * 500]
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    made = failure_masks(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert Counter(map(tuple, made.collect())) == Counter(brute_masks(docs, []))


def test_empty(spark, empty_docs):
    made = audit_filters(failure_masks(empty_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert made.collect() == [] and made.columns == COLUMNS


def test_query_covers_every_source_and_order(spark, small):
    rows = op11_filter_audit(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    parts = {r[0] or "": r[1] for r in docs.groupBy("source").count().collect()}
    assert len(rows) == 600 * len(parts)
    assert all(r["kept"] + r["removed"] <= parts[r["part"]] for r in rows)
