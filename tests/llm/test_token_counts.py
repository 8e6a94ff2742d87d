import math
import random
from collections import Counter as Bag

import pytest

from vellum.llm.token_counts import LEAF, TOKENIZER, Counter, Tree, apply_edits, build_trees, count_edited, levels, recount, redaction_edits, update_trees


@pytest.fixture(scope="module")
def counter():
    return Counter(TOKENIZER)


def test_recount_equals_a_full_count(counter):
    rng = random.Random(4)
    pieces = ["word", " word", "  ", "\n", " 12", "don't", "é", "!!", " ", "   x", "\t", "ab"]
    for n in [0, 1, 5, 40, 300, 900]:
        for _ in range(25):
            text = "".join(rng.choice(pieces) for _ in range(n))
            cuts = sorted(rng.sample(range(len(text) + 1), min(2 * rng.randint(0, 6), len(text) // 2 * 2)))
            edits = [(a, b if rng.random() < 0.8 else a, rng.choice(["", " ", "x", "'s", " new words", "\n\n"])) for a, b in zip(cuts[::2], cuts[1::2])]
            tree = counter.tree(text)
            for _ in range(3):  # edits of the edited text go to the updated tree
                new, tree, encoded, renewed = recount(counter, text, tree, edits)
                assert new == apply_edits(text, edits)
                assert tree.tokens[-1] == [len(counter.encoding.encode_ordinary(new))] and tree.chars[-1] == [len(new)]
                assert tree == Tree(levels(tree.chars[0]), levels(tree.tokens[0]))
                assert encoded <= len(new) and (edits or encoded == renewed == 0)
                text, edits = new, [(len(new) // 3, len(new) // 2, rng.choice(["", "mid dle", "\n"]))]


def test_one_edit_in_a_long_text_is_local(counter):
    text = "some words of a long text, " * 4000
    for edit in [(50_000, 50_004, "other"), (0, 0, "x "), (len(text), len(text), "end"), (60_000, 60_300, "")]:
        before = counter.tree(text)
        new, tree, encoded, renewed = recount(counter, text, before, [edit])
        assert encoded < 40 * LEAF
        assert renewed <= 8 * math.ceil(math.log2(len(before.chars[0])))
        assert tree.tokens[-1] == [len(counter.encoding.encode_ordinary(new))]


def test_leaves_are_found_by_sums():
    sizes = [3, 0, 5, 1, 0, 0, 7, 2, 4, 0, 1]
    tree, place = Tree(levels(sizes), levels(sizes)), 0
    for leaf, n in enumerate(sizes):
        for _ in range(n):
            start = sum(sizes[:leaf])
            assert tree.leaf_at(place) == (leaf, start)
            place += 1
    assert tree.leaf_at(place) == (len(sizes), place) and tree.chars[-1] == [23]


def test_replaced_leaves_equal_a_new_tree():
    sizes = list(range(11))
    for start, end, new in [(2, 4, [7, 7]), (0, 11, list(range(11))), (3, 5, [1]), (4, 4, [9, 9]), (10, 11, [])]:
        want = levels(sizes[:start] + new + sizes[end:])
        assert Tree(levels(sizes), levels(sizes)).replace([(start, end, new, new)])[0] == Tree(want, want)


def test_kept_trees_are_updated_again(spark, counter):
    docs = spark.createDataFrame([(1, "a few words " * 300), (2, None), (3, "")], "doc_id long, text string")
    once = docs.selectExpr("*", "array(named_struct('start', 0, 'end', 0, 'text', 'new '), named_struct('start', 0, 'end', 0, 'text', 'x')) edits")
    kept = update_trees(build_trees(once))
    again = update_trees(kept.selectExpr("doc_id", "text", "array(named_struct('start', 1, 'end', 3, 'text', 'Z')) edits", "tree_chars", "tree_tokens"))
    for r in again.collect():
        assert r.n_tokens_after == len(counter.encoding.encode_ordinary(r.text)) == r.tree_tokens[-1][0]
        assert r.text.startswith("nZ x")


def test_query_shape_and_edges(spark, edge_docs, empty_docs, counter):
    edited = redaction_edits(edge_docs)
    rows = count_edited(edited).collect()
    want = Bag()
    for r in edited.collect():
        new = apply_edits(r.text or "", [(e.start, e.end, e.text) for e in r.edits])
        want[(r.doc_id, len(counter.encoding.encode_ordinary(r.text or "")), len(counter.encoding.encode_ordinary(new)), len(r.edits), len(new))] += 1
    assert Bag((r.doc_id, r.n_tokens, r.n_tokens_after, r.n_edits, r.chars_after) for r in rows) == want
    assert sum(r.n_edits for r in rows) > 5 and all(sum(r.tree_tokens[0]) == r.n_tokens_after for r in rows)
    assert count_edited(redaction_edits(empty_docs)).count() == 0
