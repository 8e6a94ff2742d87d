import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vellum.llm.conversation_trie import op12_conversation_trie, trie_of

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = Counter(), Counter(), []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(rebuilt[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' as key", "1 as depth", "2 as parent", "3 as place", "'y' as words").repartition(5)


def got(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("light", [1, 7, 40, 4096])
def test_random_conversations(spark, light):
    rng = random.Random(light)
    rows = []
    for c in [*range(0, 90), *range(200, 215), 12345678901]:
        for t in range(rng.choice([0, 1, 2, 3, 3, 4, 6, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot"]), rng.choice(["a", "a b", "c  d\te", "é\x85ü"])))
    assert got(trie_of(frame(spark, rows), light)) == brute_trie(rows)


def test_edges(spark):
    rows = [
        (0, 0, None, None), (0, 0, None, None), (0, None, "user", ""), (0, 5, "", "x y"), (1, 1, "user", "hello"), (1, 1, "user", "hello"),
        (None, 0, "user", "lost"), (2, 0, "a", "bc"), (3, 0, "ab", "c"), (4, 0, "u", "w " * 200_000), (5, 0, "u", "w " * 200_000), (25, 0, "u", "own turn gone"),
        (43, -3, "u", "t"), (43, 2, "u", "t"), (9, 0, "u", "1"), (9, 1, "u", "2"), (9, 2, "u", "3"), (9, 3, "u", "4"), (9, 4, "u", "5"),
    ]
    assert got(trie_of(frame(spark, rows))) == brute_trie(rows)


@pytest.mark.parametrize("light", [50, 4096])
def test_copies_and_near_copies_of_a_long_conversation(spark, light):
    """Copies are one weight; conversations that part at their last turn are cut where they branch."""
    long = [("u", f"turn {k}") for k in range(30)]
    rows = []
    for c in range(60):  # exact copies, but for what rebuilding lends
        rows += [(c, t, *turn) for t, turn in enumerate(long)]
    for c in range(100, 160):
        rows += [(c, t, *turn) for t, turn in enumerate(long[:20])] + [(c, 99, "u", f"own {c}")]
    assert got(trie_of(frame(spark, rows), light)) == brute_trie(rows)


def test_many_ends_of_one_node(spark):
    rows = [(c, 0, "u", "same") for c in range(10_000)]
    assert got(trie_of(frame(spark, rows))) == brute_trie(rows)


def test_empty(spark, small):
    none = spark.read.parquet(f"{small}/conversations.parquet").limit(0)
    assert got(trie_of(none)) == Counter()


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_conversation_trie(spark, small)) == brute_trie(rows)
