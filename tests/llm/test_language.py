import zlib

import numpy as np
from pyspark.sql import functions as F

from vellum.llm.language import gram_counts, identify_language, learn_profiles, letter_codes, most_frequent, op8_language_id, predictor

BITS = 21


def brute_grams(text, k):
    counts = {}
    blanked = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = "".join(f" {w} ".replace(" ", "\0") for w in blanked.split()).replace("\0\0", "\0")
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if not (n == 1 and g == "\0") and "\0" not in g[1:-1]:
                packed = 0
                for c in g:
                    packed = packed << BITS | ord(c)
                counts[packed] = counts.get(packed, 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], g))[:k]


def test_ranked_grams_equal_brute_force():
    for text in ("Hello, wörld! Hello again.", "a", "12 a 3 bb", "ab " * 50 + "çé"):
        assert most_frequent(*gram_counts(letter_codes(text)), 20).tolist() == brute_grams(text, 20)


def test_out_of_place_distance_by_hand():
    profiles = {"x": np.array(brute_grams("aab ab", 5), np.uint64), "y": np.array(brute_grams("zz zzy", 5), np.uint64)}
    predict = predictor(profiles, 5)
    lang, score = predict("aab")
    top = brute_grams("aab", 5)
    far = {k: sum(abs(i - p.tolist().index(g)) if g in p.tolist() else 5 for i, g in enumerate(top)) for k, p in profiles.items()}
    assert lang == "x" and abs(score - (1 - far["x"] / far["y"])) < 1e-12


def test_held_out_accuracy_and_contract(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    got = op8_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in unseen) >= 0.97 * len(unseen) > 100


def test_edges(spark, edge_docs, empty_docs, small_docs):
    profiles = learn_profiles(small_docs.select("doc_id", "text", "lang").dropna())
    rows = identify_language(edge_docs, profiles).collect()
    assert len(rows) == edge_docs.count()
    said = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert said[0] == said[1] == said[2] == said[10] == ("und", 0.0)
    assert identify_language(empty_docs, profiles).count() == 0
    assert learn_profiles(empty_docs.select("doc_id", "text", "lang")) == {}
    assert {r.lang_pred for r in identify_language(edge_docs, {}).collect()} == {"und"}
    assert small_docs.select(F.countDistinct("lang")).first()[0] == len(profiles)
