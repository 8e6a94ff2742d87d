"""Texts of more than a million characters: many words, and one word."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute_set
from test_pii import brute as brute_pii
from test_quality import brute as brute_quality

from vellum.llm.decontaminate import contained_items
from vellum.llm.jaccard import join_ngrams
from vellum.llm.language import identify_language, learn_profiles
from vellum.llm.mixing import mix_sources
from vellum.llm.pii import find_pii, redact
from vellum.llm.quality import judge_quality
from vellum.llm.secrets import find_secrets
from vellum.llm.shared import span_list
from vellum.llm.substrings import remove_repeats
from vellum.llm.token_counts import TOKENIZER, Counter, count_edited, redaction_edits


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{rng.randrange(50_000)}" for _ in range(180_000)]
    for at in range(1000, 180_000, 9000):
        words[at : at + 3] = [f"u{at}@site.org", "token=abcdef" + str(at), "10.0.0.1"]
    return {1: " ".join(words), 2: "x" * 1_200_000, 3: " ".join(words[:90_000]) + " end", 4: "ab" * 600_000}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)


def test_measures_of_words(docs, texts):
    got = {r.doc_id: r for r in judge_quality(docs).collect()}
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
    assert {r.doc_id: r.size for r in mix_sources(docs).collect()} == {i: len(t.split()) for i, t in texts.items()}


def test_personal_data_and_secrets(docs, texts):
    got = {r.doc_id: r.said for r in find_pii(docs).withColumn("said", span_list(F.col("base"))).collect()}
    # plain expressions take the square of the length of a text without blanks; those have nothing to be found
    assert got == {1: brute_pii(texts[1])[4], 2: "", 3: brute_pii(texts[3])[4], 4: ""}
    assert {r.doc_id for r in redact(docs).collect() if "@site" in r.text} == set()
    assert {r.doc_id: r.n_assign for r in find_secrets(docs).collect()} == {1: 20, 2: 0, 3: 10, 4: 0}


def test_tokens(docs, texts):
    counter = Counter(TOKENIZER)
    rows = {r.doc_id: r for r in count_edited(redaction_edits(docs.where("doc_id in (1, 3)"))).collect()}
    for i in (1, 3):
        assert rows[i].n_tokens == len(counter.encoding.encode_ordinary(texts[i]))
        assert rows[i].n_edits == len(texts[i].split("@site")) - 1 + texts[i].count("10.0.0.1") and rows[i].chars_encoded < len(texts[i]) / 4


def test_sets_of_shingles(docs, texts, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_ngrams(docs, width=4, percent=85).collect()}
    assert got == {i: (len(brute_set(t, 4)), i) for i, t in texts.items()}
    item = spark.createDataFrame([(7, " ".join(texts[1].split()[100:120]))], "item_id long, text string")
    assert sorted((r.doc_id, r.n_shared) for r in contained_items(docs, item).collect()) == [(1, 16), (3, 16)]


def test_repeats_and_languages(docs, texts):
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[4].n_removed) == (0, 0, 0)
    assert got[3].n_removed == len(texts[3]) - len("end") and got[3].n_spans == 1
    profiles = learn_profiles(docs.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in identify_language(docs, profiles).collect()} == {"en"}


def test_very_many_matches_in_a_text(spark):
    """100,000 e-mail addresses in one text: redaction and edits take time in proportion, not its square."""
    n = 100_000
    text = "".join(f"u{i}@mail.example.org, " for i in range(n))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "no match", "en", "s", 8)], "doc_id long, text string, lang string, source string, n_chars long")
    start = time.perf_counter()
    got = {r.doc_id: (r.text, r.n_chars) for r in redact(docs).collect()}
    assert time.perf_counter() - start < 60
    assert got == {1: ("[EMAIL], " * n, 9 * n), 2: ("no match", 8)}
    start = time.perf_counter()
    edits = redaction_edits(docs).where("doc_id = 1").select(F.size("edits").alias("n"), F.element_at("edits", -1).alias("last")).first()
    assert time.perf_counter() - start < 60
    assert edits.n == n and text[edits.last.start : edits.last.end] == f"u{n - 1}@mail.example.org" and edits.last.text == "[EMAIL]"
