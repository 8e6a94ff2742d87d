import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm.pii import find_pii, redact, trusted_patterns
from vellum.llm.shared import span_list


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


digits = lambda m: re.sub("[^0-9]", "", m[0])
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute(text):
    spans = [(kind, *m.span()) for kind, p, good in RULES for m in re.finditer(p, text or "") if good(m)]
    counts = Counter(s[0] for s in spans)
    return *(counts[k] for k, _, _ in RULES), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_equal_brute_force(edge_docs, small_docs, spark, small):
    seen = Counter()
    for docs in (edge_docs, small_docs):
        want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
        rows = find_pii(docs).withColumn("said", span_list(F.col("base"))).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.said) for r in rows) == want
        assert all([s for s in r.spans if s.kind != "context"] == r.base for r in rows)
        for w in want:
            seen.update({k: n for (k, _, _), n in zip(RULES, w[1:5])})
    assert all(seen[k] > 1 for k, _, _ in RULES)


def test_many_matches_in_one_text(spark):
    text = "é " + " ".join(f"a{i}@b.org 10.0.{i % 256}.1" for i in range(1500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert find_pii(docs).select(span_list(F.col("base"))).first()[0] == brute(text)[4]


def test_contexts_of_seeds_reveal_other_identifiers(spark):
    rows = [(i, f"please write to our agent mail user{i}@site{i}.org today") for i in range(9)]
    rows += [(10, "then write to our agent mail someone@localhost today"), (11, "part number 12345678 was sold out"), (12, "the agent mail 77-88-99-00-x today")]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s[0] for s in found[i]] == ["email"] for i in range(9))
    assert found[10] == [("context", 29, 46)] and found[11] == [] and found[12] == [("context", 15, 28)]


def test_contexts_are_whole_words(spark):
    """Five seeds behind different long words that end alike don't make a pattern for a sixth."""
    rows = [(i, f"to {c * 9}{'z' * 70} u{i}@site.org now") for i, c in enumerate("abcde")]
    rows += [(9, f"to {'f' * 9}{'z' * 70} someone@localhost now")]
    found = find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not [s for r in found.collect() for s in r.spans if s.kind == "context"]


def brute_bootstrap(edges):
    """edges: {(pattern, identifier): seed}. Accepted patterns and their scores, by plain loops."""
    accepted = {}
    while True:
        score = {}
        for (p, i), seed in edges.items():
            score[i] = max(score.get(i, 0.0), accepted.get(p, 0.0))
        means = {}
        for (p, i), seed in edges.items():
            means.setdefault(p, []).append(max(float(seed), score[i]))
        new = {p: sum(x) / len(x) for p, x in means.items() if p not in accepted and sum(s > 0 for s in x) >= 3 and sum(x) / len(x) >= 0.8 - 1e-9}
        if not new:
            return accepted
        accepted |= new


def test_bootstrapping_equals_plain_loops_to_the_last_round(spark):
    rng = random.Random(2)
    edges = {(f"p{rng.randrange(60)}", f"i{rng.randrange(150)}"): rng.random() < 0.75 for _ in range(420)}
    for k in range(8):  # a chain: each pattern is reached by way of the one before
        edges |= {(f"chain{k}", f"c{k}-{j}"): k == 0 for j in range(6)} | {(f"chain{k}", f"c{k + 1}-{j}"): False for j in range(1 if k == 0 else 0)}
        edges |= {(f"chain{k + 1}", f"c{k}-{j}"): k == 0 for j in range(6)}
    want = brute_bootstrap(edges)
    rows = spark.createDataFrame([(*e, s) for e, s in edges.items()], "pattern string, identifier string, seed boolean")
    got = {r.pattern: r.score for r in trusted_patterns(rows).collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_added_spans_equal_plain_loops(spark, small_docs):
    """Candidates, contexts and seeds taken from the texts by Python, then the plain loops."""
    rng = random.Random(7)
    texts = [r.text or "" for r in small_docs.select("text").collect()]
    for _ in range(300):
        who = rng.choice([f"u{rng.randrange(99)}@site.org", f"u{rng.randrange(99)}@host", f"{rng.randrange(10**7, 10**8)}", f"ab-{rng.randrange(10**6)}9"])
        texts.append(f"{rng.choice(['mail', 'write', 'part'])} {rng.choice(['to', 'the', 'No 7'])}\t{who}\n{rng.choice(['now', 'or', 'x@y 1234567'])} end")
    for i in range(40):  # most here are seeds; what the others are called is known elsewhere only by their context
        who = f"u{i}@site.org" if i % 9 else f"u{i}@host"
        texts.append(f"reach  our desk at {who} today")
        texts.append(f"again write via u{i // 9 * 9}@host please")
    word, digits_of = re.compile("[^\x20\x09-\x0d]+"), lambda w: sum(c in "0123456789" for c in w)
    fold = lambda w: re.sub("[0-9]+", "0", w.lower())
    edges, places = {}, []
    for row, text in enumerate(texts):
        found = [m for m in word.finditer(text) if "@" in m[0] or digits_of(m[0]) >= 6]
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute(text)[4].split(",") if s]
        for k, m in enumerate(found):
            left = word.findall(text[found[k - 1].end() if k else 0 : m.start()])[::-1]
            right = word.findall(text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)])
            made = [("b2", *left[1::-1]), ("ba", *left[:1], *right[:1]), ("b1", *left[:1])]
            made = [p for p, n in zip(made, (3, 3, 2), strict=True) if len(p) == n]
            seed = any(a < m.end() and m.start() < b for a, b in spans)
            for p in made:
                p = (p[0], *map(fold, p[1:]))
                edges[p, m[0].lower()] = edges.get((p, m[0].lower()), False) or seed
                places.append((row, m.span(), seed, p))
    trusted = brute_bootstrap(edges)
    want = {(row, *span) for row, span, seed, p in places if not seed and p in trusted}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in find_pii(docs).collect() for s in r.spans if s.kind == "context"}
    assert got == want and want


def test_redaction_masks_spans_and_leaves_the_rest(spark, edge_docs):
    rows = [(1, "mail é a@b.org and 10.0.0.1.", "x"), (2, None, "y"), (3, "clean", "z"), (None, "c@d.net", "w"), (1, "mail é a@b.org and 10.0.0.1.", "x")]
    got = redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    one = (1, "mail é [EMAIL] and [IP].", "x")
    assert Counter(map(tuple, got)) == Counter([one, one, (2, None, "y"), (3, "clean", "z"), (None, "[EMAIL]", "w")])
    assert redact(edge_docs).count() == edge_docs.count()


def test_redaction_covers_the_union_of_overlapping_spans(spark):
    rows = [
        ("call +15551234567@txt.example.net now", "call [PHONE] now"),  # both from one start, the shorter one sorts first
        ("at 10.0.0.1@host.example.org, 10.0.0.2", "at [IP], [IP]"),
        ("paid 4111 1111 1111 1111@pay.example.org.", "paid [CARD]."),  # the e-mail starts inside the card and ends behind it
        ("from a4111111111111111@pay.example.org a@b.org", "from [EMAIL] [EMAIL]"),  # the card lies within the e-mail
        ("to +1 555 123 10.0.0.1@c.org.", "to [PHONE]."),  # a chain of three
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.base] for r in find_pii(docs).collect()}
    assert all(len(kinds[i]) > 1 for i in range(5)) and len(kinds[4]) == 3
    assert {r.doc_id: r.text for r in redact(docs).collect()} == {i: want for i, (_, want) in enumerate(rows)}


def test_empty_table(empty_docs):
    assert find_pii(empty_docs).count() == 0 and redact(empty_docs).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
