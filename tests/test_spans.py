import random
import time

import pytest
from pyspark.sql import functions as F

from vellum.functions.spans import bound, rewritten, running_max, united
from vellum.operators import deid
from vellum.operators.dataset import split_groups
from vellum.sources.tables import materialised as checkpointed

SPANS = "array<struct<start:int,end:int,type:string>>"


def union(spans):
    made = []
    for start, end, kind in sorted(spans):
        if made and start < made[-1][1]:
            made[-1][1] = max(made[-1][1], end)
        else:
            made.append([start, end, kind])
    return [tuple(x) for x in made]


def rewrite(text, spans):
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"<{kind}:{text[start:end]}>"]
        at = end
    return "".join([*out, text[at:]])


def test_bound_takes_a_value_once(spark):
    row = spark.range(1).select(bound(F.rand(), lambda x: F.array(x, x)).alias("a")).first()
    assert row.a[0] == row.a[1]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 4096, 5000])
def test_running_max(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(10 * n) for _ in range(n)]
    got = spark.createDataFrame([(values,)], "v array<int>").select(running_max(F.col("v"), lambda b: b).alias("b")).first().b
    assert got == [None, *(max(values[:i]) for i in range(1, n))] if n < 100 else got[-1] == max(values[:-1]) and got[100] == max(values[:100])


def test_union_and_rewriting_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = [("", []), (None, None), (None, []), ("abc", None), ("é😀x", [(0, 3, "A")]), ("😀😀", [(1, 1, "E"), (1, 2, "A")])]
    for _ in range(60):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(200)))
        spans = []
        for _ in range(rng.randrange(40)):
            start = rng.randrange(len(text) + 1)
            spans.append((start, min(len(text), start + rng.randrange(12)), rng.choice("AB")))
        rows.append((text, sorted(spans)))
    df = spark.createDataFrame(rows, f"text string, spans {SPANS}").withColumn("u", united(F.col("spans"), ["start", "end", "type"]))
    said = lambda s, raw: F.concat(F.lit("<"), s["type"], F.lit(":"), raw, F.lit(">"))
    for row, (text, spans) in zip(df.withColumn("out", rewritten(F.col("text"), F.col("u"), said)).collect(), rows, strict=True):
        want = None if spans is None else union(spans)
        assert (row.u if row.u is None else [tuple(x) for x in row.u]) == want
        assert row.out == (rewrite(text, want) if want else text)


def test_hundred_thousand_spans_in_a_text(spark):
    """Linear: a text of 1.9 million characters, with a span in every 19, some of which overlap."""
    n = 100_000
    text = "Jo Doe 2020-01-31; " * n
    spans = [(19 * i, 19 * i + 6, "PATIENT_NAME") for i in range(n)] + [(19 * i + 3, 19 * i + 6, "OTHER") for i in range(0, n, 7)]
    df = spark.createDataFrame([(text, sorted(spans), "p")], f"text string, spans {SPANS}, id string")
    start = time.perf_counter()
    u = united(F.sort_array("spans"), ["start", "end", "type"])
    out = df.select(deid.rewrite_spans(F.col("text"), u, F.col("id")).alias("t")).first().t
    assert time.perf_counter() - start < 20
    assert out == "[PATIENT_NAME] 2020-01-31; " * n


def test_address_without_code_and_patient_without_address(spark):
    kind = "array<struct<line:array<string>,city:string,state:string,postalCode:string>>"
    rows = [("a", [([], "c", "S", "")]), ("b", []), ("c", None), ("d", [([], "c", None, None)]), ("e", [([], "c", "S", "12345")])]
    df = spark.createDataFrame([(i, a, None, None) for i, a in rows], f"id string, address {kind}, name string, identifier string")
    got = {r.id: r.address if r.address is None else [tuple(x) for x in r.address] for r in deid.redact_patients(df).collect()}
    assert got == {"a": [("S", None)], "b": [], "c": None, "d": [(None, None)], "e": [("S", "123**")]}


def test_a_million_groups(spark):
    """As the plain greedy rule, in closed form."""
    n = 1_000_000
    size = F.col("id") * 7919 % 1000003 % 37 + 1
    sizes = spark.range(n).select("id", size.alias("n"), F.col("id").alias("first"))
    start = time.perf_counter()
    got = split_groups(sizes, "id", checkpointed).groupBy("n", "split").agg(F.count("*").alias("k"), F.sum("id").alias("ids")).collect()
    assert time.perf_counter() - start < 120
    groups = sorted((-(i * 7919 % 1000003 % 37 + 1), i) for i in range(n))
    total = -sum(k for k, _ in groups)
    names, lack, made = ["train", "val", "test"], [total * x for x in (0.8, 0.1, 0.1)], {}
    counts = [0, 0, 0]
    for k, i in groups:
        s = max(range(3), key=lambda s: (lack[s] - counts[s], -s))
        counts[s] += -k
        one = made.setdefault((-k, names[s]), [0, 0])
        one[0] += 1
        one[1] += i
    assert {(r.n, r.split): [r.k, r.ids] for r in got} == made
