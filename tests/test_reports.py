import json
import random
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from vellum.operators import dataset, deid, external, lineage, structure
from vellum.operators.relational import first_k
from vellum.sources import answers, io
from vellum.sources.tables import materialised as checkpointed


def errors(spark, *documents):
    rows = [(d if d is None or isinstance(d, str) else json.dumps(d),) for d in documents]
    return [r.e for r in spark.createDataFrame(rows, "value string").select(structure.resource_errors(F.col("value")).alias("e")).collect()]


def test_resources_are_held_against_their_definitions(spark):
    patient, observation = {"resourceType": "Patient", "id": "1"}, {"resourceType": "Observation", "status": "final", "code": {"coding": [{"code": "x"}]}}
    request = {"resourceType": "MedicationRequest", "status": "active", "intent": "order", "subject": {"reference": "Patient/1"}}
    assert errors(spark, patient, observation, request | {"medicationReference": {"reference": "m"}}) == [[], [], []]
    assert errors(spark, None, "{", "[1]", {"resourceType": "Device"}, {"id": "1"}) == [["document: JSON expected"]] * 2 + [["resourceType: unknown"]] * 3
    assert errors(spark, patient | {"gender": "m"}, patient | {"gender": 1}, patient | {"birthDate": "1950-02"}, patient | {"birthDate": "1950-2-1"}, patient | {"gender": None}) == [
        ["gender: code expected of male, female, other, unknown"], ["gender: code expected of male, female, other, unknown"], [], ["birthDate: date expected"], [],
    ]
    names = [{"given": ["A", ""]}, {"given": "A"}, {"family": ["B"]}, None, "x"]
    assert errors(spark, patient | {"name": names}, patient | {"name": {"family": "B"}}, patient | {"name": []}) == [
        ["name.given: string expected", "name.given: list expected", "name.family: string expected", "name: null in a list", "name: object expected"], ["name: list expected"], [],
    ]
    assert errors(spark, request, request | {"medicationReference": {}, "medicationCodeableConcept": {}}, {"resourceType": "MedicationRequest"}) == [
        ["medication[x]: required"], ["medication[x]: one of its kinds expected"], ["status: required", "intent: required", "medication[x]: required", "subject: required"],
    ]
    component = [{"code": {}, "valueQuantity": {"value": 1.5}}, {"valueQuantity": {"value": "1.5"}}]
    assert errors(spark, observation | {"component": component, "valueBoolean": "yes"}) == [
        ["valueBoolean: boolean expected", "component.code: required", "component.valueQuantity.value: decimal expected"],
    ]


def test_report_counts_and_first_failures(spark):
    docs = [json.dumps({"resourceType": "Patient", "id": str(i), "gender": "male" if i % 3 else "x", "meta": {"profile": ["p"] if i % 2 else []}}) for i in range(100)]
    checked = structure.validated(spark.createDataFrame(list(enumerate(docs)), "ord int, value string"))
    assert {r.resource_type: tuple(r)[1:] for r in structure.validity(checked).collect()} == {"Patient": (100, 66, 34, 50), None: (100, 66, 34, 50)}
    assert [r.id for r in structure.first_failures(checked, ["ord"]).collect()] == [str(i) for i in range(0, 75, 3)]
    assert structure.first_failures(checked.limit(0), ["ord"]).collect() == []


def test_first_k_keeps_k_rows_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("key"))
    got = first_k(rows, ["key"], ["id"], 4)
    assert sorted(r.id for r in got.collect()) == list(range(12))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # within tasks, then over all
    assert [r.id for r in first_k(rows, [], ["id"], 2).collect()] == [0, 1]


def test_recall_over_all_with_missed_spans(spark):
    truth = spark.createDataFrame([("n", 0, 4, "A"), ("n", 5, 9, "A"), ("m", 0, 2, "B"), ("o", 0, 2, "B")], "k string, start int, end int, type string")
    found = spark.createDataFrame([("n", 3, 5), ("m", 2, 3)], "k string, start int, end int")
    got = {r.type: (r.total, r.caught, r.recall, [tuple(x) for x in r.missed]) for r in deid.recall_report(truth, found, "k", 1).collect()}
    assert got == {"A": (2, 1, 0.5, [("n", 5, 9)]), "B": (2, 0, 0.0, [("m", 0, 2)]), None: (4, 1, 0.25, [("m", 0, 2)])}
    nothing = deid.recall_report(truth.limit(0), found, "k").collect()
    assert [tuple(r) for r in nothing] == [(None, 0, 0, 0.0, [])]


def test_many_identifiers_of_a_patient(spark):
    ids = [("p", f"id{i:03d}x") for i in range(200)] + [("q", "zz"), ("q", ""), ("r", "none")]
    texts = [("p", " ".join(f"id{i:03d}x" for i in range(0, 200, 2))), ("p", "id001x"), ("q", "a zz"), ("q", "zz again"), ("s", "id001x"), ("q", None)]
    identifiers, hay = spark.createDataFrame(ids, "id string, value string"), spark.createDataFrame(texts, "id string, text string")
    leaks = deid.leaked_identifiers(identifiers, hay, "id")
    assert {tuple(r) for r in leaks.collect()} == {("p", f"id{i:03d}x") for i in [1, *range(0, 200, 2)]} | {("q", "zz")}
    assert {tuple(r) for r in deid.leaks_by_patient(identifiers, leaks, "id").collect()} == {("p", 101), ("q", 1), ("r", 0)}


def test_recognised_spans_equal_the_patterns(spark):
    rng = random.Random(2)
    texts = [None, "", "MRN1234 MRN12 é😀MRN99999", *("".join(rng.choice(["MRN1234 ", "1.2.3.4", "x", " ", "2020-01-31", "a@b.cd ", "é", "😀"]) for _ in range(300)) for _ in range(20))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", deid.recognised(F.col("text")).alias("s"))
    for row in df.select("*", deid.resolved(F.col("s")).alias("r")).collect():
        want = sorted((m.start(), m.end(), kind, score) for kind, p, score in deid.RECOGNISERS for m in re.finditer(p, row.text or ""))
        assert [tuple(x) for x in row.s] == want
        cover = lambda spans: {i for s in spans for i in range(s[0], s[1])}
        assert cover(row.r) == cover(want) and all(a.end <= b.start for a, b in zip(row.r, row.r[1:], strict=False))
    assert df.select(deid.recognised(F.col("text"), least=0.95).alias("s")).where("exists(s, x -> x.type <> 'EMAIL_ADDRESS')").count() == 0


def test_cache_is_a_log(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = lambda *pairs: spark.createDataFrame(pairs, "key string, value string")
    got = lambda df: {r.key: r.value for r in df.collect()}
    assert got(io.cache_get(spark, path)) == {}
    io.cache_compact(spark, path)
    io.cache_put(rows(("a", "1"), ("b", "1")), path)
    io.cache_put(rows(("b", "2"), ("c", "2")), path)
    assert got(io.cache_get(spark, path)) == {"a": "1", "b": "2", "c": "2"}
    io.cache_compact(spark, path)
    assert len(io._manifest(spark, path)[1]) == 1 and got(io.cache_get(spark, path)) == {"a": "1", "b": "2", "c": "2"}
    io.cache_put(rows(("a", "3")), path)
    assert got(io.cache_probe(rows(("a", ""), ("b", ""), ("x", "")), path)) == {"a": "3", "b": "2"}
    rows(("z", "lost")).withColumn("row", F.lit(0).cast("long")).write.parquet(f"{path}/part-broken")  # written, but never listed
    assert "z" not in got(io.cache_get(spark, path))


def test_runs_registered_at_once_get_versions_of_their_own(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    run = lambda i: lineage.append_run(spark, path, spark.createDataFrame([(f"m{i}",)], "base_model string"))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(run, range(8)))
    assert sorted(versions) == sorted(f"v{i}" for i in range(1, 9))
    runs = lineage.read_registry(spark, path, "base_model string").collect()
    assert {r.version for r in runs} == set(versions) and {r.base_model for r in runs} == {f"m{i}" for i in range(8)}


def test_batch_ledger(spark, tmp_path):
    path, calls = f"file://{tmp_path}/batches", spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y"), ("c", "y")], "key string, text string")
    cache = spark.createDataFrame([("a", "known")], "key string, value string")
    name = external.submit_batch(calls, cache, path)
    assert external.submit_batch(calls.where("key = 'a'"), cache, path) is None
    assert tuple(external.batch_status(spark, path, name).first()) == (2, 0, 0, 2, "in_progress")
    with pytest.raises(RuntimeError, match="not ended"):
        external.collect_batch(spark, path, name)

    def first():
        def ask(text):
            if text == "bad":
                raise ValueError("refused")
            return text.upper()

        return ask

    external.run_batch(spark, path, name, first)
    assert tuple(external.batch_status(spark, path, name).first()) == (2, 1, 1, 0, "ended")
    assert [(r.key, r.error) for r in external.ledger(spark, path, name).where("state = 'failed'").collect()] == [("b", "ValueError: refused")]
    with pytest.raises(RuntimeError, match="failed"):
        external.collect_batch(spark, path, name)
    assert [tuple(r) for r in external.collect_batch(spark, path, name, partial=True).collect()] == [("c", "Y")]
    external.run_batch(spark, path, name, lambda: str.title)  # asks for b alone
    assert {tuple(r) for r in external.collect_batch(spark, path, name).collect()} == {("c", "Y"), ("b", "Bad")}
    assert {r.key: r.tries for r in external.ledger(spark, path, name).collect()} == {"b": 2, "c": 1}


def test_a_record_without_note_is_an_error(spark):
    records = spark.createDataFrame([("n1", [("d",)], [("m", None)], []), ("n2", [], [], [])], "note_id string, diagnoses array<struct<name:string>>, medications array<struct<name:string,dosage:string>>, vitals array<string>")
    notes = spark.createDataFrame([("n1", "text")], "note_id string, text string")
    row = dataset.format_records(records.where("note_id = 'n1'"), notes).first()
    assert (row.instruction, json.loads(row.response)) == ("text", {"diagnoses": [{"name": "d"}], "medications": [{"name": "m", "dosage": None}], "vitals": []})
    with pytest.raises(Exception, match="no note for note_id n2"):
        dataset.format_records(records, notes).collect()


def test_training_batches(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(1, 99) for _ in range(rng.choice([0, 1, 7, 8, 9, 30, 200]))], rng.randrange(10)) for i in range(200)]
    made = dataset.training_batches(spark.createDataFrame(rows, "id int, input_ids array<int>, n_prompt int"), "id", checkpointed, 64, 8).collect()
    given = {i: (ids, n) for i, ids, n in rows}
    assert sorted(r.id for r in made) == list(range(200))
    batches = {}
    for r in made:
        ids, n = given[r.id]
        k = len(ids)
        assert r.input_ids[:k] == ids and not any(r.input_ids[k:]) and r.attention_mask == [1] * k + [0] * (len(r.input_ids) - k)
        assert r.labels == [-100] * min(n, k) + ids[n:] + [-100] * (len(r.input_ids) - k)
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, _), own in batches.items():
        assert {len(r.input_ids) for r in own} == {max(len(given[r.id][0]) for r in own)}
        assert len(own) == 1 or len(own) * (bucket + 1) * 8 <= 64


def test_answers_as_a_data_source(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/requests", tmp_path / "asked"
    asked.mkdir()
    rows = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") != 7, F.concat(F.lit("text "), "id")).alias("text"))
    rows.repartition(3).write.option("parquet.block.size", 4096).option("parquet.block.size.row.check.min", 10).parquet(folder)
    log = str(asked)

    def client():
        import uuid

        file = f"{log}/{uuid.uuid4().hex}"

        def ask(text):
            with open(file, "a") as f:
                f.write(text + "\n")
            if text == "text 5":
                raise ValueError("no")
            return text.upper()

        return ask

    said = lambda: sorted(line for f in asked.iterdir() for line in f.read_text().splitlines())
    answers.register_answers(spark, "rules_of_test", client)
    scan = spark.read.format("rules_of_test").option("splitBytes", 2000)
    got = {r.key: (r.value, r.error) for r in scan.load(folder).collect()}
    want = {str(i): (f"TEXT {i}", None) for i in range(3000)} | {"5": (None, "ValueError: no"), "7": (None, None)}
    assert got == want and said() == sorted(f"text {i}" for i in range(3000) if i != 7)
    assert scan.load(folder).rdd.getNumPartitions() > 3
    empty = tmp_path / "empty"
    empty.mkdir()
    assert scan.load(f"file://{empty}").collect() == []

    for f in asked.iterdir():
        f.unlink()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = scan.option("keys", "true").load(folder).where(F.col("key").isin("5", "8", "9", "x") & (F.col("key") != "9"))
        assert {r.key for r in some.collect()} == {"5", "8"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert set(said()) <= {"text 5", "text 8", "text 9"}
