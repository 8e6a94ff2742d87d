"""Invariants and planted faults of the clinical operators on small tables."""

import hashlib
import json
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.functions import vocabulary as V
from vellum.operators import dataset, deid, evaluate, external, generate, lineage, normalize, omop, quality_gate, structure
from vellum.operators import relational as R
from vellum.plans import clinical
from vellum.plans.catalogue import checkpointed
from vellum.sources import io
from vellum.streaming import landing


def offset(patient, category):
    r = int(hashlib.sha256(f"{patient}:{category}".encode()).hexdigest(), 16) % 730
    return r - 365 if r < 365 else r - 364


def test_offsets_follow_the_digest_and_are_never_zero(spark):
    rows = spark.range(300).select("id", S.patient_offset(F.col("id"), F.lit("visit")).alias("d")).collect()
    assert all(r.d == offset(r.id, "visit") != 0 for r in rows)


def test_date_contamination_paraphrase_and_prefix(spark):
    cases = [
        ("Migraine, diagnosed 2017-07-17", "Migraine", True),
        ("Major depression, single episode, first diagnosed 2019-01-30", "Major depression, single episode", True),
        ("Type 2 diabetes mellitus", "Type 2 diabetes mellitus without complication", True),
        ("obesity management", "Obesity", True),
        ("Essential hypertension (dx 2020)", "Essential hypertension", True),
        ("Gout", "Gout", False),
    ]
    got = normalize.normalize_diagnoses(spark.createDataFrame([(c[0],) for c in cases], "name string")).collect()
    assert {(r.name, r.canonical, r.matched) for r in got} == set(cases)


def test_vitals(spark):
    rows = [("Body weight", "154.3", "lb"), ("BP", "120/80", "mmHg"), ("bp", "high", None), ("hr", "70", None), ("Heart rate", "12d", "/min"), ("Body temperature", "98.6", "°F"), ("pulse", "60", None), ("Body height", "70", "parsec"), ("bp", "120", "mmHg"), ("bp", " 130/85 ", None)]
    got = {(r.name, r.value_text, r.value_num, r.unit, r.matched) for r in normalize.normalize_vitals(spark.createDataFrame(rows, "name string, value string, unit string")).collect()}
    assert got == {
        ("Body weight", None, 70.0, "kg", True), ("Blood pressure", "120/80", None, "mm[Hg]", True), ("bp", "high", None, None, False),
        ("Heart rate", None, 70.0, "/min", True), ("Heart rate", "12d", None, "/min", False), ("bp", None, 120.0, "mmHg", False), ("Blood pressure", "130/85", None, "mm[Hg]", True), ("Body temperature", None, 37.0, "Cel", True),
        ("pulse", None, 60.0, None, False), ("Body height", None, 70.0, "parsec", False),
    }


def test_dosages(spark):
    full = "Take 5 mg by mouth once daily"
    label = "Amlodipine 5 MG Oral Tablet"
    rows = [("Amlodipine", "5 mg by mouth once daily"), ("amlodipine", "5 MG Oral Tablet, 5mg PO QD"), (label, full), (label, "None"), ("amlodipine", None), ("Unknown", "x")]
    got = [tuple(r) for r in normalize.normalize_dosages(spark.createDataFrame(rows, "name string, dosage string")).select("name", "dosage", "matched").collect()]
    assert sorted(got, key=str) == sorted([(label, full, True)] * 3 + [(label, None, True)] * 2 + [("Unknown", "x", False)], key=str)


def test_spans_are_rewritten_and_dates_shifted(spark):
    text = "Patient: Ana Abel, born 1950-03-04, seen 2024-01-02."
    spans = [(9, 17, "PATIENT_NAME"), (24, 34, "DOB"), (41, 51, "DATE")]
    df = spark.createDataFrame([("p1", text, [dict(zip(("start", "end", "type"), s)) for s in spans])], "id string, text string, spans array<struct<start:int,end:int,type:string>>")
    out = df.select(deid.rewrite_spans(F.col("text"), F.col("spans"), F.col("id")).alias("t")).first().t
    born = date(1950, 3, 4) + timedelta(offset("p1", "dob"))
    seen = date(2024, 1, 2) + timedelta(offset("p1", "visit"))
    assert out == f"Patient: [PATIENT_NAME], born {born}, seen {seen}."


@pytest.fixture(scope="module")
def resources(spark):
    made = generate.as_landing(generate.dataset(spark, 60))
    parsed = made.withColumn("ord", F.xxhash64("value")).select("ord", F.from_json("value", omop.RESOURCE).alias("r")).select("ord", "r.*")
    return checkpointed(parsed)


def test_generated_resources_are_deterministic_and_valid(spark, resources):
    again = generate.as_landing(generate.dataset(spark, 60))
    assert again.exceptAll(generate.as_landing(generate.dataset(spark, 60))).count() == 0
    assert omop.structural_failures(resources).count() == 0
    assert omop.structural_failures(resources.withColumn("birthDate", F.lit(None).cast("string"))).count() == 60


def test_requests_refer_to_a_condition_that_the_drug_treats(resources, spark):
    made = generate.dataset(spark, 30, seed=7)
    dx = {r.id: (r.subject.reference, r.code.coding[1].code) for r in made["Condition"].collect()}
    allowed = {(icd, rx) for icd, rx, _ in V.DX_TO_MED}
    rx = made["MedicationRequest"].collect()
    for r in rx:
        subject, icd = dx[r.reasonReference[0].reference.removeprefix("Condition/")]
        assert subject == r.subject.reference and (icd, r.medicationCodeableConcept.coding[0].code) in allowed
    assert len(rx) == len(dx)
    assert {r.e for r in generate.as_landing(made).select(F.size(structure.resource_errors(F.col("value"))).alias("e")).collect()} == {0}
    unknown = made["Condition"].limit(1).withColumn("code", F.struct(F.transform("code.coding", lambda c: c.withField("code", F.lit("none"))).alias("coding"), F.col("code.text").alias("text")))
    assert generate.medication_requests(unknown).count() == 0


def test_generated_resources_of_few_bytes_are_dealt_to_many_tasks(spark):
    made = clinical._generated(lambda name: spark.range(2 * R.TASK_ROWS + 1).coalesce(1).withColumnRenamed("id", "c_custkey"))
    assert {kind: df.rdd.getNumPartitions() for kind, df in made.items()} == dict.fromkeys(made, 3)
    assert made["Patient"].count() == 2 * R.TASK_ROWS + 1


def test_weighted_samples_by_running_sums(spark):
    weights = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", 0.0), ("b", "x", 0.333), ("b", "w", 0.333), ("c", "x", 0.0), (None, "x", 1.0)], "k string, v string, weight double")
    lists = generate.choice_lists(weights, "k", "v")
    facts = spark.createDataFrame([("a", 0.0), ("a", 0.24), ("a", 0.25), ("a", 0.999), ("b", 0.49), ("b", 0.5), ("b", 1.0), ("c", 0.1), ("d", 0.1), (None, 0.1)], "k string, u double")
    got = sorted(tuple(r) for r in generate.sampled(facts, lists, "k", "v", F.col("u")).collect())
    assert got == [("a", 0.0, "x"), ("a", 0.24, "x"), ("a", 0.25, "y"), ("a", 0.999, "y"), ("b", 0.49, "w"), ("b", 0.5, "x"), ("b", 1.0, "x")]
    assert generate.sampled(facts, generate.choice_lists(weights.limit(0), "k", "v"), "k", "v", F.col("u")).count() == 0


def test_a_table_is_made_without_numbering_the_others(resources):
    for name, expected in {"person": ["person_id"], "drug_exposure": ["person_id", "drug_exposure_id"], "observation_period": ["person_id", "observation_period_id"]}.items():
        numbered = []

        def number(df, order, key):
            numbered.append(key)
            return R.numbered(df, order, key, checkpointed)

        alone = omop.fhir_to_omop(resources, number, (name,))[name]
        assert numbered == expected
        assert sorted(alone.collect()) == sorted(omop.fhir_to_omop(resources, lambda *a: R.numbered(*a, checkpointed))[name].collect())


def test_numbers_of_one_store_and_no_second_shuffle(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = R.numbered(df, ["k"], "n", checkpointed)
    assert sorted(map(tuple, got.collect())) == [(i, i + 1) for i in range(1000)]
    assert "hashpartitioning(_part" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert R.numbered(df.limit(0), ["k"], "n", checkpointed).count() == 0


@pytest.mark.parametrize("name", ["_part", "_place", "_before", "_id", "_n"])
def test_a_number_may_have_the_name_of_what_it_is_made_of(spark, name):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), F.lit("x").alias("v"))
    got = R.numbered(df, ["k"], name, checkpointed)
    assert got.columns == ["k", "v", name]
    assert sorted(map(tuple, got.collect())) == [(i, "x", i + 1) for i in range(100)]


def test_build_splits_keeps_copies_with_their_patient(spark):
    """Sizes 3, 2, 2 and 1 of 8 records; the synthesized one has no part."""
    rows = [(1, "a", None, None), (2, "b", None, False), (3, "a-dup1", "a", False), (4, "c", None, True), (5, "b-dup1", "b", False), (6, "a", None, False), (7, "d", None, False), (8, "e", None, False), (9, "e-dup1", "e", False)]
    records = spark.createDataFrame(rows, "o int, patient_id string, rebalance_duplicate_of string, synthesized boolean")
    got = {r.o: r.split for r in dataset.build_splits(records, "o", checkpointed, [("x", 0.5), ("y", 0.5)]).collect()}
    assert got == {1: "x", 3: "x", 6: "x", 2: "y", 5: "y", 8: "y", 9: "y", 7: "x"}


def test_star_schema(spark, resources):
    number = lambda df, order, name: R.numbered(df, order, name, checkpointed)
    tables = omop.fhir_to_omop(resources, number)
    kinds = {r.resourceType: r["count"] for r in resources.groupBy("resourceType").count().collect()}
    assert tables["person"].count() == 60
    assert sorted(r.person_id for r in tables["person"].collect()) == list(range(1, 61))
    assert tables["condition_occurrence"].count() == kinds["Condition"]
    assert tables["drug_exposure"].count() == kinds["MedicationRequest"]
    assert tables["measurement"].count() == kinds["Observation"] + 60  # each panel gives two rows
    assert tables["measurement"].where("unit_concept_id = 0 and unit_source_value <> '[lb_av]'").count() == 0
    assert tables["observation_period"].where("observation_period_start_date > observation_period_end_date").count() == 0
    report = {r.system: r for r in omop.binding_report(omop.codings(resources), omop.known_codes(spark)).collect()}
    assert report[omop.ICD10].pct == 100 and report[omop.UCUM].matched < report[omop.UCUM].total
    bad = resources.withColumn("code", F.when(F.col("resourceType") == "Condition", F.lit(None).cast(resources.schema["code"].dataType)).otherwise(F.col("code")))
    assert omop.fhir_to_omop(bad, number)["condition_occurrence"].where("condition_concept_id <> 0").count() == 0


def test_redaction_leaves_no_identifier(resources):
    people = resources.where("resourceType = 'Patient'")
    redacted = deid.redact_patients(people)
    assert "name" not in redacted.columns
    identifiers = people.select(F.col("id").alias("p"), F.explode("identifier.value").alias("value"))
    said = redacted.select(F.col("id").alias("p"), F.to_json(F.struct("identifier", "address")).alias("text"))
    assert deid.leaked_identifiers(identifiers, said, "p").count() == 0
    raw = people.select(F.col("id").alias("p"), F.to_json(F.struct("identifier")).alias("text"))
    assert deid.leaked_identifiers(identifiers, raw, "p").count() == identifiers.count() > 0


def test_planted_quality_faults(spark):
    rows = [("a", 0.5, 70.0), ("b", 1.5, 70.0), ("c", 0.5, 999.0), ("d", 0.5, float("nan")), ("a", 0.1, 60.0)]
    df = spark.createDataFrame(rows, "id string, confidence double, hr double")
    found = quality_gate.rule_failures(df, "id", [quality_gate.in_range("confidence", 0, 1), quality_gate.in_range("hr", 30, 220), quality_gate.not_null("id")])
    assert sorted((r.column, r.row_key) for r in found.collect()) == [("confidence", "b"), ("hr", "c"), ("hr", "d")]
    assert [r.row_key for r in quality_gate.duplicate_keys(df, "id").collect()] == ["a"]


def test_promotion_only_on_pass(spark, tmp_path):
    staging, final = f"{tmp_path}/staging", f"{tmp_path}/final"
    gate = lambda df: df.where("id > 10")
    assert io.stage_then_promote(spark.range(5), gate, staging, final).count() == 5
    with pytest.raises(io.GateFailed):
        io.stage_then_promote(spark.range(20), gate, staging, final)
    assert spark.read.parquet(final).count() == 5 and spark.read.parquet(staging).count() == 20


def test_compressed_landing_is_read_back_and_settings_stay(spark, tmp_path):
    key, path = "spark.sql.maxConcurrentOutputFileWriters", str(tmp_path / "landing")
    before, rows = spark.conf.get(key), [("A", '{"resourceType": "A", "id": "1"}'), ("B", '{"resourceType": "B", "id": "2"}'), ("A", '{"resourceType": "A", "id": "3"}'), ("A", "no JSON")]
    io.write_landing(spark.createDataFrame(rows, "resourceType string, value string"), path, "snappy")
    assert spark.conf.get(key) == before
    of = lambda kind: io.parsed(io.read_landing(spark, f"{path}/resourceType={kind}", "*.snappy"), "resourceType string, id string", kind)
    assert {kind: sorted(r.id for r in of(kind).collect()) for kind in "AB"} == {"A": ["1", "3"], "B": ["2"]}


def test_landing_round_trip_and_stream(spark, tmp_path):
    made = generate.as_landing(generate.dataset(spark, 5))
    counts = {r.resourceType: r.n for r in io.write_landing(made, f"{tmp_path}/by-type").collect()}
    assert counts["Patient"] == 5 and spark.read.text(f"{tmp_path}/by-type").count() == sum(counts.values())
    lines = [r.value for r in made.where("resourceType = 'Patient'").collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text("\n".join([*lines, "", lines[0]]))
    parsed = io.parsed(io.read_landing(spark, f"{tmp_path}/in"), omop.RESOURCE, "Patient")
    assert parsed.count() == 6
    stream = landing.deduplicated(landing.landing_stream(spark, f"{tmp_path}/in", omop.RESOURCE), ["resourceType", "id"])
    run = landing.gated_sink(stream, lambda b: b.where("id is null"), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/checkpoint")
    run.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 5


def test_cache_first(spark, tmp_path):
    requests = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "key string, text string")
    io.cache_put(spark.createDataFrame([("a", "old")], "key string, value string"), f"{tmp_path}/cache")
    cache = io.cache_get(spark, f"{tmp_path}/cache")
    with pytest.raises(LookupError):
        external.cache_first(requests, cache, None)
    got = external.cache_first(requests, cache, lambda: str.upper).collect()
    assert sorted((r.key, r.value) for r in got) == [("a", "old"), ("b", "Y"), ("b", "Y")]


def test_retries_stop_on_other_errors():
    calls = []

    def fail(message):
        calls.append(message)
        raise RuntimeError(message)

    for message, n in (("rate_limit", 5), ("error 502", 5), ("bad request", 1)):
        calls.clear()
        with pytest.raises(RuntimeError):
            external.with_retries(fail, message, sleep=lambda s: None)
        assert len(calls) == n


def test_scores_and_gate(spark):
    truth = spark.createDataFrame([(1, "dx0"), (1, "dx1")], "r int, c string")
    predicted = spark.createDataFrame([(1, "dx0"), (1, "dx2"), (1, "dx2")], "r int, c string")
    whole = evaluate.overall(evaluate.score_pairs(truth, predicted, "r", "c")).first()
    assert (whole.tp, whole.fp, whole.fn) == (1, 1, 1)
    bounds = spark.createDataFrame(V.RELEASE_THRESHOLDS, "check string, direction string, bound double")
    none = spark.createDataFrame([], "check string, value double")
    assert evaluate.release_gate(none, bounds).where("passed").count() == 0
    kinds = spark.createDataFrame([("a", "a"), (None, None), ("a", "b"), ("a", None), (None, "b")], "e string, g string")
    assert [r.k for r in kinds.select(evaluate.match_kind(F.col("e"), F.col("g")).alias("k")).collect()] == ["exact", "exact", "wrong", "missing", "hallucinated"]


def test_strict_lookup_fails_on_unknown_codes(spark):
    dim = spark.createDataFrame([("a", 1)], "code string, id int")
    facts = spark.createDataFrame([("a",), ("zz",)], "code string")
    with pytest.raises(Exception, match="no id for code zz"):
        R.strict_lookup(facts, dim, "code", "id").collect()


def test_provenance(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(b"{}")
    rows = lineage.provenance(spark, [("one", f"{tmp_path}/x.json"), ("two", f"{tmp_path}/missing.json")]).collect()
    assert [(r.stage, r.artifact, r.sha256, r.n_bytes) for r in rows] == [("one", "x.json", hashlib.sha256(b"{}").hexdigest(), 2)]


def test_notes_record_their_spans(spark):
    rows = spark.createDataFrame([(1, "Ana", "1950-01-01")], "id int, name string, born string")
    note = generate.render_notes(rows, "id", [(None, F.lit("Patient: ")), ("PATIENT_NAME", F.col("name")), (None, F.lit(" ")), ("DOB", F.col("born"))]).first()
    assert note.text == "Patient: Ana 1950-01-01"
    assert all(note.text[s.start : s.end] == s.text for s in note.spans) and [s.type for s in note.spans] == ["PATIENT_NAME", "DOB"]


def test_names_outside_the_vocabulary_are_counted_apart(spark):
    truth = spark.createDataFrame([(1, "dx0"), (1, "dx1"), (1, "not known")], "r int, c string")
    predicted = spark.createDataFrame([(1, "dx0"), (1, "dx2"), (1, "made up"), (2, "made up"), (2, "also")], "r int, c string")
    canon = spark.createDataFrame([(f"dx{i}",) for i in range(4)], "c string")
    by = {r.c: (r.tp, r.fp, r.fn) for r in evaluate.score_vocabulary(truth, predicted, canon, "r", "c").collect()}
    assert by == {"dx0": (1, 0, 0), "dx1": (0, 0, 1), "dx2": (0, 1, 0), "dx3": (0, 0, 0)}
    whole = evaluate.score_summary(truth, predicted, canon, "r", "c").first()
    assert (whole.tp, whole.fp, whole.fn, whole.non_canonical_count, whole.non_canonical_examples) == (1, 1, 1, 3, ["also", "made up"])
    nothing = evaluate.score_summary(truth, predicted.limit(0), canon, "r", "c").first()
    assert (nothing.tp, nothing.fn, nothing.micro_f1, nothing.non_canonical_count) == (0, 2, 0.0, 0)


def test_outputs_of_odd_types(spark):
    texts = ['{"d": [{"name": "a"}, {"name": 3}, "x", {"n": 1}, {"name": "b"}]}', '{"d": "a"}', "[1]", "{", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, output string")
    assert [(r.i, r.n) for r in evaluate.predicted_names(df, "i", "output", "d", "n").collect()] == [(0, "a"), (0, "b")]
    assert tuple(evaluate.validity(df, "output").first()) == (3, 6, 0.5)
    assert [r.example_index for r in evaluate.failure_examples(df, "i", "output").collect()] == [2, 3, 4]


def test_errors_are_transient_by_class_or_message():
    class APIConnectionError(Exception):
        pass

    assert external.is_transient(APIConnectionError("x")) and external.is_transient(TimeoutError()) and external.is_transient(ValueError("HTTP 500"))
    assert not external.is_transient(ValueError("400"))


def test_planted_faults_in_records(spark):
    vital = lambda **x: {"name": None, "value": None, "value_num": None, "unit": None} | x
    good = [vital(name="Heart rate", value_num=70.0, unit="/min"), vital(name="Blood pressure", value="120/80", unit="mm[Hg]")]
    bad = [vital(name="Heart rate", value_num=999.0, unit="/min"), vital(name="Blood pressure", value="high")]
    rows = [
        ("a", "n1", 0.5, [("Obesity",)], [("Amlodipine 5 MG Oral Tablet", None)], good),
        ("b", "n2", 1.5, [("Gout",)], [], bad),
        ("b", "n3", 0.1, [], [("Aspirin", "x")], []),
    ]
    schema = "patient_id string, note_id string, confidence double, diagnoses array<struct<name:string>>, medications array<struct<name:string,dosage:string>>, vitals array<struct<name:string,value:string,value_num:double,unit:string>>"
    records = spark.createDataFrame(rows, schema)
    got = {r.table: (r.rows, r.n_failures, r.passed) for r in quality_gate.validate_records(records).collect()}
    assert got == {"records": (3, 3, False), "diagnoses": (2, 1, False), "medications": (2, 1, False), "numeric_vitals": (2, 1, False), "blood_pressure": (2, 1, False)}
    assert {r.passed for r in quality_gate.validate_records(records.where("note_id = 'n1'")).collect()} == {True}
    assert {r.passed for r in quality_gate.validate_records(records.limit(0)).collect()} == {True}
    wrong = quality_gate.type_failures(records.select(F.lit(1).alias("note_id")), {"note_id": "string", "name": "string"})
    assert sorted((r.column, r.failure_case) for r in wrong.collect()) == [("name", "missing"), ("note_id", "int")]
    assert deid.assert_no_phi(records).count() == 3
    with pytest.raises(ValueError, match="personal data"):
        deid.assert_no_phi(records.withColumn("diagnoses", F.array(F.struct(F.lit("Migraine, diagnosed 2017-07-17").alias("name")))))


def test_report_shows_a_bounded_number_of_cases(spark):
    failures = spark.range(500).select(F.lit("c").alias("check"), F.lit("x").alias("column"), F.lpad(F.col("id").cast("string"), 3, "0").alias("failure_case"))
    row = quality_gate.report(failures).first()
    assert row.n_failures == 500 and row.examples == [f"{i:03d}" for i in range(25)]


def test_promotion_reports_and_recovers(spark, tmp_path):
    staging, final, report = (f"{tmp_path}/{n}" for n in ("staging", "final", "report.json"))
    gate = lambda df: df.where("id > 10")
    io.stage_then_promote(spark.range(5), gate, staging, final, report)
    assert json.load(open(report)) == {"passed": True, "n_failures": 0, "first": []}
    with pytest.raises(io.GateFailed):
        io.stage_then_promote(spark.range(20), gate, staging, final, report)
    assert json.load(open(report))["n_failures"] == 9 and spark.read.parquet(final).count() == 5
    os.rename(final, f"{final}.last-good")  # as a run leaves it that ends between both renames
    with pytest.raises(io.GateFailed):
        io.stage_then_promote(spark.range(20), gate, staging, final, report)
    assert spark.read.parquet(final).count() == 5 and not os.path.exists(f"{final}.last-good")
    assert io.stage_then_promote(spark.range(7), gate, staging, final, report).count() == 7


def test_record_counts_and_lineage(spark, tmp_path):
    for name, text in {"a.jsonl": '{"x":1}\n\n{"x":2}\n', "b.csv": "h\n1\n2\n3\n", "c.json": "[1, 2]", "d.json": "{}", "e.bin": "x"}.items():
        (tmp_path / name).write_text(text)
    rows = lineage.provenance(spark, [("s", f"{tmp_path}/{n}") for n in ("a.jsonl", "b.csv", "c.json", "d.json", "e.bin", "none.json")]).collect()
    assert {r.artifact: r.record_count for r in rows} == {"a.jsonl": 2, "b.csv": 3, "c.json": 2, "d.json": None, "e.bin": None}
    manifest = spark.createDataFrame([("v1",)], "version string")
    row = lineage.data_lineage(spark, {"train": f"{tmp_path}/a.jsonl", "val": f"{tmp_path}/none.json"}, manifest).first()
    assert row.data_lineage == {"train_sha256": hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest(), "gold_version": "v1"}
    registry = spark.createDataFrame([("v1", "b", 0.5)], "version string, base_model string, loss double")
    after = lineage.register_run(registry, spark.createDataFrame([("c", 0.25)], "base_model string, loss double"))
    assert sorted(map(tuple, after.select("version", "base_model", "loss").collect())) == [("v1", "b", 0.5), ("v2", "c", 0.25)]


def greedy(sizes, fractions):
    """Plain greedy assignment, largest first, first seen first. sizes: list of n in order of appearance."""
    total, counts, out = sum(sizes), [0] * len(fractions), {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        pick = max(range(len(fractions)), key=lambda s: total * fractions[s] - counts[s])
        counts[pick] += sizes[i]
        out[i] = pick
    return out


@pytest.mark.parametrize("splits", [V.SPLITS, [("a", 0.5), ("b", 0.5)], [("a", 0.4), ("b", 0.3), ("c", 0.2), ("d", 0.1)]])
def test_split_equals_the_plain_greedy_rule(spark, splits):
    rng = random.Random(len(splits))
    sizes = [rng.choice([1] * 30 + [2] * 6 + [3, 5, 8, 40]) for _ in range(700)]
    df = spark.createDataFrame([(i, n, i) for i, n in enumerate(sizes)], "g int, n long, first int")
    got = {r.g: r.split for r in dataset.split_groups(df, "g", checkpointed, splits).collect()}
    assert got == {i: splits[s][0] for i, s in greedy(sizes, [f for _, f in splits]).items()}


def test_frozen_digest_is_the_same_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(dataset, "BLOCK", 7)
    rows = spark.range(100).select(F.col("id").alias("o"), F.concat(F.lit("t"), "id").alias("t"))
    one = dataset.frozen(rows, "o", F.col("t"), checkpointed).first()
    assert one == dataset.frozen(rows.repartition(5), "o", F.col("t"), checkpointed).first() and one.n_examples == 100
    level = [hashlib.sha256(f"t{i}".encode()).hexdigest() for i in range(100)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 7]).encode()).hexdigest() for i in range(0, len(level), 7)]
    assert one.sha256 == level[0]
    assert dataset.frozen(rows.limit(0), "o", F.col("t"), checkpointed).first().sha256 == hashlib.sha256(b"").hexdigest()
    manifest = dataset.gold_manifest(rows, "o", F.col("t"), "v1", "test", checkpointed)
    assert dataset.verified(rows, "o", F.col("t"), manifest, checkpointed)
    assert not dataset.verified(rows.where("o <> 5"), "o", F.col("t"), manifest, checkpointed)


def test_tally_of_outputs_says_what_the_scores_of_names_say(spark):
    """Odd outputs, names outside the vocabulary, null names and repeated ones; and nothing at all."""
    said = [("a", ["A", "B", "x", None]), ("b", []), ("c", ["A"]), ("d", None), ("e", ["C", "C"]), ("f", ["B"]), ("g", ["A"])]
    outputs = {
        "a": ' \n{"d": [{"name": "A"}, {"name": "A"}, {"name": "odd"}, {"name": "odd"}, {"name": 3}, "x", {"n": 1}, {"name": null}], "m": [{"name": "A"}]}',
        "b": '{"d": [{"name": "B"}, {"name": "strange"}]}', "c": '["A"]', "d": '{"d": "A", "m": {}}', "e": '{"d": [{"name": "C"}]', "f": "{}", "g": None,
    }
    schema = "i string, d array<struct<name:string>>, m array<struct<name:string>>, output string"
    lists = lambda names: None if names is None else [(n,) for n in names]
    records = spark.createDataFrame([(i, lists(names), [("A",)], outputs[i]) for i, names in said], schema)
    canon = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    for df in (records, records.limit(0)):
        tally = evaluate.output_tally(df, "output", ["d", "m"], "name")
        assert tuple(evaluate.tally_validity(tally).first()) == tuple(evaluate.validity(df, "output").first())
        for f in "dm":
            truth = df.where(evaluate.json_object(F.col("output"))).select("i", F.explode(f"{f}.name").alias("name"))
            expected = evaluate.score_summary(truth, evaluate.predicted_names(df, "i", "output", f, "name"), canon, "i", "name").first().asDict()
            assert evaluate.tally_summary(tally.where(F.col("field") == f), canon, "name").first().asDict() == expected
    assert evaluate.tally_summary(evaluate.output_tally(records, "output", ["d", "m"], "name").where("field = 'd'"), canon, "name").first()["tp"] == 1


def test_records_are_gathered_without_their_texts(spark, small):
    """The rows that are shuffled for records hold places in the lists: their size isn't that of what is said."""
    table = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    above, _, below = clinical.extractions(table)._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate [l_orderkey")
    assert "Amlodipine" in above and below and "Amlodipine" not in below


def test_unmatched_report_counts_what_records_have_unmatched(spark):
    """Null mentions, null lists and equal texts of different fields; each distinct mention is normalized once, after it is counted."""
    d, m, v = [("Gout",), ("GERD",), (None,), ("Gout",), ("Obesity",), None], [("Gout", "1"), ("Gout", None), ("Gout", "1"), (None, "it's"), None], [("Gout", "1", None), ("hr", "70", None), ("bp", "x", "1"), (None, None, None), ("bp", "x", "1"), None]
    schema = "i int, diagnoses array<struct<name:string>>, medications array<struct<name:string,dosage:string>>, vitals array<struct<name:string,value:string,unit:string>>"
    records = spark.createDataFrame([(1, d, m, v), (2, None, None, None), (3, [], [], []), (4, d, None, v[:2])], schema)
    expected = normalize.normalize_records(records).select(F.inline("unmatched")).groupBy("field_type", "detail").agg(F.count("*").alias("n"))
    report = normalize.unmatched_report(records)
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, expected.collect())) != []
    assert report.schema.simpleString() == expected.schema.simpleString() and normalize.unmatched_report(records.limit(0)).count() == 0


def test_fields_of_outputs_are_what_names_of_each_are(spark):
    texts = ['{"d": [{"name": "a"}, {"name": 3}, "x", {"n": 1}, {"name": "b"}, {"name": "b"}], "m": [{"name": "c"}]}', '{"d": "a", "m": [{"name": ""}]}', '[{"name": "a"}]', "{", None, "{}", '{"m": [{"name": "\\u00e9"}], "d": null}', "\t{} x", '"{}"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, output string")
    one = lambda f: evaluate.predicted_names(df, "i", "output", f, "n").select("i", F.lit(f).alias("field"), "n")
    got = sorted(map(tuple, evaluate.predicted_fields(df, "i", "output", ["d", "m"], "n").collect()))
    assert got == sorted(map(tuple, one("d").union(one("m")).collect()))
    assert got == [(0, "d", "a"), (0, "d", "b"), (0, "d", "b"), (0, "m", "c"), (1, "m", ""), (6, "m", "é")]
    old = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("output")), F.lit("OBJECT")), F.lit(False))
    assert df.where(~evaluate.json_object(F.col("output")).eqNullSafe(old)).count() == 0


def test_output_names_stores_nothing(spark, small, monkeypatch):
    """Its outputs are parsed as they come: no table of them is written to be read twice."""

    def fail(df):
        raise AssertionError("stored")

    monkeypatch.setattr(clinical, "checkpointed", fail)
    plan = clinical.output_names(lambda name: spark.read.parquet(f"{small}/{name}.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_formatted_records_join_texts_not_lists(spark):
    """The response is made before notes are joined, so that a shuffle by note carries one text of each record, and what is kept."""
    schema = "note_id string, who int, diagnoses array<struct<name:string>>, medications array<struct<name:string,dosage:string>>, vitals array<struct<name:string>>"
    records = spark.createDataFrame([("a", 1, [("x",)], [("y", None)], []), ("a", 2, None, [], [])], schema)
    made = dataset.format_records(records, spark.createDataFrame([("a", "said")], "note_id string, text string"), "who")
    assert sorted(map(tuple, made.collect())) == [
        (1, "said", '{"diagnoses":[{"name":"x"}],"medications":[{"name":"y","dosage":null}],"vitals":[]}'), (2, "said", '{"diagnoses":null,"medications":[],"vitals":[]}'),
    ]
    above, _, below = made._jdf.queryExecution().analyzed().toString().partition("Join")
    assert "to_json" in below and "to_json" not in above


def test_date_clauses_are_found_behind_the_guard(spark):
    cases = {"x (dx a-b)": "x", "x, DIAGNOSED 2020-01-01 ": "x", "x (DX )": "x", "a-b": "a-b", "(a) b ": "(a) b", "x (dx": "x (dx", "x, diagnosed 2020": "x, diagnosed 2020", "": ""}
    df = spark.createDataFrame([*((c,) for c in cases), (None,)], "n string").select("n", S.without_date_clause(F.col("n")).alias("x"))
    assert {r.n: r.x for r in df.collect()} == {**cases, None: None}
