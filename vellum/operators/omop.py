"""FHIR-like resources to OMOP-shaped tables, and how well codes bind to the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import vocabulary as v
from vellum.functions.scalars import coding, referenced
from vellum.operators.relational import lookup, strict_lookup

ICD10, SNOMED = "http://hl7.org/fhir/sid/icd-10-cm", "http://snomed.info/sct"
RXNORM, LOINC = "http://www.nlm.nih.gov/research/umls/rxnorm", "http://loinc.org"
UCUM = "http://unitsofmeasure.org"

CODING = "array<struct<system:string,code:string,display:string>>"
QUANTITY = "struct<value:double,unit:string,system:string,code:string>"
#: One schema for all four types; fields that a type lacks are null.
RESOURCE = (
    "resourceType string, id string, gender string, birthDate string, subject struct<reference:string>, "
    f"code struct<coding:{CODING},text:string>, onsetDateTime string, effectiveDateTime string, authoredOn string, "
    f"valueQuantity {QUANTITY}, component array<struct<code:struct<coding:{CODING}>,valueQuantity:{QUANTITY}>>, "
    f"medicationCodeableConcept struct<coding:{CODING},text:string>, dosageInstruction array<struct<text:string>>, "
    "identifier array<struct<system:string,value:string>>, name array<struct<family:string,given:array<string>>>, "
    "address array<struct<line:array<string>,city:string,state:string,postalCode:string>>"
)


def of_type(resources: DataFrame, kind: str) -> DataFrame:
    return resources.where(F.col("resourceType") == kind)


def person(resources: DataFrame, number) -> DataFrame:
    """One row for each patient, with patient_id, by which events find it. number(df, order, name) gives surrogate keys from 1.

    The source value is the first identifier, without one the id.
    """
    genders = resources.sparkSession.createDataFrame(v.GENDERS, "gender string, gender_concept_id long")
    rows = lookup(of_type(resources, "Patient"), genders, ["gender"], {"gender_concept_id": 0})
    born = F.to_date("birthDate")
    flat = rows.select(
        "ord",
        "gender_concept_id",
        F.year(born).cast("long").alias("year_of_birth"),
        F.month(born).cast("long").alias("month_of_birth"),
        F.day(born).cast("long").alias("day_of_birth"),
        F.lit(0).cast("long").alias("race_concept_id"),
        F.lit(0).cast("long").alias("ethnicity_concept_id"),
        F.coalesce(F.nullif(F.get("identifier", F.lit(0))["value"], F.lit("")), F.col("id")).alias("person_source_value"),
        F.coalesce("gender", F.lit("")).alias("gender_source_value"),
        F.col("id").alias("patient_id"),
    )
    return number(flat, ["ord"], "person_id")


def events_of(resources: DataFrame, kind: str, people: DataFrame) -> DataFrame:
    """Resources of a type with the number and place of their patient; orphans go."""
    rows = of_type(resources, kind).withColumn("patient_id", referenced(F.col("subject.reference")))
    return rows.join(people.select("patient_id", "person_id"), "patient_id")


def coded_or_none(rows: DataFrame, dim: DataFrame, ids: list[str]) -> DataFrame:
    """rows with the ids of their code; a code that dim lacks is an error, a missing one has ids 0."""
    coded = strict_lookup(rows.where("code is not null"), dim.select("code", ids[0]), "code", ids[0])
    if ids[1:]:
        coded = coded.join(dim.select("code", *ids[1:]), "code")
    return coded.unionByName(rows.where("code is null").withColumns({i: F.lit(0).cast("long") for i in ids}))


def condition_occurrence(resources: DataFrame, people: DataFrame, number) -> DataFrame:
    """An ICD-10 code that the vocabulary lacks is an error; a missing one gives concept 0."""
    rows = events_of(resources, "Condition", people).withColumn("code", coding(F.col("code.coding"), ICD10)["code"])
    flat = coded_or_none(rows, v.conditions(resources.sparkSession), ["standard_id", "source_id"]).select(
        "ord",
        "person_id",
        F.col("standard_id").alias("condition_concept_id"),
        F.col("onsetDateTime").alias("condition_start_date"),
        F.lit(v.EHR_TYPE).cast("long").alias("condition_type_concept_id"),
        F.coalesce("code", F.lit("")).alias("condition_source_value"),
        F.col("source_id").alias("condition_source_concept_id"),
    )
    return number(flat, ["person_id", "ord"], "condition_occurrence_id")


def drug_exposure(resources: DataFrame, people: DataFrame, number) -> DataFrame:
    """An RxNorm code that the vocabulary lacks is an error; a missing one gives concept 0. RxNorm and LOINC are standard
    vocabularies, so source concepts of drugs and measurements are the standard ones."""
    rows = events_of(resources, "MedicationRequest", people)
    rows = rows.withColumn("code", coding(F.col("medicationCodeableConcept.coding"), RXNORM)["code"])
    found = coded_or_none(rows, v.medications(resources.sparkSession).select("code", "standard_id"), ["standard_id"])
    flat = found.select(
        "ord",
        "person_id",
        F.col("standard_id").alias("drug_concept_id"),
        F.col("authoredOn").alias("drug_exposure_start_date"),
        F.lit(v.EHR_TYPE).cast("long").alias("drug_type_concept_id"),
        F.coalesce("code", F.lit("")).alias("drug_source_value"),
        F.col("standard_id").alias("drug_source_concept_id"),
        F.coalesce(F.get("dosageInstruction", F.lit(0))["text"], F.lit("")).alias("sig"),
    )
    return number(flat, ["person_id", "ord"], "drug_exposure_id")


def measurement(resources: DataFrame, people: DataFrame, number) -> DataFrame:
    """One row for each observation, or for each component of a panel. Unknown codes and units give concept 0."""
    one = F.array(F.struct(F.struct(F.col("code.coding").alias("coding")).alias("code"), "valueQuantity"))
    rows = events_of(resources, "Observation", people)
    parts = rows.select("ord", "person_id", "effectiveDateTime", F.posexplode(F.when(F.size("component") > 0, F.col("component")).otherwise(one)).alias("part", "c"))
    coded = parts.withColumns({"code": coding(F.col("c.code.coding"), LOINC)["code"], "unit": F.coalesce(F.col("c.valueQuantity.code"), F.lit(""))})
    found = lookup(coded, v.observations(resources.sparkSession), ["code"], {"standard_id": 0})
    found = lookup(found, v.units(resources.sparkSession), ["unit"], {"unit_id": 0})
    flat = found.select(
        "ord",
        "part",
        "person_id",
        F.col("standard_id").alias("measurement_concept_id"),
        F.col("effectiveDateTime").alias("measurement_date"),
        F.lit(v.EHR_TYPE).cast("long").alias("measurement_type_concept_id"),
        F.col("c.valueQuantity.value").alias("value_as_number"),
        F.col("unit_id").alias("unit_concept_id"),
        F.coalesce("code", F.lit("")).alias("measurement_source_value"),
        F.col("standard_id").alias("measurement_source_concept_id"),
        F.col("unit").alias("unit_source_value"),
    )
    return number(flat, ["person_id", "ord", "part"], "measurement_id")


def observation_period(events: list[DataFrame], key: str, number) -> DataFrame:
    """First and last event date of each person that has one. events: DataFrames of (key, date)."""
    dated = events[0].select(key, "date")
    for more in events[1:]:
        dated = dated.union(more.select(key, "date"))
    spans = dated.where("date is not null").groupBy(key).agg(
        F.min("date").alias("observation_period_start_date"), F.max("date").alias("observation_period_end_date")
    )
    return number(spans.withColumn("period_type_concept_id", F.lit(v.EHR_TYPE).cast("long")), [key], "observation_period_id")


#: The tables of events, each with its date.
EVENTS = {
    "condition_occurrence": (condition_occurrence, "condition_start_date"),
    "drug_exposure": (drug_exposure, "drug_exposure_start_date"),
    "measurement": (measurement, "measurement_date"),
}
TABLES = ("person", *EVENTS, "observation_period")


def fhir_to_omop(resources: DataFrame, number, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """All five tables, or those named; nothing else is numbered, and so nothing else is stored. resources: ord and the columns of RESOURCE."""
    people = person(resources, number)
    found = {"person": people.drop("patient_id")} | {name: EVENTS[name][0](resources, people, number) for name in EVENTS if name in names}
    if "observation_period" in names:
        table = lambda name: found[name] if name in found else EVENTS[name][0](resources, people, lambda df, order, key: df)
        dates = [table(name).select("person_id", F.col(date).alias("date")) for name, (_, date) in EVENTS.items()]
        found["observation_period"] = observation_period(dates, "person_id", number)
    return {name: found[name] for name in names}


def codings(resources: DataFrame) -> DataFrame:
    """system, code: every coding of every resource, panels' components and units included."""
    unit = lambda q: F.array(F.struct(q["system"].alias("system"), q["code"].alias("code")))
    pair = lambda a: F.transform(a, lambda c: F.struct(c["system"].alias("system"), c["code"].alias("code")))
    none = F.array().cast("array<struct<system:string,code:string>>")
    parts = F.coalesce(F.flatten(F.transform("component", lambda c: F.concat(pair(c["code"]["coding"]), unit(c["valueQuantity"])))), none)
    own = [F.coalesce(pair(F.col(c)), none) for c in ("code.coding", "medicationCodeableConcept.coding")]
    every = F.concat(*own, parts, F.when(F.col("valueQuantity").isNotNull(), unit(F.col("valueQuantity"))).otherwise(none))
    return resources.select(F.explode(every).alias("c")).select("c.system", "c.code").where("code is not null")


def known_codes(spark: SparkSession) -> DataFrame:
    """system, code: what the vocabulary maps."""
    rows = [(ICD10, c[0]) for c in v.CONDITIONS] + [(SNOMED, c[2]) for c in v.CONDITIONS]
    rows += [(RXNORM, m[0]) for m in v.MEDICATIONS] + [(LOINC, o[0]) for o in v.OBSERVATIONS] + [(UCUM, u) for u, i in v.UNITS if i]
    return spark.createDataFrame(rows, "system string, code string")


def binding_report(codes: DataFrame, known: DataFrame, group: str = "system") -> DataFrame:
    """total, matched and pct of each group, and of all (group null). codes: group, code; known: group, code."""
    flagged = codes.join(known.distinct().withColumn("_known", F.lit(1)), [group, "code"], "left")
    counts = flagged.rollup(group).agg(F.count("*").alias("total"), F.count("_known").alias("matched"))
    return counts.withColumn("pct", F.round(100 * F.col("matched") / F.col("total"), 2))


def coverage(concepts: DataFrame, section: str, mapped: str) -> DataFrame:
    """total and mapped of each section of a vocabulary; concept 0 is unmapped."""
    return concepts.groupBy(section).agg(F.count("*").alias("total"), F.count_if(F.col(mapped) != 0).alias("mapped"))


def read_concepts(spark: SparkSession, path: str, section: str) -> DataFrame:
    """Concepts of a section of a vocabulary document: source and standard code, name, vocabulary and id; no id is 0.

    The document maps each section's source codes to {source, standard}, each with concept_id, concept_code, concept_name and
    vocabulary_id, or null.
    """
    side = "struct<concept_id:bigint,concept_code:string,concept_name:string,vocabulary_id:string,domain_id:string>"
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.from_json("value", f"`{section}` map<string,struct<source:{side},standard:{side}>>")[section].alias("e"))
    each = entries.select(F.explode("e").alias("source_code", "c"))
    field = lambda s, name: F.coalesce(F.col(f"c.{s}.{name}"), F.lit(0 if name == "concept_id" else ""))
    return each.select(
        "source_code",
        field("source", "concept_name").alias("source_name"),
        field("source", "vocabulary_id").alias("source_vocabulary"),
        field("source", "concept_id").alias("source_concept_id"),
        field("standard", "concept_code").alias("standard_code"),
        field("standard", "concept_name").alias("standard_name"),
        field("standard", "vocabulary_id").alias("standard_vocabulary"),
        field("standard", "concept_id").alias("standard_concept_id"),
        F.coalesce(F.nullif(field("standard", "domain_id"), F.lit("")), field("source", "domain_id")).alias("domain"),
    )


def concept_name() -> Column:
    """The standard name of a concept of read_concepts(), or its source name."""
    return F.coalesce(F.nullif(F.col("standard_name"), F.lit("")), "source_name")


def validity_by_type(resources: DataFrame) -> DataFrame:
    """total, valid of each resource type, and of all (resourceType null)."""
    bad = structural_failures(resources).select("resourceType", "id").distinct().withColumn("_bad", F.lit(1))
    flagged = resources.select("resourceType", "id").join(bad, ["resourceType", "id"], "left")
    return flagged.rollup("resourceType").agg(F.count("*").alias("total"), F.count_if(F.col("_bad").isNull()).alias("valid"))


def structural_failures(resources: DataFrame) -> DataFrame:
    """Resources that lack what their type needs: resourceType, id, field."""
    needs = {"Patient": ["birthDate"], "Condition": ["code", "subject"], "Observation": ["code", "subject"], "MedicationRequest": ["medicationCodeableConcept", "subject"]}
    lacking = F.array(
        F.when(F.col("id").isNull(), F.lit("id")),
        F.when(~F.col("resourceType").isin(list(needs)), F.lit("resourceType")),
        *(F.when((F.col("resourceType") == kind) & F.col(f).isNull(), F.lit(f)) for kind, fields in needs.items() for f in fields),
    )
    return resources.select("resourceType", "id", F.explode(F.array_compact(lacking)).alias("field"))
