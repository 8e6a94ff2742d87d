"""Seeded synthetic resources: rows are functions of (seed, number), so that a run on any cluster gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import vocabulary as v
from vellum.functions.scalars import coding
from vellum.operators.omop import ICD10, LOINC, RXNORM, SNOMED, UCUM


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def chosen(values: list, u: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int"))


def choice_lists(weights: DataFrame, on: str, value: str) -> DataFrame:
    """on, options: the values that weights (on, value, weight) lists for each key, in their order, with running sums of their weights."""
    upto = F.sum("weight").over(Window.partitionBy(on).orderBy(value))
    option = F.struct(F.col(value).alias("value"), upto.cast("double").alias("upto"))
    return weights.where("weight > 0").select(on, option.alias("option")).groupBy(on).agg(F.sort_array(F.collect_list("option")).alias("options"))


def sampled(facts: DataFrame, lists: DataFrame, on: str, value: str, u: Column) -> DataFrame:
    """facts with value: one that lists (of choice_lists) has for the fact's key, by weight, at u in [0, 1); facts whose key has none go.

    A fact meets one row, however many values its key has. Weights needn't add up to 1.
    """
    met = facts.join(lists.withColumnRenamed("options", "_options"), on)
    place = u * F.element_at("_options", -1)["upto"]
    found = F.get(F.filter("_options", lambda o: o["upto"] > place), F.lit(0))["value"]
    return met.withColumn(value, F.coalesce(found, F.element_at("_options", -1)["value"])).drop("_options")


def unless(u: Column, p: float, value: Column) -> Column:
    """value, missing with probability p."""
    return F.when(u >= p, value)


def profile(name: str) -> Column:
    return F.struct(F.array(F.lit(f"http://hl7.org/fhir/us/core/StructureDefinition/us-core-{name}")).alias("profile"))


def status(system: str, code: str) -> Column:
    return F.struct(F.array(F.struct(F.lit(f"http://terminology.hl7.org/CodeSystem/{system}").alias("system"), F.lit(code).alias("code"))).alias("coding"))


def patients(spark: SparkSession, n: int, seed: int = 42, messy: bool = True) -> DataFrame:
    return patients_of(spark.range(n).withColumnRenamed("id", "n"), seed, messy)


def patients_of(numbers: DataFrame, seed: int = 42, messy: bool = True) -> DataFrame:
    """A patient for each number n. A messy one lacks its gender, identifier or address at times."""
    i, p = F.col("n"), 0.15 if messy else 0.0
    u = lambda salt: uniform(seed, salt, i)
    given, family = chosen(["Ana", "Ben", "Cora", "Dan", "Eva", "Finn"], u("given")), chosen(["Abel", "Bond", "Cruz", "Dorn", "Ek"], u("family"))
    address = F.array(F.struct(F.array(F.lit("1 Main St")).alias("line"), F.lit("Springfield").alias("city"), F.lit("IL").alias("state"), F.format_string("%05d", F.floor(u("zip") * 100000)).alias("postalCode")))
    return numbers.select(
        F.lit("Patient").alias("resourceType"),
        F.format_string("p%07d", "n").alias("id"),
        profile("patient").alias("meta"),
        unless(u("m1"), p, chosen(["male", "female"], u("gender"))).alias("gender"),
        F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), F.floor(u("born") * 22000).cast("int")), "yyyy-MM-dd").alias("birthDate"),
        unless(u("m2"), p, F.array(F.struct(F.lit("urn:mrn").alias("system"), F.format_string("MRN%06d", "n").alias("value")))).alias("identifier"),
        F.array(F.struct(family.alias("family"), F.array(given).alias("given"))).alias("name"),
        unless(u("m3"), p, address).alias("address"),
    )


def conditions(people: DataFrame, seed: int = 42, messy: bool = True) -> DataFrame:
    """One to three conditions of each patient; messy ones lack their clinical status at times."""
    count = (F.floor(uniform(seed, "n_dx", F.col("id")) * 3) + 1).cast("int")
    rows = people.select(F.col("id").alias("pid"), F.explode(F.sequence(F.lit(1), count)).alias("k"))
    u = lambda salt: uniform(seed, salt, F.col("pid"), F.col("k"))
    pick = F.get(F.array(*(F.struct(F.lit(c[0]).alias("icd"), F.lit(c[2]).alias("snomed"), F.lit(c[1]).alias("text")) for c in v.CONDITIONS)), F.floor(u("dx") * len(v.CONDITIONS)).cast("int"))
    code = lambda system, c: F.struct(F.lit(system).alias("system"), c.alias("code"), F.lit(None).cast("string").alias("display"))
    return rows.withColumn("c", pick).select(
        F.lit("Condition").alias("resourceType"),
        F.concat_ws("-", "pid", F.lit("c"), "k").alias("id"),
        profile("condition-problems-health-concerns").alias("meta"),
        unless(u("m"), 0.2 if messy else 0.0, status("condition-clinical", "active")).alias("clinicalStatus"),
        status("condition-ver-status", "confirmed").alias("verificationStatus"),
        F.struct(F.concat(F.lit("Patient/"), "pid").alias("reference")).alias("subject"),
        F.struct(F.array(code(SNOMED, F.col("c.snomed")), code(ICD10, F.col("c.icd"))).alias("coding"), F.col("c.text").alias("text")).alias("code"),
        F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), F.floor(u("onset") * 3600).cast("int")), "yyyy-MM-dd").alias("onsetDateTime"),
    )


def observations(people: DataFrame, seed: int = 42, messy: bool = True) -> DataFrame:
    """A blood pressure panel and one to four simple observations of each patient, some in other units."""
    simple = [o for o in v.OBSERVATIONS if o[5] is not None]
    count = (F.floor(uniform(seed, "n_obs", F.col("id")) * 4) + 1).cast("int")
    rows = people.select(F.col("id").alias("pid"), F.explode(F.sequence(F.lit(0), count)).alias("k"))
    u = lambda salt: uniform(seed, salt, F.col("pid"), F.col("k"))
    spec = F.get(F.array(*(F.struct(F.lit(o[0]).alias("code"), F.lit(o[3]).alias("unit"), F.lit(o[4]).alias("other"), F.lit(o[5]).alias("least"), F.lit(o[6]).alias("most")) for o in simple)), F.floor(u("obs") * len(simple)).cast("int"))
    quantity = lambda value, unit: F.struct(value.cast("double").alias("value"), unit.alias("unit"), F.lit(UCUM).alias("system"), unit.alias("code"))
    coded = lambda c: F.struct(F.array(F.struct(F.lit(LOINC).alias("system"), c.alias("code"), F.lit(None).cast("string").alias("display"))).alias("coding"), F.lit(None).cast("string").alias("text"))
    part = lambda c, value: F.struct(F.struct(coded(F.lit(c))["coding"].alias("coding")).alias("code"), quantity(value, F.lit("mm[Hg]")).alias("valueQuantity"))
    value = F.round(F.col("s.least") + (F.col("s.most") - F.col("s.least")) * (0.2 + 0.3 * u("value")), 1)
    swap = F.col("s.other").isNotNull() & (u("unit") < (0.4 if messy else 0.0))
    other = F.when(F.col("s.other") == "[degF]", F.round(value * 9 / 5 + 32, 1)).when(F.col("s.other") == "[lb_av]", F.round(value * 2.20462, 1)).otherwise(F.round(value / 2.54, 1))
    panel = F.array(part("8480-6", F.round(100 + 40 * u("sys"))), part("8462-4", F.round(60 + 30 * u("dia"))))
    first = F.col("k") == 0
    when = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.floor(u("when") * 1500).cast("int")), "yyyy-MM-dd")
    return rows.withColumn("s", spec).select(
        F.lit("Observation").alias("resourceType"),
        F.concat_ws("-", "pid", F.lit("o"), "k").alias("id"),
        F.lit("final").alias("status"),
        F.struct(F.concat(F.lit("Patient/"), "pid").alias("reference")).alias("subject"),
        coded(F.when(first, F.lit("85354-9")).otherwise(F.col("s.code"))).alias("code"),
        F.when(first, when).otherwise(unless(u("m"), 0.15 if messy else 0.0, when)).alias("effectiveDateTime"),
        F.when(~first, quantity(F.when(swap, other).otherwise(value), F.when(swap, F.col("s.other")).otherwise(F.col("s.unit")))).alias("valueQuantity"),
        F.when(first, panel).alias("component"),
    )


def medication_requests(dx: DataFrame, seed: int = 42, messy: bool = True) -> DataFrame:
    """A medication for each condition that the bridge from diagnoses to drugs has any for, by its weights; conditions without one get no request."""
    u = lambda salt: uniform(seed, salt, F.col("id"))
    spark = dx.sparkSession
    lists = F.broadcast(choice_lists(v.dx_to_med(spark), "icd10", "rxcui"))  # closed vocabularies, a few rows
    drugs = F.broadcast(v.medications(spark).select(F.col("code").alias("rxcui"), "label", "short", "full"))
    picked = sampled(dx.withColumn("icd10", coding(F.col("code.coding"), ICD10)["code"]), lists, "icd10", "rxcui", u("rx")).join(drugs, "rxcui")
    text = F.when(u("short") < (0.5 if messy else 0.0), F.col("short")).otherwise(F.col("full"))
    return picked.select(
        F.lit("MedicationRequest").alias("resourceType"),
        F.concat("id", F.lit("-m")).alias("id"),
        profile("medicationrequest").alias("meta"),
        F.lit("active").alias("status"),
        F.lit("order").alias("intent"),
        "subject",
        F.struct(F.array(F.struct(F.lit(RXNORM).alias("system"), F.col("rxcui").alias("code"), F.lit(None).cast("string").alias("display"))).alias("coding"), F.col("label").alias("text")).alias("medicationCodeableConcept"),
        F.col("onsetDateTime").alias("authoredOn"),
        unless(u("m"), 0.15 if messy else 0.0, F.array(F.struct(text.alias("text")))).alias("dosageInstruction"),
        F.array(F.struct(F.concat(F.lit("Condition/"), "id").alias("reference"))).alias("reasonReference"),
    )


def bridge(members: DataFrame, vocabulary: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """icd10, rxcui, weight: drugs of the vocabulary that may treat each diagnosis; a diagnosis' drugs share alike unless overridden.

    members: icd10, rxcui (of a classification, most of them outside the vocabulary). vocabulary: rxcui. overrides: icd10, rxcui, weight.
    """
    matched = members.select("icd10", "rxcui").distinct().join(vocabulary.select("rxcui"), "rxcui", "left_semi")
    even = matched.groupBy("icd10").agg((1.0 / F.count("*")).alias("even"))
    weighted = matched.join(even, "icd10")
    weight = F.col("even")
    if overrides is not None:
        weighted = weighted.join(overrides.select("icd10", "rxcui", F.col("weight").alias("own")), ["icd10", "rxcui"], "left")
        weight = F.coalesce("own", weight)
    return weighted.select("icd10", "rxcui", F.round(weight, 3).alias("weight"))


def bridge_flags(diagnoses: DataFrame, found: DataFrame, added: DataFrame) -> DataFrame:
    """icd10, reason: diagnoses without a drug of the vocabulary, or with newly added ones only. added: rxcui."""
    flagged = diagnoses.select("icd10").join(found.select("icd10", "rxcui"), "icd10", "left").join(added.select("rxcui", F.lit(True).alias("new")), "rxcui", "left")
    counts = flagged.groupBy("icd10").agg(F.count("rxcui").alias("n"), F.count("new").alias("n_new"))
    reason = F.when(F.col("n") == 0, "no in-vocabulary medication").when(F.col("n") == F.col("n_new"), "only newly added medications")
    return counts.select("icd10", reason.alias("reason")).where("reason is not null")


def dataset(spark: SparkSession, n_patients: int, seed: int = 42, messy: bool = True) -> dict[str, DataFrame]:
    return resources_of(patients(spark, n_patients, seed, messy), seed, messy)


def resources_of(people: DataFrame, seed: int = 42, messy: bool = True) -> dict[str, DataFrame]:
    """Resources of each type of these patients."""
    dx = conditions(people, seed, messy)
    return {"Patient": people, "Condition": dx, "Observation": observations(people, seed, messy), "MedicationRequest": medication_requests(dx, seed, messy)}


def as_landing(resources: dict[str, DataFrame]) -> DataFrame:
    """resourceType, value (JSON): what a landing holds."""
    parts = [df.select("resourceType", F.to_json(F.struct(*df.columns)).alias("value")) for df in resources.values()]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def render_notes(rows: DataFrame, key: str, parts: list[tuple[str | None, Column]]) -> DataFrame:
    """text and spans (start, end, type, text) of notes put together from parts (type or None, text); places are code points."""
    pieces = F.array(*(F.struct(F.lit(kind).cast("string").alias("type"), F.coalesce(text, F.lit("")).alias("text")) for kind, text in parts))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,type:string,text:string>>").alias("spans"))
    end = lambda a, p: (a["at"] + F.length(p["text"])).alias("end")
    folded = F.aggregate(
        pieces,
        begin,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["text"])).alias("at"),
            F.when(p["type"].isNull(), a["spans"])
            .otherwise(F.array_append(a["spans"], F.struct(a["at"].alias("start"), end(a, p), p["type"].alias("type"), p["text"].alias("text"))))
            .alias("spans"),
        ),
    )
    text = F.array_join(F.transform(pieces, lambda p: p["text"]), "")
    return rows.select(key, text.alias("text"), folded["spans"].alias("spans"))
