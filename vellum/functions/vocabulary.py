"""Closed vocabularies as DataFrames. The lists below are fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: ICD-10, standard name, SNOMED, source concept, standard concept; in canonical order.
CONDITIONS = [
    ("E11.9", "Type 2 diabetes mellitus without complication", "313436004", 35206882, 4193704),
    ("I10", "Essential hypertension", "59621000", 35207668, 320128),
    ("J45.909", "Uncomplicated asthma", "707444001", 45562457, 45768910),
    ("E78.5", "Hyperlipidemia", "55822004", 35207065, 432867),
    ("J44.9", "Chronic obstructive lung disease", "13645005", 35208025, 255573),
    ("G43.909", "Migraine", "37796009", 45600786, 318736),
    ("E66.9", "Obesity", "414916001", 35207024, 433736),
    ("K21.9", "Gastroesophageal reflux disease without esophagitis", "266435005", 35208190, 4144111),
    ("E03.9", "Hypothyroidism", "40930008", 35206859, 140673),
    ("F32.9", "Major depression, single episode", "36923009", 35207155, 4282096),
]
#: RxNorm, label, short sig, full sig, standard concept.
MEDICATIONS = [
    ("6809", "Metformin 500 MG Oral Tablet", "500mg PO BID", "Take 500 mg by mouth twice daily", 1503297),
    ("29046", "Lisinopril 10 MG Oral Tablet", "10mg PO QD", "Take 10 mg by mouth once daily", 1308216),
    ("83367", "Atorvastatin 20 MG Oral Tablet", "20mg PO QHS", "Take 20 mg by mouth at bedtime", 1545958),
    ("435", "Albuterol 90 MCG Inhaler", "2puff q4h PRN", "Inhale 2 puffs every 4 hours as needed", 1154343),
    ("10582", "Levothyroxine 75 MCG Oral Tablet", "75mcg PO QAM", "Take 75 mcg by mouth every morning", 1501700),
    ("36437", "Sertraline 50 MG Oral Tablet", "50mg PO QD", "Take 50 mg by mouth once daily", 739138),
    ("7646", "Omeprazole 20 MG Oral Capsule", "20mg PO QD", "Take 20 mg by mouth once daily", 923645),
    ("17767", "Amlodipine 5 MG Oral Tablet", "5mg PO QD", "Take 5 mg by mouth once daily", 1332418),
    ("69120", "Tiotropium 18 MCG Inhalation Powder", "1cap inh QD", "Inhale the contents of 1 capsule once daily", 1106776),
    ("37418", "Sumatriptan 50 MG Oral Tablet", "50mg PO PRN", "Take 50 mg by mouth at onset of migraine; may repeat once after 2 hours", 1140643),
    ("8152", "Phentermine 37.5 MG Oral Tablet", "37.5mg PO QAM", "Take 37.5 mg by mouth every morning before breakfast", 735340),
]
#: LOINC, name, standard concept, unit, other unit, least and most plausible value.
OBSERVATIONS = [
    ("8867-4", "Heart rate", 3027018, "/min", None, 30.0, 220.0),
    ("8310-5", "Body temperature", 3020891, "Cel", "[degF]", 30.0, 45.0),
    ("29463-7", "Body weight", 3025315, "kg", "[lb_av]", 20.0, 350.0),
    ("8302-2", "Body height", 3036277, "cm", "[in_i]", 100.0, 250.0),
    ("2339-0", "Glucose [Mass/volume] in Blood", 3000483, "mg/dL", None, 20.0, 600.0),
    ("85354-9", "Blood pressure panel", 36203185, None, None, None, None),
    ("8480-6", "Systolic blood pressure", 3004249, "mm[Hg]", None, None, None),
    ("8462-4", "Diastolic blood pressure", 3012888, "mm[Hg]", None, None, None),
]
#: UCUM unit, concept; 0 is unmapped.
UNITS = [
    ("mm[Hg]", 8876), ("Cel", 586323), ("[degF]", 9289), ("kg", 9529), ("[lb_av]", 0),
    ("cm", 8582), ("[in_i]", 9327), ("mg/dL", 8840), ("/min", 8541),
]
GENDERS = [("male", 8507), ("female", 8532)]
EHR_TYPE = 32817
#: ICD-10, RxNorm, weight.
DX_TO_MED = [
    ("E11.9", "6809", 1.0), ("I10", "29046", 0.55), ("I10", "17767", 0.45), ("J45.909", "435", 1.0), ("E78.5", "83367", 1.0),
    ("J44.9", "69120", 1.0), ("G43.909", "37418", 1.0), ("E66.9", "8152", 1.0), ("K21.9", "7646", 1.0), ("E03.9", "10582", 1.0),
    ("F32.9", "36437", 1.0),
]
PARAPHRASES = [
    ("type 2 diabetes mellitus", "Type 2 diabetes mellitus without complication"),
    ("asthma", "Uncomplicated asthma"),
]
VITAL_ALIASES = [("glucose", "Glucose [Mass/volume] in Blood"), ("hr", "Heart rate")]
BLOOD_PRESSURE_NAMES = ["bp", "blood pressure", "blood pressure panel"]
UNIT_ALIASES = [
    ("in", "in_i"), ("inch", "in_i"), ("inches", "in_i"), ("lb", "lb_av"), ("lbs", "lb_av"), ("pound", "lb_av"), ("pounds", "lb_av"),
    ("f", "degf"), ("degf", "degf"), ("c", "cel"), ("celsius", "cel"),
]
MISSING_DOSAGES = ["", "dosage not recorded", "none", "n/a"]
#: The clause of date that stands behind a diagnosis in notes, and a blood pressure as it is written.
DATE_CLAUSE = r"\s*(?:,\s*(?:first\s+)?diagnosed\s+\d{4}-\d{2}-\d{2}|\(dx\s+[^)]*\))\s*$"
PRESSURE = r"^\d{2,3}/\d{2,3}$"
#: What an error that may pass by itself has in its class name or message.
TRANSIENT_HINTS = ("rate_limit", "overloaded", "timeout", "connection", "500", "502", "503", "529")
#: Kind and pattern of what must not be left in free text.
PHI_PATTERNS = [
    ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("mrn", r"(?i)\bMRN\d+\b"),
    ("placeholder", r"\[[A-Z_]+\]"),
    ("provider", r"\bDr\.\s+[A-Z][a-z]+"),
]
#: Check, direction and bound of the release gate.
RELEASE_THRESHOLDS = [
    ("json_validity_rate", ">=", 0.90),
    ("diagnosis_micro_f1", ">=", 0.80),
    ("medication_micro_f1", ">=", 0.70),
    ("non_canonical_total", "<=", 2.0),
]
SPLITS = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
#: How many examples of names outside the vocabulary, of failed outputs, of failure cases and of leaks a report shows.
NON_CANONICAL_EXAMPLES, FAILURE_EXAMPLES, CASE_EXAMPLES, LEAK_EXAMPLES = 20, 5, 25, 20


def conditions(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(CONDITIONS)]
    return spark.createDataFrame(rows, "ord int, code string, name string, snomed string, source_id long, standard_id long")


def medications(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEDICATIONS, "code string, label string, short string, full string, standard_id long")


def observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBSERVATIONS, "code string, name string, standard_id long, unit string, other_unit string, least double, most double")


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "unit string, unit_id long")


def dx_to_med(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DX_TO_MED, "icd10 string, rxcui string, weight double")


def dosage_variants(spark: SparkSession) -> DataFrame:
    """label, variant, full: the short form, the full one, and the full one without its leading verb."""
    rows = {(label, v, full) for _, label, short, full, _ in MEDICATIONS for v in (short, full, full.removeprefix("Take "))}
    return spark.createDataFrame(sorted(rows), "label string, variant string, full string")
