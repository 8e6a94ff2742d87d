"""Declarative data quality: rules give failure rows; a gate passes if there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import vocabulary as v
from vellum.functions.vocabulary import CASE_EXAMPLES


def not_null(column: str) -> tuple[str, str, Column]:
    return "not_null", column, F.col(column).isNull()


def in_range(column: str, least: float, most: float) -> tuple[str, str, Column]:
    """NaN is out of range."""
    x = F.col(column).cast("double")
    return "in_range", column, F.isnan(x) | (x < least) | (x > most)


def at_least(column: str, least: float) -> tuple[str, str, Column]:
    return "ge", column, F.col(column) < least


def one_of(column: str, values: list) -> tuple[str, str, Column]:
    return "isin", column, ~F.col(column).isin(values)


def matching(column: str, pattern: str) -> tuple[str, str, Column]:
    return "str_matches", column, ~F.col(column).rlike(pattern)


def holds(name: str, column: str, condition: Column) -> tuple[str, str, Column]:
    return name, column, ~condition


def rule_failures(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """check, column, failure_case, key: all failures of all rules, in one pass over df."""
    cases = F.array_compact(
        F.array(
            *(
                F.when(bad, F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), F.col(column).cast("string").alias("failure_case")))
                for check, column, bad in rules
            )
        )
    )
    return df.select(F.explode(cases).alias("f"), F.col(key).alias("row_key")).select("f.*", "row_key")


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """Failures of uniqueness: a row for each value that occurs more than once."""
    twice = df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit("unique").alias("check"), F.lit(column).alias("column"), F.col(column).cast("string").alias("failure_case"), F.col(column).alias("row_key"))


def report(failures: DataFrame, examples: int = CASE_EXAMPLES, by: tuple[str, ...] = ("check", "column")) -> DataFrame:
    """n_failures of each check and column, with the first distinct examples only: no more of them are ever gathered."""
    counts = failures.groupBy(*by).agg(F.count("*").alias("n_failures"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("failure_case"))
    first = failures.select(*by, "failure_case").where("failure_case is not null").distinct().withColumn("_n", rank).where(F.col("_n") <= examples)
    shown = first.groupBy(*by).agg(F.sort_array(F.collect_list("failure_case")).alias("examples"))
    return counts.join(shown, list(by), "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def record_frames(records: DataFrame) -> dict[str, DataFrame]:
    """The five tables that curated records are checked as. records: patient_id, note_id, confidence, diagnoses (name),
    medications (name, dosage), vitals (name, value, value_num, unit)."""
    each = lambda c: records.select("note_id", F.explode(c).alias("x"))
    pressure = F.col("x.name").eqNullSafe("Blood pressure")
    return {
        "records": records.select("patient_id", "note_id", "confidence", F.greatest(F.size("diagnoses"), F.lit(0)).cast("long").alias("n_diagnoses")),
        "diagnoses": each("diagnoses").select("note_id", "x.name"),
        "medications": each("medications").select("note_id", "x.name", "x.dosage"),
        "numeric_vitals": each("vitals").where(~pressure).select("note_id", "x.name", F.col("x.value_num").alias("value"), "x.unit"),
        "blood_pressure": each("vitals").where(pressure).select("note_id", "x.value"),
    }


def by_name(values: list[tuple], of: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values for x in pair)), of)


def record_rules() -> dict[str, list[tuple[str, str, Column]]]:
    """The rules of each of the five tables. Bounds and units of vitals go by name; an unknown name has no bounds, and no unit is right."""
    simple = [(name, unit, least, most) for _, name, _, unit, _, least, most in v.OBSERVATIONS if least is not None]
    least, most = (by_name([(n, x[i]) for n, *x in simple], F.col("name")) for i in (1, 2))
    value = F.col("value")
    beyond = F.isnan(value) | (value < F.coalesce(least, F.lit(float("-inf")))) | (value > F.coalesce(most, F.lit(float("inf"))))
    right_unit = F.col("unit").eqNullSafe(by_name([(n, u) for n, u, *_ in simple], F.col("name")))
    return {
        "records": [not_null("patient_id"), not_null("note_id"), not_null("confidence"), in_range("confidence", 0.0, 1.0), at_least("n_diagnoses", 1)],
        "diagnoses": [not_null("note_id"), not_null("name"), one_of("name", [c[1] for c in v.CONDITIONS])],
        "medications": [not_null("note_id"), not_null("name"), one_of("name", [m[1] for m in v.MEDICATIONS])],
        "numeric_vitals": [
            not_null("note_id"), not_null("name"), one_of("name", [s[0] for s in simple]), not_null("value"), not_null("unit"),
            ("vital value out of clinical bounds", "value", beyond), holds("vital unit not canonical", "unit", right_unit),
        ],
        "blood_pressure": [not_null("note_id"), not_null("value"), matching("value", v.PRESSURE)],
    }


#: Types of the five tables' columns.
RECORD_TYPES = {
    "records": {"patient_id": "string", "note_id": "string", "confidence": "double", "n_diagnoses": "bigint"},
    "diagnoses": {"note_id": "string", "name": "string"},
    "medications": {"note_id": "string", "name": "string", "dosage": "string"},
    "numeric_vitals": {"note_id": "string", "name": "string", "value": "double", "unit": "string"},
    "blood_pressure": {"note_id": "string", "value": "string"},
}


def type_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """A failure for each column that is missing or of another type; they depend on the schema alone."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = [("dtype", c, actual.get(c, "missing"), None) for c, kind in types.items() if actual.get(c) != kind]
    return df.sparkSession.createDataFrame(bad, "check string, column string, failure_case string, row_key string")


def record_failures(records: DataFrame) -> DataFrame:
    """table, check, column, failure_case, row_key: everything that is wrong with curated records."""
    rules, found = record_rules(), []
    for name, frame in record_frames(records).items():
        failures = rule_failures(frame, "note_id", rules[name]).union(type_failures(frame, RECORD_TYPES[name]))
        if name == "records":
            failures = failures.union(duplicate_keys(frame.where("patient_id is not null"), "patient_id"))
        found.append(failures.select(F.lit(name).alias("table"), "*"))
    return reduce(DataFrame.union, found)


def validate_records(records: DataFrame, examples: int = CASE_EXAMPLES) -> DataFrame:
    """table, rows, passed, n_failures, failures (the first so many, as check, column and failure_case) of each of the five tables.

    A table without rows passes.
    """
    sizes = reduce(DataFrame.union, (f.agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, f in record_frames(records).items()))
    failures = record_failures(records)
    case = F.struct("check", "column", "failure_case")
    first = failures.withColumn("_n", F.row_number().over(Window.partitionBy("table").orderBy("check", "column", "failure_case"))).where(F.col("_n") <= examples)
    shown = first.groupBy("table").agg(F.sort_array(F.collect_list(case)).alias("failures"))
    counts = failures.groupBy("table").agg(F.count("*").alias("n_failures"))
    joined = sizes.join(counts, "table", "left").join(shown, "table", "left")
    n = F.when(F.col("rows") > 0, F.coalesce("n_failures", F.lit(0))).otherwise(0)
    return joined.select("table", "rows", (n == 0).alias("passed"), n.cast("long").alias("n_failures"), "failures")
