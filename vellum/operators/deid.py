"""De-identification: date shifts that keep intervals, redaction, measured recall, leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scalars import pseudonym, shifted, zip3
from vellum.functions.spans import bound, rewritten, running_sum, united
from vellum.functions.vocabulary import CASE_EXAMPLES, LEAK_EXAMPLES, PHI_PATTERNS
from vellum.operators.relational import first_k, no_rows, overlapping

#: The category whose shift a field or a span follows.
FIELD_CATEGORY = {"birthDate": "dob", "onsetDateTime": "visit", "effectiveDateTime": "visit", "authoredOn": "visit"}
SPAN_CATEGORY = {"DOB": "dob", "DATE": "visit"}


def shift_dates(df: DataFrame, patient: str, fields: dict[str, str] = FIELD_CATEGORY) -> DataFrame:
    """Moves the date fields that df has, each by its patient's offset for the field's category."""
    present = {f: c for f, c in fields.items() if f in df.columns}
    return df.withColumns({f: shifted(F.col(patient), F.lit(c), F.col(f)) for f, c in present.items()})


def redact_patients(patients: DataFrame) -> DataFrame:
    """Drops the name, replaces the identifier, keeps state and the first three digits of the code of the first address.

    A patient without addresses stays without; an empty or missing code gives none.
    """
    first = F.get("address", F.lit(0))
    general = F.array(F.struct(first["state"].alias("state"), zip3(first["postalCode"]).alias("postalCode")))
    none = F.array().cast("array<struct<state:string,postalCode:string>>")
    general = F.when(F.size("address") > 0, general).when(F.col("address").isNotNull(), none)
    return patients.drop("name").withColumns(
        {"identifier": F.array(F.struct(F.lit("urn:deid").alias("system"), pseudonym(F.col("id")).alias("value"))), "address": general}
    )


def rewrite_spans(text: Column, spans: Column, patient: Column) -> Column:
    """text with its spans (start, end, type; disjoint) rewritten: dates shifted, others as [TYPE]."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))))

    def said(s: Column, raw: Column) -> Column:
        dates = F.when(F.lit(False), raw)
        for kind, category in SPAN_CATEGORY.items():
            dates = dates.when(s["type"] == kind, shifted(patient, F.lit(category), raw))
        return dates.otherwise(F.concat(F.lit("["), s["type"], F.lit("]")))

    return rewritten(text, ordered, said)


def span_recall(truth: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """For each type of true spans: total, how many a detected span overlaps, recall."""
    found = overlapping(truth.withColumn("_row", F.struct(key, "start", "end", "type")), detected, key, "left_semi")
    hits = found.groupBy("type").agg(F.count("*").alias("caught"))
    totals = truth.groupBy("type").agg(F.count("*").alias("total"))
    joined = totals.join(hits, "type", "left").withColumn("caught", F.coalesce("caught", F.lit(0)))
    return joined.withColumn("recall", F.round(F.col("caught") / F.col("total"), 4))


#: Identifiers of one patient that are sought together.
PACK = 64


def leaked_identifiers(identifiers: DataFrame, haystacks: DataFrame, key: str) -> DataFrame:
    """key, value: identifiers that are still found in a text of the same key. Empty identifiers are no identifiers.

    A patient's identifiers meet a text as one list (of PACK at most), and only those found in it become rows; so a patient with many texts is a
    row for each, not for each text and identifier.
    """
    known = identifiers.where(F.length("value") > 0).select(key, "value").distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("value"))
    packs = known.withColumn("_pack", F.floor((place - 1) / PACK)).groupBy(key, "_pack").agg(F.collect_list("value").alias("_values"))
    met = haystacks.select(key, "text").join(packs, key)
    return met.select(key, F.explode(F.filter("_values", lambda v: F.contains(F.col("text"), v))).alias("value")).distinct()


def leaks_by_patient(identifiers: DataFrame, leaks: DataFrame, key: str) -> DataFrame:
    """key, leaks: how many identifiers of each patient leaked, 0 included. leaks: as from leaked_identifiers()."""
    counts = leaks.groupBy(key).agg(F.count("*").alias("leaks"))
    return identifiers.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("leaks", F.lit(0)).alias("leaks"))


def overall_recall(by_type: DataFrame) -> DataFrame:
    """total, caught and recall over all types of span_recall()."""
    sums = by_type.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("caught"), F.lit(0)).alias("caught"))
    return sums.withColumn("recall", F.round(F.coalesce(F.try_divide("caught", "total"), F.lit(0.0)), 4))


def missed_spans(truth: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """True spans that no detected span overlaps."""
    return overlapping(truth, detected, key, "left_anti")


def recall_report(truth: DataFrame, detected: DataFrame, key: str, examples: int = CASE_EXAMPLES) -> DataFrame:
    """type, total, caught, recall and missed of each type, and of all (type null).

    missed holds the first spans that were missed, as struct (key, start, end), in the order of key and place: at most ``examples`` a row.
    """
    by_type = span_recall(truth, detected, key)
    missed = missed_spans(truth, detected, key).select(key, "start", "end", "type")
    order = [key, "start", "end", "type"]
    span = F.struct(key, "start", "end")
    first = first_k(missed, ["type"], order, examples).groupBy("type").agg(F.sort_array(F.collect_list(span)).alias("missed"))
    sample = first_k(missed, [], order, examples).agg(F.sort_array(F.collect_list(span)).alias("missed"))
    none = F.array().cast(first.schema["missed"].dataType)
    each = by_type.join(first, "type", "left").withColumn("missed", F.coalesce("missed", none))
    whole = overall_recall(by_type).join(sample).select(F.lit(None).cast("string").alias("type"), "total", "caught", "recall", "missed")  # one row each
    return each.select("type", "total", "caught", "recall", "missed").union(whole)


def patient_identifiers(patients: DataFrame, shortest: int = 3) -> DataFrame:
    """id, value: the direct identifiers of each patient. Given names of fewer than ``shortest`` characters are none by themselves.

    patients: id, name (family, given), identifier, address (line, city, postalCode), birthDate; any of them may be null.
    """
    name = F.get("name", F.lit(0))
    given = F.coalesce(name["given"], F.array().cast("array<string>"))
    full = F.when((F.size(given) > 0) & (F.length(name["family"]) > 0), F.concat_ws(" ", F.array_join(given, " "), name["family"]))
    none = F.array().cast("array<string>")
    places = F.transform("address", lambda a: F.concat(F.coalesce(a["line"], none), F.array(a["city"], a["postalCode"])))
    values = F.concat(
        F.filter(given, lambda g: F.length(g) >= shortest),
        F.array(name["family"], full, F.col("birthDate")),
        F.coalesce(F.transform("identifier", lambda i: i["value"]), none),
        F.coalesce(F.flatten(places), none),
    )
    each = F.array_distinct(F.filter(values, lambda x: F.length(x) > 0))
    return patients.select("id", F.explode(each).alias("value"))


def deidentified_texts(resources: DataFrame, notes: DataFrame) -> DataFrame:
    """id, text: what is left of each patient to be searched. resources: id (of the patient), value (JSON); notes: id, text.

    A patient's resources and notes are rows of their own: an identifier lies within one of them.
    """
    return resources.select("id", F.col("value").alias("text")).union(notes.select("id", "text"))


def leakage_report(identifiers: DataFrame, haystacks: DataFrame, examples: int = LEAK_EXAMPLES) -> DataFrame:
    """One row: patients, total_leaks and the first leaked values in order. identifiers and haystacks: id, value; id, text."""
    leaks = leaked_identifiers(identifiers, haystacks, "id")
    first = leaks.orderBy("id", "value").limit(examples).agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("leaked_examples"))
    total = leaks.agg(F.count("*").alias("total_leaks"))
    return identifiers.agg(F.countDistinct("id").alias("patients")).join(total).join(first)  # three rows


def record_texts(records: DataFrame) -> DataFrame:
    """note_id, text: the free texts of curated records in which something could be left; values of vitals aren't."""
    none = F.array().cast("array<string>")
    parts = [F.transform("diagnoses", lambda d: d["name"]), F.transform("medications", lambda m: m["name"]), F.transform("medications", lambda m: m["dosage"]), F.transform("vitals", lambda x: x["name"])]
    return records.select("note_id", F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("text")).where(F.length("text") > 0)


def assert_no_phi(records: DataFrame) -> DataFrame:
    """records, unless a pattern shows in one of their free texts: then an error that names the first few."""
    no_rows(phi_patterns_found(record_texts(records), "text").select("note_id", "kind", "text"), "patterns of personal data in curated records")
    return records


def phi_patterns_found(df: DataFrame, field: str, patterns: list[tuple[str, str]] = PHI_PATTERNS) -> DataFrame:
    """A row for each row of df and kind of pattern that its field shows. One pass: patterns are tried within the row."""
    kinds = F.array(*(F.when(F.col(field).rlike(p), F.lit(kind)) for kind, p in patterns))
    return df.withColumn("kind", F.explode(F.array_compact(kinds)))


def moved_days(before: DataFrame, after: DataFrame, key: str, date: str, group: str) -> DataFrame:
    """group, least, most, kept: by how many days the dates of each group moved, and whether that is one number other than 0."""
    moved = before.select(key, group, F.col(date).alias("_b")).join(after.select(key, F.col(date).alias("_a")), key)
    days = F.datediff(F.to_date("_a"), F.to_date("_b"))
    return moved.groupBy(group).agg(F.min(days).alias("least"), F.max(days).alias("most")).withColumn("kept", (F.col("least") == F.col("most")) & (F.col("least") != 0))


def offsets_keep_intervals(before: DataFrame, after: DataFrame, key: str, date: str, group: str) -> DataFrame:
    """Groups whose dates are not all moved by one number of days other than 0."""
    return moved_days(before, after, key, date, group).where("not kept").drop("kept")


def any_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for _, p in patterns))


#: What recognisers look for, and how sure they are. The first is the one for record numbers.
RECOGNISERS = [
    ("MRN", r"\bMRN\d{4,}\b", 0.9),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 1.0),
    ("IP_ADDRESS", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", 0.6),
    ("DATE_TIME", r"\b\d{4}-\d{2}-\d{2}\b", 0.6),
]


def recognised(text: Column, recognisers: list[tuple[str, str, float]] = RECOGNISERS, least: float = 0.0) -> Column:
    """array<struct<start, end, type, score>>: what each recogniser (type, pattern, score) of at least that score finds, in order of place.

    Places come from split() and regexp_extract_all(), which walk a text alike: a match starts behind the pieces and matches ahead of it.
    """

    def found(kind: str, pattern: str, score: float) -> Column:
        def placed(x: Column) -> Column:
            steps = F.zip_with(x["pieces"], x["found"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
            span = lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("type"), F.lit(score).alias("score"))
            return running_sum(steps, lambda ends: F.transform(x["found"], lambda m, i: span(m, F.get(ends, i))))

        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        none = F.array().cast("array<struct<start:int,end:int,type:string,score:double>>")
        pair = F.struct(F.split(text, pattern).alias("pieces"), matches.alias("found"))
        return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), bound(pair, placed)).otherwise(none)

    return F.sort_array(F.concat(*(found(*r) for r in recognisers if r[2] >= least)))


def resolved(spans: Column) -> Column:
    """Recognised spans made disjoint, so that all they cover is redacted; of those that start together the longest names the type."""
    ordered = F.array_sort(
        spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    )
    return united(ordered, ["start", "end", "type"])
