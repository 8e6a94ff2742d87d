"""Scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.vocabulary import DATE_CLAUSE

SHIFT_DAYS = 365
NUMBER = r"(?i)^[+-]?([0-9]+[.]?[0-9]*(e[+-]?[0-9]+)?|[.][0-9]+(e[+-]?[0-9]+)?|nan|inf|infinity)$"
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def digest_mod(text: Column, modulus: int) -> Column:
    """The SHA-256 of text, as a number, modulo modulus: folded over chunks of 32 bits."""
    digest = F.sha2(text, 256)
    chunk = lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda r, i: (r * 4294967296 + chunk(i)) % modulus)


def patient_offset(patient: Column, category: Column) -> Column:
    """Days to shift a patient's dates of a category by: within a year either way, never 0."""
    r = digest_mod(F.concat_ws(":", patient.cast("string"), category), 2 * SHIFT_DAYS)
    return F.when(r < SHIFT_DAYS, r - SHIFT_DAYS).otherwise(r - SHIFT_DAYS + 1).cast("int")


def shifted(patient: Column, category: Column, date: Column) -> Column:
    """An ISO date string moved by the patient's offset."""
    return F.date_format(F.date_add(F.to_date(date), patient_offset(patient, category)), "yyyy-MM-dd")


def pseudonym(patient: Column) -> Column:
    return F.concat(F.lit("DEID-"), F.upper(F.substring(F.sha2(patient.cast("string"), 256), 1, 10)))


def zip3(code: Column) -> Column:
    """The first three digits of a postal code; null for a code that is empty or missing."""
    return F.when(F.length(code) > 0, F.concat(F.substring(code, 1, 3), F.lit("**")))


def referenced(reference: Column) -> Column:
    """The id in ``Type/id``; null without a slash."""
    return F.get(F.split(reference, "/", 2), F.lit(1))


def coding(codings: Column, system: str) -> Column:
    """The first coding of a system, or null."""
    return F.get(F.filter(codings, lambda c: c["system"] == system), F.lit(0))


def number(text: Column) -> Column:
    """text as a double where it is written as a number, blanks around it aside, else null."""
    return F.when(strip(text).rlike(NUMBER), strip(text).try_cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return share(2 * precision * recall, precision + recall)


def without_date_clause(name: Column) -> Column:
    """A diagnosis without a trailing clause that says when it was made. Each form of it has a hyphen or a parenthesis; other names aren't searched."""
    may = F.contains(name, F.lit("-")) | F.contains(name, F.lit(")"))
    return strip(F.when(may, F.regexp_replace(name, "(?i)" + DATE_CLAUSE, "")).otherwise(name))


def quoted(text: Column) -> Column:
    """text as reports quote it: in single quotes, or in double ones if it holds single ones only; None for null."""
    escaped = text
    for raw, said in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(said))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.coalesce(F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single), F.lit("None"))


def to_metric(unit: Column, value: Column) -> Column:
    """Value in the canonical unit, for the folded names of other units; rounded half up to one place."""
    return (
        F.when(unit == "degf", F.round((value - 32) * 5 / 9, 1))
        .when(unit == "lb_av", F.round(value / 2.20462, 1))
        .when(unit == "in_i", F.round(value * 2.54, 1))
    )
