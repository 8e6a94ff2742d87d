"""Structural validation of resources: definitions of their elements, compiled to one expression over VARIANT.

A definition lists elements: name, kind, least and greatest number, and for codes the values allowed. An element of several kinds
(``value[x]``) is a choice: at most one of its names may be there. The compiled expression walks a parsed document once and gives the
list of what is wrong with it; nothing is joined or shuffled, whatever the definition.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.spans import bound
from vellum.functions.vocabulary import CASE_EXAMPLES
from vellum.operators.relational import first_k

MANY = None


@dataclass(frozen=True)
class Element:
    """kind: string, code, date, dateTime, decimal, boolean or object (of parts); most: 1, or MANY for a list."""

    name: str
    kind: str = "string"
    least: int = 0
    most: int | None = 1
    values: tuple[str, ...] = ()
    parts: tuple[Element, ...] = field(default=())


@dataclass(frozen=True)
class Choice:
    """One of several elements, at most."""

    name: str
    least: int
    of: tuple[Element, ...]


DATE = r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$"
DATE_TIME = r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01])(T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2}))?)?)?$"

CODING = (Element("system"), Element("code"), Element("display"))
CONCEPT = (Element("coding", "object", 0, MANY, parts=CODING), Element("text"))
REFERENCE = (Element("reference"),)
QUANTITY = (Element("value", "decimal"), Element("unit"), Element("system"), Element("code"))
META = Element("meta", "object", parts=(Element("profile", "string", 0, MANY),))
COMMON = (Element("id"), META)
#: The elements of the four resource types, with what the standard requires of them.
DEFINITIONS: dict[str, tuple[Element | Choice, ...]] = {
    "Patient": (
        *COMMON,
        Element("gender", "code", values=("male", "female", "other", "unknown")),
        Element("birthDate", "date"),
        Element("identifier", "object", 0, MANY, parts=(Element("system"), Element("value"))),
        Element("name", "object", 0, MANY, parts=(Element("family"), Element("given", "string", 0, MANY))),
        Element("address", "object", 0, MANY, parts=(Element("line", "string", 0, MANY), Element("city"), Element("state"), Element("postalCode"))),
    ),
    "Condition": (
        *COMMON,
        Element("code", "object", parts=CONCEPT),
        Element("subject", "object", 1, parts=REFERENCE),
        Choice("onset[x]", 0, (Element("onsetDateTime", "dateTime"), Element("onsetString"))),
    ),
    "Observation": (
        *COMMON,
        Element("status", "code", 1, values=("registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown")),
        Element("code", "object", 1, parts=CONCEPT),
        Element("subject", "object", parts=REFERENCE),
        Choice("effective[x]", 0, (Element("effectiveDateTime", "dateTime"), Element("effectiveInstant", "dateTime"))),
        Choice("value[x]", 0, (Element("valueQuantity", "object", parts=QUANTITY), Element("valueString"), Element("valueBoolean", "boolean"))),
        Element("component", "object", 0, MANY, parts=(Element("code", "object", 1, parts=CONCEPT), Element("valueQuantity", "object", parts=QUANTITY))),
    ),
    "MedicationRequest": (
        *COMMON,
        Element("status", "code", 1, values=("active", "on-hold", "cancelled", "completed", "entered-in-error", "stopped", "draft", "unknown")),
        Element("intent", "code", 1, values=("proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option")),
        Choice("medication[x]", 1, (Element("medicationCodeableConcept", "object", parts=CONCEPT), Element("medicationReference", "object", parts=REFERENCE))),
        Element("subject", "object", 1, parts=REFERENCE),
        Element("authoredOn", "dateTime"),
        Element("dosageInstruction", "object", 0, MANY, parts=(Element("text"),)),
    ),
}

NO_ERRORS = "array<string>"


def none() -> Column:
    return F.array().cast(NO_ERRORS)


def error(path: str, said: str) -> Column:
    return F.array(F.lit(f"{path}: {said}"))


def child(document: Column, path: str) -> Column:
    """What stands at a path, null if it isn't there or is null."""
    return bound(F.try_variant_get(document, path, "variant"), lambda x: F.when(~F.is_variant_null(x), x))


def is_object(document: Column, path: str) -> Column:
    """Whether an object stands at a path. Nothing of it is copied: the one field that is asked for needn't be there."""
    return F.try_variant_get(document, path, "struct<_:boolean>").isNotNull()


def value_errors(value: Column, e: Element, path: str) -> Column:
    """What is wrong with one value of an element that is no object."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    is_text = kind == "STRING"
    fits = {
        "string": is_text & (F.length(text) > 0),
        "code": is_text & (text.isin(list(e.values)) if e.values else F.length(text) > 0),
        "date": is_text & text.rlike(DATE),
        "dateTime": is_text & text.rlike(DATE_TIME),
        "decimal": kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
        "boolean": kind == "BOOLEAN",
    }[e.kind]
    return F.when(F.coalesce(fits, F.lit(False)), none()).otherwise(expected(e, path))


def expected(e: Element, path: str) -> Column:
    return error(path, f"{e.kind} expected" + (" of " + ", ".join(e.values) if e.values else ""))


def element_errors(document: Column, at: str, e: Element, prefix: str, least: int) -> Column:
    """What is wrong with an element of the object at a path of document. Objects are walked by longer paths, not taken out."""
    path, place = prefix + e.name, f"{at}.{e.name}"
    missing = error(path, "required") if least else none()
    otherwise = lambda wrong: bound(child(document, place), lambda x: F.when(x.isNull(), missing).otherwise(wrong(x)))
    if e.most != 1:
        inner = lambda i: F.when(is_object(i, "$"), object_errors(i, e.parts, path)).otherwise(expected(e, path)) if e.kind == "object" else value_errors(i, e, path)
        each = lambda i: F.when(F.is_variant_null(i), error(path, "null in a list")).otherwise(inner(i))
        listed = lambda items: F.when(items.isNotNull(), F.flatten(F.transform(items, each))).otherwise(otherwise(lambda _: error(path, "list expected")))
        return bound(F.try_variant_get(document, place, "array<variant>"), listed)
    if e.kind == "object":
        inner = object_errors(document, e.parts, path, place) if e.parts else none()
        return F.when(is_object(document, place), inner).otherwise(otherwise(lambda _: expected(e, path)))
    return otherwise(lambda x: value_errors(x, e, path))


def chosen(few: Column, many: Column, n: Column) -> Column:
    return F.when(n == 0, few).when(n > 1, many).otherwise(none())


def object_errors(document: Column, elements: tuple[Element | Choice, ...], prefix: str = "", at: str = "$") -> Column:
    """What is wrong with the object at a path of document, as an array of texts: path and what is expected there."""
    prefix = f"{prefix}." if prefix else ""
    found = []
    for e in elements:
        if isinstance(e, Element):
            found.append(element_errors(document, at, e, prefix, e.least))
            continue
        found += [element_errors(document, at, one, prefix, 0) for one in e.of]
        there = lambda place: is_object(document, place) | child(document, place).isNotNull()
        n = sum((there(f"{at}.{one.name}").cast("int") for one in e.of), F.lit(0))
        few, many = (error(prefix + e.name, "required") if e.least else none()), error(prefix + e.name, "one of its kinds expected")
        found.append(bound(n, partial(chosen, few, many)))
    return F.concat(*found)


def resource_errors(value: Column, definitions: dict[str, tuple[Element | Choice, ...]] = DEFINITIONS) -> Column:
    """What is wrong with a resource (JSON text), as an array of texts; its type decides which definition holds."""

    def by_type(document: Column) -> Column:
        kind = F.try_variant_get(document, "$.resourceType", "string")
        checks = F.when(document.isNull(), error("document", "JSON expected"))
        for name, elements in definitions.items():
            checks = checks.when(kind == name, object_errors(document, elements))
        return checks.otherwise(error("resourceType", "unknown"))

    return bound(F.try_parse_json(value), by_type)


def validated(resources: DataFrame, definitions: dict = DEFINITIONS) -> DataFrame:
    """resources (value: JSON text, and others) with resource_type, id, profiled and errors."""
    document = F.try_parse_json("value")
    get = lambda path: F.try_variant_get(document, path, "string")
    profiled = F.size(F.try_variant_get(document, "$.meta.profile", "array<variant>")) > 0
    return resources.withColumns(
        {"resource_type": get("$.resourceType"), "id": get("$.id"), "profiled": F.coalesce(profiled, F.lit(False)), "errors": resource_errors(F.col("value"), definitions)}
    )


def validity(checked: DataFrame) -> DataFrame:
    """total, valid, invalid and profiled of each resource_type of validated() resources, and of all (null)."""
    right = F.size("errors") == 0
    known = checked.select(F.coalesce("resource_type", F.lit("")).alias("resource_type"), right.alias("right"), "profiled")
    counts = [F.count("*").alias("total"), F.count_if("right").alias("valid"), F.count_if(~F.col("right")).alias("invalid"), F.count_if("profiled").alias("profiled")]
    return known.rollup("resource_type").agg(*counts)


def first_failures(checked: DataFrame, order: list[str], k: int = CASE_EXAMPLES) -> DataFrame:
    """The first k invalid resources in order: resource_type, id and error, the first thing wrong."""
    wrong = checked.where(F.size("errors") > 0)
    return first_k(wrong, [], order, k).select("resource_type", "id", F.get("errors", F.lit(0)).alias("error"))
