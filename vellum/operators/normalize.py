"""Normalization of extracted names, values and dosages to closed vocabularies.

The vocabularies are closed and short, so every rule is an expression over one mention: nothing is joined or shuffled, and a
record is normalized where it is, with its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import vocabulary as v
from vellum.functions.scalars import number, quoted, strip, to_metric, without_date_clause
from vellum.functions.spans import bound


def _mapping(pairs):
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def diagnosis(name: Column) -> Column:
    """struct(name, matched): date clause off, then paraphrases, then the longest canonical name that it starts with; else kept."""


    def found(x: Column) -> Column:
        known = sorted((c[1] for c in v.CONDITIONS), key=len, reverse=True)
        starting = (F.when(F.startswith(x["low"], F.lit(k.lower())), F.lit(k)) for k in known)
        hit = F.coalesce(F.try_element_at(_mapping(v.PARAPHRASES), x["low"]), *starting)
        return bound(hit, lambda h: F.struct(F.coalesce(h, x["bare"]).alias("name"), h.isNotNull().alias("matched")))

    return bound(without_date_clause(name), lambda bare: bound(F.struct(bare.alias("bare"), F.lower(bare).alias("low")), found))


def folded_unit(unit: Column) -> Column:
    """A unit in lower case without brackets and degree sign, its common spellings made one."""
    token = F.lower(strip(F.replace(F.btrim(strip(unit), F.lit("[]")), F.lit("°"), F.lit(""))))
    return bound(token, lambda t: F.coalesce(F.try_element_at(_mapping(v.UNIT_ALIASES), t), t))


def vital_rules() -> Column:
    """A map from each name of a vital, in lower case, to struct (name, own, own_folded, other_folded): its canonical name and units."""
    folded = lambda unit: unit and unit.strip("[]").lower()
    known = {name: (name, own, folded(own), folded(other)) for _, name, _, own, other, least, _ in v.OBSERVATIONS if least is not None}
    names = {name.lower(): name for name in known} | dict(v.VITAL_ALIASES)
    rule = lambda values: F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("name", "own", "own_folded", "other_folded"), values, strict=True)))
    return F.create_map(*(x for low, name in names.items() for x in (F.lit(low), rule(known[name]))))


def vital(name: Column, value: Column, unit: Column) -> Column:
    """struct(name, value, value_num, unit, matched) of a vital's name, value (text) and unit.

    A blood pressure that reads as two numbers with a slash keeps its text. Any other value that is a number goes to value_num, and
    value is null. A null unit counts as the canonical one; the other unit of a vital is converted; with any other unit
    the value is kept and not matched. An unknown name, and the name of a value that is no number, stay as they are, not matched.
    """

    def found(x: Column) -> Column:
        rule = x["rule"]
        kind = (
            F.when(x["low"].isin(v.BLOOD_PRESSURE_NAMES) & x["said"].rlike(v.PRESSURE), "pressure")
            .when(x["num"].isNull(), "text")
            .when(rule["name"].isNull(), "unknown")
            .when(unit.isNull() | (x["folded"] == rule["own_folded"]), "same")
            .when(x["folded"] == rule["other_folded"], "converted")
            .otherwise("other unit")
        )
        return bound(kind, lambda k: made(x, k))

    def made(x: Column, kind: Column) -> Column:
        return F.struct(
            F.when(kind == "pressure", "Blood pressure").when(kind.isin("text", "unknown"), name).otherwise(x["rule"]["name"]).alias("name"),
            F.when(kind == "pressure", x["said"]).when(kind == "text", value).alias("value"),
            F.when(kind == "converted", to_metric(x["folded"], x["num"])).when(kind != "pressure", x["num"]).alias("value_num"),
            F.when(kind == "pressure", "mm[Hg]").when(kind.isin("same", "converted"), x["rule"]["own"]).otherwise(unit).alias("unit"),
            kind.isin("pressure", "same", "converted").alias("matched"),
        )

    def ruled(low: Column) -> Column:
        rule = F.try_element_at(vital_rules(), low)
        return bound(F.struct(low.alias("low"), rule.alias("rule"), strip(value).alias("said"), number(value).alias("num"), folded_unit(unit).alias("folded")), found)

    return bound(F.lower(strip(name)), ruled)


def split_label(name: Column, dosage: Column) -> Column:
    """struct(label, dosage): a bare drug name as its label; what the label says is cut off the front of the dosage."""
    bare = [(label.split(" ", 1)[0].lower(), label) for _, label, *_ in v.MEDICATIONS]

    def cut(x: Column) -> Column:
        said = strip(F.substring(x["label"], F.length(x["name"]) + 1, F.length(x["label"])))
        rest = lambda s: F.nullif(F.ltrim(F.substring(dosage, F.length(s) + 1, F.length(dosage)), F.lit(" -,;")), F.lit(""))
        bundled = lambda s: F.coalesce(F.startswith(F.lower(dosage), F.lower(s)), F.lit(False))
        dose = F.when(x["label"].isNotNull() & dosage.isNotNull(), bound(said, lambda s: F.when(bundled(s), rest(s)).otherwise(dosage))).otherwise(dosage)
        return F.struct(F.coalesce(x["label"], name).alias("label"), dose.alias("dosage"))

    labelled = lambda bare_name: F.struct(bare_name.alias("name"), F.try_element_at(_mapping(bare), F.lower(bare_name)).alias("label"))
    return bound(strip(name), lambda bare_name: bound(labelled(bare_name), cut))


def dosage_of(label: Column, dosage: Column) -> Column:
    """struct(dosage, matched): the full form of a label's dosage. One that says that it is missing is null and matched; an unknown
    one is kept and not matched."""
    forms = {name: {form: full for form in (short, full, full.removeprefix("Take "))} for _, name, short, full, _ in v.MEDICATIONS}
    own = F.create_map(*(x for name, known in forms.items() for x in (F.lit(name), _mapping(known.items()))))
    known = F.try_element_at(F.try_element_at(own, label), dosage)
    missing = dosage.isNull() | F.lower(strip(dosage)).isin(v.MISSING_DOSAGES)
    found = lambda x: F.struct(F.when(~x["missing"], F.coalesce(x["known"], dosage)).alias("dosage"), (x["missing"] | x["known"].isNotNull()).alias("matched"))
    return bound(F.struct(known.alias("known"), missing.alias("missing")), found)


def medication(name: Column, dosage: Column) -> Column:
    """struct(name, dosage, matched, said): said is the dosage as it was before it was looked up."""


    def known(x: Column) -> Column:
        found = lambda d: F.struct(x["label"].alias("name"), d["dosage"].alias("dosage"), d["matched"].alias("matched"), x["dosage"].alias("said"))
        return bound(dosage_of(x["label"], x["dosage"]), found)

    return bound(split_label(name, dosage), known)


def normalize_diagnoses(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds canonical and matched."""
    found = diagnosis(F.col(name))
    return df.withColumns({"canonical": found["name"], "matched": found["matched"]})


def normalize_vitals(df: DataFrame) -> DataFrame:
    """Of name, value (text), unit: what vital() makes of them, value as value_text; other columns stay."""
    found = df.withColumn("_v", vital(F.col("name"), F.col("value"), F.col("unit")))
    others = [c for c in df.columns if c not in ("name", "value", "unit")]
    return found.select(*others, "_v.name", F.col("_v.value").alias("value_text"), "_v.value_num", "_v.unit", "_v.matched")


def normalize_dosages(df: DataFrame) -> DataFrame:
    """Of name, dosage: what medication() makes of them; other columns stay."""
    found = df.withColumn("_m", medication(F.col("name"), F.col("dosage")))
    return found.select(*[c for c in df.columns if c not in ("name", "dosage")], "_m.name", "_m.dosage", "_m.matched")


def _detail(kind: str, *texts: Column | str) -> Column:
    said = F.concat(*(F.lit(x) if isinstance(x, str) else quoted(x) for x in texts))
    return F.struct(F.lit(kind).alias("field_type"), said.alias("detail"))


def _detail_of_diagnosis(raw: Column) -> Column:
    return _detail("diagnosis", "diagnosis: ", raw)


def _detail_of_dosage(found: Column) -> Column:
    """Of what medication() found."""
    return _detail("dosage", "dosage for ", found["name"], ": ", found["said"])


def _detail_of_vital(x: Column) -> Column:
    """Of name, value and unit as they were said."""
    return _detail("vital", "vital: ", x["name"], " (", x["value"], " ", x["unit"], ")")


def normalize_records(records: DataFrame) -> DataFrame:
    """records with diagnoses, medications and vitals normalized, and unmatched: array of struct (field_type, detail).

    records: diagnoses (array of struct name), medications (name, dosage), vitals (name, value, unit), and other columns, which
    stay. A diagnosis, or a medication with its dosage, that was said before in the record is left out; vitals stay all. A null array
    counts as an empty one.
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast(records.schema[c].dataType))
    work = records.withColumns(
        {
            "_d": F.transform(some("diagnoses"), lambda x: F.struct(diagnosis(x["name"]).alias("r"), x["name"].alias("raw"))),
            "_m": F.transform(some("medications"), lambda x: medication(x["name"], x["dosage"])),
            "_v": F.transform(
                some("vitals"),
                lambda x: F.struct(vital(x["name"], x["value"].cast("string"), x["unit"]).alias("r"), x["name"].alias("name"), x["value"].cast("string").alias("value"), x["unit"].alias("unit")),
            ),
        }
    )
    unmatched = F.concat(
        F.transform(F.filter("_d", lambda x: ~x["r"]["matched"]), lambda x: _detail_of_diagnosis(x["raw"])),
        F.transform(F.filter("_m", lambda x: ~x["matched"]), _detail_of_dosage),
        F.transform(F.filter("_v", lambda x: ~x["r"]["matched"]), _detail_of_vital),
    )
    made = {
        "diagnoses": F.array_distinct(F.transform("_d", lambda x: F.struct(x["r"]["name"].alias("name")))),
        "medications": F.array_distinct(F.transform("_m", lambda x: F.struct(x["name"].alias("name"), x["dosage"].alias("dosage")))),
        "vitals": F.transform("_v", lambda x: F.struct(*(x["r"][c].alias(c) for c in ("name", "value", "value_num", "unit")))),
        "unmatched": unmatched,
    }
    return work.withColumns(made).drop("_d", "_m", "_v")


def unmatched_report(records: DataFrame) -> DataFrame:
    """field_type, detail, n: how often raw records say what isn't matched; what normalize_records() has in unmatched, counted.

    Mentions are counted as they were said first, so that each distinct one is normalized once, however often it was said.
    """
    said = {"diagnoses": ("name",), "medications": ("name", "dosage"), "vitals": ("name", "value", "unit")}
    columns = ["name", "dosage", "value", "unit"]
    field = lambda x, names, c: (x[c] if c in names else F.lit(None)).cast("string").alias(c)
    rows = lambda kind, names: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), *(field(x, names, c) for c in columns)))
    each = F.concat(*(F.coalesce(rows(*k), F.array().cast(f"array<struct<kind:string,{','.join(f'{c}:string' for c in columns)}>>")) for k in said.items()))
    distinct = records.select(F.inline(each)).groupBy("kind", *columns).agg(F.count("*").alias("n"))
    name, dosage, value, unit = map(F.col, columns)
    judged = (
        F.when(F.col("kind") == "diagnoses", bound(diagnosis(name)["matched"], lambda m: F.when(~m, _detail_of_diagnosis(name))))
        .when(F.col("kind") == "medications", bound(medication(name, dosage), lambda x: F.when(~x["matched"], _detail_of_dosage(x))))
        .otherwise(bound(vital(name, value, unit)["matched"], lambda m: F.when(~m, _detail_of_vital(F.struct(name, value, unit)))))
    )
    found = distinct.select(F.inline(F.array_compact(F.array(judged))), "n")
    return found.groupBy("field_type", "detail").agg(F.sum("n").alias("n"))


def mentions(records: DataFrame) -> DataFrame:
    """field, total, unmatched: a row for each field of each record of normalize_records() that has n_diagnoses, n_medications, n_vitals."""
    count = lambda kind: F.size(F.filter("unmatched", lambda u: u["field_type"] == kind)).cast("long")
    fields = [("diagnosis", "n_diagnoses"), ("dosage", "n_medications"), ("vital", "n_vitals")]
    return records.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(n).alias("total"), count(f).alias("unmatched")) for f, n in fields))))


def record_metrics(records: DataFrame) -> DataFrame:
    """total, matched, unmatched and unmatched_rate of each field of raw records, and over all (field null)."""
    sizes = {f"n_{c}": F.greatest(F.size(c), F.lit(0)).cast("long") for c in ("diagnoses", "medications", "vitals")}
    rows = mentions(normalize_records(records.withColumns(sizes)))
    return (
        rows.rollup("field")
        .agg(F.sum("total").alias("total"), F.sum("unmatched").alias("unmatched"))
        .withColumn("matched", F.col("total") - F.col("unmatched"))
        .withColumn("unmatched_rate", F.coalesce(F.try_divide("unmatched", "total"), F.lit(0.0)))
    )


def match_metrics(mentions: DataFrame) -> DataFrame:
    """For each field, and over all (field null): total, matched, unmatched and rate. mentions: field, matched."""
    return mentions.rollup("field").agg(
        F.count("*").alias("total"),
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("unmatched"),
        F.round(F.avg(F.col("matched").cast("int")), 4).alias("rate"),
    )
