"""Evaluation: true and false positives by category of a vocabulary, dosage matches, JSON validity, release gate.

Names outside the vocabulary are counted apart, as hallucinations; they are no false positives of any category.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scalars import f1, share
from vellum.functions.spans import bound
from vellum.functions.vocabulary import FAILURE_EXAMPLES, NON_CANONICAL_EXAMPLES


def score_pairs(truth: DataFrame, predicted: DataFrame, record: str, category: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each category, over distinct (record, category) of either side."""
    t = truth.select(record, category).distinct().withColumn("t", F.lit(1))
    p = predicted.select(record, category).distinct().withColumn("p", F.lit(1))
    both = t.join(p, [record, category], "full")
    counts = both.groupBy(category).agg(
        F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": F.round(share(tp, tp + fp), 4), "recall": F.round(share(tp, tp + fn), 4), "f1": F.round(f1(tp, fp, fn), 4)})


def overall(by_category: DataFrame) -> DataFrame:
    return with_rates(by_category.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def score_vocabulary(truth: DataFrame, predicted: DataFrame, vocabulary: DataFrame, record: str, category: str) -> DataFrame:
    """tp, fp, fn and rates of every category of the vocabulary, zeros too; names outside it count on neither side."""
    known = vocabulary.select(category).distinct()
    within = lambda df: df.join(known, category, "left_semi")
    found = score_pairs(within(truth), within(predicted), record, category).select(category, "tp", "fp", "fn")
    return with_rates(known.join(found, category, "left").fillna(0, ["tp", "fp", "fn"]))


def outside(predicted: DataFrame, vocabulary: DataFrame, category: str, examples: int = NON_CANONICAL_EXAMPLES) -> DataFrame:
    """One row: non_canonical_count (every mention of a name outside the vocabulary) and the first such names in order."""
    strange = predicted.select(category).where(F.col(category).isNotNull()).join(vocabulary.select(category), category, "left_anti")
    first = strange.distinct().orderBy(category).limit(examples)
    names = first.agg(F.sort_array(F.collect_list(category)).alias("non_canonical_examples"))  # so many names at most
    return strange.agg(F.count("*").alias("non_canonical_count")).join(names)


def score_summary(truth: DataFrame, predicted: DataFrame, vocabulary: DataFrame, record: str, category: str) -> DataFrame:
    """One row: micro_precision, micro_recall, micro_f1, tp, fp, fn, non_canonical_count, non_canonical_examples."""
    sums = score_vocabulary(truth, predicted, vocabulary, record, category).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return _micro(sums).join(outside(predicted, vocabulary, category))


def _micro(sums: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"micro_precision": share(tp, tp + fp), "micro_recall": share(tp, tp + fn), "micro_f1": f1(tp, fp, fn)})


def _named(parsed: Column, field: str) -> Column:
    items = F.try_variant_get(parsed, f"$.{field}", "array<variant>")
    name = lambda x: F.try_variant_get(x, "$.name", "variant")
    text = lambda n: F.when(F.schema_of_variant(n) == "STRING", F.try_variant_get(n, "$", "string"))
    return F.coalesce(F.array_compact(F.transform(items, lambda x: bound(name(x), text))), F.array().cast("array<string>"))


def named_items(output: Column, field: str) -> Column:
    """Names in a list of an output (JSON text): those of its objects that are strings; [] if the field is no list."""
    return _named(F.try_parse_json(output), field)


def _object(output: Column, parsed: Column) -> Column:
    """Whether an output, as text and parsed, is a JSON object: what is valid and begins as one."""
    return F.coalesce(parsed.isNotNull() & F.startswith(F.ltrim(output, F.lit(" \t\n\r")), F.lit("{")), F.lit(False))


def predicted_names(outputs: DataFrame, record: str, output: str, field: str, category: str) -> DataFrame:
    """record, category: every name that a field of each output (JSON text) has; outputs that are no object have none."""
    return outputs.where(json_object(F.col(output))).select(record, F.explode(named_items(F.col(output), field)).alias(category))


def predicted_fields(outputs: DataFrame, record: str, output: str, fields: list[str], category: str) -> DataFrame:
    """record, field, category: what predicted_names() gives of each of some fields, with each output parsed once."""

    def named(parsed: Column) -> Column:
        rows = lambda f: F.transform(_named(parsed, f), lambda x: F.struct(F.lit(f).alias("field"), x.alias(category)))
        return F.when(_object(F.col(output), parsed), F.concat(*map(rows, fields)))

    return outputs.select(record, F.inline(bound(F.try_parse_json(output), named)))


def output_tally(outputs: DataFrame, output: str, fields: list[str], category: str) -> DataFrame:
    """field, category, tp, fp, fn, said: how often outputs (JSON text) name what their records name; and valid, total of field null.

    outputs: output, and the record's own lists (array of struct with category) under the names in fields, which are the output's too. A record is
    a row, so no names are joined or shuffled but as sums: each record is parsed once, and compares its distinct names. said counts
    every mention. Only records whose output is an object count, but for total.
    """
    one = lambda field, name, *counts: F.struct(
        field.alias("field"), name.alias(category), *(F.lit(int(c in counts)).cast("long").alias(c) for c in ("tp", "fp", "fn", "said")), F.lit(0).cast("long").alias("valid"), F.lit(0).cast("long").alias("total")
    )

    def compared(field: str, truth: Column, predicted: Column) -> Column:
        rows = lambda names, count: F.transform(names, lambda x: one(F.lit(field), x, count))
        kinds = lambda t, p: ((F.array_intersect(t, p), "tp"), (F.array_except(p, t), "fp"), (F.array_except(t, p), "fn"), (p, "said"))
        return bound(F.struct(truth.alias("t"), predicted.alias("p")), lambda x: F.concat(*(rows(*k) for k in kinds(x["t"], x["p"]))))

    def judged(parsed: Column) -> Column:
        truth = lambda f: F.coalesce(F.array_compact(F.transform(f, lambda x: x[category])), F.array().cast("array<string>"))
        each = (compared(f, truth(f), _named(parsed, f)) for f in fields)
        null = F.lit(None).cast("string")
        whole = lambda valid: F.array(one(null, null).withField("valid", F.lit(valid).cast("long")).withField("total", F.lit(1).cast("long")))
        return F.when(_object(F.col(output), parsed), F.concat(whole(1), *each)).otherwise(whole(0))

    rows = outputs.select(F.inline(bound(F.try_parse_json(output), judged)))
    return rows.groupBy("field", category).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "said", "valid", "total")))


def tally_validity(tally: DataFrame) -> DataFrame:
    """What validity() gives, of an output_tally()."""
    counts = tally.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("valid", "total")))
    return counts.withColumn("rate", share(F.col("valid"), F.col("total")))


def tally_summary(tally: DataFrame, vocabulary: DataFrame, category: str, examples: int = NON_CANONICAL_EXAMPLES) -> DataFrame:
    """What score_summary() gives, of one field's rows of an output_tally()."""
    known = vocabulary.select(category).distinct()
    sums = tally.join(known, category, "left_semi").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    strange = tally.where(F.col(category).isNotNull() & (F.col("said") > 0)).join(known, category, "left_anti")
    first = strange.select(category).orderBy(category).limit(examples)
    names = first.agg(F.sort_array(F.collect_list(category)).alias("non_canonical_examples"))  # so many names at most
    return _micro(sums).join(strange.agg(F.coalesce(F.sum("said"), F.lit(0)).alias("non_canonical_count")).join(names))


def validity(outputs: DataFrame, output: str) -> DataFrame:
    """valid, total and rate of outputs that are JSON objects; the rate of none is 0."""
    counts = outputs.agg(F.count_if(json_object(F.col(output))).alias("valid"), F.count("*").alias("total"))
    return counts.withColumn("rate", share(F.col("valid"), F.col("total")))


def failure_examples(outputs: DataFrame, order: str, output: str, examples: int = FAILURE_EXAMPLES) -> DataFrame:
    """The first outputs, in order, that are no JSON object, cut to 300 characters."""
    bad = outputs.where(~json_object(F.col(output))).orderBy(order).limit(examples)
    return bad.select(F.col(order).alias("example_index"), F.lit("unparseable JSON").alias("reason"), F.left(F.col(output), F.lit(300)).alias("output"))


def match_kind(expected: Column, got: Column) -> Column:
    """exact (two nulls are), missing, hallucinated or wrong."""
    return (
        F.when(expected.eqNullSafe(got), "exact").when(got.isNull(), "missing").when(expected.isNull(), "hallucinated").otherwise("wrong")
    )


def dosage_matches(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """patient_id, name, expected, predicted, kind: medications of both sides, matched by patient and name.

    predicted: patient_id, name, dosage. truth: patient_id, name, dosage, ord; of several the last counts.
    """
    facts = truth.groupBy("patient_id", "name").agg(F.max_by(F.struct("dosage"), "ord").alias("f"))
    both = predicted.join(facts, ["patient_id", "name"])
    kind = match_kind(F.col("f.dosage"), F.col("dosage")).alias("kind")
    return both.select("patient_id", "name", F.col("f.dosage").alias("expected"), F.col("dosage").alias("predicted"), kind)


def dosage_summary(matches: DataFrame) -> DataFrame:
    """exact_match, total, accuracy and hallucinated."""
    counts = matches.agg(
        F.count_if(F.col("kind") == "exact").alias("exact_match"), F.count("*").alias("total"), F.count_if(F.col("kind") == "hallucinated").alias("hallucinated")
    )
    return counts.withColumn("accuracy", share(F.col("exact_match"), F.col("total")))


def json_object(text: Column) -> Column:
    """Whether a text is a JSON object."""
    return _object(text, F.try_parse_json(text))


def gate_metrics(valid: DataFrame, diagnosis: DataFrame, medication: DataFrame) -> DataFrame:
    """check, value of the release gate, from validity() and two score_summary()."""
    strange = diagnosis.select("non_canonical_count").union(medication.select("non_canonical_count")).agg(F.sum("non_canonical_count").cast("double"))
    parts = [
        valid.select(F.lit("json_validity_rate").alias("check"), F.col("rate").alias("value")),
        diagnosis.select(F.lit("diagnosis_micro_f1"), "micro_f1"),
        medication.select(F.lit("medication_micro_f1"), "micro_f1"),
        strange.select(F.lit("non_canonical_total"), "*"),
    ]
    return reduce(DataFrame.union, parts)


def release_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """check, value, bound, passed, and all_passed, the same on each row.

    metrics: check, value; thresholds: check, direction (>= or <=), bound. A metric that is missing fails.
    """
    passed = F.when(F.col("direction") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    checks = thresholds.join(metrics, "check", "left").select("check", F.round("value", 4).alias("value"), "bound", F.coalesce(passed, F.lit(False)).alias("passed"))
    return checks.withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy(F.lit(1))))  # a handful of checks
