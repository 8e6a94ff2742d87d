"""Class balance: counts, templates, oversampling to the largest class, deficits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_counts(records: DataFrame, record: str, category: str) -> DataFrame:
    """How many records have each category; a record counts once."""
    return records.select(record, category).distinct().groupBy(category).agg(F.count("*").alias("n"))


def deficits(counts: DataFrame, vocabulary: DataFrame, category: str) -> DataFrame:
    """What each category of the vocabulary lacks to the largest count, where it lacks any."""
    most = counts.agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    lack = most - F.coalesce("n", F.lit(0))
    return vocabulary.join(counts, category, "left").select(category, lack.alias("needed")).where("needed > 0")


def duplicates_needed(records: DataFrame, categories: DataFrame, record: str, category: str, order: str) -> DataFrame:
    """category, template, n_copies: how often the first record of each category is repeated to level the counts.

    Categories go in the order of ``place``; copies made for earlier ones count for later ones too. The state of that
    sequence is one number for each category of the closed vocabulary, so it is folded over an array of them.
    records: record, category, order. categories: category, place.
    """
    counts = category_counts(records, record, category)
    templates = records.groupBy(category).agg(F.min_by(record, order).alias("template"))
    held = records.select(F.col(record).alias("template"), category).distinct()
    bundle = (
        templates.join(categories, category)
        .join(held.groupBy("template").agg(F.collect_set(category).alias("also")), "template")
        .join(counts, category)
        .select("place", category, "template", "also", "n")
    )
    steps = bundle.agg(F.sort_array(F.collect_list(F.struct("place", category, "template", "also", "n"))).alias("steps"))
    target = F.array_max(F.transform("steps", lambda s: s["n"]))
    kind = records.schema[category].dataType.simpleString()
    key = records.schema[record].dataType.simpleString()
    done = F.array().cast(f"array<struct<category:{kind},template:{key},also:array<{kind}>,n_copies:bigint>>")

    def step(done, s):
        earlier = F.aggregate(F.filter(done, lambda d: F.array_contains(d["also"], s[category])), F.lit(0).cast("long"), lambda a, d: a + d["n_copies"])
        lack = F.greatest(F.lit(0).cast("long"), target - s["n"] - earlier)
        return F.array_append(done, F.struct(s[category].alias("category"), s["template"].alias("template"), s["also"].alias("also"), lack.alias("n_copies")))

    folded = steps.select(F.explode(F.aggregate("steps", done, step)).alias("d"))
    return folded.select(F.col("d.category").alias(category), "d.template", "d.n_copies")


def duplicate_rows(needed: DataFrame, category: str) -> DataFrame:
    """A row for each copy, with its number among all copies of its template."""
    each = needed.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return each.withColumn("dup", F.row_number().over(Window.partitionBy("template").orderBy(category, "copy"))).drop("n_copies")


def duplicated_records(records: DataFrame, copies: DataFrame, record: str) -> DataFrame:
    """The copies as records: those of duplicate_rows() with all columns of their template, named <template>-dup<number>, and
    rebalance_duplicate_of, the record that they are copies of."""
    named = F.concat(F.col(record).cast("string"), F.lit("-dup"), F.col("dup").cast("string"))
    joined = records.join(copies.select(F.col("template").alias(record), "dup"), record)
    return joined.select(named.alias(record), *[c for c in records.columns if c not in (record, "rebalance_duplicate_of")], F.col(record).cast("string").alias("rebalance_duplicate_of"))


def rebalanced(records: DataFrame, copies: DataFrame, record: str) -> DataFrame:
    """records and their copies; rebalance_duplicate_of is null for records that aren't copies."""
    own = records.withColumn(record, F.col(record).cast("string"))
    if "rebalance_duplicate_of" not in own.columns:
        own = own.withColumn("rebalance_duplicate_of", F.lit(None).cast("string"))
    return own.unionByName(duplicated_records(records, copies, record))
