"""The analytics fact table and its three named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_records(splits: dict[str, DataFrame]) -> DataFrame:
    """A row for each record and diagnosis, with sizes, confidence and whether the record is a copy.

    Each split holds patient_id, diagnoses (array of struct name), medications, vitals, confidence, rebalance_duplicate_of.
    """
    tagged = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return every.select(
        "patient_id",
        "split",
        F.explode("diagnoses.name").alias("diagnosis"),
        *(F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"n_{c}") for c in ("diagnoses", "medications", "vitals")),
        "confidence",
        F.col("rebalance_duplicate_of").isNotNull().alias("is_rebalance_duplicate"),
    )


def prevalence(facts: DataFrame) -> DataFrame:
    """Distinct patients and mean confidence of each diagnosis, the most frequent first."""
    by = facts.groupBy("diagnosis").agg(F.countDistinct("patient_id").alias("patients"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
    return by.orderBy(F.desc("patients"), "diagnosis")


def split_distribution(facts: DataFrame) -> DataFrame:
    """Rows, distinct patients and copies of each split, the largest first."""
    copies = F.count_if("is_rebalance_duplicate").alias("rebalance_dupes")
    by = facts.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("patient_id").alias("patients"), copies)
    return by.orderBy(F.desc("rows"), "split")


def comorbidity(facts: DataFrame) -> DataFrame:
    """Mean number of diagnoses and medications of the records that have each diagnosis, the heaviest first."""
    means = [F.round(F.avg(c), 2).alias(name) for c, name in (("n_diagnoses", "avg_dx_per_record"), ("n_medications", "avg_meds"))]
    return facts.groupBy("diagnosis").agg(*means).orderBy(F.desc("avg_dx_per_record"), "diagnosis")


def query_facts(facts: DataFrame, sql: str, view: str = "tbl") -> DataFrame:
    """The answer of a SQL text over the facts, which it names as a view."""
    facts.createOrReplaceTempView(view)
    return facts.sparkSession.sql(sql)
