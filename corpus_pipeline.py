"""The corpus pipeline: documents pass the stages one after another; each reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (and any others that docs has),
but for the last, which returns the mix: those columns, and how often each document is taken. Rows are told apart by SHA-256
of doc_id and text; helper columns get names that docs doesn't have. An empty table passes every stage as an empty one. Null
and blank texts: the quality rules reject them; the n-gram join, decontamination and PII keep them as they are; the mix
takes none of them, as they have no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.decontaminate import decontaminate
from vellum.llm.jaccard import join_ngrams
from vellum.llm.mixing import mix_sized, size_of, text_hash
from vellum.llm.pii import redact
from vellum.llm.quality import judge_quality
from vellum.llm.shared import fresh, row_key, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows of one doc_id and text share a verdict, and all of them stay or go."""
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    kept = judge_quality(keyed, key).where("kept").select(key).distinct()
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def with_node(docs: DataFrame, node: str) -> DataFrame:
    """docs with a number for each row, in the order of doc_id, nulls last: doc_id itself if it names every row, else
    numbers given in the order of doc_id, then of what the row says."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or doc_id is null").limit(1).count():
        return docs.withColumn(node, F.col("doc_id").cast("long"))
    said = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), row_key(), said)
    return stored(ordered.withColumn(node, F.monotonically_increasing_id()), "numbered")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id, null last; of rows of that id, one that reruns choose too.

    Rows are linked by text alone: two texts of one doc_id are two documents, and rows without doc_id are linked like others.
    A text without words is linked with nothing and stays.
    """
    node = fresh(docs, "node")
    numbered = with_node(docs, node)
    groups = join_ngrams(numbered.select(F.col(node).alias("doc_id"), "text"))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(node))
    return numbered.join(first, node, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in text replaced by its kind."""
    return redact(docs)


#: What the mix adds; columns of docs with these names give way to them.
MIXED = ["size", "source_size", "target", "copies", "taken"]


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies and taken words.

    Rows of one doc_id, source and text are one document, and one of them is returned.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key("source"))
    sizes = keyed.select(key, "doc_id", "source", size_of("text").alias("size"), text_hash().alias("salt"))
    mixed = mix_sized(stored(sizes.dropDuplicates([key]), "mix-sizes"), key).where("copies > 0").select(key, *MIXED)
    named = [c for c in docs.columns if c.lower() not in MIXED]
    return keyed.select(*named, key).join(mixed, key).dropDuplicates([key]).select(*named, *MIXED)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources", mixing_stage),
]

#: Estimation by iteration, components and bootstrapping aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
