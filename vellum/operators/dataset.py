"""Data sets for training: splits that keep groups whole, leakage, formatting, a frozen gold set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.vocabulary import SPLITS
from vellum.operators.relational import numbered


def original_patient() -> Column:
    """The patient that a record belongs to: the one it is a copy of, if it is a copy."""
    return F.coalesce("rebalance_duplicate_of", "patient_id")


def eligible(records: DataFrame) -> DataFrame:
    """Records that were not synthesized; those have no note to learn from."""
    return records.where(~F.coalesce(F.col("synthesized"), F.lit(False)))


def group_sizes(records: DataFrame, order: str) -> DataFrame:
    """patient, n, first: original patients of eligible records, their number of records and their first place."""
    return eligible(records).groupBy(original_patient().alias("patient")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def build_splits(records: DataFrame, order: str, store: Callable[[DataFrame], DataFrame], splits: list[tuple[str, float]] = SPLITS) -> DataFrame:
    """Eligible records with split; no original patient is in two. records: patient_id, rebalance_duplicate_of, synthesized, order."""
    assigned = split_groups(group_sizes(records, order), "patient", store, splits).select("patient", "split")
    return eligible(records).join(assigned, original_patient() == F.col("patient")).drop("patient")


def phases(n: int, counts: list[int], targets: list[float]) -> list[tuple[int, list[int]]]:
    """How groups of n records are dealt when counts are what the splits have: (first group, splits in turn) of each phase.

    A split that has been chosen j times lacks target - (count + j n), and the split that lacks most is next, of equal ones the first.
    So at first the neediest split is chosen alone; once it lacks no more than the second these two take turns, and so on, until all do: every turn
    takes n from each, so their order stays.
    """
    lack = lambda s, j: (-(targets[s] - (counts[s] + j * n)), s)
    order = sorted(range(len(counts)), key=lambda s: lack(s, 0))
    chosen, found, start = [0] * len(counts), [], 0
    for i in range(1, len(order) + 1):
        turns = sorted(order[:i], key=lambda s: lack(s, chosen[s]))
        found.append((start, turns))
        if i == len(order):
            return found
        for s in turns:  # how often, until the next split's first turn
            far = chosen[s] + max(0, int((targets[s] - (counts[s] + chosen[s] * n) - (targets[order[i]] - counts[order[i]])) // n) - 1)
            while lack(s, far) < lack(order[i], 0):
                far += 1
            start += far - chosen[s]
            chosen[s] = far


def dealt(m: int, found: list[tuple[int, list[int]]], n_splits: int) -> list[int]:
    """How many of m groups each split gets."""
    made = [0] * n_splits
    for (start, turns), end in zip(found, [start for start, _ in found[1:]] + [m], strict=True):
        size = max(0, min(end, m) - start)
        for place, s in enumerate(turns):
            made[s] += (size - place + len(turns) - 1) // len(turns)
    return made


def class_batches(total: int, splits: list[tuple[str, float]]):
    """Of batches of (n, m), the largest size first: (n, before, phases). What it keeps from row to row is what the splits have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, before = [0] * len(splits), 0
        targets = [total * share for _, share in splits]
        for batch in batches:
            rows = []
            for n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = phases(n, counts, targets)
                rows.append((n, before, [{"start": start, "turns": [splits[s][0] for s in turns]} for start, turns in found]))
                counts = [c + n * k for c, k in zip(counts, dealt(m, found, len(splits)), strict=True)]
                before += m
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("turns", pa.list_(pa.string()))]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["n", "before", "phases"])

    return run


def split_groups(sizes: DataFrame, group: str, store: Callable[[DataFrame], DataFrame], splits: list[tuple[str, float]] = SPLITS) -> DataFrame:
    """group, n, split: whole groups, the largest first, each to the split that is furthest below its share.

    sizes: group, n, first (the order of appearance, those without come last). Groups of one size are alike, and are dealt in at most as many phases as there are
    splits, each of which repeats itself; the phases of the distinct sizes are found in one pass over these, which are no more than the
    root of twice the records. A group finds its split from its rank among those of its size. Groups are numbered by range
    partitions (store() materialises them), so no size meets in one task.
    """
    ordered = numbered(sizes.withColumn("_less", -F.col("n")), ["_less", F.asc_nulls_last("first")], "_place", store)
    classes = sizes.groupBy("n").agg(F.count("*").alias("m"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    one = classes.coalesce(1).sortWithinPartitions(F.desc("n"))
    folded = one.select(F.col("n").cast("long").alias("n"), "m").mapInArrow(class_batches(total, splits), "n long, before long, phases array<struct<start:bigint,turns:array<string>>>")
    rank = F.col("_place") - 1 - F.col("before")
    phase = F.element_at(F.filter("phases", lambda p: p["start"] <= rank), -1)
    chosen = F.get(phase["turns"], ((rank - phase["start"]) % F.size(phase["turns"])).cast("int"))
    return ordered.join(F.broadcast(folded), "n").select(group, "n", chosen.alias("split"))


def crossing_groups(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def split_shares(rows: DataFrame) -> DataFrame:
    whole = Window.partitionBy(F.lit(1))
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(whole), 4))


#: The clinical fields of a record, which a response says; all others are bookkeeping.
RESPONSE = ["diagnoses", "medications", "vitals"]


def format_records(records: DataFrame, notes: DataFrame, *keep: str) -> DataFrame:
    """instruction and response of each record, and the columns in keep: its note's text, and its clinical fields as JSON, nulls kept.

    A record whose note isn't there is an error that names it. Copies of a record share its note.
    """
    response = F.to_json(F.struct(*RESPONSE), {"ignoreNullFields": "false"})
    said = records.select(*{"note_id": None, **dict.fromkeys(keep)}, response.alias("response"))  # texts are joined, not the lists that they are made of
    found = said.join(notes.select("note_id", F.col("text").alias("instruction")), "note_id", "left")
    lost = F.raise_error(F.concat(F.lit("no note for note_id "), F.coalesce("note_id", F.lit("null"))))
    return found.select(*keep, F.when(F.col("instruction").isNull(), lost).otherwise(F.col("instruction")).alias("instruction"), "response")


#: What the loss leaves out.
MASKED = -100


def training_batches(examples: DataFrame, key: str, store: Callable[[DataFrame], DataFrame], budget: int, width: int = 64, seed: int = 7, pad: int = 0) -> DataFrame:
    """key, bucket, batch, input_ids, labels, attention_mask of examples (key, input_ids, n_prompt), padded to their batch's longest.

    Examples of like length (in steps of width) make a bucket, and within a bucket follow each other in an order that seed and key give. A batch
    holds as many as fit the budget of tokens when all are as long as the bucket allows, but one at least. Labels of the prompt and of padding are masked.
    Examples whose ids are null lie in the first bucket and stay null; those without a key come last.
    """
    length = F.array_size("input_ids")
    bucketed = examples.select(key, "input_ids", "n_prompt").withColumns(
        {"bucket": F.floor(F.greatest(length - 1, F.lit(0)) / width).cast("int"), "_order": F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))}
    )
    placed = numbered(bucketed, ["bucket", F.asc_nulls_last("_order")], "_place", store)
    firsts = placed.groupBy("bucket").agg(F.min("_place").alias("_first"))  # a row for each step of length
    size = F.greatest(F.floor(F.lit(budget) / ((F.col("bucket") + 1) * width)), F.lit(1))
    batched = placed.join(F.broadcast(firsts), "bucket").withColumn("batch", F.floor((F.col("_place") - F.col("_first")) / size).cast("long"))
    longest = F.max(length).over(Window.partitionBy("bucket", "batch"))
    fill = lambda what: F.array_repeat(F.lit(what), F.col("_longest") - length)
    labels = F.transform("input_ids", lambda x, i: F.when(i < F.col("n_prompt"), MASKED).otherwise(x))
    return batched.withColumn("_longest", longest).select(
        key,
        "bucket",
        "batch",
        F.concat("input_ids", fill(pad)).alias("input_ids"),
        F.concat(labels, fill(MASKED)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), length), fill(0)).alias("attention_mask"),
    )


#: Digests that are digested together.
BLOCK = 4096


def frozen(examples: DataFrame, order: str, content: Column, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """n_examples and sha256 of the examples: digests in order, digested by blocks of BLOCK, and so on until one is left.

    Up to BLOCK examples that is the digest of their digests. No examples have the digest of the empty text.
    """
    digests = numbered(examples.select(F.col(order).alias("_o"), F.sha2(content, 256).alias("d")), ["_o", "d"], "i", store).select("i", "d")
    n = n_examples = digests.count()
    while True:
        blocks = digests.groupBy(F.floor((F.col("i") - 1) / BLOCK).alias("b"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), "")
        digests = blocks.agg(F.sha2(joined, 256).alias("d")).select((F.col("b") + 1).alias("i"), "d")
        n = -(-n // BLOCK)
        if n <= 1:
            return digests.agg(F.lit(n_examples).cast("long").alias("n_examples"), F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("sha256"))


def gold_manifest(examples: DataFrame, order: str, content: Column, version: str, source: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """version, n_examples, sha256, source."""
    return frozen(examples, order, content, store).select(F.lit(version).alias("version"), "n_examples", "sha256", F.lit(source).alias("source"))


def freeze(examples: DataFrame, order: str, path: str) -> DataFrame:
    """Writes the examples as JSON lines whose files follow the order, and returns them as read back, with their place."""
    examples.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return examples.sparkSession.read.schema(examples.schema).json(path)


def verified(examples: DataFrame, order: str, content: Column, manifest: DataFrame, store: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether examples still have the number and the digest that their manifest says."""
    said = manifest.select("n_examples", "sha256")
    return frozen(examples, order, content, store).join(said, ["n_examples", "sha256"]).limit(1).count() == 1
