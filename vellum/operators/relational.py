"""Relational operators that the composites are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a task where much is made of each.
TASK_ROWS = 5000


def cogroup_nest(left: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """left with, for each part, the array of its rows of the same key; empty arrays where there are none; orphans go."""
    for name, part in parts.items():
        others = [c for c in part.columns if c != key]
        nested = part.groupBy(key).agg(F.collect_list(F.struct(*others)).alias(name))
        kind = nested.schema[name].dataType
        left = left.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return left


def lookup(facts: DataFrame, dim: DataFrame, on: list[str], columns: dict[str, object]) -> DataFrame:
    """Left join with a dimension; the given defaults stand for what is not found."""
    found = facts.join(dim.select(*on, *columns), on, "left")
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in columns.items() if v is not None})


def strict_lookup(facts: DataFrame, dim: DataFrame, on: str, column: str) -> DataFrame:
    """Left join with a dimension that fails on the first key that is not in it."""
    message = F.concat(F.lit(f"no {column} for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
    found = facts.join(dim.select(on, column), on, "left")
    return found.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(message)).otherwise(F.col(column)))


def longest_prefix(names: DataFrame, vocabulary: DataFrame, name: str, canonical: str) -> DataFrame:
    """names with the longest canonical name that each starts with, whatever the case, or null.

    The vocabulary is closed and small; its distinct lengths give the prefixes to look up, so this is an equi-join.
    """
    known = vocabulary.select(canonical, F.lower(canonical).alias("_prefix"), F.length(canonical).alias("_n"))
    lengths = known.agg(F.collect_set("_n")).scalar()
    distinct = names.select(name).distinct().withColumn("_n", F.explode(lengths))
    prefixes = distinct.where(F.length(name) >= F.col("_n")).withColumn("_prefix", F.lower(F.left(F.col(name), F.col("_n"))))
    best = prefixes.join(known.drop("_n"), "_prefix").groupBy(name).agg(F.max_by(canonical, "_n").alias(canonical))
    return names.join(best, name, "left")


def overlapping(spans: DataFrame, others: DataFrame, key: str, how: str) -> DataFrame:
    """Spans (key, start, end) that overlap (left_semi) or don't overlap (left_anti) one of the others of the same key."""
    a, b = spans.alias("a"), others.alias("b")
    meet = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, meet, how)


def latest(df: DataFrame, keys: list[str], when: Column, order: list[str]) -> DataFrame:
    """The latest row of each key: a missing time is the oldest, ties go to the later row."""
    last = Window.partitionBy(*keys).orderBy(when.desc_nulls_last(), *(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key in order; without keys of all rows.

    Each task keeps k rows of a key at most before anything is shuffled (a group limit, or a top-k), so what meets is bounded by k times the
    tasks, however many rows a key has. Ties in order are between rows that the caller doesn't tell apart.
    """
    if not keys:
        return df.orderBy(*order).limit(k)
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k).drop("_n")


def numbered(df: DataFrame, order: list[str | Column], name: str, store) -> DataFrame:
    """Numbers from 1 in the given order. Rows are range-partitioned, sorted and numbered where they are; parts are offset by
    the sizes of those before, of which there are as many as partitions. store(df) must materialise df."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # an id is the part's number, and behind it a row's place in 33 bits; kept with the rows, so that no part has to be gathered again
    parts = store(placed.select(*df.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place") + 1
    # chosen, not dropped: the number may have the name of one of the columns that it is made of
    return parts.join(F.broadcast(offsets), "_part").select(*(c for c in df.columns if c != name), number.alias(name))


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt out by key into tasks of about so many rows, counted first.

    Few bytes are read by few tasks, whatever is made of each row; this is for rows that much is made of.
    """
    return df.repartition(max(1, -(-df.count() // rows)), key)


def missing_from(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests that the cache has no answer to, once each."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def no_rows(failures: DataFrame, message: str) -> None:
    """Raises if there are any rows."""
    found = failures.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {found}")


def within(left: DataFrame, right: DataFrame) -> bool:
    """Whether every distinct row of left is a row of right."""
    return left.subtract(right).limit(1).count() == 0


def same_set(left: DataFrame, right: DataFrame) -> bool:
    """Whether both have the same distinct rows."""
    return within(left, right) and within(right, left)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in order, without nulls."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
