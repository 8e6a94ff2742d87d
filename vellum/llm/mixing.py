"""Mixing sources to target weights by systematic sampling.

Targets are found by pouring the corpus' words over the sources by weight until none holds more than it
may. Each document of a source then has the same expected number of copies; these are prefix-summed in a
fixed order, one random offset for each source is added, and a document is emitted once for each integer that its
step crosses. The order puts documents of like size together, so a source's words come near its target.

The prefix sum takes three levels: sources are cut into hash cells of about ``CELL`` documents, rows are
numbered within cells, and cells are offset by the counts of those before, in their block and in blocks before. No task holds
a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.shared import WORD, stored, table

CELL = 2048
#: Cells that are offset together: their sums are taken within blocks, then over the blocks of a source.
BLOCK = 1024
WEIGHTS = [5, 2, 1]
MOST = 3


def source_targets(sized: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source_size, n_docs, target.

    Sources in code point order, null last, take the weights in turn and share 100% of all words; a
    target stops at ``most`` times its source's size, the excess goes to the others by weight. Sources are
    filled up in the order of size by weight; a source is full if its fair share of what is left exceeds what it may hold.
    The table of sources is the only thing numbered in one task.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weighted = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / weight_left
    room = F.col("source_size") * F.lit(most)
    # levels mean something up to the first source that isn't full; it and all behind it share at its level
    is_open = level * F.col("weight") <= room
    open_so_far = F.sum(F.col("open").cast("int")).over(filling.rowsBetween(Window.unboundedPreceding, 0)) > 0
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        weighted.withColumns({"open": is_open, "level": level, "room": room.cast("double")})
        .withColumns({"sharing": open_so_far, "final": final})
        .select(
            "source",
            "source_size",
            "n_docs",
            F.when(F.col("sharing"), F.least(F.col("final") * F.col("weight"), "room")).otherwise(F.col("room")).alias("target"),
        )
    )


def fraction(text, seed: int):
    """A number in [0, 1) that depends on text and seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix_sources(docs: DataFrame, *keep: str, seed: int = 7, weights: list[int] = WEIGHTS, most: int = MOST, cell: int = CELL) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of docs (doc_id, text, source), and the columns in keep.

    A null text has size 0. A null source is a source of its own, the last. Repeated rows are documents
    of their own, as are rows with a null doc_id. A source without words has target 0 and no copies.
    Reruns agree: the offset and the cells are hashes (of doc_id, without it of the text), ties in the order are between equal rows. An empty table gives an empty result.
    """
    sized = stored(docs.select("doc_id", "source", *keep, size_of("text").alias("size"), text_hash().alias("salt")), "mix-sizes")
    return mix_sized(sized, *keep, seed=seed, weights=weights, most=most, cell=cell)


def size_of(text: str):
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash():
    """Deals rows without doc_id to cells; null for others."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def mix_sized(sized: DataFrame, *keep: str, seed: int = 7, weights: list[int] = WEIGHTS, most: int = MOST, cell: int = CELL) -> DataFrame:
    """mix_sources() of a stored table of doc_id, source, size, salt (text_hash()) and the columns in keep."""
    key = lambda side: [F.col(f"{side}.source").isNull(), F.coalesce(F.col(f"{side}.source"), F.lit(""))]
    same = lambda a, b: [x == y for x, y in zip(key(a), key(b), strict=True)]
    sources = source_targets(sized, weights, most).withColumns(
        {
            "step": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
            "offset": fraction(F.coalesce("source", F.lit("")), seed),
            "n_cells": F.ceil(F.col("n_docs") / cell).cast("long"),
        }
    )
    numbered = (
        sized.alias("d")
        .join(sources.alias("s"), same("d", "s"))
        .select("d.doc_id", "d.source", "d.size", "d.salt", *(f"d.{c}" for c in keep), "s.source_size", "s.target", "s.step", "s.offset", "s.n_cells")
        .withColumn("cell", F.floor(fraction(F.coalesce(F.col("doc_id").cast("string"), "salt", F.lit("")), seed) * F.col("n_cells")))
        .withColumn("n", F.row_number().over(Window.partitionBy("source", "cell").orderBy("size", "doc_id")))
    )
    counts = numbered.groupBy("source", "cell").agg(F.max("n").alias("n_cell")).withColumn("block", F.floor(F.col("cell") / BLOCK))
    blocks = counts.groupBy("source", "block").agg(F.sum("n_cell").alias("n_block"))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("earlier", F.coalesce(F.sum("n_block").over(ahead("source").orderBy("block")), F.lit(0)))
    within = F.coalesce(F.sum("n_cell").over(ahead("c.source", "c.block").orderBy("c.cell")), F.lit(0))
    cells = (
        counts.alias("c")
        .join(blocks.alias("b"), [*same("c", "b"), F.col("c.block") == F.col("b.block")])
        .select("c.source", "c.cell", (F.col("b.earlier") + within).alias("earlier"))
    )
    place = F.col("c.earlier") + F.col("d.n")
    upto = lambda k: F.floor(k * F.col("d.step") + F.col("d.offset"))
    return (
        numbered.alias("d")
        .join(cells.alias("c"), [*same("d", "c"), F.col("d.cell") == F.col("c.cell")])
        .select("d.doc_id", "d.source", "d.size", *(f"d.{c}" for c in keep), "d.source_size", "d.target", (upto(place) - upto(place - 1)).alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS named,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
weighted AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS room,
    row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS place,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted
  WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sources AS (
  SELECT source, source_size, n_docs,
    CASE WHEN place < min(place) FILTER (level * weight <= room) OVER () THEN CAST(room AS DOUBLE)
      ELSE least((SELECT arg_min(level, place) FROM levels WHERE level * weight <= room) * weight, room) END AS target
  FROM levels),
steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
    CAST('0x' || md5('7:' || coalesce(source, ''))[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS offs,
    ceil(n_docs / 2048) AS n_cells
  FROM sources),
numbered AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.step, s.offs,
    row_number() OVER (PARTITION BY d.source ORDER BY
      floor(CAST('0x' || md5('7:' || d.named)[1:8] AS BIGINT) / 4294967296.0::DOUBLE * s.n_cells),
      d.size, d.doc_id) AS n
  FROM sized d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(n * step + offs) - floor((n - 1) * step + offs)) * size AS BIGINT) AS taken
FROM numbered
"""
