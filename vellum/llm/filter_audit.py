"""How filters interact: what each of them removes in every order in which they could be applied.

A document's failures are a mask with a bit for each filter. Spark counts the masks of every part; a part has 2 to the power
of the number of filters at most, whatever its documents. Within a part the masks make a decision diagram: a level for each filter, at each
node an edge for passing and one for failing, and the counts of the documents that come this way as its weight; equal subdiagrams are one
node. Neighbouring levels are swapped, one pair at a time, until every order has been on top of the diagram once (Steinhaus, Johnson
and Trotter's sequence: each order is one swap away from the last). In each order the steps are read along the path on which all
filters pass: what fails at a level is removed by that step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.shared import stored, table, words

FILTERS = "ABCDE"
MARKS = "[#$%&*|]"

Counts = tuple[int, ...]


class Diagram:
    """A quasi-reduced decision diagram with counts (all, good, toxic) as weights.

    A node is (filter, pass, fail); node 0 to the number of terminals are counts. Nodes are kept in one table, so that equal ones are shared.
    """

    def __init__(self, masks: dict[int, Counts], n_filters: int, zero: Counts = (0, 0, 0)):
        self.nodes: list[tuple[int, int, int]] = []
        self.weights: list[Counts] = []
        self.known: dict[tuple, int] = {}
        self.order = list(range(n_filters))
        self.zero = zero
        self.root = self.build(masks, 0, 0)

    def terminal(self, counts: Counts) -> int:
        return self.add((-1, *counts), (-1, 0, 0), counts)

    def node(self, variable: int, passing: int, failing: int) -> int:
        weight = tuple(a + b for a, b in zip(self.weights[passing], self.weights[failing], strict=True))
        return self.add((variable, passing, failing), (variable, passing, failing), weight)

    def add(self, name: tuple, node: tuple[int, int, int], weight: Counts) -> int:
        if name not in self.known:
            self.known[name] = len(self.nodes)
            self.nodes.append(node)
            self.weights.append(weight)
        return self.known[name]

    def build(self, masks: dict[int, Counts], level: int, mask: int) -> int:
        if level == len(self.order):
            return self.terminal(masks.get(mask, self.zero))
        return self.node(level, self.build(masks, level + 1, mask), self.build(masks, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Swaps a level with the one below it. Nodes below both stay as they are."""
        above, below = self.order[level : level + 2]
        self.order[level : level + 2] = below, above
        done: dict[int, int] = {}

        def renewed(node: int, at: int) -> int:
            if node not in done:
                variable, passing, failing = self.nodes[node]
                if at < level:
                    done[node] = self.node(variable, renewed(passing, at + 1), renewed(failing, at + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = self.nodes[passing], self.nodes[failing]
                    done[node] = self.node(below, self.node(above, pp, fp), self.node(above, pf, ff))
            return done[node]

        self.root = renewed(self.root, 0)

    def steps(self) -> Iterator[tuple[int, Counts, Counts, Counts]]:
        """Along the all-pass path: each filter, the weights of what it keeps and removes, and of what fails at it alone."""
        at = self.root
        while self.nodes[at][0] >= 0:
            variable, passing, failing = self.nodes[at]
            alone = failing
            while self.nodes[alone][0] >= 0:
                alone = self.nodes[alone][1]
            yield variable, self.weights[passing], self.weights[failing], self.weights[alone]
            at = passing


def swaps(n: int) -> Iterator[int]:
    """Levels to swap with the one below, one after another, so that all orders of n come up once."""
    if n < 2:
        return
    down = True
    inner = swaps(n - 1)
    while True:  # the last element walks through the others, which take a step when it stands at an end
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def audited(masks: dict[int, Counts], names: str) -> Iterator[tuple]:
    """order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of each order and step."""
    diagram = Diagram(masks, len(names))
    found = []
    failing, total = [0] * len(names), [0] * len(names)

    def read() -> None:
        said = "".join(names[v] for v in diagram.order)
        for step, (variable, kept, removed, alone) in enumerate(diagram.steps(), 1):
            total[variable] += removed[0]
            if step == 1:
                failing[variable] = removed[0]
            found.append((said, step, variable, kept[0], removed, alone[0]))

    read()
    for level in swaps(len(names)):
        diagram.swap(level)
        read()
    for said, step, v, kept, removed, alone in found:
        yield said, step, kept, removed[0], failing[v] - removed[0], alone, removed[1], removed[2], total[v]


COUNTED = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_batches(names: str):
    """Of batches of (part, masks): a row for each order and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(audited({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}, names))
                columns = [pa.array([part] * len(rows)), *(pa.array(c) for c in zip(*rows, strict=True))]
                columns[2] = columns[2].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTED])

    return run


def audit_filters(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step and counts, for every order of the filters, from masks: a row (part, mask, good, toxic) for each document.

    Bit k of mask is set if the document fails filter k of names. good and toxic are booleans. Masks are counted by part before they meet, so
    a part with most of all documents is no more work than another. No documents give no parts and an empty result.
    """
    number = lambda c: F.count_if(F.col(c)).alias(c)
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), number("good"), number("toxic"))
    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2 ** len(names) at most
    return gathered.mapInArrow(audit_batches(names), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTED))


def failure_mask() -> Column:
    """Filters A to D of text and its words: few words, repeated words, capitals, marks."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length("text"), F.col("text").rlike(MARKS)]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each row of docs (doc_id, text, source); filter E fails if a smaller doc_id has the same text.

    part is the source, '' for null. A null text counts as empty, and equals other empty ones. A row without doc_id has no
    labels and isn't E's failure, nor does it make others fail; rows of one doc_id and text don't fail through each other. A doc_id with
    several labels is good or toxic if one of them says so. Other columns aren't read.
    """
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    measured = read.withColumn("words", words(F.col("text"))).select(
        "doc_id", "part", failure_mask().alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    measured = stored(measured, "masks")
    named = measured.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    said = labels.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))))
    judged = named.join(first, "digest").join(said, "doc_id", "left")
    repeated = F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    bare = measured.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return judged.select("part", (F.col("mask") + repeated).alias("mask"), yes("good"), yes("toxic")).union(bare)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = """
WITH read AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM read LEFT JOIN said USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, 1 << (ord(filter_order[step]) - 65) AS bit,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ord(filter_order[i]) - 65))), 0) AS BIGINT) AS earlier
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
audit AS (
  SELECT part, filter_order, step, letter,
    sum(n) FILTER (mask & (earlier | bit) = 0) AS kept,
    sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS good_lost,
    sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM audit
"""
