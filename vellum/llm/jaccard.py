"""N-gram Jaccard join: candidates must share prefix tokens under several global token orders.

Documents are sets of word shingles (tokens); equal sets are joined as one. If two sets reach the threshold t, then
under any order of all tokens both hold a common token among their first p = n - ceil(t n) + 1. Three orders are used:

* Frequent tokens last. Tokens are ordered by hash, but those that many lists hold come after all others. Of each
  set a list of the first p and some more tokens by hash is taken; a token that HEAVY lists or more hold is heavy. A set with p
  light tokens in its list before it meets too many heavy ones is light. If at least one set of a pair is light, the pair's
  first common light token is in both lists; so these pairs come from tokens with fewer than HEAVY postings.
* The other sets are dense: large groups of near copies, or made of common passages. Pairs of dense sets share prefix
  tokens under the order by exact frequency among dense sets. Their groups are not expanded into pairs: for each token, members are linked
  to pivots in a few rounds, and only pairs that still lie in different components are compared.
* Candidates of either kind must also share prefix tokens under two more orders, before they are verified on whole sets.

Results are exact but for chance equality of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.hashing import mixed, shingle_sets
from vellum.llm.shared import pieces, sized, stored, table

HEAVY = 40
PIVOT_ROUNDS = 3
#: Percent of a set that its list holds beyond the prefix.
MORE = 6
#: Fixed: what tokens are xored with under the second and third order.
SEEDS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def prefix_length(n: int, percent: int) -> int:
    """How many tokens of n must be looked at so that one that a partner shares is among them."""
    return n - (n * percent + 99) // 100 + 1


def prefix_column(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def both_share(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many tokens linked sets of these sizes have in common at least."""
    return F.ceil((n_a + n_b) * percent / (100 + percent))


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def set_number(digest: bytes) -> int:
    """Tells apart the sets of one doc_id."""
    return int.from_bytes(digest[:8], "little", signed=True)


def set_rows(width: int, percent: int):
    """Of batches of (doc_id, text): doc_id, number of tokens, digest of the set, its number, list of first tokens by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, digests, own, lists = [], [], [], []
            for tokens in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(tokens))
                digest = set_digest(tokens)
                digests.append(digest.hex() if len(tokens) else None)
                own.append(set_number(digest))
                lists.append(tokens[: prefix_length(len(tokens), percent) + len(tokens) * MORE // 100])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(own, pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "digest", "own", "list"],
            )

    return run


def whole_sets(width: int, percent: int):
    """Of batches of (doc_id, text): node, n, own, tokens (all, 8 bytes each), and prefixes under the other orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, own, whole, others = [], [], [], [[], []]
            for tokens in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(tokens))
                own.append(set_number(set_digest(tokens)))
                whole.append(tokens.tobytes())
                p = prefix_length(len(tokens), percent)
                for seed, out in zip(SEEDS, others, strict=True):
                    out.append(np.sort(mixed(tokens.view(np.uint64) ^ seed))[:p].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in others]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(whole, pa.binary()), *lists],
                ["node", "n", "own", "tokens", "second", "third"],
            )

    return run


def linked_pairs(percent: int):
    """Of batches of (a, b, tokens_a, tokens_b): the pairs whose Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that are linked; first by the other orders' prefixes, then by whole sets."""
    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
    sets = sets.join(sized(nodes), "node", "left_semi")
    orders = sets.select("node", "n", "second", "third")
    x, y = orders.alias("x"), orders.alias("y")
    share = lambda order: F.arrays_overlap(f"x.{order}", f"y.{order}")
    alike = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    left = stored(
        pairs.join(x, F.col("a") == F.col("x.node"))
        .join(y, F.col("b") == F.col("y.node"))
        .where(alike & share("second") & share("third"))
        .select("a", "b")
        .distinct(),
        "filtered",
    )
    tokens = sets.select("node", "tokens")
    both = (
        left.join(tokens.withColumnsRenamed({"node": "a", "tokens": "tokens_a"}), "a")
        .join(tokens.withColumnsRenamed({"node": "b", "tokens": "tokens_b"}), "b")
        .select("a", "b", "tokens_a", "tokens_b")
    )
    return both.mapInArrow(linked_pairs(percent), "a long, b long").distinct()


def light_candidates(reps: DataFrame, percent: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) with a light member, and the dense nodes. reps: node, n, own, list."""
    postings = reps.select("node", "n", "own", F.posexplode("list").alias("rank", "token"))
    frequent = postings.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    shared = postings.join(frequent, "token")
    before = Window.partitionBy("node", "own").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    p = prefix_column(F.col("n"), percent)
    placed = stored(
        shared.withColumn("heavy", F.col("f") >= heavy)
        .withColumn("light_rank", F.col("rank") - F.coalesce(F.sum(F.col("heavy").cast("int")).over(before), F.lit(0)))
        .select("node", "n", "own", "token", "rank", "light_rank", "heavy"),
        "postings",
    )
    # a set is dense if more of its tokens are heavy, before its p-th light one, than any partner's list has to spare
    spare = F.floor(F.floor(F.col("n") * percent / 100) * MORE / 100)
    dense = (
        placed.where(F.col("heavy") & (F.col("light_rank") < p))
        .groupBy("node", "n", "own")
        .agg(F.count("*").alias("heavies"))
        .where(F.col("heavies") > spare)
        .select("node")
        .distinct()
    )
    light = placed.where(~F.col("heavy") & (F.col("light_rank") < p)).select("token", "node", "n")
    x, y = light.alias("x"), light.alias("y")
    alike = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & alike)
    counted = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).agg(
        F.count("*").alias("shared")
    )
    # of two light sets that are linked, each lacks few of the other's tokens; so all but as many of their prefixes are shared
    both = both_share(F.col("n_a"), F.col("n_b"), percent)
    least = F.least(*(prefix_column(F.col(n), percent) - (F.col(n) - both) for n in ("n_a", "n_b")))
    dense = stored(dense, "dense")
    flags = sized(dense).withColumn("dense", F.lit(True))
    flagged = counted.join(flags.withColumnsRenamed({"node": "a", "dense": "dense_a"}), "a", "left").join(
        flags.withColumnsRenamed({"node": "b", "dense": "dense_b"}), "b", "left"
    )
    kept = flagged.withColumn("least", least).where("dense_a or dense_b or shared >= least")
    return kept.select("a", "b").distinct(), dense


def dense_postings(sets: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """token, node, n, rank, rare: prefix postings of dense sets under the order by frequency among them."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *row, whole in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                each = np.frombuffer(whole, np.int64)
                same = [pa.array(np.full(len(each), x)) for x in row]
                yield pa.RecordBatch.from_arrays([pa.array(each), *same], ["token", "node", "n", "own"])

    postings = sets.join(dense, "node", "left_semi").select("node", "n", "own", "tokens").mapInArrow(tokens, "token long, node long, n long, own long")
    frequency = postings.groupBy("token").agg(F.count("*").alias("f"))
    order = Window.partitionBy("node", "own").orderBy("f", "token")
    ranked = postings.join(frequency, "token").withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("rare", F.sum((F.col("f") == 1).cast("int")).over(Window.partitionBy("node", "own")) / F.col("n"))
    return ranked.where((F.col("rank") <= prefix_column(F.col("n"), percent)) & (F.col("f") > 1)).select("token", "node", "n", "rank", "rare")


def dense_links(links: DataFrame, sets: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """links, and links between dense nodes, enough to connect all that are connected.

    For each token, all members are compared with one pivot: first with the one that has the fewest tokens of its own, then
    with others, as long as members lie in different components. What is still apart is compared in full.
    """
    postings = stored(dense_postings(sets, dense, percent), "dense-postings")

    def early(x: str, y: str) -> Column:
        """Alike in size, and the token early in both: what stands before the first common token, the partner lacks."""
        a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
        both = both_share(a, b, percent)
        return (
            (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
            & (F.col(f"{x}.rank") <= a - both + 1)
            & (F.col(f"{y}.rank") <= b - both + 1)
        )

    unsettled, tried = postings, None
    for turn in range(PIVOT_ROUNDS):
        first = F.col("rare") if turn == 0 else F.xxhash64("node", F.lit(turn))
        pivots = unsettled.groupBy("token").agg(F.min_by(F.struct("node", "n", "rank"), F.struct(first, "node")).alias("p"))
        x, y = unsettled.alias("x"), pivots.select("token", "p.*").alias("y")
        stars = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") != F.col("y.node")) & early("x", "y"))
        pairs = stars.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "stars")
        tried = pairs if tried is None else tried.union(pairs)
        links = stored(links.union(verified(pairs, sets, percent)), "verified")
        unsettled = stored(apart(postings, components(links)), "unsettled")
        if not unsettled.limit(1).count():
            return links
    x, y = unsettled.alias("x"), unsettled.alias("y")
    open_pair = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    rest = x.join(y, open_pair & early("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return links.union(verified(stored(rest.join(tried, ["a", "b"], "left_anti"), "rest"), sets, percent))


def join_ngrams(docs: DataFrame, width: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """n_shingles and component_id of each row of docs (doc_id, text): documents are linked if the Jaccard
    similarity of their shingle sets is at least percent / 100; component_id is the least doc_id connected.

    Words are compared with A-Z in lower case. A text of fewer words than a shingle has its whole sequence as its one
    token. A null or blank text has no token and is linked with nothing. Rows with one doc_id count as one document
    (each row with its own n_shingles). A null doc_id is linked with nothing, its component_id is null. Other
    columns are not read. An empty table gives an empty result.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(read.mapInArrow(set_rows(width, percent), "doc_id long, n long, digest string, own long, list array<long>"), "sets")
    named = rows.where("digest is not null and doc_id is not null")
    counted = stored(named.groupBy("digest", "doc_id").agg(F.count("*").alias("times")), "named")
    reps = stored(counted.groupBy("digest").agg(F.min("doc_id").alias("node")), "reps")
    copies = stored(counted.join(reps, "digest").where("doc_id <> node").select("doc_id", "digest"), "copies")
    repeated = counted.where("times > 1").limit(1).count() > 0
    once = lambda df, *names: df.dropDuplicates([*names]) if repeated else df

    lists = named.join(sized(copies), ["doc_id", "digest"], "left_anti")
    lists = once(lists, "doc_id", "digest").select(F.col("doc_id").alias("node"), "n", "own", "list")
    candidates, dense = light_candidates(lists, percent, heavy)
    candidates = stored(candidates, "candidates")
    wanted = stored(candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).union(dense).distinct(), "wanted")
    schema = "node long, n long, own long, tokens binary, second array<long>, third array<long>"
    sets = read.join(sized(wanted), "doc_id", "left_semi").mapInArrow(whole_sets(width, percent), schema)
    sets = stored(once(sets, "node", "tokens"), "whole-sets")
    links = verified(candidates, sets, percent)
    if dense.limit(1).count():
        links = dense_links(stored(links, "verified"), sets, dense, percent)

    nodes = named.select("doc_id", "digest").join(reps.select("digest", "node"), "digest")
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most")
    same_id = nodes.join(several, "doc_id").select("a", F.col("node").alias("b"))
    found = reps.select("digest", "node").join(components(links.union(same_id)), "node", "left")
    component = found.select("digest", F.coalesce("component", "node").alias("component"))
    linked = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    # rows that are linked with nothing have nothing to look up; as one null key they would meet in one task
    alone = rows.where(~linked).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    others = rows.where(linked).select("doc_id", F.col("n").alias("n_shingles"), "digest").join(component, "digest")
    return others.select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(alone)


def apart(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of tokens whose members lie in several components, with the component of each."""
    labelled = postings.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    return labelled.join(several, "token", "left_semi")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents"), width=4, percent=85)
