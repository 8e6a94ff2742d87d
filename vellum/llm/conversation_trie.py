"""The trie of all conversations' prefixes, by truncation peeling.

Nodes are found from the deepest turn up: at each depth the conversations that end there are merged with the nodes that survived from
below, the last turn is stripped, and what is left is grouped again by its prefix. A node's members, children, leaves and saved tokens
are summed on the way, so one pass up finds the nodes and all that is asked of them.

A prefix is known by a chain of SHA-256 over its turns, which is carried along a conversation in one sorted stream. Conversations of the same
turns are merged first; from then on their number is a weight. Prefixes with few turns below them (``LIGHT``) are peeled within a
task, each subtree as a whole; heavier ones, from their heavy children and the light subtrees up, by Spark, a depth at a time. So a first
turn that a third of all conversations share is cut at the depth where it branches into light parts, and no task holds more than a light subtree.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.shared import WORD, counted, pieces, small, stored, table

#: Turns below a prefix, of distinct conversations, up to which it is peeled within a task.
LIGHT = 4096
#: Conversation ids that are joined into one text before they are digested.
PACKED = 4096
#: Conversations are taken by so many, and the first of them lends its first turns to the others (up to HEADS).
SHARED, HEADS = 20, 3


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest, words: the turns of each conversation, numbered from 1 by turn (null first), then role and text."""
    read = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return read.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("place"),
        F.unhex(F.sha2(said, 256)).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """conv_id, side, place, digest, words of turns: each conversation c with its first h turns replaced by those of c - c % 20.

    h is crc32 of c as text, modulo 4. Side 1 holds c's own turns, side 0 the lent ones, side -1 a row without turn for each conversation.
    """
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    convs = convs.select(
        "conv_id",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"),
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)
    own = turns.where(F.col("place") > h).withColumn("side", F.lit(1))
    heads = turns.where((F.col("place") <= HEADS) & (F.col("conv_id") % SHARED == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.join(heads, "base").where(F.col("place") <= F.col("h")).withColumn("side", F.lit(0))
    start = convs.select("conv_id", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("place"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"))
    kept = ["conv_id", "side", "place", "digest", "words"]
    return own.select(*kept).union(lent.select(*kept)).union(start)


CHAIN = "conv_id long, depth long, key binary, parent binary, words long, ends boolean"


def chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (conv_id, digest, words), conversation by conversation in order: a row for each depth, with the keys of its prefix and of the one before.

    Whether a row is its conversation's last shows only at the next one, which is all that is kept between batches.
    """
    last = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ends", pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    for batch in pieces(batches, 8192):
        rows = []
        for conv, digest, n_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and conv == last[0]:
                rows.append((*last, False))
                last = (conv, last[1] + 1, hashlib.sha256(last[2] + digest).digest()[:16], last[2], n_words)
            else:
                if last is not None:
                    rows.append((*last, True))
                last = (conv, 0, b"", None, 0)
        yield made(rows)
    if last is not None:
        yield made([(*last, True)])


def prefix_chains(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, words, ends: a row for each prefix of each rebuilt conversation, the empty one included."""
    dealt = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "side", "place")
    return dealt.select("conv_id", "digest", "words").mapInArrow(chain_batches, CHAIN)


def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, conv_id) in order: (key, first, n, ids), up to PACKED ids joined by comma in a row."""
    key, ids = None, []
    for batch in pieces(batches, 8192):
        rows = []
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PACKED):
                rows.append((key, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(conv)
        yield packed(rows)
    if ids:
        yield packed([(key, ids[0], len(ids), ",".join(map(str, ids)))])


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, first, n, ids) in order: (key, conv_id, n, sha), the least id, the number of ids and the digest of all of them, as a stream."""
    key, state = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("end_key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("sha", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    for batch in batches:
        rows = []
        for k, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is not None and k == key:
                state[1] += n
                state[2].update(b"," + ids.encode())
            else:
                if state is not None:
                    rows.append((key, state[0], state[1], state[2].hexdigest()))
                key, state = k, [first, n, hashlib.sha256(ids.encode())]
        yield made(rows)
    if state is not None:
        yield made([(key, state[0], state[1], state[2].hexdigest())])


def distinct_ends(chains: DataFrame) -> DataFrame:
    """end_key, conv_id, n, sha: each distinct rebuilt conversation, its least conv_id, how many there are, and the digest of their ids.

    Ids are sorted over all tasks and packed there; a task then digests what was packed, one piece after another.
    """
    ends = chains.where("ends").select("key", "conv_id")
    pieces_ = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack_batches, "key binary, first long, n long, ids string")
    ordered = pieces_.repartition("key").sortWithinPartitions("key", "first")
    return ordered.mapInArrow(digest_batches, "end_key binary, conv_id long, n long, sha string")


NODE = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string"


def peeled(rows: list[tuple]) -> Iterator[tuple]:
    """The nodes of one subtree. rows: (depth, key, parent, words, ends, conv_id, n, sha) of all its conversations, from its top down.

    A node on its way is [conv_id, convs, children, leaves, saved, sha].
    """
    above: dict[bytes, tuple[bytes, int]] = {}
    ended: dict[int, list[tuple]] = defaultdict(list)
    top = min(r[0] for r in rows)
    for depth, key, parent, n_words, ends, conv, n, sha in rows:
        above[key] = parent, n_words
        if ends:
            ended[depth].append((key, conv, n, sha))
    alive: dict[bytes, list] = {}
    below: list[tuple[bytes, list]] = []  # nodes one deeper, which wait for their parent's conv_id
    for depth in range(max(ended), top - 1, -1):
        for key, conv, n, sha in ended[depth]:
            node = alive.setdefault(key, [conv, 0, 0, 0, 0, None])
            node[0], node[1], node[5] = min(node[0], conv), node[1] + n, sha
        for key, (conv, convs, children, leaves, saved, sha) in below:
            parent = above[key][0]
            yield key, parent, conv, depth + 1, alive[parent][0], convs, children, leaves, saved, sha
        below, stripped = list(alive.items()), {}
        for key, node in below:
            parent, n_words = above[key]
            node[3] = node[3] or 1
            node[4] += (node[1] - 1) * n_words
            into = stripped.setdefault(parent, [node[0], 0, 0, 0, 0, None])
            into[0] = min(into[0], node[0])
            into[1] += node[1]
            into[2] += 1
            into[3] += node[3]
            into[4] += node[4]
        alive = stripped
    for key, (conv, convs, children, leaves, saved, sha) in below:
        yield key, above[key][0], conv, top, None, convs, children, leaves, saved, sha


def peel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, depth, key, parent, words, ends, conv_id, n, sha), bucket by bucket: the nodes of each bucket's subtree."""
    bucket, rows = None, []
    names = [x.split()[0] for x in NODE.split(", ")]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]

    def made(nodes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in nodes], kind) for k, kind in enumerate(kinds)], names)

    for batch in pieces(batches, 8192):
        nodes = []
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and b != bucket:
                nodes += peeled(rows)
                rows = []
            bucket = b
            rows.append(tuple(row))
        yield made(nodes)
    if rows:
        yield made(list(peeled(rows)))


def build_trie(turns: DataFrame, light: int = LIGHT) -> DataFrame:
    """The nodes of the trie of turns: conv_id, side, place, digest, words, as from rebuilt_turns().

    conv_id (the least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    chains = stored(prefix_chains(turns), "chains")
    ends = stored(distinct_ends(chains), "trie-ends")
    lengths = ends.join(chains.where("ends").select("conv_id", F.col("depth").alias("length")), "conv_id").select("conv_id", "length", "n", "sha")
    rows = stored(chains.join(lengths, "conv_id"), "trie-rows")
    prefixes = rows.groupBy("key").agg(
        F.sum(F.col("length") - F.col("depth") + 1).alias("below"), *(F.first(c).alias(c) for c in ("parent", "words", "depth"))
    )
    heavy, n_heavy = counted(prefixes.where((F.col("below") > light) | (F.col("depth") == 0)).drop("below"), "trie-heavy")
    flagged = rows.join(small(heavy.select("key", F.lit(True).alias("heavy")), n_heavy), "key", "left")
    one = Window.partitionBy("conv_id")
    cut = flagged.withColumn("from", F.max(F.when(F.col("heavy"), F.col("depth"))).over(one) + 1)
    cut = cut.withColumn("bucket", F.max(F.when(F.col("depth") == F.col("from"), F.col("key"))).over(one))
    fields = ["bucket", "depth", "key", "parent", "words", "ends", "conv_id", "n", "sha"]
    dealt = cut.where(F.col("depth") >= F.col("from")).select(*fields).repartition("bucket").sortWithinPartitions("bucket")
    subtrees = stored(dealt.mapInArrow(peel_batches, NODE), "trie-light")
    tops = subtrees.where("parent_conv_id is null")
    sums = {"conv_id": F.min, "n_convs": F.sum, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum}
    gathered = lambda df, *more: df.groupBy("key").agg(*(f(c).alias(c) for c, f in sums.items()), *more)
    none = F.lit(0).cast("long")
    stripped = lambda nodes: nodes.select(F.col("parent").alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    ended = rows.where("ends").join(small(heavy.select("key"), n_heavy), "key").select("key", "conv_id", F.col("n").alias("n_convs"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"), "sha")
    known = stripped(tops).withColumn("sha", F.lit(None).cast("string")).union(ended)
    begun = stored(heavy.join(gathered(known, F.max("sha").alias("sha")), "key", "left"), "trie-begun")
    levels = []
    deepest = heavy.agg(F.max("depth")).first()[0]
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = begun.where(F.col("depth") == depth)
        if levels:
            place = level.select("key", "parent", "words", "depth")
            level = place.join(gathered(level.select("key", *sums, "sha").unionByName(stripped(levels[-1]), allowMissingColumns=True), F.max("sha").alias("sha")), "key")
        saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")
        leaves = F.greatest("n_leaves", F.lit(1))
        made = level.withColumns({"saved_tokens": saved, "n_leaves": leaves}).select("key", "parent", "conv_id", "depth", *list(sums)[1:], "sha")
        levels.append(stored(made, f"trie-level-{depth}"))
    inner = tops.drop("parent_conv_id").select("key", "parent", "conv_id", "depth", *list(sums)[1:], "sha")
    parents = inner.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).limit(0)
    for level in levels:
        inner = inner.union(level)
        parents = parents.union(level.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    joined = inner.join(small(parents, n_heavy), "parent", "left")
    result = ["conv_id", "depth", "parent_conv_id", *list(sums)[1:], F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return subtrees.where("parent_conv_id is not null").select(*result).union(joined.select(*result))


def trie_of(conversations: DataFrame, light: int = LIGHT) -> DataFrame:
    """build_trie() of rebuilt conversations (conv_id, turn, role, text).

    Null roles and texts are empty ones. Turns of one number are ordered by role, then text; repeated rows are turns of their own. Rows
    without conv_id belong to no conversation. A conversation that is left without turns is a member of the root alone, and ends there. Other
    columns aren't read. An empty table gives no root and an empty result.
    """
    return build_trie(rebuilt_turns(stored(ordered_turns(conversations), "turns")), light)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_of(table(spark, sf_dir, "conversations"))


#: CRC-32 by bits: over the bytes of the decimal digits, then over the eight bits of each.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""
OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS side, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(len(role) || ':' || len(text) || ':' || role || text, '|') OVER w) AS key,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY side, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length) AS ends
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY depth, key),
parents AS (
  SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = p.depth AND u.key = p.key),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children c ON c.conv_id = p.conv_id AND c.depth = p.depth),
sums AS (
  SELECT p.depth, p.key, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_nodes JOIN sums USING (depth, key)
"""
