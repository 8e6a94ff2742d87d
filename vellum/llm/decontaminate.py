"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item of n word shingles is contained if at least ``SHARE`` of them occur in a document, so at most
n - ceil(SHARE n) may be missing. Items are partitioned by size; each partition has a sketch length of one more
than its largest item may miss. The sketch of an item is the least so many of its shingle hashes (a bottom-k MinHash):
a document that contains the item must hold one of them, so the search misses nothing, however long the
document. Documents that hold one and are large enough are candidates; these are verified on the shingles themselves.
"""

# Filters on arrays made here, and explode() without _outer, would be pushed below the projection that
# splits a text, and the split be repeated for each word; hence explode_outer(), sizes that can't be null (joins
# filter out null operands of their conditions), and the filter after the aggregate.

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.shared import fresh, lower_ascii, row_key, sized, stored, table, words

WIDTH = 5
#: Containment as a fraction, for integer arithmetic.
SHARE = (4, 5)
#: Sketch entries (hash, item, size; 24 bytes each) are broadcast up to this number; beyond it, the join is shuffled.
BROADCAST_ENTRIES = 500_000
#: Bytes of item texts up to which their shingles (WIDTH times as long) are broadcast.
BROADCAST_BYTES = 8 << 20


def with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("_words", words(lower_ascii(F.col("text"))))


def shingles(make) -> Column:
    """make(i) for each start i of a shingle in _words; [] for texts of fewer words than a shingle."""
    starts = F.when(F.size("_words") >= WIDTH, F.sequence(F.lit(0), F.size("_words") - WIDTH))
    return F.array_distinct(F.transform(starts, make))


def hashed(i: Column) -> Column:
    return F.xxhash64(*(F.get("_words", i + k) for k in range(WIDTH)))


def spelled(i: Column) -> Column:
    return F.array_join(F.slice("_words", i + 1, F.lit(WIDTH)), " ")


def needed(n: Column) -> Column:
    """Shingles that must be shared, of n."""
    return F.floor((n * SHARE[0] + SHARE[1] - 1) / SHARE[1]).cast("int")


def item_key() -> Column:
    """Names an item by item_id and text. Should two items share a name, each is verified by its own text."""
    return F.xxhash64("item_id", "text").alias("item")


def item_sketches(items: DataFrame) -> DataFrame:
    """item, n_item, hash: one row for each entry of each item's sketch."""
    sized = (
        with_words(items.select(item_key(), "text"))
        .select("item", shingles(hashed).alias("hashes"))
        .withColumn("n_item", F.greatest(F.size("hashes"), F.lit(1)))
    )
    partition_size = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("int")  # its largest item
    length = partition_size - needed(partition_size) + 1
    entries = F.explode_outer(F.slice(F.sort_array("hashes"), F.lit(1), length))
    return sized.select("item", "n_item", entries.alias("hash")).where("hash is not null")


def contained_items(docs: DataFrame, items: DataFrame, *, by_row: bool = False) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: the items contained in each document; with by_row also the row's key.

    docs: doc_id, text. items: item_id, text. Words are compared with A-Z in lower case. Null texts, and those of
    fewer than five words, hold and are nothing. Repeated rows of either side give one row for each pair of ids;
    documents with a null doc_id are searched too, and for items with a null item_id. Texts of one item_id are judged each by itself;
    the counts are those of the contained one that shares most. Other columns are not read. An empty side gives an empty result.
    """
    sketches = stored(item_sketches(items), "sketches")
    if sketches.count() <= BROADCAST_ENTRIES:
        sketches = F.broadcast(sketches)
    keyed = docs.select("doc_id", "text").withColumn("key", row_key())
    candidates = (
        with_words(keyed)
        .select("key", shingles(hashed).alias("hashes"))
        .select("key", F.coalesce(F.size("hashes"), F.lit(0)).alias("n_doc"), F.explode_outer("hashes").alias("hash"))
        .join(sketches, "hash")
        .where(F.col("n_doc") >= needed(F.col("n_item")))
        .select("key", "item")
        .distinct()
    )
    candidates = sized(stored(candidates, "candidates"))
    spelled_items = with_words(items.select(item_key(), "item_id", "text")).select("item", "item_id", shingles(spelled).alias("item_shingles"))
    # broadcast, texts aren't dealt by item; else they are, and what holds a frequent item is split as a skewed partition
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES:
        spelled_items = F.broadcast(spelled_items)
    shared = F.size(F.array_intersect(shingles(spelled), F.col("item_shingles")))
    verified = (
        with_words(keyed.join(candidates, "key").select("key", "doc_id", "text", "item").join(spelled_items, "item"))
        .select("key", "doc_id", "item_id", F.size("item_shingles").alias("n_item"), shared.alias("n_shared"))
    )
    names = (["key"] if by_row else []) + ["doc_id", "item_id"]
    contained = (F.col("n_item") > 0) & (F.col("n_shared") >= needed(F.col("n_item")))
    most = F.max(F.when(contained, F.struct("n_shared", "n_item"))).alias("most")
    return verified.groupBy(*names).agg(most).where("most is not null").select(
        *names, F.col("most.n_item").cast("long").alias("n_item"), F.col("most.n_shared").cast("long").alias("n_shared")
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that contain an item; all columns stay."""
    key = fresh(docs, "row_key")
    hit = contained_items(docs, items, by_row=True).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(sized(stored(hit, "hits")), key, "left_anti").select(*docs.columns)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shingle_sql(name: str, ident: str) -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
{name}_w AS (SELECT {ident}, regexp_extract_all({lowered}, '[^\\x20\\x09-\\x0D]+') AS w FROM {name}),
{name}_s AS (SELECT DISTINCT {ident}, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s
  FROM {name}_w)"""


OP7_SQL = f"""
WITH {_shingle_sql("documents", "doc_id")}, {_shingle_sql("benchmark", "item_id")},
sizes AS (SELECT item_id, count(*) AS n_item FROM benchmark_s GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM documents_s JOIN benchmark_s USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
"""
