"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts up to ``ORDER`` bytes, learned from the training documents. A byte is predicted in its longest context; a
byte that was never seen there costs an escape (method D: half a count of each different byte goes to it), and is sought in the next shorter
context, in which the bytes of the longer one are excluded. There a byte counts once for each different longer context that it was seen in, as it
is sought there only where it's new. What no context has is uniform over what is left. So a byte's code length depends on itself and the
ORDER bytes before it, its gram.

A text is coded as its words in lower case (A-Z), parted by single spaces, with an end behind. 0xFE and 0xFF, which UTF-8 never has, stand for what is
before the start and for the end.

The trie isn't held anywhere as a whole; it is a table for each order, of grams with counts and of contexts with theirs. Texts are cut into blocks
of some megabytes. A block asks for its distinct grams and words, packed by hash bucket; counts are merged by bucket, code lengths are
found by joins from order to order, and each block gets those of what it asked for. What moves grows with the distinct grams
and words of blocks, not with documents times grams. The unigram base score goes the same way: words stand there by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.hashing import word_hashes
from vellum.llm.shared import LOWER, UPPER, pieces, sized, stored, table

ORDER = 5
START, END = b"\xfe", b"\xff"
#: All bytes but START can be a symbol.
SYMBOLS = 255
#: Bytes of text in a block, and those that are looked at together.
BLOCK, CHUNK = 32 << 20, 1 << 20
WORDS, GRAMS = 0, 1
#: What is known of a word is its count, of a gram the log10 of its probability.
VALUES = {WORDS: np.int64, GRAMS: np.float32}
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
U = np.uint64


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, held_out, text as bytes): (block, doc_id, held_out, tokens, n_bytes), tokens parted by single spaces."""
    task = TaskContext.get()
    block, size = task.partitionId() << 32, 0
    for batch in pieces(batches):
        texts = [b" ".join(t.translate(TO_LOWER).split()) for t in batch.column(2).to_pylist()]
        blocks = []
        for t in texts:
            if size >= BLOCK:
                block, size = block + 1, 0
            size += len(t)
            blocks.append(block)
        columns = [pa.array(blocks, pa.int64()), batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "held_out", "tokens", "n_bytes"])


def segments(texts: list[bytes], order: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Padded texts, long ones in overlapping parts, in lists of about CHUNK bytes, and the text that each is of."""
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        padded = START * order + text + END
        for at in range(0, len(text) + 1, CHUNK):
            parts.append(padded[at : at + CHUNK + order])
            owners.append(i)
            size += len(parts[-1])
            if size >= CHUNK:
                yield parts, owners
                parts, owners, size = [], [], 0
    if parts:
        yield parts, owners


def grams_of(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams (order bytes and the one behind, as a number) of all parts, and how many each has."""
    data = b"".join([*parts, b"\0" * 8])
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    keep = np.ones(ends[-1], bool)
    for k in range(order):
        keep[ends - 1 - k] = False
    whole = np.ndarray((ends[-1],), ">u8", data, strides=(1,)).astype(U)
    return (whole >> U(8 * (7 - order)))[keep], lengths - order


def distinct(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each is there or the sum of its weights."""
    if weights is None:
        x = np.sort(x)
    else:
        order = np.argsort(x, kind="stable")
        x, weights = x[order], weights[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    if weights is None:
        return x[first], np.diff(first, append=len(x))
    return x[first], np.add.reduceat(weights, first) if len(first) else weights


class Counted:
    """Sorted keys with counts, to which others are added; merged when what was added outgrows what there is."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.n = np.empty(0, U), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n += len(keys)
        if self.n > len(self.keys) + (1 << 19):
            self.merge()

    def merge(self) -> Counted:
        if self.waiting:
            keys, counts = zip(*self.waiting, strict=True)
            self.keys, self.counts = distinct(np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts]))
            self.waiting, self.n = [], 0
        return self


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: the first bytes of all, the second ones of all and so on. Small numbers compress well so."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U(0)))


def unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(from_planes(x, U), dtype=U)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, of 63 bits, and how many each text has."""
    hashes, counts = word_hashes(texts)
    return hashes >> U(1), counts


def by_bucket(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the places of their keys, in the keys' order."""
    buckets = (keys % U(n_buckets)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def ask_batches(n_buckets: int, order: int):
    """Of (block, held_out, tokens), block by block: (bucket, block, kind, keys, counts), the distinct keys and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, None

        def rows() -> pa.RecordBatch:
            made = []
            for kind in (WORDS, GRAMS):
                c = found[kind].merge()
                made += [(b, current, kind, pack_keys(c.keys[at]), planes(c.counts[at])) for b, at in by_bucket(c.keys, n_buckets)]
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = [("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

        for batch in pieces(batches, 512):
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks):
                if block != current:
                    if current is not None:
                        yield rows()
                    current, found = int(block), {WORDS: Counted(), GRAMS: Counted()}
                part = batch.filter(pa.array(blocks == block))
                held, texts = part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_pylist()
                for training in (True, False):
                    own = [t for t, h in zip(texts, held, strict=True) if h != training]
                    for group, _ in segments(own, order):
                        keys, n = distinct(grams_of(group, order)[0])
                        found[GRAMS].add(keys, n * training)
                    if own:
                        keys, n = distinct(word_keys(own)[0])
                        found[WORDS].add(keys, n * training)
        if current is not None:
            yield rows()

    return run


def merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, kind, keys, counts) in order: the same, one row for each bucket and kind, with the sum of counts and how many are positive."""
    current, found = None, Counted()

    def row() -> pa.RecordBatch:
        c = found.merge()
        values = [*current, pack_keys(c.keys), planes(c.counts), int(c.counts.sum()), int((c.counts > 0).sum())]
        kinds = [("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("known", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, kinds, strict=True)], [n for n, _ in kinds])

    for batch in pieces(batches, 64):
        for bucket, kind, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current != (bucket, kind):
                if current is not None:
                    yield row()
                current, found = (bucket, kind), Counted()
            found.add(unpack_keys(keys), from_planes(counts, np.int64))
    if current is not None:
        yield row()


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (keys, counts): a row for each gram and its count."""
    for batch in pieces(batches, 8):
        for keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            grams, n = unpack_keys(keys).view(np.int64), from_planes(counts, np.int64)
            for at in range(0, len(grams), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (grams, n)], ["gram", "n"])


def length_batches(n_buckets: int):
    """Of (gram, lp): (bucket, keys, values), packed in runs of some hundred thousand grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def rows() -> pa.RecordBatch:
            keys = np.concatenate([b.column(0).to_numpy() for b in waiting]).astype(U)
            values = np.concatenate([b.column(1).to_numpy() for b in waiting]).astype(np.float32)
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            made = [(b, pack_keys(keys[at]), planes(values[at])) for b, at in by_bucket(keys, n_buckets)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "counts"])

        n = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= 1 << 18:
                yield rows()
                waiting, n = [], 0
        if waiting:
            yield rows()

    return run


def answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, kind, block, keys, counts), those without block first: to each block's keys the values that rows without block have for them."""
    current, known, model = None, [], None
    for batch in pieces(batches, 64):
        rows = []
        for bucket, kind, block, keys, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current != (bucket, kind):
                current, known, model = (bucket, kind), [], None
            if block is None:
                known.append((unpack_keys(keys), from_planes(values, VALUES[kind])))
                continue
            if model is None:
                all_keys, all_values = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(all_keys, kind="stable")
                model, known = (all_keys[order], all_values[order]), []
            rows.append((block, kind, keys, planes(model[1][np.searchsorted(model[0], unpack_keys(keys))])))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


class Lookup:
    """Values by key for many keys at once: a table by multiplicative hash, and another for those that share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, level: int = 0):
        self.keys, self.values = keys, values
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.factor = U(64 - bits), U((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * level) & (1 << 64) - 1 | 1)
        self.slots = np.zeros(1 << bits, np.int32)
        slots = self.slot(keys)
        self.slots[slots] = np.arange(len(keys), dtype=np.int32)
        left = np.flatnonzero(self.slots[slots] != np.arange(len(keys)))
        self.rest = Lookup(keys[left], values[left], level + 1) if len(left) else None

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * self.factor) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be there."""
        if not len(keys):
            return np.empty(0, self.values.dtype)
        at = self.slots[self.slot(keys)]
        found = self.values[at]
        if self.rest is not None:
            other = np.flatnonzero(self.keys[at] != keys)
            if len(other):
                found[other] = self.rest(keys[other])
        return found


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_batches(order: int, n_train: int, n_distinct: int, n_ends: int):
    """Of (block, kind, keys, counts, doc_id, held_out, tokens), a block's answers before its texts: the scores of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, answers, words, grams = None, {}, None, None
        base = lambda c: np.log10((c + 0.1) / (n_train + 0.1 * (n_distinct + 1)))
        end = base(np.float64(n_ends))
        for batch in pieces(batches, 512):
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks):
                if block != current:
                    current, answers, words = block, {WORDS: [], GRAMS: []}, None
                part = batch.filter(pa.array(blocks == block))
                own = kinds[blocks == block]
                for kind, keys, values in zip(*(c.to_pylist() for c in part.filter(pa.array(own >= 0)).select([1, 2, 3]).columns), strict=True):
                    answers[kind].append((unpack_keys(keys), from_planes(values, VALUES[kind])))
                texts = part.filter(pa.array(own < 0))
                if not texts.num_rows:
                    continue
                if words is None:
                    made = lambda kind: [np.concatenate(x) for x in zip(*answers[kind], strict=True)] or [np.empty(0, U), np.empty(0)]
                    keys, counts = made(WORDS)
                    words, grams = Lookup(keys, base(counts) + 1j * (counts > 0)), Lookup(*made(GRAMS))
                    answers = {}
                yield scored(texts, words, grams, end)

    def scored(texts: pa.RecordBatch, words: Lookup, grams: Lookup, end: float) -> pa.RecordBatch:
        said = texts.column(6).to_pylist()
        score = np.zeros(len(said))
        for parts, owners in segments(said, order):
            keys, n = grams_of(parts, order)
            score += np.bincount(owners, np.add.reduceat(grams(keys), np.cumsum(n) - n, dtype=np.float64), len(said))
        keys, n = word_keys(said)
        found = words(keys)
        owner = np.repeat(np.arange(len(said)), n)
        unigram, known = np.bincount(owner, found.real, len(said)), np.bincount(owner, found.imag, len(said))
        columns = [texts.column(4), texts.column(5), pa.array(n + 1), pa.array(known.astype(np.int64) + (n_ends > 0)), pa.array(np.full(len(said), n_train)), pa.array(unigram + end), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

    return run


def suffix(gram: str, order: int):
    """The last ``order`` bytes of a context and the byte behind."""
    return F.col(gram).bitwiseAND((1 << 8 * (order + 1)) - 1)


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, lp: log10 of the probability of each gram's last byte behind the others. grams: distinct grams, n (0 if not in training).

    seen[j] has the grams of order j with their counts (below the highest order: of different grams one longer), contexts[j] the contexts of
    order j: total count, different bytes, and both of what is left in the context one shorter when the bytes seen here are excluded.
    """
    seen = {order: grams.where("n > 0")}
    for j in range(order - 1, -1, -1):
        seen[j] = sized(stored(seen[j + 1].groupBy(suffix("gram", j).alias("gram")).agg(F.count("*").alias("n")), f"seen-{j}"))
    context = F.shiftright("gram", 8)
    totals = [F.sum("n").alias("total"), F.count("*").alias("different")]
    contexts = {0: seen[0].groupBy(context.alias("context")).agg(*totals)}
    for j in range(1, order + 1):
        shorter = seen[j - 1].select(F.col("gram").alias("shorter"), F.col("n").alias("n_shorter"))
        both = seen[j].withColumn("shorter", suffix("gram", j - 1)).join(shorter, "shorter")
        own = both.groupBy(context.alias("context")).agg(*totals, F.sum("n_shorter").alias("excluded"))
        above = contexts[j - 1].select(F.col("context").alias("parent"), F.col("total").alias("t"), F.col("different").alias("d"))
        parent = F.col("context").bitwiseAND((1 << 8 * (j - 1)) - 1)
        rest = {"rest_total": F.col("t") - F.col("excluded"), "rest_different": F.col("d") - F.col("different")}
        contexts[j] = sized(stored(own.withColumn("parent", parent).join(above, "parent").withColumns(rest).drop("parent", "t", "d", "excluded"), f"contexts-{j}"))
    contexts[0] = F.broadcast(contexts[0])  # one row
    longest = seen[order].withColumn("context", context).join(contexts[order], "context")
    hits = longest.select("gram", F.log10((F.col("n") - 0.5) / F.col("total")).alias("lp"))

    none = F.lit(None).cast("long")
    left = grams.where("n = 0").select("gram", F.lit(0.0).cast("double").alias("lp"), F.lit(False).alias("done"), none.alias("t"), none.alias("d"))
    for j in range(order, -1, -1):
        at = left.withColumns({"context": F.shiftright(suffix("gram", j), 8), "own": suffix("gram", j)}).join(contexts[j], "context", "left")
        t, d = F.coalesce("t", "total"), F.coalesce("d", "different")
        if j < order:
            at = at.join(seen[j].select(F.col("gram").alias("own"), F.col("n").alias("n_own")), "own", "left")
        n = F.col("n_own") if j < order else none
        lp = F.when(F.col("done"), F.col("lp")).when(n.isNotNull(), F.col("lp") + F.log10((n - 0.5) / t)).when(d > 0, F.col("lp") + F.log10(0.5 * d / t)).otherwise(F.col("lp"))
        rest = (F.col("rest_total"), F.col("rest_different")) if j else (none, F.col("different"))
        left = at.select("gram", lp.alias("lp"), (F.col("done") | n.isNotNull()).alias("done"), rest[0].alias("t"), rest[1].alias("d"))
    # what order 0 doesn't have either is uniform
    uniform = F.log10(SYMBOLS - F.coalesce("d", F.lit(0)))
    return hits.union(left.select("gram", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - uniform).alias("lp")))


def bucket_count(n_bytes: int) -> int:
    """A prime, of the order of the root of the text: what a bucket holds and how many rows a block asks with grow alike."""
    n = max(61, int(8 * (n_bytes / (16 << 20)) ** 0.5))
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of doc_id as text is 0 modulo 10 are held out; the model and the unigram base learn from all others. A null text counts as
    empty: its one token is the end. A null doc_id counts as the empty text for crc32, whose value is 0: held out. Repeated rows are documents
    of their own. score is log10 of the probability of the words in order and the end. Without training documents every byte is
    uniform, and the base knows no token. Other columns aren't read. An empty table gives an empty result.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    blocks = stored(read.mapInArrow(cut_batches, "block long, doc_id long, held_out boolean, tokens binary, n_bytes long"), "lm-blocks", "zstd")
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.count_if(~F.col("held_out")).alias("n_ends")).first()
    n_buckets = bucket_count(size["n_bytes"])
    asked = stored(
        blocks.select("block", "held_out", "tokens").mapInArrow(ask_batches(n_buckets, order), "bucket int, block long, kind int, keys binary, counts binary"),
        "lm-asked",
        "zstd",
    )
    merging = asked.select("bucket", "kind", "keys", "counts").repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
    merged = stored(merging.mapInArrow(merge_batches, "bucket int, kind int, keys binary, counts binary, total long, known long"), "lm-merged")
    known = merged.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("known"), F.lit(0)).alias("known")).first()
    n_ends = size["n_ends"]
    n_train, n_distinct = known["total"] + n_ends, known["known"] + (n_ends > 0)
    grams = stored(merged.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(gram_batches, "gram long, n long"), "lm-grams")
    lengths = code_lengths(grams, order).mapInArrow(length_batches(n_buckets), "bucket int, keys binary, counts binary")
    none = F.lit(None).cast("long")
    model = lengths.select("bucket", F.lit(GRAMS).alias("kind"), none.alias("block"), "keys", "counts").union(
        merged.where(F.col("kind") == WORDS).select("bucket", "kind", none.alias("block"), "keys", "counts")
    )
    questions = model.union(asked.select("bucket", "kind", "block", "keys", F.lit(None).cast("binary")))
    dealt = questions.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind", F.col("block").asc_nulls_first())
    answers = dealt.mapInArrow(answer_batches, "block long, kind int, keys binary, counts binary")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("held_out", "boolean"), ("tokens", "binary"))]
    texts = blocks.select("block", F.lit(-1).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in ("keys", "counts")), "doc_id", "held_out", "tokens")
    together = answers.select("*", *nothing).union(texts).repartition("block").sortWithinPartitions("block", F.col("kind") < 0)
    return together.mapInArrow(score_batches(order, n_train, n_distinct, n_ends), SCORED)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
