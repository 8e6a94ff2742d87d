"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if it is covered by a ``WINDOW``-byte string that also starts in a document with a smaller doc_id.

Suffixes are first put into buckets by q-grams. Of each window only its minimizer is looked at: the leftmost of its q-grams of
least hash; equal windows have equal minimizers at equal places. Buckets of minimizers that occur in one document only are dropped.
The windows of the others are brought together by bucket; those whose hash no other document has are final, as singletons
are, and go. The rest are refined: suffixes get the bucket number of their first 8 bytes, then by sorting pairs of
bucket numbers, their own and that of a later offset, of 16, 32 and WINDOW bytes; each round uses the numbers of the last, and
looks only at offsets that the windows need. What is then in one bucket is equal byte for byte.

Minimizers that occur at very many places (found in a sample of documents) don't go to buckets, as all that hold one would meet
in one task; the workers know them by a Bloom filter of bounded size. Their runs of windows are reduced to the least doc_id of each distinct run, then of each distinct window, by
aggregations that combine before they shuffle; the keys are the bytes themselves. The results are joined back to the holders.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.hashing import gram_hashes, mixed
from vellum.llm.shared import counted, pieces, sized, stored, table

WINDOW = 50
GRAM = 24
#: A run of windows of one minimizer; it has at most 2 * WINDOW - GRAM bytes.
HEAD = np.dtype([("doc", np.int64), ("key", np.int64), ("start", np.int32), ("length", np.uint8)])
#: Bytes of text for each bucket of q-grams, about; the number of buckets follows the input.
BUCKET_BYTES = 1 << 20
#: The same for buckets of minimizers alone, which have a row for about 14 bytes of text.
MINIMIZER_BUCKET_BYTES = 1 << 25
CHUNK = 1 << 20
#: From about so many places on, a minimizer is common. A sample of documents has ``SAMPLED`` of so many.
COMMON, SAMPLED = 4096, 64
#: The set of common minimizers goes to the workers as a Bloom filter: segments of so many bits, so many bits set for each
#: minimizer, so many bits a minimizer, and so many segments at most (128 MB). A minimizer that it takes for common by chance
#: goes the way of common ones, which is as exact; only its cost differs.
SEGMENT_BITS, PROBES, BITS_EACH, MOST_SEGMENTS = 1 << 20, 6, 32, 1024
#: Distinct windows, and distinct runs with the least doc_id of each window, that may be broadcast.
FEW_WINDOWS, FEW_RUNS = 200_000, 20_000


def chunks(docs: list, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of WINDOW bytes or more, put together: ids, starts (with the end of all), bytes."""
    ids, parts, size = [], [], 0  # ids may be tuples; they become rows of an array
    for doc, text in zip(docs, texts, strict=True):
        if len(text) >= WINDOW:
            ids.append(doc)
            parts.append(text)
            size += len(text)
        if size >= CHUNK:
            yield np.array(ids), np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), np.uint8)
            ids, parts, size = [], [], 0
    if ids:
        yield np.array(ids), np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), np.uint8)


def minimizer_runs(starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows with one minimizer: text number, first and last window, hash of the minimizer."""
    value = gram_hashes(data, GRAM)
    place = np.arange(len(value), dtype=np.int32)
    width, span = WINDOW - GRAM + 1, 1
    while span < width:
        step = min(span, width - span)
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        span += step
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts) - WINDOW + 1)
    window = np.arange(len(text)) + (WINDOW - 1) * text
    first = np.flatnonzero(np.diff(place[window], prepend=-1) | np.diff(text, prepend=-1))
    last = np.append(first, len(window))[1:] - 1
    return text[first], window[first], window[last], value[window[first]]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int32)


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and where it is."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    for at, end in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
        yield int(keys[order[at]]), order[at:end]


def encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """PROBES places in a segment for each hash, which don't depend on the segment."""
    at = mixed(hashes)
    step = (at >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield at & np.uint64(SEGMENT_BITS - 1)
        at = at + step


def segment_of_filter(group: pa.Table) -> pa.Table:
    """Of a table of (segment, hash), all of one segment: the segment and its bits."""
    hashes = group["hash"].to_numpy().view(np.uint64)
    bits = np.zeros(SEGMENT_BITS, bool)
    for at in probes(hashes):
        bits[at] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"segment": group["segment"][:1], "bits": pa.array([packed], pa.binary())})


def common_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of a table of n hashes (hash long): a power of two of segments, none if there are no hashes.

    The tasks build the segments; the driver puts together MOST_SEGMENTS of them at most, whatever n is.
    """
    if not n:
        return np.empty(0, np.uint8)
    segments = min(MOST_SEGMENTS, 1 << math.ceil(math.log2(max(1, n * BITS_EACH / SEGMENT_BITS))))
    by_segment = hashes.select(F.col("hash").bitwiseAND(F.lit(segments - 1)).alias("segment"), "hash").groupBy("segment")
    found = by_segment.applyInArrow(segment_of_filter, "segment long, bits binary").toArrow()
    bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for segment, packed in zip(found["segment"].to_pylist(), found["bits"], strict=True):
        bits[segment] = np.frombuffer(packed.as_buffer(), np.uint8)
    return bits.reshape(-1)


def among(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash is in a filter; one that isn't may pass by chance."""
    if not len(bits):
        return np.zeros(len(hashes), bool)
    at, base = np.arange(len(hashes)), (hashes & np.uint64(len(bits) * 8 // SEGMENT_BITS - 1)) * np.uint64(SEGMENT_BITS)
    for place in probes(hashes):  # most leave at the first probe
        place = base[at] + place[at]
        at = at[bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
    out = np.zeros(len(hashes), bool)
    out[at] = True
    return out


def sampled_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of (doc_id, text): the minimizers, and at how many places they occur."""
    for batch in pieces(batches):
        for _, starts, data in chunks(batch.column(0).to_pylist(), encoded(batch.column(1))):
            hashes, n = np.unique(minimizer_runs(starts, data)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["hash", "n"])


def common_runs(common: np.ndarray):
    """Of batches of (doc_id, text, key): the bytes of each run of windows of a common minimizer, and where the texts of a chunk hold it.

    A run that many documents hold is so one row for each chunk of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in pieces(batches):
            ids_keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for ids, starts, data in chunks(ids_keys, encoded(batch.column(1))):
                text, first, last, hashes = minimizer_runs(starts, data)
                keep = among(hashes, common)
                text, first, last = text[keep], first[keep], last[keep]
                view = data.tobytes()
                chunk += 1
                at: dict[bytes, list[int]] = {}
                for i, (a, b) in enumerate(zip(first, last, strict=True)):
                    at.setdefault(view[a : b + WINDOW], []).append(i)
                order = np.array([i for where in at.values() for i in where], np.int64)
                fields = [
                    pa.array(ids[text[order], 0], pa.int64()),
                    pa.array(ids[text[order], 1], pa.int64()),
                    pa.array((first - starts[text])[order].astype(np.int32), pa.int32()),
                ]
                ends = pa.array(np.cumsum([0, *map(len, at.values())]).astype(np.int32))
                held = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["doc_id", "key", "place"]))
                chunk_ids = pa.array(np.full(len(at), chunk), pa.int64())
                yield pa.RecordBatch.from_arrays([chunk_ids, pa.array(list(at), pa.binary()), held], ["chunk", "run", "held"])

    return run


def merged_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of found, the ranges (doc_id, key, start, end) of a chunk's texts: those that overlap or touch made one."""
    for batch in batches:
        out = []
        for found in batch.column(0):
            fields = [found.values.field(k).to_pylist() for k in range(4)]
            for doc, key, start, end in sorted(zip(*fields, strict=True)):
                if out and out[-1][:2] == [doc, key] and start <= out[-1][3]:
                    out[-1][3] = max(end, out[-1][3])
                else:
                    out.append([doc, key, start, end])
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "key", "start", "end"])


def minimizers(buckets: int, common: np.ndarray):
    """Of batches of (doc_id, text): packed minimizers by bucket but for common ones, tags and documents of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for ids, starts, data in chunks(batch.column(0).to_pylist(), encoded(batch.column(1))):
                text, _, _, hashes = minimizer_runs(starts, data)
                docs = ids[text].astype(np.int64)
                order = np.lexsort((hashes, docs))
                hashes, docs = hashes[order], docs[order]
                once = np.append(True, (np.diff(hashes) != 0) | (np.diff(docs) != 0))
                once &= ~among(hashes, common)
                hashes, docs = hashes[once], docs[once]
                rows = [(b, tags(hashes[at]).tobytes(), packed_ids(docs[at])) for b, at in grouped(bucket_of(hashes, buckets))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))],
                    ["bucket", "hashes", "docs"],
                )

    return run


def tags(hashes: np.ndarray) -> np.ndarray:
    """The half of each hash that stands for it within a bucket; a chance equality lets a window through to be compared."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids in order: the first, the bytes that a step takes, and the steps from each to the next."""
    steps = np.diff(ids.view(np.uint64))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or steps.max(initial=0) < np.uint64(1 << 8 * w))
    return ids[:1].tobytes() + bytes([width]) + steps.astype(f"u{width}").tobytes()


def unpacked_ids(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, f"u{packed[8]}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(packed, np.uint64, 1), steps]), dtype=np.uint64).view(np.int64)


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared_minimizers(group: pa.Table) -> pa.Table:
    """The tags of a bucket that several documents have, by document."""
    hashes = joined(group["hashes"], np.uint32)
    docs = np.concatenate([unpacked_ids(d) for d in group["docs"].to_pylist()])
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
    several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    keep = np.repeat(several, np.diff(np.append(first, len(hashes))))
    hashes, docs = hashes[keep], docs[keep]
    order = np.argsort(docs, kind="stable")
    hashes, docs = hashes[order], docs[order]
    cuts = np.flatnonzero(np.diff(docs, prepend=docs[:1] - 1))
    found = [hashes[a:b].tobytes() for a, b in zip(cuts, np.append(cuts, len(docs))[1:], strict=True)]
    return pa.table({"doc_id": pa.array(docs[cuts], pa.int64()), "shared": pa.array(found, pa.binary())})


def windows_to_compare(buckets: int):
    """Of batches of (doc_id, text, shared: list of packed tags, key, copy): the bytes of all runs of windows of these minimizers,
    by bucket: packed doc_id, key, start and length, and the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            shared = {}
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shared[doc] = np.sort(np.frombuffer(b"".join(packed), np.uint32))
            ids_keys = list(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for ids, starts, data in chunks(ids_keys, encoded(batch.column(1))):
                text, first, last, hashes = minimizer_runs(starts, data)
                keep = np.zeros(len(text), bool)
                cuts = np.searchsorted(text, np.arange(len(ids) + 1))
                for i, doc in enumerate(ids[:, 0]):
                    mine, theirs = tags(hashes[cuts[i] : cuts[i + 1]]), shared[int(doc)]
                    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                    keep[cuts[i] : cuts[i + 1]] = theirs[at] == mine
                text, first, last, hashes = text[keep], first[keep], last[keep], hashes[keep]
                lengths = last - first + WINDOW
                view = data.tobytes()
                rows = []
                for b, at in grouped(bucket_of(hashes, buckets)):
                    head = np.empty(len(at), HEAD)
                    head["doc"], head["key"] = ids[text[at]].T
                    head["start"], head["length"] = first[at] - starts[text[at]], lengths[at]
                    rows.append((b, head.tobytes(), b"".join(view[x : x + n] for x, n in zip(first[at], lengths[at], strict=True))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))],
                    ["bucket", "heads", "bytes"],
                )

    return run


def numbered(*keys: np.ndarray) -> np.ndarray:
    """Bucket numbers of the tuples of keys: equal just where the tuples are."""
    key = keys[0]
    for more in keys[1:]:
        key = key.astype(np.uint64) * np.uint64(int(more.max(initial=0)) + 1) + more.astype(np.uint64)
    return np.unique(key, return_inverse=True)[1]


def refine(data: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each of the windows (places in data) the number of the bucket of its WINDOW bytes."""

    def eight(at: np.ndarray) -> np.ndarray:
        return sum(data[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(8))

    # depth 16 at the offsets that cover a window, numbered together
    offsets = [*range(0, WINDOW - 16, 16), WINDOW - 16]
    places = np.concatenate([windows + o for o in offsets])
    numbers = numbered(numbered(eight(places)), numbered(eight(places + 8))).reshape(len(offsets), -1)
    while len(numbers) > 1:  # each round doubles the depth
        pairs = [numbered(a, b) for a, b in zip(numbers[0::2], numbers[1::2], strict=False)]
        numbers = np.stack([*pairs, *numbers[len(numbers) & ~1 :]])
    return numbers[0]


def several_documents(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether more than one document has the key of each row; the least document that has it."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(cuts, len(keys)))
    least, most = (np.empty(len(keys), np.int64) for _ in range(2))
    least[order] = np.repeat(np.minimum.reduceat(docs[order], cuts), sizes) if len(keys) else docs
    most[order] = np.repeat(np.maximum.reduceat(docs[order], cuts), sizes) if len(keys) else docs
    return least != most, least


def repeated_runs(group: pa.Table) -> pa.Table:
    """doc_id, key, start, end: the bytes of windows that an earlier document has, of one bucket of minimizers."""
    heads = joined(group["heads"], HEAD)
    data = joined(group["bytes"], np.uint8)
    lengths = heads["length"].astype(np.int64)
    n_windows = lengths - WINDOW + 1
    begins = np.cumsum(lengths) - lengths
    inside = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    row = np.repeat(np.arange(len(heads), dtype=np.int32), n_windows)
    windows = begins[row] + inside
    keep, _ = several_documents(gram_hashes(data, WINDOW)[windows], heads["doc"][row])
    row, windows, inside = row[keep], windows[keep], inside[keep]
    docs, keys, places = heads["doc"][row], heads["key"][row], heads["start"][row] + inside
    _, earliest = several_documents(refine(data, windows), docs)
    late = np.flatnonzero(earliest < docs)
    late = late[np.lexsort((places[late], keys[late], docs[late]))]
    docs, keys, places = docs[late], keys[late], places[late]
    new = np.flatnonzero((np.diff(docs, prepend=docs[:1] - 1) != 0) | (np.diff(keys, prepend=keys[:1]) != 0) | (np.diff(places, prepend=places[:1] - 2) > 1))
    ends = places[np.append(new, len(places))[1:] - 1] + WINDOW
    return pa.table({"doc_id": docs[new], "key": keys[new], "start": places[new].astype(np.int32), "end": ends.astype(np.int32)})


def without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of (doc_id, text, copy, key, keys, starts, ends): what is removed and what is left."""
    for batch in pieces(batches):
        rows = []
        for text, copy, own, keys, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
            text = (text or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = [[0, len(text)]] if copy and len(text) >= WINDOW else []
            if not copy:
                for start, end in sorted((a, b) for k, a, b in zip(keys or [], starts or [], ends or [], strict=True) if k == own):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
            at, kept = 0, hashlib.sha256()
            for start, end in runs:
                kept.update(text[at:start])
                at = end
            kept.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [x for run in runs for x in run]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def common_minimizers(firsts: DataFrame, common: int) -> tuple[DataFrame, int]:
    """A table (hash) of minimizers that occur at about so many places or more, by a sample of the documents, and its size."""
    every = max(1, common // SAMPLED)
    sample = firsts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", "text")
    counts = sample.mapInArrow(sampled_minimizers, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return counted(counts.where(F.col("n") >= common // every).select("hash"), "common-minimizers")


def repeated_common_runs(firsts: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, key, start, end: the bytes of windows of common minimizers that an earlier document has.

    The windows of a run overlap, so those that go cover one range of bytes. Joins with rows of a common key split the
    partitions that are skewed, if the other side is too large to be broadcast.
    """
    places = "array<struct<doc_id:bigint,key:bigint,place:int>>"
    held = stored(firsts.mapInArrow(common_runs(common), f"chunk long, run binary, held {places}"), "common-runs")
    distinct = held.groupBy("run").agg(F.min(F.array_min(F.transform("held", lambda h: h["doc_id"]))).alias("least"))
    at = F.explode(F.sequence(F.lit(0), F.octet_length("run") - WINDOW))
    windows = stored(distinct.select("run", "least", at.alias("i")).withColumn("window", F.expr(f"substring(run, i + 1, {WINDOW})")), "common-windows")
    several = windows.groupBy("window").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first")
    several = sized(stored(several, "common-firsts"), FEW_WINDOWS)
    first = F.coalesce("first", "least").alias("first")
    by_run = windows.join(several, "window", "left").groupBy("run").agg(F.collect_list(F.struct("i", first)).alias("firsts"))
    by_run = sized(stored(by_run, "common-firsts-by-run"), FEW_RUNS)
    late = lambda h: F.transform(F.filter("firsts", lambda w: w["first"] < h["doc_id"]), lambda w: w["i"])
    later = F.filter("held", lambda h: F.exists("firsts", lambda w: w["first"] < h["doc_id"]))
    found = F.transform(
        later,
        lambda h: F.struct(
            h["doc_id"].alias("doc_id"),
            h["key"].alias("key"),
            (h["place"] + F.array_min(late(h))).alias("start"),
            (h["place"] + F.array_max(late(h)) + WINDOW).alias("end"),
        ),
    )
    # a chunk's ranges are as many as its runs at most, and become few where they are put together: one for each passage of a text
    of_chunks = held.join(by_run, "run").select("chunk", found.alias("found")).where(F.size("found") > 0).groupBy("chunk").agg(F.flatten(F.collect_list("found")).alias("found"))
    return of_chunks.select("found").mapInArrow(merged_ranges, "doc_id long, key long, start int, end int")


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, common: int = COMMON) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256 and removed (starts and ends by turns) of each row of docs (doc_id, text).

    Texts are taken as UTF-8 bytes, a null one as empty. A text that is equal to one of a smaller doc_id goes as a whole if it has
    WINDOW bytes; such copies are found first and take no part in the rest. Rows with equal doc_id remove
    nothing from each other, and share what others remove. A row with a null doc_id has no place in the order: it is kept whole and
    removes nothing. Other columns are not read. An empty table gives an empty result.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    named = stored(read.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.octet_length("text").alias("n")), "named")
    long = named.where(F.col("n") >= WINDOW)  # shorter copies lose nothing; all empty texts would meet in one task
    least = long.groupBy("digest").agg(F.min("doc_id").alias("least"))
    copies = stored(long.join(least, "digest").where("doc_id > least").select("doc_id", "digest").distinct(), "copies")
    total = named.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, total // bucket_bytes)
    marked = read.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).join(
        sized(copies).withColumn("copy", F.lit(True)), ["doc_id", "digest"], "left"
    )
    key = F.xxhash64(F.coalesce("text", F.lit("")))  # tells apart texts of one doc_id
    marked = marked.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), key.alias("key"))
    firsts = marked.where(~F.col("copy"))
    # the bound grows slowly with the input, so that the common minimizers stay few too
    bits = common_filter(*common_minimizers(firsts, max(common, math.isqrt(total) // SAMPLED)))
    shared = stored(
        firsts.select("doc_id", "text").mapInArrow(minimizers(max(64, total // MINIMIZER_BUCKET_BYTES), bits), "bucket int, hashes binary, docs binary")
        .groupBy("bucket")
        .applyInArrow(shared_minimizers, "doc_id long, shared binary")
        .groupBy("doc_id")
        .agg(F.collect_list("shared").alias("shared")),
        "shared",
    )
    # both joins below are by doc_id alone, over all rows and columns of marked, so that texts are shuffled once
    compared = marked.join(shared, "doc_id").select("doc_id", "text", "shared", "key", "copy")
    runs = (
        compared.mapInArrow(windows_to_compare(buckets), "bucket int, heads binary, bytes binary")
        .groupBy("bucket")
        .applyInArrow(repeated_runs, "doc_id long, key long, start int, end int")
    )
    if len(bits):
        runs = runs.union(repeated_common_runs(firsts.select("doc_id", "text", "key"), bits))
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "end")).alias("runs"))
    found = marked.join(runs, "doc_id", "left").select("doc_id", "text", "copy", "key", F.col("runs.key").alias("keys"), "runs.start", "runs.end")
    unplaced = docs.where("doc_id is null").select(
        F.lit(None).cast("long"), "text", F.lit(False), F.lit(0).cast("long"), F.array().cast("array<long>"), *[F.array().cast("array<int>")] * 2
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>"
    return found.union(unplaced).mapInArrow(without_runs, schema)


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")
