"""Language identification by rank-order profiles.

A profile is a ranked list of a language's most frequent character n-grams (one to three letters, words set off by
blanks). A document's own most frequent n-grams are compared with each profile by the out-of-place measure:
the sum over them of the distance between both ranks, or the greatest distance where the profile lacks one. The language of
least distance is predicted. Profiles come from a bounded sample of labelled rows; only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.shared import pieces, table

#: n-grams in a profile, and of a document that are compared.
PROFILE = 300
#: Labelled documents that profiles are learned from, for each language; those with the least hash of doc_id.
SAMPLE = 2000
BITS = 21  # of a code point


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one 0, with a 0 at either end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]])
    return codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])].astype(np.uint64)


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of up to three, packed into integers, and their counts. A blank may stand at the ends of an n-gram only."""
    one = codes[codes > 0]
    two = (codes[:-1] << np.uint64(BITS)) | codes[1:]
    inner = codes[1:-1] > 0
    three = ((two[:-1] << np.uint64(BITS)) | codes[2:])[inner]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def most_frequent(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k grams of highest count, in rank order; ties by value."""
    if len(grams) > k:  # all that reach the k-th highest count
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:k]


def count_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            codes = np.concatenate([letter_codes(t) for x, t in zip(langs, texts, strict=True) if x == lang])
            grams, counts = gram_counts(codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"]
            )


def learn_profiles(labelled: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language of labelled (doc_id, text, lang, without nulls): a ranked array of n-grams."""
    hashed = labelled.withColumn("h", F.xxhash64("doc_id"))
    # twice the sample is enough to find its last row in; so no language's rows meet in one task
    totals = labelled.groupBy("lang").agg(F.count("*").alias("total"))
    share = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("total")  # rows with a lesser hash, about
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    low = hashed.select("lang", "h").join(F.broadcast(totals), "lang").where(share < 2 * sample + 100)
    last = low.withColumn("n", place).where(F.col("n") <= sample).groupBy("lang").agg(F.max("h").alias("last"))
    sampled = hashed.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last")).select("lang", "text")
    counts = sampled.mapInArrow(count_sample, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("r", rank).where(F.col("r") <= size).collect()  # languages times size
    found: dict[str, list] = {}
    for row in sorted(rows, key=lambda x: (x.lang, x.r)):
        found.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(grams, np.uint64) for lang, grams in found.items()}


def predictor(profiles: dict[str, np.ndarray], size: int = PROFILE) -> Callable[[str | None], tuple[str, float]]:
    """A function from a text to its language and score."""
    langs = sorted(profiles)
    known = np.unique(np.concatenate([*profiles.values(), np.array([], np.uint64)]))
    ranks = np.full((len(langs), len(known) + 1), -1)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(text: str | None) -> tuple[str, float]:
        codes = letter_codes(text or "")
        if not len(known) or not codes.any():
            return "und", 0.0
        top = most_frequent(*gram_counts(codes), size)
        at = np.searchsorted(known, top)
        at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
        theirs = ranks[:, at]
        far = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(far, kind="stable")
        if len(langs) == 1 or far[order[1]] == 0:
            return langs[order[0]], 1.0 - float(far[order[0]]) / (size * len(top))
        return langs[order[0]], 1.0 - float(far[order[0]] / far[order[1]])

    return predict


def identify_language(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text); other columns are not read.

    score is the margin, 0 to 1: one less the ratio of the least to the second least distance. A text that is null or has no letter
    is ``und`` with score 0; so is any text if there are no profiles. Of equal distances the first language by name wins.
    Repeated rows are judged each; a null doc_id stays null. An empty table gives an empty result.
    """

    def predict_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(profiles)
        for batch in pieces(batches):
            found = [predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(predict_batches, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", "text", "lang").dropna().where(~held_out(F.col("doc_id")))
    judged = identify_language(docs, learn_profiles(labelled))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
