"""Slots for models and services that are not part of this library; defaults are deterministic rules."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.vocabulary import TRANSIENT_HINTS


def is_transient(error: Exception) -> bool:
    """Whether an error may pass by itself, by its class name and message."""
    said = f"{type(error).__name__} {error}".lower()
    return any(hint in said for hint in TRANSIENT_HINTS)


def cache_key(text: Column, model: str, prompt_version: str) -> Column:
    """Changes with the prompt, the model and the text."""
    return F.sha2(F.concat(F.lit(prompt_version + "\0" + model + "\0"), text), 256)


def with_retries(call: Callable, *args, attempts: int = 4, base: float = 1.0, most: float = 30.0, sleep: Callable = time.sleep):
    """call(*args), again after transient errors, with waits that double up to a bound."""
    for attempt in range(attempts + 1):
        try:
            return call(*args)
        except Exception as error:
            if attempt == attempts or not is_transient(error):
                raise
            sleep(min(base * 2**attempt, most))


def answered(requests: DataFrame, client_factory: Callable[[], Callable[[str], str]], **retry: float) -> DataFrame:
    """key, value: the client's answer to the text of each request (key, text), asked once for each key.

    client_factory runs once for each task; the client takes a text and returns a text. retry: attempts, base and most of with_retries.
    """

    def run(frames: Iterator) -> Iterator:
        client = client_factory()
        for frame in frames:
            frame["value"] = [with_retries(client, text, **retry) for text in frame["text"]]
            yield frame[["key", "value"]]

    return requests.dropDuplicates(["key"]).select("key", "text").mapInPandas(run, "key string, value string")


def cache_first(requests: DataFrame, cache: DataFrame, client_factory: Callable | None) -> DataFrame:
    """requests (key, text) with value: from the cache where it has the key, else from the client; without a client a miss is an error."""
    misses = requests.join(cache.select("key"), "key", "left_anti")
    if client_factory is None:
        if misses.limit(1).count():
            raise LookupError("requests that the cache has no answer to")
        return requests.join(cache, "key")
    return requests.join(cache.unionByName(answered(misses, client_factory)), "key")


def tried(client: Callable[[str], str], text: str | None, **retry: float) -> tuple[str | None, str | None]:
    """The client's answer and no error, or no answer and what went wrong, after retries. Nothing is asked about a null text."""
    try:
        return (None if text is None else with_retries(client, text, **retry)), None
    except Exception as error:
        return None, f"{type(error).__name__}: {error}"


def attempted(requests: DataFrame, client_factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """key, value, error: as answered(), but a request that fails has an error and no value, and others go on."""

    def run(frames: Iterator) -> Iterator:
        client = client_factory()
        for frame in frames:
            said = [tried(client, text) for text in frame["text"]]
            frame["value"], frame["error"] = [v for v, _ in said], [e for _, e in said]
            yield frame[["key", "value", "error"]]

    return requests.dropDuplicates(["key"]).select("key", "text").mapInPandas(run, "key string, value string, error string")


def submit_batch(requests: DataFrame, cache: DataFrame, path: str) -> str | None:
    """Writes the requests (key, text) that the cache has no answer to, once each, as a batch to path; its name, or None if there are none.

    Nothing is asked yet. A batch is a folder: its requests, and a table of results to which each run adds. It is all that others need.
    """
    misses = requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", "text")
    if not misses.limit(1).count():
        return None
    name = uuid.uuid4().hex
    misses.write.parquet(f"{path}/{name}/requests")
    return name


RESULT = "key string, value string, error string, n long"


def ledger(spark: SparkSession, path: str, name: str) -> DataFrame:
    """key, text, state, value, error, tries of each request of a batch. state: answered, failed (each time so far), or open."""
    requests = spark.read.parquet(f"{path}/{name}/requests")
    folder = f"{path}/{name}/results"
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    results = spark.read.schema(RESULT).option("recursiveFileLookup", True).parquet(folder) if known else spark.createDataFrame([], RESULT)
    last = results.groupBy("key").agg(F.max_by("value", F.when(F.col("error").isNull(), F.col("n"))).alias("value"), F.max_by("error", "n").alias("error"), F.count_if(F.col("error").isNull()).alias("right"), F.count("*").alias("tries"))
    state = F.when(F.col("right") > 0, "answered").when(F.col("tries") > 0, "failed").otherwise("open")
    found = requests.join(last, "key", "left").withColumn("state", state)
    return found.select("key", "text", "state", "value", F.when(F.col("state") == "failed", F.col("error")).alias("error"), F.coalesce("tries", F.lit(0)).alias("tries"))


def run_batch(spark: SparkSession, path: str, name: str, client_factory: Callable[[], Callable[[str], str]]) -> None:
    """Asks for what isn't answered yet: all requests at first, later those that failed or were never asked. Results are added to the batch."""
    open_ = ledger(spark, path, name).where("state <> 'answered'")
    n = (open_.agg(F.max("tries")).first()[0] or 0) + 1
    attempted(open_, client_factory).withColumn("n", F.lit(n).cast("long")).write.parquet(f"{path}/{name}/results/run-{n:04d}-{uuid.uuid4().hex}")


def batch_status(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row: submitted, answered, failed, open, and status: ended if none is open, else in_progress."""
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    counts = ledger(spark, path, name).agg(F.count("*").alias("submitted"), count("answered"), count("failed"), count("open"))
    return counts.withColumn("status", F.when(F.col("open") == 0, "ended").otherwise("in_progress"))


def collect_batch(spark: SparkSession, path: str, name: str, partial: bool = False) -> DataFrame:
    """key, value: the answers to a submitted batch, for the cache. A batch that hasn't ended, or in which requests failed, is an error,
    unless the part that is answered is asked for."""
    said = batch_status(spark, path, name).first()
    if not partial and said["status"] != "ended":
        raise RuntimeError(f"batch {name} has not ended: {said['open']} requests are open")
    if not partial and said["failed"]:
        raise RuntimeError(f"{said['failed']} requests of batch {name} failed")
    return ledger(spark, path, name).where("state = 'answered'").select("key", "value")


def synthesized(needed: DataFrame, client_factory: Callable[[], Callable[[str], str]], fields: str) -> DataFrame:
    """Records that fill deficits: patient_id, note_id, the fields, synthesized and synthesized_category.

    needed: category, needed. The client gets a prompt for each record and answers a JSON text of the fields (a schema). Ids are
    digests of category and number, so that a rerun names the same records.
    """
    each = needed.where("needed > 0").select("category", F.explode(F.sequence(F.lit(1).cast("long"), F.col("needed").cast("long"))).alias("i"))
    key = F.substring(F.sha2(F.concat_ws(":", "category", "i"), 256), 1, 32)
    asked = each.select(key.alias("key"), "category", F.concat(F.lit("A record of a patient with "), "category").alias("text"))
    said = asked.join(answered(asked, client_factory), "key").withColumn("_f", F.from_json("value", fields))
    return said.select(
        F.concat(F.lit("synthetic-"), "key").alias("patient_id"),
        F.concat(F.lit("note-synthetic-"), "key").alias("note_id"),
        "_f.*",
        F.lit(True).alias("synthesized"),
        F.col("category").alias("synthesized_category"),
    )


def low_confidence(confidence: Column, least: float = 0.7) -> Column:
    """Whether a record should be looked at; one that says nothing of its confidence need not."""
    return F.coalesce(confidence, F.lit(1.0)) < least


def rule_detector(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Stands for a trained detector: array<struct<type, text>> of all matches of each pattern."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _typed(kind)) for kind, p in patterns]
    return F.concat(*found)


def _typed(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("type"), m.alias("text"))
