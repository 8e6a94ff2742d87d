"""Provenance of artifacts and a registry of runs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.sources import io


#: Bytes of a file that are read at a time.
CHUNK = 1 << 20


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a short list of paths at which there is something."""
    found = []
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            found.append(path)
    return found


TOKEN = re.compile(rb'\\|["\[\]{},]|[^\s\\"\[\]{},]+')


class Records:
    """Counts the records of a file that comes in chunks: lines that aren't blank (.jsonl, .ndjson), lines but for the header (.csv), or the
    elements of an array (.json); else None. What it keeps doesn't grow with the file."""

    def __init__(self, path: str):
        self.kind = path.rpartition(".")[2]
        self.lines, self.written, self.in_line, self.in_text = 0, 0, False, False
        self.depth, self.commas, self.values, self.quoted, self.skip, self.top = 0, 0, False, False, 0, b""

    def add(self, chunk: bytes) -> None:
        if self.kind != "json":
            *ended, rest = chunk.split(b"\n")
            for part in ended:
                self.lines += 1
                self.written += self.in_text or bool(part.strip())
                self.in_line = self.in_text = False
            self.in_line |= bool(rest)
            self.in_text |= bool(rest.strip())
            return
        end = self.skip
        for m in TOKEN.finditer(chunk):
            if m.start() < end:
                continue
            token = m[0]
            if self.quoted:
                if token == b"\\":
                    end = m.end() + 1
                elif token == b'"':
                    self.quoted = False
                continue
            self.top = self.top or token[:1]
            if token in b"]}":
                self.depth -= 1
            elif token == b",":
                self.commas += self.depth == 1
            else:
                self.values |= self.depth == 1
                self.depth += token in b"[{"
                self.quoted = token == b'"'
        self.skip = max(0, end - len(chunk))

    def count(self) -> int | None:
        if self.kind in ("jsonl", "ndjson"):
            return self.written + self.in_text
        if self.kind == "csv":
            return max(self.lines + self.in_line - 1, 0)
        if self.kind == "json" and self.top == b"[":
            return self.commas + self.values
        return None


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of paths: path, sha256, n_bytes, record_count. Files are read as streams, a chunk at a time."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            system, place = fs.FileSystem.from_uri(path)
            digest, records, n = hashlib.sha256(), Records(path), 0
            with system.open_input_stream(place, compression=None) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
                    records.add(chunk)
                    n += len(chunk)
            rows.append((path, digest.hexdigest(), n, records.count()))
        kinds = [("path", pa.string()), ("sha256", pa.string()), ("n_bytes", pa.int64()), ("record_count", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256, n_bytes, record_count of each file that exists; a task for each, which streams it, however large it is."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "path string, sha256 string, n_bytes long, record_count long")
    listed = spark.createDataFrame([(p,) for p in found], "path string").repartition(len(found))
    return listed.mapInArrow(read_batches, "path string, sha256 string, n_bytes long, record_count long")


def provenance(spark: SparkSession, artifacts: list[tuple[str, str]]) -> DataFrame:
    """stage, artifact, sha256, n_bytes, record_count of each file that exists, in the order of artifacts: (stage, path), a short list."""
    rows = [(i, stage, path, path.rsplit("/", 1)[-1]) for i, (stage, path) in enumerate(artifacts)]
    stages = spark.createDataFrame(rows, "place int, stage string, path string, artifact string")
    found = stages.join(file_digests(spark, [path for _, path in artifacts]), "path").orderBy("place")
    return found.select("stage", "artifact", "sha256", "n_bytes", "record_count")


def data_lineage(spark: SparkSession, files: dict[str, str], manifest: DataFrame | None = None) -> DataFrame:
    """One row: data_lineage, a map of <name>_sha256 of the files that exist, and gold_version if a manifest (version) is given."""
    names = spark.createDataFrame([(p, f"{n}_sha256") for n, p in files.items()], "path string, said string")
    entries = file_digests(spark, list(files.values())).join(names, "path").select("said", F.col("sha256").alias("what"))
    if manifest is not None:
        entries = entries.union(manifest.select(F.lit("gold_version"), "version"))
    return entries.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("said", "what")))).alias("data_lineage"))  # a short list of files


def register_run(registry: DataFrame, run: DataFrame) -> DataFrame:
    """registry with a further run, of version v<number of runs>. Runs of a registry are few and have a version each."""
    number = registry.agg((F.count("*") + 1).alias("_n"))
    versioned = run.drop("version").join(F.broadcast(number)).withColumn("version", F.concat(F.lit("v"), F.col("_n").cast("string"))).drop("_n")
    return registry.unionByName(versioned, allowMissingColumns=True)


def append_run(spark: SparkSession, path: str, run: DataFrame) -> str:
    """Adds run (one row) to the registry in a folder, and returns its version.

    Each run is a file of its own, whose name is its number. A file is only created where there is none, so of two runs registered at
    once one gets the next number; a reader never sees a registry that lacks an earlier run.
    """
    said = run.limit(1).toJSON().first()
    n = 1
    while not io.create_new(spark, f"{path}/run-{n:08d}.json", said.replace("{", f'{{"number":{n},"version":"v{n}",' if said != "{}" else f'{{"number":{n},"version":"v{n}"', 1)):
        n += 1
    return f"v{n}"


def read_registry(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """number, version and the fields (a schema) of all runs in a registry's folder."""
    return spark.read.schema(f"number long, version string, {fields}").option("pathGlobFilter", "run-*.json").json(path)


def with_versions(runs: DataFrame, order: str) -> DataFrame:
    """Versions v1, v2, ... in order. runs is a registry: a row for each training run."""
    return runs.withColumn("version", F.concat(F.lit("v"), F.row_number().over(Window.orderBy(order))))


def latest_run(runs: DataFrame, order: str) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), order).alias("r")).select("r.*")


def best_epoch(losses: DataFrame, run: str) -> DataFrame:
    """The first epoch of least loss of each run. losses: run, epoch, loss."""
    return losses.groupBy(run).agg(F.min(F.struct("loss", "epoch")).alias("b")).select(run, F.col("b.epoch").alias("epoch"), F.col("b.loss").alias("loss"))


def weighted_mean(df: DataFrame, value: str, weight: str, name: str) -> DataFrame:
    """Mean of value by weight; weights that sum to less than one count as one."""
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias(name))


def call_stats(calls: DataFrame) -> DataFrame:
    """n_calls, retries, total and mean seconds of a log of calls (seconds, retries)."""
    return calls.agg(F.count("*").alias("n_calls"), F.sum("retries").alias("retries"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"))
