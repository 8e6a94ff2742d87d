"""Sources and sinks: NDJSON landing, JSON lines, JSON, CSV, Parquet views, staged promotion, a cache table."""

from __future__ import annotations

import contextlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a compressed file of a landing.
LANDING_ROWS = 500_000


def read_landing(spark: SparkSession, path: str, pattern: str = "*.ndjson") -> DataFrame:
    """Rows of all files in path: file, value, and ord, which orders them by file name, then place; blank lines are skipped."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    lines = lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    placed = lines.withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return placed.select("file", F.struct("file", "block", "line").alias("ord"), "value")


def parsed(landing: DataFrame, schema: T.StructType | str, resource_type: str | None = None) -> DataFrame:
    """The JSON of a landing as columns of a schema, of one resource type if named."""
    rows = landing.select("ord", F.inline(F.array(F.from_json("value", schema))))  # a condition on what is made here doesn't parse it again
    return rows if resource_type is None else rows.where(F.col("resourceType") == resource_type)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_landing(resources: DataFrame, path: str, compression: str = "none") -> DataFrame:
    """Writes resources (resourceType, value) by type as text; returns the count of each type.

    A task keeps a file open for each of some types, so that it needn't sort its rows by type; beyond these Spark sorts the rest. Compressed
    files aren't split when they are read, so they hold LANDING_ROWS at most.
    """
    with _setting(resources.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "16"):
        writer = resources.select("resourceType", "value").write.mode("overwrite").partitionBy("resourceType").option("compression", compression)
        (writer if compression == "none" else writer.option("maxRecordsPerFile", LANDING_ROWS)).text(path)
    return resources.groupBy("resourceType").agg(F.count("*").alias("n")).orderBy("resourceType")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parquet_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Registers a Parquet file as a view for SQL and returns it."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_report(spark: SparkSession, report: DataFrame, path: str) -> dict:
    """Writes a report of one row as a JSON document."""
    row = json.loads(report.limit(1).toJSON().first() or "{}")
    target, fs = _file_system(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps(row, indent=2), "utf-8"))
    stream.close()
    return row


class GateFailed(RuntimeError):
    """The staged data didn't pass; the final data is untouched."""


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def stage_then_promote(df: DataFrame, gate, staging: str, final: str, report: str | None = None) -> DataFrame:
    """Writes df to staging, runs gate(DataFrame) -> failures over what was written, and renames it to final if there are none.

    The number of failures and the first of them are written to report in either case. The last good data
    is kept beside final until the new one has its place; if a run ends in between, the next one puts it back first.
    """
    spark = df.sparkSession
    source, fs = _file_system(spark, staging)
    target, _ = _file_system(spark, final)
    kept, _ = _file_system(spark, f"{final}.last-good")
    if fs.exists(kept):
        if fs.exists(target):
            fs.delete(kept, True)
        else:
            _moved(fs, kept, target)
    df.write.mode("overwrite").parquet(staging)
    failures = gate(spark.read.parquet(staging))
    first = failures.limit(5).toJSON().collect()
    if report:
        counts = failures.agg((F.count("*") == 0).alias("passed"), F.count("*").alias("n_failures"))
        write_report(spark, counts.withColumn("first", F.lit(first)), report)
    if first:
        raise GateFailed(f"staged data in {staging} failed: {first}")
    had_one = fs.exists(target)
    if had_one:
        _moved(fs, target, kept)
    try:
        _moved(fs, source, target)
    except BaseException:
        if had_one:
            _moved(fs, kept, target)
        raise
    if had_one:
        fs.delete(kept, True)
    return spark.read.parquet(final)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file if there is none of that name, and says whether it did: compare and swap, as file systems give it."""
    target, fs = _file_system(spark, path)
    if fs.exists(target):
        return False
    try:
        stream = fs.create(target, False)
    except Exception:
        if fs.exists(target):  # another one was faster
            return False
        raise
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    return True


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of a cache's latest manifest and the parts that it lists, oldest first; 0 and none for a cache that isn't there."""
    folder, fs = _file_system(spark, f"{path}/manifests")
    numbers = [int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(folder)] if fs.exists(folder) else []
    if not numbers:
        return 0, []
    said = spark.read.text(f"{path}/manifests/{max(numbers):08d}.json", wholetext=True).first()
    return max(numbers), json.loads(said["value"])


def _commit(spark: SparkSession, path: str, change) -> None:
    """Adds a manifest whose parts are change(those of the latest one); again, if another writer was faster."""
    while True:
        n, parts = _manifest(spark, path)
        if create_new(spark, f"{path}/manifests/{n + 1:08d}.json", json.dumps(change(parts))):
            return


def cache_put(results: DataFrame, path: str) -> None:
    """Appends results (key, value) to a cache; later ones win, of one append the later row.

    A cache is a log: each append is a part of its own, which counts once a manifest lists it. A write that breaks off leaves nothing that is read.
    """
    part = f"part-{uuid.uuid4().hex}"
    results.select("key", "value", F.monotonically_increasing_id().alias("row")).write.parquet(f"{path}/{part}")
    _commit(results.sparkSession, path, lambda parts: [*parts, part])


def _cached(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    found = spark.createDataFrame([], "key string, value string, row long, part int")
    for i, part in enumerate(parts):
        found = found.union(spark.read.schema("key string, value string, row long").parquet(f"{path}/{part}").withColumn("part", F.lit(i)))
    return found


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by("value", F.struct("part", "row")).alias("value"))


def cache_get(spark: SparkSession, path: str) -> DataFrame:
    """key, value: the latest value of each key."""
    _, parts = _manifest(spark, path)
    rows = _cached(spark, path, parts)
    return _latest(rows) if len(parts) != 1 else rows.select("key", "value") if parts[0].startswith("base") else _latest(rows)


def cache_probe(requests: DataFrame, path: str) -> DataFrame:
    """key, value of the keys that are requested: only their rows of the cache are grouped, not the whole of it."""
    spark = requests.sparkSession
    rows = _cached(spark, path, _manifest(spark, path)[1])
    return _latest(rows.join(requests.select("key").distinct(), "key", "left_semi"))


def cache_compact(spark: SparkSession, path: str) -> None:
    """Puts all parts together as one without superseded values. Parts appended meanwhile stay behind it; old parts stay readable for who
    reads an old manifest."""
    _, parts = _manifest(spark, path)
    if not parts:
        return
    base = f"base-{uuid.uuid4().hex}"
    _latest(_cached(spark, path, parts)).withColumn("row", F.lit(0).cast("long")).write.parquet(f"{path}/{base}")
    _commit(spark, path, lambda now: [base, *now[len(parts) :]] if now[: len(parts)] == parts else now)
