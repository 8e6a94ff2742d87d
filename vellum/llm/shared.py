"""What several operators need: the word rule, table reading, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where it is unset, in local mode only."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return _own_folder[context.applicationId]


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: what follows is planned with true sizes, reads only the columns it needs, and
    survives the loss of executors. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vellum/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """stored(df), and its number of rows, taken while it is written."""
    rows = Observation()
    return stored(df.observe(rows, F.count(F.lit(1)).alias("n")), what), rows.get["n"]


#: Rows of a few numbers or short strings that may be broadcast: tens of megabytes.
FEW = 500_000


def small(df: DataFrame, n: int, rows: int = FEW) -> DataFrame:
    """df, a table of n short rows, marked for broadcast if they are few; else joins with it are shuffled."""
    return F.broadcast(df) if n <= rows else df


def sized(df: DataFrame, rows: int = FEW) -> DataFrame:
    """small() of a stored table whose rows aren't counted yet."""
    return small(df, df.count(), rows)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*more: str) -> Column:
    """Names a row by what it says: doc_id, text and more columns, by SHA-256; equal rows share a name."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", *more, "text")]
    nulls = [F.col(c).isNull().cast("string") for c in ("doc_id", *more)]
    return F.sha2(F.concat_ws("\x1f", *nulls, *fields), 256)


def words(text: Column) -> Column:
    """The words of a text, [] for null or blank ones."""
    kept = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(kept) > 0, F.split(kept, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def span_list(spans: Column) -> Column:
    """array<struct<kind, start, end>> as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones, so that few rows are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
