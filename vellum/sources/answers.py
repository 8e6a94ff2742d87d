"""A model's answers as a Spark data source: a scan of a table of requests, which asks for what it reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from vellum.operators.external import tried

SCHEMA = pa.schema([("key", pa.string()), ("value", pa.string()), ("error", pa.string())])
#: Bytes of requests that one task asks for, and requests that are Python objects at a time. A call costs far more than a row.
SPLIT, ROWS = 1 << 20, 256


@dataclass
class Split(InputPartition):
    """The row groups of a file that start in a range of its bytes."""

    file: str
    start: int
    end: int


class AnswerReader(DataSourceReader):
    """Partitions are planned from the sizes of files; footers and rows are read by tasks."""

    def __init__(self, path: str, client_factory: Callable, size: int, retry: dict):
        self.path, self.client_factory, self.size, self.retry = path, client_factory, size, retry

    def partitions(self) -> list[Split]:
        system, top = fs.FileSystem.from_uri(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and f.base_name.endswith(".parquet")]
        return [Split(f.path, at, at + self.size) for f in files for at in range(0, f.size, self.size)]

    def wanted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The requests of a batch that are asked."""
        return batch

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(split, Split):  # a folder without files
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        client = None
        with system.open_input_file(split.file) as opened, pq.ParquetFile(opened) as file:
            starts = [row_group_start(file.metadata.row_group(i)) for i in range(file.metadata.num_row_groups)]
            mine = [i for i, at in enumerate(starts) if split.start <= at < split.end]
            for batch in file.iter_batches(ROWS, row_groups=mine, columns=["key", "text"]) if mine else ():
                asked = self.wanted(batch)
                if asked.num_rows:
                    client = client or self.client_factory()
                    said = [tried(client, text, **self.retry) for text in asked["text"].to_pylist()]
                    answers = [asked["key"].cast(pa.string()), pa.array([v for v, _ in said], pa.string()), pa.array([e for _, e in said], pa.string())]
                    yield pa.RecordBatch.from_arrays(answers, schema=SCHEMA)


class KeyedReader(AnswerReader):
    """An AnswerReader that takes conditions on key, so that other requests are never asked."""

    keys: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for each in filters:
            if isinstance(each, (EqualTo, In)) and each.attribute == ("key",):
                named = {each.value} if isinstance(each, EqualTo) else set(each.value)
                self.keys = named if self.keys is None else self.keys & named
            else:
                yield each

    def wanted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.keys is None:
            return batch
        return batch.filter(pc.is_in(batch["key"].cast(pa.string()), pa.array(sorted(k for k in self.keys if k is not None), pa.string())))


def row_group_start(group: pq.RowGroupMetaData) -> int:
    """Where the first page of a row group is: one place in the file, so that one split has it."""
    columns = [group.column(i) for i in range(group.num_columns)]
    return min(min(c.data_page_offset, c.dictionary_page_offset or c.data_page_offset) for c in columns)


def register_answers(spark: SparkSession, name: str, client_factory: Callable[[], Callable[[str], str]], **retry: float) -> None:
    """Makes a client a format: spark.read.format(name).load(folder) is key, value, error of each request in the folder's Parquet files.

    Requests are key and text (a null text is answered by null); a request that fails, after retries if the error may pass, has an error
    and no value. client_factory runs once for each task that asks anything. Each task asks for about splitBytes of requests (an option).
    Each scan asks anew, and a task that is lost asks its share again, so write the answers to a cache before they are used twice.
    With the option keys, conditions on key that can be pushed down select what is asked; this needs spark.sql.python.filterPushdown.enabled.
    The folder must be one that pyarrow.fs opens. A folder without files gives no rows.
    """

    class Answers(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "key string, value string, error string"

        def reader(self, schema) -> DataSourceReader:
            kind = KeyedReader if self.options.get("keys", "false").lower() == "true" else AnswerReader
            return kind(self.options["path"], client_factory, int(self.options.get("splitBytes", SPLIT)), retry)

    spark.dataSource.register(Answers)
