"""Every catalogue query gives what its SQL gives on the same tables."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

from vellum.plans import clinical  # noqa: F401 (registers its queries)
from vellum.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def database(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(names, found):
    order = [names.index(n) for n in sorted(names)]
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, database, name):
    df = QUERIES[name](spark, small)
    con = database.execute(SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, con.fetchall())


def same_as_sql(spark, folder, name, table, kinds, given):
    """The query's columns and rows over a small table, once they are found to be what its SQL gives."""
    spark.createDataFrame(given, kinds).coalesce(1).write.parquet(f"file://{folder}/{table}.parquet")
    df = QUERIES[name](spark, f"file://{folder}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'").execute(SQL[name])
    names, got = [d[0] for d in con.description], df.collect()
    assert rows(df.columns, got) == rows(names, con.fetchall())
    return got


ORDER_KINDS = "o_orderkey long, o_custkey long"


def test_groups_without_a_first_place_come_last(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "group_split", "orders", ORDER_KINDS, [(None if c == 5 else c, c) for c in range(10)])
    assert {r.patient: r.split for r in got if r.split != "train"} == {9: "val", 5: "test"}


def test_records_without_a_patient_count_in_the_shares(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "split_ratio", "orders", ORDER_KINDS, [(i, None if i % 5 == 0 else i % 7) for i in range(1, 60)])
    assert sum(r.n for r in got) == 59


def test_batches_of_documents_that_lack_something(spark, tmp_path):
    """Sources, languages and counts that are null, and an id that is; what is null says nothing but lies in a batch."""
    given = [(i, None if i % 3 == 0 else "é\u0301😀"[: i % 4], None if i % 11 == 0 else "日本", None if i % 13 == 0 else i) for i in range(1, 80)]
    given += [(None, "abc", "en", 5)] + [(i, "abc", "en", 5) for i in range(100, 180)]
    kinds = "doc_id long, source string, lang string, n_chars long"
    got = same_as_sql(spark, tmp_path, "training_batches", "documents", kinds, given)
    lacking = [r for r in got if r.n_attended is None]
    assert len(lacking) == sum(None in row[1:] for row in given) and all(r.n_labels == 0 for r in lacking)


def test_records_without_a_key_take_no_part_in_the_splits(spark, tmp_path):
    given = [(None if i % 4 == 0 or i % 7 in (3, 4) else i, i % 7) for i in range(1, 40)] + [(100 + i, None) for i in range(5)]
    got = same_as_sql(spark, tmp_path, "build_splits", "orders", ORDER_KINDS, given)
    assert got and all(r.o_orderkey % 11 for r in got)
