"""Every registered query with SQL gives what DuckDB gives for it, on the smallest tables."""

import hashlib
import math
import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else round(float(value), 6)
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in values))


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry_points.queries()[name](spark, SF), duck.sql(entry_points.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["k", "code", "severity", "field", "expected", "actual"]


@pytest.mark.parametrize("large", [None, 10_000])
def test_stream_takes_all_files(spark, monkeypatch, large):
    """With ``large``, some files are read as streams."""
    if large:
        from ledgerleaf.streaming import ingest

        monkeypatch.setattr(ingest, "LARGE", large)
    files = {p.name: p.read_bytes() for p in pathlib.Path(SF).rglob("*.parquet") if p.is_file()}
    got = entry_points.queries()["stream_ingest"](spark, SF).collect()
    assert len(files) >= len(TABLES)
    assert {r.name: (r.length, r.content_hash) for r in got} == {k: (len(b), hashlib.sha256(b).hexdigest()) for k, b in files.items()}
