"""Every query of the library beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

from scriptorium.plans import catalog

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    return round(float(v), 9) if v.__class__.__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(DIR):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{DIR}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = sorted(str([plain(v) for v in r]) for r in df.collect())
    if name in catalog.ORACLES:
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        assert rows == sorted(str([plain(v) for v in r]) for r in want)
    else:
        assert rows


@pytest.mark.parametrize("name", ["ocr_compare_pairs", "candidate_ranking", "assembled_documents", "chunk_documents", "lexical_variants"])
def test_partitioning_changes_nothing(spark, name):
    read = lambda: sorted(map(str, catalog.QUERIES[name](spark, DIR).collect()))
    many = read()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert read() == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
