"""Every registered query against its comparison SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as contract
from larder.plans import catalogue

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
# The two boosted models of 120 rounds take minutes; tests/test_series.py covers their parts.
SLOW_MODELS = {"ml_wastage_models", "ml_wastage_serve", "rule_recommendations_fitted"}


@pytest.fixture(scope="module")
def warehouse():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, warehouse, name):
    df = QUERIES[name](spark, FOLDER)
    found = warehouse.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert not [d for d in found.description if str(d[1]).startswith(("HUGEINT", "DECIMAL", "DATE", "TIMESTAMP", "BOOL"))]
    expected = ordered([tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()])
    assert ordered([tuple(r) for r in df.collect()]) == expected


def test_evidence_over_more_dishes(spark):
    """Ranks over two thousand dishes end in half-way digits, which the smallest tables never show."""
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    df = QUERIES["prj_evidence"](spark, folder)
    found = con.execute(ORACLE["prj_evidence"])
    names = [d[0] for d in found.description]
    assert ordered([tuple(r[c] for c in names) for r in df.collect()]) == ordered(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW_MODELS))
def test_without_sql_has_rows(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows
    for r in rows:
        for column, value in r.asDict().items():
            if column in ("Prediction", "prediction", "Expected_Wastage"):
                assert value >= 0 and math.isfinite(value)


def test_entry(spark):
    assert contract.entry(spark).columns == ["Item_ID", "Item_Name", "Units", "Net_Revenue", "Cost", "Contribution", "Orders", "Profit_Percent"]
