"""Every query of the catalogue against its SQL on the smallest tables, and the entry points."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from docprobe.plans import catalogue, catalogue_files, catalogue_forge, catalogue_order, catalogue_pixels  # noqa: F401  each registers its queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cells(df):
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{x:.9g}" if isinstance(x, float) else str(int(x)) if type(x).__name__ in ("bool", "bool_") else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE:
        want = db.sql(catalogue.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)
    else:
        assert len(got)


def test_entry_points(spark):
    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
