"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from cellstrata.plans import io_queries  # noqa: F401
from cellstrata.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(frame):
    def one(v):
        if not isinstance(v, (list, tuple, dict)) and getattr(v, "ndim", 0) == 0 and pd.isna(v):
            return "~"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return repr(round(float(v), 6) + 0.0)

    columns = sorted(frame.columns)
    return sorted(tuple(map(one, r)) for r in frame[columns].astype(object).itertuples(index=False))


def near(a, b):
    def same(x, y):
        try:
            return math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-5)
        except ValueError:
            return x == y

    return len(a) == len(b) and all(len(x) == len(y) and all(map(same, x, y)) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sql):
    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(found.columns)
        return
    want = sql.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(want.columns)
    assert len(want) or not name.startswith("x12")
    a, b = rows(found), rows(want)
    assert a == b or near(a, b)


@pytest.mark.parametrize("z", [0.0, 1.5, 2.9, 3.0, 8.0, 30.0, 45.0])
def test_tails_of_the_oracle(z, sql):
    """p of the oracles of ranked genes is that of the normal distribution, however large z is."""
    from cellstrata.plans import queries

    p, padj = sql.execute(f"with w as (select '1' as label, 'g' as gene, 1.0::double as lfc, {z}::double as z), {queries._P_FAR} select p, padj from tested").fetchone()
    assert math.isclose(p, math.erfc(z / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-12 if z < 3 else 0.0) and p == padj


def test_triples_of_a_matrix_span_tasks(spark, monkeypatch):
    """The lines of the matrix file lie in several files, its three header lines first."""
    folders = []
    own = io_queries._folder
    monkeypatch.setattr(io_queries, "_folder", lambda t: (lambda f: (folders.append(f), f)[1])(own(t)))
    monkeypatch.setattr(io_queries.readers, "read_mtx", lambda spark, *paths: spark.read.text(paths[2]).selectExpr("1 as cell_id", "1 as gene", "1 as n"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        QUERIES["s3_mtx"](spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    files = sorted(f for f in os.listdir(folders[2].removeprefix("file:")) if f.startswith("part"))
    lines = [open(os.path.join(folders[2].removeprefix("file:"), f)).read().splitlines() for f in files]
    assert [x for part in lines for x in part][:3] == ["%%MatrixMarket matrix coordinate integer general", "%", "0 0 0"]
    assert max(map(len, lines)) < 0.6 * sum(map(len, lines))
