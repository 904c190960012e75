"""Every registered raster query against its SQL, and its stated row counts and sums."""

from collections import Counter

import duckdb
import pytest

from voxelgrid import catalog

SF = "/root/testdata/sf0.01"
TABLES = "customer supplier orders events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    names = sorted(df.columns)
    return Counter(tuple(r[c] for c in names) for r in df.collect()), names


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    got, names = rows_of(catalog.QUERIES[name](spark, SF))
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize(
    ("name", "rows", "column", "total"),
    [("block_average_r1", 1200, "attr1", 45980), ("block_average", 150, "attr1", 5744), ("sliding_z_average", 270, "attr1", 10317), ("halo_group", 22, "n", 24480), ("halo_tile", 80, "n", 41984), ("halo_ordinary2d", 40, "n", 50336), ("halo_group2d", 19, "n", 44096), ("quadrant2d_windows", 27, None, None)],
)
def test_stated_values(spark, name, rows, column, total):
    found = catalog.QUERIES[name](spark, SF).collect()
    assert len(found) == rows
    if column:
        assert sum(r[column] for r in found) == total
