"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from stackfuse import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        if name == "phase_shift":
            assert (got.dx == got.found_x).all() and (got.dy == got.found_y).all()
        if name == "ecc_affine":
            assert got.found.mean() >= 0.9
        return
    want = sql.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in columns if got[c].dtype.kind != "f"] + [c for c in columns if got[c].dtype.kind == "f"]
    got, want = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if got[c].dtype.kind == "f":
            assert abs(got[c] - want[c]).max() <= 1e-5, c
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", ["warp_bilinear", "warp_no_fill"])
def test_every_warp_meets_the_whole_canvas(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got) == len(got.drop_duplicates(["stack_id", "frame_idx", "y", "x"])) == 25 * 32 * 32
    assert got.groupby(["stack_id", "frame_idx"]).ngroups == 25 and got.y.max() == got.x.max() == 31
