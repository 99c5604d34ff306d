"""Selections on outputs: what is refused, order, lookups, dense and sparse forms, files."""

import math

import pytest

from fragspark.operators.selection import Bins, Output, load


@pytest.fixture(scope="module")
def out(spark):
    values = spark.createDataFrame([(0, 30, "AC", 2.0), (0, 40, "GT", 3.0), (2, 30, "AC", 1.0), (2, 50, "GT", 0.0)], "window_idx long, length_start long, motif string, count double")
    rows = spark.createDataFrame([(0, "a", 0.1), (1, "b", 0.4), (2, "b", None)], "window_idx long, group_name string, blacklisted_fraction double")
    return Output(values, row="window_idx", rows=rows, lengths=Bins("length_start", (30, 40, 50, 60)), motif="motif", motifs=("AC", "GT"))


def test_rows(out):
    got = out.windows(2, 0).values.orderBy("row_order", "length_start").collect()
    assert [(r.window_idx, r.row_order) for r in got] == [(2, 0), (2, 0), (0, 1), (0, 1)]
    with pytest.raises(ValueError):
        out.windows(2, 2)
    assert {r.window_idx for r in out.groups_by_name("b").values.collect()} == {2}
    assert {r.window_idx for r in out.max_blacklisted(0.2).values.collect()} == {0}
    assert out.windows().values.count() == 0
    with pytest.raises(ValueError):
        Output(out.values).windows(1)


def test_bins(out):
    assert out.length_range(39, 41).lengths.edges == (30, 40, 50)
    assert {r.length_start for r in out.length_range(40, 41).values.collect()} == {40}
    for bad in ((41, 41), (60, 70)):
        with pytest.raises(ValueError):
            out.length_range(*bad)
    with pytest.raises(ValueError):
        out.length_bins(35)
    with pytest.raises(ValueError):
        out.position_range(0, 5)
    with pytest.raises(ValueError):
        out.select_motifs("TT")


def test_forms(out, monkeypatch):
    assert out.entries().count() == 3
    dense = out.dense()
    assert dense.count() == 3 * 3 * 2 and dense.agg({"count": "sum"}).first()[0] == 6.0
    assert out.lookup(window_idx=0, length_start=40, motif="GT") == 3.0 and out.lookup(window_idx=1, length_start=40, motif="GT") == 0.0
    with pytest.raises(ValueError):
        out.lookup(window_idx=0)
    wide = {(r.window_idx, r.motif): (r.count_30_40, r.count_40_50, r.count_50_60, r.group_name) for r in out.frame(wide=True).collect()}
    assert wide[0, "AC"] == (2.0, 0.0, 0.0, "a") and wide[2, "GT"] == (0.0, 0.0, 0.0, "b")
    ratio = {r.window_idx: r.ratio for r in out.ratio((30, 40), (40, 60)).collect()}
    assert abs(ratio[0] - 2 / 3) < 1e-12 and math.isnan(ratio[2])
    monkeypatch.setattr("fragspark.operators.selection.MOST_DENSE", 100)
    with pytest.raises(ValueError):
        out.dense()


def test_files(spark, out, tmp_path):
    out.select_motifs("GT").write(f"{tmp_path}/o")
    back = load(spark, f"{tmp_path}/o")
    assert back.motifs == ("GT",) and back.lengths == out.lengths and back.positions is None
    assert back.length_range(30, 50).entries().collect()[0]["count"] == 3.0 and back.rows.count() == 3
