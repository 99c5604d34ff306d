"""Compact numbers, mismatches, near edges, compositions, sinks that read back, counters, natural order."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fragspark.functions import compact_number, round_half_up
from fragspark.operators import lengths, prepare, windows
from fragspark.operators.alignments import mismatches
from fragspark.plans.counters import Counters
from fragspark.sources import text


def test_compact_numbers(spark):
    df = spark.createDataFrame([(1.25,), (2.0,), (-0.0001,), (0.125,), (-1.5,), (100.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(compact_number("x", 2)).collect()] == ["1.25", "2", "0", "0.13", "-1.5", "100", "NaN"]


def test_mismatches(spark):
    df = spark.createDataFrame([("10A5^AC0T3", 100), ("25", 7), ("0C0G4", 0)], "md string, pos long")
    assert [r[0] for r in df.select(mismatches("md", "pos")).collect()] == [[110, 118], [], [0, 1]]


def test_near_edges(spark):
    rows = [("chr1", 10, 20, "+", "a", 0), ("chr1", 10, 30, "-", "b", 1), ("chr1", 40, 41, None, "c", 2)]
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, strand string, name string, n int")
    at = lambda *a, **o: sorted((r.pos, r.name) for r in prepare.near_edges(df, *a, order="n", label="name", **o).collect())
    assert at("left") == [(10, "a"), (40, "c")] and at("left", "drop-all") == [(40, "c")] and at("left", "merge") == [(10, "a,b"), (40, "c")]
    assert at("right") == [(19, "a"), (29, "b"), (40, "c")] and at("nearest") == [(10, "a"), (19, "a"), (29, "b"), (40, "c")]
    assert at("upstream") == [(10, "a"), (29, "b"), (40, "c")] and at("downstream") == [(10, "b"), (19, "a"), (40, "c")]
    with pytest.raises(Exception, match="share the edge"):
        at("left", "error")


def test_compositions(spark):
    df = spark.createDataFrame([("a", None, "x")], "p string, q string, r string")
    assert prepare.compositions(df, ["both=p,q", "all=both,r"]).first().all == "a..x"
    for bad in ("=p", "x=", "x=p,zz"):
        with pytest.raises(ValueError):
            prepare.compositions(df, [bad])


def test_factors_read_back(spark, tmp_path):
    bins = spark.createDataFrame([("chr2", 0, 5, 0.5, 2.0), ("chr1", 5, 9, None, 0.0), ("chr1", 0, 5, 1.5, 0.25)], "chrom string, start_pos long, end_pos long, smoothed double, scaling_factor double")
    text.write_scaling_factors(bins, f"{tmp_path}/f", {"gc_mode": "tag", "ignore_gap": "false"})
    back, remarks = text.scaling_factors(spark, f"{tmp_path}/f")
    assert remarks == {"gc_mode": "tag", "ignore_gap": "false"}
    assert sorted(map(tuple, back.collect())) == [("chr1", 0, 5, 0.25), ("chr1", 5, 9, 0.0), ("chr2", 0, 5, 2.0)]
    text.write_group_index(spark.createDataFrame([(1, "b"), (0, "a")], "group_idx int, group_name string"), f"{tmp_path}/g")
    assert [r.value for r in spark.read.text(f"{tmp_path}/g").collect()] == ["group_idx\tgroup_name", "0\ta", "1\tb"]
    (tmp_path / "c.txt").write_text("chr7\nchrX\t5\n")
    assert text.chromosomes(spark, str(tmp_path / "c.txt")) == ["chr7", "chrX"] and text.chromosomes(spark, "all") is None


def test_counters(spark):
    seen = Counters()
    reads = seen.reads(spark.createDataFrame([(0,), (16,), (16,)], "flag int"))
    kept = seen.count(reads.where("flag = 16"), "kept", most=F.max("flag"))
    assert kept.collect() and seen.told() == {"reads": {"rows": 3, "forward": 1, "reverse": 2}, "kept": {"rows": 2, "most": 16}}
    with pytest.raises(ValueError):
        seen.count(reads, "kept")


def test_natural_order(spark):
    chroms = spark.createDataFrame([("chr10", 5), ("chrX", 5), ("chr2", 15)], "chrom string, chrom_len long")
    got = {(r.chrom, r.start_pos): r.window_idx for r in windows.fixed_size(chroms, 10).collect()}
    assert got == {("chr2", 0): 0, ("chr2", 10): 1, ("chr10", 0): 2, ("chrX", 0): 3}


def test_weights_add_up_in_any_order(spark):
    """A sum on the edge between two last places rounds up, whichever way the shares come."""
    shares = [k % 97 / 101 for k in range(1, 300)]
    shares.append(float(Fraction(285_000_001, 2_000_000) - sum(map(Fraction, shares))))
    for order in (shares, shares[::-1], sorted(shares), sorted(shares, reverse=True)):
        df = spark.createDataFrame([(0, 50, x) for x in order], "start_pos long, end_pos long, w double").coalesce(1)
        told = lengths.counts(df, [], [30, 60], F.col("w")).select(round_half_up("count").alias("count"))
        assert [r["count"] for r in told.collect()] == [142.500001]
    odd = spark.createDataFrame([(0, 50, float("inf")), (0, 50, 0.1), (0, 80, float("nan"))], "start_pos long, end_pos long, w double")
    assert sorted(str(r["count"]) for r in lengths.counts(odd, [], [30, 60, 90], F.col("w")).collect()) == ["inf", "nan"]
