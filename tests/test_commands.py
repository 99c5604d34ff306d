"""Whole commands on small hand-worked inputs."""

import random

import numpy as np
import pytest

from fragspark.operators import sequence
from fragspark.operators.alignments import Clips
from fragspark.plans import commands
from fragspark.plans.commands import Selection, WindowPlan

READ = "chrom string, qname string, pos long, flag int, mapq int, cigar string, seq string, qual array<int>, mate_chrom string, gc_tag double"


def read(qname, pos, flag, cigar, mapq=40, gc=None):
    n = sum(int(x) for x, op in __import__("re").findall(r"(\d+)([MIDNS=X])", cigar) if op not in "DN")
    return ("chr1", qname, pos, flag, mapq, cigar, ("ACGT" * 30)[:n], [30] * n, "chr1", gc)


@pytest.fixture(scope="module")
def reads(spark):
    rows = [read("a", 100, 99, "5S20M2D20M"), read("a", 130, 147, "12M2D30M3S"), read("b", 200, 99, "30M"), read("b", 260, 147, "30M4I10M")]
    return spark.createDataFrame(rows, READ)


def test_coverage_of_reads(reads):
    select = Selection(10, 1000)
    runs = lambda **o: sorted((r.start_pos, r.end_pos, r.value) for r in commands.coverage_of_reads(reads, select, **o).collect())
    # a: forward covers 100..120 and 122..142, reverse 130..142 and 144..174; each mate's gap is closed where the other covers it
    assert runs() == [(100, 120, 1.0), (122, 142, 1.0), (144, 174, 1.0), (200, 300, 1.0)]
    assert runs(ignore_gap=True) == [(100, 120, 1.0), (122, 142, 1.0), (144, 174, 1.0), (200, 230, 1.0), (260, 300, 1.0)]
    assert runs(least_gap=3) == [(100, 174, 1.0), (200, 300, 1.0)]


def test_lengths_of_reads(spark, reads):
    got = lambda **o: sorted((r.length_start, round(r["count"], 6)) for r in commands.lengths_of_reads(reads, Selection(10, 1000), bins="60:200:1", **o).collect())
    assert got() == [(74, 1.0), (100, 1.0)]
    assert got(indels="adjust") == [(70, 1.0), (104, 1.0)]  # 120..122 and 142..144 lie out of the mates' overlap 130..142
    assert got(indels="adjust", clips="adjust") == [(78, 1.0), (104, 1.0)]
    assert got(indels="skip") == [] and got(clips="skip") == [(100, 1.0)] and got(most_clipped=3) == [(100, 1.0)]
    halves = commands.lengths_of_reads(reads, Selection(10, 1000, scaling=spark.createDataFrame([("chr1", 0, 150, 2.0), ("chr1", 150, 400, 4.0)], "chrom string, start_pos long, end_pos long, factor double")), size=150, bins="60 200")
    assert sorted((r.window_start, round(r["count"], 6)) for r in halves.collect()) == [(0, round(2 * 50 / 74, 6)), (150, round(4 * 24 / 74 + 4, 6))]


def test_ends_of_reads(reads):
    got = {r.motif: r["count"] for r in commands.ends_of_reads(reads, Selection(10, 1000), 4).collect()}
    # a: read bases behind 5 clipped ones; right ends before the 3 clipped ones, reverse complemented
    assert got == {"_CGTA": 1.0, "_GTAC": 1.0, "_ACGT": 2.0}
    shifted = commands.ends_of_reads(reads, Selection(10, 1000), 4, size=10, clips=Clips.AT_SHIFTED)
    assert {(r.window_start, r["count"]) for r in shifted.collect()} == {(90, 1.0), (170, 1.0), (200, 1.0), (290, 1.0)}


def test_tagged_reads(spark):
    rows = [("chr1", "a", 100, 150, 99, 40, "chr1", 1.5), ("chr1", "a", 180, 230, 147, 50, "chr1", 2.5), ("chr1", "c", 100, 150, 99, 5, "chr1", 1.0), ("chr1", "c", 180, 230, 147, 50, "chr1", 1.0)]
    r = spark.createDataFrame(rows, "chrom string, qname string, pos long, end_pos long, flag int, mapq int, mate_chrom string, gc_tag double")
    got = commands.tagged_reads(r, Selection(gc_tag="gc_weight"), factors={"cw": spark.createDataFrame([("chr1", 0, 1000, 3.0)], "chrom string, start_pos long, end_pos long, factor double")}).collect()
    assert len(got) == 2 and all((x.qname, x.fl, x.GC, x.cw) == ("a", 130, 2.0, 3.0) for x in got)


def test_gc_correction_undoes_a_bias(spark):
    """A sample that takes GC-rich fragments more often gets weights that fall with GC."""
    rng = random.Random(3)
    bases = "".join(rng.choice("GC" if rng.random() < 0.5 + 0.35 * np.sin(k / 150) else "AT") for k in range(12_000))
    chunked = sequence.chunks(spark.createDataFrame([("chr1", k, b) for k, b in enumerate(bases)], "chrom string, pos long, base string"), 2048, 80)
    lengths = list(range(60, 72))
    reference = commands.ref_gc_bias(chunked, lengths, 3, 5, chunk=2048, support_per_mb=0.0)
    assert reference["acgt"] == 12_000 and reference["counts"].sum() > 10_000 and not (reference["support"] & ~reference["possible"]).any()
    frags = []
    for _ in range(9_000):
        n, at = rng.choice(lengths), rng.randrange(0, 11_900)
        gc = sum(b in "GC" for b in bases[at + 5 : at + n - 5]) / (n - 10)
        if rng.random() < gc:
            frags.append(("chr1", at, at + n, 60))
    sample = spark.createDataFrame(frags, "chrom string, start_pos long, end_pos long, mapq int")
    select = Selection(60, 71)
    for window in (None, 2_000):
        package = commands.gc_bias(sample, select, chunked, reference, window=window, chunk=2048, length_width=6, gc_share=0.1, short=0)
        w = np.asarray(package["correction"]).mean(0)
        assert w[1] > w[-2] and package["end_offset"] == 5
    commands.check_package(package, Selection(60, 71), 5)
    for bad in ((Selection(50, 71), 5), (Selection(60, 72), 5), (Selection(60, 71), 6)):
        with pytest.raises(ValueError):
            commands.check_package(package, *bad)


def test_transitions(spark):
    chunked = sequence.chunks(spark.createDataFrame([("chr1", k, b) for k, b in enumerate("ACGT" * 60)], "chrom string, pos long, base string"), 128, 60)
    frags = spark.createDataFrame([("chr1", k, k + 40, 60) for k in range(0, 100)], "chrom string, start_pos long, end_pos long, mapq int")
    got = commands.transitions(frags, Selection(30, 50), chunked, 2, 128, frame="left", last=3).collect()
    assert {(r.prefix, r.next_base): r.probability for r in got} == {("AC", "G"): 1.0, ("CG", "T"): 1.0, ("GT", "A"): 1.0, ("TA", "C"): 1.0} and len(got) == 16
    scaled = commands.fragment_kmers(frags, Selection(30, 50, scaling=spark.createDataFrame([("chr1", 0, 240, 0.5)], "chrom string, start_pos long, end_pos long, factor double")), chunked, 3, chunk=128, frame="left", last=0)
    assert {r.kmer: r["count"] for r in scaled.collect()} == {k: 12.5 for k in ("ACG", "CGT", "GTA", "TAC")}


def test_prep_windows(spark):
    rows = [("chr1", 0, 10, "a", 0, 5.0), ("chr1", 0, 10, "a", 1, 9.0), ("chr1", 12, 20, "a", 2, 5.0), ("chr1", 15, 40, "b", 3, 5.0), ("chr2", 5, 9, "b", 4, 5.0), ("chr1", 90, 99, "b", 5, 1.0)]
    given = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, group_name string, window_idx long, score double")
    got = lambda **o: [(r.chrom, r.start_pos, r.end_pos, r.group_name) for r in commands.prep_windows(given, WindowPlan(**o)).collect()]
    assert got(score=">= 2", duplicates="highest") == [("chr1", 0, 10, "a"), ("chr1", 12, 20, "a"), ("chr1", 15, 40, "b"), ("chr2", 5, 9, "b")]
    assert got(chromosomes=["chr1"], merge_within=2) == [("chr1", 0, 20, "a"), ("chr1", 15, 40, "b"), ("chr1", 90, 99, "b")]
    assert got(chromosomes=["chr1"], merge_within=2, merge_across=0, exclude={"group_name": ["b"]}) == [("chr1", 0, 40, "a,b")]
    mask = spark.createDataFrame([("chr1", 18, 19)], "chrom string, start_pos long, end_pos long")
    assert got(blacklist=mask, min_per={"group_name": 2}, duplicates="first") == [("chr1", 90, 99, "b"), ("chr2", 5, 9, "b")]
    assert got(resize=4, chromosomes=["chr2"]) == [("chr2", 5, 9, "b")]


def test_protection(spark):
    frags = spark.createDataFrame([("chr1", 100, 250, 60, 2.0)], "chrom string, start_pos long, end_pos long, mapq int, gc_weight double")
    got = commands.protection(frags, Selection(gc_tag="gc_weight")).collect()
    assert {r.value for r in got} == {2.0, -2.0}
    with pytest.raises(ValueError):
        commands.protection(frags, Selection(), sizes=(100, 180))
