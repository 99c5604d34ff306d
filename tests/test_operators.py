"""Operators on hand-worked cases, and invariants."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragspark.functions import distance_label, gc_percent, length_edges, midpoint, quality_filter, reverse_complement, round_half_up
from fragspark.operators import blacklist, coverage, gcbias, intervals, lengths, prepare, profiles, reads, sequence, weights, windows
from fragspark.operators.blacklist import Strategy
from fragspark.plans.commands import Selection, bam_to_frag, check_scaling, fcoverage, length_counts, midpoint_profiles, ref_kmers
from fragspark.sources import text

SPAN = "chrom string, start_pos long, end_pos long"


def spans(spark, *rows, extra="", schema=""):
    return spark.createDataFrame([("chr1", *r) for r in rows], SPAN + schema)


def told(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


ALL = Selection(min_length=10, min_mapq=0)


def test_coverage_single(spark):
    f = spans(spark, (20, 80))
    assert told(fcoverage(f, ALL), "start_pos", "end_pos", "value") == [(20, 80, 1.0)]
    assert told(fcoverage(f, ALL, unit_mass=True, decimals=4), "value") == [(0.0167,)]
    bins = windows.fixed_size(spark.createDataFrame([("chr1", 200)], "chrom string, chrom_len long"), 200)
    assert abs(fcoverage(f, ALL, bins, "total", unit_mass=True).first().total - 1) < 1e-9


def test_restore_mean(spark):
    f = spans(spark, (20, 60), (100, 180))
    assert told(fcoverage(f, ALL, restore_mean=True), "start_pos", "end_pos", "value") == [(20, 60, 1.5), (100, 180, 0.75)]
    bins = windows.fixed_size(spark.createDataFrame([("chr1", 200)], "chrom string, chrom_len long"), 200)
    r = fcoverage(f, ALL, bins, "summary-stats", restore_mean=True).first()
    assert [round(r[k], 9) for k in ("total", "total_squared", "average", "variance", "covered_fraction")] == [120, 135, 0.6, 0.315, 0.6]


@pytest.mark.parametrize("tile", [7, 50, 1_000_000])
def test_tiles_do_not_matter(spark, tile):
    f = spans(spark, (0, 20), (4, 12), (10, 90), (15, 16), (90, 95))
    got = coverage.runs(coverage.segments(f, tile=tile))
    assert told(got, "start_pos", "end_pos", "value") == [(0, 4, 1.0), (4, 10, 2.0), (10, 12, 3.0), (12, 15, 2.0), (15, 16, 3.0), (16, 20, 2.0), (20, 95, 1.0)]
    assert told(intervals.merge(f, tile=tile), "start_pos", "end_pos") == [(0, 95)]
    assert told(intervals.merge(f, touching=False, tile=tile), "start_pos", "end_pos") == [(0, 90), (90, 95)]


def test_blacklist_midpoint(spark):
    hits = lambda a, b, *black: blacklist.drop(spans(spark, (a, b)), spans(spark, *black), Strategy.MIDPOINT).count() == 0
    assert [hits(40, 50, (p, p + 1)) for p in (43, 44, 45, 46)] == [False, True, True, False]
    assert [hits(40, 51, (p, p + 1)) for p in (44, 45, 46)] == [False, True, False]


def test_blacklist_strategies(spark):
    f, b = spans(spark, (0, 10), (20, 30), (40, 50)), spans(spark, (5, 10), (18, 32), (49, 60))
    left = lambda s, p=0.5: told(blacklist.drop(f, b, s, p), "start_pos")
    assert left(Strategy.ANY) == [] and left(Strategy.ALL) == [(0,), (40,)] and left(Strategy.PROPORTION) == [(40,)] and left(Strategy.PROPORTION, 0) == []


def test_overlap_join_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 5000, 300), rng.integers(1, 400, 300))]
    b = [(int(s), int(s + n), i) for i, (s, n) in enumerate(zip(rng.integers(0, 5000, 80), rng.integers(1, 40, 80) ** 3))]
    right = intervals.renamed(spans(spark, *b, schema=", i int"))
    want = sorted((x, y, i) for x, y in a for s, e, i in b if x < e and s < y)
    for width in (1, 37, 1000):
        if width == 1:
            continue
        assert told(intervals.overlap_join(spans(spark, *a), right, width), "start_pos", "end_pos", "i") == want


def test_count_overlap_mass(spark):
    f = spans(spark, *[(k * 13, k * 13 + 30 + k % 70) for k in range(200)])
    got = length_counts(f, ALL, size=97)
    assert abs(got.agg(F.sum("count")).first()[0] - 200) < 1e-9


def test_subtract(spark):
    got = intervals.subtract(spans(spark, (0, 100), (200, 300)), spans(spark, (10, 20), (15, 30), (90, 120), (200, 300)), [])
    assert told(got, "start_pos", "end_pos") == [(0, 10), (30, 90)]


def test_gc_percent_and_rounding(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (0, 0)], "gc int, n int").select(gc_percent("gc", "n").alias("p"))
    assert [r.p for r in df.collect()] == [33, 67, 100, None]
    r = spark.range(1).select(round_half_up(F.lit(0.125), 2).alias("a"), round_half_up(F.lit(-0.125), 2).alias("b")).first()
    assert (r.a, r.b) == (0.13, -0.13)


def test_length_edges():
    assert length_edges("30:60:10") == [30, 40, 50, 60] and length_edges("30:65:10") == [30, 40, 50, 60, 65]
    with pytest.raises(ValueError):
        length_edges("30 20")


def test_triangular_kernel(spark):
    rows = [("chr1", i, 1.0 if i == 3 else 0.0, 1.0) for i in range(7)]
    got = weights.smooth_triangular(spark.createDataFrame(rows, "chrom string, i long, value double, support double"), 2)
    assert [round(r.smoothed, 6) for r in got.orderBy("i").collect()] == [0, round(1 / 8, 6), round(2 / 9, 6), round(3 / 9, 6), round(2 / 9, 6), round(1 / 8, 6), 0]


def test_scaling_is_neutral_on_average(spark):
    f = spans(spark, *[(k * 7 % 3000, k * 7 % 3000 + 60) for k in range(900)])
    chroms = spark.createDataFrame([("chr1", 3100)], "chrom string, chrom_len long")
    got = weights.scaling_factors(f, chroms, 100, 500).where("scaling_factor > 0")
    products = [r.smoothed * r.scaling_factor for r in got.collect()]
    assert max(products) - min(products) < 1e-9


def test_protection_score(spark):
    one = profiles.protection_score(spans(spark, (10, 22)), 4, (1, 100))
    assert told(coverage.runs(one), "start_pos", "end_pos", "value") == [(9, 12, -1.0), (12, 21, 1.0), (21, 23, -1.0)]
    two = profiles.protection_score(spans(spark, (0, 20), (4, 12)), 4, (1, 100))
    got = told(coverage.runs(two), "start_pos", "end_pos", "value")
    assert [x for x in got if x[0] >= 2] == [(2, 3, 1.0), (6, 11, 2.0), (13, 19, 1.0), (19, 21, -1.0)]


def test_savgol_coefficients():
    for window in (5, 21, 165):
        c, x = np.array(profiles.savgol_coefficients(window)), np.arange(-(window // 2), window // 2 + 1)
        assert abs(c.sum() - 1) < 1e-12 and abs((c * x**2).sum()) < 1e-9 and abs((c * x**3).sum()) < 1e-6 * window**3
    assert np.allclose(np.array(profiles.savgol_coefficients(5)) * 35, [-3, 12, 17, 12, -3])
    with pytest.raises(ValueError):
        profiles.savgol_coefficients(4)


def test_midpoints(spark):
    f = spans(spark, (100, 131), (100, 141))
    sites = spark.createDataFrame([("chr1", 110, 121, "g", "+"), ("chr1", 110, 121, "h", "-")], SPAN + ", group_name string, strand string")
    got = midpoint_profiles(f, ALL, sites, smooth=None)
    assert told(got, "group_name", "position", "count") == [("g", 5, 1.0), ("g", 10, 1.0), ("h", 0, 1.0), ("h", 5, 1.0)]
    assert [r.m for r in f.select(midpoint("start_pos", "end_pos").alias("m")).collect()] == [115, 120]


def test_reference_correction_is_uniform(spark):
    """Fragments at every start of a periodic reference: corrected motif counts are all equal."""
    ref = "AACG" * 20 + "A"
    bases = spark.createDataFrame([("chr1", i, b) for i, b in enumerate(ref)], "chrom string, pos long, base string")
    chunked = sequence.chunks(bases, 16, 30)
    kmers = sequence.kmer_counts(sequence.kmers(chunked, 2, 16), []).collect()
    assert {r.kmer: r.weight for r in kmers} == {"AA": 10, "AC": 10, "CG": 20, "GA": 10, "GT": 10, "TC": 10, "TT": 10}
    f = spans(spark, *[(s, s + 14) for s in range(68)])
    ends = sequence.end_motifs(f, chunked, 2, 0, size=16)
    counts = ends.groupBy(F.lit("").alias("outside"), F.substring("motif", 2, 2).alias("inside")).agg(F.count("*").cast("double").alias("count"))
    got = sequence.correct(counts, ref_kmers(chunked, 2, chunk=16).select("kmer", "frequency"), [])
    assert len(got.collect()) == 7 and all(abs(r.corrected - 136 / 7) < 1e-9 for r in got.collect())
    freq = ref_kmers(chunked, 2, chunk=16)
    assert abs(freq.agg(F.sum("frequency")).first()[0] - 1) < 1e-12
    back = {r.kmer: r.weight for r in sequence.restored_counts(freq.drop("weight")).collect()}
    assert back["CG"] == 20
    masked = sequence.masked(chunked, spans(spark, (0, 81)), 16)
    assert sequence.kmers(masked, 2, 16).count() == 0


def test_unsupported_counts(spark):
    counts = spark.createDataFrame([("A", "C", 2.0), ("G", "G", 0.0)], "outside string, inside string, count double")
    ref = spark.createDataFrame([("TT", 1.0)], "kmer string, frequency double")
    assert [r.corrected for r in sequence.correct(counts, ref, [], unsupported="drop").collect()] == [0.0]
    assert any(math.isnan(r.corrected) for r in sequence.correct(counts, ref, [], unsupported="nan").collect())
    with pytest.raises(Exception, match="without reference support"):
        sequence.correct(counts, ref, []).collect()


def test_transitions_sum_to_one(spark):
    counts = spark.createDataFrame([(0, "AAC", 3.0), (0, "AAG", 1.0), (1, "AAC", 2.0)], "pos int, kmer string, weight double")
    got = sequence.transitions(counts, ["pos"], 2)
    assert told(got, "pos", "next_base", "probability") == [(0, "C", 0.75), (0, "G", 0.25), (1, "C", 1.0)]


WINDOW = SPAN + ", group_name string, window_idx long, score double"


def window_rows(spark, *rows):
    return spark.createDataFrame([("chr1", a, b, g, i, float(s)) for i, (a, b, g, s) in enumerate(rows)], WINDOW)


def test_min_distance(spark):
    w = window_rows(spark, (0, 10, "g", 1), (4, 12, "g", 5), (20, 30, "g", 1))
    assert told(prepare.thin(w, 5), "start_pos") == [(0,), (20,)]
    w = window_rows(spark, (0, 10, "g", 1), (4, 12, "g", 5), (40, 50, "g", 2))
    assert told(prepare.thin(w, 8, "highest"), "start_pos") == [(4,), (40,)]
    w = window_rows(spark, (1000, 1050, "g", 1), (1100, 1150, "g", 1))
    assert told(prepare.thin(w, 500), "start_pos") == [(1000,)]


def test_merge_within(spark):
    w = window_rows(spark, (0, 5, "G", 1), (4, 8, "G", 1), (50, 55, "H", 1), (60, 65, "H", 1))
    assert told(prepare.merge_within(w, 2), "group_name", "start_pos", "end_pos") == [("G", 0, 8), ("H", 50, 55), ("H", 60, 65)]


def test_min_per_cascades(spark):
    rows = [(0, 1, "a", 0), (0, 1, "a", 1), (0, 1, "b", 1), (0, 1, "b", 2), (0, 1, "b", 2)]
    w = window_rows(spark, *rows)
    assert told(prepare.min_per(w, {"group_name": 2, "score": 2}), "window_idx") == [(3,), (4,)]


def test_nearest(spark):
    w = window_rows(spark, (100, 110, "g", 1), (500, 510, "g", 1), (0, 5, "g", 1))
    t = spark.createDataFrame([("chr1", 90), ("chr1", 119), ("chr1", 505), ("chr1", 20_000)], "chrom string, pos long")
    got = prepare.annotate_nearest(w, t, ["<=0", "1-20", ">20"])
    assert told(got, "start_pos", "distance", "near_pos", "tied", "distance_label") == [(0, 86, 90, False, ">20"), (100, -10, 90, True, "1-20"), (500, 0, 505, False, "<=0")]


def test_labels(spark):
    df = spark.createDataFrame([("x", "", None)], "a string, b string, c string")
    assert df.select(prepare.group_label(["a", "b", "c"]).alias("g"), prepare.compose(["a", "b", "c"]).alias("p")).first() == ("x__[NA]__[NA]", "x..")
    with pytest.raises(ValueError):
        distance_label("a", ["~3"])


def test_resize(spark):
    w = window_rows(spark, (100, 110, "g", 1), (0, 4, "g", 1))
    chroms = spark.createDataFrame([("chr1", 1000)], "chrom string, chrom_len long")
    assert told(prepare.resize(w, 20, chroms), "start_pos", "end_pos") == [(95, 115)]
    assert told(prepare.resize(w, 20, chroms, "trim"), "start_pos", "end_pos") == [(0, 12), (95, 115)]


def test_gc_tags(spark):
    rows = [(None, None), (1.0, None), (1.0, 2.0), (0.0, -1.0), (-1.0, 2.0), (float("nan"), 1.0), (1e9, None)]
    s, w = weights.combined_gc("a", "b")
    got = [tuple(r) for r in spark.createDataFrame(rows, "a double, b double").select(s, w).collect()]
    assert got == [("missing", None), ("usable", 1.0), ("usable", 1.5), ("zero", 0.0), ("invalid", None), ("invalid", None), ("invalid", None)]


def test_cigars(spark):
    df = spark.createDataFrame([("5S10M2D3M4I10M100N7M3S",)], "c string")
    d, i, left, right = reads.indel_bases("c")
    r = df.select(reads.mapped_segments("c", F.lit(1000), 50).alias("s"), reads.reference_length("c").alias("n"), d.alias("d"), i.alias("i"), left.alias("l"), right.alias("r")).first()
    assert [(x.start, x.end) for x in r.s] == [(1000, 1025), (1125, 1132)] and (r.n, r.d, r.i, r.l, r.r) == (132, 2, 4, 5, 3)
    every = df.select(reads.mapped_segments("c", F.lit(0)).alias("s")).first().s
    assert [(x.start, x.end) for x in every] == [(0, 10), (12, 25), (125, 132)]
    assert df.select(reads.adjusted_length(F.lit(132), d, i, left, right, "adjust", "adjust").alias("n")).first().n == 142


def test_quality_filter(spark):
    scope, test = quality_filter("q", "mean in end >= 20")
    assert scope == "end" and [r[0] for r in spark.createDataFrame([([10, 30],), ([10, 20],)], "q array<int>").select(test).collect()] == [True, False]
    with pytest.raises(ValueError):
        quality_filter("q", "median in end > 3")


def test_gc_matrix():
    row = np.arange(8.0)
    assert np.allclose(gcbias.smooth_rows(np.ones((2, 9))), 1) and gcbias.percent_widths(50).sum() == 51
    grid = gcbias.percent_grid(np.ones(51), 50)
    assert abs(grid.sum() - 51) < 1e-9
    assert gcbias.greedy_bins(np.array([5, 1, 1, 1, 5.0]), 0.3) == [0, 1, 5] or gcbias.greedy_bins(np.array([5, 1, 1, 1, 5.0]), 0.3)[-1] == 5
    ok = np.ones(8, bool)
    ok[3:5] = False
    assert np.allclose(gcbias.fill_gaps(np.where(ok, row, 0), ok), row, atol=0.3)
    filled = gcbias.fill_gaps(np.where(ok, row, 0), ok)
    assert 2 <= filled[3] <= filled[4] <= 5
    rng = np.random.default_rng(2)
    reference = rng.poisson(200, (60, 101)).astype(float)
    bias = np.linspace(0.5, 1.5, 101)
    package = gcbias.correction(reference * bias, reference, list(range(100, 160)))
    middle = np.asarray(package["correction"])[1:]
    assert (middle[:, 2] > middle[:, -3]).all() and abs(sum(package["length_frequencies"]) - 1) < 1e-9
    assert gcbias.length_agnostic(package).shape == (len(package["gc_edges"]) - 1,)
    assert gcbias.length_agnostic(package, "max-frequency").shape == gcbias.length_agnostic(package, "frequency", trim=0.1).shape


def test_selection_rules():
    with pytest.raises(ValueError):
        Selection(min_length=5)
    check_scaling({"gc_mode": "tag"}, True)
    check_scaling({}, False)
    with pytest.raises(ValueError):
        check_scaling({"gc_mode": "none"}, True)


def test_short_long(spark):
    long = spark.createDataFrame([("a", 100, 2.0), ("a", 160, 4.0), ("b", 100, 1.0)], "k string, length_start long, count double")
    got = {r.k: r.ratio for r in lengths.short_long_ratio(long, ["k"], (100, 151), (151, 221)).collect()}
    assert got["a"] == 0.5 and math.isnan(got["b"])


def test_peaks():
    x = np.full(3000, -1.0)
    x[1000:1100] = 10 * np.sin(np.linspace(0, np.pi, 100))
    found = profiles.call_peaks(x, 500)
    assert len(found) == 1 and abs(found[0][2] - 1550) <= 1 and found[0][3] > 9
    assert profiles.call_peaks(x * 0.1, 500) == []


# --- sources


def test_text_sources(spark, tmp_path):
    p = tmp_path / "w.bed"
    p.write_text("# remark\nchrom\tstart\tend\tgroup\tx\tstrand\nchr2\t5\t9\tb\t1\t-\nchr1\t0\t4\ta\t2\t+\nchr1\t8\t9\tb\t3.5\t.\n")
    assert told(text.bed(spark, str(p), ["chr1"]), "start_pos", "window_idx") == [(0, 1), (8, 2)]
    assert told(text.grouped_bed(spark, str(p), True), "start_pos", "group_name", "group_idx", "strand") == [(0, "a", 1, "+"), (5, "b", 0, "-"), (8, "b", 0, ".")]
    assert told(text.scored_bed(spark, str(p)), "score") == [(1.0,), (2.0,), (3.5,)]
    z = tmp_path / "w.bed.zst"
    import zstandard

    z.write_bytes(zstandard.ZstdCompressor().compress(p.read_bytes()))
    assert text.bed(spark, str(z)).count() == 3
    s = tmp_path / "s.tsv"
    s.write_text("# gc_mode=tag\nchromosome\tstart\tend\tscaling_factor\nchr1\t0\t10\t1.5\nchr1\t10\t15\t0.5\n")
    bins, remarks = text.scaling_factors(spark, str(s))
    assert told(bins, "factor") == [(0.5,), (1.5,)] and remarks == {"gc_mode": "tag"}
    s.write_text("chromosome\tstart\tend\tscaling_factor\nchr1\t0\t10\t1.5\nchr1\t11\t15\t0.5\n")
    with pytest.raises(Exception, match="bad scaling bin"):
        text.scaling_factors(spark, str(s))[0].collect()
    c = tmp_path / "c.sizes"
    c.write_text("chr2\t100\nchr1\t50\n")
    assert told(text.chrom_sizes(spark, str(c)), "ord", "chrom", "chrom_len") == [(0, "chr2", 100), (1, "chr1", 50)]
    m = tmp_path / "m.txt"
    m.write_text("acg\tx\nTTT\ty\n")
    assert told(text.motifs(spark, str(m)), "motif", "motif_group") == [("ACG", "x"), ("TTT", "y")]
    frags = spark.createDataFrame([("chr1", 5, 60, 30, "+"), ("chr1", 1, 40, 20, "-")], "chrom string, start_pos long, end_pos long, mapq int, strand string")
    text.write_frag(frags, str(tmp_path / "frag"))
    assert told(text.frag(spark, str(tmp_path / "frag")), "start_pos", "end_pos", "mapq", "strand") == [(1, 40, 20, "-"), (5, 60, 30, "+")]
    with pytest.raises(ValueError):
        text.frag(spark, str(tmp_path / "frag"), ["chrom", "start", "end", "odd"])


def test_bam(spark, tmp_path):
    from fragspark.sources.binary import BamSource, contigs_of

    spark.dataSource.register(BamSource)
    rows = [("chr1" if k % 3 else "chr2", 7 * k, 7 * k + 30 + k % 200, k % 60, "-" if k % 4 == 0 else "+", 0.5 + k % 3) for k in range(4000)]
    frags = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, mapq int, strand string, gc_weight double")
    out = str(tmp_path / "out")
    frags.repartition(2).sortWithinPartitions("chrom", "start_pos").write.format("bam").option("contigs", "chr1:100000,chr2:100000").mode("append").save(out)
    files = sorted(os.listdir(out))
    assert len(files) == 2 and contigs_of(f"{out}/{files[0]}") == [("chr1", 100000), ("chr2", 100000)]
    for stretch in (1 << 30, 20_000):
        back = spark.read.format("bam").option("stretch", stretch).load(out)
        got = sorted((r.chrom, r.pos, r.end_pos, r.mapq, "-" if r.flag & 16 else "+", r.gc_tag) for r in back.collect())
        assert got == sorted(rows)
    assert reads.single(back.where(reads.usable_single(10))).count() == sum(r[3] >= 10 for r in rows)


def test_twobit(spark, tmp_path):
    import struct

    from fragspark.sources.binary import TwoBitSource, twobit_index

    seq = "ACGTN" * 5 + "GGA"
    code = {"T": 0, "C": 1, "A": 2, "G": 3, "N": 0}
    packed = bytes(sum(code[b] << (6 - 2 * j) for j, b in enumerate(seq[k : k + 4])) for k in range(0, len(seq), 4))
    at = [i for i, b in enumerate(seq) if b == "N"]
    body = struct.pack("<II", len(seq), len(at)) + struct.pack(f"<{len(at)}I", *at) + struct.pack(f"<{len(at)}I", *[1] * len(at)) + struct.pack("<II", 0, 0) + packed
    p = tmp_path / "r.2bit"
    p.write_bytes(struct.pack("<IIII", 0x1A412743, 0, 1, 0) + b"\x04chrX" + struct.pack("<I", 25) + body)
    assert [x[:2] for x in twobit_index(str(p))] == [("chrX", len(seq))]
    spark.dataSource.register(TwoBitSource)
    for chunk, over in ((5, 2), (100, 0)):
        rows = spark.read.format("twobit").option("chunk", chunk).option("overlap", over).option("bases", 11).load(str(p)).orderBy("chunk_start").collect()
        assert [r.seq for r in rows] == [seq[k : k + chunk + over] for k in range(0, len(seq), chunk)]


def test_pairs_to_fragments(spark):
    rows = [
        ("chr1", "a", 99, 100, 150, 40, "chr1", 1.0), ("chr1", "a", 147, 180, 230, 50, "chr1", 2.0),
        ("chr1", "b", 99, 100, 150, 40, "chr1", None), ("chr1", "b", 147, 90, 140, 50, "chr1", None),
        ("chr1", "c", 99, 100, 150, 5, "chr1", None), ("chr1", "c", 147, 180, 230, 50, "chr1", None),
        ("chr1", "d", 65, 100, 150, 40, "chr1", None), ("chr1", "d", 129, 180, 230, 50, "chr1", None),
    ]
    r = spark.createDataFrame(rows, "chrom string, qname string, flag int, pos long, end_pos long, mapq int, mate_chrom string, gc_tag double")
    got = bam_to_frag(r, Selection(gc_tag="gc_weight"), factors={"coverage_scaling_weight": spark.createDataFrame([("chr1", 0, 165, 1.0), ("chr1", 165, 1000, 2.0)], SPAN + ", factor double")})
    assert [tuple(x) for x in got.collect()] == [("chr1", 100, 230, 40, "+", 1.5, 1.5)]


def test_stream(spark, tmp_path):
    from fragspark.streaming import histograms

    rows = [("chr1", k, k + 30 + k % 50, 1, "+", 1.0, None) for k in range(300)]
    spark.createDataFrame(rows, histograms.FRAG_SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = histograms.fragments(spark, str(tmp_path / "in"), files_per_trigger=1)
    q = histograms.length_counts(stream, 100, [30, 50, 80]).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    batch = lengths.counts(spark.createDataFrame(rows, histograms.FRAG_SCHEMA).withColumn("window_start", F.floor(F.col("start_pos") / 100) * 100), ["chrom", "window_start"], [30, 50, 80])
    assert told(spark.table("hist"), "window_start", "length_start", "count") == told(batch, "window_start", "length_start", "count")


def test_reverse_complement(spark):
    assert spark.range(1).select(reverse_complement(F.lit("AACGn"))).first()[0] == "nCGTT"


def test_support_masks():
    mask = gcbias.support_theoretical([20, 30, 121], 10)
    assert not mask[0].any() and list(np.flatnonzero(mask[1])) == list(range(0, 101, 10)) and mask[2].all()
    assert gcbias.support_per_mb(np.array([[1.9, 2.0]]), 2_000_000).tolist() == [[False, True]]
    assert gcbias.support_extreme((3, 5)).tolist() == [[False] * 5, [False, True, True, True, False], [False, True, True, True, False]]
    assert not gcbias.support_extreme((1, 2), 5, 5).any()


def test_short_bins_are_masked():
    rng = np.random.default_rng(2)
    reference = rng.integers(50, 100, (12, 101)).astype(float)
    package = gcbias.correction(reference * np.linspace(0.5, 2, 101), reference, list(range(100, 112)), length_share=0.0, gc_share=0.02)
    w = package["correction"]
    assert np.isfinite(w).all() and (w > 0).all() and w[:, 2].mean() > w[:, -3].mean()
    with pytest.raises(ValueError):
        gcbias.correction(reference[:2], reference[:2], [100, 101], length_share=0.9, gc_share=0.9)


def test_split_files_are_numbered_in_order(spark, tmp_path):
    p = tmp_path / "many.bed"
    p.write_text("# head\n" + "".join(f"chr1\t{k}\t{k + 1}\tg{k // 400}\n" for k in range(3000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = text.bed(spark, str(p))
        assert text.lines(spark, str(p)).select("block").distinct().count() > 5
        assert all(r.start_pos == r.window_idx for r in got.collect()) and got.count() == 3000
        assert {(r.group_name, r.group_idx) for r in text.grouped_bed(spark, str(p)).collect()} == {(f"g{k}", k) for k in range(8)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_fragment_files_with_any_white_space(spark, tmp_path):
    p = tmp_path / "f.tsv"
    p.write_text("chromosome start end min_mapq read1_strand\n# note\nchr1 5   60\t30 +\n\nchr2\t7\t90\t20\t-\n")
    assert sorted((r.chrom, r.start_pos, r.end_pos, r.mapq, r.strand) for r in text.frag(spark, str(p)).collect()) == [("chr1", 5, 60, 30, "+"), ("chr2", 7, 90, 20, "-")]


def test_tallied_words(spark):
    """k-mers counted batch by batch weigh what a row for each of them gives, in all kinds of windows."""
    rng = random.Random(11)
    rows = [(f"chr{c}", k, rng.choice("ACGT" * 8 + "Na")) for c in range(3) for k in range(rng.randrange(70, 140))]
    bases = spark.createDataFrame(rows, "chrom string, pos long, base string")
    targets = spark.createDataFrame([("chr0", 3, 40, "x"), ("chr0", 31, 34, "y"), ("chr1", 0, 500, "x"), ("chr2", 15, 17, "y")], SPAN + ", name string")
    for k in (3, 4, 30):
        chunked = sequence.chunks(bases, 16, 45)
        rowwise = sequence.kmers(chunked, k, 16)
        plain = lambda df, *keys: {tuple(r[c] for c in (*keys, "kmer")): round(r.weight, 9) for r in df.collect()}
        total = lambda found, keys, w=None: plain(sequence.kmer_counts(found, keys, "forward", weight=w), *keys)
        assert total(sequence.tallied(chunked, k, 16, ["chrom"]), ["chrom"], F.col("weight")) == total(rowwise, ["chrom"])
        for how in windows.Assigner if k == 4 else ():
            for keys, more, old in ((["name"], {"targets": targets}, {"targets": targets}), (["window_start"], {"bins": 10}, {"size": 10})):
                want = total(sequence.kmers_by_window(rowwise, k, how=how, **old), keys, F.col("in_window"))
                assert total(sequence.tallied(chunked, k, 16, [x for x in keys if x != "window_start"], how=how, **more), keys, F.col("weight")) == want


def test_words_are_no_rows(spark, tmp_path):
    """Counting k-mers makes no row of each of them, and reading the sequence none of each base."""
    from fragspark.queries import QUERIES

    text = "abé\U0001f600c d€e\n" * 150
    spark.createDataFrame([(1, text, len(text)), (2, "x", 1), (None, "abcd", 4), (3, "", 0)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("kmer_forward", "kmer_bed_overlap", "kmer_by_size", "gc_window_scaled", "corr_joint"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence(0, least" not in plan and "posexplode" not in plan and "regexp_extract_all" not in plan
    from fragspark import surrogate

    got = {(r.chrom, r.chunk_start): r.seq for r in surrogate.chunks(spark, str(tmp_path), 512, 2).collect()}
    bases = "".join("ACGTN"[ord(c) % 5] for c in text)
    assert got == {("d1", k): bases[k : k + 514] for k in range(0, len(text), 512)} | {("d2", 0): "A", (None, 0): "CDEF".translate(str.maketrans("CDEF", "".join("ACGTN"[ord(c) % 5] for c in "abcd")))}


def test_fragment_words_meet_chunks_once(spark):
    """Selected k-mers on both sides of chunk edges, also of fragments that begin before the chunk's end and end beyond the sequence."""
    ref = "".join(random.Random(4).choice("ACGT") for _ in range(100))
    chunked = sequence.chunks(spark.createDataFrame([("chr1", k, b) for k, b in enumerate(ref)], "chrom string, pos long, base string"), 16, 4)
    f = spans(spark, *[(a, a + n) for a in range(0, 90, 7) for n in (12, 30)])
    for frame in ("left", "right", "nearest", "per-end", "mid"):
        table = sequence.position_table(spark, (10, 40), 4, frame)
        picked = {}
        for r in table.collect():
            picked.setdefault(r["size"], []).append((r.offset, r.reverse))
        want = sorted((r.start_pos, r.end_pos, o, rev, w[::-1].translate(str.maketrans("ACGT", "TGCA")) if rev else w) for r in f.collect() for o, rev in picked[r.end_pos - r.start_pos] if len(w := ref[r.start_pos + o : r.start_pos + o + 4]) == 4)
        told = sequence.fragment_kmers(f, chunked, table, 4, 16)
        assert sorted((r.frag_start, r.frag_end, r.offset, r.reverse, r.kmer) for r in told.collect()) == want
        counted = sequence.fragments_tallied(f, chunked, table, 4, 16).groupBy("offset", "reverse", "kmer").agg(F.sum("n").alias("n"))
        assert {(r.offset, r.reverse, r.kmer): r.n for r in counted.collect()} == Counter(x[2:] for x in want)


def test_thinning_over_batches(spark):
    """Stretches that go over batches of Arrow, against a walk in Python; no group is a task's call of its own."""
    rng = random.Random(8)
    rows = [(f"chr{rng.randrange(2)}", a := rng.randrange(4_000), a + rng.randrange(1, 40), rng.choice("ab"), k, rng.random()) for k in range(400)]
    df = spark.createDataFrame(rows, SPAN + ", group_name string, window_idx long, score double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (1, 3, 1_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))
            for keep, worth in (("first", lambda r: 0), ("highest", lambda r: r[5]), ("lowest", lambda r: -r[5]), ("longest", lambda r: r[2] - r[1])):
                want = []
                for key in {(r[0], r[3]) for r in rows}:
                    own = sorted((r for r in rows if (r[0], r[3]) == key), key=lambda r: (r[1], r[2], r[5]))
                    while own:
                        run = own[:1] + [r for r in own[1:] if r[1] - own[0][2] < 20]
                        best = max(run, key=worth)
                        want.append(best[4])
                        own = [r for r in own[len(run) :] if r[1] - best[2] >= 20]
                out = prepare.thin(df, 20, keep)
                assert sorted(r.window_idx for r in out.collect()) == sorted(want) and out.schema == df.schema
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
