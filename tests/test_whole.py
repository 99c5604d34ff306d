"""Queries see their whole inputs: against brute force on small tables."""

import random
import re
from collections import Counter

from fragspark.queries import ORACLES, QUERIES


def _documents(spark, path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefé\U0001f600\n ") for _ in range(n))) for i, n in ((3, 2_600), (199, 0), (200, 150), (731, 4_001))]
    rows.append((900, None))
    spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return {i: "".join("ACGTN"[ord(c) % 5] for c in t or "") for i, t in rows}


def test_sequence_whole(spark, tmp_path):
    bases = _documents(spark, tmp_path)
    words = Counter(b[k : k + 3] for b in bases.values() for k in range(len(b) - 2))
    got = {r.kmer: r.weight for r in QUERIES["kmer_forward"](spark, str(tmp_path)).collect()}
    assert got == {w: n for w, n in words.items() if "N" not in w}
    ends = Counter()
    for d, b in bases.items():
        for i in range(len(b) // 50 + 1):
            a = i * 50 + (d * 7 + i * 3) % 40
            z = a + 30 + (d * 11 + i * 13) % 120
            if z <= len(b):
                ends["left", "_" + b[a : a + 3]] += 1
                ends["right", "_" + b[z - 3 : z][::-1].translate(str.maketrans("ACGT", "TGCA"))] += 1
    got = {(r.end, r.motif): r.n for r in QUERIES["ends_inside"](spark, str(tmp_path)).collect()}
    assert got == {k: n for k, n in ends.items() if "N" not in k[1]}


def test_no_sieve():
    assert not any(re.search(r"doc_id < |_idx %|limit ", sql) for sql in ORACLES.values())


def test_windows_whole(spark, tmp_path):
    """Windows and sites whose index no modulo filter lets through still count."""
    parts = [(k, 1 + k * 7 % 50, f"Brand#{k % 4}", 1000.0 + k) for k in range(1, 241)]
    custs = [(k, f"M{k % 3}") for k in range(1, 260)]  # beyond the last window
    items = [(k, 1, k % 240 + 1, k % 10 + 1, 5.0, 0.05, "N") for k in range(300)]
    for name, rows, schema in (
        ("part", parts, "p_partkey long, p_size int, p_brand string, p_retailprice double"),
        ("customer", custs, "c_custkey long, c_mktsegment string"),
        ("lineitem", items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    wins = sorted((f"chr{1 + k % 5}", k * 40, k * 40 + 50 + size * 20, k, brand) for k, size, brand, _ in parts)

    def islands(gap):
        out = []
        for c, a, z, _, brand in wins:
            if out and out[-1][0] == c and a - out[-1][2] <= gap:
                out[-1][2] = max(out[-1][2], z)
                out[-1][3].add(brand)
            else:
                out.append([c, a, z, {brand}])
        return out

    for name, gap in (("interval_merge_touching", 0), ("interval_merge_keep_touching", -1)):
        assert {(r.chrom, r.start_pos, r.end_pos) for r in run(name)} == {tuple(x[:3]) for x in islands(gap)}
    assert {(r.chrom, r.start_pos, r.end_pos) for r in run("prep_merge_across")} == {tuple(x[:3]) for x in islands(20)}
    sites = [(f"chr{1 + k % 5}", k * 53) for k, _ in custs]
    near = {r.window_idx: r.distance for r in run("prep_nearest")}
    for c, a, z, k, _ in wins:
        left = [a - p for d, p in sites if d == c and p <= a]
        right = [max(0, p - z + 1) for d, p in sites if d == c and p >= a]
        assert abs(near[k]) == min(left + right)
    assert sum(r.n for r in run("prep_distance_bins")) == len(wins)
    frags = {k: (p * 40 + (k * 13 + 7) % 40, p * 40 + (k * 13 + 7) % 40 + 30 + (k * 31 + 17 + 95) % 371, f"chr{1 + s % 5}") for k, _, p, s, *_ in items}
    met = {k for c, a, z, k, _ in wins if any(d == c and s < z and a < e for s, e, d in frags.values())}
    assert {r.window_idx for r in run("cov_runs_indexed")} == met


def test_lengths_beyond_window_200(spark, tmp_path):
    """Fragments far down a chromosome count, in windows that the twins' series does not reach."""
    items = [(1, 1, p, 1, 5.0, 0.05, "N") for p in (10, 25_200, 120_000)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"
    spark.createDataFrame(items, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("any", "all", "count_overlap", "midpoint", "proportion"):
        got = QUERIES[f"lengths_by_size_{name}"](spark, str(tmp_path)).collect()
        assert {r.window_start: r["count"] for r in got} == {p * 40 // 5_000 * 5_000: 1.0 for _, _, p, *_ in items}
