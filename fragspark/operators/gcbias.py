"""GC bias: counts by length and GC in Spark, then dense matrix steps in numpy on the driver.

After aggregation the data is a table of fragment length by GC, of at most a thousand by a hundred cells whatever
the input's size; only that reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gc_percent, int_div
from . import intervals, sequence

MIN_ACGT = 10


def fragment_gc(frags: DataFrame, chunked: DataFrame, end_offset: int = 0, size: int = sequence.CHUNK) -> DataFrame:
    """frags with gc and acgt (bases of the fragment, trimmed by the offset at both ends) and gc_pct; fewer than 10 go."""
    trimmed = frags.withColumnsRenamed({"start_pos": "frag_start", "end_pos": "frag_end"})
    trimmed = trimmed.withColumn("start_pos", F.col("frag_start") + end_offset).withColumn("end_pos", F.col("frag_end") - end_offset).where("start_pos < end_pos")
    told = sequence.sequence_at(trimmed, chunked, size)
    pair = lambda a, b: F.length("seq") - F.length(F.replace(F.replace("seq", F.lit(a), F.lit("")), F.lit(b), F.lit("")))
    out = told.withColumn("gc", pair("G", "C")).withColumn("acgt", F.col("gc") + pair("A", "T")).where(F.col("acgt") >= MIN_ACGT)
    out = out.withColumn("gc_pct", gc_percent("gc", "acgt")).drop("seq", "start_pos", "end_pos")
    return out.withColumnsRenamed({"frag_start": "start_pos", "frag_end": "end_pos"})


def observed_counts(with_gc: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, size, gc_pct, n): how many fragments of each length and GC percent."""
    return with_gc.groupBy(*keys, (F.col("end_pos") - F.col("start_pos")).alias("size"), "gc_pct").agg(F.count("*").alias("n"))


def window_scaled(counted: DataFrame, window_bp: DataFrame, window: str = "window_idx", least_share: float = 0.1) -> DataFrame:
    """(size, gc_pct, weight): counts averaged over windows, each scaled to a mean cell of 1 and by its usable bases.

    window_bp(window, span, acgt); windows with too few usable bases or no counts drop out.
    """
    usable = window_bp.where(F.col("acgt") >= F.col("span") * least_share)
    span = usable.agg(F.avg("span").alias("_avg"))
    own = Window.partitionBy(window)  # a row for each cell of one window
    scaled = counted.withColumn("_mean", F.avg("n").over(own)).withColumn("_first", F.when(F.row_number().over(own.orderBy("size", "gc_pct")) == 1, 1).otherwise(0))
    scaled = scaled.join(usable, window).crossJoin(F.broadcast(span))  # one row
    cells = scaled.groupBy("size", "gc_pct").agg(F.sum(F.col("n") / F.col("_mean") * F.col("acgt") / F.col("_avg")).alias("weight"), F.sum("_first").alias("_windows"))
    n = F.sum("_windows").over(Window.partitionBy(F.lit(0)))  # over a thousand by a hundred cells at most
    return cells.withColumn("weight", F.col("weight") / n).drop("_windows")


def window_bases(chunked: DataFrame, size: int = sequence.CHUNK) -> DataFrame:
    """(chrom, span, acgt): bases of each contig and those of them that are A, C, G or T, of each chunk without its overlap."""
    own = F.substring("seq", 1, size)
    return chunked.groupBy("chrom").agg(F.sum(F.length(own)).alias("span"), F.sum(F.length(F.regexp_replace(own, "[^ACGT]+", ""))).alias("acgt"))


def sampled_starts(chunked: DataFrame, every: int, seed: int = 0, size: int = sequence.CHUNK) -> DataFrame:
    """(chrom, pos) of the bases of the chunks that a fixed hash picks, one in ``every``; the same whatever the partitions."""
    at = chunked.select("chrom", F.explode(F.sequence(F.col("chunk_start"), F.col("chunk_start") + F.least(F.length("seq"), F.lit(size)) - 1)).alias("pos"))
    return at.where(F.pmod(F.xxhash64(F.lit(seed), "chrom", "pos"), F.lit(every)) == 0)


def reference_counts(chunked: DataFrame, starts: DataFrame, lengths: list[int], size: int = sequence.CHUNK, end_offset: int = 0, targets: DataFrame | None = None, keys: list[str] = [], least_share: float = 0.0, least_count: int = MIN_ACGT) -> DataFrame:  # noqa: B006
    """(keys, size, gc, acgt, gc_pct, n) of the reference: fragments of each length from starts(chrom, pos).

    With targets(chrom, start_pos, end_pos, keys) a start counts in each window that holds it, for the lengths that still
    fit the window. GC is that of the fragment less ``end_offset`` at both ends; fragments with fewer ACGT bases than that
    share of it, rounded up, or than ``least_count`` go. Chunks must overlap by the longest length.
    """
    chunk = starts.withColumn("_chunk", int_div("pos", size) * size)
    found = chunk.join(chunked.select("chrom", F.col("chunk_start").alias("_chunk"), "seq"), ["chrom", "_chunk"])
    room = F.length("seq") - (F.col("pos") - F.col("_chunk"))
    if targets is not None:
        points = found.select("chrom", "_chunk", "seq", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"))
        found = intervals.overlap_join(points, intervals.renamed(targets.select("chrom", "start_pos", "end_pos", *keys))).withColumn("pos", F.col("start_pos"))
        room = F.least(room, F.col("b_end") - F.col("pos"))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths if n > 2 * end_offset]), lambda n: n <= room)
    sized = found.select(*keys, "seq", (F.col("pos") - F.col("_chunk") + 1 + end_offset).cast("int").alias("_at"), F.explode(fits).alias("size"))
    piece = F.substring("seq", F.col("_at"), F.col("size") - 2 * end_offset)
    told = sized.select(*keys, "size", F.length(F.regexp_replace(piece, "[^GC]+", "")).alias("gc"), F.length(F.regexp_replace(piece, "[^ACGT]+", "")).alias("acgt"))
    least = F.greatest(F.ceil(F.lit(float(least_share)) * (F.col("size") - 2 * end_offset)), F.lit(max(1, least_count)))
    counted = told.where(F.col("acgt") >= least).groupBy(*keys, "size", "gc", "acgt").agg(F.count("*").alias("n"))
    return counted.withColumn("gc_pct", gc_percent("gc", "acgt"))


def support_theoretical(lengths: list[int], end_offset: int = 0) -> np.ndarray:
    """Which GC percents the whole numbers of GC bases of each length can give at all."""
    out = np.zeros((len(lengths), 101), bool)
    for row, n in enumerate(lengths):
        if n > 2 * end_offset:
            out[row] = percent_widths(n - 2 * end_offset) > 0
    return out


def support_per_mb(reference: np.ndarray, acgt_bp: int, least: float = 1.0) -> np.ndarray:
    """Cells of the reference counted at least so often for each million ACGT bases that starts were drawn from."""
    return reference >= acgt_bp / 1e6 * least


def support_extreme(shape: tuple[int, int], extreme: int = 1, short: int = 1) -> np.ndarray:
    """All cells but those of so many GC bins at either end and of so many of the shortest length bins."""
    out = np.ones(shape, bool)
    k = min(extreme, shape[1])
    out[:, :k] = out[:, shape[1] - k :] = False
    out[: min(short, shape[0])] = False
    return out


def percent_rows(counted: DataFrame, lengths: list[int], end_offset: int = 0, debias: bool = True) -> DataFrame:
    """(size, gc_pct, value): counts(size, gc, n) by GC bases on the percent grid, a row of at most 101 cells for each length."""
    spark = counted.sparkSession
    held = counted.where(F.col("size").isin(*lengths)).groupBy("size", "gc").agg(F.sum("n").alias("n")).collect()  # lengths x (length + 1) at most
    rows: dict[int, np.ndarray] = {}
    for r in held:
        rows.setdefault(r["size"], np.zeros(r["size"] - 2 * end_offset + 1))[r["gc"]] += float(r["n"])
    cells = [(n, p, float(v)) for n, row in sorted(rows.items()) for p, v in enumerate(percent_grid(row, n - 2 * end_offset, debias)) if v]
    return spark.createDataFrame(cells, "size long, gc_pct long, value double")


def matrix(counted: DataFrame, lengths: list[int], value: str = "n") -> np.ndarray:
    """Lengths x 101 matrix of a table of counts; its size doesn't depend on the data."""
    row = {n: i for i, n in enumerate(lengths)}
    out = np.zeros((len(lengths), 101))
    for r in counted.where(F.col("size").isin(*lengths)).groupBy("size", "gc_pct").agg(F.sum(value).alias("v")).collect():
        out[row[r["size"]], r["gc_pct"]] += float(r["v"])
    return out


def smooth_rows(x: np.ndarray, sigma: float = 0.8, radius: int = 2) -> np.ndarray:
    """Gaussian along each row, edges reflected without repeating the last cell."""
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    padded = np.pad(x, ((0, 0), (radius, radius)), mode="reflect")
    return sum(w * padded[:, j : j + x.shape[1]] for j, w in enumerate(k))


def percent_widths(size: int) -> np.ndarray:
    """How many GC counts 0..size fall on each whole percent."""
    counts = np.arange(size + 1)
    return np.bincount(np.minimum(100, (100 * counts + size // 2) // size), minlength=101)


def percent_grid(by_count: np.ndarray, size: int, debias: bool = True) -> np.ndarray:
    """A row of counts by GC bases as one by GC percent; divided by the number of counts behind each percent, with
    the row's mass kept."""
    pct = np.minimum(100, (100 * np.arange(size + 1) + size // 2) // size)
    row = np.bincount(pct, by_count[: size + 1], 101)
    if not debias or not row.sum():
        return row
    flat = row / np.maximum(1, percent_widths(size))
    return flat * row.sum() / flat.sum()


def greedy_bins(mass: np.ndarray, least_share: float, least_width: int = 1) -> list[int]:
    """Edges of neighbouring bins that each hold at least that share of the mass; the last takes what is left."""
    total, edges, held = mass.sum(), [0], 0.0
    for i, m in enumerate(mass):
        held += m
        if held >= least_share * total and i + 1 - edges[-1] >= least_width:
            edges.append(i + 1)
            held = 0.0
    if edges[-1] != len(mass):
        if len(edges) > 1:
            edges.pop()
        edges.append(len(mass))
    return edges


def collapse(x: np.ndarray, edges: list[int], axis: int, how: str = "sum") -> np.ndarray:
    """Cells of each bin summed or averaged along an axis."""
    parts = [np.take(x, range(a, b), axis) for a, b in zip(edges, edges[1:])]
    return np.stack([p.sum(axis) if how == "sum" else p.mean(axis) for p in parts], axis)


def mean_scaled(x: np.ndarray, support: np.ndarray | None = None, per_row: bool = True) -> np.ndarray:
    """Divided by the mean of the supported cells, of each row or of all; rows without any stay."""
    ok = np.ones_like(x, bool) if support is None else support
    if not per_row:
        m = x[ok].mean() if ok.any() else 1.0
        return x / m if m else x
    n = ok.sum(1)
    mean = np.where(n > 0, (x * ok).sum(1) / np.maximum(n, 1), 1.0)
    return x / np.where(mean > 0, mean, 1.0)[:, None]


def outlier_bounds(x: np.ndarray, how: str = "iqr", k: float = 3.0, quantiles: tuple[float, float] = (0.03, 0.97)) -> tuple[float, float]:
    """Bounds of usual values by quantiles, Tukey's fences, standard deviations or scaled MAD."""
    if how == "quantile":
        return tuple(np.quantile(x, quantiles))
    if how == "iqr":
        a, b = np.quantile(x, [0.25, 0.75])
        return a - k * (b - a), b + k * (b - a)
    if how == "sd":
        return x.mean() - k * x.std(), x.mean() + k * x.std()
    if how == "mad":
        m = np.median(x)
        return m - k * 1.4826 * np.median(abs(x - m)), m + k * 1.4826 * np.median(abs(x - m))
    raise ValueError(f"unknown outlier rule: {how}")


def winsorized(x: np.ndarray, support: np.ndarray, how: str = "iqr", k: float = 3.0, per_row: bool = False) -> np.ndarray:
    out = x.copy()
    for rows in ([slice(i, i + 1) for i in range(len(x))] if per_row else [slice(None)]):
        ok = support[rows]
        if ok.any():
            out[rows] = np.where(ok, np.clip(x[rows], *outlier_bounds(x[rows][ok], how, k)), x[rows])
    return out


def fill_gaps(row: np.ndarray, support: np.ndarray, degree: int = 2, side: int = 3) -> np.ndarray:
    """Unsupported runs of a row filled by a weighted polynomial through their nearest supported cells.

    Up to ``side`` anchors on each side, weighted by 1 / (1 + distance squared); a side that lacks anchors mirrors the other's
    distances with the boundary value and then goes on outwards by one. Fits stay between the run's edge values, not below
    zero, and monotone. A row with fewer anchors than degree + 1 stays as it is.
    """
    anchors = np.flatnonzero(support)
    if len(anchors) < degree + 1:
        return row
    out = row.copy()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~support, [False]]).astype(np.int8))).reshape(-1, 2)
    for a, b in edges:
        left, right = anchors[anchors < a][-side:][::-1], anchors[anchors >= b][:side]
        lv = row[left[0]] if len(left) else None
        rv = row[right[0]] if len(right) else None
        if lv is None or rv is None or lv == rv:
            out[a:b] = max(0.0, rv if lv is None else lv)
            if lv is None or rv is None:
                continue
            continue
        x, y = list(left), list(row[left])
        ld, rd = [a - p for p in left], [p - (b - 1) for p in right]
        while len(ld) < side:
            d = rd[len(ld)] if len(ld) < len(rd) and rd[len(ld)] > ld[-1] else ld[-1] + 1
            ld.append(d)
            x.append(a - d)
            y.append(lv)
        x, y = x + list(right), y + list(row[right])
        while len(rd) < side:
            d = ld[len(rd)] if ld[len(rd)] > rd[-1] else rd[-1] + 1
            rd.append(d)
            x.append(b - 1 + d)
            y.append(rv)
        w = 1 / (1 + np.array(ld + rd, float) ** 2)
        centre = (a + b - 1) / 2
        at = np.array(x, float) - centre
        scale = abs(at).max()
        basis = np.vander(at / scale, degree + 1)
        root = np.sqrt(w / w.sum())[:, None]
        c, *_ = np.linalg.lstsq(basis * root, np.array(y) * root[:, 0], rcond=None)
        fit = np.vander((np.arange(a, b) - centre) / scale, degree + 1) @ c
        fit = np.maximum(0, np.clip(fit, min(lv, rv), max(lv, rv)))
        out[a:b] = np.maximum.accumulate(fit) if rv > lv else np.minimum.accumulate(fit)
    return out


def correction(sample: np.ndarray, reference: np.ndarray, lengths: list[int], length_share: float = 0.01, length_width: int = 3, gc_share: float = 0.01, extreme: int = 1, short: int = 1, support: np.ndarray | None = None) -> dict:
    """The correction package: weights by length bin and GC bin that make the sample's GC look like the reference's.

    Steps: row smoothing, division by the supported mean, gap filling, bins by mass (GC summed, lengths averaged),
    extreme bins masked, mean scaling per length, sample over reference, filling of masked cells, winsorizing, clamping to
    [0.1, 10], mean scaling, inversion with zeros kept. ``support`` tells the cells that the reference supports
    (see support_theoretical and support_per_mb); by default those that it has at all.
    """
    ok = (reference > 0) if support is None else support
    sample, reference = smooth_rows(sample), smooth_rows(reference)
    observed = ok & (sample > 0)
    sample = mean_scaled(np.stack([fill_gaps(r, s) for r, s in zip(sample, observed)]), ok, per_row=False)
    reference = mean_scaled(reference, ok, per_row=False)
    length_bins, gc_bins = greedy_bins(sample.sum(1), length_share, length_width), greedy_bins(sample.sum(0), gc_share)
    a, b = (collapse(collapse(m, gc_bins, 1), length_bins, 0, "mean") for m in (sample, reference))
    usable = (b > 0) & support_extreme(b.shape, extreme, short)
    if not usable.any():
        raise ValueError("no length and GC bin has support; widen the lengths or mask fewer bins")
    a, b = mean_scaled(a, usable), mean_scaled(b, usable)
    ratio = np.where(usable, a / np.where(b > 0, b, 1), 1.0)
    ratio = mean_scaled(ratio, usable)
    ratio = np.stack([fill_gaps(r, s) for r, s in zip(ratio, usable)])
    done = usable | usable.any(1)[:, None]
    ratio = np.stack([fill_gaps(r, s) for r, s in zip(ratio.T, done.T)]).T
    ratio = np.clip(winsorized(ratio, np.ones_like(usable)), 0.1, 10)
    ratio = mean_scaled(ratio)
    weights = np.divide(1, ratio, out=np.zeros_like(ratio), where=ratio > 0)
    starts = [lengths[i] for i in length_bins[:-1]]
    mass = collapse(sample.sum(1, keepdims=True), length_bins, 0)[:, 0]
    return {"length_edges": [*starts, lengths[-1] + 1], "gc_edges": gc_bins, "correction": weights, "length_frequencies": mass / mass.sum()}


def length_agnostic(package: dict, scheme: str = "equal", lengths: tuple[int, int] | None = None, trim: float = 0.0) -> np.ndarray:
    """One weight per GC bin: length bins averaged equally, by frequency, or the most frequent one alone.

    ``lengths`` picks the bins that meet a range; ``trim`` leaves out the rarest bins up to that mass, equal ones together.
    """
    edges, freq = package["length_edges"], np.asarray(package["length_frequencies"], float).copy()
    use = np.array([lengths is None or (a < lengths[1] and b > lengths[0]) for a, b in zip(edges, edges[1:])])
    if trim:
        order = sorted(set(np.round(freq[use], 7)))
        lost = 0.0
        for f in order:
            same = use & (abs(freq - f) <= 1e-7)
            if lost + freq[same].sum() > trim * freq[use].sum() or same.sum() == use.sum():
                break
            lost += freq[same].sum()
            use = use & ~same
    w = {"equal": use.astype(float), "frequency": freq * use, "max-frequency": (freq * use == (freq * use).max()) * use * 1.0}[scheme]
    return (np.asarray(package["correction"]) * w[:, None]).sum(0) / w.sum()


def weigh(with_gc: DataFrame, package: dict) -> DataFrame:
    """Fragments with gc_weight from a package; those outside its lengths have none. The table of weights is small."""
    spark = with_gc.sparkSession
    rows = []
    for i, (a, b) in enumerate(zip(package["length_edges"], package["length_edges"][1:])):
        for j, (g, h) in enumerate(zip(package["gc_edges"], package["gc_edges"][1:])):
            rows += [(n, p, float(package["correction"][i][j])) for n in range(a, b) for p in range(g, min(h, 101))]
    weights = spark.createDataFrame(rows, "size long, gc_pct long, gc_weight double")
    sized = with_gc.withColumn("size", F.col("end_pos") - F.col("start_pos"))
    return sized.join(F.broadcast(weights), ["size", "gc_pct"], "left").drop("size")  # at most 971 x 101 rows
