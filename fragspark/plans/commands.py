"""Whole commands: the chains of operators that users run, with their defaults.

Each function declares one plan over DataFrames and leaves the physical strategy to Catalyst; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import length_edges
from ..operators import blacklist, coverage, intervals, lengths, profiles, sequence, weights, windows
from ..operators.blacklist import Strategy
from ..operators.windows import Assigner


@dataclass
class Selection:
    """What all commands share: which fragments count, and with what weight."""

    min_length: int = 30
    max_length: int = 1000
    min_mapq: int = 30
    chromosomes: list[str] | None = field(default_factory=lambda: [f"chr{i}" for i in range(1, 23)])
    blacklist: DataFrame | None = None
    strategy: Strategy = Strategy.ANY
    proportion: float = 0.5
    gc_tag: str | None = None
    neutralize_invalid_gc: bool = False
    scaling: DataFrame | None = None

    def __post_init__(self) -> None:
        if not 10 <= self.min_length <= self.max_length <= 50_000:
            raise ValueError("fragment lengths must lie in 10..50,000")

    def apply(self, frags: DataFrame) -> DataFrame:
        """Fragments that count, with ``weight``: cheap predicates first, so that they reach the scan."""
        out = frags.where((F.col("end_pos") - F.col("start_pos")).between(self.min_length, self.max_length))
        if "mapq" in frags.columns:
            out = out.where(F.col("mapq") >= self.min_mapq)
        if self.chromosomes is not None:
            out = out.where(F.col("chrom").isin(*self.chromosomes))
        if self.blacklist is not None:
            out = blacklist.drop(out, self.blacklist, self.strategy, self.proportion)
        weight: Column = F.lit(1.0)
        if self.gc_tag:
            state = weights.gc_state(self.gc_tag)
            usable = state.isin("usable", "zero")
            if self.neutralize_invalid_gc:
                weight = F.when(usable, F.col(self.gc_tag).cast("double")).otherwise(1.0)
            else:
                out, weight = out.where(usable), F.col(self.gc_tag).cast("double")
        return out.withColumn("weight", weight)


def check_scaling(remarks: dict[str, str], gc_corrected: bool) -> None:
    """Scaling factors built with GC correction need a corrected run and the other way round; unknown modes pass."""
    mode = remarks.get("gc_mode")
    if mode in ("none", "file", "tag") and (mode != "none") != gc_corrected:
        raise ValueError(f"scaling factors have gc_mode={mode}; this run is {'' if gc_corrected else 'not '}GC-corrected")


def fcoverage(frags: DataFrame, select: Selection, targets: DataFrame | None = None, per_window: str = "average", keys: list[str] = ["window_idx"], unit_mass: bool = False, restore_mean: bool = False, unique_bases: bool = False, decimals: int = 2) -> DataFrame:  # noqa: B006
    """Fragment coverage: bedGraph runs without windows, else ``average``, ``total`` or ``summary-stats`` per key."""
    chosen = select.apply(frags)
    size = F.col("end_pos") - F.col("start_pos")
    weight = F.col("weight") * coverage.unit_mass(size) if unit_mass or restore_mean else F.col("weight")
    covered = coverage.segments(chosen, weight)
    if restore_mean:
        mean = chosen.agg(F.avg(size).alias("_m"))
        covered = covered.crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") * F.col("_m")).drop("_m")  # one row
    if select.scaling is not None:
        covered = coverage.scaled(covered, select.scaling)
    if targets is None:
        return coverage.runs(covered if select.blacklist is None else intervals.subtract(covered, select.blacklist, ["value"]), decimals)
    if unique_bases:
        targets = coverage.merged_groups(targets, keys[0])
    told = coverage.sums(covered, targets, keys, select.blacklist)
    if per_window == "summary-stats":
        return coverage.summary(told)
    if per_window == "total":
        return told.select(*keys, "total", "blacklisted")
    if per_window != "average":
        raise ValueError(f"unknown per_window: {per_window}")
    return coverage.summary(told).select(*keys, "average", "blacklisted")


def length_counts(frags: DataFrame, select: Selection, targets: DataFrame | None = None, size: int | None = None, how: Assigner = Assigner.COUNT_OVERLAP, bins: str = "30:1001:1", keys: list[str] = ["window_idx"], proportion: float = 0.5) -> DataFrame:  # noqa: B006
    """Length histograms: global, per fixed-size bin, or per key of target windows."""
    chosen = select.apply(frags)
    if select.scaling is not None:
        chosen = weights.average_factor(chosen, select.scaling, []).withColumn("weight", F.col("weight") * F.col("factor"))
    edges = length_edges(bins)
    if targets is None and size is None:
        return lengths.counts(chosen, [], edges, F.col("weight"))
    if size is not None:
        assigned, keys = windows.assign_fixed(chosen, size, how, proportion), ["chrom", "window_start"]
    else:
        assigned = windows.assign(chosen, targets.select("chrom", "start_pos", "end_pos", *[k for k in keys if k != "chrom"]), how, proportion)
    weight = F.col("weight") * lengths.count_overlap_weight() if how is Assigner.COUNT_OVERLAP else F.col("weight")
    return lengths.counts(assigned, keys, edges, weight)


def midpoint_profiles(frags: DataFrame, select: Selection, sites: DataFrame, bins: str = "30 1001", smooth: int | None = 165, bin_size: int = 1, group: str = "group_name") -> DataFrame:
    """Midpoint profiles per group of sites of one width, smoothed and binned.

    Sites are widened by half the smoothing window first, so that smoothing has no edges; those near the blacklist go.
    """
    widths = sites.select((F.col("end_pos") - F.col("start_pos")).alias("w")).distinct().limit(2).collect()
    if len(widths) != 1:
        raise ValueError("sites must share one width")
    width, margin = widths[0].w, (smooth or 1) // 2
    grown = sites.withColumn("start_pos", F.col("start_pos") - margin).withColumn("end_pos", F.col("end_pos") + margin)
    if select.blacklist is not None:
        grown = blacklist.drop(grown, select.blacklist, Strategy.ANY)
    chosen = select.apply(frags)
    if select.scaling is not None:
        chosen = weights.average_factor(chosen, select.scaling, []).withColumn("weight", F.col("weight") * F.col("factor"))
    out = profiles.midpoint_profile(chosen, grown, length_edges(bins), F.col("weight"), group)
    keys = [group, "length_start"]
    out = profiles.savgol(out, keys, smooth) if smooth else out
    out = out.withColumn("position", F.col("position") - margin).where((F.col("position") >= 0) & (F.col("position") < width))
    return out if bin_size == 1 else profiles.binned_profile(out, keys, bin_size, width)


def end_motifs(frags: DataFrame, select: Selection, chunked: DataFrame, k_inside: int, k_outside: int = 0, size: int | None = None, collapse: bool = False, chunk: int = sequence.CHUNK) -> DataFrame:
    """End-motif counts, global or per fixed-size window of the end's base."""
    ends = sequence.end_motifs(select.apply(frags), chunked, k_inside, k_outside, collapse, chunk)
    keys = []
    if size is not None:
        place = F.when(F.col("end") == "left", F.col("boundary")).otherwise(F.col("boundary") - 1)
        ends, keys = ends.withColumn("window_start", F.floor(place / size) * size), ["chrom", "window_start"]
    return ends.groupBy(*keys, "motif").agg(F.sum("weight").alias("count"))


def ref_kmers(chunked: DataFrame, k: int, keys: list[str] = [], orientation: str = "both", canonical: bool = False, mask: DataFrame | None = None, chunk: int = sequence.CHUNK) -> DataFrame:  # noqa: B006
    """Reference k-mer frequencies per key column of the chunks; chunks must overlap by k - 1 bases."""
    source = chunked if mask is None else sequence.masked(chunked, mask, chunk)
    found = sequence.tallied(source, k, chunk, keys)
    return sequence.frequencies(sequence.kmer_counts(found, keys, orientation, canonical, k, F.col("weight")), keys)


def scaling_weights(frags: DataFrame, select: Selection, chroms: DataFrame, stride: int = 500_000, width: int = 5_000_000, unit_mass: bool = False) -> DataFrame:
    """Smoothed inverse coverage (or fragment-count) factors per stride."""
    return weights.scaling_factors(select.apply(frags), chroms, stride, width, select.blacklist, unit_mass, F.col("weight"))


def protection_peaks(frags: DataFrame, window: int = 120, sizes: tuple[int, int] = (120, 180), least: float = 5.0) -> DataFrame:
    """Peaks of the windowed protection score."""
    return profiles.peaks(profiles.protection_score(frags, window, sizes), least=least)


def _fragments_of(reads: DataFrame, select: Selection, targets: DataFrame | None, factors: dict[str, DataFrame] | None) -> DataFrame:
    """Fragments that count, out of reads: as ``select`` gives them, with qname and a column for each of ``factors``."""
    from ..operators.reads import opposite_strands, pair, usable_paired

    usable = reads.where(usable_paired(select.min_mapq) & opposite_strands() & (F.col("chrom") == F.coalesce("mate_chrom", "chrom")))
    chosen = select.apply(pair(usable, require_first=True).withColumnsRenamed({"min_mapq": "mapq", "read1_strand": "strand"}))
    if targets is not None:
        places = chosen.select("chrom", "start_pos", "end_pos").distinct()
        hit = intervals.overlap_join(places, intervals.renamed(targets.select("chrom", "start_pos", "end_pos"))).select("chrom", "start_pos", "end_pos").distinct()
        chosen = chosen.join(hit, ["chrom", "start_pos", "end_pos"], "left_semi")
    for name, bins in (factors or {}).items():
        chosen = weights.average_factor(chosen, bins, []).withColumnRenamed("factor", name)
    return chosen


def bam_to_frag(reads: DataFrame, select: Selection, targets: DataFrame | None = None, factors: dict[str, DataFrame] | None = None) -> DataFrame:
    """Reads to fragments in file form; weight columns appear only where their input is given."""
    names = ["chrom", "start_pos", "end_pos", "mapq", "strand"] + (["gc_weight"] if select.gc_tag else [])
    return _fragments_of(reads, select, targets, factors).select(*names, *(factors or {}))


def tagged_reads(reads: DataFrame, select: Selection, targets: DataFrame | None = None, factors: dict[str, DataFrame] | None = None) -> DataFrame:
    """Both reads of each fragment that counts, with tags: fl (its length), GC (its weight, if chosen by one) and one for
    each of ``factors`` (say cw and nw). With targets only fragments that meet one stay."""
    chosen = _fragments_of(reads, select, targets, factors)
    tags = [(F.col("end_pos") - F.col("start_pos")).cast("int").alias("fl")] + ([F.col("weight").alias("GC")] if select.gc_tag else [])
    return reads.join(chosen.select("chrom", "qname", *tags, *(factors or {})), ["chrom", "qname"])


def coverage_of_reads(reads: DataFrame, select: Selection, targets: DataFrame | None = None, least_gap: int = 1, ignore_gap: bool = False, single: bool = False, **options) -> DataFrame:
    """``fcoverage`` of reads: deletions and skips of at least ``least_gap`` bases, and on request the gap between
    mates, don't count as covered. Filters look at whole fragments, coverage at their segments."""
    from ..operators import alignments

    segments = alignments.segment_fragments(reads, least_gap, ignore_gap, single)
    frags = segments.select("chrom", "qname", "start_pos", "end_pos").distinct()
    chosen = select.apply(frags).select("chrom", "qname", "weight")
    parts = segments.join(chosen, ["chrom", "qname"]).select("chrom", F.col("seg_start").alias("start_pos"), F.col("seg_end").alias("end_pos"), "weight")
    covered = coverage.segments(parts, F.col("weight"))
    if select.scaling is not None:
        covered = coverage.scaled(covered, select.scaling)
    if targets is None:
        return coverage.runs(covered if select.blacklist is None else intervals.subtract(covered, select.blacklist, ["value"]), options.get("decimals", 2))
    keys = options.get("keys", ["window_idx"])
    return coverage.summary(coverage.sums(covered, targets, keys, select.blacklist))


def lengths_of_reads(reads: DataFrame, select: Selection, indels: str = "ignore", clips: str = "aligned", most_clipped: int = 256, most_deleted: int | None = None, single: bool = False, size: int | None = None, targets: DataFrame | None = None, how: Assigner = Assigner.COUNT_OVERLAP, bins: str = "30:1001:1", keys: list[str] = ["window_idx"], proportion: float = 0.5) -> DataFrame:  # noqa: B006
    """Length histograms of reads, with lengths under an indel and a clip mode.

    Length limits hold for the adjusted length. Blacklists look at the aligned fragment, windows at the assignment interval.
    Under count-overlap a fragment counts with the share of its assignment interval in the window, and scaling is that of
    the overlapped part; else scaling is that of the whole aligned fragment.
    """
    from ..operators import alignments

    found = alignments.indel_fragments(reads, indels, clips, most_clipped, most_deleted, single)
    whole = Selection(10, 50_000, 0, select.chromosomes, select.blacklist, select.strategy, select.proportion)
    chosen = whole.apply(found.withColumnRenamed("min_mapq", "mapq")).where(F.col("size").between(select.min_length, select.max_length) & (F.col("mapq") >= select.min_mapq))
    edges, count = length_edges(bins), how is Assigner.COUNT_OVERLAP and (size is not None or targets is not None)
    if select.scaling is not None and not count:
        chosen = weights.average_factor(chosen, select.scaling, []).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
    if size is None and targets is None:
        return lengths.counts(chosen, [], edges, F.col("weight"), F.col("size"))
    placed = chosen.withColumn("start_pos", F.col("assign_start")).withColumn("end_pos", F.col("assign_end"))
    if size is not None:
        assigned, keys = windows.assign_fixed(placed, size, how, proportion), ["chrom", "window_start"]
        assigned = assigned.withColumn("b_start", F.col("window_start")).withColumn("b_end", F.col("window_start") + size)
    else:
        assigned = windows.assign(placed, targets.select("chrom", "start_pos", "end_pos", *[k for k in keys if k != "chrom"]), how, proportion)
    if select.scaling is not None and count:
        assigned = weights.overlap_factor(assigned, select.scaling).withColumn("weight", F.col("weight") * F.col("factor"))
    return lengths.counts(assigned, keys, edges, F.col("weight") * lengths.count_overlap_weight() if count else F.col("weight"), F.col("size"))


def ends_of_reads(reads: DataFrame, select: Selection, k: int, targets: DataFrame | None = None, size: int | None = None, keys: list[str] = ["window_idx"], **options) -> DataFrame:  # noqa: B006
    """End-motif counts with inside bases from reads, global or by the window that holds the end's base.

    ``options`` are those of ``alignments.resolve_ends``. Blacklists and length limits look at the assignment interval. The
    right end's bases are given as its reverse complement, so that both ends read outside in.
    """
    from ..functions import reverse_complement
    from ..operators import alignments

    ends = alignments.resolve_ends(reads, k, from_read=True, **options)
    placed = ends.withColumnsRenamed({"start_pos": "frag_start", "end_pos": "frag_end", "assign_start": "start_pos", "assign_end": "end_pos"})
    chosen = select.apply(placed)
    motif = F.when(F.col("end") == "right", reverse_complement("bases")).otherwise(F.col("bases"))
    told = chosen.withColumn("motif", F.concat(F.lit("_"), motif)).where("not contains(motif, 'N')")
    place = F.when(F.col("end") == "left", F.col("boundary")).otherwise(F.col("boundary") - 1)
    if size is not None:
        told, keys = told.withColumn("window_start", F.floor(place / size) * size), ["chrom", "window_start"]
    elif targets is not None:
        points = told.select("chrom", "motif", "weight", place.alias("start_pos"), (place + 1).alias("end_pos"))
        told = intervals.overlap_join(points, intervals.renamed(targets.select("chrom", "start_pos", "end_pos", *[k for k in keys if k != "chrom"])))
    else:
        keys = []
    return told.groupBy(*keys, "motif").agg(F.sum("weight").alias("count"))


def ref_gc_bias(chunked: DataFrame, lengths_: list[int], every: int = 10, end_offset: int = 10, targets: DataFrame | None = None, seed: int = 0, least_share: float = 0.0, support_per_mb: float = 1.0, chunk: int = sequence.CHUNK) -> dict:
    """The reference's GC package: counts by length and GC percent from sampled starts, debiased and with its support.

    Overlapping and touching targets merge first, so that a start counts once. Only a matrix of lengths x 101 is collected.
    """
    import numpy as np

    from ..operators import gcbias

    starts = gcbias.sampled_starts(chunked, every, seed, chunk)
    merged = None if targets is None else intervals.merge(targets)
    counted = gcbias.reference_counts(chunked, starts, lengths_, chunk, end_offset, merged, [], least_share)
    own = chunked.select(F.substring("seq", 1, chunk).alias("s"))
    acgt = own.agg(F.sum(F.length(F.regexp_replace("s", "[^ACGT]", "")))).first()[0] or 0
    matrix = gcbias.matrix(counted, lengths_)
    possible = gcbias.support_theoretical(lengths_, end_offset)
    debiased = np.stack([_flat(row, n - 2 * end_offset) for row, n in zip(matrix, lengths_)])
    return {"lengths": lengths_, "end_offset": end_offset, "counts": debiased, "possible": possible, "support": possible & gcbias.support_per_mb(matrix, acgt, support_per_mb / every), "acgt": int(acgt)}


def _flat(row, size: int):
    """A row by GC percent, divided by how many GC counts fall on each percent, with its mass kept."""
    import numpy as np

    from ..operators import gcbias

    if size <= 0 or not row.sum():
        return row
    flat = row / np.maximum(1, gcbias.percent_widths(size))
    return flat * row.sum() / flat.sum()


def gc_bias(frags: DataFrame, select: Selection, chunked: DataFrame, reference: dict, chroms: DataFrame | None = None, window: int | None = 100_000, chunk: int = sequence.CHUNK, **options) -> dict:
    """The correction package of a sample against a reference package.

    Counts are averaged over windows of one size, each scaled to a mean cell of 1 and by its usable bases (``window`` None: plain
    sums). A fragment belongs to the window of its midpoint. Only matrices reach the driver.
    """
    from ..functions import int_div, midpoint
    from ..operators import gcbias

    lengths_ = reference["lengths"]
    chosen = select.apply(frags).where((F.col("end_pos") - F.col("start_pos")).isin(*lengths_))
    told = gcbias.fragment_gc(chosen, chunked, reference["end_offset"], chunk)
    if window is None:
        sample = gcbias.matrix(gcbias.observed_counts(told), lengths_)
    else:
        name = lambda p: F.concat_ws(":", "chrom", int_div(p, window).cast("string"))
        counted = gcbias.observed_counts(told.withColumn("window_idx", name(midpoint("start_pos", "end_pos"))), ["window_idx"])
        bases = chunked.select("chrom", F.explode(F.sequence(F.lit(0), int_div(F.least(F.length("seq"), F.lit(chunk)) - 1, 1000))).alias("i"), "chunk_start", "seq")
        piece = F.substring("seq", (F.col("i") * 1000 + 1).cast("int"), F.least(F.lit(1000), F.lit(chunk) - F.col("i") * 1000).cast("int"))
        spans = bases.select("chrom", (F.col("chunk_start") + F.col("i") * 1000).alias("p"), piece.alias("s"))
        window_bp = spans.groupBy(name(F.col("p")).alias("window_idx")).agg(F.sum(F.length("s")).alias("span"), F.sum(F.length(F.regexp_replace("s", "[^ACGT]", ""))).alias("acgt"))
        sample = gcbias.matrix(gcbias.window_scaled(counted, window_bp), lengths_, "weight")
    return gcbias.correction(sample, reference["counts"], lengths_, support=reference["support"], **options) | {"end_offset": reference["end_offset"]}


def check_package(package: dict, select: Selection, end_offset: int | None = None) -> None:
    """A correction package must cover the lengths of the run and share its end offset."""
    if package["length_edges"][0] > select.min_length or package["length_edges"][-1] <= select.max_length:
        raise ValueError(f"the package covers lengths {package['length_edges'][0]}..{package['length_edges'][-1] - 1}, the run {select.min_length}..{select.max_length}")
    if end_offset is not None and package.get("end_offset", end_offset) != end_offset:
        raise ValueError(f"the package has end offset {package['end_offset']}, the run {end_offset}")


def protection(frags: DataFrame, select: Selection, targets: DataFrame | None = None, window: int = 120, sizes: tuple[int, int] = (120, 180), keys: list[str] = ["window_idx"]) -> DataFrame:  # noqa: B006
    """Windowed protection score, weighted, scaled and masked: runs, or its average and total per window."""
    if sizes[0] < window:
        raise ValueError("fragments must be at least as long as the window")
    score = profiles.protection_score(select.apply(frags), window, sizes, weight=F.col("weight"))
    if select.scaling is not None:
        score = coverage.scaled(score, select.scaling)
    if targets is None:
        return coverage.runs(score if select.blacklist is None else intervals.subtract(score, select.blacklist, ["value"]))
    return coverage.summary(coverage.sums(score, targets, keys, select.blacklist)).select(*keys, "average", "total", "blacklisted")


def fragment_kmers(frags: DataFrame, select: Selection, chunked: DataFrame, k: int, by_position: bool = False, chunk: int = sequence.CHUNK, **positions) -> DataFrame:
    """k-mer counts at selected positions of fragments, scaled by the factor at each k-mer's first base.

    ``positions`` are those of ``sequence.position_table`` (frame, first, last, step). Returns (offset,) kmer, count.
    """
    chosen = select.apply(frags)
    table = sequence.position_table(frags.sparkSession, (select.min_length, select.max_length), k, **positions)
    found = sequence.fragment_kmers(chosen, chunked, table, k, chunk)
    if select.scaling is not None:
        spot = found.withColumn("_at", F.col("frag_start") + F.col("offset")).withColumn("_to", F.col("_at") + 1)
        found = weights.average_factor(spot, select.scaling, [], "_at", "_to").withColumn("weight", F.col("weight") * F.col("factor"))
    return found.groupBy(*(["offset"] if by_position else []), "kmer").agg(F.sum("weight").alias("count"))


def transitions(frags: DataFrame, select: Selection, chunked: DataFrame, order: int, chunk: int = sequence.CHUNK, **positions) -> DataFrame:
    """Probabilities of the next base behind ``order`` bases, for each selected position."""
    counted = fragment_kmers(frags, select, chunked, order + 1, True, chunk, **positions).withColumnRenamed("count", "weight")
    return sequence.transitions(counted, ["offset"], order)


@dataclass
class WindowPlan:
    """Settings of ``prep_windows``; a step without its setting is left out."""

    score: str | None = None
    chromosomes: list[str] | None = None
    resize: int | None = None
    outside: str = "drop"
    blacklist: DataFrame | None = None
    duplicates: str | None = None
    merge_within: int | None = None
    cluster_depth: int | None = None
    least_distance: int | None = None
    keep: str = "first"
    merge_across: int | None = None
    near: DataFrame | None = None
    distance_bins: list[str] | None = None
    exclude: dict[str, list[str]] = field(default_factory=dict)
    min_per: dict[str, int] = field(default_factory=dict)


def prep_windows(given: DataFrame, plan: WindowPlan, chroms: DataFrame | None = None, group: str = "group_name") -> DataFrame:
    """Windows(chrom, start_pos, end_pos, group, window_idx, score) through all steps in their fixed order.

    Scores, chromosomes, sizes, blacklist, duplicates, merging within groups (and sizes again), distance, clusters, merging
    across groups (and sizes and blacklist again), nearest targets, exclusions, least numbers; sorted by place.
    """
    from ..functions import score_filter
    from ..operators import prepare

    out = given
    if plan.score:
        out = out.where(score_filter("score", plan.score))
    if plan.chromosomes is not None:
        out = out.where(F.col("chrom").isin(*plan.chromosomes))
    sized = lambda df: df if plan.resize is None else prepare.resize(df, plan.resize, chroms, plan.outside)
    cleared = lambda df: df if plan.blacklist is None else blacklist.drop(df, plan.blacklist)
    numbered = lambda df: df.withColumn("window_idx", F.xxhash64("chrom", "start_pos", "end_pos", group)).withColumn("score", F.lit(None).cast("double"))  # noqa: E731  merged rows have no own number
    out = cleared(sized(out))
    if plan.duplicates:
        out = prepare.deduplicate(out, ["chrom", "start_pos", "end_pos", group], plan.duplicates)
    if plan.merge_within is not None:
        out = sized(numbered(prepare.merge_within(out, plan.merge_within, group)))
    if plan.least_distance is not None:
        out = prepare.thin(out, plan.least_distance, plan.keep, group)
    if plan.cluster_depth is not None:
        out = prepare.cluster_label(out, plan.cluster_depth, ["window_idx"])
    if plan.merge_across is not None:
        out = cleared(sized(numbered(prepare.merge_across(out, plan.merge_across, group))))
    if plan.near is not None:
        out = prepare.annotate_nearest(out, plan.near, plan.distance_bins)
    if plan.exclude:
        out = prepare.exclude(out, plan.exclude)
    if plan.min_per:
        out = prepare.min_per(out, plan.min_per)
    return out.orderBy("chrom", "start_pos", "end_pos", group)
