"""Reads to fragments: flag filters, mate pairing, CIGAR segments, indel-aware lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col
from .weights import combined_gc

# SAM flag bits, fixed values of the format
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, LAST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << k for k in range(12))


def has(bits: int, flag="flag") -> Column:
    return col(flag).bitwiseAND(F.lit(bits)) != 0


def usable_single(min_mapq: int = 0) -> Column:
    """Mapped, primary, no duplicate, no QC failure, good mapping quality."""
    return ~has(UNMAPPED | SECONDARY | SUPPLEMENTARY | DUPLICATE | QC_FAIL) & (F.col("mapq") >= min_mapq)


def usable_paired(min_mapq: int = 0, proper_only: bool = False) -> Column:
    """As usable_single, with a mapped mate on the same chromosome and the other strand.

    Needs mate_chrom where it differs from chrom; without that column mates are taken to share it.
    """
    out = usable_single(min_mapq) & ~has(MATE_UNMAPPED)
    return out & has(PROPER) if proper_only else out


def opposite_strands() -> Column:
    return has(REVERSE) != has(MATE_REVERSE)


def pair(reads: DataFrame, require_first: bool = False) -> DataFrame:
    """Fragments from reads(chrom, qname, pos, end_pos, flag, mapq, gc_tag): one forward and one reverse read each.

    Only names with exactly one usable read of each strand on a chromosome pair up, and only inwards: the forward
    read starts at or before the reverse one. The fragment runs from the forward start to the reverse end. With
    ``require_first`` exactly one of the two must be the first read. Returns chrom, qname, start_pos, end_pos, min_mapq,
    read1_strand, gc_state, gc_weight.
    """
    fwd, rev = ~has(REVERSE), has(REVERSE)
    told = reads.groupBy("chrom", "qname").agg(
        F.count_if(fwd).alias("n_fwd"), F.count_if(rev).alias("n_rev"), F.count_if(has(FIRST)).alias("n_first"),
        F.max(F.when(fwd, F.col("pos"))).alias("start_pos"), F.max(F.when(rev, F.col("pos"))).alias("rev_pos"),
        F.max(F.when(rev, F.col("end_pos"))).alias("end_pos"), F.min("mapq").alias("min_mapq"),
        F.max(F.when(fwd, F.col("gc_tag"))).alias("gc_fwd"), F.max(F.when(rev, F.col("gc_tag"))).alias("gc_rev"),
        F.max(F.when(has(FIRST), F.when(rev, "-").otherwise("+"))).alias("read1_strand"),
    )
    ok = (F.col("n_fwd") == 1) & (F.col("n_rev") == 1) & (F.col("start_pos") <= F.col("rev_pos")) & (F.col("end_pos") > F.col("start_pos"))
    if require_first:
        ok = ok & (F.col("n_first") == 1)
    state, weight = combined_gc("gc_fwd", "gc_rev")
    return told.where(ok).select("chrom", "qname", "start_pos", "end_pos", "min_mapq", "read1_strand", state.alias("gc_state"), weight.alias("gc_weight"))


def single(reads: DataFrame) -> DataFrame:
    """Reads that are fragments themselves."""
    strand = F.when(has(REVERSE), "-").otherwise("+")
    return reads.select("chrom", "qname", F.col("pos").alias("start_pos"), "end_pos", F.col("mapq").alias("min_mapq"), strand.alias("read1_strand"), "gc_tag")


def cigar_ops(cigar) -> Column:
    """CIGAR text as an array of (n, op, ref): length, letter, and reference bases before the operation."""
    n = F.transform(F.regexp_extract_all(col(cigar), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("long"))
    op = F.regexp_extract_all(col(cigar), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    ops = F.arrays_zip(n.alias("n"), op.alias("op"))
    eats = lambda x: F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0)
    empty = F.expr("cast(array() as array<struct<n:bigint,op:string,ref:bigint>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    walked = F.aggregate(
        ops, start,
        lambda s, x: F.struct((s["at"] + eats(x)).alias("at"), F.concat(s["out"], F.array(F.struct(x["n"].alias("n"), x["op"].alias("op"), s["at"].alias("ref")))).alias("out")),
    )
    return walked["out"]


def reference_length(cigar) -> Column:
    """Bases of the reference that an alignment spans."""
    n = F.regexp_extract_all(col(cigar), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def mapped_segments(cigar, pos, min_gap: int = 1) -> Column:
    """Array of (start, end): the alignment split at deletions and skips of at least ``min_gap`` bases."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    aligned = F.filter(cigar_ops(cigar), lambda x: x["op"].isin("M", "=", "X", "D", "N"))
    gap = lambda x: x["op"].isin("D", "N") & (x["n"] >= min_gap)
    at = col(pos).cast("long")

    def step(s, x):
        a, b = at + x["ref"], at + x["ref"] + x["n"]
        joined = (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["end"] == a)
        grown = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(s, F.lit(-1))["start"].alias("start"), b.alias("end"))))
        return F.when(gap(x), s).when(joined, grown).otherwise(F.concat(s, F.array(F.struct(a.alias("start"), b.alias("end")))))

    return F.aggregate(aligned, empty, step)


def indel_bases(cigar) -> tuple[Column, Column, Column, Column]:
    """(deleted, inserted, left soft clip, right soft clip) bases of an alignment."""
    total = lambda op: F.aggregate(F.regexp_extract_all(col(cigar), F.lit(rf"(\d+){op}"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    left = F.coalesce(F.nullif(F.regexp_extract(col(cigar), r"^(?:\d+H)?(\d+)S", 1), F.lit("")).cast("long"), F.lit(0))
    right = F.coalesce(F.nullif(F.regexp_extract(col(cigar), r"[A-Z=](\d+)S(?:\d+H)?$", 1), F.lit("")).cast("long"), F.lit(0))
    return total("D"), total("I"), left, right


def adjusted_length(size, deleted, inserted, left_clip, right_clip, indels: str = "ignore", clips: str = "aligned") -> Column:
    """Length as counted: insertions add and deletions take away under 'adjust', clips add under 'adjust'."""
    out = col(size)
    if indels == "adjust":
        out = out + col(inserted) - col(deleted)
    if clips == "adjust":
        out = out + col(left_clip) + col(right_clip)
    return out
