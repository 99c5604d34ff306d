"""Fragments from alignments: indel-aware lengths, fragment ends under clip, indel and quality policies, mate segments.

Reads are rows (chrom, qname, pos, flag, mapq, cigar, and for ends seq and qual). CIGARs are taken apart by column
expressions, so all of it stays in the JVM. Intervals are 0-based and half-open.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, quality_filter
from .reads import FIRST, REVERSE, cigar_ops, has, indel_bases, mapped_segments, reference_length
from .weights import combined_gc

#: Soft-clipped bases of an end that are accepted at most, unless told otherwise.
MOST_CLIPPED = 256
_SPANS = "cast(array() as array<struct<start:bigint,end:bigint>>)"


class Clips(Enum):
    ALIGNED = "aligned"
    SKIP = "skip"
    AT_ALIGNED = "include-at-aligned-boundary"
    AT_SHIFTED = "include-at-shifted-boundary"

    @property
    def included(self) -> bool:
        return self in (Clips.AT_ALIGNED, Clips.AT_SHIFTED)


class Indels(Enum):
    """What an indel within an end's inside bases does: auto skips the end if its bases come from the reference."""

    AUTO = "auto"
    SKIP_END = "skip-affected-end"
    SKIP_FRAGMENT = "skip-affected-fragment"


def _overlap(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(x["end"], high) - F.greatest(x["start"], low))


def _total(spans: Column, size) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + size(x))


def deletions(cigar, pos) -> Column:
    """Array of (start, end) on the reference that D and N operations leave out; touching ones as one."""
    at = col(pos).cast("long")
    gaps = F.filter(cigar_ops(cigar), lambda x: x["op"].isin("D", "N") & (x["n"] > 0))

    def step(s, x):
        a, last = at + x["ref"], F.try_element_at(s, F.lit(-1))
        grown = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (a + x["n"]).alias("end"))))
        return F.when((F.size(s) > 0) & (last["end"] == a), grown).otherwise(F.concat(s, F.array(F.struct(a.alias("start"), (a + x["n"]).alias("end")))))

    return F.aggregate(gaps, F.expr(_SPANS), step)


def insertions(cigar, pos) -> Column:
    """Array of (at, n): the reference position before which n bases are inserted."""
    found = F.filter(cigar_ops(cigar), lambda x: (x["op"] == "I") & (x["n"] > 0))
    return F.transform(found, lambda x: F.struct((col(pos).cast("long") + x["ref"]).alias("at"), x["n"].alias("n")))


def motif_has_indel(cigar, aligned: Column, from_right: bool) -> Column:
    """Whether an insertion, deletion or skip lies before so many aligned bases are seen, from one side of an alignment."""
    ops = F.filter(cigar_ops(cigar), lambda x: ~x["op"].isin("S", "H", "P"))
    ops = F.reverse(ops) if from_right else ops
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(False).alias("hit"))
    walked = F.aggregate(
        ops, start,
        lambda s, x: F.struct((s["seen"] + F.when(x["op"].isin("M", "=", "X"), x["n"]).otherwise(0)).alias("seen"), (s["hit"] | ((s["seen"] < aligned) & x["op"].isin("I", "D", "N"))).alias("hit")),
    )
    return walked["hit"]


def with_alignment(reads: DataFrame) -> DataFrame:
    """reads with end_pos, clips, deletions and insertions out of pos and cigar."""
    _, _, left, right = indel_bases("cigar")
    told = {"end_pos": F.col("pos") + reference_length("cigar"), "left_clip": left, "right_clip": right, "deleted": deletions("cigar", "pos"), "inserted": insertions("cigar", "pos")}
    return reads.withColumns(told | {"hard_clip": F.col("cigar").rlike(r"\dH")})


def mates(reads: DataFrame, *carried: str, require_first: bool = False) -> DataFrame:
    """(chrom, qname, f, r, min_mapq, read1_strand, gc_state, gc_weight): one forward and one reverse read each, inwards.

    f and r are structs of pos, end_pos and the columns ``carried``. Names with other than one usable read of each strand
    on a chromosome make no fragment. Without a column gc_tag the state is missing.
    """
    tagged = reads if "gc_tag" in reads.columns else reads.withColumn("gc_tag", F.lit(None).cast("double"))
    told = F.struct("pos", "end_pos", "gc_tag", *carried)
    side = lambda test, name: F.first(F.when(test, told), ignorenulls=True).alias(name)
    found = tagged.groupBy("chrom", "qname").agg(
        side(~has(REVERSE), "f"), side(has(REVERSE), "r"), F.count_if(~has(REVERSE)).alias("n_f"), F.count_if(has(REVERSE)).alias("n_r"),
        F.count_if(has(FIRST)).alias("n_first"), F.min("mapq").alias("min_mapq"),
        F.max(F.when(has(FIRST), F.when(has(REVERSE), "-").otherwise("+"))).alias("read1_strand"),
    )
    ok = (F.col("n_f") == 1) & (F.col("n_r") == 1) & (F.col("f.pos") <= F.col("r.pos")) & (F.col("r.end_pos") > F.col("f.pos"))
    if require_first:
        ok = ok & (F.col("n_first") == 1)
    state, weight = combined_gc("f.gc_tag", "r.gc_tag")
    return found.where(ok).select("chrom", "qname", "f", "r", "min_mapq", "read1_strand", state.alias("gc_state"), weight.alias("gc_weight"))


def as_mates(reads: DataFrame, *carried: str) -> DataFrame:
    """Reads that are fragments themselves, in the form of ``mates``: each is both of its sides."""
    told = F.struct("pos", "end_pos", *carried)
    strand = F.when(has(REVERSE), "-").otherwise("+")
    return reads.select("chrom", "qname", told.alias("f"), told.alias("r"), F.col("mapq").alias("min_mapq"), strand.alias("read1_strand"))


def indel_fragments(reads: DataFrame, indels: str = "adjust", clips: str = "aligned", most_clipped: int = MOST_CLIPPED, most_deleted: int | None = None, single: bool = False) -> DataFrame:
    """Fragments with indel-aware lengths: chrom, qname, start_pos, end_pos, deleted, inserted, clips and ``size``.

    Indels outside of the mates' aligned overlap count in full; within it only those that both mates show: shared
    bases of deletions, and the lesser of two insertions at one place. ``indels``: 'adjust' adds insertions and takes
    deletions off, 'ignore' leaves the reference span, 'skip' drops fragments with an indel in either mate. ``clips``:
    'adjust' adds soft clips to the length and to assign_start and assign_end, 'skip' drops clipped fragments. Fragments with an
    end of more than most_clipped clipped bases or of more than most_deleted deleted ones go.
    """
    if indels not in ("adjust", "ignore", "skip") or clips not in ("aligned", "adjust", "skip"):
        raise ValueError(f"unknown mode: {indels}, {clips}")
    carried = ("left_clip", "right_clip", "deleted", "inserted")
    found = (as_mates if single else mates)(with_alignment(reads), *carried)
    start, end = F.col("f.pos").cast("long"), F.col("r.end_pos").cast("long")
    low, high = F.greatest("f.pos", "r.pos").cast("long"), F.least("f.end_pos", "r.end_pos").cast("long")
    shared = F.lit(not single) & (low < high)
    within = lambda x: F.when(shared, _overlap(x, low, high)).otherwise(F.lit(0).cast("long"))
    sides = ("f",) if single else ("f", "r")
    apart = lambda x: _overlap(x, start, end) - F.when(shared, _overlap(x, F.greatest(low, start), F.least(high, end))).otherwise(F.lit(0).cast("long"))
    deleted_out = sum((_total(F.col(f"{s}.deleted"), apart) for s in sides), F.lit(0).cast("long"))
    both = F.flatten(F.transform("f.deleted", lambda x: F.transform("r.deleted", lambda y: F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["end"], y["end"]).alias("end")))))
    deleted_in = _total(both, within)
    inside = lambda x: F.coalesce(shared & (x["at"] >= low) & (x["at"] < high), F.lit(False))
    held = lambda x: (x["at"] >= start) & (x["at"] < end)
    inserted_out = sum((_total(F.filter(F.col(f"{s}.inserted"), lambda x: held(x) & ~inside(x)), lambda x: x["n"]) for s in sides), F.lit(0).cast("long"))
    most = lambda s, at: F.coalesce(F.array_max(F.transform(F.filter(F.col(f"{s}.inserted"), lambda y: y["at"] == at), lambda y: y["n"])), F.lit(0).cast("long"))
    places = F.array_distinct(F.transform(F.filter("f.inserted", lambda x: held(x) & inside(x)), lambda x: x["at"]))
    inserted_in = F.aggregate(places, F.lit(0).cast("long"), lambda n, at: n + F.least(most("f", at), most("r", at)))
    if single:
        deleted_in = inserted_in = F.lit(0).cast("long")
    counted = indels == "adjust"
    zero = F.lit(0).cast("long")
    out = found.select(
        *[c for c in found.columns if c not in ("f", "r")], start.alias("start_pos"), end.alias("end_pos"),
        (deleted_out + deleted_in if counted else zero).alias("deleted"), (inserted_out + inserted_in if counted else zero).alias("inserted"),
        F.col("f.left_clip").alias("left_clip"), F.col("r.right_clip").alias("right_clip"),
        sum((F.size(F.col(f"{s}.{k}")) for s in sides for k in ("deleted", "inserted")), F.lit(0)).alias("_indels"),
    )
    if indels == "skip":
        out = out.where("_indels = 0")
    out = out.where((F.col("left_clip") <= most_clipped) & (F.col("right_clip") <= most_clipped))
    if most_deleted is not None:
        out = out.where(F.col("deleted") <= most_deleted)
    size, add_left, add_right = F.greatest(zero, F.col("end_pos") - F.col("start_pos") + F.col("inserted") - F.col("deleted")), zero, zero
    if clips == "skip":
        out = out.where("left_clip = 0 and right_clip = 0")
    elif clips == "adjust":
        add_left, add_right = F.col("left_clip"), F.col("right_clip")
    assigned = (F.greatest(zero, F.col("start_pos") - add_left).alias("assign_start"), (F.col("end_pos") + add_right).alias("assign_end"))
    return out.select(*[c for c in out.columns if c != "_indels"], *assigned, (size + add_left + add_right).alias("size"))


def _end(read: str, right: bool, k: int, clips: Clips, indels: Indels, from_read: bool, most_clipped: int) -> Column:
    """Struct (keep, drop_fragment, assigned, boundary, bases, qualities, checked) of one fragment end."""
    c = lambda x: F.col(f"{read}.{x}")
    clip = c("right_clip") if right else c("left_clip")
    edge = (c("end_pos") if right else c("pos")).cast("long")
    shift = clip if clips is Clips.AT_SHIFTED else F.lit(0).cast("long")
    boundary = edge + shift if right else F.greatest(F.lit(0).cast("long"), edge - shift)
    aligned = F.greatest(F.lit(0).cast("long"), F.lit(k) - clip) if clips.included else F.lit(k).cast("long")
    has_indel = motif_has_indel(c("cigar"), aligned, right)
    trusted = clip <= most_clipped
    clipped_out = F.lit(clips is Clips.SKIP) & (clip > 0)
    spoilt = has_indel & F.lit(indels is not Indels.AUTO or not from_read)
    size, cut = F.length(c("seq")), F.lit(0).cast("long") if clips.included else clip
    first = (size - cut - k) if right else cut
    fits = (first >= 0) & (first + k <= size)
    readable = fits if from_read else F.lit(True)
    keep = trusted & ~clipped_out & ~spoilt & readable
    stays = trusted & ~clipped_out & (spoilt | readable)  # the end's place counts, whether or not its bases do
    none = F.lit(None)
    return F.struct(
        keep.alias("keep"), (trusted & has_indel & F.lit(indels is Indels.SKIP_FRAGMENT)).alias("drop_fragment"),
        F.when(stays, boundary).otherwise(edge).alias("assigned"), F.when(keep, boundary).alias("boundary"),
        F.when(keep & fits, F.substring(c("seq"), (first + 1).cast("int"), F.lit(k))).otherwise(none).alias("bases") if from_read else F.lit(None).cast("string").alias("bases"),
        F.when(keep & fits, F.slice(c("qual"), F.greatest(first + 1, F.lit(1)).cast("int"), F.lit(k))).otherwise(none).alias("qualities"),
        (aligned if clips is Clips.AT_ALIGNED else F.lit(k).cast("long")).alias("checked"),
    )


def resolve_ends(reads: DataFrame, k: int, clips: Clips = Clips.ALIGNED, indels: Indels = Indels.AUTO, from_read: bool = False, most_clipped: int = MOST_CLIPPED, quality: list[str] = [], single: bool = False) -> DataFrame:  # noqa: B006
    """A row for each end that counts: chrom, qname, end, boundary, bases, checked, start_pos, end_pos, assign_start, assign_end.

    An end whose soft clip exceeds most_clipped, or any clip under SKIP, drops out and its aligned edge assigns the
    fragment. Under AT_SHIFTED the boundary moves out by the clip; with either inclusion clipped bases are the first
    inside ones. An indel among the aligned inside bases skips the end (its boundary still assigns the fragment) or the fragment.
    ``bases`` are the k inside bases of the read in reference orientation, null where the reference gives them;
    ``checked`` of them lie on the reference. Hard-clipped fragments and those with no end left go. Quality
    rules are looked at for the inside bases of ends that still count: fragment rules first, over both ends, then rules
    for each end.
    """
    carried = ("cigar", "seq", "qual", "left_clip", "right_clip", "hard_clip")
    found = (as_mates if single else mates)(with_alignment(reads), *carried).where("not f.hard_clip and not r.hard_clip")
    found = found.withColumn("l", _end("f", False, k, clips, indels, from_read, most_clipped)).withColumn("g", _end("r", True, k, clips, indels, from_read, most_clipped))
    found = found.where("not l.drop_fragment and not g.drop_fragment and (l.keep or g.keep) and l.assigned < g.assigned")
    empty = F.expr("cast(array() as array<int>)")
    of = lambda s: F.when(F.col(f"{s}.keep"), F.coalesce(F.col(f"{s}.qualities").cast("array<int>"), empty)).otherwise(empty)
    found = found.withColumn("_ql", of("l")).withColumn("_qg", of("g")).withColumn("_q", F.concat("_ql", "_qg"))
    keep = {"l": F.col("l.keep"), "g": F.col("g.keep")}
    for rule in quality:
        scope, test = quality_filter("_q", rule)
        if scope == "fragment":
            found = found.where(F.coalesce(test, F.lit(False)))
    for rule in quality:
        scope, _ = quality_filter("_q", rule)
        if scope == "end":
            for s in keep:
                passed = quality_filter(f"_q{s}", rule)[1]
                keep[s] = keep[s] & ((F.size(f"_q{s}") == 0) | passed)
    side = lambda s, name: F.struct(F.lit(name).alias("end"), F.col(f"{s}.boundary").alias("boundary"), F.col(f"{s}.bases").alias("bases"), F.col(f"{s}.checked").alias("checked"), keep[s].alias("keep"))
    ends = found.select(
        "chrom", "qname", F.col("f.pos").cast("long").alias("start_pos"), F.col("r.end_pos").cast("long").alias("end_pos"),
        F.col("l.assigned").alias("assign_start"), F.col("g.assigned").alias("assign_end"), F.explode(F.array(side("l", "left"), side("g", "right"))).alias("e"),
    )
    return ends.where("e.keep").select("chrom", "qname", "e.end", "e.boundary", "e.bases", "e.checked", "start_pos", "end_pos", "assign_start", "assign_end")


def _united(spans: Column, keep_touching: bool = False) -> Column:
    """The union of an array of (start, end)."""

    def step(s, x):
        last = F.try_element_at(s, F.lit(-1))
        meets = x["start"] < last["end"] if keep_touching else x["start"] <= last["end"]
        grown = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(s) > 0) & meets, grown).otherwise(F.concat(s, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.expr(_SPANS), step)


def segment_fragments(reads: DataFrame, least_gap: int = 1, ignore_gap: bool = False, single: bool = False) -> DataFrame:
    """Counted segments of fragments: chrom, qname, start_pos, end_pos, segment, seg_start, seg_end.

    Each mate is split at deletions and skips of at least ``least_gap`` bases; the mates' segments are united, touching ones
    as one. The gap between the mates counts, unless ``ignore_gap``. Segments are clipped to the fragment.
    """
    found = (as_mates if single else mates)(with_alignment(reads), "cigar")
    start, end = F.col("f.pos").cast("long"), F.col("r.end_pos").cast("long")
    spans = mapped_segments("f.cigar", "f.pos", least_gap)
    if not single:
        spans = F.concat(spans, mapped_segments("r.cigar", "r.pos", least_gap))
        if not ignore_gap:
            between = F.array(F.struct(F.col("f.end_pos").cast("long").alias("start"), F.col("r.pos").cast("long").alias("end")))
            spans = F.concat(spans, F.when(F.col("f.end_pos") < F.col("r.pos"), between).otherwise(F.expr(_SPANS)))
    clipped = F.transform(spans, lambda x: F.struct(F.greatest(x["start"], start).alias("start"), F.least(x["end"], end).alias("end")))
    told = found.select("chrom", "qname", start.alias("start_pos"), end.alias("end_pos"), F.posexplode(_united(F.filter(clipped, lambda x: x["start"] < x["end"]))).alias("segment", "s"))
    return told.select("chrom", "qname", "start_pos", "end_pos", "segment", F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"))


def _pieces(cigar, pos) -> Column:
    """Array of (start, end): aligned stretches without an insertion, deletion or skip in them."""
    at = col(pos).cast("long")
    ops = F.filter(cigar_ops(cigar), lambda x: x["op"].isin("M", "=", "X", "I", "D", "N"))
    start = F.struct(F.expr(_SPANS).alias("out"), F.lit(False).alias("open"))

    def step(s, x):
        a, b, out = at + x["ref"], at + x["ref"] + x["n"], s["out"]
        grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), b.alias("end"))))
        longer = F.when(s["open"], grown).otherwise(F.concat(out, F.array(F.struct(a.alias("start"), b.alias("end")))))
        aligned = x["op"].isin("M", "=", "X")
        return F.struct(F.when(aligned, longer).otherwise(out).alias("out"), aligned.alias("open"))

    return F.aggregate(ops, start, step)["out"]


def kmer_segments(reads: DataFrame, indels: str = "adjust", trim: int = 0, ignore_gap: bool = False, single: bool = False) -> DataFrame:
    """Stretches of fragments that k-mers must lie in: chrom, qname, start_pos, end_pos, segment, seg_start, seg_end.

    'ignore' takes the whole span, 'skip' drops fragments with an indel in either mate, 'adjust' cuts each mate at its
    indels and unites the mates' pieces; pieces that only touch stay apart, as an insertion lies between them. The gap between
    the mates counts, unless ``ignore_gap``. Both fragment ends lose ``trim`` bases.
    """
    if indels not in ("adjust", "ignore", "skip"):
        raise ValueError(f"unknown mode: {indels}")
    found = (as_mates if single else mates)(with_alignment(reads), "cigar", "deleted", "inserted")
    start, end = F.col("f.pos").cast("long"), F.col("r.end_pos").cast("long")
    sides = ("f",) if single else ("f", "r")
    if indels == "skip":
        found = found.where(sum((F.size(F.col(f"{s}.{k}")) for s in sides for k in ("deleted", "inserted")), F.lit(0)) == 0)
    if indels == "adjust":
        spans = F.concat(*[_pieces(f"{s}.cigar", f"{s}.pos") for s in sides])
        if not single and not ignore_gap:
            between = F.array(F.struct(F.col("f.end_pos").cast("long").alias("start"), F.col("r.pos").cast("long").alias("end")))
            spans = F.concat(spans, F.when(F.col("f.end_pos") < F.col("r.pos"), between).otherwise(F.expr(_SPANS)))
    else:
        spans = F.array(F.struct(start.alias("start"), end.alias("end")))
    clipped = F.transform(spans, lambda x: F.struct(F.greatest(x["start"], start + trim).alias("start"), F.least(x["end"], end - trim).alias("end")))
    told = found.select("chrom", "qname", start.alias("start_pos"), end.alias("end_pos"), F.posexplode(_united(F.filter(clipped, lambda x: x["start"] < x["end"]), True)).alias("segment", "s"))
    return told.select("chrom", "qname", "start_pos", "end_pos", "segment", F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"))


def mismatches(md, pos) -> Column:
    """Reference positions of the mismatches that an MD tag tells: numbers are matches, ^letters deletions, letters mismatches."""
    parts = F.regexp_extract_all(col(md), F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    start = F.struct(col(pos).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(s, x):
        deleted, number = x.startswith("^"), x.rlike(r"^\d")
        moved = F.when(number, x.try_cast("long")).when(deleted, (F.length(x) - 1).cast("long")).otherwise(F.lit(1).cast("long"))
        return F.struct((s["at"] + moved).alias("at"), F.when(number | deleted, s["out"]).otherwise(F.concat(s["out"], F.array(s["at"]))).alias("out"))

    return F.aggregate(parts, start, step)["out"]
