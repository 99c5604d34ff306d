"""Registered queries over alignments with indels and clips, each with its DuckDB twin.

The twins never parse a CIGAR: they compute from the columns that the surrogate's CIGARs are made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import alignments, reads
from .operators.alignments import Clips, Indels

_reads = lambda v: v("aln").drop("end_pos").where(reads.usable_single(5))
USED = "(select *, case when k1 in ('D', 'N') then n1 else 0 end as d1, case when k2 in ('D', 'N') then n2 else 0 end as d2 from {aln} where (flag & 1024) = 0 and mapq >= 5)"
PAIRED = f"""u as {USED}, p as (select chrom, qname, count(*) filter (not rev) as nf, count(*) filter (rev) as nr, max(pos) filter (not rev) as fp, max(end_pos) filter (not rev) as fe, max(pos) filter (rev) as rp, max(end_pos) filter (rev) as re,
  max(s1) filter (not rev) as lc, max(s2) filter (rev) as rc, bool_or(hard) as hard from u group by 1, 2 having nf = 1 and nr = 1 and fp <= rp and re > fp)"""
GAPS = """dels as (select chrom, qname, rev, pos + m1 as s, pos + m1 + n1 as e from u where k1 in ('D', 'N') union all select chrom, qname, rev, pos + m1 + d1 + m2, pos + m1 + d1 + m2 + n2 from u where k2 in ('D', 'N')),
  inss as (select chrom, qname, rev, pos + m1 as at_pos, n1 as n from u where k1 = 'I' union all select chrom, qname, rev, pos + m1 + d1 + m2, n2 from u where k2 = 'I')"""


def _within(s: str, e: str, low: str, high: str) -> str:
    return f"greatest(0, least({e}, {high}) - greatest({s}, {low}))"


LOW, HIGH = "greatest(p.fp, p.rp)", "least(p.fe, p.re)"
SHARED = f"{LOW} < {HIGH}"
COUNTED = f"""{PAIRED}, {GAPS},
  dn as (select chrom, qname, sum({_within('s', 'e', 'fp', 're')} - case when {SHARED} then {_within('s', 'e', f'greatest({LOW}, fp)', f'least({HIGH}, re)')} else 0 end) as n from dels join p using (chrom, qname) group by 1, 2),
  ds as (select a.chrom, a.qname, sum({_within('greatest(a.s, b.s)', 'least(a.e, b.e)', LOW, HIGH)}) as n from dels a join dels b on a.chrom = b.chrom and a.qname = b.qname and not a.rev and b.rev join p on p.chrom = a.chrom and p.qname = a.qname where {SHARED} group by 1, 2),
  ip as (select *, at_pos >= {LOW} and at_pos < {HIGH} as inside from inss join p using (chrom, qname) where at_pos >= fp and at_pos < re),
  i_n as (select chrom, qname, sum(n) as n from ip where not inside group by 1, 2),
  im as (select chrom, qname, rev, at_pos, max(n) as n from ip where inside group by all),
  i_s as (select a.chrom, a.qname, sum(least(a.n, b.n)) as n from im a join im b on a.chrom = b.chrom and a.qname = b.qname and a.at_pos = b.at_pos and not a.rev and b.rev group by 1, 2),
  told as (select p.*, coalesce(dn.n, 0) + coalesce(ds.n, 0) as deleted, coalesce(i_n.n, 0) + coalesce(i_s.n, 0) as inserted,
    exists (select 1 from u where u.chrom = p.chrom and u.qname = p.qname and (k1 <> '' or k2 <> '')) as has_indel
    from p left join dn using (chrom, qname) left join ds using (chrom, qname) left join i_n using (chrom, qname) left join i_s using (chrom, qname))"""
LENGTHS = {
    "adjust": ({"indels": "adjust"}, "deleted, inserted", "re - fp + inserted - deleted", "true"),
    "ignore": ({"indels": "ignore"}, "0 as deleted, 0 as inserted", "re - fp", "true"),
    "skip": ({"indels": "skip", "clips": "skip"}, "0 as deleted, 0 as inserted", "re - fp", "not has_indel and lc = 0 and rc = 0"),
    "clips": ({"indels": "adjust", "clips": "adjust", "most_clipped": 4, "most_deleted": 5}, "deleted, inserted", "re - fp + inserted - deleted + lc + rc", "lc <= 4 and rc <= 4 and deleted <= 5"),
}


def _lengths(options: dict):
    return lambda v: alignments.indel_fragments(_reads(v), **options).select("chrom", "qname", "start_pos", "end_pos", "deleted", "inserted", "assign_start", "assign_end", "size")


def _ends_sql(k: int, clips: Clips, indels: Indels, from_read: bool, most: int, quality: tuple[str, str] = ("true", "true")) -> str:
    """quality: a test of all kept ends' qualities (list q of a fragment) and one of an end's (list q)."""
    aligned = (lambda c: f"greatest(0, {k} - {c})") if clips.included else lambda c: str(k)
    shift = (lambda c: c) if clips is Clips.AT_SHIFTED else lambda c: "0"
    first_l = "0" if clips.included else "s1"
    first_r = f"read_len - {k}" if clips.included else f"read_len - s2 - {k}"
    spoils = "true" if indels is not Indels.AUTO or not from_read else "false"
    fits = (lambda first: f"({first} >= 0 and {first} + {k} <= read_len)") if from_read else lambda first: "true"
    skip = (lambda c: f"{c} > 0") if clips is Clips.SKIP else lambda c: "false"
    side = """select chrom, qname, '{name}' as "end", {clip} <= {most} as trusted, {hit} as hit, {skip} as clipped_out, {fits} as fits, {edge} as edge, {boundary} as boundary, {first} as first, seq, qual, {checked} as checked from u where {which}"""
    hit_l = f"((k1 <> '' and m1 < {aligned('s1')}) or (k2 <> '' and m1 + m2 < {aligned('s1')}))"
    hit_r = f"((k2 <> '' and m3 < {aligned('s2')}) or (k1 <> '' and m3 + m2 < {aligned('s2')}))"
    checked = (lambda c: aligned(c)) if clips is Clips.AT_ALIGNED else lambda c: str(k)
    left = side.format(name="left", clip="s1", most=most, hit=hit_l, skip=skip("s1"), fits=fits(first_l), edge="pos", boundary=f"greatest(0, pos - {shift('s1')})", first=first_l, checked=checked("s1"), which="not rev")
    right = side.format(name="right", clip="s2", most=most, hit=hit_r, skip=skip("s2"), fits=fits(first_r), edge="end_pos", boundary=f"end_pos + {shift('s2')}", first=first_r, checked=checked("s2"), which="rev")
    dropped = "trusted and hit" if indels is Indels.SKIP_FRAGMENT else "false"
    bases = f"substr(seq, cast(first + 1 as int), {k})" if from_read else "cast(null as varchar)"
    return f"""with {PAIRED}, e as ({left} union all {right}),
  x as (select e.*, p.fp, p.re, trusted and not clipped_out and not (hit and {spoils}) and fits as keep, trusted and not clipped_out and ((hit and {spoils}) or fits) as stays from e join p using (chrom, qname) where not p.hard),
  y as (select *, case when stays then boundary else edge end as assigned, case when keep and first >= 0 and first + {k} <= len(qual) then qual[cast(first + 1 as int):cast(first + {k} as int)] else [] end as q from x),
  z as (select chrom, qname, bool_or({dropped}) as gone, bool_or(keep) as any_kept, max(assigned) filter ("end" = 'left') as a, max(assigned) filter ("end" = 'right') as b, flatten(list(q)) as q from y group by 1, 2)
  select y.chrom, y.qname, "end", boundary, {bases} as bases, checked, fp as start_pos, re as end_pos, a as assign_start, b as assign_end from y join (select * exclude (q) from z where not gone and any_kept and a < b and {quality[0]}) z using (chrom, qname) where keep and (len(q) = 0 or {quality[1]})"""


ENDS = {
    "aligned": (dict(clips=Clips.ALIGNED, from_read=True), ("true", "true")),
    "skip_clipped": (dict(clips=Clips.SKIP, from_read=True), ("true", "true")),
    "at_aligned": (dict(clips=Clips.AT_ALIGNED, from_read=True, indels=Indels.SKIP_END), ("true", "true")),
    "at_shifted": (dict(clips=Clips.AT_SHIFTED, from_read=True, most_clipped=4), ("true", "true")),
    "reference": (dict(clips=Clips.ALIGNED), ("true", "true")),
    "skip_fragment": (dict(clips=Clips.AT_SHIFTED, indels=Indels.SKIP_FRAGMENT), ("true", "true")),
    "quality": (dict(clips=Clips.ALIGNED, from_read=True, quality=["mean in fragment >= 24", "min in end >= 11"]), ("list_avg(q) >= 24", "list_min(q) >= 11")),
}
K = 10
PIECES = """pieces as (select chrom, qname, pos as s, pos + m1 as e from u where k1 in ('D', 'N') and n1 >= {g} union all select chrom, qname, case when k1 in ('D', 'N') and n1 >= {g} then pos + m1 + d1 else pos end, pos + m1 + d1 + m2 from u where k2 in ('D', 'N') and n2 >= {g}
  union all select chrom, qname, case when k2 in ('D', 'N') and n2 >= {g} then end_pos - m3 when k1 in ('D', 'N') and n1 >= {g} then pos + m1 + d1 else pos end, end_pos from u{between})"""


def _segments_sql(least: int, ignore: bool) -> str:
    between = "" if ignore else " union all select chrom, qname, fe, rp from p where fe < rp"
    return f"""with {PAIRED}, {PIECES.replace('{g}', str(least)).replace('{between}', between)},
  c as (select distinct chrom, qname, fp, re, greatest(s, fp) as s, least(e, re) as e from pieces join p using (chrom, qname) where greatest(s, fp) < least(e, re)),
  i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by chrom, qname order by s, e rows unbounded preceding) as island from (
    select *, max(e) over (partition by chrom, qname order by s, e rows between unbounded preceding and 1 preceding) as reach from c))
  select chrom, qname, any_value(fp) as start_pos, any_value(re) as end_pos, cast(island - 1 as int) as segment, min(s) as seg_start, max(e) as seg_end from i group by chrom, qname, island"""


TRIM = 3
STRETCHES = """pieces as (select chrom, qname, pos as s, case when k1 <> '' then pos + m1 when k2 <> '' then pos + m1 + d1 + m2 else end_pos end as e from u
  union all select chrom, qname, pos + m1 + d1, case when k2 <> '' then pos + m1 + d1 + m2 else end_pos end from u where k1 <> ''
  union all select chrom, qname, end_pos - m3, end_pos from u where k2 <> ''{between})"""


def _stretches_sql(ignore: bool) -> str:
    between = "" if ignore else " union all select chrom, qname, fe, rp from p where fe < rp"
    return f"""with {PAIRED}, {STRETCHES.replace('{between}', between)},
  c as (select distinct chrom, qname, fp, re, greatest(s, fp + {TRIM}) as s, least(e, re - {TRIM}) as e from pieces join p using (chrom, qname) where greatest(s, fp + {TRIM}) < least(e, re - {TRIM})),
  i as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by chrom, qname order by s, e rows unbounded preceding) as island from (
    select *, max(e) over (partition by chrom, qname order by s, e rows between unbounded preceding and 1 preceding) as reach from c))
  select chrom, qname, any_value(fp) as start_pos, any_value(re) as end_pos, cast(island - 1 as int) as segment, min(s) as seg_start, max(e) as seg_end from i group by chrom, qname, island"""


def register(add) -> None:
    for name, ignore in (("aln_kmer_segments", False), ("aln_kmer_segments_ignore_gap", True)):
        add(name, lambda v, i=ignore: alignments.kmer_segments(_reads(v), "adjust", TRIM, i), _stretches_sql(ignore))
    for name, (options, counted, size, test) in LENGTHS.items():
        clip = "greatest(0, fp - lc) as assign_start, re + rc as assign_end" if options.get("clips") == "adjust" else "fp as assign_start, re as assign_end"
        add(f"aln_lengths_{name}", _lengths(options), f"with {COUNTED} select chrom, qname, fp as start_pos, re as end_pos, {counted}, {clip}, greatest({'lc + rc' if name == 'clips' else '0'}, {size}) as size from told where {test}")
    for name, (options, quality) in ENDS.items():
        told = dict(clips=Clips.ALIGNED, indels=Indels.AUTO, from_read=False, most_clipped=alignments.MOST_CLIPPED) | {k: x for k, x in options.items() if k != "quality"}
        add(
            f"aln_ends_{name}",
            lambda v, o=options: alignments.resolve_ends(_reads(v), K, **o).withColumn("checked", F.col("checked").cast("long")),
            _ends_sql(K, told["clips"], told["indels"], told["from_read"], told["most_clipped"], quality),
        )
    for name, least, ignore in (("aln_segments", 3, False), ("aln_segments_ignore_gap", 2, True)):
        add(name, lambda v, g=least, i=ignore: alignments.segment_fragments(_reads(v), g, i), _segments_sql(least, ignore))
