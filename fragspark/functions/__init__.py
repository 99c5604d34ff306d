"""Scalar functions as Spark columns: bases, midpoints, rounding, bins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a, b) -> Column:
    """Integer quotient, towards zero."""
    return F.call_function("div", col(a).cast("long"), (F.lit(b) if isinstance(b, int) else col(b)).cast("long"))


def complement(s) -> Column:
    """Complement of A, C, G, T in either case; other letters stay."""
    return F.translate(col(s), "ACGTacgt", "TGCAtgca")


def reverse_complement(s) -> Column:
    return complement(F.reverse(col(s)))


def canonical_by_centre(s, k: int) -> Column:
    """Reference k-mers: odd k takes the strand whose central base is A or C, even k the lesser strand."""
    s = col(s)
    if k % 2:
        return F.when(F.substring(s, k // 2 + 1, 1).isin("G", "T"), reverse_complement(s)).otherwise(s)
    return F.least(s, reverse_complement(s))


def canonical_lexicographic(s) -> Column:
    """Fragment k-mers: the lesser of a k-mer and its reverse complement."""
    return F.least(col(s), reverse_complement(s))


def collapse_complement(outside, inside, separator: str = "_") -> Column:
    """End motifs: the lesser of outside + inside and its plain complement, with the separator between."""
    a, b = F.concat(col(outside), col(inside)), complement(F.concat(col(outside), col(inside)))
    direct = F.concat(col(outside), F.lit(separator), col(inside))
    return F.when(a <= b, direct).otherwise(F.concat(complement(outside), F.lit(separator), complement(inside)))


def gc_percent(gc, acgt) -> Column:
    """Whole percent, halves up; null without bases."""
    gc, acgt = col(gc).cast("long"), col(acgt).cast("long")
    return F.when(acgt > 0, F.least(F.lit(100), F.call_function("div", 100 * gc + F.call_function("div", acgt, F.lit(2)), acgt)))


def midpoint(start, end, tie: Column | None = None) -> Column:
    """The central base of [start, end). Even lengths have two; the right one is taken where ``tie`` holds.

    By default the tie is settled by an arithmetic rule on start and length, so that reruns agree.
    """
    start, size = col(start), col(end) - col(start)
    tie = (start * 31 + size * 17) % 7 < 4 if tie is None else tie
    half = F.call_function("div", size.cast("long"), F.lit(2).cast("long"))
    return F.when(size % 2 == 1, start + half).otherwise(start + half - F.when(tie, 0).otherwise(1))


def round_half_up(x, decimals: int = 6) -> Column:
    """Half away from zero at so many decimals, as floor(x * f + 1/2) / f on the magnitude."""
    f = float(10**decimals)
    x = col(x)
    return F.when(x < 0, -(F.floor(-x * f + 0.5) / f)).when(F.isnan(x), x).otherwise(F.floor(x * f + 0.5) / f)


def compact_number(x, decimals: int = 6) -> Column:
    """Rounded half away from zero, as text without trailing zeros; minus zero reads 0, what is no number stays itself."""
    rounded = round_half_up(x, decimals)
    text = F.format_string(f"%.{decimals}f", rounded)
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(col(x)) | (F.abs(col(x)) == float("inf")), col(x).cast("string")).otherwise(F.when(short == "-0", "0").otherwise(short))


def steady_sum(x) -> Column:
    """The sum of doubles, whatever the order of the rows: their parts that are multiples of 2 ** -20 add up exactly, and the
    rest is too small for its errors to reach the last place."""
    x = col(x).cast("double")
    whole = F.rint(x * 1048576.0) / 1048576.0
    return F.sum(whole) + F.sum(F.when(whole == x, 0.0).otherwise(x - whole))


def ratio_or_nan(a, b) -> Column:
    """a / b as double, NaN where b is zero."""
    return F.when(col(b) == 0, F.lit(float("nan"))).otherwise(col(a).cast("double") / F.when(col(b) == 0, F.lit(1.0)).otherwise(col(b)))


def overlap_bp(a_start, a_end, b_start, b_end) -> Column:
    """Bases that two half-open intervals share; 0 if none."""
    return F.greatest(F.lit(0), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start))).cast("long")


def length_edges(spec: str) -> list[int]:
    """Edges of length bins from ``start:end:step`` or a list such as ``30 100 151``."""
    spec = spec.strip()
    if ":" in spec:
        start, end, step = map(int, spec.split(":"))
        if step <= 0 or end <= start:
            raise ValueError(f"bad length bins: {spec}")
        edges = list(range(start, end, step))
        edges.append(edges[-1] + step if edges[-1] + step < end else end)
    else:
        edges = [int(x) for x in re.split(r"[\s,]+", spec)]
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"length bin edges must rise: {spec}")
    return edges


def length_bin(size, edges: list[int]) -> Column:
    """Start of the half-open bin that holds a length, null outside all bins."""
    size = col(size)
    steps = {b - a for a, b in zip(edges, edges[1:])}
    inside = (size >= edges[0]) & (size < edges[-1])
    if len(steps) == 1:
        step = steps.pop()
        return F.when(inside, edges[0] + F.call_function("div", (size - edges[0]).cast("long"), F.lit(step).cast("long")) * step)
    out = F.lit(edges[0])
    for a in edges[1:-1]:
        out = F.when(size >= a, F.lit(a)).otherwise(out)
    return F.when(inside, out.cast("long"))


_DISTANCE = re.compile(r"^(<=|<|>=|>)?\s*(\d+)(?:\s*-\s*(\d+))?$")


def distance_label(distance, rules: list[str], other: str | None = None) -> Column:
    """The first rule that a distance meets: '<N', '<=N', 'A-B' (both included), '>=N', '>N'."""
    d, out = col(distance), None
    for rule in rules:
        m = _DISTANCE.match(rule.strip())
        if not m or (m[1] and m[3]):
            raise ValueError(f"bad distance bin: {rule}")
        n = int(m[2])
        test = {"<": d < n, "<=": d <= n, ">": d > n, ">=": d >= n}[m[1]] if m[1] else (d >= n) & (d <= int(m[3] or n))
        out = F.when(test, F.lit(rule)) if out is None else out.when(test, F.lit(rule))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


_SCORE = re.compile(r"^\s*(>=|<=|==|!=|>|<)\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*$")


def score_filter(score, rule: str, keep_missing: bool = False) -> Column:
    """Predicate from an expression such as '>= 5'; unreadable or missing scores are kept or dropped."""
    m = _SCORE.match(rule)
    if not m:
        raise ValueError(f"bad score filter: {rule}")
    x, n = col(score).try_cast("double"), float(m[2])
    test = {">=": x >= n, "<=": x <= n, "==": x == n, "!=": x != n, ">": x > n, "<": x < n}[m[1]]
    return F.coalesce(test, F.lit(keep_missing))


_QUALITY = re.compile(r"^\s*(min|mean|max)\s+in\s+(end|fragment)\s*(>=|<=|>|<)\s*(\d+(?:\.\d+)?)\s*$")


def quality_filter(qualities, rule: str) -> tuple[str, Column]:
    """(scope, predicate) of a base-quality rule such as 'mean in end >= 30' over an array column."""
    m = _QUALITY.match(rule)
    if not m:
        raise ValueError(f"bad base-quality filter: {rule}")
    q, n = col(qualities), float(m[4])
    mean = F.aggregate(q, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(q), F.lit(0))
    x = {"min": F.array_min(q).cast("double"), "max": F.array_max(q).cast("double"), "mean": mean}[m[1]]
    return m[2], {">=": x >= n, "<=": x <= n, ">": x > n, "<": x < n}[m[3]]
