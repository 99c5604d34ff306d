"""Registered queries of the fragment operators over the surrogate relations, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment_queries, surrogate
from .functions import gc_percent, length_edges, round_half_up, score_filter
from .operators import blacklist, coverage, gcbias, intervals, lengths, prepare, profiles, reads, sequence, weights, windows
from .operators.blacklist import Strategy
from .operators.selection import Bins, Output
from .operators.windows import Assigner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIZE = 5_000
EDGES = length_edges("30:401:10")
COARSE = length_edges("30 100 151 221 401")


def add(name: str, run: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(lambda view: surrogate.view(spark, sf_dir, view))
    if oracle:
        ORACLES[name] = surrogate.duck(oracle)


def r6(x: str) -> str:
    return f"floor(({x})*1e6+0.5)/1e6"


def R6(x):  # noqa: N802
    return round_half_up(x, 6)


# --- shared SQL
MERGED_BL = """select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos from (
  select *, sum(case when reach is null or start_pos > reach then 1 else 0 end) over (partition by chrom order by start_pos, end_pos rows unbounded preceding) as island from (
    select *, max(end_pos) over (partition by chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from {bl}))
  group by chrom, island"""
MID = """(start_pos + (end_pos - start_pos) // 2 - case when (end_pos - start_pos) % 2 = 0 and not ((start_pos*31 + (end_pos - start_pos)*17) % 7 < 4) then 1 else 0 end)"""
OVER = "(least(f.end_pos, w.end_pos) - greatest(f.start_pos, w.start_pos))"
MEETS = "f.chrom = w.chrom and f.start_pos < w.end_pos and w.start_pos < f.end_pos"
FSIZE = "(f.end_pos - f.start_pos)"
TESTS = {
    Assigner.ANY: f"{MEETS}", Assigner.ALL: f"f.chrom = w.chrom and w.start_pos <= f.start_pos and f.end_pos <= w.end_pos",
    Assigner.PROPORTION: f"{MEETS} and {OVER} >= 0.5 * {FSIZE}", Assigner.COUNT_OVERLAP: MEETS,
    Assigner.MIDPOINT: "f.chrom = w.chrom and f.mid >= w.start_pos and f.mid < w.end_pos",
}
FM = f"(select *, {MID} as mid from {{frag}})"
SEG = """segs as (select chrom, p as start_pos, lead(p) over (partition by chrom order by p) as end_pos, sum(d) over (partition by chrom order by p) as value
  from (select chrom, p, sum(d) as d from (select chrom, start_pos as p, {W} as d from {frag} f union all select chrom, end_pos, -({W}) from {frag} f) group by all))"""
BINS = f"""bins as (select c.chrom, i*{SIZE} as start_pos, least((i+1)*{SIZE}, chrom_len) as end_pos, off + i as window_idx from (
  select *, coalesce(sum((chrom_len + {SIZE-1}) // {SIZE}) over (order by chrom rows between unbounded preceding and 1 preceding), 0) as off from {{chroms}}) c, generate_series(0, (chrom_len + {SIZE-1}) // {SIZE} - 1) t(i))"""


def segs(weight: str = "1.0") -> str:
    return SEG.replace("{W}", weight)


# --- intervals
MERGE_SQL = """select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos from (
  select *, sum(case when reach is null or start_pos {op} reach then 1 else 0 end) over (partition by chrom order by start_pos, end_pos, window_idx rows unbounded preceding) as island from (
    select *, max(end_pos) over (partition by chrom order by start_pos, end_pos, window_idx rows between unbounded preceding and 1 preceding) as reach from {win}))
  group by chrom, island"""
for _name, _touch, _op in (("interval_merge_touching", True, ">"), ("interval_merge_keep_touching", False, ">=")):
    add(_name, lambda v, t=_touch: intervals.merge(v("win"), touching=t), MERGE_SQL.replace("{op}", _op))
add("interval_merge_blacklist", lambda v: blacklist.prepare(v("bl")), MERGED_BL)
add(
    "interval_subtract_blacklist",
    lambda v: intervals.subtract(v("win").select("chrom", "start_pos", "end_pos", "window_idx"), v("bl"), ["window_idx"]),
    f"""with m as ({MERGED_BL}), h as (select w.chrom, w.window_idx, w.start_pos as ws, w.end_pos as we, m.start_pos as ms, m.end_pos as me from {{win}} w join m on m.chrom = w.chrom and m.start_pos < w.end_pos and w.start_pos < m.end_pos),
  starts as (select chrom, window_idx, start_pos as s from {{win}} union all select chrom, window_idx, me from h),
  ends as (select chrom, window_idx, end_pos as e from {{win}} union all select chrom, window_idx, ms from h),
  s2 as (select *, row_number() over (partition by window_idx order by s) as k from starts), e2 as (select *, row_number() over (partition by window_idx order by e) as k from ends)
  select s2.chrom, s2.s as start_pos, e2.e as end_pos, s2.window_idx from s2 join e2 using (window_idx, k) where s2.s < e2.e""",
)
add(
    "interval_clip",
    lambda v: intervals.clip(v("win").select("chrom", "start_pos", "end_pos", "window_idx"), 2_000, 30_000),
    "select chrom, greatest(start_pos, 2000) as start_pos, least(end_pos, 30000) as end_pos, window_idx from {win} where greatest(start_pos, 2000) < least(end_pos, 30000)",
)

# --- assignment to windows
for _how, _name in ((Assigner.ANY, "overlap_any"), (Assigner.ALL, "overlap_all"), (Assigner.MIDPOINT, "overlap_midpoint"), (Assigner.PROPORTION, "overlap_proportion")):
    add(
        _name,
        lambda v, h=_how: windows.assign(v("frag"), v("win").select("chrom", "start_pos", "end_pos", "window_idx"), h).groupBy("window_idx").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bp")),
        f"select w.window_idx, count(*) as n, cast(sum({FSIZE}) as bigint) as bp from {FM} f join {{win}} w on {TESTS[_how]} group by w.window_idx",
    )
add(
    "overlap_count",
    lambda v: windows.assign(v("frag"), v("win").select("chrom", "start_pos", "end_pos", "window_idx")).groupBy("window_idx").agg(F.count("*").alias("n"), F.sum("overlap").alias("bp")),
    f"select w.window_idx, count(*) as n, cast(sum({OVER}) as bigint) as bp from {{frag}} f join {{win}} w on {MEETS} group by w.window_idx",
)
add("window_by_size_index", lambda v: windows.fixed_size(v("chroms"), SIZE), f"with {BINS} select chrom, start_pos, end_pos, cast(window_idx as bigint) as window_idx from bins")

# --- blacklists
BL_TESTS = {
    Strategy.ANY: "not exists (select 1 from m where m.chrom = f.chrom and m.start_pos < f.end_pos and f.start_pos < m.end_pos)",
    Strategy.ALL: "not exists (select 1 from m where m.chrom = f.chrom and m.start_pos <= f.start_pos and f.end_pos <= m.end_pos)",
    Strategy.MIDPOINT: f"not exists (select 1 from m where m.chrom = f.chrom and ((m.start_pos <= f.start_pos + ({FSIZE}-1)//2 and f.start_pos + ({FSIZE}-1)//2 < m.end_pos) or (m.start_pos <= f.start_pos + {FSIZE}//2 and f.start_pos + {FSIZE}//2 < m.end_pos)))",
    Strategy.PROPORTION: f"coalesce((select sum(least(f.end_pos, m.end_pos) - greatest(f.start_pos, m.start_pos)) from m where m.chrom = f.chrom and m.start_pos < f.end_pos and f.start_pos < m.end_pos), 0) < 0.5 * {FSIZE}",
}
for _how in Strategy:
    add(
        f"blacklist_{_how.value}",
        lambda v, h=_how: blacklist.drop(v("frag"), v("bl"), h).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("start_pos").alias("starts")),
        f"with m as ({MERGED_BL}) select chrom, count(*) as n, cast(sum(start_pos) as bigint) as starts from {{frag}} f where {BL_TESTS[_how]} group by chrom",
    )
add(
    "blacklisted_fraction",
    lambda v: windows.covered_bp(v("win").select("chrom", "start_pos", "end_pos", "window_idx"), v("bl"), ["window_idx"]).select("window_idx", R6(F.col("covered") / (F.col("end_pos") - F.col("start_pos"))).alias("blacklisted_fraction")),
    f"with m as ({MERGED_BL}) select w.window_idx, {r6('sum(case when m.chrom is null then 0 else least(w.end_pos, m.end_pos) - greatest(w.start_pos, m.start_pos) end) / (any_value(w.end_pos) - any_value(w.start_pos))')} as blacklisted_fraction from {{win}} w left join m on m.chrom = w.chrom and m.start_pos < w.end_pos and w.start_pos < m.end_pos group by w.window_idx",
)

# --- lengths
LB = "(30 + (({s}) - 30) // 10 * 10)"
SZ = "f.end_pos - f.start_pos"
CB = f"case when {SZ} < 100 then 30 when {SZ} < 151 then 100 when {SZ} < 221 then 151 else 221 end"
IN = f"{SZ} >= 30 and {SZ} < 401"


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("count", R6("count"))


add("lengths_global", lambda v: _counted(lengths.counts(v("frag"), [], EDGES)), f"select {LB.format(s=SZ)} as length_start, {r6('count(*)')} as count from {{frag}} f where {IN} group by 1")
add("lengths_bins_custom", lambda v: _counted(lengths.counts(v("frag"), ["chrom"], COARSE, F.col("gc_weight"))), f"select chrom, cast({CB} as bigint) as length_start, {r6('sum(gc_weight)')} as count from {{frag}} f where {IN} group by 1, 2")
SIZED = {
    Assigner.ANY: (f"{IN} and i between f.start_pos // {SIZE} and (f.end_pos - 1) // {SIZE}", "1.0"),
    Assigner.ALL: (f"{IN} and i = f.start_pos // {SIZE} and i = (f.end_pos - 1) // {SIZE}", "1.0"),
    Assigner.MIDPOINT: (f"{IN} and i = mid // {SIZE}", "1.0"),
    Assigner.PROPORTION: (f"{IN} and i between f.start_pos // {SIZE} and (f.end_pos - 1) // {SIZE} and least(f.end_pos, (i+1)*{SIZE}) - greatest(f.start_pos, i*{SIZE}) >= 0.5 * ({SZ})", "1.0"),
    Assigner.COUNT_OVERLAP: (f"{IN} and i between f.start_pos // {SIZE} and (f.end_pos - 1) // {SIZE}", f"(least(f.end_pos, (i+1)*{SIZE}) - greatest(f.start_pos, i*{SIZE})) / ({SZ})"),
}
for _how in Assigner:
    _test, _w = SIZED[_how]
    add(
        f"lengths_by_size_{_how.value.replace('-', '_')}",
        lambda v, h=_how: _counted(lengths.counts(windows.assign_fixed(v("frag"), SIZE, h), ["chrom", "window_start"], EDGES, lengths.count_overlap_weight() if h is Assigner.COUNT_OVERLAP else None)),
        f"select chrom, i*{SIZE} as window_start, {LB.format(s=SZ)} as length_start, {r6(f'sum({_w})')} as count from {FM} f, generate_series(0, 200) t(i) where {_test} group by 1, 2, 3",
    )
_win = lambda v: v("win").select("chrom", "start_pos", "end_pos", "window_idx", "group_name")
add(
    "lengths_bed",
    lambda v: _counted(lengths.counts(windows.assign(v("frag"), _win(v), Assigner.COUNT_OVERLAP), ["window_idx"], COARSE, lengths.count_overlap_weight())),
    f"select w.window_idx, cast({CB} as bigint) as length_start, {r6(f'sum({OVER} / {FSIZE})')} as count from {{frag}} f join {{win}} w on {MEETS} where {IN} group by 1, 2",
)
add(
    "lengths_grouped",
    lambda v: _counted(lengths.counts(windows.assign(v("frag"), _win(v), Assigner.ANY), ["group_name"], EDGES)),
    f"select w.group_name, {LB.format(s=SZ)} as length_start, {r6('count(*)')} as count from {{frag}} f join {{win}} w on {MEETS} where {IN} group by 1, 2",
)
add(
    "lengths_overlap_gc_blacklist",
    lambda v: _counted(lengths.counts(windows.assign_fixed(blacklist.drop(v("frag"), v("bl")), SIZE, Assigner.COUNT_OVERLAP), ["chrom", "window_start"], COARSE, lengths.count_overlap_weight() * F.col("gc_weight"))),
    f"with m as ({MERGED_BL}) select chrom, i*{SIZE} as window_start, cast({CB} as bigint) as length_start, {r6(f'sum((least(f.end_pos, (i+1)*{SIZE}) - greatest(f.start_pos, i*{SIZE})) / ({SZ}) * gc_weight)')} as count from {{frag}} f, generate_series(0, 200) t(i) where {SIZED[Assigner.ANY][0]} and {BL_TESTS[Strategy.ANY]} group by 1, 2, 3",
)
add(
    "lengths_short_long_ratio",
    lambda v: (lambda r: r.select("chrom", "window_start", R6("short").alias("short"), R6("long").alias("long"), R6("ratio").alias("ratio")))(lengths.short_long_ratio(lengths.counts(windows.assign_fixed(v("frag"), SIZE), ["chrom", "window_start"], COARSE), ["chrom", "window_start"], (100, 151), (151, 221))),
    f"""select chrom, i*{SIZE} as window_start, {r6(f'count(*) filter ({SZ} >= 100 and {SZ} < 151)')} as short, {r6(f'count(*) filter ({SZ} >= 151 and {SZ} < 221)')} as long,
  case when count(*) filter ({SZ} >= 151 and {SZ} < 221) = 0 then cast('NaN' as double) else {r6(f'count(*) filter ({SZ} >= 100 and {SZ} < 151) / count(*) filter ({SZ} >= 151 and {SZ} < 221)')} end as ratio
  from {{frag}} f, generate_series(0, 200) t(i) where {SIZED[Assigner.ANY][0]} group by 1, 2""",
)
add(
    "lengths_wide",
    lambda v: lengths.wide(lengths.counts(v("frag"), ["chrom"], COARSE), ["chrom"], COARSE),
    f"select chrom, count(*) filter ({SZ} < 100)::double as count_30_100, count(*) filter ({SZ} >= 100 and {SZ} < 151)::double as count_100_151, count(*) filter ({SZ} >= 151 and {SZ} < 221)::double as count_151_221, count(*) filter ({SZ} >= 221 and {SZ} < 401)::double as count_221_401 from {{frag}} f group by chrom",
)

# --- coverage
RUNS = """runs as (select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos, value from (
  select *, sum(case when value = before and start_pos = stop then 0 else 1 end) over (partition by chrom order by start_pos) as island from (
    select *, lag(value) over (partition by chrom order by start_pos) as before, lag(end_pos) over (partition by chrom order by start_pos) as stop from rounded)) group by chrom, island, value)"""
add(
    "cov_segments",
    lambda v: coverage.runs(coverage.segments(v("frag"), tile=20_000), 2),
    f"with {segs()}, rounded as (select chrom, start_pos, end_pos, floor(value*100+0.5)/100 as value from segs where value > 0), {RUNS} select chrom, start_pos, end_pos, value from runs",
)
add(
    "cov_runs_indexed",
    lambda v: coverage.in_windows(coverage.runs(coverage.segments(v("frag"), F.col("gc_weight")), 2), _win(v), ["chrom", "window_idx"]),
    f"with {segs('gc_weight')}, rounded as (select chrom, start_pos, end_pos, floor(value*100+0.5)/100 as value from segs where value > 1e-9), {RUNS} select f.chrom, w.window_idx, greatest(f.start_pos, w.start_pos) as start_pos, least(f.end_pos, w.end_pos) as end_pos, value from runs f join {{win}} w on {MEETS}",
)


def _cov(windows_sql: str, keys: str, weight: str = "1.0", mask: bool = True, select: str = "", extra: str = "") -> str:
    """Aggregates per key over segments cut by masks, all in integers of covered bases times values."""
    m = f"m as ({MERGED_BL}), " if mask else ""
    cut = (
        """cuts as (select chrom, p from (select chrom, start_pos as p from segs union select chrom, end_pos from segs union select chrom, start_pos from m union select chrom, end_pos from m) where p is not null),
  pieces as (select chrom, p as start_pos, lead(p) over (partition by chrom order by p) as end_pos from cuts),
  free as (select p.chrom, p.start_pos, p.end_pos, s.value from pieces p join segs s on s.chrom = p.chrom and s.start_pos <= p.start_pos and p.end_pos <= s.end_pos
    where s.value > 1e-9 and not exists (select 1 from m where m.chrom = p.chrom and m.start_pos <= p.start_pos and p.end_pos <= m.end_pos)), """
        if mask
        else "free as (select * from segs where value > 1e-9), "
    )
    black = f"black as (select {keys}, cast(sum(least(w.end_pos, m.end_pos) - greatest(w.start_pos, m.start_pos)) as bigint) as blacklisted from wins w join m on m.chrom = w.chrom and m.start_pos < w.end_pos and w.start_pos < m.end_pos group by all)," if mask else f"black as (select {keys}, 0 as blacklisted from wins where false group by all),"
    return f"""with {extra} {segs(weight)}, {m} {cut} wins as ({windows_sql}),
  got as (select {keys}, sum(value * {OVER}) as total, sum(value * value * {OVER}) as total_squared, cast(sum({OVER}) as bigint) as nonzero from free f join wins w on {MEETS} group by all),
  span as (select {keys}, cast(sum(end_pos - start_pos) as bigint) as span from wins group by all), {black}
  told as (select {keys}, span, coalesce(blacklisted, 0) as blacklisted, span - coalesce(blacklisted, 0) as eligible, coalesce(nonzero, 0) as nonzero, coalesce(total, 0) as total, coalesce(total_squared, 0) as total_squared from span left join got using ({keys}) left join black using ({keys}))
  select {select} from told"""


AVERAGE_SQL = "case when eligible = 0 then cast('NaN' as double) else floor(total / eligible * 1e6 + 0.5) / 1e6 end as average"


def _avg(df: DataFrame) -> DataFrame:
    return df.withColumn("average", F.when(F.col("eligible") == 0, F.lit(float("nan"))).otherwise(R6(F.col("total") / F.when(F.col("eligible") == 0, 1).otherwise(F.col("eligible")))))


WIN_SQL = "select chrom, start_pos, end_pos, window_idx, group_name from {win}"
add(
    "cov_avg_size",
    lambda v: _avg(coverage.sums(coverage.segments(v("frag")), windows.fixed_size(v("chroms"), SIZE), ["window_idx"], v("bl"))).select("window_idx", "blacklisted", "average"),
    _cov("select * from bins", "window_idx", select=f"cast(window_idx as bigint) as window_idx, blacklisted, {AVERAGE_SQL}", extra=BINS + ","),
)
add(
    "cov_total_bed",
    lambda v: coverage.sums(coverage.segments(v("frag"), F.col("gc_weight")), _win(v), ["window_idx"], v("bl")).select("window_idx", R6("total").alias("total"), "blacklisted"),
    _cov(WIN_SQL, "window_idx", "gc_weight", select=f"window_idx, {r6('total')} as total, blacklisted"),
)
_NAN = "cast('NaN' as double)"
SUMMARY_SQL = f"""span, blacklisted, eligible, nonzero, {r6('total')} as total, {r6('total_squared')} as total_squared,
  case when eligible = 0 then {_NAN} else {r6('nonzero / eligible')} end as covered_fraction, {AVERAGE_SQL},
  case when eligible = 0 then {_NAN} else {r6('greatest(0, total_squared / eligible - (total / eligible) * (total / eligible))')} end as variance,
  case when eligible = 0 then {_NAN} else {r6('sqrt(greatest(0, total_squared / eligible - (total / eligible) * (total / eligible)))')} end as sd,
  case when eligible = 0 or abs(total / eligible) <= 4.440892098500626e-16 then {_NAN} else {r6('sqrt(greatest(0, total_squared / eligible - (total / eligible) * (total / eligible))) / (total / eligible)')} end as cv"""


def _summary(df: DataFrame, keys: list[str]) -> DataFrame:
    s = coverage.summary(df)
    return s.select(*keys, "span", "blacklisted", "eligible", "nonzero", *[R6(c).alias(c) for c in ("total", "total_squared", "covered_fraction", "average", "variance", "sd", "cv")])


add(
    "cov_summary_bed",
    lambda v: _summary(coverage.sums(coverage.segments(v("frag")), _win(v), ["window_idx"], v("bl")), ["window_idx"]),
    _cov(WIN_SQL, "window_idx", select=f"window_idx, {SUMMARY_SQL}"),
)
add(
    "cov_summary_grouped",
    lambda v: _summary(coverage.sums(coverage.segments(v("frag")), _win(v), ["group_name"], v("bl")), ["group_name"]),
    _cov(WIN_SQL, "group_name", select=f"group_name, {SUMMARY_SQL}"),
)
UNIQUE_SQL = """select chrom, group_name, min(start_pos) as start_pos, max(end_pos) as end_pos from (
  select *, sum(case when reach is null or start_pos > reach then 1 else 0 end) over (partition by chrom, group_name order by start_pos, end_pos, window_idx rows unbounded preceding) as island from (
    select *, max(end_pos) over (partition by chrom, group_name order by start_pos, end_pos, window_idx rows between unbounded preceding and 1 preceding) as reach from {win})) group by chrom, group_name, island"""
add(
    "cov_unique_bases",
    lambda v: _summary(coverage.sums(coverage.segments(v("frag")), coverage.merged_groups(v("win")), ["group_name"], v("bl")), ["group_name"]),
    _cov(UNIQUE_SQL, "group_name", select=f"group_name, {SUMMARY_SQL}"),
)
add(
    "cov_unit_mass",
    lambda v: coverage.sums(coverage.segments(v("frag"), coverage.unit_mass(F.col("end_pos") - F.col("start_pos"))), windows.fixed_size(v("chroms"), SIZE), ["window_idx"]).select("window_idx", round_half_up("total", 4).alias("total")),
    _cov("select * from bins", "window_idx", "1.0/(end_pos - start_pos)", mask=False, select="cast(window_idx as bigint) as window_idx, floor(total*1e4+0.5)/1e4 as total", extra=BINS + ","),
)
add(
    "cov_restore_mean",
    lambda v: coverage.sums(coverage.segments(v("frag"), coverage.unit_mass(F.col("end_pos") - F.col("start_pos"))), _win(v), ["group_name"])
    .crossJoin(F.broadcast(v("frag").agg(F.avg(F.col("end_pos") - F.col("start_pos")).alias("m"))))
    .select("group_name", round_half_up(F.col("total") * F.col("m"), 3).alias("total")),
    _cov(WIN_SQL, "group_name", "1.0/(end_pos - start_pos)", mask=False, select="group_name, floor(total * (select avg(end_pos - start_pos) from {frag}) * 1e3 + 0.5) / 1e3 as total"),
)

# --- scaling
STRIDE, WIDE = 2_000, 10_000


def _factors(v, unit: bool) -> DataFrame:
    return weights.scaling_factors(v("frag"), v("chroms"), STRIDE, WIDE, v("bl"), unit)


def _weights_sql(unit: bool) -> str:
    bins = BINS.replace(str(SIZE - 1), str(STRIDE - 1)).replace(f"*{SIZE}", f"*{STRIDE}").replace(f"// {SIZE}", f"// {STRIDE}")
    value = "total" if unit else "total / eligible"
    inner = _cov("select * from bins", "window_idx", "1.0/(end_pos - start_pos)" if unit else "1.0", select="*", extra=bins + ",")
    return f"""with told as ({inner}), bb as (with {bins} select * from bins),
  t as (select bb.*, eligible, eligible / span as support, case when eligible > 0 then {value} end as v from told join bb using (window_idx)),
  s as (select a.chrom, a.start_pos, a.end_pos, a.window_idx, a.eligible, sum((5 - abs(a.window_idx - b.window_idx)) * b.support * b.v) / nullif(sum((5 - abs(a.window_idx - b.window_idx)) * b.support), 0) as smoothed
    from t a join t b on a.chrom = b.chrom and abs(a.window_idx - b.window_idx) <= 4 and b.v is not null and b.support > 0 group by all),
  g as (select sum(smoothed * eligible) / sum(eligible) as mean from s where smoothed > 0)
  select chrom, start_pos, end_pos, {r6('smoothed')} as smoothed, case when smoothed > 0 then {r6('(select mean from g) / smoothed')} else 0 end as scaling_factor from s"""


for _name, _unit in (("weights_coverage", False), ("weights_fragment_count", True)):
    add(_name, lambda v, u=_unit: _factors(v, u).select("chrom", "start_pos", "end_pos", R6("smoothed").alias("smoothed"), R6("scaling_factor").alias("scaling_factor")), _weights_sql(_unit))
FAKE = f"(select chrom, i*{STRIDE} as start_pos, (i+1)*{STRIDE} as end_pos, 0.5 + (i % 7) * 0.25 as factor from {{chroms}}, generate_series(0, (chrom_len - 1) // {STRIDE}) t(i))"


def _fake_bins(v) -> DataFrame:
    b = windows.fixed_size(v("chroms"), STRIDE)
    return b.select("chrom", "start_pos", (F.col("start_pos") + STRIDE).alias("end_pos"), (0.5 + (F.floor(F.col("start_pos") / STRIDE) % 7) * 0.25).alias("factor"))


add(
    "lengths_scaled",
    lambda v: _counted(lengths.counts(weights.average_factor(v("frag"), _fake_bins(v), []), ["chrom"], COARSE, F.col("factor"))),
    f"select chrom, length_start, {r6('sum(factor)')} as count from (select f.chrom, cast({CB} as bigint) as length_start, f.start_pos, f.end_pos, mapq, strand, gc_weight, rn, sum({OVER} * w.factor) / sum({OVER}) as factor from (select *, row_number() over () as rn from {{frag}}) f join {FAKE} w on {MEETS} where {IN} group by all) group by all",
)
add(
    "lengths_scaled_overlap",
    lambda v: _counted(lengths.counts(weights.overlap_factor(windows.assign(v("frag"), _win(v), Assigner.COUNT_OVERLAP), _fake_bins(v)), ["group_name"], COARSE, lengths.count_overlap_weight() * F.col("factor"))),
    f"""select group_name, length_start, {r6('sum(share * factor)')} as count from (
  select group_name, cast({CB.replace('f.end_pos - f.start_pos', 'f.size')} as bigint) as length_start, any_value((f.end_pos - f.start_pos) / f.size) as share, sum({OVER} * w.factor) / sum({OVER}) as factor from (
    select f.chrom, greatest(f.start_pos, w.start_pos) as start_pos, least(f.end_pos, w.end_pos) as end_pos, f.end_pos - f.start_pos as size, w.group_name, row_number() over () as rn from {{frag}} f join {{win}} w on {MEETS} where {IN}) f join {FAKE} w on {MEETS} group by rn, group_name, length_start) group by 1, 2""",
)
add(
    "cov_scaled",
    lambda v: coverage.sums(coverage.scaled(coverage.segments(v("frag")), _fake_bins(v)), _win(v), ["group_name"]).select("group_name", R6("total").alias("total")),
    f"with {segs()}, sc as (select f.chrom, greatest(f.start_pos, w.start_pos) as start_pos, least(f.end_pos, w.end_pos) as end_pos, f.value * w.factor as value from segs f join {FAKE} w on {MEETS} where f.value > 0) select w.group_name, {r6(f'sum(value * {OVER})')} as total from sc f join {{win}} w on {MEETS} group by 1",
)

# --- midpoint profiles
MIDS = f"from {FM} f join {{site}} w on f.chrom = w.chrom and f.mid >= w.start_pos and f.mid < w.end_pos where {IN}"
add(
    "mid_profile",
    lambda v: _counted(profiles.midpoint_profile(v("frag"), v("site").drop("strand"), COARSE)),
    f"select w.group_name, cast({CB} as bigint) as length_start, f.mid - w.start_pos as position, {r6('count(*)')} as count {MIDS} group by 1, 2, 3",
)
PLACE = "case when w.strand = '-' then w.end_pos - 1 - f.mid else f.mid - w.start_pos end"
add(
    "mid_profile_stranded",
    lambda v: _counted(profiles.midpoint_profile(v("frag"), v("site"), COARSE, F.col("gc_weight"))),
    f"select w.group_name, cast({CB} as bigint) as length_start, {PLACE} as position, {r6('sum(gc_weight)')} as count {MIDS} group by 1, 2, 3",
)
add(
    "mid_binned",
    lambda v: _counted(profiles.binned_profile(profiles.midpoint_profile(v("frag"), v("site"), COARSE), ["group_name", "length_start"], 10, 201)),
    f"select group_name, length_start, p // 10 as bin, {r6('count(*) / least(10, 201 - p // 10 * 10)')} as count from (select w.group_name, cast({CB} as bigint) as length_start, {PLACE} as p {MIDS}) group by group_name, length_start, p // 10",
)
_SG = ", ".join(f"({x - 5}, {c!r})" for x, c in enumerate(profiles.savgol_coefficients(11)))
add(
    "mid_savgol",
    lambda v: profiles.savgol(profiles.midpoint_profile(v("frag"), v("site"), COARSE), ["group_name", "length_start"], 11).where("position between 5 and 195").select("group_name", "length_start", "position", round_half_up("count", 4).alias("count")),
    f"with p as (select w.group_name, cast({CB} as bigint) as length_start, {PLACE} as position, count(*) as n {MIDS} group by 1, 2, 3), k(x, c) as (values {_SG}) select group_name, length_start, position - x as position, case when sum(n*c) < 0 then -floor(-sum(n*c)*1e4+0.5)/1e4 else floor(sum(n*c)*1e4+0.5)/1e4 end as count from p, k where position - x between 5 and 195 group by 1, 2, position - x",
)

# --- sequence
_chunks = lambda v, over: v(f"chunks:512:{over}")
K = 3
KM = "(select doc_id, pos, base || lead(base, 1) over w || lead(base, 2) over w as kmer from {seq} window w as (partition by doc_id order by pos))"
KOK = "kmer is not null and not contains(kmer, 'N')"


def RC(x: str) -> str:  # noqa: N802
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


_tallied = lambda v, *keys, **o: sequence.tallied(_chunks(v, K - 1).withColumn("contig_group", F.expr("cast(substr(chrom, 2) as bigint) % 5")), K, 512, list(keys), **o)
_counts = lambda v, keys, *more, **o: sequence.kmer_counts(_tallied(v, *[k for k in keys if k != "window_start"], **o), keys, *more, weight=F.col("weight"))
_w6 = lambda df, *more: df.select(*more, R6("weight").alias("weight"))
add("kmer_forward", lambda v: _w6(_counts(v, [], "forward"), "kmer"), f"select kmer, {r6('count(*)')} as weight from {KM} where {KOK} group by 1")
BOTH = f"(select doc_id, pos, kmer, 0.5 as w from {KM} where {KOK} union all select doc_id, pos, {RC('kmer')}, 0.5 from {KM} where {KOK})"
add("kmer_both", lambda v: _w6(_counts(v, []), "kmer"), f"select kmer, {r6('sum(w)')} as weight from {BOTH} group by 1")
CAN = f"case when substr(kmer, 2, 1) in ('G', 'T') then {RC('kmer')} else kmer end"
add("kmer_canonical", lambda v: _w6(_counts(v, [], "both", True, K), "kmer"), f"select {CAN} as kmer, {r6('sum(w)')} as weight from {BOTH} group by 1")
add(
    "kmer_grouped",
    lambda v: sequence.frequencies(_counts(v, ["contig_group"]), ["contig_group"]).select("contig_group", "kmer", R6("frequency").alias("frequency"), R6("row_scaling_factor").alias("row_scaling_factor")),
    f"select contig_group, kmer, {r6('w / sum(w) over (partition by contig_group)')} as frequency, {r6('sum(w) over (partition by contig_group)')} as row_scaling_factor from (select doc_id % 5 as contig_group, kmer, sum(w) as w from {BOTH} group by 1, 2)",
)
WIN_KMERS = "(select k.doc_id, k.pos, k.kmer, w.window_name, w.start_pos, w.end_pos, least(k.pos + 3, w.end_pos) - greatest(k.pos, w.start_pos) as ov from " + KM + " k join {docwin} w on w.doc_id = k.doc_id and k.pos < w.end_pos and w.start_pos < k.pos + 3 where " + KOK + ")"
_docwindows = lambda v: v("docwin").select(F.concat(F.lit("d"), F.col("doc_id")).alias("chrom"), "start_pos", "end_pos", "window_name")
add(
    "kmer_bed_overlap",
    lambda v: _w6(_counts(v, ["window_name"], "both", targets=_docwindows(v)), "window_name", "kmer"),
    f"select window_name, kmer, {r6('sum(w)')} as weight from (select window_name, kmer, ov / 6 as w from {WIN_KMERS} union all select window_name, {RC('kmer')}, ov / 6 from {WIN_KMERS}) group by 1, 2",
)
add(
    "kmer_bed_all",
    lambda v: _w6(_counts(v, ["window_name"], "forward", targets=_docwindows(v), how=Assigner.ALL), "window_name", "kmer"),
    f"select window_name, kmer, {r6('count(*)')} as weight from {WIN_KMERS} where ov = 3 group by 1, 2",
)
add(
    "kmer_by_size",
    lambda v: _w6(_counts(v, ["window_start"], "forward", bins=1_000), "window_start", "kmer"),
    f"select i * 1000 as window_start, kmer, {r6('sum(least(pos + 3, i * 1000 + 1000) - greatest(pos, i * 1000)) / 3')} as weight from (select pos, kmer, unnest(range(pos // 1000, (pos + 2) // 1000 + 1)) as i from {KM} where {KOK}) group by 1, 2",
)
MOTIFS = [("ACG", "x"), ("CGT", "x"), ("TTT", "y"), ("GGG", "z")]
add(
    "kmer_selected",
    lambda v: (lambda c: _w6(sequence.selected(c, c.sparkSession.createDataFrame(MOTIFS, "motif string, motif_group string")), "motif_group"))(_counts(v, [], "forward")),
    f"select g as motif_group, {r6('count(*)')} as weight from {KM} join (values {', '.join(map(str, MOTIFS))}) t(m, g) on kmer = m where {KOK} group by 1",
)
_sf = lambda v: v("seqfrag").select(F.concat(F.lit("d"), F.col("doc_id")).alias("chrom"), "doc_id", "start_pos", "end_pos")
ENDS = """(select f.doc_id, f.start_pos, f.end_pos, f.end_pos - f.start_pos as size, s.e as "end", case when s.e = 'left' then lo.m else {rc} end as m from {seqfrag} f, (values ('left'), ('right')) s(e)
  join {src} lo on lo.doc_id = f.doc_id and lo.pos = case when s.e = 'left' then f.start_pos - {o} else f.end_pos - {i} end where lo.m is not null and not contains(lo.m, 'N'))"""


def _words(k: int) -> str:
    return "(select doc_id, pos, base" + "".join(f" || lead(base, {j}) over w" for j in range(1, k)) + " as m from {seq} window w as (partition by doc_id order by pos))"


def _offsets(last: int) -> str:
    return f"(select *, start_pos + o as place from (select *, unnest(generate_series(0, {last})) as o from {{seqfrag}}))"


def _ends_sql(i: int, o: int) -> str:
    return ENDS.replace("{src}", _words(i + o)).replace("{rc}", RC("lo.m")).replace("{o}", str(o)).replace("{i}", str(i))


_ends = lambda v, i, o, c=False: sequence.end_motifs(_sf(v), _chunks(v, 220), i, o, c, 512)
add("ends_inside", lambda v: _ends(v, 3, 0).groupBy("end", "motif").agg(F.count("*").alias("n")), f"""select "end", '_' || m as motif, count(*) as n from {_ends_sql(3, 0)} group by 1, 2""")
add("ends_two_sided", lambda v: _ends(v, 2, 1).groupBy("motif").agg(F.count("*").alias("n")), f"select substr(m, 1, 1) || '_' || substr(m, 2) as motif, count(*) as n from {_ends_sql(2, 1)} group by 1")
COMP = "translate(m, 'ACGT', 'TGCA')"
add(
    "ends_collapsed",
    lambda v: _ends(v, 2, 1, True).groupBy("motif").agg(F.count("*").alias("n")),
    f"select substr(c, 1, 1) || '_' || substr(c, 2) as motif, count(*) as n from (select least(m, {COMP}) as c from {_ends_sql(2, 1)}) group by 1",
)
add(
    "ends_endpoint_bed",
    lambda v: _ends(v, 2, 0).withColumn("place", F.when(F.col("end") == "left", F.col("boundary")).otherwise(F.col("boundary") - 1)).groupBy("chrom", F.floor(F.col("place") / 500).alias("window"), "motif").agg(F.count("*").alias("n")),
    f"""select 'd' || doc_id as chrom, (case when "end" = 'left' then start_pos else end_pos - 1 end) // 500 as "window", '_' || m as motif, count(*) as n from {_ends_sql(2, 0)} group by 1, 2, 3""",
)
ALL2 = "(select a || b as kmer from (values ('A'),('C'),('G'),('T')) x(a), (values ('A'),('C'),('G'),('T')) y(b))"
add(
    "ends_all_motifs",
    lambda v: (lambda e: sequence.zero_filled(e.withColumn("kmer", F.substring("motif", 2, 2)).groupBy("end", "kmer").agg(F.count("*").cast("double").alias("n")), e.select("end"), sequence.all_motifs(e.sparkSession, 2), ["end"], "kmer", "n"))(_ends(v, 2, 0)),
    f"""select e as "end", kmer, count(m)::double as n from (values ('left'), ('right')) t(e), {ALL2} k left join {_ends_sql(2, 0)} x on x."end" = e and x.m = kmer group by 1, 2""",
)
add(
    "ends_motif_groups",
    lambda v: (lambda e: sequence.selected(e.withColumn("kmer", F.substring("motif", 2, 3)).groupBy("kmer").agg(F.count("*").alias("n")), e.sparkSession.createDataFrame(MOTIFS, "motif string, motif_group string"), weight="n"))(_ends(v, 3, 0)),
    f"select g as motif_group, cast(count(*) as bigint) as n from {_ends_sql(3, 0)} join (values {', '.join(map(str, MOTIFS))}) t(mm, g) on m = mm group by 1",
)

# --- reference correction: counts of 1 + 2 base end motifs by 3-mer frequencies, global reference or by contig group
_counts12 = lambda v: _ends(v, 2, 1).select((F.col("doc_id") % 5).alias("g"), F.substring("motif", 1, 1).alias("outside"), F.substring("motif", 3, 2).alias("inside")).groupBy("g", "outside", "inside").agg(F.count("*").cast("double").alias("count"))
_ref = lambda v: sequence.frequencies(_counts(v, ["contig_group"]).withColumnRenamed("contig_group", "g"), ["g"]).select("g", "kmer", "frequency")
_ref_all = lambda v: sequence.frequencies(_counts(v, []), []).select("kmer", "frequency")
CNT = f"cnt as (select doc_id % 5 as g, substr(m, 1, 1) as outside, substr(m, 2) as inside, count(*)::double as n from {_ends_sql(2, 1)} group by 1, 2, 3)"
REF = f"ref as (select g, kmer, w / sum(w) over (partition by g) as f from (select doc_id % 5 as g, kmer, sum(w) as w from {BOTH} group by 1, 2))"
REFALL = f"ref as (select kmer, w / sum(w) over () as f from (select kmer, sum(w) as w from {BOTH} group by 1))"
_c4 = lambda df, *keys: df.select(*keys, round_half_up("corrected", 4).alias("corrected"))


def r4(x: str) -> str:
    return f"floor(({x})*1e4+0.5)/1e4"


add("corr_joint", lambda v: _c4(sequence.correct(_counts12(v), _ref(v), ["g"]), "g", "outside", "inside"), f"with {CNT}, {REF}, r as (select *, count(*) filter (f > 0) over (partition by g) as s from ref) select g, outside, inside, {r4('n / (f * s)')} as corrected from cnt join r using (g) where kmer = outside || inside")
add("corr_global_bias", lambda v: _c4(sequence.correct(_counts12(v), _ref_all(v), ["g"], use_global=True), "g", "outside", "inside"), f"with {CNT}, {REFALL}, r as (select *, count(*) filter (f > 0) over () as s from ref) select g, outside, inside, {r4('n / (f * s)')} as corrected from cnt join r on kmer = outside || inside")
MARG = "mo as (select g, substr(kmer, 1, 1) as outside, sum(f) as fo from ref group by 1, 2), mi as (select g, substr(kmer, 2) as inside, sum(f) as fi from ref group by 1, 2), so as (select *, count(*) filter (fo > 0) over (partition by g) as co from mo), si as (select *, count(*) filter (fi > 0) over (partition by g) as ci from mi)"
add("corr_split", lambda v: _c4(sequence.correct(_counts12(v), _ref(v), ["g"], "split"), "g", "outside", "inside"), f"with {CNT}, {REF}, {MARG} select g, outside, inside, {r4('n / (fo * co * fi * ci)')} as corrected from cnt join so using (g, outside) join si using (g, inside)")
add("corr_outside", lambda v: _c4(sequence.correct(_counts12(v), _ref(v), ["g"], "outside"), "g", "outside"), f"with {CNT}, {REF}, {MARG} select g, outside, {r4('sum(n) / any_value(fo * co)')} as corrected from cnt join so using (g, outside) group by 1, 2")
# three places, as at sf0.001 one value lies on the edge of the fourth (138.14375)
add("corr_inside", lambda v: sequence.correct(_counts12(v), _ref(v), ["g"], "inside").select("g", "inside", round_half_up("corrected", 3).alias("corrected")), f"with {CNT}, {REF}, {MARG} select g, inside, floor(sum(n) / any_value(fi * ci) * 1e3 + 0.5) / 1e3 as corrected from cnt join si using (g, inside) group by 1, 2")

# --- fragment k-mers and transitions
_positions = lambda v, **o: sequence.position_table(v("frag").sparkSession, (30, 149), 3, **o)
add(
    "fkmer_left",
    lambda v: sequence.fragments_tallied(_sf(v), _chunks(v, 220), _positions(v, frame="left", last=10), 3, 512).groupBy("offset", "kmer").agg(F.sum("n").alias("n")),
    f'select o as "offset", m as kmer, count(*) as n from {_offsets(10)} f join {_words(3)} s on s.doc_id = f.doc_id and s.pos = f.place where m is not null and not contains(m, \'N\') group by 1, 2',
)
add(
    "fkmer_nearest",
    lambda v: sequence.fragments_tallied(_sf(v), _chunks(v, 220), _positions(v, frame="nearest", last=10), 3, 512).groupBy("kmer").agg(F.sum("n").alias("n")),
    f"""select case when rev then {RC('m')} else m end as kmer, count(*) as n from (
  select doc_id, rev, case when rev then end_pos - 3 - o else start_pos + o end as place from {_offsets(10)} f, (values (false), (true)) r(rev)
  where 2*o + 3 <= end_pos - start_pos and not (rev and end_pos - start_pos - 3 - o = o)) f join {_words(3)} s on s.doc_id = f.doc_id and s.pos = f.place where m is not null and not contains(m, 'N') group by 1""",
)
add(
    "trans_order2",
    lambda v: sequence.transitions(sequence.fragments_tallied(_sf(v), _chunks(v, 220), _positions(v, frame="left", last=5), 3, 512).groupBy("offset", "kmer").agg(F.sum("n").cast("double").alias("weight")), ["offset"], 2).select("offset", "prefix", "next_base", R6("probability").alias("probability")),
    f'select o as "offset", substr(m, 1, 2) as prefix, substr(m, 3) as next_base, {r6("n / sum(n) over (partition by o, substr(m, 1, 2))")} as probability from (select o, m, count(*) as n from {_offsets(5)} f join {_words(3)} s on s.doc_id = f.doc_id and s.pos = f.place where m is not null and not contains(m, \'N\') group by 1, 2)',
)

# --- protection scores
WPS_EVENTS = """(select chrom, greatest(0, a) as p, d from (select chrom, unnest([start_pos + 60, start_pos - 59, end_pos - 59]) as a, unnest([end_pos - 59, start_pos + 60, end_pos + 59]) as b, unnest([1, -1, -1]) as d from {frag} where end_pos - start_pos between 120 and 180) where b > greatest(0, a)
  union all select chrom, b, -d from (select chrom, unnest([start_pos + 60, start_pos - 59, end_pos - 59]) as a, unnest([end_pos - 59, start_pos + 60, end_pos + 59]) as b, unnest([1, -1, -1]) as d from {frag} where end_pos - start_pos between 120 and 180) where b > greatest(0, a))"""
WPS = f"segs as (select chrom, p as start_pos, lead(p) over (partition by chrom order by p) as end_pos, cast(sum(d) over (partition by chrom order by p) as double) as value from (select chrom, p, sum(d) as d from {WPS_EVENTS} group by 1, 2))"
add(
    "wps_segments",
    lambda v: intervals.merge(profiles.protection_score(v("frag"), tile=20_000), ["chrom", "value"]).select("chrom", "start_pos", "end_pos", "value"),
    f"with {WPS}, rounded as (select * from segs where value <> 0 and end_pos is not null), {RUNS} select chrom, start_pos, end_pos, value from runs",
)
add(
    "wps_window_avg",
    lambda v: _avg(coverage.sums(profiles.protection_score(v("frag")), _win(v), ["window_idx"])).select("window_idx", "average"),
    f"with {WPS} select w.window_idx, case when coalesce(sum(value * {OVER}), 0) < 0 then -floor(-coalesce(sum(value * {OVER}), 0) / any_value(w.end_pos - w.start_pos) * 1e6 + 0.5) / 1e6 else floor(coalesce(sum(value * {OVER}), 0) / any_value(w.end_pos - w.start_pos) * 1e6 + 0.5) / 1e6 end as average from {{win}} w left join segs f on {MEETS} group by 1",
)
_peaks = lambda v: profiles.peaks(profiles.protection_score(v("frag")), 100_000, 1.0)
_C21 = ", ".join(f"({x - 10}, {c!r})" for x, c in enumerate(profiles.savgol_coefficients(21)))
#: Peaks a base at a time: smoothed with mirrored ends, less the running median, runs above zero with gaps of up to 5 closed.
PEAKS = f"""{WPS}, ends as (select chrom, max(end_pos) as last from segs where end_pos is not null group by 1),
  raw as materialized (select b.chrom, p, coalesce(s.value, 0) as x from (select chrom, unnest(range(0, last + 2000)) as p from ends) b asof left join segs s on s.chrom = b.chrom and s.start_pos <= b.p),
  coef(j, c) as (values {_C21}),
  mirrored as (select chrom, p, sum(y) as y from (select chrom, p - j as p, c * x as y from raw, coef union all select chrom, -(p) - j, c * x from raw, coef where p between 1 and 10) where p >= 0 group by 1, 2),
  normal as materialized (select m.chrom, m.p, round(y - median(y) over (partition by m.chrom order by m.p rows between 500 preceding and 500 following), 9) as v from mirrored m),
  above as (select chrom, p, lag(p) over (partition by chrom order by p) as before from normal where v > 0),
  closed as (select chrom, p, sum(case when before is null or p - before - 1 > 5 then 1 else 0 end) over (partition by chrom order by p) as run from above),
  runs as (select chrom, run, min(p) as a, max(p) + 1 as b from closed group by 1, 2 having max(p) + 1 - min(p) between 50 and 450),
  vals as (select r.chrom, run, a, b, p, greatest(v, 0) as v from runs r join normal n on n.chrom = r.chrom and n.p >= r.a and n.p < r.b),
  high as (select *, p - row_number() over (partition by chrom, run order by p) as stretch from (select *, median(v) over (partition by chrom, run) as mid from vals) where v >= mid),
  picks as (select chrom, run, stretch, min(p) as start_pos, max(p) + 1 as end_pos, sum(v) as total, max(v) as height, any_value(b - a) as size from high group by 1, 2, 3),
  chosen as (select * from picks qualify case when size <= 150 then row_number() over (partition by chrom, run order by total desc, start_pos) = 1 else end_pos - start_pos between 50 and 150 end),
  calls as (select c.chrom, c.start_pos, c.end_pos, min(h.p) as peak_position, c.height from chosen c join high h on h.chrom = c.chrom and h.run = c.run and h.stretch = c.stretch and h.v = c.height where c.height > 1.0 group by all)"""
add("peaks_calls", lambda v: _peaks(v).select("chrom", "start_pos", "end_pos", "peak_position", R6("height").alias("height")), f"with {PEAKS} select chrom, start_pos, end_pos, peak_position, {r6('height')} as height from calls")
add(
    "peaks_stats",
    lambda v: profiles.peak_stats(_peaks(v), windows.fixed_size(v("chroms"), 10_000), ["window_idx"]).select("window_idx", "n_peaks", R6("mean_distance").alias("mean_distance"), "median_distance"),
    f"with {PEAKS}, {BINS.replace(str(SIZE - 1), '9999').replace(str(SIZE), '10000')}, g as (select window_idx, c.peak_position - lag(c.peak_position) over (partition by window_idx order by c.peak_position) as gap from calls c join bins w on w.chrom = c.chrom and c.peak_position >= w.start_pos and c.peak_position < w.end_pos) select cast(window_idx as bigint) as window_idx, count(*) as n_peaks, {r6('avg(gap)')} as mean_distance, median(gap) as median_distance from g group by 1",
)

# --- pairing
_reads = lambda v: v("read").withColumn("end_pos", F.col("pos") + F.col("aligned_len")).withColumn("gc_tag", F.col("gc_tag").cast("double")).where(reads.usable_single(5))
PAIRS = """(select chrom, qname, max(pos) filter (not rev) as start_pos, max(pos) filter (rev) as rev_pos, max(pos + aligned_len) filter (rev) as end_pos, min(mapq) as min_mapq, count(*) filter (rev) as n_rev, count(*) filter (not rev) as n_fwd,
  max(gc_tag) filter (not rev) as a, max(gc_tag) filter (rev) as b, max(case when rev then '-' else '+' end) filter ((flag & 64) <> 0) as read1_strand from (select *, (flag & 16) <> 0 as rev from {read} where (flag & 1024) = 0 and mapq >= 5) group by 1, 2 having n_rev = 1 and n_fwd = 1 and start_pos <= rev_pos and end_pos > start_pos)"""
add("pairing_fragments", lambda v: reads.pair(_reads(v)).select("chrom", "qname", "start_pos", "end_pos", "min_mapq", "read1_strand"), f"select chrom, qname, start_pos, end_pos, min_mapq, read1_strand from {PAIRS}")
STATE = "case when {x} is null then 'missing' when abs({x}) <= 4.5e-16 then 'zero' when {x} >= 1e-3 and {x} <= 1e3 then 'usable' else 'invalid' end"
add(
    "pairing_gc_tag",
    lambda v: reads.pair(_reads(v)).select("qname", "gc_state", R6("gc_weight").alias("gc_weight")),
    f"""select qname, case when sa = 'zero' or sb = 'zero' then 'zero' when sa = 'invalid' or sb = 'invalid' then 'invalid' when sa = 'missing' and sb = 'missing' then 'missing' else 'usable' end as gc_state,
  case when sa = 'zero' or sb = 'zero' then 0.0 when sa = 'invalid' or sb = 'invalid' then null when sa = 'missing' then {r6('b')} when sb = 'missing' then {r6('a')} else {r6('(a + b) / 2')} end as gc_weight
  from (select *, {STATE.format(x='a')} as sa, {STATE.format(x='b')} as sb from {PAIRS})""",
)

# --- preparing windows
_w5 = lambda v: v("win").select("chrom", "start_pos", "end_pos", "group_name", "window_idx", "score")
add("prep_dedup", lambda v: prepare.deduplicate(_w5(v).withColumn("start_pos", F.expr("start_pos div 200")), ["chrom", "start_pos"], "highest"), "select chrom, start_pos // 200 as start_pos, end_pos, group_name, window_idx, score from {win} qualify row_number() over (partition by chrom, start_pos // 200 order by score desc, window_idx) = 1")
add("prep_merge_within", lambda v: prepare.merge_within(v("win"), 300), UNIQUE_SQL.replace("start_pos > reach", "start_pos > reach + 300"))
add(
    "prep_merge_across",
    lambda v: prepare.merge_across(v("win"), 20),
    """select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos, string_agg(distinct group_name, ',' order by group_name) as group_name from (
  select *, sum(case when reach is null or start_pos > reach + 20 then 1 else 0 end) over (partition by chrom order by start_pos, end_pos rows unbounded preceding) as island from (
    select *, max(end_pos) over (partition by chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from {win})) group by chrom, island""",
)
NEAR = """(select w.chrom, w.window_idx, l.pos as lp, r.pos as rp, w.start_pos - l.pos as lg, greatest(0, r.pos - w.end_pos + 1) as rg from {win} w
  left join lateral (select max(start_pos) as pos from {site} s where s.chrom = w.chrom and s.start_pos <= w.start_pos) l on true
  left join lateral (select min(start_pos) as pos from {site} s where s.chrom = w.chrom and s.start_pos >= w.start_pos) r on true)"""
_targets = lambda v: v("site").select("chrom", F.col("start_pos").alias("pos"))
DIST = "case when lg = 0 or rg = 0 then 0 when rg is null or lg <= rg then -lg else rg end"
add(
    "prep_nearest",
    lambda v: prepare.annotate_nearest(_w5(v), _targets(v)).select("window_idx", "distance", "near_pos", "tied"),
    f"select window_idx, {DIST} as distance, case when rg is null or lg <= rg then lp else rp end as near_pos, coalesce(lg = rg and not (lg = 0 or rg = 0), false) as tied from {NEAR}",
)
RULES = ["<=0", "1-100", "101-1000", ">1000"]
add(
    "prep_distance_bins",
    lambda v: prepare.annotate_nearest(_w5(v), _targets(v), RULES).groupBy("distance_label").agg(F.count("*").alias("n")),
    f"select case when d <= 0 then '<=0' when d between 1 and 100 then '1-100' when d between 101 and 1000 then '101-1000' when d > 1000 then '>1000' end as distance_label, count(*) as n from (select abs({DIST}) as d from {NEAR}) group by 1",
)
add(
    "prep_cluster",
    lambda v: prepare.cluster_label(_w5(v), 4, ["window_idx"]).select("window_idx", "clustered"),
    f"select f.window_idx, sum({OVER}) >= 4 * any_value({FSIZE}) as clustered from {{win}} f join {{win}} w on {MEETS} group by 1",
)
add("prep_exclude", lambda v: prepare.exclude(_w5(v), {"group_name": ["Brand#11", "Brand#23"], "chrom": ["chr2"]}).select("window_idx", "group_name"), "select window_idx, group_name from {win} where group_name not in ('Brand#11', 'Brand#23') and chrom <> 'chr2'")
SPAN = "(end_pos - start_pos)"
add(
    "prep_resize",
    lambda v: prepare.resize(_w5(v), 201, v("chroms")).select("window_idx", "start_pos", "end_pos"),
    f"""select window_idx, s as start_pos, s + 201 as end_pos from (select *, start_pos + {SPAN} // 2 - 100 + case when {SPAN} % 2 = 1 then 0 else -((start_pos * 31 + {SPAN} * 17) % 2) end as s from {{win}}) join {{chroms}} using (chrom) where s >= 0 and s + 201 <= chrom_len""",
)
add("prep_min_per", lambda v: prepare.min_per(_w5(v), {"group_name": 85}).select("window_idx", "group_name"), "select window_idx, group_name from {win} where group_name in (select group_name from {win} group by 1 having count(*) >= 85)")
ROUNDS = 40  # more than the fixpoint takes at any of the scales; a further round changes nothing
add(
    "prep_min_per_two",
    lambda v: prepare.min_per(_w5(v).withColumn("bucket", F.expr("start_pos div 3000")), {"group_name": 60, "bucket": 60}).select("window_idx", "group_name", "bucket"),
    "with r0 as materialized (select window_idx, group_name, start_pos // 3000 as bucket from {win})"
    + "".join(f", r{k + 1} as materialized (select window_idx, group_name, bucket from r{k} qualify count(*) over (partition by group_name) >= 60 and count(*) over (partition by bucket) >= 60)" for k in range(ROUNDS))
    + f" select * from r{ROUNDS}",
)
add(
    "prep_min_distance",
    lambda v: prepare.thin(_w5(v), 500, "highest"),
    """with recursive o as materialized (select *, row_number() over (partition by chrom, group_name order by start_pos, end_pos, score) as i from {win}),
  walk as (select chrom, group_name, i, i as pending, score as best, end_pos as pending_end, end_pos as reach, cast(null as bigint) as last_end, cast(null as bigint) as emitted from o where i = 1
    union all select o.chrom, o.group_name, o.i,
      case when o.start_pos - last_end < 500 then pending when pending is null then o.i when o.start_pos - reach < 500 then case when o.score > best then o.i else pending end when o.start_pos - pending_end >= 500 then o.i end,
      case when o.start_pos - last_end < 500 then best when pending is null then o.score when o.start_pos - reach < 500 then greatest(best, o.score) when o.start_pos - pending_end >= 500 then o.score end,
      case when o.start_pos - last_end < 500 then pending_end when pending is null then o.end_pos when o.start_pos - reach < 500 then case when o.score > best then o.end_pos else pending_end end when o.start_pos - pending_end >= 500 then o.end_pos end,
      case when o.start_pos - last_end < 500 then reach when pending is null then o.end_pos when o.start_pos - reach < 500 then reach when o.start_pos - pending_end >= 500 then o.end_pos end,
      case when coalesce(o.start_pos - last_end < 500, false) or pending is null or o.start_pos - reach < 500 then last_end else pending_end end,
      case when coalesce(o.start_pos - last_end < 500, false) or pending is null or o.start_pos - reach < 500 then null else pending end
    from walk w join o on o.chrom = w.chrom and o.group_name = w.group_name and o.i = w.i + 1),
  kept as (select chrom, group_name, emitted as i from walk where emitted is not null
    union all select w.chrom, w.group_name, w.pending from walk w where w.pending is not null and not exists (select 1 from o where o.chrom = w.chrom and o.group_name = w.group_name and o.i = w.i + 1))
  select chrom, start_pos, end_pos, group_name, window_idx, score from o join kept using (chrom, group_name, i)""",
)
add("prep_score_filter", lambda v: _w5(v).where(score_filter("score", ">= 950")).select("window_idx"), "select window_idx from {win} where score >= 950")

# --- GC
GCF = "(select f.doc_id, f.start_pos, f.end_pos, count(*) filter (base in ('G', 'C')) as gc, count(*) filter (base <> 'N') as acgt from {seqfrag} f join {seq} s on s.doc_id = f.doc_id and s.pos >= f.start_pos + 5 and s.pos < f.end_pos - 5 group by all having count(*) filter (base <> 'N') >= 10)"
PCT = "least(100, (100 * gc + acgt // 2) // acgt)"
_gc = lambda v: gcbias.fragment_gc(_sf(v), _chunks(v, 220), 5, 512)
add("gc_counts_observed", lambda v: gcbias.observed_counts(_gc(v)), f"select end_pos - start_pos as size, {PCT} as gc_pct, count(*) as n from {GCF} group by 1, 2")
add(
    "gc_percent_grid",
    lambda v: gcbias.percent_rows(_gc(v).where("acgt = end_pos - start_pos - 10").groupBy((F.col("end_pos") - F.col("start_pos")).alias("size"), "gc").agg(F.count("*").alias("n")), list(range(30, 150)), 5).select("size", "gc_pct", R6("value").alias("value")),
    f"""with c as (select end_pos - start_pos as size, gc, count(*) as n from {GCF} where acgt = end_pos - start_pos - 10 group by 1, 2),
  w as (select size, least(100, (100 * g + (size - 10) // 2) // (size - 10)) as gc_pct, count(*) as width from (select distinct size from c) s, lateral (select unnest(generate_series(0, s.size - 10)) as g) group by 1, 2),
  r as (select size, least(100, (100 * gc + (size - 10) // 2) // (size - 10)) as gc_pct, sum(n) as n from c group by 1, 2)
  select size, gc_pct, {r6('n / width * sum(n) over (partition by size) / sum(n / width) over (partition by size)')} as value from r join w using (size, gc_pct)""",
)
SIZES = [40, 75, 110]
_starts = lambda v: v("seqfrag").select(F.concat(F.lit("d"), F.col("doc_id")).alias("chrom"), F.col("start_pos").alias("pos"))
_docwin = lambda v: v("docwin").select(F.concat(F.lit("d"), F.col("doc_id")).alias("chrom"), "start_pos", "end_pos", "window_name")
GCW = f"""(select f.doc_id, window_name, size, f.pos, count(*) filter (base in ('G', 'C')) as gc, count(*) filter (base <> 'N') as acgt
  from (select doc_id, w.window_name, least(w.end_pos, n_chars) as end_pos, s.start_pos as pos, unnest([{', '.join(map(str, SIZES))}]) as size, s.end_pos as other from {{seqfrag}} s join {{docwin}} w using (doc_id) join {{documents}} using (doc_id) where s.start_pos >= w.start_pos and s.start_pos < w.end_pos) f
  join {{seq}} b on b.doc_id = f.doc_id and b.pos >= f.pos + 4 and b.pos < f.pos + size - 4 where f.pos + size <= f.end_pos group by f.doc_id, window_name, size, f.pos, f.other
  having count(*) = size - 8 and acgt >= greatest(ceil(0.8 * (size - 8)), 10))"""
add(
    "gc_reference_windows",
    lambda v: gcbias.reference_counts(_chunks(v, 220), _starts(v), SIZES, 512, 4, _docwin(v), ["window_name"], 0.8).groupBy("window_name", "size", "gc_pct").agg(F.sum("n").alias("n")),
    f"select window_name, size, {PCT} as gc_pct, count(*) as n from {GCW} group by 1, 2, 3",
)
add(
    "gc_window_scaled",
    lambda v: (lambda counted, bp: gcbias.window_scaled(counted, bp, "chrom").withColumn("weight", R6("weight")))(
        gcbias.observed_counts(_gc(v), ["chrom"]), gcbias.window_bases(_chunks(v, 0), 512)
    ),
    f"""with c as (select doc_id, end_pos - start_pos as size, {PCT} as gc_pct, count(*) as n from {GCF} group by 1, 2, 3), b as (select doc_id, count(*) as span, count(*) filter (base <> 'N') as acgt from {{seq}} group by 1 having acgt >= 0.1 * span),
  m as (select doc_id, avg(n) as mean from c group by 1), used as (select count(*) as k from b join m using (doc_id))
  select size, gc_pct, {r6('sum(n / mean * acgt / (select avg(span) from b) / (select k from used))')} as weight from c join m using (doc_id) join b using (doc_id) group by 1, 2""",
)
PACKAGE = {"length_edges": [30, 60, 90, 150], "gc_edges": [0, 40, 60, 101], "correction": [[1.0, 0.5, 2.0], [0.25, 1.0, 1.5], [1.25, 0.75, 1.0]], "length_frequencies": [0.2, 0.5, 0.3]}
_GW = " ".join(f"when size >= {a} and size < {b} and pct >= {g} and pct < {h} then {PACKAGE['correction'][i][j]}" for i, (a, b) in enumerate(zip(PACKAGE["length_edges"], PACKAGE["length_edges"][1:])) for j, (g, h) in enumerate(zip(PACKAGE["gc_edges"], PACKAGE["gc_edges"][1:])))
add(
    "gc_weighted_lengths",
    lambda v: _counted(lengths.counts(gcbias.weigh(_gc(v), PACKAGE), [], length_edges("30:150:10"), F.col("gc_weight"))),
    f"select 30 + (size - 30) // 10 * 10 as length_start, {r6(f'sum(case {_GW} end)')} as count from (select end_pos - start_pos as size, {PCT} as pct from {GCF}) group by 1",
)

# --- selection on outputs
_global = lambda v: lengths.counts(v("frag"), ["chrom"], COARSE)
_by_chrom = lambda v: Output(_global(v), row="chrom", lengths=Bins("length_start", tuple(COARSE)))
add("sel_length_range", lambda v: _counted(_by_chrom(v).length_range(120, 160).values), f"select chrom, cast({CB} as bigint) as length_start, {r6('count(*)')} as count from {{frag}} f where {IN} and {CB} < 160 and {CB} + 51 > 120 group by 1, 2")
_profile = lambda v: Output(profiles.midpoint_profile(v("frag"), v("site"), COARSE), row="group_name", lengths=Bins("length_start", tuple(COARSE)), positions=Bins("position", tuple(range(202))))
add("sel_position_range", lambda v: _counted(_profile(v).position_range(90, 111).values), f"select w.group_name, cast({CB} as bigint) as length_start, {PLACE} as position, {r6('count(*)')} as count {MIDS} and {PLACE} >= 90 and {PLACE} < 111 group by 1, 2, 3")
add(
    "sel_profile",
    lambda v: _counted(_profile(v).groups("BUILDING", "MACHINERY").length_range(151, 221).profile("BUILDING")),
    f"select {PLACE} as position, {r6('count(*)')} as count {MIDS} and w.group_name = 'BUILDING' and {SZ} >= 151 and {SZ} < 221 group by 1",
)
add(
    "sel_groups_ordered",
    lambda v: _counted(_profile(v).groups("MACHINERY", "BUILDING").position_range(100, 101).values),
    f"select w.group_name, cast({CB} as bigint) as length_start, {PLACE} as position, {r6('count(*)')} as count, case w.group_name when 'MACHINERY' then 0 else 1 end as row_order {MIDS} and {PLACE} = 100 and w.group_name in ('MACHINERY', 'BUILDING') group by 1, 2, 3",
)


def _windowed(v) -> Output:
    """Lengths by window, each with its group and masked fraction."""
    rows = windows.covered_bp(_win(v), v("bl"), ["window_idx"]).select("window_idx", "group_name", "covered", R6(F.col("covered") / (F.col("end_pos") - F.col("start_pos"))).alias("blacklisted_fraction"))
    counted = lengths.counts(windows.assign(v("frag"), v("win").select("chrom", "start_pos", "end_pos", "window_idx")), ["window_idx"], COARSE)
    return Output(counted, row="window_idx", rows=rows, lengths=Bins("length_start", tuple(COARSE)))


_BLACK = f"(with m as ({MERGED_BL}) select w.window_idx, any_value(w.group_name) as group_name, cast(sum(case when m.chrom is null then 0 else least(w.end_pos, m.end_pos) - greatest(w.start_pos, m.start_pos) end) as bigint) as covered, {r6('sum(case when m.chrom is null then 0 else least(w.end_pos, m.end_pos) - greatest(w.start_pos, m.start_pos) end) / any_value(w.end_pos - w.start_pos)')} as blacklisted_fraction from {{win}} w left join m on m.chrom = w.chrom and m.start_pos < w.end_pos and w.start_pos < m.end_pos group by 1)"
_BY_WIN = f"(select w.window_idx, cast({CB} as bigint) as length_start, count(*)::double as n from {{frag}} f join {{win}} w on {MEETS} where {IN} group by 1, 2)"
add("sel_max_blacklisted", lambda v: _windowed(v).max_blacklisted(0.1).rows.select("window_idx", "group_name", "covered"), f"select window_idx, group_name, covered from {_BLACK} where blacklisted_fraction <= 0.1")
add(
    "sel_groups_by_name",
    lambda v: _windowed(v).groups_by_name("Brand#11", "Brand#23").max_blacklisted(0.25).frame().select("window_idx", "length_start", R6("count").alias("count"), "group_name", "blacklisted_fraction"),
    f"select window_idx, length_start, n as count, group_name, blacklisted_fraction from {_BY_WIN} join {_BLACK} using (window_idx) where group_name in ('Brand#11', 'Brand#23') and blacklisted_fraction <= 0.25",
)
add(
    "sel_dense",
    lambda v: _windowed(v).length_bins(100, 151).dense(),
    f"select d.window_idx, cast(s as bigint) as length_start, coalesce(n, 0) as count from (select distinct window_idx from {{win}}) d cross join (values (100), (151)) t(s) left join {_BY_WIN} x on x.window_idx = d.window_idx and x.length_start = s",
)
add(
    "sel_wide",
    lambda v: _windowed(v).frame(wide=True).drop("covered"),
    f"select window_idx, group_name, blacklisted_fraction, coalesce(sum(n) filter (length_start = 30), 0) as count_30_100, coalesce(sum(n) filter (length_start = 100), 0) as count_100_151, coalesce(sum(n) filter (length_start = 151), 0) as count_151_221, coalesce(sum(n) filter (length_start = 221), 0) as count_221_401 from {_BY_WIN} join {_BLACK} using (window_idx) group by 1, 2, 3",
)
add(
    "sel_ratio",
    lambda v: _windowed(v).max_blacklisted(0.5).ratio((100, 151), (151, 221)).withColumn("ratio", R6("ratio")),
    f"select window_idx, coalesce(sum(n) filter (length_start = 100), 0) as short, coalesce(sum(n) filter (length_start = 151), 0) as long, case when coalesce(sum(n) filter (length_start = 151), 0) = 0 then cast('NaN' as double) else {r6('coalesce(sum(n) filter (length_start = 100), 0) / sum(n) filter (length_start = 151)')} end as ratio from {_BY_WIN} join {_BLACK} using (window_idx) where blacklisted_fraction <= 0.5 group by 1",
)
_KMER_OUT = lambda v: Output(
    sequence.frequencies(_counts(v, ["contig_group"]), ["contig_group"]), "frequency", "contig_group", motif="kmer"
)
add(
    "sel_motif_counts",
    lambda v: _KMER_OUT(v).groups(3, 1).select_motifs("TTT", "ACG").counts().entries().withColumn("count", R6("count")),
    f"select doc_id % 5 as contig_group, kmer, {r6('sum(w)')} as count from {BOTH} where doc_id % 5 in (1, 3) and kmer in ('TTT', 'ACG') group by 1, 2",
)

alignment_queries.register(add)
