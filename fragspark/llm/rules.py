"""Quality rules: statistics of whole texts in Spark expressions, and learned decision lists over them.

The statistics and the verdict are DataFrame expressions. The list is learned by sequential covering from the
statistics of labelled rows: a rule grows one threshold condition at a time by information gain on two thirds
of the rows, is pruned from its end on the other third, takes the rows that it covers with it, and the next
rule is learned from what is left. The result is an ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fold, fresh_name, one_label

#: At most this many labelled rows, those of the least hashed ids, are used to learn the list.
FIT_ROWS = 20_000
#: Rows of this fold (crc32 of the id modulo FOLDS) are never learned from.
FOLDS, HELD_FOLD = 5, 0
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"

MOST_RULES, MOST_CONDITIONS, CUTS = 8, 4, 48


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: a lambda's variable isn't computed again inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def words_of(text: Column) -> Column:
    """The runs of characters other than space and the controls 9 to 13, in order."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " +"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more in the array.

    Windows are told apart by 64-bit hashes. Hashes that occur once drop out first; the places of the others,
    sorted, cover the lesser of the window and the way to the next place each.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(2), F.greatest(F.size(places), F.lit(2))),
            lambda i: F.least(F.lit(window), F.coalesce(F.get(places, i - 1) - F.get(places, i - 2), F.lit(window))),
        )
        # the last place covers a whole window; a lone place is counted by it alone
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(F.slice(gaps, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.lit(window), lambda a, x: a + x))

    def twice(keyed: Column) -> Column:
        """keyed: (hash, place) sorted by hash, then place."""
        same = lambda a, b: F.get(keyed, a).getField("h") == F.get(keyed, b).getField("h")
        met = F.filter(keyed, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return _let(F.array_sort(F.transform(met, lambda x: x.getField("p"))), covered)

    def of_hashes(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(keyed, twice))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
    return F.when(F.size(words) < window + 1, 0).otherwise(_let(windows(words), of_hashes)).cast("long")


def statistics(docs: DataFrame, text: str = "text", stats: str = "stats") -> DataFrame:
    """docs with one more struct column of that name. Null and empty texts have no words and zero everywhere."""
    counted_name, lines_name = fresh_name(docs, "_w", "_l")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = lambda c: F.length(c).cast("long")
    lost = lambda letters: (F.length(t) - F.length(_without(t, letters))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACES) != "")
    digits, upper, marks = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?"
    counted = _let(
        words_of(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"), F.size(F.array_distinct(w)).cast("long").alias("d")),
    )
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("r")))
    raw = docs.select("*", counted.alias(counted_name), of_lines.alias(lines_name))
    told = lambda c: F.col(f"{counted_name}.{c}")
    line = lambda c: F.col(f"{lines_name}.{c}")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    chars, n = size(_without(t, SPACES)), told("n")
    return raw.withColumn(
        stats,
        F.struct(
            n.alias("n_words"), chars.alias("word_chars"), lost(SYMBOLS).alias("n_symbols"), line("r").alias("n_dup_lines"), told("r").alias("n_repeat_words"),
            share(chars, n).alias("mean_word"), share(lost(SYMBOLS), chars).alias("symbol_share"), share(line("r"), line("n")).alias("dup_line_share"),
            share(told("r"), n).alias("repeat_share"), share(told("d"), n).alias("distinct_share"), share(lost(upper), chars).alias("upper_share"),
            share(lost(marks), chars).alias("mark_share"), share(lost(digits), chars).alias("digit_share"), share(n, line("n")).alias("words_a_line"),
        ),
    ).drop(counted_name, lines_name)


FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share", "digit_share", "words_a_line")


class Rule:
    """A conjunction of (feature, is_at_least, threshold) that rejects a text."""

    def __init__(self, conditions: list[tuple[str, bool, float]]) -> None:
        self.conditions = conditions

    def merged(self) -> Rule:
        """The same conjunction with the tightest threshold of each feature and side only."""
        least: dict[tuple[str, bool], float] = {}
        for f, up, t in self.conditions:
            held = least.get((f, up), t)
            least[f, up] = max(held, t) if up else min(held, t)
        return Rule([(f, up, t) for (f, up), t in least.items()])

    def covers(self, row: dict) -> bool:
        return all((row[f] >= t) if up else (row[f] <= t) for f, up, t in self.conditions)

    def expression(self, stats: Column) -> Column:
        out = F.lit(True)
        for f, up, t in self.conditions:
            out = out & ((stats.getField(f) >= F.lit(t)) if up else (stats.getField(f) <= F.lit(t)))
        return out

    def __repr__(self) -> str:
        return " and ".join(f"{f} {'>=' if up else '<='} {t:.4g}" for f, up, t in self.conditions)


def _information(p: int, n: int) -> float:
    return math.log2(p / (p + n)) if p else -60.0


def _cuts(rows: list[dict], feature: str) -> list[float]:
    """Candidate thresholds: midpoints of neighbouring quantiles."""
    values = sorted(r[feature] for r in rows)
    picks = sorted({values[round(k * (len(values) - 1) / CUTS)] for k in range(CUTS + 1)})
    return [(a + b) / 2 for a, b in zip(picks, picks[1:])]


def _grow(rows: list[dict]) -> Rule:
    """Add the condition of most gain until no accepted row is covered; positives are rejected texts (y = 0)."""
    chosen: list[tuple[str, bool, float]] = []
    while len(chosen) < MOST_CONDITIONS:
        p0 = sum(r["y"] == 0 for r in rows)
        n0 = len(rows) - p0
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for f in FEATURES:
            ordered = sorted((r[f], r["y"] == 0) for r in rows)
            at = p = n = 0
            for cut in _cuts(rows, f):
                while at < len(ordered) and ordered[at][0] < cut:
                    p, n, at = p + ordered[at][1], n + (not ordered[at][1]), at + 1
                for up, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    g = a * (_information(a, b) - _information(p0, n0))
                    if g > gain:
                        best, gain = (f, up, cut), g
        if best is None:
            break
        chosen.append(best)
        rows = [r for r in rows if Rule([best]).covers(r)]
    return Rule(chosen)


def _worth(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    hit = [r for r in rows if rule.covers(r)]
    p = sum(r["y"] == 0 for r in hit)
    return ((2 * p - len(hit)) / len(hit) if hit else -1.0), p


def learn(rows: list[dict], least_worth: float = 0.5) -> list[Rule]:
    """Ordered rejecting rules from labelled statistics; ``part`` 0 and 1 grow, 2 prunes. No rows: no rules."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        growing, pruning = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2]
        rule = _grow(growing) if growing else Rule([])
        kept = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
        if not kept:
            break
        best = max(kept, key=lambda x: _worth(x, pruning))  # of equal worth the longest
        worth, hits = _worth(best, pruning)
        if worth < least_worth or not hits:
            break
        rules.append(best.merged())
        rows = [r for r in rows if not best.covers(r)]
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> list[dict]:
    """Statistics of at most ``most`` labelled rows outside the held-out fold, as plain rows on the driver.

    An id's label is the mean of its labels, ties going to 1; of several texts of an id the one of the least hash
    counts. Null ids and labels are left out; other columns aren't looked at.
    """
    named = one_label(labels, "quality").where(fold(F.col("doc_id"), FOLDS) != HELD_FOLD)
    named = named.select(F.col("doc_id").cast("long").alias("id"), "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "id").limit(most)
    met = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(named), "id")  # `most` rows of 24 bytes
    stats = statistics(met).select("id", "y", F.pmod(F.shiftright("h", 8), F.lit(3)).alias("part"), F.xxhash64("text").alias("t"), "stats")
    one = stats.groupBy("id", "y", "part").agg(F.min_by("stats", F.coalesce("t", F.lit(0))).alias("stats"))
    rows = one.select("id", "y", "part", *[F.col(f"stats.{f}").alias(f) for f in FEATURES]).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["id"])]


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """docs with ``stats``, base_failed and kept, and the rules that were learned.

    A row is kept if the base tests hold and no rule rejects it. Repeated rows get the same verdict; null and
    empty texts have too few words; an empty table has no rows. Columns of docs by these names stay, and the new
    ones get underscores.
    """
    rules = learn(labelled_statistics(docs, labels))
    name, base, kept = fresh_name(docs, "stats", "base_failed", "kept")
    told = statistics(docs, stats=name)
    stats = F.col(name)
    n, repeated = stats.getField("n_words"), stats.getField("n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    verdict = F.when(failed, F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.expression(stats), F.lit(False))
    return told.withColumn(base, failed).withColumn(kept, verdict.otherwise(F.lit(True))), rules


#: The base statistics in SQL over ``documents``.
SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from t),
k as (select doc_id, unnest(range(1, len(words) - 3)) as i, words from w where len(words) > 4),
windows as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(words[i:i + 4], ' ')) as n from k),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from windows where n > 1) group by doc_id)
select w.doc_id, len(words) as n_words, coalesce(length(array_to_string(words, '')), 0) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
  len(words) < 10 or 100 * coalesce(n, 0) > 20 * len(words) as base_failed
from w left join covered using (doc_id)
"""
