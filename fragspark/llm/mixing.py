"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

The schedule is a sequence of slots. Slot i is the point i * phi modulo 1 of the golden-ratio sequence; the
cumulative targets of the sources cut the unit interval, and the cut that holds the point names the slot's
source. Slots are ranked within their source. Each source lays its documents end to end in shuffled order,
again and again; the words that it gives to the mix, the first Q of that line, are dealt as blocks of equal
length, the k-th block to its k-th slot. So any stretch of the schedule holds the sources in proportion, a
source gives Q words exactly, and a document is taken as often as the line passes it.

Nothing is ranked in one task: running sums and ranks go by chunk first (hash range of the shuffle, run of
slots), then over chunks, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, fresh_name

#: Words of a block, nearly: each source's blocks are equal, so that they fill its share exactly.
BLOCK_WORDS = 256
#: No source gives more than this many times its words.
MOST_PASSES = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of a chunk in running sums, on average.
CHUNK_ROWS = 1024
#: floor(2**48 / golden ratio), made odd, in two halves of 24 bits.
_STEP = 173961102589771
_HIGH, _LOW = _STEP >> 24, _STEP & 0xFFFFFF


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13; null: 0."""
    blank = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.coalesce(F.regexp_count(blank, F.lit("[^ ]+")), F.lit(0)).cast("long")


def point(i: Column) -> Column:
    """i times the golden ratio modulo 1, exact to 48 bits for i below 2**48."""
    high, low = F.shiftright(i, 24), i.bitwiseAND(F.lit(0xFFFFFF))
    middle = (low * F.lit(_HIGH) + high * F.lit(_LOW)).bitwiseAND(F.lit(0xFFFFFF))
    return ((F.shiftleft(middle, 24) + low * F.lit(_LOW)).bitwiseAND(F.lit((1 << 48) - 1))) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, most: float = MOST_PASSES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, rank, source_size, rows, target, quota) from sizes(source, source_size, rows), a row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most`` times its source's size and the excess is shared by weight, until none is above. That
    ends at min(cap, level * weight): by rising cap / weight the sources that stop come first, so the level
    is found with running sums. The windows hold one row for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    here = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("here", here).withColumn("stops", F.col("cap") <= F.col("here") * F.col("w"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), F.col("here")))).over(Window.partitionBy(F.lit(0)))
    target = F.when(F.col("stops"), F.col("cap")).otherwise(level.getField("here") * F.col("w"))
    return leveled.withColumn("target", target).select(
        "source", "rank", "source_size", "rows", "target",
        F.least(F.round("target").cast("long"), (F.col("source_size") * float(most)).cast("long")).alias("quota"),
    )


def _key() -> Column:
    return F.xxhash64(F.col("source").cast("string"), F.lit(0), F.col("text").cast("string"))


class Mix:
    """The schedule of a table. ``sized`` has a row for each document, ``segments`` what each slot takes.

    docs(doc_id, source, text); ``size`` may name a column of sizes to use in place of words. Null texts have
    size 0. A row is known by its doc_id and a hash of its source and text, so rows of one id or without id are
    documents of their own; rows equal in all three can stand for one another. Ties in the shuffle go by
    doc_id, null ids first, then that hash. An empty table, or one without words, gives an empty schedule.
    Other columns aren't looked at.
    """

    def __init__(self, docs: DataFrame, size: Column | None = None, block: int = BLOCK_WORDS, most: float = MOST_PASSES, seed: int = 17, weights: tuple[float, ...] = WEIGHTS) -> None:
        spark = docs.sparkSession
        size = word_count(F.col("text").cast("string")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _key().alias("key"))
        # the upper half of the hash, 0 .. 2**31 - 1, orders the shuffle
        slim = cut(named.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 33)))
        summed = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        self.sources = cut(targets(summed, most, weights))
        total, n_sources, most_rows = self.sources.agg(F.sum("quota"), F.count("*"), F.max("rows")).first()
        total, n_sources, most_rows = int(total or 0), int(n_sources), int(most_rows or 0)
        self.slot_count = max(1, -(-total // block)) if total else 0
        self.sized = cut(self._laid(slim, most_rows))
        self.slots = self._schedule(spark, n_sources)
        self.segments = self._segments(most)

    def _laid(self, slim: DataFrame, most_rows: int) -> DataFrame:
        """Each document's place on its source's line: ``at`` is the words before it."""
        chunks = max(1, most_rows // CHUNK_ROWS)
        placed = slim.withColumn("chunk", F.floor(F.col("h") * float(chunks) / float(1 << 31)).cast("long"))
        order = [F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("key"), F.col("size")]
        inside = Window.partitionBy("source", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        over = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = placed.groupBy("source", "chunk").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0)))
        bases = sums.join(self.sources, sums.source.eqNullSafe(self.sources.source)).select("rank", "source_size", "target", "quota", sums.source.alias("s"), F.col("chunk").alias("c"), "base")
        within = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        joined = within.join(bases, within.source.eqNullSafe(F.col("s")) & (within.chunk == F.col("c")))
        return joined.select("doc_id", "key", "source", "size", "rank", "source_size", "target", "quota", (F.col("base") + F.col("inside")).alias("at"))

    def _schedule(self, spark, n_sources: int) -> DataFrame:
        """(slot, rank, k): slots in order, their source and their rank among its slots.

        A source whose cut is so thin that no point falls in it gets a slot at the end, so that none starves.
        """
        shares = self.sources.where("quota > 0").select("rank", "quota")
        over = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        whole = F.sum("quota").over(Window.partitionBy(F.lit(0)))
        cuts = shares.withColumn("upper", F.sum("quota").over(over)).withColumn("whole", whole)
        cells = 1 << max(10, (4 * max(1, n_sources)).bit_length())
        cuts = cut(cuts.select("rank", "quota", ((F.col("upper") - F.col("quota")) / F.col("whole")).alias("lo"), (F.col("upper") / F.col("whole")).alias("hi")))
        cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("long")
        held = cuts.select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
        drawn = spark.range(self.slot_count).select(F.col("id").alias("slot"), point(F.col("id") + 1).alias("u")).withColumn("cell", cell(F.col("u")))
        drawn = drawn.join(held, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "rank")
        found = drawn.groupBy("rank").agg(F.count("*").alias("n"))
        late = cuts.join(found, "rank", "left_anti").select((F.lit(self.slot_count) + F.row_number().over(Window.orderBy("rank")) - 1).alias("slot"), "rank")
        slots = cut(drawn.union(late)).withColumn("run", F.floor(F.col("slot") / CHUNK_ROWS))
        runs = slots.groupBy("rank", "run").agg(F.count("*").alias("n"))
        runs = runs.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1
        return cut(slots.withColumn("inside", inside).join(runs.select("rank", "run", "base"), ["rank", "run"]).select("slot", "rank", (F.col("base") + F.col("inside")).alias("k")))

    def _segments(self, most: float) -> DataFrame:
        """(slot, source, doc_id, at, pass, from_word, to_word): words of a document that a slot takes, in line order."""
        counts = self.slots.groupBy("rank").agg(F.count("*").alias("slots"))
        lines = self.sized.where("size > 0 and quota > 0").join(counts, "rank")
        longer = F.col("quota") % F.col("slots")
        begin = F.col("at") + F.col("pass") * F.col("source_size")
        passes = F.sequence(F.lit(0), F.lit(int(most)))
        laid = (
            lines.withColumn("short", F.expr("quota div slots")).withColumn("longer", longer)
            .withColumn("pass", F.explode(passes))
            .withColumn("a", begin)
            .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota")))
            .where("a < b")
        )
        # the first `longer` blocks have short + 1 words, the others short
        which = lambda x: f"if({x} < longer * (short + 1), ({x}) div (short + 1), longer + ({x} - longer * (short + 1)) div greatest(short, 1))"
        first = lambda k: F.col(k) * F.col("short") + F.least(F.col(k), F.col("longer"))
        parts = laid.withColumn("k", F.explode(F.expr(f"sequence({which('a')}, {which('(b - 1)')})")))
        start = F.greatest(F.col("a"), first("k"))
        stop = F.least(F.col("b"), first("k") + F.col("short") + F.when(F.col("k") < F.col("longer"), 1).otherwise(0))
        return (
            parts.withColumn("from_word", start - F.col("a")).withColumn("to_word", stop - F.col("a"))
            .join(self.slots, ["rank", "k"])
            .select("slot", "source", "rank", "doc_id", "at", "pass", "from_word", "to_word")
        )

    def taken(self) -> DataFrame:
        """doc_id, key, source, size, source_size, target, taken and copies (passes that take its first word)."""
        got = self.segments.groupBy("rank", "at").agg(
            F.sum(F.col("to_word") - F.col("from_word")).alias("got"), F.sum(F.when(F.col("from_word") == 0, 1).otherwise(0)).alias("copies")
        )
        own = self.sized.alias("d")
        joined = own.join(got.alias("g"), (F.col("d.rank") == F.col("g.rank")) & (F.col("d.at") == F.col("g.at")) & (F.col("d.size") > 0), "left")
        told = [F.col(f"d.{c}") for c in ("doc_id", "key", "source", "size", "source_size", "target")]
        return joined.select(*told, F.coalesce("got", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))

    def documents(self, docs: DataFrame) -> DataFrame:
        """docs as the mix takes them, whole: a row for each pass that takes a document's first word.

        Rows equal in doc_id, source and text are given out as one of them, as often as all of them are taken.
        Documents without words take no part.
        """
        i, none, k, copies, n = fresh_name(docs, "_id", "_none", "_key", "_copies", "_n")
        named = lambda x: [F.coalesce(x, F.lit(0)).alias(i), x.isNull().alias(none)]
        chosen = self.taken().where("copies > 0").select(*named(F.col("doc_id")), F.col("key").alias(k), "copies").groupBy(i, none, k).agg(F.sum("copies").alias(copies))
        columns = [F.col(f"`{c}`") for c in docs.columns]
        keyed = docs.select(*columns, *named(F.col("doc_id").cast("long")), _key().alias(k))
        met = keyed.join(chosen, [i, none, k]).dropDuplicates([i, none, k])
        return met.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns)
