"""SimHash near-duplicates, linked by covering locality-sensitive hashing.

The bits of a fingerprint are dealt into equal parts. Two fingerprints that differ in at most ``radius`` bits
differ in at most radius // parts = q bits of some part. Within a part every bit position i has a code m(i), a
non-zero vector of q + 1 bits, and table v, for each non-zero vector v, keeps the bits with an odd inner
product <m(i), v>. For any q positions some v is orthogonal to all their codes: in table v none of them is
kept, so the pair surely meets there. No pair within the radius is lost, and a table keeps about half of a part.

``near_duplicates`` links fingerprints of three-word shingles within two bits.

``keep_one`` links texts whose sets of five-word shingles have a Jaccard likeness J of 0.8 or more. No radius of
fingerprints holds all such pairs, so their candidates come from the sets: if all sets are put in one order, two sets
of that likeness share one of the first n - ceil(J * n) + 1 of their n shingles, whatever the order. Rare shingles
come first, which keeps buckets small. The likeness of candidates is verified exactly.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_name, join_spread, let_go, release, scratch, spans_of
from .components import components

RADIUS = 2
BITS = 64
#: A bucket with more different fingerprints is linked through neighbour keys or leaders first, not through pairs.
BUSY_BUCKET = 32
SHINGLE_WORDS = 3
SEED = 42
#: Masks of a wider radius, in parts; the tests compare what they meet, up to LOOSE bits, with ``keep_one``.
WIDE_RADIUS, PARTS, LOOSE = 9, 2, 12
#: Texts of a Jaccard likeness of LIKENESS on WIDE_SHINGLE words are linked by ``keep_one``. From more than WIDE_BUSY
#: members a bucket counts as busy; in TURNS turns it is dealt anew into parts of some PART members, and a member is
#: verified against the NEAREST of the parts it is in.
LIKENESS, WIDE_SHINGLE, WIDE_BUSY, TURNS, PART, NEAREST = 0.8, 5, 8, 2, 16, 4
#: 64-bit words of parities of a set. About SAMPLE_ROWS rows tell which shingles are common; at most SAMPLE_MOST of them
#: are kept.
WORDS, SAMPLE_ROWS, SAMPLE_MOST = 8, 10_000, 50_000
#: A table of bits that sorts rows out has so many bits for each row looked for, and at most MOST_BITS (32 MB).
BITS_A_ROW, MOST_BITS = 16, 1 << 28
#: Up to so many links are joined up by one task.
AT_ONCE = 200_000
#: Texts that a block of pairs holds at once, as sets.
BLOCK = 64
#: Bounds in floating point are looser by so much.
_SLACK = 1e-6
_BLOCK = 1 << 15


def covering_masks(radius: int = RADIUS, parts: int = 1) -> list[int]:
    """The masks of all tables, as unsigned integers: parts * (2 ** (radius // parts + 1) - 1) of them."""
    width, dims = BITS // parts, radius // parts + 1
    codes = [2 * i + 1 for i in range(width)] if width <= 1 << (dims - 1) else [1 + i % ((1 << dims) - 1) for i in range(width)]
    return [sum(1 << (p * width + i) for i, m in enumerate(codes) if (m & v).bit_count() & 1) for p in range(parts) for v in range(1, 1 << dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(data: bytes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the k-word shingles of a text in UTF-8, repeats included; fewer words are one shingle, none none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], ">u8")
    starts, stops = [0, *ends[:-k]], ends[k - 1 :]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, stops)]), ">u8")


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, unsigned: a bit is 1 if it is set in over half of them; 0 without any."""
    total = np.zeros(BITS, dtype=np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), _BLOCK):
        total += np.unpackbits(raw[at : at + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(raw)).tobytes(), "big")


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 without words."""
    return folded(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), k))


def _fingerprints(batches):
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row for each document; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of ``distinct(fp)`` within the radius.

    A usual bucket is joined with itself. In a busy bucket each fingerprint is keyed by itself with any
    two of the free bits blanked: at most four fingerprints share such a key and all of them are within
    the radius, so a star over each key gives every link with linear work and no cap.
    """
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])
    placed = distinct.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.k")
    sizes = placed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(placed.join(sizes, ["t", "k"]))
    few = met.where(F.col("n") <= BUSY_BUCKET)
    a, b = few.select("t", "k", F.col("fp").alias("u")), few.select("t", "k", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    pairs = a.join(b, ["t", "k"]).where(near).select("u", "v")
    blanks = []
    for t, m in enumerate(masks):
        free = [i for i in range(BITS) if not m >> i & 1]
        two = [(1 << i) | (1 << j) for n, i in enumerate(free) for j in free[:n]]
        blanks.append((t, [_signed(~x & (2**64 - 1)) for x in two]))
    spark = distinct.sparkSession
    keep = F.broadcast(spark.createDataFrame(blanks, "t int, keep array<long>"))  # seven rows of fixed size
    many = (
        met.where(F.col("n") > BUSY_BUCKET)
        .join(keep, "t")
        .select("fp", F.posexplode("keep").alias("p", "w"), "t")
        .select("t", "p", F.col("fp").bitwiseAND(F.col("w")).alias("k"), "fp")
        .groupBy("t", "p", "k")
        .agg(F.collect_set("fp").alias("near"))  # four at most
        .where(F.size("near") > 1)
        .select(F.array_min("near").alias("u"), F.explode("near").alias("v"))
        .where("u <> v")
    )
    return pairs.union(many).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id that links of at most two differing bits can reach. Null texts
    count as empty; documents without words share fingerprint 0. Rows with a null id take part, and a
    component of null ids only has a null component_id. Repeated rows give repeated result rows. An empty
    table gives no rows.
    """
    own = cut(fingerprints(docs))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = components(links(distinct.select("fp")))
    joined = linked.join(distinct, linked.node == distinct.fp).select("fp", "root", "least")
    rooted = joined.groupBy("root").agg(F.min("least").alias("all_least"))
    named = cut(joined.join(rooted, "root").select("fp", "all_least"))
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("all_least", "least").alias("component_id"), "n")
    return join_spread(own, cut(classes), ["fp"]).select("doc_id", "fp", "component_id")


def _row_key() -> list:
    """Columns i and k, never null, which name a row by its id and its text."""
    told = F.col("doc_id").cast("long")
    return [F.coalesce(told, F.lit(0)).cast("long").alias("i"), F.xxhash64(told, F.col("text").cast("string")).alias("k")]


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(*_row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _sets(batch, k: int) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(t.as_py() or b"", k).astype(np.uint64)) for t in batch.column(batch.schema.get_field_index("text"))]


def _common(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper halves of hashes, counts) of shingles that several of about SAMPLE_ROWS rows share, by hash.

    They only decide in which order a set's shingles are taken; any order gives the same pairs.
    """
    part = SAMPLE_ROWS / max(docs.count(), 1)

    def run(batches):
        release()
        for batch in batches:
            for a, b in spans_of(batch.column(batch.schema.get_field_index("text"))):
                found, n = np.unique(np.concatenate(_sets(batch.slice(a, b - a), k)) >> 32, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    rows = _text_rows(docs)
    rows = rows.where(F.pmod(F.xxhash64("k", "i"), F.lit(1 << 30)) < int(min(part, 1.0) * (1 << 30)))
    told = rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(SAMPLE_MOST).toArrow()
    found, n = (told.column(c).to_numpy() for c in range(2))
    found = found.view(np.uint64)
    order = np.argsort(found)
    return found[order], n[order]


def _prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: sets of that likeness have one of them in common."""
    size = len(hashes) - math.ceil(least * len(hashes) - _SLACK) + 1 if len(hashes) else 0
    if not len(common[0]):
        return hashes[:size]
    told = hashes >> 32
    at = np.minimum(np.searchsorted(common[0], told), len(common[0]) - 1)
    seen = np.where(common[0][at] == told, common[1][at], 0)
    rare = hashes[seen == 0]
    return rare[:size] if len(rare) >= size else hashes[np.lexsort((hashes, seen))[:size]]


def _parities(hashes: np.ndarray) -> bytes:
    """For each of 64 * WORDS bins whether it holds an odd number of the hashes."""
    return np.packbits(np.bincount((hashes % (64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1).tobytes()


def _name(hashes: np.ndarray) -> bytes:
    """The class of a text: texts of equal sets have one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _classed(docs: DataFrame, k: int, least: float) -> DataFrame:
    """(i, k, doc_id, class, c, prefix, s) of each row: rows of equal shingle sets are one class, c is its short name; s has
    the size of the set and the words of its parities. In a task only the first row of a class has its prefix."""
    common = _common(docs, k)

    def run(batches):
        release()
        met = set()
        for batch in batches:
            for a, b in spans_of(batch.column(batch.schema.get_field_index("text"))):
                part = batch.slice(a, b - a)
                sets = _sets(part, k)
                names, firsts = list(map(_name, sets)), []
                for name, x in zip(names, sets):
                    firsts.append(x[:0].view(np.int64) if name in met else _prefix(x, common, least).view(np.int64))
                    met.add(name)
                ends = np.cumsum([0, *map(len, firsts)])
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts)))
                told = np.column_stack([[len(s) for s in sets], np.frombuffer(b"".join(map(_parities, sets)), np.int64).reshape(-1, WORDS)]).astype(np.int64)
                told = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (WORDS + 1), pa.int32()), pa.array(told.ravel()))
                columns = [*(part.column(c) for c in range(3)), pa.array(names, pa.binary()), pa.array(np.frombuffer(b"".join(x[:8] for x in names), np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, prefix, told], names=["i", "k", "doc_id", "class", "c", "prefix", "s"])

    return _text_rows(docs).mapInArrow(run, "i long, k long, doc_id long, class binary, c long, prefix array<long>, s array<long>")


def _texts(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(class, text): the texts of rows(i, k), compressed, perhaps repeatedly, and a few others.

    A table of bits, set where the hash of one of the rows points, sorts nearly all others out before any text is shuffled.
    """
    size = 1 << 15
    while size < min(BITS_A_ROW * rows.count(), MOST_BITS):
        size *= 2
    at = F.pmod(F.xxhash64("i", "k"), F.lit(size))
    own = rows.select(F.shiftright(at, 15).alias("b"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("p"))
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for r in own.groupBy("b").agg(F.bitmap_construct_agg("p").alias("x")).toLocalIterator():
        bits[r.b] = np.frombuffer(r.x, np.uint8)
    bits = bits.ravel()

    def run(batches):
        release()
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            p = batch.column(1).to_numpy()
            found = pa.array(np.flatnonzero(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1))
            for a, b in spans_of(text := batch.column(0).take(found)):
                part = pa.RecordBatch.from_arrays([text.slice(a, b - a)], names=["text"])
                yield pa.RecordBatch.from_arrays([pa.array(map(_name, _sets(part, k)), pa.binary()), pa.array((pack(t.as_py() or b"") for t in part.column(0)), pa.binary())], names=["class", "text"])

    return _text_rows(docs).select("text", at.alias("at")).mapInArrow(run, "class binary, text binary")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (u, v) of classes whose Jaccard likeness, exactly, is at least that."""

    def alike(batches):
        # a block's held texts come first, those that are only compared with them stream by
        block, sets, later, plain = None, {}, [], zstandard.ZstdDecompressor().decompress

        def compared(v, own, us):
            for u in us:
                a = sets[u]
                shared = len(np.intersect1d(a, own, assume_unique=True))
                if shared >= least * (len(a) + len(own) - shared):
                    yield u, v

        def told(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)] if found else [pa.array([], pa.binary())] * 2, names=["u", "v"])

        for batch in batches:
            found = []
            for at, v, held, us, text in zip(*(batch.column(c) for c in range(5))):
                if block != (at := at.as_py()):
                    found += [x for w, ws in later for x in compared(w, sets[w], ws)]
                    block, sets, later = at, {}, []
                v, us, own = v.as_py(), us.as_py(), np.unique(shingle_hashes(plain(text.as_py()), k).astype(np.uint64))
                if held.as_py():
                    sets[v] = own
                    later.append((v, us))
                else:
                    found += compared(v, own, us)
            yield told(found)
        yield told([x for w, ws in later for x in compared(w, sets[w], ws)])

    with scratch(docs.sparkSession) as put:
        pairs = put(pairs, few=True)
        shipped = put(_shipped(pairs), few=True)
        texts = _texts(docs, put(classes.join(shipped.select("class").distinct(), "class", "left_semi").select("i", "k"), few=True), k).dropDuplicates(["class"])
        met = shipped.join(texts, "class").select("block", "class", "held", "us", "text")
        met = met.repartition("block").sortWithinPartitions("block", F.desc("held"))
        found = cut(met.mapInArrow(alike, "u binary, v binary"), few=True)
    del shipped, texts, met
    let_go(docs.sparkSession)
    return found


def _shipped(pairs: DataFrame) -> DataFrame:
    """(block, class, held, us): where the text of each class of pairs(u, v) is needed, and the us it is compared with there.

    A pair is verified in a block of its u. Classes that share their least neighbour are put together, some BLOCK of
    them in a block, so that a text goes to a block once, however many pairs it has there.
    """
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("label")) / BLOCK).cast("long")
    block = pairs.select("u").distinct().join(label, "u").select("u", F.xxhash64("label", F.pmod(F.xxhash64("u"), parts)).alias("block"))
    placed = pairs.join(block, "u")
    held = placed.select("block", F.col("u").alias("class"), F.lit(True).alias("held"), F.lit(None).cast("binary").alias("other"))
    rows = held.union(placed.select("block", F.col("v").alias("class"), F.lit(False).alias("held"), F.col("u").alias("other")))
    return rows.groupBy("block", "class").agg(F.max("held").alias("held"), F.collect_set("other").alias("us"))


def _differing():
    """Column: parities in which the sets su and sv differ. Their symmetric difference has at least so many members."""
    return reduce(add, [F.bit_count(F.col("su")[w].bitwiseXOR(F.col("sv")[w])) for w in range(1, WORDS + 1)])


def _placed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, m, class, s): the members of each bucket h of several classes, m in number. One shuffle of the postings does."""
    own = Window.partitionBy("h")
    posted = rows.select("c", F.explode("prefix").alias("h"))
    posted = posted.select("h", "c", F.min("c").over(own).alias("from"), F.max("c").over(own).alias("to")).where(F.col("from") < F.col("to"))
    posted = posted.select("h", "c").distinct().select("h", "c", F.count("*").over(own).alias("m"))
    return posted.join(classes.select("c", "class", "s"), "c").select("h", "m", "class", "s")


def _wide_links(docs: DataFrame, classes: DataFrame, placed: DataFrame, k: int, least: float, put) -> DataFrame:
    """Links (u, v) that connect all classes(class, i, k) of at least that likeness; placed is of ``_placed``.

    Two such sets share a shingle of their prefixes, so they meet in its bucket. Sizes and parities rule pairs out that
    surely are less alike; all others are verified, but for those that links connect anyway: members of a busy bucket
    are verified in small parts of it first, and then all pairs that are in different components still.
    """
    side = lambda df, c, *more: df.select("h", F.col("class").alias(c), F.col("s").alias(f"s{c}"), *more)
    nu, nv = F.col("su")[0], F.col("sv")[0]
    near = (F.least(nu, nv) >= least * F.greatest(nu, nv) - _SLACK) & (_differing() <= (nu + nv) * ((1 - least) / (1 + least)) + _SLACK)
    ordered = (F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    few, many = placed.where(F.col("m") <= WIDE_BUSY), placed.where(F.col("m") > WIDE_BUSY)
    pairs = side(few, "u").join(side(few, "v"), "h").where((F.col("u") < F.col("v")) & near).select("u", "v").distinct()
    links, held = None, many.withColumn("root", F.col("class"))
    for turn in range(TURNS):
        part = F.pmod(F.xxhash64("h", "class", F.lit(turn)), F.ceil(F.col("m") / PART).cast("long")).alias("part")
        met = side(held, "u", F.col("root").alias("ru"), part).join(side(held, "v", F.col("root").alias("rv"), part), ["h", "part"])
        # a class is verified against the nearest few of those that it meets in parts of its buckets
        nearest = F.slice(F.array_sort(F.collect_set(F.struct(_differing().alias("d"), "v"))), 1, NEAREST)
        met = met.where((F.col("ru") != F.col("rv")) & near).groupBy("u").agg(nearest.alias("x"))
        met = met.select("u", F.explode("x.v").alias("v")).select(*ordered).distinct()
        new = _verified(docs, classes, pairs.union(met).distinct() if links is None else met, k, least)
        links = new if links is None else links.union(new)
        root = components(links, at_once=AT_ONCE).withColumnRenamed("node", "class")
        held = put(many.join(root, "class", "left").select("h", "m", "class", "s", F.coalesce("root", "class").alias("root")))
    counts = held.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("most"))
    open_ = held.join(counts, "h").where(F.col("root") != F.col("most"))
    # of two members outside of the most common component one order is enough
    met = side(open_, "u", F.col("root").alias("ru"), "most").join(side(held, "v", F.col("root").alias("rv")), "h")
    once = (F.col("u") < F.col("v")) | (F.col("rv") == F.col("most"))
    left = cut(met.where((F.col("ru") != F.col("rv")) & once & near).select(*ordered).distinct(), few=True)
    return links if left.isEmpty() else links.union(_verified(docs, classes, left, k, least))


def keep_one(docs: DataFrame, least: float = LIKENESS, shingle_words: int = WIDE_SHINGLE) -> DataFrame:
    """One row of docs for each component of near copies, with all columns: the one of its smallest doc_id, null ids last.

    Texts are linked when their sets of shingles have at least that Jaccard likeness, verified exactly; no such pair is
    left out. Null texts and texts without words are copies of each other. A row is known by its id and its text, so
    different texts of one id or without id are judged each for itself; of equal rows one stays. An empty table
    gives no rows.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "i", "k")
    with scratch(docs.sparkSession) as put:
        with scratch(docs.sparkSession) as first:
            rows = first(_classed(docs, shingle_words, least))
            classes = rows.groupBy("class").agg(F.min(rank).alias("r"), F.first("c").alias("c"), F.first("s").alias("s"))
            classes = put(classes.select("class", "c", "s", "r", "r.i", "r.k"))
            placed = put(_placed(rows, classes))
        del rows
        let_go(docs.sparkSession)
        links = _wide_links(docs, classes, placed, shingle_words, least, put)
        linked = components(links, at_once=AT_ONCE).withColumnRenamed("node", "class")
        rooted = classes.join(linked, "class", "left").select(F.coalesce("root", "class").alias("root"), "r")
        kept = cut(rooted.groupBy("root").agg(F.min("r").alias("r")).select("r.i", "r.k"))
    del classes, placed, links, linked, rooted
    let_go(docs.sparkSession)
    i, k = fresh_name(docs, "_i", "_k")
    kept = kept.select(F.col("i").alias(i), F.col("k").alias(k))
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(_row_key(), (i, k))])
    return keyed.join(kept, [i, k], "left_semi").dropDuplicates([i, k]).select(*[F.col(f"`{c}`") for c in docs.columns])
