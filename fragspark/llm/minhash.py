"""Document fingerprints by MinHash, in vectorised numpy; similar documents by bands, Jaccard verified.

A text's words, lower-cased in A-Z, give shingles of five words. Words are hashed by a polynomial over their bytes with
running sums, so that no loop over words is needed; shingles combine the hashes of their words. Each of
PERMUTATIONS multiply-add permutations of the 32-bit numbers takes its least value over the shingles; the
fingerprint keeps 16 bits of each, written in hexadecimal. The likeness of two fingerprints is the share of equal
places, an estimate of the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, pieces, spans_of

SHINGLE_WORDS, PERMUTATIONS, SEED = 5, 128, 20_240_601
#: Bands of the similarity search, and the least Jaccard likeness of a pair.
BANDS, LIKENESS = 32, 0.8
#: Range parts of documents for each shuffle partition when neighbours are looked up.
PARTS = 4
_U64 = np.uint64
_rng = np.random.default_rng(SEED)
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_A = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | _U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ALIKE = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    held = _ALIKE.get("powers")
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            held = tuple(np.concatenate([[_U64(1)], np.cumprod(np.full(size - 1, b, _U64))]) for b in (_BASE, _U64(inverse)))
        _ALIKE["powers"] = held
    return held


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (in place)."""
    x ^= x >> _U64(33)
    x *= _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of UTF-8 text."""
    if not data:
        return np.zeros(0, _U64)
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, _U64)
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U64(0)], np.cumsum((_LOWER[raw].astype(_U64) + _U64(1)) * up[: len(raw)])])
        return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U64))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """32-bit hashes of the k-word shingles; fewer words make one shingle, no words none."""
    if not len(words):
        return np.zeros(0, np.uint32)
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, _U64)
        for j in range(min(k, len(words))):
            total += words[j : j + n] * _PLACE[j]
        return (_mixed(total) >> _U64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, PERMUTATIONS) least values as 32-bit numbers; the largest one for a text without shingles."""
    out = np.full((len(sets), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        held = np.empty_like(x)
        with np.errstate(over="ignore"):
            for p in range(PERMUTATIONS):
                np.multiply(x, _A[p], out=held)
                held += _B[p]
                out[full, p] = np.minimum.reduceat(held, starts)
    return out


def fingerprint_of(texts: list[str]) -> np.ndarray:
    """16-bit fingerprints (texts, PERMUTATIONS) of whole texts, in pieces of bounded size."""
    parts = [signatures([shingle_hashes(word_hashes(t.encode("utf-8", "surrogatepass"))) for t in texts[a:b]]) for a, b in pieces(texts)]
    return (np.concatenate(parts) >> np.uint32(16)).astype(">u2") if parts else np.zeros((0, PERMUTATIONS), ">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(axis=-1)


def edited_text(text: str, following: str) -> str:
    """The last third of the characters replaced by as many first ones of the following text (or all of it)."""
    gone = len(text) // 3
    return text[: len(text) - gone] + following[:gone]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Deal docs(doc_id, text) out by ranges of doc_id; each range also gets the first row of the next one.

    Returns (part, own, doc_id, text), each part in one partition, sorted descending by doc_id, null ids last, ties
    by text. ``own`` is false for the borrowed row, which stands at its part's end; the last part borrows
    the very first row. Only range bounds and each range's first row number reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    bounds = sorted({int(c) for c in cuts}, reverse=True)
    # part 0 holds the largest ids; a part's number is the count of bounds above the id, counted among the last bounds
    # of stretches first and then within one stretch
    part = F.lit(0)
    if bounds:
        wide = max(1, int(len(bounds) ** 0.5))
        stretches = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
        above = lambda ladder: F.size(F.filter(ladder, lambda b: b > F.col("doc_id")))
        full = above(F.array(*[F.lit(x[-1]) for x in stretches]))
        inner = F.get(F.array(*[F.array(*[F.lit(b) for b in x]) for x in stretches]), full)
        part = full * wide + F.when(full == len(stretches), len(bounds) - len(stretches) * wide).otherwise(above(inner))
    numbered = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(part))
    first = {r.part: r.head for r in numbered.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(first)
    if not order:
        return numbered.withColumn("own", F.lit(True)).select("part", "own", "doc_id", "text")
    lender = dict(zip(order, order[-1:] + order[:-1]))  # whose end each part's first row also stands at
    to = F.create_map(*[F.lit(x) for p in order for x in (p, lender[p])])
    heads = F.create_map(*[F.lit(x) for p in order if first[p] is not None for x in (p, first[p])]) if any(v is not None for v in first.values()) else None
    is_head = F.col("doc_id").isNull() if heads is None else F.col("doc_id").eqNullSafe(F.element_at(heads, F.col("part")))
    places = F.when(is_head, F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")), F.struct(F.element_at(to, F.col("part")).alias("part"), F.lit(False).alias("own"))))
    places = places.otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))))
    spread = numbered.withColumn("place", F.explode(places)).select("place.part", "place.own", "doc_id", "text")
    dealt = spread.repartition(F.col("part"))
    return dealt.sortWithinPartitions("part", F.desc("own"), F.col("doc_id").desc_nulls_last(), "text")


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see ``edited_text``.

    The next document is the one of the next smaller doc_id, after the last the first; a single document is its own
    next. Null texts count as empty. Rows of one doc_id stand in the order of their texts. Empty tables give no rows.
    """

    def run(batches):
        held: tuple | None = None  # (part, doc_id, text, whether its results are wanted)

        def told(rows):
            """rows: (doc_id, text, next text)."""
            texts = [t for _, t, _ in rows] + [n for _, _, n in rows[-1:]]
            edited = [edited_text(t, n) for _, t, n in rows]
            joined = all(rows[i][2] is rows[i + 1][1] for i in range(len(rows) - 1))
            own = fingerprint_of(texts if joined else [t for _, t, _ in rows])
            after = own[1:] if joined else fingerprint_of([n for _, _, n in rows])
            own = own[: len(rows)]
            changed = fingerprint_of(edited)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([i for i, _, _ in rows], pa.int64()),
                    "n_chars": pa.array([len(t) for _, t, _ in rows], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": [x.tobytes().hex() for x in own],
                    "edited_fingerprint": [x.tobytes().hex() for x in changed],
                    "near_edited": likeness(own, changed),
                    "near_next": likeness(own, after),
                }
            )

        rows, size = [], 0
        for batch in batches:
            for part, own, doc_id, text in zip(*(batch.column(k) for k in range(4))):
                part, own, doc_id, text = part.as_py(), own.as_py(), doc_id.as_py(), text.as_py()
                if held is not None and held[0] == part and held[3]:
                    rows.append((held[1], held[2], text))
                    size += len(held[2])
                    if size > 1_000_000:
                        yield told(rows)
                        rows, size = [], 0
                held = (part, doc_id, text, own)
        if rows:
            yield told(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(docs).mapInArrow(run, schema)


def similar(queries: DataFrame, docs: DataFrame, least: float = LIKENESS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of docs whose shingle sets are at least that like a query's: (members of queries, members of docs, links).

    Both take (doc_id, text). Texts of equal shingle sets are one class; members are (doc_id, class), a row for
    each row, and links are (x, y, jaccard) between classes of queries and of docs, a class with itself included, so
    copies are not expanded into pairs. Signatures are banded, bands are joined between classes, and the exact
    Jaccard likeness of the met classes is taken from their shingle hashes. Null and empty texts have no shingles,
    no class and are like nothing. A pair of that likeness shares a band with a probability of at least
    1 - (1 - least**4)**32, over 0.9999999 at 0.8; no bucket is cut.
    """

    def run(batches):
        for batch in batches:
            for a, b in spans_of(batch.column(1)):
                part = batch.slice(a, b - a)
                sets = [np.unique(shingle_hashes(word_hashes(t.as_py() or b""))) for t in part.column(1)]
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                columns = [pa.array(names, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x.tobytes() for x in signatures(sets)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "class", "held", "signature"])

    def prepared(df):
        told = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, class binary, held binary, signature binary")
        told = cut(told.where("class is not null"))
        return told.select("doc_id", "class"), cut(told.dropDuplicates(["class"]).select("class", "held", "signature"))  # equal in a class

    def alike(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                found.append(shared / (len(p) + len(q) - shared))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["x", "y", "jaccard"])
            yield out.filter(pa.array([j >= least for j in found], pa.bool_()))

    (asked, a), (held, b) = prepared(queries), prepared(docs)
    width = 4 * PERMUTATIONS // BANDS
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 1 + width * k, width)) for k in range(BANDS)])
    keys = lambda df, name: df.select(F.col("class").alias(name), F.explode(bands).alias("key"))
    met = keys(a, "x").join(keys(b, "y"), "key").select("x", "y").distinct()
    side = lambda df, name, h: df.select(F.col("class").alias(name), F.col("held").alias(h))
    links = met.join(side(a, "x", "p"), "x").join(side(b, "y", "q"), "y").select("x", "y", "p", "q")
    return asked, held, links.mapInArrow(alike, "x binary, y binary, jaccard double")


def matches(queries: DataFrame, docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(doc_id, class, n_classes, n_docs, best) for each row of queries(doc_id, text).

    How many classes of docs are at least that like it, how many rows of docs they have, both without the query's own
    row, and the likeness of the best other class (null if there is none). Rows without words have a null class and
    no matches. ``docs`` holds the queries.
    """
    asked, held, links = similar(queries, docs, least)
    sizes = held.groupBy(F.col("class").alias("y")).agg(F.count("*").alias("n"))
    other = F.col("x") != F.col("y")
    told = links.join(sizes, "y").groupBy(F.col("x").alias("class")).agg(
        F.count(F.when(other, 1)).alias("n_classes"), (F.sum("n") - 1).alias("n_docs"), F.max(F.when(other, F.col("jaccard"))).alias("best")
    )
    found = asked.join(told, "class").select("doc_id", F.lower(F.hex("class")).alias("class"), "n_classes", "n_docs", "best")
    ids = queries.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wordless = F.trim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == ""
    return found.unionByName(ids.where(wordless).select("doc_id", F.lit(None).cast("string").alias("class"), F.lit(0).cast("long").alias("n_classes"), F.lit(0).cast("long").alias("n_docs"), F.lit(None).cast("double").alias("best")))
