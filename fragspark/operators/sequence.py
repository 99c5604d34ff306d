"""Reference sequence: chunks, k-mers, end motifs, fragment k-mers, and reference correction of motif counts.

A reference is a table of chunks (chrom, chunk_start, seq). Chunks carry their right neighbour's first bases
where an operator needs them, so that k-mers across chunk edges are seen once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical_by_centre, collapse_complement, int_div, reverse_complement
from ..storage import settled
from . import intervals, windows

#: Bases of a chunk.
CHUNK = 4096
#: Characters that a Python worker looks at together, and cells of its tables of counts.
PIECE, CELLS = 1 << 22, 1 << 20


def characters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings without nulls one behind the other, where each begins and the last ends)."""
    if not len(strings):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, at, data = strings.buffers()
    at = np.frombuffer(at, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    u = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    lead = (u & 0xC0) != 0x80
    if lead.all():
        c = u.astype(np.uint32)
    else:
        place = np.flatnonzero(lead)
        c, padded = u[place].astype(np.uint32), np.append(u, np.zeros(3, np.uint8)).astype(np.uint32)
        for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            own = np.flatnonzero((u[place] >= low) & (u[place] < (low | mask + 1 if more < 3 else 256)))
            code = u[place[own]].astype(np.uint32) & mask
            for j in range(1, more + 1):
                code = code << 6 | padded[place[own] + j] & 0x3F
            c[own] = code
        at = np.concatenate([[0], np.cumsum(lead)])[at]
    return c, at


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE):
    """Slices of a batch whose strings have about so many bytes together, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def chunks(bases: DataFrame, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """bases(chrom, pos, base) as chunks with ``overlap`` bases of what follows."""
    own = int_div("pos", size)
    places = F.array(own)
    if overlap:
        back = F.when((F.col("pos") % size < overlap) & (own > 0), F.array(own, own - 1)).otherwise(places)
        places = back
    spread = bases.withColumn("chunk", F.explode(places))
    told = spread.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    return told.select("chrom", (F.col("chunk") * size).alias("chunk_start"), F.array_join(F.transform("b", lambda x: x["base"]), "").alias("seq"))


def kmers(chunked: DataFrame, k: int, size: int = CHUNK, keep_n: bool = False) -> DataFrame:
    """(chrom, pos, kmer) for every k-mer that begins in a chunk; chunks must overlap by k - 1 bases."""
    last = F.least(F.length("seq") - k, F.lit(size - 1))
    at = chunked.where(last >= 0).select("chrom", "chunk_start", "seq", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    out = at.select("chrom", (F.col("chunk_start") + F.col("i")).alias("pos"), F.substring("seq", F.col("i") + 1, F.lit(k)).alias("kmer"))
    return out if keep_n else out.where(~F.col("kmer").contains("N"))


def kmers_by_window(found: DataFrame, k: int, targets: DataFrame | None = None, size: int | None = None, how: windows.Assigner = windows.Assigner.COUNT_OVERLAP, proportion: float = 0.5) -> DataFrame:
    """k-mers of found(chrom, pos, kmer) with every window that they belong to, and ``in_window``, their weight there.

    The windows are fixed bins (``size``, as window_start) or targets(chrom, start_pos, end_pos, ...). The rules are those of
    fragments, with the k-mer as the fragment; under count-overlap a k-mer weighs the share of it that is inside.
    """
    placed = found.withColumn("start_pos", F.col("pos")).withColumn("end_pos", F.col("pos") + k)
    met = windows.assign_fixed(placed, size, how, proportion) if targets is None else windows.assign(placed, targets, how, proportion)
    weight = F.col("overlap") / F.lit(float(k)) if how is windows.Assigner.COUNT_OVERLAP else F.lit(1.0)
    return met.withColumn("in_window", weight).drop("start_pos", "end_pos", "overlap", "b_start", "b_end")


def _numbered(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a first row of each combination of keys, the number of each row's combination)."""
    code = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        column = batch.column(key).dictionary_encode(null_encoding="encode")
        told = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (len(column.dictionary) + 1) + told, return_inverse=True)
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return first, number


def _summed(group: np.ndarray, units: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums of whole units in them); without units each counts one."""
    if not len(group):
        return group, np.zeros(0)
    if group.max() < CELLS:
        sums = np.bincount(group, units)
        held = np.flatnonzero(sums)
        return held, sums[held].astype(float)
    held, at = np.unique(group, return_inverse=True)
    return held, np.bincount(at, units).astype(float)


def tallied(chunked: DataFrame, k: int, size: int = CHUNK, keys: list[str] = [], targets: DataFrame | None = None, bins: int | None = None, how: windows.Assigner = windows.Assigner.COUNT_OVERLAP, proportion: float = 0.5) -> DataFrame:  # noqa: B006
    """(keys, kmer, weight): the k-mers that begin in a chunk, counted batch by batch, so that no k-mer is a row of its own.

    Rows of equal keys and k-mer come back several times: sum them up, as ``kmer_counts`` does. keys are columns of chunked or
    targets. k-mers with N go; chunks must overlap by k - 1 bases. With ``bins`` (a width; window_start is a key too) or
    targets(chrom, start_pos, end_pos, ...) the weights are those that ``kmers_by_window`` gives.
    """
    placed = targets is not None
    if placed:
        spans = chunked.withColumn("start_pos", F.col("chunk_start")).withColumn("end_pos", F.col("chunk_start") + F.least(F.length("seq"), F.lit(size + k - 1))).where("start_pos < end_pos")
        chunked = intervals.overlap_join(spans, intervals.renamed(targets))
    column = lambda c, kind="long": F.col(c).cast(kind).alias("_" + c)
    source = chunked.where("seq is not null").select(*keys, column("seq", "string"), column("chunk_start"), *([column("b_start"), column("b_end")] if placed else []))
    point, shared = how is windows.Assigner.MIDPOINT, how is windows.Assigner.COUNT_OVERLAP

    def weighed(p: np.ndarray, a, b) -> np.ndarray:
        """Units (k of them are one) of k-mers at p in windows [a, b)."""
        if point:
            mid = p + k // 2 - (0 if k % 2 else np.where((p * 31 + k * 17) % 7 < 4, 0, 1))
            return np.where((mid >= a) & (mid < b), k, 0)
        overlap = np.maximum(0, np.minimum(p + k, b) - np.maximum(p, a))
        if shared:
            return overlap
        enough = overlap == k if how is windows.Assigner.ALL else (overlap >= proportion * k) & (overlap > 0) if how is windows.Assigner.PROPORTION else overlap > 0
        return np.where(enough, k, 0)

    def words(codes, letters, group):
        out = np.empty((len(group), k), np.uint32)
        for j in reversed(range(k)):
            out[:, j] = letters[group % len(letters)]
            group = group // len(letters)
        return pa.array(["".join(map(chr, w)) for w in out.tolist()], pa.string())

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_seq"):
                codes, at = characters(part.column("_seq"))
                n = np.minimum(np.diff(at) - (k - 1), size).clip(0)
                row = np.repeat(np.arange(part.num_rows), n)
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = at[row] + i
                letters = np.flatnonzero(np.bincount(codes)).astype(np.uint32) if len(codes) else np.zeros(0, np.uint32)
                no = np.concatenate([[0], np.cumsum(codes == ord("N"))])
                keep = no[place + k] == no[place]
                row, i, place = row[keep], i[keep], place[keep]
                if not len(row):
                    continue
                first, number = _numbered(part, keys)
                if len(letters) ** k * (len(first) + 1) < 1 << 62:
                    own = np.searchsorted(letters, codes).astype(np.int64) if len(letters) > 1 else np.zeros(len(codes), np.int64)
                    word = own[place]
                    for j in range(1, k):
                        word = word * len(letters) + own[place + j]
                    told, wide = lambda w: words(codes, letters, w), len(letters) ** k
                else:  # words too long for a number
                    text = [codes[x : x + k].tobytes() for x in place.tolist()]
                    names = list(Counter(text))
                    index = {x: j for j, x in enumerate(names)}
                    word = np.array([index[x] for x in text], np.int64)
                    told, wide = lambda w: pa.array(["".join(map(chr, np.frombuffer(names[x], np.uint32))) for x in w.tolist()], pa.string()), len(names)
                group = number[row] * wide + word
                if bins is None and not placed:
                    groups, sums = _summed(group, None)
                    yield answer(part, first, groups // wide, told(groups % wide), sums, None)
                    continue
                p = part.column("_chunk_start").to_numpy(zero_copy_only=False)[row] + i
                if bins is None:
                    a, b = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("_b_start", "_b_end"))
                    groups, sums = _summed(group, weighed(p, a, b))
                    yield answer(part, first, groups // wide, told(groups % wide), sums / k, None)
                    continue
                least, most = p // bins, (p + k - 1) // bins
                for bin_ in range((most - least).max() + 1):  # neighbours of a word's first window
                    met = np.flatnonzero(least + bin_ <= most)
                    window = least[met] + bin_
                    units = weighed(p[met], window * bins, (window + 1) * bins)
                    names_, at_ = np.unique(window, return_inverse=True)
                    groups, sums = _summed(at_ * (len(first) * wide) + group[met], units)
                    rest = groups % (len(first) * wide)
                    yield answer(part, first, rest // wide, told(rest % wide), sums / k, names_[groups // (len(first) * wide)] * bins)

    def answer(part, first, key, kmer, weight, start):
        held = pa.array(weight > 0)
        columns = [part.column(c).take(pa.array(first[key])) for c in keys]
        columns += [pa.array(start, pa.int64())] if start is not None else []
        return pa.RecordBatch.from_arrays([*columns, kmer, pa.array(weight, pa.float64())], names=[*keys, *(["window_start"] if start is not None else []), "kmer", "weight"]).filter(held)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema] + (["window_start long"] if bins is not None else [])
    return source.mapInArrow(run, ", ".join([*kinds, "kmer string", "weight double"]))


def both_orientations(counted: DataFrame, weight: str = "weight") -> DataFrame:
    """Half of each weight to the k-mer and half to its reverse complement."""
    halves = F.array(F.struct(F.col("kmer").alias("m")), F.struct(reverse_complement("kmer").alias("m")))
    return counted.withColumn("_m", F.explode(halves)).withColumn("kmer", F.col("_m.m")).withColumn(weight, F.col(weight) * 0.5).drop("_m")


def kmer_counts(found: DataFrame, keys: list[str], orientation: str = "both", canonical: bool = False, k: int | None = None, weight: Column | None = None) -> DataFrame:
    """(keys, kmer, weight): weighted counts of found(keys, kmer)."""
    if orientation not in ("forward", "both"):
        raise ValueError(f"unknown orientation: {orientation}")
    weighted = found.withColumn("weight", F.lit(1.0) if weight is None else weight)
    counted = weighted.groupBy(*keys, "kmer").agg(F.sum("weight").alias("weight"))
    if orientation == "both":
        counted = both_orientations(counted)
    if canonical:
        if k is None:
            raise ValueError("canonical needs k")
        counted = counted.withColumn("kmer", canonical_by_centre("kmer", k))
    return counted.groupBy(*keys, "kmer").agg(F.sum("weight").alias("weight"))


def frequencies(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Adds row_scaling_factor (the row's total) and frequency (the share of it)."""
    whole = F.sum("weight").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return counted.withColumn("row_scaling_factor", whole).withColumn("frequency", F.when(whole == 0, 0.0).otherwise(F.col("weight") / whole))


def selected(counted: DataFrame, motifs: DataFrame, motif: str = "kmer", weight: str = "weight", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts of listed motifs only, under their group where motifs(motif, motif_group) has one."""
    met = counted.join(motifs.select(F.col("motif").alias(motif), "motif_group"), motif)
    return met.groupBy(*keys, "motif_group").agg(F.sum(weight).alias(weight))


def sequence_at(spans: DataFrame, chunked: DataFrame, size: int = CHUNK) -> DataFrame:
    """spans(chrom, start_pos, end_pos, ...) with ``seq``: the reference bases of each span.

    Chunks must overlap by at least the longest span. Spans that begin in no chunk go.
    """
    right = chunked.select(F.col("chrom").alias("_c"), F.col("chunk_start").alias("_at"), F.col("seq").alias("_s"))
    met = spans.withColumn("_k", int_div("start_pos", size) * size).join(right, (F.col("chrom") == F.col("_c")) & (F.col("_k") == F.col("_at")))
    return met.withColumn("seq", F.substring("_s", F.col("start_pos") - F.col("_at") + 1, F.col("end_pos") - F.col("start_pos"))).drop("_k", "_c", "_at", "_s")


def end_motifs(frags: DataFrame, chunked: DataFrame, k_inside: int, k_outside: int = 0, collapse: bool = False, size: int = CHUNK) -> DataFrame:
    """Both ends of each fragment with their motif 'outside_inside': end ('left' / 'right'), boundary, motif.

    The left end reads outside then inside; the right end is the reverse complement of inside then outside, so that it
    reads from the outside as well. Motifs with other letters than A, C, G, T and ends beyond the contig go.
    """
    ends = F.array(
        F.struct(F.lit("left").alias("end"), F.col("start_pos").alias("boundary"), (F.col("start_pos") - k_outside).alias("a"), (F.col("start_pos") + k_inside).alias("b")),
        F.struct(F.lit("right").alias("end"), F.col("end_pos").alias("boundary"), (F.col("end_pos") - k_inside).alias("a"), (F.col("end_pos") + k_outside).alias("b")),
    )
    long = frags.withColumn("_e", F.explode(ends)).withColumnsRenamed({"start_pos": "frag_start", "end_pos": "frag_end"})
    long = long.withColumn("end", F.col("_e.end")).withColumn("boundary", F.col("_e.boundary")).withColumn("start_pos", F.col("_e.a")).withColumn("end_pos", F.col("_e.b")).drop("_e")
    told = sequence_at(long.where("start_pos >= 0"), chunked, size)
    full = told.where((F.length("seq") == k_inside + k_outside) & ~F.col("seq").rlike("[^ACGT]"))
    read = full.withColumn("seq", F.when(F.col("end") == "right", reverse_complement("seq")).otherwise(F.col("seq")))
    outside, inside = F.substring("seq", 1, k_outside), F.substring("seq", k_outside + 1, k_inside)
    motif = collapse_complement(outside, inside) if collapse else F.concat(outside, F.lit("_"), inside)
    return read.withColumn("motif", motif).drop("seq", "start_pos", "end_pos")


def all_motifs(spark, k: int) -> DataFrame:
    """(kmer): all 4 ** k words over A, C, G, T, sorted."""
    digits = [F.element_at(F.split(F.lit("A,C,G,T"), ","), (F.call_function("mod", F.call_function("div", F.col("id"), F.lit(4 ** (k - 1 - j))), F.lit(4)) + 1).cast("int")) for j in range(k)]
    return spark.range(4**k).select(F.concat(*digits).alias("kmer"))


def zero_filled(counted: DataFrame, rows: DataFrame, axis: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Every row of ``rows`` with every label of ``axis``. A dense result of more than MOST_DENSE bytes is refused first."""
    from .selection import MOST_DENSE

    if keys and 8 * axis.count() * rows.select(*keys).distinct().count() > MOST_DENSE:
        raise ValueError("the dense result is too large; leave out what was not observed")
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(axis.select(label))) if keys else axis.select(label)
    return grid.join(counted, [*keys, label], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def transitions(counted: DataFrame, keys: list[str], order: int, weight: str = "weight") -> DataFrame:
    """Probability of the last base of each k-mer (k = order + 1) after its first ``order`` bases, per key."""
    out = counted.withColumn("prefix", F.substring("kmer", 1, order)).withColumn("next_base", F.substring("kmer", order + 1, 1))
    whole = F.sum(weight).over(Window.partitionBy(*keys, "prefix"))
    return out.withColumn("probability", F.when(whole == 0, 0.0).otherwise(F.col(weight) / whole))


def position_table(spark, lengths: tuple[int, int], k: int, frame: str = "left", first: int = 0, last: int | None = None, step: int = 1) -> DataFrame:
    """(size, offset, reverse): which k-mer starts of a fragment of each length a selection takes.

    Frames: left and right count from that end (right ones are read reversed), nearest takes each position from the end
    it is nearer to, per-end both ends in full, mid counts from the central base. The table has a row per length and
    selected position and no fragment data; fragments join it on their length.
    """
    rows = []
    for size in range(lengths[0], lengths[1] + 1):
        stop = size - k if last is None else min(last, size - k)
        for d in range(first, stop + 1, step) if frame != "mid" else ():
            if frame in ("left", "per-end") or frame == "nearest" and 2 * d + k <= size:
                rows.append((size, d, False))
            if frame in ("right", "per-end") or frame == "nearest" and 2 * d + k <= size and size - k - d != d:
                rows.append((size, size - k - d, True))
        if frame == "mid":
            centre = size // 2
            rows += [(size, centre + d, False) for d in range(first, (last if last is not None else 0) + 1, step) if 0 <= centre + d <= size - k]
    return spark.createDataFrame(rows, "size long, offset long, reverse boolean")


def _fragment_pieces(frags: DataFrame, chunked: DataFrame, positions: DataFrame, k: int, size: int) -> DataFrame:
    """frags as frag_start, frag_end with each chunk _k_of that selected k-mers begin in, the selection _spots, and the bases
    seq from start_pos on that these k-mers can read."""
    spots = positions.groupBy("size").agg(F.collect_list(F.struct("offset", "reverse")).alias("_spots"), F.min("offset").alias("_least"), F.max("offset").alias("_most"))
    met = frags.withColumn("size", F.col("end_pos") - F.col("start_pos")).join(F.broadcast(spots), "size")  # a row for each length
    met = met.withColumnsRenamed({"start_pos": "frag_start", "end_pos": "frag_end"})
    met = met.withColumn("_k_of", F.explode(F.sequence(int_div(F.col("frag_start") + F.col("_least"), size), int_div(F.col("frag_start") + F.col("_most"), size))))
    # what of the fragment its k-mers in this chunk can read
    met = met.withColumn("start_pos", F.greatest(F.col("frag_start") + F.col("_least"), F.col("_k_of") * size))
    met = met.withColumn("end_pos", F.least(F.col("frag_start") + F.col("_most"), (F.col("_k_of") + 1) * size - 1) + k)
    return sequence_at(met, chunked, size)


def fragment_kmers(frags: DataFrame, chunked: DataFrame, positions: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """frags with offset, reverse and kmer for each selected position; k-mers from the right end are reversed.

    A fragment meets each chunk that its selected positions begin in once, whatever their number.
    """
    told = _fragment_pieces(frags, chunked, positions, k, size).withColumn("_o", F.explode("_spots")).withColumn("offset", F.col("_o.offset")).withColumn("reverse", F.col("_o.reverse"))
    told = told.where(int_div(F.col("frag_start") + F.col("offset"), size) == F.col("_k_of"))
    told = told.withColumn("seq", F.substring("seq", (F.col("frag_start") + F.col("offset") - F.col("start_pos") + 1).cast("int"), F.lit(k)))
    told = told.where((F.length("seq") == k) & ~F.col("seq").rlike("[^ACGT]"))
    return told.withColumn("kmer", F.when(F.col("reverse"), reverse_complement("seq")).otherwise(F.col("seq"))).drop("seq", "start_pos", "end_pos", "_spots", "_least", "_most", "_k_of", "_o")


def fragments_tallied(frags: DataFrame, chunked: DataFrame, positions: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """(offset, reverse, kmer, n): what ``fragment_kmers`` gives, counted batch by batch; rows of one k-mer come back several times."""
    table = {}
    for r in positions.collect():  # some for each length
        table.setdefault(r["size"], []).append((r["offset"], r["reverse"]))
    spots = sorted({x for own in table.values() for x in own})
    at_spot = {x: j for j, x in enumerate(spots)}
    wide = max(map(len, table.values()), default=0)
    sizes = np.array(sorted(table), np.int64)
    chosen = np.array([[at_spot[x] for x in table[n]] + [-1] * (wide - len(table[n])) for n in sizes.tolist()], np.int64).reshape(len(sizes), wide)
    offsets = np.array([x for x, _ in spots] or [0], np.int64)
    source = _fragment_pieces(frags, chunked, positions, k, size).select(F.col("frag_start").cast("long").alias("frag_start"), F.col("size").cast("long").alias("size"), F.col("_k_of").cast("long").alias("chunk"), F.col("start_pos").cast("long").alias("start_pos"), "seq")
    complement = bytes.maketrans(b"ACGT", b"TGCA")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "seq", PIECE // 4):
                codes, at = characters(part.column("seq"))
                start, length, chunk, begin = (part.column(c).to_numpy(zero_copy_only=False) for c in range(4))
                spot = chosen[np.searchsorted(sizes, length)]
                first = start[:, None] + offsets[spot]
                place = at[:-1, None] + first - begin[:, None]
                row, column = np.nonzero((spot >= 0) & (first // size == chunk[:, None]) & (first >= begin[:, None]) & (place + k <= at[1:, None]))
                place, spot = place[row, column], spot[row, column]
                own = np.full(max(int(codes.max()) + 1 if len(codes) else 1, 128), -1, np.int64)
                own[np.frombuffer(b"ACGT", np.uint8)] = range(4)
                own = own[codes]
                no = np.concatenate([[0], np.cumsum(own < 0)])
                clean = no[place + k] == no[place]
                place, spot = place[clean], spot[clean]
                word = np.zeros(len(place), np.int64)
                for j in range(k):
                    word = word * 4 + own[place + j]
                groups, sums = _summed(spot * 4**k + word, None)
                told = []
                for g in groups.tolist():
                    w, text = g % 4**k, bytearray()
                    for _ in range(k):
                        text.append(b"ACGT"[w % 4])
                        w //= 4
                    told.append((bytes(text).translate(complement) if spots[g // 4**k][1] else bytes(text[::-1])).decode())
                of = (groups // 4**k).tolist()
                columns = [pa.array([int(spots[j][0]) for j in of], pa.int64()), pa.array([bool(spots[j][1]) for j in of], pa.bool_()), pa.array(told, pa.string()), pa.array(sums.astype(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["offset", "reverse", "kmer", "n"])

    if len(spots) * 4**k >= 1 << 62:  # words too long for a number
        return fragment_kmers(frags, chunked, positions, k, size).groupBy("offset", "reverse", "kmer").agg(F.count("*").alias("n"))
    return source.mapInArrow(run, "offset long, reverse boolean, kmer string, n long")


def _with_support(reference: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return reference.withColumn("support", F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).over(whole)).select(*keys, label, F.col(value).alias("_f"), "support")


def _corrected(met: DataFrame, denominator: Column, unsupported: str) -> DataFrame:
    bad = (F.col("count") > 0) & (F.coalesce(denominator, F.lit(0.0)) <= 0)
    if unsupported == "drop":
        return met.where(~bad).withColumn("corrected", F.when(F.coalesce(denominator, F.lit(0.0)) <= 0, 0.0).otherwise(F.col("count") / denominator))
    fail = F.raise_error(F.lit("counts without reference support")).cast("double") if unsupported == "error" else F.lit(float("nan"))
    return met.withColumn("corrected", F.when(bad, fail).when(F.coalesce(denominator, F.lit(0.0)) <= 0, 0.0).otherwise(F.col("count") / denominator))


def correct(counted: DataFrame, reference: DataFrame, keys: list[str], mode: str = "joint", use_global: bool = False, unsupported: str = "error") -> DataFrame:
    """Motif counts divided by what the reference would give, times the number of motifs it supports.

    counted(keys, outside, inside, count); reference(keys, kmer, frequency) with kmer = outside + inside, counted
    in both orientations and not canonical. joint: by the whole motif. split: by the product of the two sides' marginals.
    outside / inside: counts and reference are summed by that side first. ``use_global``: the reference has no keys.
    """
    if mode not in ("joint", "split", "outside", "inside"):
        raise ValueError(f"unknown mode: {mode}")
    own = [] if use_global else keys
    k_out = F.length("outside")
    if mode == "joint":
        ref = _with_support(reference, own, "kmer", "frequency")
        met = counted.withColumn("kmer", F.concat("outside", "inside")).join(ref, [*own, "kmer"], "left")
        return _corrected(met, F.col("_f") * F.col("support"), unsupported).drop("_f", "support", "kmer")
    counted, reference = settled(counted), settled(reference)  # small, and read several times
    width = counted.select(k_out.alias("k")).limit(1).first()
    if width is None:
        return counted.withColumn("corrected", F.lit(None).cast("double"))
    k = width.k
    sides = {"outside": F.substring("kmer", 1, k), "inside": F.expr(f"substring(kmer, {k + 1})")}
    marginal = lambda side: _with_support(reference.withColumn(side, sides[side]).groupBy(*own, side).agg(F.sum("frequency").alias("frequency")), own, side, "frequency")
    if mode == "split":
        a = marginal("outside").withColumnsRenamed({"_f": "_fo", "support": "_so"})
        b = marginal("inside").withColumnsRenamed({"_f": "_fi", "support": "_si"})
        met = counted.join(a, [*own, "outside"], "left").join(b, [*own, "inside"], "left")
        return _corrected(met, F.col("_fo") * F.col("_so") * F.col("_fi") * F.col("_si"), unsupported).drop("_fo", "_so", "_fi", "_si")
    summed = counted.groupBy(*keys, mode).agg(F.sum("count").alias("count"))
    return _corrected(summed.join(marginal(mode), [*own, mode], "left"), F.col("_f") * F.col("support"), unsupported).drop("_f", "support")


def restored_counts(freqs: DataFrame) -> DataFrame:
    """Counts back from frequencies: frequency times the row's factor."""
    return freqs.withColumn("weight", F.col("frequency") * F.col("row_scaling_factor"))


def masked(chunked: DataFrame, mask: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks with the bases under mask(chrom, start_pos, end_pos) replaced by N."""
    own = chunked.withColumn("start_pos", F.col("chunk_start")).withColumn("end_pos", F.col("chunk_start") + F.length("seq"))
    hit = intervals.overlap_join(own.select("chrom", "chunk_start", "start_pos", "end_pos"), intervals.renamed(intervals.merge(mask)))
    spans = hit.groupBy("chrom", "chunk_start").agg(
        F.array_sort(F.collect_list(F.struct((F.greatest("start_pos", "b_start") - F.col("chunk_start")).cast("int").alias("a"), (F.least("end_pos", "b_end") - F.col("chunk_start")).cast("int").alias("b")))).alias("_m")
    )
    cover = F.aggregate("_m", F.col("seq"), lambda s, m: F.overlay(s, F.repeat(F.lit("N"), m["b"] - m["a"]), m["a"] + 1, m["b"] - m["a"]))
    return chunked.join(spans, ["chrom", "chunk_start"], "left").withColumn("seq", F.when(F.col("_m").isNull(), F.col("seq")).otherwise(cover)).drop("_m")
