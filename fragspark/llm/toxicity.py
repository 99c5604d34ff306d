"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vocabulary holds every term that at least two examples share; no label picks terms. A term weighs
(1 + log count) * idf * (FLOOR + phi2): idf over all documents, phi2 the squared correlation of the term's presence with the
label over the examples, which doesn't depend on their number. Equal example vectors form one group. Groups are
sorted so that alike ones are neighbours and cut into blocks; postings are sorted by group, and for each term
and block the index knows the largest weight.

A query adds up postings, terms of the largest possible contribution first. The block maxima of the terms left bound
what each block may still gain; a block whose best sum and bound stay below the k-th best sum found falls out, and
postings are read in the ranges of the other blocks only. The cosines of the best are taken from their whole vectors. So
the k nearest groups are exact. Their votes, weighted by cosine, give a score that is calibrated on examples,
each scored without itself.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, one_label, release

#: At most this many labelled rows, those of the least hashed ids, serve as examples; so many of them calibrate.
FIT_ROWS, CALIBRATE_ROWS = 2_500, 1_500
#: Rows of this fold (crc32 of the id modulo FOLDS) are never learned from.
FOLDS, HELD_FOLD = 4, 2
#: Least weight of a term beside its squared correlation with the label.
FLOOR = 0.0005
NEIGHBOURS, BLOCK = 25, 64
#: Terms that are added up before the first look at the bounds.
FIRST_TERMS = 8
#: The blocks' bounds are looked at once what is left could add at most this many times the k-th best sum.
LOOK = 1.0
#: Score from which a text is called toxic.
THRESHOLD = 0.3
#: Postings are 32-bit floats; sums of them are compared with this slack.
_SLACK = 1e-5
_MARKS = string.punctuation


#: Term numbers and how often each occurs: a dictionary, or two arrays.
Counts = dict[int, int] | tuple[np.ndarray, np.ndarray]


def words_of(text: str) -> Counter:
    """Counts of the lower-cased words without outer punctuation."""
    counts = Counter(w.strip(_MARKS) for w in text.lower().split())
    counts.pop("", None)
    return counts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Example groups with unit vectors, their members and labels, and the block-max postings.

    ``examples`` are (doc_id, label, counts of term numbers); ``scale`` has the weight of each term.
    """

    def __init__(self, vocabulary: dict[str, int], scale: np.ndarray, examples: list[tuple[int, int, Counts]]) -> None:
        self.vocabulary, self.scale = vocabulary, scale
        self.examples, self.prior = len(examples), (sum(y for _, y, _ in examples) + 0.5) / (len(examples) + 1) if examples else 0.0
        groups: dict[bytes, list] = {}
        for doc_id, y, counts in examples:
            t, c = self._sorted(counts)
            key = t.tobytes() + c.tobytes()
            g = groups.setdefault(key, [0, 0, doc_id, t, c, key])
            g[0], g[1], g[2] = g[0] + 1, g[1] + y, min(g[2], doc_id)
        none = groups.pop(b"", [0, 0, None])
        self.none_n, self.none_pos = none[0], none[1]
        units = {key: self._weighed(g[3], g[4]) for key, g in groups.items()}
        # alike vectors side by side: by a term of over half the length, else by the commonest term, which tells the
        # language; then by size, as short vectors have large weights
        spread = np.bincount(np.concatenate([np.zeros(0, np.int32), *(g[3] for g in groups.values())]), minlength=len(vocabulary))

        def place(g):
            t, unit = g[3], units[g[5]]
            heavy = int(unit.argmax())
            return (0, int(t[heavy]), len(t), g[5]) if unit[heavy] > 0.5 else (1, int(t[spread[t].argmax()]), len(t), g[5])

        held = sorted(groups.values(), key=place)
        self.n = np.array([g[0] for g in held], float)
        self.pos = np.array([g[1] for g in held], float)
        self.ids = [g[2] for g in held]
        self.group_of = {g[5]: i for i, g in enumerate(held)}
        self.blocks = -(-len(held) // BLOCK)
        # whole vectors, one after another
        self.sizes = np.array([len(g[3]) for g in held], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.terms = np.concatenate([np.zeros(0, np.int32), *(g[3] for g in held)])
        self.weights = np.concatenate([np.zeros(0), *(units[g[5]] for g in held)])
        # postings by term, then group; the largest weight of each term and block
        owner = np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(self.terms, kind="stable")
        self.at, self.own = owner[order].astype(np.int32), self.weights[order].astype(np.float32)
        edges = np.arange(len(vocabulary) + 1)
        self.posted = np.searchsorted(self.terms[order], edges)
        self.top = np.zeros(len(vocabulary))
        np.maximum.at(self.top, self.terms, self.weights)
        pair = self.terms[order].astype(np.int64) * max(self.blocks, 1) + self.at // BLOCK
        pair, first = np.unique(pair, return_index=True)
        self.first = np.concatenate([first, [len(order)]])
        self.block, self.most = (pair % max(self.blocks, 1)).astype(np.int32), np.maximum.reduceat(self.own, first) if len(first) else self.own
        self.blocked = np.searchsorted(pair // max(self.blocks, 1), edges)
        self.spread = np.zeros(len(vocabulary))
        self.slope, self.offset = 1.0, 0.0
        self.kept: dict[str, tuple] = {}
        #: Postings that queries added up, and all postings of their terms.
        self.visited = self.listed = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def counts(self, text: str) -> dict[int, int]:
        """Term number -> count of a text's known terms."""
        known = self.vocabulary.get
        return {t: c for w, c in words_of(text).items() if (t := known(w)) is not None}

    @staticmethod
    def _sorted(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(counts, dict):
            counts = np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))
        order = np.argsort(counts[0])
        return counts[0][order], counts[1][order]

    def _weighed(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        w = (1 + np.log(c)) * self.scale[t]
        return w / max(math.sqrt(float(w @ w)), 1e-300)

    def unit(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        t, c = self._sorted(counts)
        return t, self._weighed(t, c)

    def nearest(self, counts: Counts, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """(cosine, group) of the k best groups with a positive cosine, exact; ties go to the lower group."""
        terms, weights = self.unit(counts)
        size = len(self.ids)
        if not len(terms) or not size:
            return []
        gain = weights * self.top[terms]
        order = np.argsort(-gain, kind="stable")
        t, w = terms[order], weights[order]
        left = np.concatenate([np.cumsum(gain[order][::-1])[::-1], [0.0]])  # what terms from j on can add at most
        self.listed += int((self.posted[t + 1] - self.posted[t]).sum())
        sums, done, step, live = np.zeros(size), 0, FIRST_TERMS, None
        while True:
            part = slice(done, done + step)
            at, own, many = self._postings(t[part], live)
            sums += np.bincount(at, own * np.repeat(w[part].astype(np.float32), many), size)
            self.visited += len(at)
            done, step = min(done + step, len(t)), step * 4
            floor = np.partition(sums, size - k)[size - k] - _SLACK if size > k else -1.0
            if done == len(t):
                break
            if left[done] <= LOOK * floor:
                rest = slice(done, None)
                many = self.blocked[t[rest] + 1] - self.blocked[t[rest]]
                at = _ranges(self.blocked[t[rest]], many)
                bound = np.bincount(self.block[at], self.most[at] * np.repeat(w[rest], many), self.blocks)
                most = np.maximum.reduceat(sums, np.arange(0, size, BLOCK)) + bound
                live = most >= floor if live is None else live & (most >= floor)
        chosen = np.flatnonzero(sums >= max(floor, 1e-30))  # sums outside of live blocks are too low even with their bounds
        spread = self.spread
        spread[terms] = weights
        at = _ranges(self.begins[chosen], self.sizes[chosen])
        cos = np.add.reduceat(spread[self.terms[at]] * self.weights[at], np.concatenate([[0], np.cumsum(self.sizes[chosen])[:-1]])) if len(chosen) else np.zeros(0)
        spread[terms] = 0.0
        best = np.lexsort((chosen, -np.round(cos, 12)))[:k]
        return [(c, g) for c, g in zip(cos[best].tolist(), chosen[best].tolist()) if c > 0]

    def _postings(self, t: np.ndarray, live: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups and weights of the postings of these terms in live blocks (all, if None), and how many each term has."""
        if live is None:
            starts, stops = self.posted[t].tolist(), self.posted[t + 1].tolist()
            at, own = (np.concatenate([x[a:b] for a, b in zip(starts, stops)]) for x in (self.at, self.own))
            return at, own, self.posted[t + 1] - self.posted[t]
        blocks = self.blocked[t + 1] - self.blocked[t]
        entry = _ranges(self.blocked[t], blocks)
        held = live[self.block[entry]]
        sizes = np.where(held, self.first[entry + 1] - self.first[entry], 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(blocks)]
        at = _ranges(self.first[entry[held]], sizes[held])
        return self.at[at], self.own[at], np.diff(ends, prepend=0)

    def vote(self, counts: Counts, leave_one: int | None = None, near: list | None = None) -> tuple[float, list]:
        """(share of votes for label 1, evidence). ``leave_one``: this label is of a member that doesn't vote.
        ``near``: the neighbours, if known."""
        if not len(counts if isinstance(counts, dict) else counts[0]):
            n, pos = self.none_n - (leave_one is not None), self.none_pos - (leave_one or 0)
            return (pos + self.prior) / (n + 1), []
        near = self.nearest(counts) if near is None else near
        own = None
        if leave_one is not None:
            t, c = self._sorted(counts)
            own = self.group_of.get(t.tobytes() + c.tobytes())
        total, toxic = 0.1, 0.1 * self.prior
        for cos, g in near:
            n, pos = self.n[g], self.pos[g]
            if g == own:
                n, pos = n - 1, pos - leave_one
            if n > 0:
                w = cos * cos * math.sqrt(n)  # a large group speaks louder, not in proportion
                total += w
                toxic += w * pos / n
        return toxic / total, [(self.ids[g], cos, self.pos[g] / self.n[g]) for cos, g in near[:3]]

    def calibrate(self, examples: list[tuple[int, int, Counts]]) -> None:
        """Fit P(label 1) = sigmoid(slope * logit(vote) + offset) on examples, each without its own vote."""
        examples = [e for e in examples if len(e[2] if isinstance(e[2], dict) else e[2][0])]
        x = np.array([_logit(self.vote(counts, y)[0]) for _, y, counts in examples])
        y = np.array([y for _, y, _ in examples], float)
        if len(set(y.tolist())) < 2:
            return
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a little shrinkage towards (1, 0)
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + 0.01 * b])
            q = p * (1 - p)
            h = np.array([[(q * x * x).sum() + 1, (q * x).sum()], [(q * x).sum(), q.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
            if abs(step).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.offset = float(a), float(b)

    def score(self, text: str | None) -> tuple[float, str]:
        """(calibrated probability of label 1, evidence as id:cosine:share joined by commas)."""
        if not self.examples:
            return 0.0, ""
        text = text or ""
        told = self.kept.get(text)
        if told is None:
            counts = self.counts(text)
            vote, evidence = self.vote(counts)
            # without a known term the vote is a share of examples already
            told = vote if not counts else 1 / (1 + math.exp(-(self.slope * _logit(vote) + self.offset))), ",".join(f"{i}:{c:.4f}:{s:.3f}" for i, c, s in evidence)
            if len(self.kept) > 2_000:
                self.kept.clear()
            if len(text) < 5_000:
                self.kept[text] = told
        return told


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, most: int = FIT_ROWS) -> Index:
    """The index from labelled rows of docs(doc_id, text); document frequencies come from all of ``corpus``
    (docs, if not given).

    An id's label is the mean of its labels, ties going to 1; of several texts of an id the least counts. Null ids
    and labels are left out, null texts count as empty; other columns aren't looked at. Without any example
    all scores are 0.
    """
    corpus = docs if corpus is None else corpus
    named = one_label(labels, "toxic").where(fold(F.col("doc_id"), FOLDS) != HELD_FOLD)
    named = named.select(F.col("doc_id").cast("long").alias("id"), "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(named), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # `most` rows of 12 bytes

    def words(batches):
        for batch in batches:
            for i, y, text in zip(*(batch.column(k) for k in range(3))):
                counts = words_of(text.as_py())
                n = len(counts) or 1
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array([i.as_py()] * n, pa.int64()), "y": pa.array([y.as_py()] * n, pa.int32()), "term": pa.array(list(counts) or [None], pa.string()), "c": pa.array(list(counts.values()) or [0], pa.int32())}
                )

    said = cut(met.mapInArrow(words, "id long, y int, term string, c int"))
    shared = said.where("term is not null").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).where("n > 1").orderBy("term").toArrow()
    vocabulary = {t: k for k, t in enumerate(shared.column("term").to_pylist())}

    def frequencies(batches):
        release()
        seen, rows = np.zeros(len(vocabulary), np.int64), 0
        known = vocabulary.get
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                found = [t for w in {w.strip(_MARKS) for w in set((text.as_py() or "").lower().split())} if (t := known(w)) is not None]
                seen[found] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"t": pa.array([-1, *found.tolist()], pa.int32()), "n": pa.array([rows, *seen[found].tolist()], pa.int64())})

    counted = corpus.select(F.col("text").cast("string")).mapInArrow(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    everywhere = dict(zip(counted.column("t").to_pylist(), counted.column("n").to_pylist()))
    in_docs = np.array([everywhere.get(i, 0) for i in range(len(vocabulary))], float)

    def numbered(batches):
        known = vocabulary.get
        for batch in batches:
            t = pa.array([known(x, -1) for x in batch.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), t, batch.column(3)], names=["id", "y", "t", "c"])

    # numbers only, as Arrow arrays; an example without a known term keeps a row of term -1
    known = said.mapInArrow(numbered, "id long, y int, t int, c int").toArrow().sort_by("id")
    ids, ys, ts, cs = (known.column(k).to_numpy() for k in range(4))
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    told = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(ids)]):
        real = ts[lo:hi] >= 0
        told.append((int(ids[lo]), int(ys[lo]), (ts[lo:hi][real], cs[lo:hi][real])))
    scale = (np.log((1 + everywhere.get(-1, 0)) / (1 + in_docs)) + 1) * (FLOOR + _phi2(shared, len(told), sum(y for _, y, _ in told)))
    index = Index(vocabulary, scale, told)
    index.calibrate(sorted(told, key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0]))[:CALIBRATE_ROWS])
    return index


def _phi2(shared: pa.Table, rows: int, positive: int) -> np.ndarray:
    """Squared correlation of each term's presence with the label."""
    n, a = (np.array(shared.column(k).to_pylist(), float) for k in ("n", "pos"))
    off = a * rows - n * positive
    return off * off / np.maximum(n * (rows - n) * positive * (rows - positive), 1.0)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) for each row of docs(doc_id, text): 0 to 1, higher if label 1 is likelier.

    A null text counts as empty; texts without a known term get the share of label 1 among such examples.
    Without any example all scores are 0. Equal texts have equal scores; repeated rows repeat, an empty table has none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shipped.value
        for batch in batches:
            told = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in told], pa.float64()), pa.array([e for _, e in told], pa.string())], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, evidence string")


def accept(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; null texts count as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def run(batches):
        release()
        own = shipped.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py())[0] < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
