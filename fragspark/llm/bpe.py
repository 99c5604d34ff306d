"""BPE encoding by speculation and verification, and decoding.

For pieces not seen before, greedy longest match proposes tokens. A proposal is the true encoding exactly
if every adjacent pair of its tokens is compatible, that is, if merging the bytes of the pair from scratch
gives the pair back (and, for a lone token, if its bytes merge back to it). All pairs of a batch are looked
up at once in a sorted table of verdicts; pairs without a verdict get one by exact merging and keep it. Only
pieces with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, release, spans_of
from .vocabulary import KEPT, LONGEST_KEPT, PATTERN, Vocabulary, parts_of

#: Verdicts on pairs of tokens that are kept at most; beyond that the table starts anew.
PAIRS_KEPT = 2_000_000


#: Rank of a pair that doesn't merge.
_NEVER = 1 << 40


def merge_exactly(data: bytes, v: Vocabulary) -> list[int]:
    """The encoding of one piece by its definition: again and again the first pair of lowest rank merges."""
    ids = list(map(v.byte_id.__getitem__, data))
    if len(ids) > 64:
        return _merge_long(ids, v)
    size, made, rank_of = v.size, v.made, v.rank_of.get
    ranks = [rank_of(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]
    while ranks:
        least = min(ranks)
        if least == _NEVER:
            break
        at = ranks.index(least)
        ids[at : at + 2] = [made[least]]
        del ranks[at]
        if at:
            ranks[at - 1] = rank_of(ids[at - 1] * size + ids[at], _NEVER)
        if at < len(ranks):
            ranks[at] = rank_of(ids[at] * size + ids[at + 1], _NEVER)
    return ids


def _merge_long(ids: list[int], v: Vocabulary) -> list[int]:
    """The same for long pieces, with a heap of (rank, place) over a linked list."""
    size, made, rank_of, n = v.size, v.made, v.rank_of.get, len(ids)
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] * size + ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or rank_of(ids[i] * size + ids[j]) != rank:
            continue  # one of the two has merged otherwise meanwhile
        ids[i], ids[j], after[i] = made[rank], -1, after[j]
        if after[i] < n:
            ahead[after[i]] = i
        for a in (ahead[i], i):
            if a >= 0 and after[a] < n and (r := rank_of(ids[a] * size + ids[after[a]])) is not None:
                heapq.heappush(heap, (r, a))
    return [x for x in ids if x >= 0]


class Speculator:
    """Encodes lists of pieces (bytes); counts how many proposals held."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.longest: dict[bytes, int] = {}
        for token in v.id_of:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 1), len(token))
        self.lone: dict[int, bool] = {}
        self.keys, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        self.held = self.merged = 0

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match from the left."""
        id_of, longest, out, at, n = self.v.id_of, self.longest, [], 0, len(data)
        while at < n:
            stop = min(n, at + longest.get(data[at : at + 2], 1))
            while (i := id_of.get(data[at:stop])) is None:
                stop -= 1
            out.append(i)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of neighbouring tokens: do their joined bytes encode to just these two?"""
        keys = a * self.v.size + b
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        fresh = np.unique(keys[~known])
        if len(fresh):
            tokens, size = self.v.token_bytes, self.v.size
            told = np.fromiter((merge_exactly(tokens[k // size] + tokens[k % size], self.v) == [k // size, k % size] for k in fresh.tolist()), bool, len(fresh))
            if len(self.keys) + len(fresh) > PAIRS_KEPT:  # this batch's pairs stay
                used = np.isin(self.keys, keys)
                self.keys, self.verdicts = self.keys[used], self.verdicts[used]
            joined = np.concatenate([self.keys, fresh])
            order = np.argsort(joined, kind="stable")
            self.keys, self.verdicts = joined[order], np.concatenate([self.verdicts, told])[order]
            at = np.searchsorted(self.keys, keys)
        return self.verdicts[at]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.propose(w) for w in words]
        if not proposed:
            return []
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        good = np.ones(len(words), bool)
        if inner.any():
            fits = self.compatible(flat[:-1][inner], flat[1:][inner])
            good[owner[1:][inner][~fits]] = False
        for k in np.flatnonzero(sizes == 1).tolist():
            i = proposed[k][0]
            if i not in self.lone:
                self.lone[i] = merge_exactly(self.v.token_bytes[i], self.v) == [i]
            good[k] = self.lone[i]
        for k in np.flatnonzero(~good).tolist():
            proposed[k] = merge_exactly(words[k], self.v)
        self.held += int(good.sum())
        self.merged += int((~good).sum())
        return proposed


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, v: Vocabulary, kept: int = KEPT) -> None:
        self.v, self.kept = v, kept
        self.speculator = Speculator(v)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.decimal = list(map(str, range(v.size)))

    def _pieces(self, part: str) -> list[str]:
        if part.isalpha() or part[:1] == " " and part[1:].isalpha():
            return [part]
        if self.special and any(s in part for s in self.v.special):
            out = []
            for k, x in enumerate(self.special.split(part)):
                out += [x] if k % 2 else self.pattern.findall(x)
            return out
        return self.pattern.findall(part)

    def _learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Have all these parts in the cache; long ones come back in a table for this call only."""
        if len(self.now) > self.kept:
            self.now, self.before = {}, self.now
        fresh = []
        for part in wanted.difference(self.now):
            if (ids := self.before.get(part)) is None:
                fresh.append(part)
            else:
                self.now[part] = ids
        split = [self._pieces(p) for p in fresh]
        special = self.v.special
        words = list(dict.fromkeys(w for p in split for w in p if w not in special))
        own = dict(zip(words, self.speculator.encode([w.encode("utf-8", "surrogatepass") for w in words])))
        own.update({s: [i] for s, i in special.items()})
        once = {}
        for part, ws in zip(fresh, split):
            ids = np.array([i for w in ws for i in own[w]], self.v.dtype).tobytes()
            (self.now if len(part) <= LONGEST_KEPT else once)[part] = ids
        return once

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        taken = [parts_of(t) for t in texts]
        once = self._learn(set().union(*taken))
        get = (lambda p: self.now[p] if p in self.now else once[p]) if once else self.now.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), self.v.dtype) for parts in taken]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[bytes, Codec] = kept_in_worker({})


def codec(data: bytes, kept: int = KEPT) -> Codec:
    """One codec for each Python worker and vocabulary; the first makes the worker let go of other stages' tables."""
    key = hashlib.sha256(data).digest()
    if key not in _codecs:
        if not _codecs:
            release()
        _codecs[key] = Codec(Vocabulary(data))
    _codecs[key].kept = kept
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary_path: str, digests: bool = False, decoded: bool = True, kept: int = KEPT) -> DataFrame:
    """Encode docs(doc_id, text) and decode again.

    Returns for each row doc_id, n_tokens and round_trip (the decoded text equals the text); with
    ``digests`` ids_sha256 and decoded_sha256 beside them, else ids (array of int) and, if wanted, decoded. A null
    text counts as empty and gives no ids. Repeated rows give repeated results, an empty table none. Other columns
    are not looked at. Texts leave Arrow, and results enter it, piece by piece. Workers keep about ``kept`` encoded parts
    in each of two generations.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        c = codec(shipped.value, kept)
        decimal = c.decimal.__getitem__
        for batch in batches:
            for a, b in spans_of(batch.column(1)):
                texts = [x.as_py() or "" for x in batch.column(1).slice(a, b - a)]
                columns: list[list] = [[], [], [], []]
                for text, found in zip(texts, c.encode(texts)):
                    ids = found.tolist()
                    back = c.decode(ids)
                    row = [len(ids), back == text]
                    if digests:
                        row += [hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()]
                    else:
                        row += [found.astype(np.int32), back]
                    for column, x in zip(columns, row):
                        column.append(x)
                arrays = [batch.column(0).slice(a, b - a), *(pa.array(x, k) for x, k in zip(columns[: len(names) - 1], kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = (pa.int64(), pa.bool_(), pa.string() if digests else pa.list_(pa.int32()), pa.string())
    names = ["doc_id", "n_tokens", "round_trip", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")[: 1 + decoded])]
    told = ["long", "long", "boolean", "string" if digests else "array<int>", "string"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, told)))
