"""Quality classifier: a byte-level convolutional network in numpy, trained here.

Each byte becomes one of 512 symbols: its value, and whether the six bytes that end with it were seen at a distance of up
to ECHO bytes before (plain repetition, which no sum over bytes can see). Filters of WIDTH symbols run over every
position of the whole text; as symbols are few, a filter is WIDTH lookups. Rectified outputs are averaged over
chunks of 2 * HALF bytes that overlap by half, a hidden layer reads each chunk, its units are max-pooled over all
chunks, and one logistic unit gives the probability of label 1. Nothing is cut off: a text of any length is covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, one_label, pieces

#: At most this many labelled rows, those of the least hashed ids, of at most so many bytes each, are used for training.
FIT_ROWS, FIT_BYTES = 2400, 50_000
#: Rows of this fold (crc32 of the id modulo FOLDS) are never trained on.
FOLDS, HELD_FOLD = 5, 0
#: Score from which a text is called good.
THRESHOLD = 0.3
WIDTH, FILTERS, HIDDEN, HALF, ECHO = 4, 10, 8, 128, 36
EPOCHS, BATCH, RATE, SEED = 8, 48, 0.02, 7
#: Bytes of a training batch (one text may have more), and bytes beyond which a text is read in stretches.
BATCH_BYTES, LONG = 400_000, 1_000_000
PAD = 512
_NEVER = np.float32(-1e4)


def blocks_of(size: int) -> int:
    """Blocks of HALF places that a text of so many bytes takes, with at least WIDTH - 1 of padding."""
    return -(-(size + WIDTH - 1) // HALF)


def symbols(data: bytes) -> np.ndarray:
    """A symbol for each byte, PAD behind them to the end of the last block."""
    n = len(data)
    out = np.full(blocks_of(n) * HALF, PAD, np.int16)
    raw = np.frombuffer(data, np.uint8)
    out[:n] = raw
    if n > 6:
        x = raw.astype(np.uint32)
        six = np.zeros(n - 5, np.uint32)
        with np.errstate(over="ignore"):
            for j in range(6):
                six = six * np.uint32(0x01000193) + x[j : n - 5 + j]
        echo = np.zeros(n - 5, bool)
        for lag in range(2, min(ECHO, n - 6) + 1):
            np.logical_or(echo[lag:], six[lag:] == six[:-lag], out=echo[lag:])
        out[5:n][echo] += 256
    return out


class Layout:
    """Texts of a batch side by side: their blocks of HALF symbols, and chunks of two blocks."""

    def __init__(self, sizes: list[int]) -> None:
        blocks = np.array([blocks_of(n) for n in sizes])
        chunks = np.maximum(1, blocks - 1)
        starts = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        self.first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
        self.doc = np.repeat(np.arange(len(sizes)), chunks)
        self.left = np.repeat(starts, chunks) + np.arange(len(self.doc)) - np.repeat(self.first, chunks)
        self.right = self.left + (np.repeat(blocks, chunks) > 1)
        place = np.arange(int(blocks.sum())) - np.repeat(starts, blocks)
        real = np.clip(np.repeat(np.array(sizes), blocks) - place * HALF, 0, HALF)
        self.two = (self.right != self.left)[:, None]
        self.size = np.maximum(1, real[self.left] + np.where(self.two[:, 0], real[self.right], 0)).astype(np.float32)[:, None]


class Network:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.15, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        self.taps[:, PAD] = 0
        self.taps[0, PAD] = _NEVER  # no output at padding
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = rng.normal(0, 0.8, (FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.full(HIDDEN, 0.1, np.float32)
        self.w2 = rng.normal(0, 0.5, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.w1, self.b1, self.w2, self.b2]

    def _filtered(self, s: np.ndarray) -> np.ndarray:
        z = self.taps[0].take(s, axis=0)
        for j in range(1, WIDTH):
            z[:-j] += self.taps[j].take(s[j:], axis=0)
        z += self.bias
        return np.maximum(z, 0, out=z)

    def forward(self, texts: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Logits of the texts, and what the backward pass needs."""
        s = np.concatenate([symbols(t) for t in texts])
        a = self._filtered(s)
        x = Layout(list(map(len, texts)))
        logit, held = self._pooled(x, self._sums(a))
        return logit, (x, s, a, *held)

    @staticmethod
    def _sums(a: np.ndarray) -> np.ndarray:
        return a.reshape(-1, HALF, FILTERS).sum(axis=1)

    def _pooled(self, x: Layout, sums: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits from the filters' sums over each block."""
        mean = (sums[x.left] + sums[x.right] * x.two) / x.size
        h = np.maximum(mean @ self.w1 + self.b1, 0)
        pooled = np.maximum.reduceat(h, x.first, axis=0)
        return pooled @ self.w2 + self.b2[0], (mean, h, pooled)

    def gradients(self, held: tuple, d: np.ndarray) -> list[np.ndarray]:
        """Gradients for the derivative d of the loss by each logit."""
        x, s, a, mean, h, pooled = held
        dh = (d[:, None] * self.w2)[x.doc] * ((h == pooled[x.doc]) & (h > 0))
        dmean = (dh @ self.w1.T) / x.size
        dsum = np.zeros((len(s) // HALF, FILTERS), np.float32)
        np.add.at(dsum, x.left, dmean)
        np.add.at(dsum, x.right, dmean * x.two)
        busy = np.flatnonzero(dsum.any(axis=1))  # max-pooling leaves most blocks out
        at = (busy[:, None] * HALF + np.arange(HALF)).ravel()
        da = np.repeat(dsum[busy], HALF, axis=0) * (a[at] > 0)
        dtaps = np.zeros_like(self.taps)
        padded = np.concatenate([s, np.full(WIDTH, PAD, s.dtype)])
        for j in range(WIDTH):
            seen = padded[at + j]
            for f in range(FILTERS):
                dtaps[j, :, f] = np.bincount(seen, da[:, f], PAD + 1)
        dtaps[:, PAD] = 0
        return [dtaps, da.sum(axis=0), mean.T @ dh, dh.sum(axis=0), pooled.T @ d, d.sum(keepdims=True)]

    def fit(self, texts: list[bytes], y: np.ndarray, seed: int = SEED) -> Network:
        """Adam on the mean log loss, over batches of texts of a like length."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        order = np.array(sorted(range(len(texts)), key=lambda i: len(texts[i])))
        batches: list[list[int]] = []
        for i in order.tolist():
            if not batches or len(batches[-1]) == BATCH or (len(batches[-1]) + 1) * len(texts[i]) > BATCH_BYTES:
                batches.append([])
            batches[-1].append(i)
        share = y.mean() if len(y) else 0.5
        self.b2[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for k in rng.permutation(len(batches)):
                rows = batches[k]
                logit, held = self.forward([texts[i] for i in rows])
                d = ((1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)).astype(np.float32)
                step += 1
                for p, g, (m, v) in zip(self.parameters(), self.gradients(held, d), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        out = np.empty(len(texts))
        for a, b in pieces(texts, 200_000):
            if b - a == 1 and len(texts[a]) > LONG:
                out[a] = self._long(texts[a])
            else:
                out[a:b] = self.forward(texts[a:b])[0]
        return 1 / (1 + np.exp(-out))

    def _long(self, text: bytes) -> float:
        """The logit of a very long text, its filters run over stretches of whole blocks.

        A stretch is read with the bytes before it that echoes can reach and the WIDTH - 1 ones behind it, so its
        symbols and outputs are those of the whole text, and so are all chunks.
        """
        sums, step, back = [], 4096 * HALF, ECHO + 6
        places = blocks_of(len(text)) * HALF
        for at in range(0, places, step):
            begin, stop = max(0, at - back), min(places, at + step)
            s = symbols(text[begin : stop + WIDTH - 1])[at - begin :]
            s = np.concatenate([s, np.full(max(0, stop - at - len(s)), PAD, s.dtype)])
            sums.append(self._sums(self._filtered(s)[: stop - at]))
        return float(self._pooled(Layout([len(text)]), np.concatenate(sums))[0][0])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Network:
    """A network trained on the driver on at most ``most`` labelled rows outside the held-out fold.

    Rows of more than FIT_BYTES bytes are not trained on, so the sample is bounded in bytes. An id's label is the mean
    of its labels, ties going to 1; of several texts of an id the least counts. Null ids and labels are left
    out, null texts count as empty; other columns aren't looked at.
    """
    named = one_label(labels, "quality").where(fold(F.col("doc_id"), FOLDS) != HELD_FOLD)
    named = named.select(F.col("doc_id").cast("long").alias("id"), "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(named), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # `most` rows of 12 bytes
    rows = sorted((r.id, r.text, r.y) for r in met.collect())
    if not rows:
        return Network()
    return Network().fit([t.encode("utf-8", "surrogatepass") for _, t, _ in rows], np.array([y for *_, y in rows], np.float32))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text): the probability of label 1.

    Null and empty texts have a single empty chunk and get the network's score of it. Equal texts have equal
    scores but for rounding; repeated rows repeat, an empty table has none. Without any labelled row the network
    is untrained and says nothing.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        own = shipped.value
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
