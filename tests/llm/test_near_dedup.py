"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import pytest

from fragspark.llm import simhash


@pytest.mark.parametrize("busy", [2, 32])
def test_near_dedup(spark, monkeypatch, busy):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "WIDE_BUSY", busy)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(8):
        base = [rng.choice(words) for _ in range(150)]
        for copy in range(6):
            text = list(base)
            for _ in range(copy % 4):
                text[rng.randrange(150)] = "changed%d" % rng.randrange(1000)
            rows.append((len(rows), " ".join(text)))
    rows += [(7, "one id, another text of its own"), (None, "no id, first text of these"), (None, "no id but a second different text"), (None, rows[0][1]), (60, ""), (61, None)]
    sets = [frozenset(tuple(w[k : k + 5]) for w in [(t or "").split()] for k in range(max(1, len(w) - 4))) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    masks = simhash.covering_masks(simhash.WIDE_RADIUS, simhash.PARTS)
    wide, prints = 0, [simhash.fingerprint(t, 5) for _, t in rows]
    for i, a in enumerate(sets):
        for k in range(i):
            if len(a & sets[k]) >= 0.8 * len(a | sets[k]):
                apart = prints[i] ^ prints[k]
                meets = any(not apart & m for m in masks)
                assert meets or apart.bit_count() > simhash.WIDE_RADIUS
                if not meets or apart.bit_count() > simhash.LOOSE:
                    continue
                wide += apart.bit_count() > 2
                x, y = top(i), top(k)
                root[max(x, y)] = min(x, y)
    assert wide > 10
    rows += rows[:3]  # of equal rows one stays
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = []
    for r in set(map(top, range(len(sets)))):
        ids = [rows[i] for i in range(len(sets)) if top(i) == r]
        want.append(min(ids, key=lambda x: (x[0] is None, x[0] or 0)))
    assert got == sorted(want, key=repr)


def test_wide_masks():
    """Any two fingerprints within the radius agree on all bits of some mask."""
    rng = random.Random(7)
    for radius, parts, tables in ((2, 1, 7), (3, 1, 15), (5, 2, 14), (11, 2, 126), (9, 2, 62)):
        masks = simhash.covering_masks(radius, parts)
        assert len(masks) == tables
        for _ in range(300):
            apart = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, radius + 1)))
            assert any(not apart & m for m in masks)


def test_near_dedup_odd(spark):
    schema = "doc_id long, text string, i long, K string, fp long, n int, class string, r string, _i string"
    assert simhash.keep_one(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(k, t, 0, "x", 1, 2, "c", "r", "z") for k, t in enumerate([None, "", " \n", long, long + " end", "one", "two", "one"])]
    out = simhash.keep_one(spark.createDataFrame(rows, schema))
    assert out.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 5, 6]


@pytest.mark.parametrize("busy", [2, 32])
def test_near_dedup_whole(spark, monkeypatch, busy):
    """Every pair of Jaccard 0.8 is linked, however far its fingerprints are apart, and also in busy buckets."""
    monkeypatch.setattr(simhash, "WIDE_BUSY", busy)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(100_000)}"
    texts = []
    for _ in range(40):  # 8 / 10 shingles are enough, 8 / 11 aren't
        base = [word() for _ in range(12)]
        texts += [base, [word(), *base, word()], [word(), word(), *base, word()]]
    passage = [word() for _ in range(60)]
    for _ in range(6):  # groups that all share a passage and meet in its buckets
        own = [*passage, *[word() for _ in range(22)]]
        texts += [own, [*own, word()], [*own, *[word() for _ in range(8)]], [*own[20:], *[word() for _ in range(9)]]]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    prints = [simhash.fingerprint(" ".join(t), 5) for t in texts]
    masks = simhash.covering_masks(simhash.WIDE_RADIUS, simhash.PARTS)
    root, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for k in range(i):
            if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]):
                apart = prints[i] ^ prints[k]
                far += apart.bit_count() > simhash.LOOSE or all(apart & m for m in masks)
                a, b = sorted((root[i], root[k]))
                root = [a if r == b else r for r in root]
    assert far > 1 and 40 < len(set(root)) < len(texts) - 40
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(root))


def test_workers_let_tables_go(spark):
    """A worker that encoded texts keeps no tables of it once it takes part in another stage."""
    from fragspark.llm import bpe, common

    def held(batches):
        bpe._codecs[b"x"] = "a codec"
        common.release()
        for batch in batches:
            yield batch.slice(0, len(bpe._codecs))

    assert spark.range(4).mapInArrow(held, "id long").count() == 0


def _far_apart(rows=500, near=8):
    """Texts of random words, of which the last few are near copies of the first."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(200)) for _ in range(rows)]
    return [*texts, *[t + " end" for t in texts[:near]]]


def test_near_dedup_disk(spark):
    """Only texts that a pair needs are shuffled for it, and tables on the way go; before, each step shuffled all texts."""
    from pathlib import Path

    from fragspark.storage import shared_dir

    texts, shared = _far_apart(), shared_dir(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).checkpoint()
    store, gate = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    states, shares = gate.jvm.java.util.ArrayList(), gate.new_array(gate.jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(states, False, False, shares, states)
        return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))

    began = written()
    out = simhash.keep_one(docs)
    assert written() - began < sum(map(len, texts))  # the texts themselves once, by the result alone
    assert out.count() == len(texts) - 8
    assert not list(Path(shared.removeprefix("file:")).glob("scratch-*/*"))


def test_near_dedup_jobs(spark):
    """Components of a few links take one task, not rounds whose plans and tasks stay in the driver's memory."""
    rng = random.Random(3)
    base = [f"{rng.getrandbits(60):x}" for _ in range(200)]
    texts = [" ".join([*base[k * 6 :], *[f"n{k}x{j}" for j in range(k * 6)]]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.sparkContext.setJobGroup("near_dedup_jobs", "")
    try:
        assert simhash.keep_one(docs).count() == 37
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near_dedup_jobs")) < 100  # 130 before


def test_components_at_once(spark):
    """Joined up by one task or in rounds: the same roots, of names as of numbers."""
    from fragspark.llm.components import components

    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(350)]
    for kind, name in (("long", lambda x: x), ("binary", lambda x: bytes([100 + (x >> 8), x & 255]))):
        table = spark.createDataFrame([(name(u), name(v)) for u, v in edges], f"u {kind}, v {kind}")
        one, rounds = ({(r.node, r.root) for r in components(table, at_once=n).collect()} for n in (1000, 0))
        assert one == rounds and len({r for _, r in one}) > 20
