"""The corpus pipeline on a small table against its stages by brute force."""

import random
import re

from fragspark.llm import secrets
from tests.llm.test_text_operators import brute_fingerprint, prose


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 8 == 3
        text = prose(rng, 40) + (" awful, horrid nasty" if toxic else "") + (' token = "' + "%040x" % rng.getrandbits(160) + '" tail' if i % 5 == 0 else "")
        rows.append((i, text if i % 30 != 7 else rows[i - 1][1], "en", f"s{i % 3}", 0))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    step = corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path))
    left = {r.doc_id: r.text for r in step.collect()}
    assert step.columns == columns and left == {i: t for i, t, *_ in rows if "awful" not in t}
    step = corpus_pipeline.near_dedup(spark, spark.createDataFrame([r for r in rows if r[0] in left], docs.schema), str(tmp_path))
    texts = {r.doc_id: r.text for r in step.collect()}
    prints = {i: brute_fingerprint(t) for i, t in left.items()}
    assert all(any((prints[i] ^ prints[k]).bit_count() <= 2 for k in texts) for i in left)
    assert all((prints[a] ^ prints[b]).bit_count() > 2 for a in texts for b in texts if a < b)
    step = corpus_pipeline.secret_removal(spark, step, str(tmp_path))
    clean = {r.doc_id: r for r in step.collect()}
    assert clean.keys() == texts.keys() and step.columns == columns
    assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.values())
    assert any("<SECRET>" in r.text for r in clean.values())
    mixed = corpus_pipeline.source_mix(spark, step, str(tmp_path))
    assert mixed.columns == columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    total = sum(words.values())
    assert all(abs(words[f"s{k}"] / total - (k + 1) / 6) < 0.03 for k in range(3))
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows_out = out.collect()
    assert rows_out and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows_out)
    assert {r.doc_id for r in rows_out} <= texts.keys()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, y string, fp string, copies int, _id string, key string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, blank and very long texts, ties, repeats, null and repeated ids, and columns of clashing names."""
    import corpus_pipeline

    rng = random.Random(22)
    base, long = prose(rng, 60), prose(rng, 30_000)
    texts = [(0, None), (1, ""), (2, " \n"), (3, base), (4, base), (4, prose(rng, 40)), (None, prose(rng, 40)), (None, base), (5, long), (6, long + " end"), (7, base + ' token = "' + "ab12" * 9 + '"'), (8, "one"), (9, prose(rng, 45) + " awful")]
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 2}", len(t or ""), 0.5, 1, "y", "f", 2, "z", "k") for k, (i, t) in enumerate(texts)]
    rows += [rows[3], rows[6]]
    labelled = [(100 + k, prose(rng, 30) + (" awful" if k % 4 == 0 else ""), "en", "s1", 0, 0.5, 1, "y", "f", 2, "z", "k") for k in range(80)]
    docs = spark.createDataFrame(rows + labelled, COLUMNS)
    spark.createDataFrame([(100 + k, 1, int(k % 4 == 0)) for k in range(80)] + [(3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        path = f"{tmp_path}/{name}"
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        told = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            assert before - len(told) == 21 and not any("awful" in (t or "") for _, t in told)
        if name == "near_dedup":
            own = {t for t in told if t[0] is None or t[0] < 100}
            assert {i for i, _ in own} == {0, 3, 4, None, 5, 8} and len(own) == 6 and (5, long) in own and (3, base) in own
            assert len(told) == len(set(told))
        if name == "secrets":
            assert len(told) == before and not any("ab12" in (t or "") for _, t in told) and (0, None) in told
            assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        if name == "mixing":
            assert told and all((t or "").split() for _, t in told)
    out = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert len(out) == docs.count() and all(r.round_trip for r in out)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_small_batches(spark, tmp_path):
    """Stages bound what a worker is sent at once; before, the 12 MB here came as one batch."""
    import corpus_pipeline
    import pyarrow as pa
    from fragspark.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    name, read = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    rows = [(i, f"{i} " * 500_000, "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
    try:
        for _, stage in corpus_pipeline.STAGES:
            if stage is not corpus_pipeline.source_mix:  # has no Python workers
                spark.conf.unset(name), spark.conf.unset(read)
                stage(spark, docs, str(tmp_path))
                told = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
                assert max(told) < 8_000_000 and sum(told) > 12_000_000
                assert spark.conf.get(read) == str(common.BATCH_ROWS)
        for own, rows, then in (("1000", "100", ("1000", "100")), ("64MB", "9999", (str(common.BATCH_BYTES), str(common.BATCH_ROWS)))):
            spark.conf.set(name, own), spark.conf.set(read, rows)
            common.small_batches(spark)
            assert (spark.conf.get(name), spark.conf.get(read)) == then
    finally:
        spark.conf.unset(name), spark.conf.unset(read)


def test_codec_makes_room(monkeypatch):
    """A worker's first codec comes when the tables of other stages are gone; a smaller cache gives the same ids."""
    from fragspark.llm import bpe, common
    from fragspark.llm.queries import vocabulary_path

    monkeypatch.setattr(common, "_kept", [bpe._codecs])
    data, left = bpe.read_vocabulary(vocabulary_path()), common.kept_in_worker({1: "left by another stage"})
    bpe._codecs.clear()
    own = bpe.codec(data)
    assert not left and own.kept == bpe.KEPT
    rng = random.Random(23)
    texts = [prose(rng, 300) for _ in range(40)]
    whole = [x.tolist() for t in texts for x in own.encode([t])]
    own.now, own.before = {}, {}
    assert bpe.codec(data, 50) is own
    assert [x.tolist() for t in texts for x in own.encode([t])] == whole and len(own.now) + len(own.before) < 1_500
    bpe._codecs.clear()
