"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .linededup import SQL as LINE_DEDUP_SQL
from .rules import SQL as QUALITY_SQL


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix

    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytecnn import FOLDS, HELD_FOLD, THRESHOLD, fit, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = fold(F.col("doc_id"), FOLDS) == HELD_FOLD
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that loses a passage: the runs removed, whose earlier copies stay where, and the text left."""
    from .linededup import deduplicate

    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), changed_only=True)
    runs = F.transform("removed", lambda x: F.concat_ws(":", x["at"], x["stop"]))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["at"])
    return found.select(
        "doc_id", F.size("removed").cast("long").alias("n_runs"), chars.alias("n_chars_removed"), F.array_join(runs, ",").alias("removed"), F.array_join("kept_ids", ",").alias("kept_ids"), "text"
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), *base, "base_failed", "kept")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import neighbour_fingerprints

    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import FOLDS, HELD_FOLD, THRESHOLD, fit, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = fold(F.col("doc_id"), FOLDS) == HELD_FOLD
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def minhash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of every document whose id is divisible by 20 among all documents, by bands and exact Jaccard likeness."""
    from .minhash import matches

    docs = table(spark, sf_dir, "documents")
    return matches(docs.where("doc_id % 20 = 0"), docs)


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics and tests of ``op6_quality_rules`` alone, which SQL can express."""
    from .rules import LEAST_WORDS, MOST_REPEATED, statistics

    told = statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return told.select("doc_id", *base).withColumn("base_failed", failed)


def line_dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what line dedup leaves of its text."""
    from .linededup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "source", F.size("removed").cast("long").alias("n_runs"), "text")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_secrets, op3_byte_cnn, op4_line_dedup, op5_bpe, op6_quality_rules, op7_token_files, op8_simhash, op9_minhash, op10_toxicity, minhash_matches, quality_statistics, line_dedup_texts)}
LINE_DEDUP_TEXTS_SQL = f"select d.doc_id, d.source, coalesce(g.n_runs, 0) as n_runs, case when g.doc_id is null then d.text else g.text end as text from documents d left join ({LINE_DEDUP_SQL}) g on g.doc_id = d.doc_id"
ORACLES: dict[str, str] = {"op4_line_dedup": LINE_DEDUP_SQL, "quality_statistics": QUALITY_SQL, "line_dedup_texts": LINE_DEDUP_TEXTS_SQL}
