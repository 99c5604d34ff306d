"""What the text operators share: words, shared storage, folds of the labelled rows."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settled, shared_dir

#: Characters that separate words: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: Documents are handled in pieces of about this many characters, so that memory stays flat.
PIECE_CHARS = 2_000_000


#: What modules keep in a Python worker from task to task.
_kept: list[dict] = []


def kept_in_worker(table: dict) -> dict:
    """The table, known to ``release``."""
    _kept.append(table)
    return table


def release() -> None:
    """Empty the tables that stages of another kind left in this Python worker, and give free memory back.

    Workers are used again for all stages of an application, so that their tables would add up.
    """
    for t in _kept:
        t.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: Bytes of rows that the pipeline's Python workers are sent at once, and rows of Parquet that are decoded at once; Spark's
#: defaults are 64 MB and 4,096 rows, of whole texts here.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Have this session handle rows in batches of at most BATCH_BYTES and BATCH_ROWS, or of fewer if it says so already.

    A batch is held several times over, by a worker, in the JVM and outside of its heap. Rows and results are the same.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most, told in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, size), ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS, int)):
        own = spark.conf.get(name, None)
        if own is None or told(own) > most:
            spark.conf.set(name, str(most))


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    ``few``: the table is small beside the texts; it goes to at most four files for each core, so that many rounds
    over many shuffle partitions don't leave tens of thousands of tiny files.
    """
    return settled(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism) if few else df)


@contextmanager
def scratch(spark: SparkSession):
    """A function that writes a table to the shared folder as Parquet and gives it back without its lineage; at the end all
    of its tables go. Unlike checkpoints they are compressed, and don't wait for the driver to collect its garbage."""
    top, paths = fresh_dir(spark, "scratch"), []

    def put(df: DataFrame, few: bool = False) -> DataFrame:
        paths.append(path := f"{top}/{len(paths)}")
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(top)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints that nothing refers to deleted now, and the plans behind them freed."""
    gc.collect()
    spark._jvm.System.gc()


def fresh_name(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys of the most rows that a spread join salts, and the tasks that each of them goes to.
HOT, SALTS = 10_000, 64


def join_spread(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with told on keys, where told has one row for each key and, in ``n``, how many of rows it meets.

    The HOT keys of the largest n are salted, so that their rows go to SALTS tasks each; any other key has less
    than a HOT-th of the rows. ``told`` is used three times: give a checkpoint. ``n`` isn't returned.
    """
    hot = told.where("n > 1").orderBy(F.desc("n"), *keys).limit(HOT).select(*keys, F.lit(True).alias("_hot"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = told.drop("n").join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")  # HOT rows at most
    spread = rows.join(F.broadcast(hot), keys, "left")
    spread = spread.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers of this application import the package from where the driver has it.

    Only matters where the package isn't installed on the executors but its folder is visible.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, parts: int):
    """Column: crc32 of the id as text, modulo parts; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, y) with one row for each labelled id: the mean of its labels, ties going to 1."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(name).cast("double")) >= 0.5).cast("int").alias("y"))
    )


def pieces(texts, chars: int = PIECE_CHARS):
    """Split a list of texts into runs of about so many characters; yields (from, to)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def spans_of(texts, size: int = PIECE_CHARS):
    """Split an Arrow column of texts into runs of about so many bytes, without taking them out; yields (from, to)."""
    told = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(told, dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to
