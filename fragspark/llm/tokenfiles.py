"""Token files: flat unsigned integers, 64-bit document offsets beside them, read through memory maps.

A token folder holds, for each partition of the documents in doc_id order,

* ``part-NNNNN.ids``      token ids, little-endian, 16 bits wide if the vocabulary fits, else 32;
* ``part-NNNNN.offsets``  n_docs + 1 little-endian 64-bit offsets into it, in tokens;
* ``part-NNNNN.docs``     n_docs little-endian 64-bit doc_ids, null ids (they come first) as 0;

and ``manifest.json``: width, and for each partition its counts and its base, the number of tokens before it.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_vocabulary
from .common import cut, fresh_dir
from .vocabulary import PartCache, byte_letters

END_ID = 0
#: Different parts that a worker keeps encoded, in each of two generations.
KEPT = 500_000
#: Partitions of a token folder that a task reads back at most, one after another.
PARTS_A_TASK = 64


def _open_store(uri: str):
    """(filesystem, path) for a URI or a plain path."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


_encoders: dict[bytes, tuple[PartCache, np.dtype]] = {}


def library_encoder(data: bytes) -> tuple[PartCache, np.dtype]:
    """Whole texts to ids with the tokenizers library; each different part is encoded once."""
    key = hashlib.sha256(data).digest()
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tool = Tokenizer.from_str(data.decode())
        tool.no_truncation()
        tool.no_padding()
        size = tool.get_vocab_size(with_added_tokens=True)
        kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        letter = {b: c for c, b in byte_letters().items()}
        model = tool.model

        def encode_part(part: str) -> bytes:
            if part.isalpha() or part[:1] == " " and part[1:].isalpha():  # one piece: straight to the model
                ids = [t.id for t in model.tokenize(part.encode().decode("latin-1").translate(letter))]
            else:
                ids = tool.encode(part, add_special_tokens=False).ids
            return np.array(ids, kind).tobytes()

        _encoders[key] = PartCache(encode_part, KEPT), kind
    return _encoders[key]


def write(docs: DataFrame, folder: str, vocabulary_path: str) -> DataFrame:
    """Encode docs(doc_id, text) into a token folder; returns its manifest with bases.

    Rows go in ascending doc_id order, null ids first, ties by a hash of the text; null texts count as empty; END_ID
    follows each document. Ranges are cut in this order, so rows of one id or without id spread over parts. Every task writes under a name of its own attempt and renames at its end, so
    a repeated task leaves the same files. Files are written through pyarrow's file systems.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        cache, kind = library_encoder(shipped.value)
        fs, root = _open_store(folder)
        task = TaskContext.get()
        name, own = f"part-{task.partitionId():05d}", f".{task.taskAttemptId()}"
        end = np.array([END_ID], kind).tobytes()
        offsets, ids, nulls, at = [0], [], 0, 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}.ids{own}") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    doc_id, text = doc_id.as_py(), text.as_py()
                    data = (cache.encode(text) if text else b"") + end
                    out.write(data)
                    at += len(data) // kind.itemsize
                    offsets.append(at)
                    nulls += doc_id is None
                    ids.append(doc_id or 0)
        for what, values in (("offsets", offsets), ("docs", ids)):
            with fs.open_output_stream(f"{root}/{name}.{what}{own}") as out:
                out.write(np.array(values, "<i8").tobytes())
        for what in ("ids", "offsets", "docs"):
            fs.move(f"{root}/{name}.{what}{own}", f"{root}/{name}.{what}")
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "docs": [len(ids)], "nulls": [nulls], "tokens": [at], "width": [kind.itemsize]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc_nulls_first()]
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    parts = cut(dealt.mapInArrow(run, "part long, docs long, nulls long, tokens long, width long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    based = cut(parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))))
    fs, root = _open_store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps([r.asDict() for r in based.orderBy("part").collect()]).encode())
    return based


def _mapped(fs, path: str, kind: str) -> np.ndarray:
    if not fs.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def documents_of(folder: str, part: int, nulls: int, width: int):
    """(doc_id, ids) of each document of one partition, as views of the mapped file."""
    fs, root = _open_store(folder)
    name = f"{root}/part-{part:05d}"
    ids, offsets, docs = (_mapped(fs, f"{name}.{what}", kind) for what, kind in (("ids", f"<u{width}"), ("offsets", "<i8"), ("docs", "<i8")))
    for k in range(len(docs)):
        yield (None if k < nulls else int(docs[k])), int(offsets[k]), ids[offsets[k] : offsets[k + 1]]


def read(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of a token folder: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                for doc_id, at, ids in documents_of(folder, row["part"], row["nulls"], row["width"]):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((doc_id, row["base"] + at, len(ids), crc, *([ids.tolist()] if with_ids else [])))
                    if len(rows) == 2000:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # by a number of its own: adaptive execution would put the few rows of the manifest into one task
    parts = manifest.count()
    tasks = max(1, min(parts, manifest.sparkSession.sparkContext.defaultParallelism), -(-parts // PARTS_A_TASK))
    return manifest.repartitionByRange(tasks, "part").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Write docs to a fresh token folder in the shared folder and read it back, without the ids."""
    folder = fresh_dir(docs.sparkSession, "tokens")
    return read(write(docs, folder, vocabulary_path), folder, with_ids=False)
