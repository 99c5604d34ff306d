"""Genomic relations derived from the driver's tables, as SQL that Spark and DuckDB both run.

``{lineitem}`` and the like stand for tables, ``{OFF}``, ``{K}``, ``{I}`` and ``{EDIV}`` for what the two dialects spell differently.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .operators.sequence import characters, pieces

VIEWS = {
    "frag": """select 'chr' || cast(1 + l_suppkey % 5 as string) as chrom,
  l_partkey*40 + (l_orderkey*13 + l_linenumber*7) % 40 as start_pos,
  l_partkey*40 + (l_orderkey*13 + l_linenumber*7) % 40 + 30 + (l_orderkey*31 + l_linenumber*17 + cast(l_quantity as bigint)*19) % 371 as end_pos,
  cast(l_orderkey % 61 as int) as mapq, case when l_returnflag = 'R' then '-' else '+' end as strand,
  cast(l_discount*8 + 0.5 as double) as gc_weight from {lineitem}""",
    "chroms": "select chrom, max(end_pos) + 1000 as chrom_len from {frag} f group by chrom",
    "win": """select 'chr' || cast(1 + p_partkey % 5 as string) as chrom, p_partkey*40 as start_pos,
  p_partkey*40 + 50 + p_size*20 as end_pos, p_brand as group_name, p_partkey as window_idx, p_retailprice as score from {part}""",
    "bl": """select 'chr' || cast(1 + s_suppkey % 5 as string) as chrom, s_suppkey*811 as start_pos,
  s_suppkey*811 + 100 + s_nationkey*20 as end_pos from {supplier}""",
    "site": """select 'chr' || cast(1 + c_custkey % 5 as string) as chrom, c_custkey*53 as start_pos, c_custkey*53 + 201 as end_pos,
  c_mktsegment as group_name, case when c_custkey % 3 = 0 then '-' else '+' end as strand, c_custkey as site_idx from {customer}""",
    # all documents to their ends; pieces keep the cost of a position flat in long texts
    "seq": """select doc_id, off + k - 1 as pos, substr('ACGTN', 1 + ascii(substr(piece, cast(k as int), 1)) % 5, 1) as base
  from (select doc_id, off, piece, {K} as k from (select doc_id, off, substr(text, cast(off as int) + 1, 1000) as piece
    from (select doc_id, text, {OFF} as off from {documents} where length(text) > 0) o) p) t""",
    "seqfrag": """select doc_id, i*50 + (doc_id*7 + i*3) % 40 as start_pos,
  i*50 + (doc_id*7 + i*3) % 40 + 30 + (doc_id*11 + i*13) % 120 as end_pos
  from (select doc_id, n_chars, {I} as i from {documents} where n_chars > 0) t
  where i*50 + (doc_id*7 + i*3) % 40 + 30 + (doc_id*11 + i*13) % 120 <= n_chars""",
    # two windows that overlap in every document
    "docwin": """select doc_id, 40 as start_pos, 400 as end_pos, 'a' as window_name from {documents} union all select doc_id, 301, 907, 'b' from {documents}""",
    "read": """select event_id as read_id, pair_id as qname, 'chr' || cast(1 + pair_id % 5 as string) as chrom,
  case when is_rev then base_pos + 20 + pair_id % 200 - (case when pair_id % 23 = 0 then 300 else 0 end) else base_pos end as pos,
  20 + event_id % 30 as aligned_len,
  case when is_rev then 16 else 0 end + (case when event_id % 2 = 0 then 64 else 128 end) + 1 + (case when event_id % 29 = 0 then 1024 else 0 end) as flag,
  cast(event_id % 61 as int) as mapq,
  case when event_id % 13 = 0 then null when event_id % 19 = 0 then -1.0 else floor(value) / 100 + 0.25 end as gc_tag
  from (select event_id, value, {EDIV} as pair_id, ({EDIV}) * 37 % 50000 + 400 as base_pos,
    (event_id % 2 = 1) and (({EDIV}) % 17 <> 0) as is_rev from {events}) e""",
    # alignments with clips and up to two indels, whose parts are columns beside the CIGAR; one mate of a pair each
    "aln": """select *, concat(case when hard then '3H' else '' end, case when s1 > 0 then concat(s1, 'S') else '' end, m1, 'M', case when k1 <> '' then concat(n1, k1) else '' end, m2, 'M',
    case when k2 <> '' then concat(n2, k2) else '' end, m3, 'M', case when s2 > 0 then concat(s2, 'S') else '' end) as cigar,
  substr(translate(concat(md5(cast(read_id as string)), md5(concat(read_id, 'b')), md5(concat(read_id, 'c'))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(read_len as int)) as seq, {QUAL} as qual
  from (select *, s1 + m1 + case when k1 = 'I' then n1 else 0 end + m2 + case when k2 = 'I' then n2 else 0 end + m3 + s2 as read_len,
    pos + m1 + case when k1 in ('D', 'N') then n1 else 0 end + m2 + case when k2 in ('D', 'N') then n2 else 0 end + m3 as end_pos
  from (select read_id, qname, rev, 'chr' || cast(1 + qname % 5 as string) as chrom, mapq, flag, base + shift as pos, hard, s1, s2,
    case when rev and qname % 3 = 0 then greatest(1, 8 + qname % 20 - shift) when rev then 8 + read_id % 20 else 8 + qname % 20 end as m1,
    case (qname + case when rev and qname % 4 = 0 then 1 else 0 end) % 5 when 1 then 'D' when 2 then 'I' when 3 then 'N' when 4 then 'D' else '' end as k1,
    1 + qname % 3 + case when rev then read_id % 2 else 0 end as n1, 5 + read_id % 10 as m2, case read_id % 7 when 0 then 'I' when 1 then 'D' when 2 then 'D' else '' end as k2, 1 + read_id % 4 as n2, 6 + read_id % 12 as m3
  from (select event_id as read_id, {EDIV} as qname, event_id % 2 = 1 as rev, cast(event_id % 61 as int) as mapq,
    case when event_id % 2 = 1 then 16 + 128 else 64 end + 1 + (case when event_id % 29 = 0 then 1024 else 0 end) as flag, ({EDIV}) * 37 % 50000 + 400 as base,
    case when event_id % 2 = 1 then ({EDIV}) * 7 % 90 - (case when ({EDIV}) % 19 = 0 then 200 else 0 end) else 0 end as shift,
    event_id % 31 = 0 as hard, case when event_id % 6 < 2 then event_id % 5 else 0 end as s1, case when event_id % 4 < 2 then event_id % 8 else 0 end as s2 from {events}) a) b) c""",
}
_SPARK = {
    "OFF": "explode(sequence(0, length(text) - 1, 1000))", "K": "explode(sequence(1, length(piece)))", "I": "explode(sequence(0, n_chars div 50))", "EDIV": "event_id div 2",
    "QUAL": "transform(sequence(0, read_len - 1), i -> cast(10 + (read_id * 7 + i * 11) % 31 as int))",
}
_DUCK = {
    "OFF": "unnest(generate_series(0, length(text) - 1, 1000))", "K": "unnest(generate_series(1, length(piece)))", "I": "unnest(generate_series(0, n_chars // 50))", "EDIV": "event_id // 2",
    "QUAL": "list_transform(range(0, read_len), lambda i: cast(10 + (read_id * 7 + i * 11) % 31 as int))",
}


def _filled(sql: str, words: dict[str, str], table) -> str:
    def word(m: re.Match) -> str:
        name = m[1]
        return words.get(name) or (_filled(_wrapped(VIEWS[name]), words, table) if name in VIEWS else table(name))

    return re.sub(r"\{(\w+)\}", word, sql)


def duck(sql: str) -> str:
    """A query over {frag}, {win} and so on, with these spelled out for DuckDB."""
    return _filled(_wrapped(sql), _DUCK, lambda n: n)


def _wrapped(sql: str) -> str:
    """Views are put in parentheses where the query names them."""
    return re.sub(r"\{(frag|chroms|win|bl|site|seq|seqfrag|read|aln|docwin)\}", r"({\1})", sql)


@functools.cache
def _spark_sql(name: str, sf_dir: str) -> str:
    return _filled(_wrapped(VIEWS[name]), _SPARK, lambda n: f"parquet.`{sf_dir}/{n}.parquet`")


def chunks(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    """The sequence of the view ``seq`` as chunks(chrom, chunk_start, seq), each with so many bases of what follows.

    Cut from whole texts, as a reference file is read, without a row for each base.
    """
    named = spark.sql(f"select concat('d', doc_id) as chrom, cast(text as string) as text from parquet.`{sf_dir}/documents.parquet` where length(text) > 0")
    letters = np.frombuffer(b"ACGTN", np.uint8)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                codes, at = characters(part.column("text"))
                n = np.diff(at)
                bases, cuts = letters[codes % 5], (n + size - 1) // size
                row = np.repeat(np.arange(len(n)), cuts)
                off = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
                long = np.minimum(n[row] - off, size + overlap)
                ends = np.concatenate([[0], np.cumsum(long)])
                seq = bases[np.repeat(at[row] + off - ends[:-1], long) + np.arange(ends[-1])]
                seq = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(seq)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("chrom").take(pa.array(row)), pa.array(off, pa.int64()), seq], names=["chrom", "chunk_start", "seq"])

    return named.mapInArrow(run, "chrom string, chunk_start long, seq string")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by its name; ``chunks:SIZE:OVERLAP`` names the sequence in chunks."""
    if name.startswith("chunks:"):
        size, overlap = map(int, name.split(":")[1:])
        return chunks(spark, sf_dir, size, overlap)
    return spark.sql(_spark_sql(name, sf_dir))
