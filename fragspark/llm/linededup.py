"""Substring dedup by paragraph hashing: paragraphs are normalised, their digests grouped, the earliest kept.

A text is cut into clauses: at line feeds, and behind words that end in one of ``.!?,;:``. A paragraph is the
shortest run of whole clauses, from any clause on and across lines, that has LEAST_WORDS words. It is normalised
by lower-casing A-Z and joining its words with single spaces. Of all occurrences of a normalised paragraph, in
all documents, the first in rank (doc_id, null last; the text's hash; place) stays, and the others are removed. A removed
paragraph's words stand unremoved somewhere of lesser rank: each removal points to an earlier place, and such
a chain ends at a place that none covers. Repeats of fewer words than LEAST_WORDS stay, as they agree by chance.

Words are runs of characters other than space and the controls 9 to 13. Rows equal in doc_id and text count as
one document and are changed alike. Null texts stay null, empty ones empty. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_name, join_spread

#: Least words of a paragraph.
LEAST_WORDS = 30
_FLUSH = 100_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".!?,;:")] = True
_DIGEST = np.dtype([("d", "<i8"), ("c", "<i4")])
_ROW = ("last", "id", "key")


def _clauses(raw: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of a text in UTF-8: byte places where words start and end, and for each paragraph its first and past clause
    and its first and past word."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw], [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < least:
        return (starts, ends, *[np.zeros(0, np.int64)] * 4)
    feeds = np.flatnonzero(raw == 10)
    closes = _MARK[raw[ends - 1]]
    closes[:-1] |= np.searchsorted(feeds, starts[1:]) > np.searchsorted(feeds, ends[:-1])
    closes[-1] = True
    bounds = np.concatenate([[0], np.flatnonzero(closes) + 1])
    past = np.searchsorted(bounds, bounds[:-1] + least)
    first = np.flatnonzero(past < len(bounds))
    past = past[first]
    return starts, ends, first, past, bounds[first], bounds[past]


def paragraphs(data: bytes, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first clauses, digests) of the paragraphs of a text in UTF-8."""
    starts, ends, first, _, a, z = _clauses(np.frombuffer(data, np.uint8), least)
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, _DIGEST)
    plain = b" ".join(data.lower().split())
    begins = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    found = b"".join([hashlib.blake2b(plain[p:q], digest_size=12).digest() for p, q in zip(begins[a].tolist(), (begins[z] - 1).tolist())])
    return first.astype(np.int32), np.frombuffer(found, _DIGEST)


def runs(data: bytes, gone: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(at, stop) in code points of the runs that these paragraphs, by first clause, cover together."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends, first, past, a, z = _clauses(raw, least)
    later = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no code point
    out: list[list[int]] = []
    reach = -1
    for k in np.searchsorted(first, sorted(gone)).tolist():
        if first[k] <= reach:
            out[-1][1] = ends[z[k] - 1]
        else:
            out.append([starts[a[k]], ends[z[k] - 1]])
        reach = past[k]
    places = np.array(out, np.int64).ravel()
    chars = (places - np.searchsorted(later, places)).tolist()
    return list(zip(chars[::2], chars[1::2]))


def _row() -> list:
    """Columns last, id and key, never null, which name a row of docs by its id, or none, and its text."""
    told, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [told.isNull().alias("last"), F.coalesce(told, F.xxhash64(text)).alias("id"), F.hash(text).alias("key")]


def hashed(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(last, id, key, first, d, c): a row for each paragraph of docs(doc_id, text); (d, c) is its digest."""

    def run(batches):
        held: list = []

        def packed():
            rows, places, digests = zip(*held)
            owner = pa.array(np.repeat(np.arange(len(held)), list(map(len, places))))
            found = np.concatenate(digests)
            columns = [pa.array(x, t).take(owner) for x, t in zip(zip(*rows), (pa.bool_(), pa.int64(), pa.int32()))]
            columns += [pa.array(np.ascontiguousarray(x)) for x in (np.concatenate(places), found["d"], found["c"])]
            return pa.RecordBatch.from_arrays(columns, names=[*_ROW, "first", "d", "c"])

        size = 0
        for batch in batches:
            for *row, text in zip(*(batch.column(k) for k in range(4))):
                places, digests = paragraphs(text.as_py() or b"", least)
                if len(places):
                    held.append(([x.as_py() for x in row], places, digests))
                    size += len(places)
                if size > _FLUSH:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    rows = docs.select(*_row(), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "last boolean, id long, key int, first int, d long, c int")


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Every occurrence that isn't its paragraph's first: last, id and key (of the row), first clause, kept_id.

    Occurrences meet by digest. Digests are grouped with partial aggregation; the ones of most occurrences are
    salted in the join back, so that a passage in a third of all documents lands in many tasks.
    """
    found = hashed(docs, least)
    rank = F.struct(*_ROW, "first")
    earliest = found.groupBy("d", "c").agg(F.min(rank).alias("rank"), F.count("*").alias("n")).where("n > 1")
    met = join_spread(found, cut(earliest), ["d", "c"]).where(rank != F.col("rank"))
    return met.select(*_ROW, "first", F.when(~F.col("rank.last"), F.col("rank.id")).alias("kept_id"))


def removals(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(last, id, key, gone, kept_ids) for each row of docs that loses something; gone has first clauses."""
    kept = F.array_sort(F.collect_set("kept_id"))
    return repeats(docs, least).groupBy(*_ROW).agg(F.collect_set("first").alias("gone"), kept.alias("kept_ids"))  # within one text


def deduplicate(docs: DataFrame, least: int = LEAST_WORDS, changed_only: bool = False) -> DataFrame:
    """docs with their repeated paragraphs cut out of ``text``, and two more columns.

    ``removed`` lists what went, (at, stop) in code points of the text as it was; ``kept_ids`` the documents that hold
    the earliest occurrences, by id, those without one left out. Columns of docs by these names stay, and the new
    ones get underscores. Rows, their number and other columns stay as they are (only rows that lose something
    with ``changed_only``).
    """
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for text, gone in zip(batch.column(at), batch.column(batch.num_columns - 2)):
                text, found = text.as_py(), []
                if gone.is_valid:
                    found = runs(text.encode(), gone.as_py(), least)
                    edges = [0, *[x for run in found for x in run], len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(text)
                spans.append([{"at": a, "stop": b} for a, b in found])
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[at] = pa.array(texts, columns[at].type)
            columns[-2] = pa.array(spans, pa.list_(pa.struct([("at", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    last, i, k, gone, kept, removed = fresh_name(docs, "_last", "_id", "_key", "_gone", "kept_ids", "removed")
    own = [F.col(f"`{c}`").cast("string").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*own, *[x.alias(n) for x, n in zip(_row(), (last, i, k))])
    met = keyed.join(removals(docs, least).toDF(last, i, k, gone, kept), [last, i, k], "inner" if changed_only else "left")
    kept_ids = F.coalesce(kept, F.expr("cast(array() as array<bigint>)")).alias(kept)
    told = met.select(*[F.col(f"`{c}`") for c in docs.columns], gone, kept_ids)
    schema = T.StructType([*told.schema.fields[:-2], T.StructField(removed, T._parse_datatype_string("array<struct<at:int,stop:int>>")), told.schema.fields[-1]])
    names = schema.names
    return told.mapInArrow(run, schema)


#: The same in SQL over ``documents``, rank by (doc_id, at).
SQL = f"""
with tokens as (
  select doc_id, text, length(regexp_extract(text, '^[\\x20\\x09-\\x0D]*')) as lead,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') as toks
  from documents where text is not null),
unrolled as (
  select doc_id, lead, unnest(toks) as tok, unnest(range(1, len(toks) + 1)) as k, len(toks) as n from tokens),
words as (
  select *, regexp_extract(tok, '^[^\\x20\\x09-\\x0D]+') as word,
    lead + sum(length(tok)) over w - length(tok) as lo
  from unrolled window w as (partition by doc_id order by k)),
closed as (
  select *, k = n or contains(tok, chr(10)) or right(word, 1) in ('.', '!', '?', ',', ';', ':') as closes,
    sum(length(word) + 1) over (partition by doc_id order by k) - length(word) - 1 as plain_lo
  from words),
placed as (
  select *, sum(closes::int) over (partition by doc_id order by k) - closes::int as clause from closed),
plain as (
  select doc_id, string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' order by k) as line
  from words group by doc_id),
clauses as (
  select doc_id, clause, min(k) as a, max(k) as z, min(lo) as lo, max(lo + length(word)) as hi,
    min(plain_lo) as plain_lo, max(plain_lo + length(word)) as plain_hi
  from placed group by doc_id, clause),
windows as (
  select s.doc_id, s.clause as first, e.clause as past, s.lo, substring(line, s.plain_lo::int + 1, (e.plain_hi - s.plain_lo)::int) as paragraph
  from clauses s asof join clauses e on s.doc_id = e.doc_id and s.a + {LEAST_WORDS} - 1 <= e.z
  join plain on plain.doc_id = s.doc_id),
ranked as (
  select *, row_number() over w as r, first_value(doc_id) over w as kept_id
  from windows window w as (partition by paragraph order by doc_id, lo)),
gone as (
  select distinct r.doc_id, c.clause, c.lo, c.hi
  from ranked r join clauses c on r.doc_id = c.doc_id and c.clause between r.first and r.past where r.r > 1),
islands as (
  select *, clause - row_number() over (partition by doc_id order by clause) as island from gone),
runs as (
  select doc_id, min(lo) as lo, max(hi) as hi from islands group by doc_id, island),
pieces as (
  select *, lag(hi, 1, 0) over (partition by doc_id order by lo) as before from runs),
kept as (
  select doc_id, string_agg(kept_id::varchar, ',' order by kept_id) as kept_ids
  from (select distinct doc_id, kept_id from ranked where r > 1) group by doc_id)
select p.doc_id, count(*) as n_runs, sum(p.hi - p.lo)::bigint as n_chars_removed,
  string_agg(p.lo::bigint || ':' || p.hi::bigint, ',' order by p.lo) as removed, any_value(kept_ids) as kept_ids,
  string_agg(substring(d.text, p.before::int + 1, (p.lo - p.before)::int), '' order by p.lo) || any_value(d.text)[max(p.hi)::int + 1:] as text
from pieces p join tokens d on d.doc_id = p.doc_id join kept k on k.doc_id = p.doc_id
group by p.doc_id
"""
