"""Secret scan: pattern spans, and incompressible strings in a sensitive context.

Patterns give the base spans. The method adds others. Each run of key-like characters that begins within REACH
characters behind a sensitive word, also on later lines, or that only white space parts from a run already found,
is a candidate. Its novelty is measured by a zstandard compressor whose dictionary holds code words, built-in ones
and those that identifiers of all documents are made of: the bytes that the surrounding text takes with the candidate
behind it less the bytes that it takes alone, other occurrences of the candidate blanked out of it. Names and paths are made
of known words and cost little; a random key costs nearly its length. All copies of a value that is found in a
text become spans. Candidates that overlap a base span are measured too, but add no span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the base spans, and their least lengths (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run of 16 or more is found from its first character on, as all runs with the short ones dropped
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
_HINTS = ("passw", "secret", "token", "api")

#: Words that make what follows them sensitive.
SENSITIVE = re.compile(
    r"secret|token|passw|passphrase|pwd|api_?key|access_?key|private|credential|bearer|authoriz|auth_|signature|signing|hmac|salt|session_?id|(?<![a-z])key(?![a-z])", re.I | re.A
)
_SENSITIVE_HINTS = ("secret", "token", "passw", "passph", "pwd", "key", "private", "credential", "bearer", "auth", "sign", "hmac", "salt", "session")
#: Characters behind a sensitive word in which a candidate must begin, and text on each side that counts as surroundings.
REACH, AROUND = 160, 400
_RUN = r"[A-Za-z0-9+/_=-]"
CANDIDATE, REST = re.compile(_RUN + "{16}"), re.compile(_RUN + "+")
#: Least novelty for each character of a candidate: with a sixth of digits, with fewer, with letters of both cases only.
NOVELTY, NOVELTY_FEW, NOVELTY_LETTERS = 0.70, 0.76, 0.82
#: Code words that any dictionary has; it also gets the CODE_WORDS most frequent ones of the corpus.
CODE_WORDS = 1_500
BUILT_IN = (
    "password secret token api key access client private public authorization bearer credential signature session refresh user name database "
    "connection string application configuration environment development production localhost example function return import self config get "
    "static final class public void const process system server service provider factory manager handler request response error message value "
    "default path file data index test type object number count list map set max min retry time date version module package property option "
    "https://www.example.com/ http:// Content-Type: application/json ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 1234567890"
)
_WORD = re.compile(r"[A-Z]?[a-z]{2,14}|[A-Z]{3,14}")
_BEFORE = re.compile(r"([A-Za-z_][A-Za-z0-9_]{2,39})\x20[=(]", re.A)


def code_words(text: str) -> set[str]:
    """The words, in lower case, that the identifiers in a text are made of.

    Identifiers are taken from runs without white space that hold an underscore, an equals sign, a parenthesis or a capital
    behind a small letter, and from names before ' =' and ' ('.
    """
    named = [w for w in set(text.split()) if "_" in w or "=" in w or "(" in w or not (w.islower() or w[1:].islower() or w.isupper()) and w.isalnum() and not w[1:].isupper()]
    if " =" in text or " (" in text:
        named += _BEFORE.findall(text)
    return {w.lower() for x in named for w in _WORD.findall(x[:200])}


def corpus_words(docs: DataFrame, most: int = CODE_WORDS) -> list[str]:
    """The code words that most of docs(text) have, the most frequent last; ties by word. At most ``most`` reach the driver."""

    def run(batches):
        release()
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(code_words(text.as_py() or ""))
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(seen.values(), pa.int64())})
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(seen.values(), pa.int64())})

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    told = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()
    return [r.word for r in reversed(told)]


class Novelty:
    """Marginal compressed bytes of a string behind its surroundings, the compressor primed with code words."""

    def __init__(self, words: list[str] = (), level: int = 3) -> None:
        primer = " ".join([*words, *(w.capitalize() for w in words), *(w.upper() for w in words)])
        own = BUILT_IN.split()
        primer += " " + " ".join([*(w.capitalize() for w in own), *(w.upper() for w in own)]) + " " + BUILT_IN
        known = zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.tool = zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def __call__(self, before: str, candidate: str, after: str) -> int:
        # the reversed words match nothing in the dictionary: by their letters the compressor gets a code for letters of names
        around = (BUILT_IN[::-1] + "\n" + before.replace(candidate, " ") + "\n" + after.replace(candidate, " ") + "\n").encode("utf-8", "surrogatepass")
        size = lambda b: len(self.tool.compress(b))
        return size(around + candidate.encode()) - size(around)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern spans."""
    low, out = text.lower(), []
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _least(value: str) -> float | None:
    """Novelty for each character from which a run counts as a key; None for runs that are none."""
    lower, upper, digits = any(map(str.islower, value)), any(map(str.isupper, value)), sum(map(str.isdigit, value))
    if digits and (lower or upper):
        return NOVELTY if 6 * digits >= len(value) else NOVELTY_FEW
    return NOVELTY_LETTERS if lower and upper else None


def _candidates(text: str):
    """(start, end, whether only white space parts it from the one before) of the runs in a sensitive context, by place."""
    at, last = 0, -1
    for word in SENSITIVE.finditer(text):
        stop = word.end() + REACH
        at = max(at, word.end())
        while (m := CANDIDATE.search(text, at, stop + 16)) and m.start() <= stop:
            at = REST.match(text, m.start()).end()
            a, b = m.start(), at
            while a < b and text[a] in "=-_/+":
                a += 1
            while b > a and text[b - 1] in "-_/+":
                b -= 1
            if b - a >= 16:
                chained = last >= 0 and not text[last:a].strip(" \t\r\n\"'\\")
                yield a, b, chained
                last = at
                stop = max(stop, at + 4)  # lines of one key


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> tuple[int, list[tuple[int, int, str]]]:
    """(candidates measured, spans that the method adds): spans overlap no base span and no other one of their kind."""
    low = text.lower()
    if not any(h in low for h in _SENSITIVE_HINTS):
        return 0, []
    found: set[str] = set()
    measured = 0
    for a, b, _ in _candidates(text):
        value = text[a:b]
        least = _least(value)
        if least is None or value in found:
            continue
        measured += 1
        if novelty(text[max(0, a - AROUND) : a], value, text[b : b + AROUND]) >= least * len(value):
            found.add(value)
    if not found:
        return measured, []
    taken: list[list[int]] = []  # merged base spans, then the new ones
    for a, b, _ in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts, stops = [a for a, _ in taken], [b for _, b in taken]
    out: list[tuple[int, int, str]] = []
    for m in re.finditer("|".join(map(re.escape, sorted(found, key=lambda v: (-len(v), v)))), text):
        a, b = m.span()
        k = bisect_left(stops, a + 1)  # the first base span that ends behind the start
        if k == len(starts) or starts[k] >= b:
            out.append((a, b, "novel"))
    return measured, out


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "<SECRET>") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, redacted: bool = False, words: list[str] | None = None) -> DataFrame:
    """Spans of each row of docs(doc_id, text); a null text counts as empty, repeated rows repeat, an empty table has none.

    Returns doc_id, n_assign, n_access, n_hex, n_novel, n_measured (candidates whose novelty was taken), base_sha256
    and spans (kind:start:end in code points by start, then kind, comma-joined) and, if wanted, redacted: the text
    without its secrets (null stays null). ``words`` prime the compressor; by default they are counted in docs.
    """
    words = corpus_words(docs) if words is None else words

    def run(batches):
        novelty = Novelty(words)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7 + redacted)]
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text or "")
                measured, added = novel_spans(text or "", base, novelty)
                kinds = [k for _, _, k in base]
                row = [*(kinds.count(k) for k in KINDS[:3]), len(added), measured, hashlib.sha256(render(base).encode()).hexdigest(), render(base + added)]
                for column, x in zip(rows, row + [redact(text, base + added) if text else text] * redacted):
                    column.append(x)
            kinds = [pa.int64()] * 5 + [pa.string()] * (2 + redacted)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "n_measured", "base_sha256", "spans", *["redacted"] * redacted]
    schema = ", ".join(f"{n} {'long' if i < 6 else 'string'}" for i, n in enumerate(names))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def clean(docs: DataFrame, mark: str = "<SECRET>", words: list[str] | None = None) -> DataFrame:
    """docs with every secret in ``text`` replaced by a mark; rows and other columns stay, null texts too."""
    words = corpus_words(docs) if words is None else words
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches):
        release()
        novelty = Novelty(words)
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    spans = base + novel_spans(text, base, novelty)[1]
                    text = redact(text, spans, mark) if spans else text
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        release()  # the worker may wait through stages without Python

    return docs.mapInArrow(run, docs.schema)
