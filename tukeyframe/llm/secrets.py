"""Secret scans: fixed patterns, and a guess-cost dynamic program over values in credential contexts.

Three pattern kinds (``assign``, ``access``, ``hex``) give the base spans. The method adds ``guess`` spans: values that
stand after a credential word (``pwd: x``, ``passphrase is x`` ...) and that no base span touches are segmented at minimum
guess cost into dictionary words, dates, repeats, keyboard walks and brute-force spans; a value whose cheapest
segmentation still needs ``min_bits`` bits of guesses is taken for a real credential, unless it is written like a word.

The dictionary is learned from the documents: words by the number of documents that have them, counted over all of them
and all of their text but the values in credential contexts (a secret that is copied many times must not become a word).

Defined results: a null text counts as empty (no spans); texts are scanned whole whatever their length; repeated rows
give repeated results; an empty table gives an empty result; other columns pass through ``scan`` untouched unless their
names clash with the added ``spans`` column, which is then replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tukeyframe.llm import scratch

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_DIGITS = frozenset("0123456789abcdef")
#: Credential words may be parts of identifiers: the long ones with anything around them, the others where a part begins
#: (after a sign, or a capital after a small letter) and up to where it ends.
CREDENTIAL = re.compile(
    r"""(?:(?:password|passwd|passphrase|passcode|pwd|api[_-]?key|secret|credential)(?:s|[_-][A-Za-z0-9_-]{0,40}|[0-9][A-Za-z0-9_-]{0,40}|(?-i:(?<=[a-z])[A-Z])[A-Za-z0-9_-]{0,40})?"""
    r"""|(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass|token|login|pin)(?:s|[_-][A-Za-z0-9_-]{0,40}|[0-9][A-Za-z0-9_-]{0,40}|(?-i:(?<=[a-z])[A-Z])[A-Za-z0-9_-]{0,40})?)"""
    r"""(?![A-Za-z0-9_])["']?\s{0,4}(?:is\b|[:=])\s{0,4}(\S+)""", re.I | re.A
)
#: Any text with a span of kind assign or guess has one of these in lower case.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "credential", "login", "pin")

#: Frequent parts of chosen passwords, most frequent first; the words learned from documents come after them. The rank is
#: the guess cost. A parameter of guess_bits.
PASSWORD_PARTS = (
    "password pass word admin root user login welcome qwerty letmein monkey dragon master secret hello shadow sun shine "
    "princess football baseball iloveyou love trust me freedom whatever test guest default change changeme summer winter "
    "spring autumn january february march april may june july august september october november december monday tuesday "
    "wednesday thursday friday saturday sunday token key value example sample your here none null true false the and for"
).split()
WORDS = tuple(PASSWORD_PARTS)
#: Learned words: how many there are at most, the documents that must have one, and its letters.
DICTIONARY, LEAST, LETTERS = 65_536, 3, (4, 24)
#: The rows of a keyboard, and how far each is shifted to the right, in keys.
KEY_ROWS = {"1234567890-=": 0.0, "qwertyuiop[]": 0.5, "asdfghjkl;'": 0.75, "zxcvbnm,./": 1.25}
LEET = str.maketrans("013457@$!", "oieastasi")
MIN_BITS = 36.0
#: Longest walk, and longest repeat beside the one of greatest length.
SPAN = 64
#: Letters in a row that aren't vowels, in something that is written like a word.
CONSONANTS = 4

_PLACE = {c: (x + shift, y) for y, (row, shift) in enumerate(KEY_ROWS.items()) for x, c in enumerate(row)}
FULL_DATES = (
    re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", re.A),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A),
)
YEAR = re.compile(r"(?:19|20)\d\d", re.A)


@lru_cache(8)
def _ranks(words: tuple[str, ...]) -> tuple[dict[str, int], int]:
    """The rank of each word, and the longest word's length."""
    return {w: r + 1 for r, w in reversed(list(enumerate(words)))}, max(map(len, words), default=0)


def _cardinality(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 128


def _walks(low: str, start: int) -> Iterator[tuple[int, float]]:
    """(end, bits) of the walks over neighbouring keys that begin at start: a start, a direction, and 3 bits for each turn."""
    turns, before = 0, None
    for j in range(start + 1, min(len(low), start + SPAN)):
        a, b = _PLACE.get(low[j - 1]), _PLACE.get(low[j])
        if not a or not b or a == b or abs(a[1] - b[1]) > 1 or abs(a[0] - b[0]) > 1:
            return
        step = (math.copysign(1, b[0] - a[0]), b[1] - a[1])
        turns += before is not None and step != before
        before = step
        if j - start >= 2:
            yield j + 1, math.log2(len(_PLACE)) + 3 + 3 * turns + math.log2(j + 1 - start)


def guess_bits(value: str, words: tuple[str, ...] | list[str] = WORDS) -> float:
    """The log2 of the guesses that the cheapest segmentation of value needs. Its time is linear in the value's length.

    Every span costs a bit for its kind, and: a word its rank, a bit for signs in place of letters and some for capitals;
    a date the days of 120 years, a year these; a walk see _walks(); a repeat its period by brute force and how often
    it comes (its lengths are up to SPAN, or the greatest); brute force the size of each character's class.
    closed[i] is the least cost of value[:i] with no brute-force span open at i, or of one that ends there.
    """
    low = value.lower()
    if len(low) != len(value):  # a few letters have longer lower-case forms
        low = value
    plain = low.translate(LEET)
    ranks, longest = _ranks(tuple(words))
    n = len(value)
    alike = {p: [0] * (n + 1) for p in range(1, 9)}  # how far value[i:] equals value[i + p:]
    for p, run in alike.items():
        for i in range(n - p - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
    closed, brute = [0.0] + [math.inf] * n, math.inf
    for i in range(n):
        here = closed[i] + 1.0  # a new span costs a bit for its kind

        def reach(j: int, cost: float, here: float = here) -> None:
            closed[j] = min(closed[j], here + cost)

        for j in range(i + 2, min(n, i + longest) + 1):
            for text, extra in ((low[i:j], 0.0), (plain[i:j], 1.0)):
                if rank := ranks.get(text):
                    case = 0.0 if value[i:j] == low[i:j] else 1.0 if value[i:j] in (low[i:j].upper(), low[i:j].capitalize()) else float(j - i)
                    reach(j, math.log2(rank + 1) + extra + case)
        for pattern, many in ((FULL_DATES[0], 365 * 120), (FULL_DATES[1], 365 * 120), (YEAR, 120)):
            if found := pattern.match(value, i):
                reach(found.end(), math.log2(many))
        for j, cost in _walks(low, i):
            reach(j, cost)
        for period, run in alike.items():
            most, least = run[i] + period, max(2 * period, 3)
            if most >= least:
                once = sum(math.log2(_cardinality(c)) for c in value[i : i + period])
                for length in {most, *range(least, min(most, SPAN) + 1)}:
                    reach(i + length, once + math.log2(length / period + 1))
        brute = min(brute, here) + math.log2(_cardinality(value[i]))
        closed[i + 1] = min(closed[i + 1], brute)
    return closed[n]


@lru_cache(1 << 12)
def _consonant(c: str) -> bool:
    base = unicodedata.normalize("NFD", c.lower())[0]
    return "a" <= base <= "z" and base not in "aeiouy"


def like_a_word(value: str) -> bool:
    """Whether value is written as one word is, or two joined by a sign: letters of one case (or a capital first), with
    vowels among them and at most CONSONANTS letters in a row that aren't. No evidence of a secret, in any dictionary."""
    parts = re.split(r"[-'’._]", value)
    for part in parts:
        if not part.isalpha() or len(part) > LETTERS[1] or not (part.islower() or part.isupper() or part[1:].islower() or part.lower() == part):
            return False
        run = max(map(len, re.split("0+", "".join("01"[_consonant(c)] for c in part))))
        if run > CONSONANTS or run == len(part) > 1:
            return False
    return len(parts) <= 2


def dictionary(documents: DataFrame, text: str = "text", size: int = DICTIONARY, least: int = LEAST) -> tuple[str, ...]:
    """PASSWORD_PARTS and then the words of the documents, by how many documents have them: at most size words.

    Counts are over all documents and whole texts; words that fewer than least documents have don't count, nor do values in
    credential contexts. What reaches the driver is at most size words of LETTERS letters: a count's words all come or
    none of them, from the highest count down.
    """
    whole = F.col(text).cast("string")
    words = F.array_distinct(F.split(F.lower(_without_values(whole)), r"[^\p{L}]+"))
    fit = F.filter(words, lambda w: F.length(w).between(*LETTERS))
    counts = documents.select(F.explode(fit).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    counts = scratch.materialise(counts, "words")
    # buckets of counts, an eighth of a doubling each: a few hundred at most
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    room, lowest = size, None
    for row in sorted(counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        if (room := room - row["words"]) < 0:
            break
        lowest = row["bucket"]
    if lowest is None:
        return WORDS
    found = counts.where(bucket >= lowest).collect()
    return tuple(dict.fromkeys([*PASSWORD_PARTS, *(r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"])))]))


def _without_values(text: Column) -> Column:
    """The text without what stands after a credential word, in a wide sense."""
    low = F.lower(text)
    some = low.contains(CONTEXT_WORDS[0])
    for word in CONTEXT_WORDS[1:]:
        some = some | low.contains(word)
    context = f"(?i)(?:{'|'.join(CONTEXT_WORDS)})[A-Za-z0-9_-]{{0,60}}[\"']?\\s{{0,4}}(?:is\\b|[:=])\\s{{0,4}}\\S+"
    return F.when(some, F.regexp_replace(text, context, " ")).otherwise(text)


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """The runs of HEX with 32 or more characters: every such run covers a position divisible by 32."""
    found, end, n = [], -1, len(text)
    probe = text[::32]
    for k, c in enumerate(probe):
        if c in HEX_DIGITS and (at := 32 * k) >= end:
            start = at
            while start > 0 and text[start - 1] in HEX_DIGITS:
                start -= 1
            if (end := HEX.match(text, start).end()) - start >= 32:
                found.append((start, end))
    return [x for x in found if x[1] <= n]


def spans(text: str | None, words: tuple[str, ...] | list[str] = WORDS, min_bits: float = MIN_BITS) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text in code points, by start and then kind."""
    if not text:
        return []
    found = [("hex", *x) for x in _hex_runs(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    low = text.lower()
    if any(w in low for w in CONTEXT_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        taken = bytearray(len(text))
        for _, s, e in found:
            taken[s:e] = b"\1" * (e - s)
        for m in CREDENTIAL.finditer(text):
            value = m[1].strip("\"'`,;.()[]{}<>")
            start = m.start(1) + (m[1].find(value) if value else 0)
            end = start + len(value)
            if len(value) >= 6 and 1 not in taken[start:end] and not like_a_word(value) and guess_bits(value, words) >= min_bits:
                found.append(("guess", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(documents: DataFrame, text: str = "text", words: tuple[str, ...] | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """documents with the column spans: array<struct<kind, start, end>>. Without words, their dictionary() is learned first."""
    sent = documents.sparkSession.sparkContext.broadcast(dictionary(documents, text) if words is None else tuple(words))

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = sent.value
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans(t, words, min_bits)] for t in texts], dtype=object)

    return scratch.text_batches(documents).withColumn("spans", find(F.col(text).cast("string")))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each scanned document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, text: str = "text", placeholder: str = "[SECRET]", words: tuple[str, ...] | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """documents with every span of scan() replaced by the placeholder; overlapping spans become one. Null texts stay null."""
    sent = documents.sparkSession.sparkContext.broadcast(dictionary(documents, text) if words is None else tuple(words))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = sent.value
        for texts in batches:
            yield pd.Series([t if t is None else _without(t, spans(t, words, min_bits), placeholder) for t in texts], dtype=object)

    return scratch.text_batches(documents).withColumn(text, clean(F.col(text).cast("string")))


def _without(text: str, found: list[tuple[str, int, int]], placeholder: str) -> str:
    parts, at = [], 0
    for _, start, end in found:
        if start >= at:
            parts += [text[at:start], placeholder]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if found else text


def text_digest(found: list[tuple[str, int, int]]) -> str:
    """The digest that digest() gives for a list of spans (for comparison in plain Python)."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found if k != "guess").encode()).hexdigest()


_ASSIGN_SQL = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: The base spans in DuckDB SQL: a match begins after all text between matches and all matches before it.
BASE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT id, 'assign' AS kind, 0 AS k, 8 AS least, regexp_extract_all(t, '{_ASSIGN_SQL}') AS f, regexp_extract_all(t, '{_ASSIGN_SQL}', 2) AS g, string_split_regex(t, '{_ASSIGN_SQL}') AS b FROM d
  UNION ALL SELECT id, 'access', 1, 16, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS f, f, string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT id, 'hex', 2, 32, regexp_extract_all(t, '[0-9a-f]+') AS f, f, string_split_regex(t, '[0-9a-f]+') FROM d),
e AS (SELECT id, kind, k, least, unnest(f) AS f, unnest(g) AS g, unnest(b[1:len(f)]) AS b, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT id, kind, k, least, g, sum(length(b) + length(f)) OVER (PARTITION BY id, k ORDER BY i) AS stop, length(f) AS size FROM e),
x AS (SELECT id, kind, k, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE length(g) >= least)
SELECT doc_id, count(k) FILTER (k = 0) AS n_assign, count(k) FILTER (k = 1) AS n_access, count(k) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k), '')) AS base_sha256
FROM d LEFT JOIN x USING (id) GROUP BY id, doc_id
"""
