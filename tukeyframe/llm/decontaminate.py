"""Benchmark decontamination by template windows.

Texts become template tokens: punctuation goes, numbers, names (capitalised words) and units after numbers are replaced by typed
placeholders, everything else is the word in lower case. A window of WINDOW tokens has a key, the hash of its template tokens
if at least half of these are words, else of the words that stand there: a row of mere numbers must be that row. Windows of
documents meet those of the benchmark in a hash join. Items of equal template, and equal pattern of which slots repeat
which, are one class; the join knows classes only, and their least item stands for them.

A document's hits with a class lie on alignments (document position less item position). Hits less than GAP tokens apart whose
alignments differ by SLIP tokens at most, so that a word more or less doesn't end it, are a chain, and a chain has one
binding of slots to values. If a name or unit of the item stands for two values in the document, or two for one, the chain's
windows count only where the words are those of an item of the class; if a number has two values, so do the windows that
hold that number (two numbers may get one value). A document matches if the windows that count cover ``share`` of the class's
windows, or if RUN of them are in one chain, so that an excerpt of a long item is found too.

Items of fewer than SHORTEST tokens are too general for windows: they match a line of a document that has exactly their words.

Only built-in functions are used. In all documents, only windows whose first two tokens may be those of a window of the benchmark,
by a table of bits, are hashed; slots and alignment are for documents that share a template. The benchmark's windows are counted, and broadcast only up to BROADCAST of them; a
larger benchmark is joined by shuffling the windows.

Defined results: null and empty texts match nothing, nor do items without a word; items shorter than a window are one window of
their own length; rows that repeat an id match each for itself, repeated items are one class; rows with a null doc_id or
item_id take no part in matches() and stay in clean(), where rows of one id go together; an empty table on either side
gives no rows; texts are compared whole whatever their length; other columns are not read, and clean() leaves all as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tukeyframe.llm import scratch
from tukeyframe.llm.native import fresh, hold

WINDOW, SHORTEST, SHARE, RUN, GAP, SLIP = 8, 5, 0.25, 16, 16, 4
#: Bits by which windows that begin unlike all of the benchmark's are passed over.
PAIRS = 1 << 15
BROADCAST = 1_000_000
SPACES = " \t\n\r\f\x0B"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡"
#: General punctuation, dashes to ellipsis, as a range for use within brackets.
DASHES = "\u2010-\u2027"
NAME, NUMBER, UNIT, AMOUNT = "\u0001", "\u0002", "\u0003", "\u0004"
UNITS = (
    "km m cm mm kg g mg l ml h min s mph kmh mile miles foot feet inch inches yard yards pound pounds ounce ounces dollar dollars "
    "euro euros cent cents percent hour hours minute minutes second seconds day days week weeks month months year years degree degrees"
).split()


def _class(chars: str) -> str:
    """Characters for use within brackets of a pattern."""
    return "".join(f"\\{c}" if c in "[]\\^-&~" else c for c in chars)


_WS, _UNIT, _SIGNS = _class(SPACES), "|".join(UNITS), _class(PUNCTUATION) + DASHES
_END = f"(?![^{_WS}])"


def _cut(words: Column) -> Column:
    return F.array_remove(F.split(F.btrim(F.lower(words), F.lit(SPACES)), f"[{_WS}]+", -1), "")


def _slots(words: Column) -> Column:
    """Numbers, amounts (a number with its unit), units after numbers, and capitalised words replaced; words stay apart."""
    x = F.regexp_replace(words, f"(^|[{_WS}])[0-9]+{_END}", f"$1{NUMBER}")
    x = F.regexp_replace(x, f"(^|[{_WS}])[0-9]+(?i:{_UNIT}){_END}", f"$1{AMOUNT}")
    x = F.regexp_replace(x, f"({NUMBER}[{_WS}]+)(?i:{_UNIT}){_END}", f"$1{UNIT}")
    x = F.when(words.rlike("[0-9]"), x).otherwise(words)
    return F.regexp_replace(x, f"(^|[{_WS}])\\p{{Lu}}\\p{{Ll}}[^{_WS}]*", f"$1{NAME}")


def tokens(df: DataFrame, text: Column, values: bool = True) -> DataFrame:
    """df with the arrays h (hashes of template tokens) and, if wanted, u (hashes of words) and slot (kinds, "" for words)."""
    df = hold(df, words=F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{_SIGNS}]+", ""))
    if not values:
        df = hold(df, t=_cut(_slots(F.col("words"))))
        return hold(df, h=F.transform("t", lambda x: F.xxhash64(x))).drop("t", "words")
    df = hold(df, t=_cut(_slots(F.col("words"))), c=_cut(F.col("words")))
    slot = F.transform("t", lambda x: F.when(x.isin(NAME, NUMBER, UNIT, AMOUNT), x).otherwise(""))
    return hold(df, h=F.transform("t", lambda x: F.xxhash64(x)), u=F.transform("c", lambda x: F.xxhash64(x)), slot=slot).drop("t", "c", "words")


def _places(size: Column) -> Column:
    return F.when(F.size("h") >= size, F.sequence(F.lit(1), F.size("h") - size + 1)).otherwise(F.array().cast("array<int>"))


def _pair(h: str, i: Column) -> Column:
    """A number from the hashes of two tokens side by side."""
    return F.element_at(h, i).bitwiseXOR(F.shiftrightunsigned(F.element_at(h, i + 1), 1))


def beginnings(theirs: DataFrame) -> Column:
    """PAIRS bits as an array of longs: set for the first two tokens of each window of the benchmark (columns first)."""
    word, place = F.col("first").bitwiseAND(PAIRS // 64 - 1).alias("word"), F.shiftrightunsigned("first", 58).cast("int")
    bits = theirs.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = {r["word"]: r["bits"] for r in bits.collect()}  # PAIRS / 64 at most
    return F.lit(np.array([found.get(k, 0) for k in range(PAIRS // 64)], np.int64))  # one literal


def templates(df: DataFrame, keep: list[str], size: Column, first: Column) -> DataFrame:
    """A row for each window of size tokens that begins like one of beginnings(), from tokens() without values: keep, size and
    the hash t of its template."""

    def begins(i: Column) -> Column:
        pair = _pair("h", i)
        return F.getbit(F.element_at(first, (pair.bitwiseAND(PAIRS // 64 - 1) + 1).cast("int")), F.shiftrightunsigned(pair, 58).cast("int")) == 1

    return df.select(*keep, size.alias("size"), F.explode(F.transform(F.filter(_places(size), begins), lambda i: F.xxhash64(F.slice("h", i, size)))).alias("t"))


def windows(df: DataFrame, keep: list[str], size: Column, more: dict[str, str] | None = None) -> DataFrame:
    """A row for each window of size tokens, from tokens(): keep, size, at, its key k, the hash v of its words, its template t;
    and for each of more (name: column) the part of that array."""
    wordy = lambda i: 2 * F.size(F.filter(F.slice("slot", i, size), lambda x: x == "")) >= size
    t, v = (lambda i: F.xxhash64(F.slice("h", i, size))), (lambda i: F.xxhash64(F.slice("u", i, size)))
    key = lambda i: F.when(wordy(i), t(i)).otherwise(F.xxhash64(v(i), F.lit(1)))
    parts = {n: (lambda i, c=c: F.slice(c, i, size)) for n, c in (more or {}).items()}
    each = F.transform(_places(size), lambda i: F.struct(i.alias("at"), key(i).alias("k"), v(i).alias("v"), t(i).alias("t"), *(p(i).alias(n) for n, p in parts.items())))
    return df.select(*keep, size.alias("size"), F.explode(each).alias("x")).select(*keep, "size", *(F.col(f"x.{n}").alias(n) for n in ("at", "k", "v", "t", *parts)))


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """The windows of classes of items: item_id (the least), n_items, n (windows of the class), size, at, k, v, t, and b: for each
    token 0, or the number of its slot, negative for numbers and amounts; first is of its first two tokens. A row for each distinct v."""
    items = tokens(benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), F.col(text).alias("text")), F.col("text")).drop("text")
    items = items.where(F.size("h") >= SHORTEST)
    first = F.transform("u", lambda x: F.array_position("u", x).cast("int"))
    number = F.zip_with(first, "slot", lambda i, s: F.when(s == "", 0).when(s.isin(NUMBER, AMOUNT), -i).otherwise(i))
    items = hold(items, b=number)
    items = items.withColumn("class", F.struct(F.xxhash64("h"), F.xxhash64("b"), F.size("h")))
    items = scratch.materialise(items, "items")
    classes = items.groupBy("class").agg(F.min("item_id").alias("least"), F.count_distinct("item_id").alias("n_items"))
    items = items.join(classes, "class").withColumn("item_id", F.col("least"))
    size = F.least(F.lit(WINDOW), F.size("h"))
    items = items.withColumn("n", F.size("h") - size + 1)
    every = windows(items, ["item_id", "n_items", "n"], size, {"b": "b", "start": "h"})
    return every.withColumn("first", _pair("start", F.lit(1))).drop("start").distinct()


def _chains(hits: DataFrame) -> DataFrame:
    """hits (doc_id, row, item_id, at, item_at) with their chains."""
    of = ["doc_id", "row", "item_id"]
    by_place = Window.partitionBy(*of).orderBy("at", "item_at")
    apart = F.coalesce((F.col("at") - F.lag("at").over(by_place) >= GAP).cast("int"), F.lit(0))
    hits = hits.withColumn("_far", apart).withColumn("part", F.sum("_far").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    shift = F.col("at") - F.col("item_at")
    by_shift = Window.partitionBy(*of, "part").orderBy("shift", "at")
    off = F.coalesce((F.col("shift") - F.lag("shift").over(by_shift) > SLIP).cast("int"), F.lit(0))
    hits = hits.withColumn("shift", shift).withColumn("_far", off)
    return hits.withColumn("line", F.sum("_far").over(by_shift.rowsBetween(Window.unboundedPreceding, 0))).drop("_far", "shift")


def _counting(hits: DataFrame) -> DataFrame:
    """The hits that count: those with the item's words, and those whose slots agree with their chain's binding."""
    chain = ["doc_id", "row", "item_id", "part", "line"]
    slots = F.filter(F.arrays_zip(F.col("b").alias("b"), F.col("w").alias("w")), lambda x: x["b"] != 0)
    pairs = hits.select(*chain, F.explode(slots).alias("x")).select(*chain, "x.b", "x.w").distinct()
    torn = pairs.groupBy(*chain, "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*chain, "b")
    shared = pairs.where("b > 0").groupBy(*chain, "w").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n > 1").select(*chain, "b")
    bad = torn.unionByName(shared).groupBy(*chain).agg(F.max(F.col("b") > 0).alias("names"), F.collect_set("b").alias("torn"))
    agrees = F.col("names").isNull() | (~F.col("names") & ~F.arrays_overlap("b", "torn"))
    return hits.join(bad, chain, "left").where(F.col("same") | agrees)


def _short(documents: DataFrame, benchmark: DataFrame, key: str, text: str, item: str) -> DataFrame:
    """Documents with a line of exactly the words of an item of fewer than SHORTEST tokens."""
    words = lambda c: F.array_join(_cut(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"[{_SIGNS}]+", "")), " ")
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), words(F.col(text)).alias("line"))
    items = items.where((F.col("line") != "") & (F.size(F.split("line", " ")) < SHORTEST)).groupBy("line").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    items = scratch.materialise(items, "short-items")
    if items.isEmpty():
        return None
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    lines = rows.select("doc_id", "row", F.explode(F.array_distinct(F.transform(F.split("text", "[\n\r]+", -1), words))).alias("line"))
    one = F.lit(1)
    return lines.join(scratch.small(items), "line").select("doc_id", "row", "item_id", "n_items", one.alias("n"), one.cast("long").alias("n_matched"), one.cast("long").alias("longest"))


def matches(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """A row for each contaminated document (row) and class of items: doc_id, item_id (the least of the class), n_items, n_windows
    (of the class), n_matched, coverage, and longest (windows that count in one chain)."""
    theirs = scratch.materialise(benchmark_windows(benchmark, item, text), "benchmark-windows")
    facts = theirs.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()  # at most WINDOW sizes
    sizes = sorted(facts["sizes"]) or [WINDOW]
    join = F.broadcast if facts["n"] <= BROADCAST else (lambda x: x)

    def every(rows: DataFrame, keep: list[str], values: bool) -> tuple[DataFrame, Column]:
        docs = tokens(rows, F.col("text"), values).drop("text")
        if len(sizes) == 1:
            return docs, F.lit(sizes[0])
        return docs.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)))), F.col("_size")

    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    # first the documents that share a template at all, then keys, slots and alignment of these
    docs, size = every(rows, ["doc_id"], False)
    near = templates(docs, ["doc_id"], size, beginnings(theirs)).join(join(theirs.select("size", "t").distinct()), ["size", "t"], "left_semi").select("doc_id").distinct()
    near = scratch.small(scratch.materialise(near, "near-benchmark"))
    docs, size = every(rows.join(near, "doc_id", "left_semi").withColumn("row", F.monotonically_increasing_id()), ["doc_id", "row"], True)
    ours = windows(docs, ["doc_id", "row"], size, {"w": "u"}).drop("t")
    classes = theirs.select("item_id", "size", F.col("at").alias("item_at"), "k", "b").distinct()
    hits = ours.join(join(classes), ["size", "k"])
    same = theirs.select("item_id", "size", F.col("at").alias("item_at"), "v", F.lit(True).alias("same")).distinct()
    hits = hits.join(join(same), ["item_id", "size", "item_at", "v"], "left").withColumn("same", F.coalesce("same", F.lit(False)))
    hits = scratch.materialise(_chains(hits.select("doc_id", "row", "item_id", "at", "item_at", "b", "w", "same")), "hits")
    good = scratch.materialise(_counting(hits).select("doc_id", "row", "item_id", "part", "line", "item_at").distinct(), "counting")
    of = ["doc_id", "row", "item_id"]
    longest = good.groupBy(*of, "part", "line").agg(F.count(F.lit(1)).alias("c")).groupBy(*of).agg(F.max("c").alias("longest"))
    per = good.groupBy(*of).agg(F.count_distinct("item_at").alias("n_matched")).join(longest, of)
    per = per.join(join(theirs.select("item_id", "n_items", "n").distinct()), "item_id")
    short = _short(documents, benchmark, key, text, item)
    if short is not None:
        per = per.unionByName(short)
    covered = F.col("n_matched") / F.col("n")
    out = per.where((covered >= share) | (F.col("longest") >= run))
    return out.select(F.col("doc_id").alias(key), F.col("item_id").alias(item), "n_items", F.col("n").cast("long").alias("n_windows"), "n_matched", covered.alias("coverage"), "longest")


def clean(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without those that match; rows with a null id stay."""
    name = fresh(documents, "contaminated")
    found = scratch.materialise(matches(documents, benchmark, share, run, key, text).select(F.col(key).alias(name)).distinct(), "contaminated")
    return documents.join(scratch.small(found), F.col(key) == F.col(name), "left_anti")


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_sql_class = lambda s: _class(s).replace("'", "''")
#: The same in DuckDB SQL, word by word and with windows compared as text.
SQL = rf"""
WITH src AS (
  SELECT 'd' AS side, doc_id AS id, text, row_number() OVER () AS r FROM documents WHERE doc_id IS NOT NULL UNION ALL
  SELECT 'b', item_id, text, row_number() OVER () FROM benchmark WHERE item_id IS NOT NULL),
raw AS (SELECT side, id, r, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[{_sql_class(PUNCTUATION)}{DASHES}]+', '', 'g'), '[{_sql_class(SPACES)}]+'), lambda x: x <> '') AS x FROM src),
tok AS (SELECT side, id, r, unnest(x) AS core, unnest(range(1, len(x) + 1)) AS i FROM raw),
p AS (SELECT *, coalesce(regexp_matches(lag(core) OVER (PARTITION BY side, r ORDER BY i), '^[0-9]+$'), false) AS amount FROM tok),
t AS (
  SELECT side, id, r, i, lower(core) AS v, CASE
    WHEN regexp_matches(core, '^[0-9]+$') THEN '<number>' WHEN regexp_matches(core, '^[0-9]+(?i:{_UNIT})$') THEN '<amount>'
    WHEN amount AND lower(core) IN ({', '.join(_quoted(u) for u in UNITS)}) THEN '<unit>'
    WHEN regexp_matches(core, '^\p{{Lu}}\p{{Ll}}') THEN '<name>' END AS s FROM p),
a AS (SELECT side, id, r, list(coalesce(s, v) ORDER BY i) AS t, list(v ORDER BY i) AS v, list(coalesce(s, '') ORDER BY i) AS s FROM t GROUP BY side, id, r),
items AS (
  SELECT id, t, v, s, least({WINDOW}, len(t)) AS size, list_transform(range(1, len(t) + 1), lambda j: CASE
    WHEN s[j] = '' THEN 0 WHEN s[j] IN ('<number>', '<amount>') THEN -list_position(v, v[j]) ELSE list_position(v, v[j]) END) AS b
  FROM a WHERE side = 'b' AND len(t) >= {SHORTEST}),
cls AS (SELECT t, b, min(id) AS item_id, count(DISTINCT id) AS n_items FROM items GROUP BY t, b),
bi AS (SELECT item_id, n_items, size, t, v, s, b, len(t) - size + 1 AS n FROM items JOIN cls USING (t, b)),
bx AS (SELECT *, unnest(range(1, CAST(n + 1 AS BIGINT))) AS pos FROM bi),
bw AS (SELECT DISTINCT item_id, n_items, n, size, pos, t[pos:pos + size - 1] AS t, v[pos:pos + size - 1] AS v, s[pos:pos + size - 1] AS s, b[pos:pos + size - 1] AS b FROM bx),
dx AS (
  SELECT id AS doc_id, r, t, v, s, size, unnest(range(1, CAST(len(t) - size + 2 AS BIGINT))) AS pos
  FROM a, (SELECT DISTINCT size FROM items) WHERE side = 'd' AND len(t) >= size),
dw AS (SELECT doc_id, r, size, pos, t[pos:pos + size - 1] AS t, v[pos:pos + size - 1] AS v, s[pos:pos + size - 1] AS s FROM dx),
key AS (SELECT DISTINCT item_id, size, pos AS item_pos, b, t, CASE WHEN 2 * len(list_filter(s, lambda y: y = '')) >= size THEN NULL ELSE v END AS words FROM bw),
same AS (SELECT DISTINCT item_id, size, pos AS item_pos, v FROM bw),
h0 AS (
  SELECT d.doc_id, d.r, k.item_id, d.pos, k.item_pos, d.pos - k.item_pos AS shift, k.b, d.v, e.item_id IS NOT NULL AS same
  FROM dw d JOIN key k ON d.size = k.size AND d.t = k.t AND (k.words IS NULL OR k.words = d.v)
  LEFT JOIN same e ON e.item_id = k.item_id AND e.size = k.size AND e.item_pos = k.item_pos AND e.v = d.v),
h1 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY r, item_id ORDER BY pos, item_pos) >= {GAP} THEN 1 ELSE 0 END AS far FROM h0),
h2 AS (SELECT *, sum(far) OVER (PARTITION BY r, item_id ORDER BY pos, item_pos ROWS UNBOUNDED PRECEDING) AS part FROM h1),
h3 AS (SELECT *, CASE WHEN shift - lag(shift) OVER (PARTITION BY r, item_id, part ORDER BY shift, pos) > {SLIP} THEN 1 ELSE 0 END AS off FROM h2),
h AS (SELECT *, sum(off) OVER (PARTITION BY r, item_id, part ORDER BY shift, pos ROWS UNBOUNDED PRECEDING) AS line FROM h3),
pr AS (SELECT DISTINCT r, item_id, part, line, b, w FROM (SELECT r, item_id, part, line, unnest(b) AS b, unnest(v) AS w FROM h) WHERE b <> 0),
torn AS (SELECT r, item_id, part, line, b FROM pr GROUP BY ALL HAVING count(*) > 1),
bad AS (
  SELECT DISTINCT r, item_id, part, line FROM torn WHERE b > 0
  UNION SELECT r, item_id, part, line FROM (SELECT r, item_id, part, line, w FROM pr WHERE b > 0 GROUP BY ALL HAVING count(*) > 1)),
numbers AS (SELECT r, item_id, part, line, list(b) AS torn FROM torn WHERE b < 0 GROUP BY ALL),
good AS (
  SELECT DISTINCT h.doc_id, h.r, h.item_id, h.part, h.line, h.item_pos FROM h
  LEFT JOIN bad ON bad.r = h.r AND bad.item_id = h.item_id AND bad.part = h.part AND bad.line = h.line
  LEFT JOIN numbers n ON n.r = h.r AND n.item_id = h.item_id AND n.part = h.part AND n.line = h.line
  WHERE h.same OR (bad.r IS NULL AND NOT list_has_any(h.b, coalesce(n.torn, [])))),
chain AS (SELECT r, item_id, count(*) AS c FROM good GROUP BY r, item_id, part, line),
per AS (SELECT doc_id, r, item_id, count(DISTINCT item_pos) AS n_matched FROM good GROUP BY ALL),
longest AS (SELECT r, item_id, max(c) AS longest FROM chain GROUP BY ALL),
size_of AS (SELECT DISTINCT item_id, n_items, n FROM bw),
short AS (
  SELECT line, min(id) AS item_id, count(DISTINCT id) AS n_items
  FROM (SELECT id, lower(array_to_string(x, ' ')) AS line FROM raw WHERE side = 'b' AND len(x) BETWEEN 1 AND {SHORTEST - 1}) GROUP BY line),
lines AS (
  SELECT DISTINCT doc_id, r, lower(array_to_string(list_filter(string_split_regex(regexp_replace(line, '[{_sql_class(PUNCTUATION)}{DASHES}]+', '', 'g'), '[{_sql_class(SPACES)}]+'), lambda x: x <> ''), ' ')) AS line
  FROM (SELECT id AS doc_id, r, unnest(string_split_regex(coalesce(text, ''), '[\n\r]+')) AS line FROM src WHERE side = 'd'))
SELECT doc_id, item_id, n_items, CAST(n AS BIGINT) AS n_windows, n_matched, n_matched / n AS coverage, longest
FROM per JOIN longest USING (r, item_id) JOIN size_of USING (item_id) WHERE n_matched / n >= {SHARE} OR longest >= {RUN}
UNION ALL SELECT doc_id, item_id, n_items, 1, 1, 1.0, 1 FROM lines JOIN short USING (line)
"""
