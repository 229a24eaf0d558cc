"""Quotation linking: nested quotes are parsed, hashed, joined to the messages that they quote, and taken out.

All of it is DataFrame functions. A message's lines get a quote level (the ``>`` marks at the line's start); a passage is
a run of lines of one level without an empty line. Passages and their single lines, in lower case with white space
collapsed, are hashed; level 0 makes originals, deeper levels make quotes. An original's hash is first reduced to the earliest
turn of its conversation that has it, so the join from quotes meets one row a hash, and neither a line that many messages
share nor a very long conversation has to be held by one task. Quotes of under MIN_TEXT characters ("ok") say nothing about
where they come from and link to nothing. A message replies to the latest message that one of its shallowest linked quotes
comes from, whole passages counting before single lines; roots and depths come from doubling the reply links, a fixed number
of joins for any chain up to that power of two.

A message's position numbers its conversation from 1 in reply order: threads by the turn of their root, within a thread by turn,
so that every message comes after the one that it answers. Rows are sorted in ranges, and a long conversation may span many.

Defined results: a null or empty text gives an empty body without quotes; a message that quotes nothing known is its own
root at depth 0; quotes never link to the own or a later turn; rows with a null conversation or turn are kept, never
linked and have no position; repeated rows give repeated results; ties between sources go to the latest turn; an empty table gives no rows;
only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tukeyframe.llm import scratch
from tukeyframe.llm.native import hold

#: Characters, white space collapsed, of the shortest quote that links.
MIN_TEXT = 8
MARKS = r"^((?:[ \t]*>)*)"
#: A line just before a quote that says whose it is.
ATTRIBUTION = r"(?i)\b(wrote|writes|schrieb|escribi\x{F3}|a \x{E9}crit)\s*:\s*$"


def _normal(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Messages (conv, turn, row) with body and passages: array<struct<level, text>>, split by index arithmetic in the row."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "\r\n?", "\n"), "\n", -1)
    rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.monotonically_increasing_id().alias("row"), lines.alias("line"))
    marks = F.transform("line", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[ \t]", "")))
    rest = F.transform("line", lambda x: F.trim(F.regexp_replace(x, MARKS, "")))
    rows = hold(rows, level=marks, rest=rest).drop("line")
    at = lambda c, i: F.get(F.col(c), i)
    quoted_next = lambda i: F.coalesce(at("level", i + 1) > at("level", i), F.lit(False))
    said = F.transform("rest", lambda x, i: x.rlike(ATTRIBUTION) & quoted_next(i))
    rows = hold(rows, said=said)
    blank = lambda i: (at("rest", i) == "") | at("said", i)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("rest") - 1),
        lambda i: ~blank(i) & ((i == 0) | (at("level", i) != at("level", i - 1)) | blank(i - 1)),
    )
    ends = F.filter(
        F.sequence(F.lit(0), F.size("rest") - 1),
        lambda i: ~blank(i) & ((i == F.size("rest") - 1) | (at("level", i) != at("level", i + 1)) | blank(i + 1)),
    )
    rows = hold(rows, starts=starts, ends=ends)
    passages = F.transform(
        "starts",
        lambda s, k: F.struct(at("level", s).alias("level"), F.array_join(F.slice("rest", s + 1, at("ends", k) - s + 1), "\n").alias("text")),
    )
    body = F.array_join(F.filter("rest", lambda x, i: (at("level", i) == 0) & ~at("said", i)), "\n")
    return rows.select("conv", "turn", "row", F.trim(F.regexp_replace(body, r"^\n+|\n+$", "")).alias("body"), passages.alias("passages"))


def units(parsed: DataFrame) -> DataFrame:
    """A row for each distinct (conv, turn, level, hash) of a passage or one of its lines, with its size in characters and
    whether it is a whole passage."""
    passage = parsed.where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", "turn", F.explode("passages").alias("p"))
    lines = F.transform(F.split("p.text", "\n"), lambda x: F.struct(_normal(x).alias("text"), F.lit(False).alias("whole")))
    texts = F.concat(F.array(F.struct(_normal(F.col("p.text")).alias("text"), F.lit(True).alias("whole"))), lines)
    each = passage.select("conv", "turn", F.col("p.level").alias("level"), F.explode(texts).alias("u")).where(F.col("u.text") != "")
    return each.groupBy("conv", "turn", "level", F.md5("u.text").alias("hash")).agg(F.max(F.length("u.text")).alias("size"), F.max("u.whole").alias("whole"))


def links(parsed: DataFrame) -> DataFrame:
    """Quotes with their source: conv, turn, level, hash, whole, source (null if no earlier turn has the passage)."""
    quotes = units(parsed.withColumn("passages", F.filter("passages", lambda p: p["level"] > 0)))
    own = units(parsed.withColumn("passages", F.filter("passages", lambda p: p["level"] == 0)))
    sources = own.where(F.col("size") >= MIN_TEXT).groupBy("conv", "hash").agg(F.min("turn").alias("source"))
    joined = quotes.join(sources, ["conv", "hash"], "left")
    return joined.select("conv", "turn", "level", "hash", "whole", F.when(F.col("source") < F.col("turn"), F.col("source")).alias("source"))


def ancestors(replies: DataFrame) -> DataFrame:
    """For reply links (conv, turn, reply_to), one a message, the root of each message and its depth, by doubling."""
    state = scratch.materialise(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        above = state.select(F.col("conv"), F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        stepped = scratch.materialise(state.join(above, ["conv", "root"], "left"), "replies")
        moved = not stepped.where(F.col("next").isNotNull()).isEmpty()
        state = stepped.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if not moved:
            return state


def positions(threads: DataFrame) -> DataFrame:
    """(row, position) for rows (row, conv, root_turn, turn, mark): each row's number, from 1, in its conversation by root_turn,
    turn and mark. Rows are sorted in ranges over all conversations; partitions and conversations are numbers a partition."""
    order = ["conv", "root_turn", "turn", "mark"]
    ranged = threads.where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.materialise(ranged.select("row", "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("start"))
    heads = placed.groupBy("part", "conv").agg(F.min("at").alias("at")).join(starts, "part")
    first = heads.groupBy("conv").agg(F.min(F.col("at") + F.col("start")).alias("first"))
    shift = heads.join(first, "conv").select("part", "conv", (F.col("start") - F.col("first") + 1).alias("shift"))
    return placed.join(shift, ["part", "conv"]).select("row", (F.col("at") + F.col("shift")).alias("position"))


def conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """A row for each message: its body without quotes, what it replies to, and its place in reply order: a conversation's
    rows by position are the conversation without quotes."""
    parsed = scratch.materialise(parse(messages, conversation, turn, text), "messages")
    found = scratch.materialise(links(parsed), "links")
    linked = F.col("source").isNotNull()
    best = F.max(F.when(linked, F.struct((-F.col("level")).alias("near"), F.col("whole"), F.col("source").alias("source"))))
    per = found.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(linked).alias("n_linked"), best.getField("source").alias("reply_to"))
    replies = scratch.materialise(per, "per-message")
    placed = ancestors(replies.where(F.col("reply_to").isNotNull()))
    threads = parsed.select("row", "conv", "turn", F.md5("body").alias("mark")).join(placed.select("conv", "turn", "root"), ["conv", "turn"], "left")
    threads = scratch.materialise(threads.select("row", "conv", F.coalesce("root", "turn").alias("root_turn"), "turn", "mark"), "threads")
    out = parsed.drop("passages").join(replies, ["conv", "turn"], "left").join(placed, ["conv", "turn"], "left").join(positions(threads), "row", "left")
    return out.select(
        F.col("conv").alias(conversation),
        F.col("turn").alias(turn),
        "body",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "position",
    )


def with_replies(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages in which every odd turn quotes the whole turn before it, with an attribution: a made table for the proof that
    quotes are linked, where a table has none."""
    previous = messages.select(F.col(conversation).alias(conversation), (F.col(turn) + 1).alias(turn), F.coalesce(F.col(text), F.lit("")).alias("_said"))
    said = F.concat(F.lit("On that day they wrote:\n> "), F.regexp_replace("_said", "\n", "\n> "), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")))
    quoting = (F.col(turn) % 2 == 1) & F.col("_said").isNotNull()
    return messages.join(previous, [conversation, turn], "left").select(conversation, turn, F.when(quoting, said).otherwise(F.col(text)).alias(text))


REPLIES_SQL = """(SELECT m.conv_id, m.turn, CASE WHEN m.turn % 2 = 1 AND p.turn IS NOT NULL
  THEN 'On that day they wrote:' || chr(10) || '> ' || replace(coalesce(p.text, ''), chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(m.text, '') ELSE m.text END AS text
  FROM conversations m LEFT JOIN conversations p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1)"""


#: The same in DuckDB SQL over a table {table} (conv_id, turn, text).
SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id AS conv, turn, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM {table}),
l AS (SELECT id, conv, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM m),
a AS (
  SELECT id, conv, turn, i, len(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[ \t]', '', 'g')) AS level,
         trim(regexp_replace(line, '^((?:[ \t]*>)*)', ''), ' ') AS rest FROM l),
b AS (
  SELECT *, coalesce(lead(level) OVER w > level, false) AND regexp_matches(rest, '(?i)\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$') AS said
  FROM a WINDOW w AS (PARTITION BY id ORDER BY i)),
c AS (SELECT *, rest = '' OR said AS blank FROM b),
d AS (SELECT *, CASE WHEN NOT blank AND (lag(level) OVER w IS DISTINCT FROM level OR coalesce(lag(blank) OVER w, true)) THEN 1 ELSE 0 END AS starts FROM c WINDOW w AS (PARTITION BY id ORDER BY i)),
e AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i) AS run FROM d),
p AS (SELECT id, conv, turn, run, any_value(level) AS level, string_agg(rest, chr(10) ORDER BY i) AS text FROM e WHERE NOT blank GROUP BY id, conv, turn, run),
u AS (
  SELECT conv, turn, level, unit, bool_or(whole) AS whole FROM (
    SELECT conv, turn, level, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS unit, true AS whole FROM p
    UNION ALL SELECT conv, turn, level, trim(regexp_replace(lower(rest), '\s+', ' ', 'g'), ' '), false FROM e WHERE NOT blank)
  WHERE unit <> '' AND conv IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
o AS (SELECT conv, unit, min(turn) AS source FROM u WHERE level = 0 AND length(unit) >= 8 GROUP BY conv, unit),
k AS (SELECT u.conv, u.turn, u.level, u.whole, CASE WHEN o.source < u.turn THEN o.source END AS source FROM u LEFT JOIN o USING (conv, unit) WHERE u.level > 0),
n AS (
  SELECT conv, turn, count(*) AS n_quotes, count(source) AS n_linked, arg_max(source, -2000000000 * level + 1000000000 * CAST(whole AS INT) + source) FILTER (WHERE source IS NOT NULL) AS reply_to
  FROM k GROUP BY conv, turn),
t AS (
  SELECT conv, turn, reply_to AS root, 1 AS depth FROM n WHERE reply_to IS NOT NULL
  UNION ALL SELECT t.conv, t.turn, n.reply_to, t.depth + 1 FROM t JOIN n ON n.conv = t.conv AND n.turn = t.root WHERE n.reply_to IS NOT NULL),
r AS (SELECT conv, turn, min(root) AS root, max(depth) AS depth FROM t GROUP BY conv, turn),
y AS (SELECT id, string_agg(rest, chr(10) ORDER BY i) AS body FROM e WHERE level = 0 AND NOT said GROUP BY id)
SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY root_turn, turn, md5(body)) END AS position FROM (
SELECT m.conv AS conv_id, m.turn, trim(regexp_replace(coalesce(body, ''), '^\n+|\n+$', '', 'g'), ' ') AS body, coalesce(n_quotes, 0) AS n_quotes,
       coalesce(n_linked, 0) AS n_linked, reply_to, coalesce(root, m.turn) AS root_turn, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth
FROM m LEFT JOIN y USING (id) LEFT JOIN n ON n.conv = m.conv AND n.turn = m.turn LEFT JOIN r ON r.conv = m.conv AND r.turn = m.turn)
"""
