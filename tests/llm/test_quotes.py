import duckdb
import pyarrow as pa

from tukeyframe.llm import quotes

SCHEMA = "conv_id long, turn long, text string, body string"
LONG = "\n".join(f"line {i} of a long message" for i in range(3000))
ROWS = [
    (1, 0, "First message here.\nSecond line of it.\n\nAnother paragraph."),
    (1, 1, "On Monday A wrote:\n> First  MESSAGE here.\n> Second line of it.\n\nI agree with that."),
    (1, 2, "> On Tuesday B wrote:\n>> First message here.\n>> Second line of it.\n> I agree with that.\nSo do I."),
    (1, 3, "> Another paragraph.\nAbout the other thing."),
    (1, 4, ">  never said\nNew topic."),
    (1, 5, "> New topic.\r\n> > never said\r\nYes: x > y\r\n"),
    (1, 6, "> Yes: x > y"),
    (1, 7, "> A later line."),
    (1, 8, "A later line."),
    (1, 9, "First message here."),
    (1, 10, "> First message here.\nthe earliest turn has it"),
    (2, 0, "First message here."),
    (2, 1, "> I agree with that.\nIn another conversation"),
    (3, 0, LONG),
    (3, 1, "\n".join("> " + x for x in LONG.split("\n")) + "\nall of it"),
    (4, 0, None),
    (4, 1, ""),
    (4, 2, "\n\n"),
    (None, 1, "> First message here."),
    (1, None, "> First message here."),
    (1, 3, "> Another paragraph.\nAbout the other thing."),
    (6, 0, "ok"),
    (6, 1, "This is a first long line.\nand a second one\nand a third one"),
    (6, 2, "and a second one"),
    (6, 3, "> ok\nmentions nothing"),
    (6, 4, "> This is a first long line.\n> and a second one\n> and a third one\n\n> and a second one\nall of turn 1"),
    (6, 5, "> mentions nothing\n\n> This is a first long line.\n> something else\nthe passage counts"),
    *((5, i, (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(40)),
]


def by_sql(rows):
    table = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.string())})
    con = duckdb.connect()
    con.register("messages", table)
    return con.execute(quotes.SQL.format(table="messages")).fetchall()


def test_conversations_match_the_sql(spark):
    got = [tuple(r) for r in quotes.conversations(spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(by_sql(ROWS), key=str)


def test_expected_links(spark):
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)).collect()}
    assert [got[1, t].reply_to for t in range(11)] == [None, 0, 1, 0, None, 4, 5, None, None, None, 0]
    assert got[1, 2].body == "So do I." and got[1, 1].body == "I agree with that." and got[1, 5].body == "Yes: x > y"
    assert (got[1, 2].root_turn, got[1, 2].depth) == (0, 2) and got[2, 1].reply_to is None
    assert (got[5, 39].root_turn, got[5, 39].depth) == (0, 39)
    assert (got[3, 1].reply_to, got[3, 1].body) == (0, "all of it")
    assert (got[None, 1].reply_to, got[None, 1].depth, got[4, 0].body) == (None, 0, "")


def test_empty_table(spark):
    assert quotes.conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_passages_count_before_lines_and_short_quotes_not_at_all(spark):
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)).collect() if r.conv_id == 6}
    assert [got[t].reply_to for t in range(6)] == [None, None, None, None, 1, 3]
    assert [t for _, t in sorted((got[t].position, t) for t in got)] == [0, 1, 4, 2, 3, 5]


def test_positions_of_a_conversation_over_many_partitions(spark):
    rows = [(1, i, f"> this is message number {i - 2}\nthis is message number {i}") for i in range(300)] + [(None, 1, "x"), (1, None, "y"), (2, 5, "z")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = quotes.conversations(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1 and r.turn is not None), key=lambda r: r.position)] == [*range(0, 300, 2), *range(1, 300, 2)]
    assert sorted((r.position for r in got if r.conv_id == 1 and r.turn is not None)) == list(range(1, 301))
    assert {(r.conv_id, r.turn): r.position for r in got if r.conv_id != 1 or r.turn is None} == {(None, 1): None, (1, None): None, (2, 5): 1}
