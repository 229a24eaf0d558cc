import random

import duckdb
import pyarrow as pa
import pytest

from tukeyframe.llm import decontaminate

ITEMS = [
    (1, "A train leaves Paris at 9:30 and travels 120 km to reach Lyon before the second train from Paris arrives there."),
    (2, "If Tom has 5 apples and Mary has 7 apples, how many apples do Tom and Mary have together after Tom eats 2?"),
    (3, "short one here"),
    (4, "exactly six words are written here"),
    (5, None),
    (None, "An item without an id has words and more words and still more words."),
    (6, "The river runs past the old mill and under the stone bridge until it meets the wide grey sea."),
    (6, "The river runs past the old mill and under the stone bridge until it meets the wide grey sea."),
]
DOCS = [
    (1, "Some words first. " + ITEMS[0][1] + " And then some words."),
    (2, "Noise here. If Anna has 11 apples and Bob has 3 apples, how many apples do Anna and Bob have together after Anna eats 9? End."),
    (3, "Noise here. If Anna has 11 apples and Bob has 3 apples, how many apples do Carl and Dora have together after Emil eats 9? End."),
    (4, "A train leaves Berlin at 10:15 and travels 300 miles to reach Bonn before the second train from Berlin arrives there."),
    (5, "A train leaves Berlin at 10:15 and travels 300 miles to reach Bonn before the second train from Munich arrives there."),
    (6, "we say exactly six words are written here today"),
    (7, "short one here and nothing else that anybody would know"),
    (8, None),
    (9, ""),
    (10, "... !!! ??? -- the river runs past the OLD mill, and under the stone bridge until"),
    (None, ITEMS[6][1]),
    (1, "Some words first. " + ITEMS[0][1] + " And then some words."),
    (11, "word " * 20_000 + ITEMS[6][1]),
    (12, "Clean words about a train, a mill and the sea; Tom has none of it."),
    (13, ITEMS[1][1] + " " + ITEMS[1][1].replace("Tom", "Ida").replace("7", "8")),
]


def tables(spark):
    return spark.createDataFrame([(*r, "clash") for r in DOCS], "doc_id long, text string, h string"), spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, n int")


def by_sql(docs, items):
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.register(name, pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return con.execute(decontaminate.SQL).fetchall()


def compared(spark, docs, items):
    """The rows of matches(), which must be those of the SQL."""
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(by_sql(docs, items))
    return got


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_against_sql(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    got = compared(spark, DOCS, ITEMS)
    assert {r.doc_id for r in got} == {1, 2, 4, 6, 7, 10, 11, 13} - {7}
    assert sum(r.doc_id == 1 and r.item_id == 1 for r in got) == 2  # repeated rows match each for itself
    assert {r.coverage for r in got if (r.doc_id, r.item_id) in ((1, 1), (13, 2))} == {1.0}


def test_extra_columns_are_not_read(spark):
    docs, items = tables(spark)
    assert sorted(tuple(r) for r in decontaminate.matches(docs, items).collect()) == sorted(by_sql(DOCS, ITEMS))


ASKED = "If Tom has 5 apples and Mary has 7 apples, how many apples do Tom and Mary have together after Tom eats 2?"


@pytest.mark.parametrize(
    "text, found",
    [
        ("If Anna has 11 apples and Bob has 3 apples, how many apples do Anna and Bob have together after Anna eats 9?", True),
        ("If Anna has 11 apples and Bob has 3 apples, how many green apples do Anna and Bob have together after Anna eats 9?", True),
        ("If Anna has 11 apples and Bob has 3 apples, how many green apples do Carl and Dora have together after Emil eats 9?", False),
        ("If Anna has 11 apples and Anna has 3 apples, how many apples do Anna and Anna have together after Anna eats 9?", False),
        ("If Anna has 6 apples and Bob has 6 apples, how many apples do Anna and Bob have together after Anna eats 6?", True),
        (ASKED.replace("after Tom", "after Ida"), True),  # nearly all windows are the words themselves
        (ASKED.lower(), False),
    ],
)
def test_slots_have_one_binding(spark, text, found):
    got = compared(spark, [(1, "We were asked this. " + text + " Nobody knew.")], [(1, ASKED)])
    assert bool(got) == found


def test_numbers_that_meet_by_chance(spark):
    item = "A tank holds 2 litres of water and a pump adds 2 litres of clean water to the tank in every hour of the day, so how long does it take"
    text = item.replace("2", "3", 1).replace("2", "5", 1)
    assert compared(spark, [(1, text)], [(1, item)])


def words(n, seed=0):
    return " ".join("".join(random.Random(f"{seed}-{i}").choices("abcdefghijklmnopqrstuvwxyz", k=7)) for i in range(n))


def test_excerpts_of_long_items_and_altered_copies(spark):
    long = words(250)
    excerpt = " ".join(long.split()[100:150])
    named = " ".join(w if i % 9 else "Paula" for i, w in enumerate(words(90, 2).split()))
    altered = named.replace("Paula", "Berta", 3).replace("Berta", "Paula", 2)
    docs = [(1, words(40, 5) + " " + excerpt + " " + words(40, 6)), (2, " ".join(long.split()[100:110])), (3, altered), (4, words(300, 7))]
    assert {(r.doc_id, r.item_id) for r in compared(spark, docs, [(1, long), (2, named)])} == {(1, 1), (3, 2)}


def test_items_of_one_template_are_a_class(spark):
    items = [(i, f"How many of the {i + 3} red apples that the farmer has picked are left when {2 * i} are eaten") for i in range(20)]
    docs = [(i, t) for i, t in items] + [(100 + i, t.replace("picked", "PICKED,")) for i, t in items]
    got = compared(spark, docs, items)
    # the two numbers of item 3 are equal, which makes it a class of its own; every document is of either form
    assert len(got) == 80 and {(r.item_id, r.n_items) for r in got} == {(0, 19), (3, 1)}


def test_tables_of_numbers_match_only_themselves(spark):
    numbers = lambda k: " ".join(str(i * k % 97) for i in range(1, 30))
    assert {r.doc_id for r in compared(spark, [(1, numbers(7)), (2, numbers(11)), (3, " ".join(["5"] * 3000))], [(1, numbers(7))])} == {1}


def test_short_items_match_whole_lines(spark):
    docs = [(1, "first line\nShort, one here!\nlast"), (2, "a short one here"), (3, "short one here"), (3, "short one here"), (4, None)]
    assert sorted(r.doc_id for r in compared(spark, docs, [(1, "short one here"), (2, "Short one HERE."), (3, ""), (4, "..."), (5, "two three four five six seven")])) == [1, 3, 3]


def test_clean(spark):
    docs, items = tables(spark)
    kept = [r.doc_id for r in decontaminate.clean(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([3, 5, 7, 8, 9, None, 12], key=str)
    clash = docs.withColumn("contaminated", docs.doc_id)
    assert decontaminate.clean(clash, items).columns == clash.columns


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert decontaminate.matches(docs.limit(0), items).collect() == []
    assert decontaminate.matches(docs, items.limit(0)).collect() == []


def test_clean_treats_words_that_open_sentences_alike(spark):
    items = spark.createDataFrame([(1, "Anna sells 12 red apples daily.")], "item_id long, text string")
    rows = [(1, "Peter sells 40 red apples daily."), (2, "y coas Eaea ndorea Anna sells 12 red apples daily."), (3, "We know that Peter sells 40 red apples daily."), (4, "Peter sells 40 green pears daily.")]
    assert [r.doc_id for r in decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()] == [4]


def test_gaps_and_places_in_a_sentence(spark):
    docs = [(1, "we all saw that young" + " \n" * 20 + "Peter went over to the old mill again"), (2, " " * 40 + "Peter went over"), (3, "we all saw that young." + " " * 40 + "Peter went over to the old mill again")]
    got = compared(spark, docs, [(1, "we all saw that young Anna went over to the old mill again")])
    assert {(r.doc_id, r.coverage) for r in got} == {(1, 1.0), (3, 1.0)}


def test_clean_takes_units_in_any_case(spark):
    items = spark.createDataFrame([(1, "they walked about 12 km along the quiet road")], "item_id long, text string")
    rows = [(1, "they walked about 30 KM along the quiet road"), (2, "they walked about 7 Miles along the quiet road"), (3, "they walked about 7 times along the busy road")]
    assert [r.doc_id for r in decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()] == [3]
