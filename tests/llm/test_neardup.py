import random
import re

import numpy as np
import pytest

from tukeyframe.llm import neardup, shingles


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, len(sets[i]), None if key is None else least[find(i)], key is None or least[find(i)] == key) for i, (key, _) in enumerate(rows)]


def words(rng, n):
    return [f"{rng.choice('bcdfgh')}{rng.randint(0, 400)}" for _ in range(n)]


def corpus(seed, n=60):
    rng, texts = random.Random(seed), []
    base = words(rng, 120)
    for _ in range(n):  # near copies from almost equal to barely alike
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz") + str(rng.randint(0, 3))
        texts.append(" ".join(copy))
    passage = " ".join(words(rng, 30))
    texts += [f"{passage} {' '.join(words(rng, rng.randint(5, 40)))}" for _ in range(n)]
    texts += [" ".join(words(rng, rng.randint(1, 9))) for _ in range(n)]
    texts += ["Same Text here\tof six\x0bwords", "same text HERE of six words", "É a b c d e", "é a b c d e", "one two", "two one", "one two", *["copied five times over and over"] * 5, "\x1c a b c d", "", None, "   \n", " ".join(words(rng, 30_000))]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(None, "one two"), (3, texts[3]), (3, "one two"), (0, texts[1])]


@pytest.mark.parametrize(("seed", "block", "many", "own"), [(1, 1 << 19, 8, 256), (2, 4096, 1000, 8), (2, 2048, 1, 8), (4, 512, 1, 2)])
def test_against_brute_force(spark, monkeypatch, seed, block, many, own):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "MANY", many)
    monkeypatch.setattr(neardup, "HEADS", 2)
    monkeypatch.setattr(neardup, "OWN", own)
    monkeypatch.setattr(neardup, "SALT_ROWS", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = [tuple(r) for r in neardup.deduplicate(docs).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_empty_table(spark):
    assert neardup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sets_match_plain_sets():
    texts = [t for _, t in corpus(3)] + ["a" * 200_000, "x y z", "A\x00b c d e f"]
    for text, found in zip(texts, shingles.shingle_sets(texts), strict=True):
        assert len(found) == len(plain_set(text)) and (np.diff(found.astype(object)) > 0).all()
        assert (found == shingles.shingle_set(text)).all()


def test_intersections(monkeypatch):
    monkeypatch.setattr(neardup, "DENSE", 20)
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(n)] for n in (17, 23))
    found = neardup._intersections(a, b)
    assert all(found[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(a) for j, y in enumerate(b))


def test_signature_is_circulant_minhash():
    found = shingles.shingle_set("a b c d e f g h i j")
    order = shingles._circle(shingles.UNIVERSE_BITS, shingles.COORDINATES)[:, 0]
    places = shingles.mix(found, 4) >> np.uint64(64 - shingles.UNIVERSE_BITS)
    size = 1 << shingles.UNIVERSE_BITS
    assert [min(int(order[(int(p) + k) % size]) for p in places) for k in range(5)] == shingles.signature(found)[:5].tolist()


def test_many_variants_of_one_text_meet_in_few_rows(spark):
    rng = random.Random(9)
    base, rows = words(rng, 100), []
    for i in range(20_000):
        copy = list(base)
        copy[rng.randrange(100)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    described = neardup.scratch.materialise(neardup.describe(docs), "described")
    seen = []
    compared = neardup._compared

    def counted(meetings, *rest):
        seen.append(meetings.count())
        return compared(meetings, *rest)

    neardup._compared = counted
    try:
        classes, forest = neardup.links(described, docs)
        assert neardup.components(forest, classes).select("rep").distinct().count() == 1
    finally:
        neardup._compared = compared
    assert len(seen) == 2 and sum(seen) < 2 * len(rows)


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (2, "a b c d e f", 8, "y"), (3, "else", 9, "z"), (None, "a b c d e f", 0, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long, repeated string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted((docs.collect()[i] for i in (0, 3, 4)), key=str)
