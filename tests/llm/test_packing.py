import random
import re

import pytest

from tukeyframe.llm import packing


def tokens(text):
    """The tokens, by a pattern."""
    kinds = r"[ \t\n\x0b\x0c\r]|[A-Za-z\x80-\U0010ffff]|[0-9]|[^ \t\n\x0b\x0c\rA-Za-z0-9\x80-\U0010ffff]".split("|")
    runs = [m[0] for m in re.finditer("|".join(f"(?:{k})+" for k in kinds), text)]
    cut = [[r[i : i + packing.TOKEN] for i in range(0, len(r), packing.TOKEN)] for r in runs]
    out = []
    for k, own in enumerate(cut):
        if out and cut[k - 1] == [" "]:
            out[-1] += own[0]
            own = own[1:]
        out += own
    return out


TEXTS = [None, "", "a", " a", "a ", "  a  b", "x" * 200_000, "é" * 50, "Ab12, cd!\n\n(été) 日本語 😀😀" * 40, "one two  three" * 3_000, "\t", "don't 3.14159265 https://x.yz/a_b"]


def check(rows, docs, capacities=packing.CAPACITIES):
    """The pieces give the texts again, bins hold what they say, and sequences have as many tokens as their pieces."""
    bins, pieces = {}, {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.n_tokens == 0 and r.text == "" and r.capacity is None
        pieces.setdefault(r.doc_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at and r.n_tokens == len(tokens(r.text)) > 0
            at += r.n_tokens
        assert len({r.capacity for r in own}) == 1
        assert own[0].capacity == min(c for c in capacities if c >= at)  # downsized
    for key, text in docs:
        own = sorted(pieces[key], key=lambda r: r.piece)
        assert "".join(r.text for r in own) == (text or "")
        assert [(text or "")[r.start : r.stop] for r in own] == [r.text for r in own]
        assert [r.piece for r in own] == list(range(max(1, -(-len(tokens(text or "")) // max(capacities)))))


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, bin_id string")
    rows = packing.pack_documents(docs).collect()
    check(rows, list(enumerate(TEXTS)))
    assert {r.doc_id for r in rows if r.bin_id is None} == {0, 1}
    small = packing.pack_documents(docs, capacities=(4, 16, 64), group_bytes=1000).collect()
    check(small, list(enumerate(TEXTS)), (4, 16, 64))
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other text"), (None, "x y"), (None, "x y"), (2, "z")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "x y"), (0, "x y"), (1, "a b c"), (1, "a b c"), (1, "other text"), (2, "z")]
    assert len({(r.bin_id, r.bin_offset) for r in rows}) == 6


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "12", "é?"], k=rng.choice([1, 5, 100, 600, 9000])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{tuple(r) for r in packing.pack_documents(docs.repartition(n), group_bytes=50_000).collect()} for n in (1, 7)]
    assert found[0] == found[1] and len({r[6] >> 32 for r in found[0]}) > 2


def test_one_id_many_times_is_dealt_out(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'the same words again' AS text")
    rows = packing.pack_documents(docs, group_bytes=6000).collect()
    assert len(rows) == 3000 and len({r.bin_id >> 32 for r in rows}) == 10


def least_cost(lengths, capacities, overhead):
    """The least cost of all ways to part the lengths into bins."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= b) + overhead for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= max(capacities):
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_near_the_least_cost_of_all_packings():
    rng, ratios = random.Random(4), []
    for _ in range(150):
        capacities = rng.choice([(8, 16, 32), (5, 12, 20), (10, 30)])
        lengths = sorted((rng.randint(1, max(capacities)) for _ in range(rng.randint(1, 7))), reverse=True)
        places, sizes = packing.pack_lengths(lengths, capacities, 2)
        assert all(sum(x for x, (b, _) in zip(lengths, places, strict=True) if b == k) <= c for k, c in enumerate(sizes))
        ratios.append((sum(sizes) + 2 * len(sizes)) / least_cost(lengths, capacities, 2))
    assert min(ratios) >= 1 and sum(ratios) / len(ratios) < 1.02 and max(ratios) < 1.3


def best_fit(lengths, capacity):
    """Plain best-fit decreasing with one capacity."""
    gaps = []
    for x in lengths:
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_one_capacity_is_best_fit_and_several_waste_less(seed):
    rng = random.Random(seed)
    lengths = sorted((min(8192, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(300)), reverse=True)
    _, sizes = packing.pack_lengths(lengths, (8192,))
    assert len(sizes) == best_fit(lengths, 8192)
    _, several = packing.pack_lengths(lengths)
    assert sum(several) + packing.OVERHEAD * len(several) <= sum(sizes) + packing.OVERHEAD * len(sizes)
    assert sum(several) <= 1.1 * sum(lengths)
