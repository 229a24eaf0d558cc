"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard on full shingle sets, components.

1. Every whole text becomes its set of distinct 5-word shingles, a 128-bit digest of the set, and the band keys of its
   signature (two permutations, one shifted around a circle; see shingles.py). Texts with equal sets form one class; only
   the class with its smallest id goes on, so exact copies cost no pairs however many they are.
2. Band keys with one class are dropped by counting. A class's family is that of the smallest class that shares a key with
   it; where a key joins classes of different families, the class of the larger family number visits the other family.
3. A family is cut into blocks by the size of the sets and a hash, each of at most about BLOCK shingles however large the
   family is. Two blocks that may hold similar sizes meet in one task, which counts all intersections exactly (common
   shingles as a matrix product, the others by postings) and returns a spanning forest of the links: never more rows
   than classes. So every two classes that share a band key are compared on their full sets, and no group is held whole.
4. In a family of more than MANY blocks each block first meets the family's heads only, the HEADS classes of each size whose
   band keys most others share, which for copies of one text are what most of them link to. What has thereby come together
   needs no further comparison; then blocks are cut anew, by component, and only blocks that aren't of one component meet.
   For a family whose copies link to its heads all this is linear in its size; the rest of it meets all others.
5. Components of the forests by distributed label propagation with pointer jumping; then classes go back to documents.

Two texts of similarity 0.75 share no band key with a probability of 5e-6 (32 bands of 4).

Defined results: a null or wordless text has an empty set, n_shingles 0, is its own component and linked with nothing;
with fewer than five words the whole sequence is the one shingle; rows with a null id are never linked, their component is
null and they are kept; rows that repeat an id get a result each; an empty table gives an empty result; ids must be whole
numbers (others are an error); columns other than the id and the text are not read, and keep_one() leaves all as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tukeyframe.llm import scratch, shingles
from tukeyframe.llm.native import fresh

#: Shingles (each class counts as MIN_SIZE at least) in a block, on average.
BLOCK, MIN_SIZE = 1 << 17, 256
#: Blocks from which a family's blocks meet its heads first, heads of each size, and classes of a component that get blocks of
#: their own thereafter.
MANY, HEADS, OWN = 8, 32, 256
#: Rows of one class from which they are dealt to several tasks.
SALT_ROWS = 1000
#: Products of posting lengths from which a shingle is counted by a matrix product.
DENSE = 4096


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that few rows at a time are Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def describe(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n (size of the set), node (digest of the set), bands; the last two null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles.shingle_sets(batch.column(1).to_pylist())
            nodes = pa.array([shingles.digest(s) if len(s) else None for s in sets], pa.binary())
            bands = pa.array([shingles.band_keys(shingles.signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, nodes, bands], names=["doc_id", "n", "node", "bands"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return scratch.text_batches(rows).mapInArrow(run, "doc_id long, n long, node binary, bands array<long>")


def _sets(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The full sets (64-bit words) of the wanted classes (node, rep), read again from the rows with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles.shingle_sets(batch.column(0).to_pylist())
            nodes = pa.array([shingles.digest(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    ids = scratch.small(scratch.materialise(wanted.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.join(ids, "doc_id", "left_semi").select("text")
    found = scratch.text_batches(found).mapInArrow(run, "node binary, set binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def block_forest(nodes: list[bytes], sets: list[np.ndarray], left: np.ndarray, percent: int = 75) -> list[tuple[bytes, bytes]]:
    """(node, first node of its component) from the exact links between left and right nodes; left == right if all are left."""
    a = np.flatnonzero(left)
    b = np.flatnonzero(~left) if not left.all() else a
    if len(nodes) < 2 or not len(a) or not len(b):
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    both = _intersections([sets[i] for i in a], [sets[i] for i in b])
    link = 100 * both >= percent * (sizes[a][:, None] + sizes[b] - both)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.where(link, label[b], len(nodes)).min(axis=1)
        label[a] = np.minimum(label[a], low)
        low = np.where(link, label[a][:, None], len(nodes)).min(axis=0)
        label[b] = np.minimum(label[b], low)
        label = np.minimum(label, label[label])
    return [(nodes[i], nodes[int(label[i])]) for i in range(len(nodes)) if label[i] != i]


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets of a with sets of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    words_a, own_a = np.concatenate(a), np.repeat(np.arange(len(a)), [len(s) for s in a])
    words_b, own_b = np.concatenate(b), np.repeat(np.arange(len(b)), [len(s) for s in b])
    order_a, order_b = np.argsort(words_a, kind="stable"), np.argsort(words_b, kind="stable")
    words_a, own_a, words_b, own_b = words_a[order_a], own_a[order_a], words_b[order_b], own_b[order_b]
    uniq_a, first_a, count_a = np.unique(words_a, return_index=True, return_counts=True)
    uniq_b, first_b, count_b = np.unique(words_b, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(uniq_a, uniq_b, assume_unique=True, return_indices=True)
    first_a, count_a, first_b, count_b = first_a[i], count_a[i], first_b[j], count_b[j]
    pairs = count_a * count_b
    heavy = np.flatnonzero(pairs >= DENSE)
    for start in range(0, len(heavy), 2048):
        part = heavy[start : start + 2048]
        x, y = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        for m, own, first, count in ((x, own_a, first_a[part], count_a[part]), (y, own_b, first_b[part], count_b[part])):
            at = _ranges(first, count)
            m[own[at], np.repeat(np.arange(len(part)), count)] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    light = np.flatnonzero(pairs < DENSE)
    ends = np.cumsum(pairs[light])
    start = 0
    while start < len(light):  # about a million pairs at a time
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
        part = light[start:stop]
        at_a = np.repeat(_ranges(first_a[part], count_a[part]), np.repeat(count_b[part], count_a[part]))
        at_b = _ranges(np.repeat(first_b[part], count_a[part]), np.repeat(count_b[part], count_a[part]))
        out += np.bincount(own_a[at_a] * len(b) + own_b[at_b], minlength=out.size).reshape(out.shape)
        start = stop
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then the same for the next ones."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(count) - count
    return np.repeat(first - skip, count) + np.arange(total)


def _families(members: DataFrame) -> DataFrame:
    """Classes with their families: distinct (family, node, visitor) from distinct (key, node)."""
    heads = members.groupBy("key").agg(F.min("node").alias("head"))
    first = scratch.materialise(members.join(heads, "key").groupBy("node").agg(F.min("head").alias("near")), "near")
    further = first.select(F.col("node").alias("near"), F.col("near").alias("family"))
    family = scratch.materialise(first.join(further, "near").select("node", F.least("near", "family").alias("family")), "family")
    placed = scratch.materialise(members.join(family, "node"), "placed")
    there = placed.select("key", F.col("family").alias("other")).distinct()
    visits = placed.join(there, "key").where(F.col("other") < F.col("family")).select(F.col("other").alias("family"), "node", F.lit(True).alias("visitor")).distinct()
    return family.select("family", "node", F.lit(False).alias("visitor")).unionByName(visits)


def _weight() -> Column:
    return F.greatest(F.lit(MIN_SIZE), F.call_function("shiftleft", F.lit(2), F.col("class")))


def _groups(items: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many classes (c) and blocks there are for each combination of by, which has class."""
    counted = items.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))
    return scratch.materialise(counted.withColumn("blocks", F.ceil(F.col("c") * _weight() / BLOCK).cast("int")), name)


def _blocks(groups: DataFrame) -> DataFrame:
    return groups.drop("c").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _unit(*columns: str) -> Column:
    return F.concat_ws(":", F.hex("family"), F.xxhash64("family", *columns).cast("string"))


def _near(a: str, b: str) -> Column:
    """Whether classes of two kinds of blocks may be alike in size; visitors come to meet members only."""
    return (F.abs(F.col(f"class{a}") - F.col(f"class{b}")) <= 1) & ~(F.col(f"visitor{a}") & F.col(f"visitor{b}"))


def _second(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The same blocks with a 2 behind the names of all columns but the family."""
    return blocks.select("family", *(F.col(c).alias(f"{c}2") for c in [*by, "block"]))


def _seated(placed: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Who sits in which unit, (unit, node, left), for written pairs of blocks."""
    keys = ["family", *by, "block"]
    equal = lambda left, right: [left[c].eqNullSafe(right[c]) for c in keys]
    first = pairs.select(*keys, "unit")
    lefts = placed.join(first, equal(placed, first)).select(first["unit"], placed["node"], F.lit(True).alias("left"))
    same = F.lit(True)
    for c in [*by, "block"]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
    second = pairs.where(~same).select("family", *(F.col(f"{c}2").alias(c) for c in [*by, "block"]), "unit")
    rights = placed.join(second, equal(placed, second)).select(second["unit"], placed["node"], F.lit(False).alias("left"))
    return lefts.unionByName(rights)


def _meetings(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(which classes meet in which task: (unit, node, left, large), the large families) from items (family, node, visitor, n, score)."""
    sized = items.withColumn("class", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    by = ["visitor", "class"]
    groups = _groups(sized, ["family", *by], "groups")
    families = scratch.materialise(groups.groupBy("family").agg(F.sum("c").alias("c"), F.sum("blocks").alias("b")).where("c > 1").select("family", (F.col("b") > MANY).alias("large")), "families")
    groups = groups.join(families, "family")
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    placed = sized.join(groups.drop("c"), ["family", *by]).select("family", *by, block.alias("block"), "node", "score", "large")
    # all blocks of a family that isn't large meet each other
    one = _blocks(groups.where(~F.col("large")).drop("large"))
    rank = lambda k: F.struct(*(F.col(f"{c}{k}") for c in [*by, "block"]))
    pairs = one.join(_second(one, by), "family").where(_near("", "2") & (rank("") <= rank("2")))
    pairs = scratch.materialise(pairs.withColumn("unit", _unit(*by, "block", *(f"{c}2" for c in by), "block2")), "pairs")
    few = _seated(placed.where(~F.col("large")).select("family", *by, "block", "node"), pairs, by)
    # each block of a large family meets the heads
    many = placed.where("large")
    units = _blocks(groups.where("large").drop("large")).withColumn("unit", _unit(*by, "block"))
    order = Window.partitionBy("family", "class").orderBy(F.desc("score"), "node")
    heads = many.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= HEADS).select("family", F.col("class").alias("class2"), "node")
    seated = units.join(heads, "family").where(F.abs(F.col("class") - F.col("class2")) <= 1).select("unit", "node", F.lit(False).alias("left"))
    mine = many.join(units, ["family", *by, "block"]).select("unit", "node", F.lit(True).alias("left"))
    return few.withColumn("large", F.lit(False)).unionByName(mine.unionByName(seated).withColumn("large", F.lit(True))), families.where("large").select("family")


def _rest(items: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit, node, left) for what is left to compare in large families, given the components (node, rep) so far."""
    ours = items.join(large, "family", "left_semi").join(labels, "node", "left")
    sized = ours.select("family", "node", "visitor", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("class"), "rep")
    sized = scratch.materialise(sized, "large-items")
    whole = sized.where(F.col("rep").isNotNull()).groupBy("family", "visitor", "class", "rep").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OWN)
    whole = scratch.materialise(whole.select("family", "visitor", "class", "rep", F.col("rep").alias("of")), "whole")
    by = ["visitor", "class", "of"]
    # members of small components, and what is alone, share blocks: those have no component (of)
    mixed = scratch.materialise(sized.join(scratch.small(whole), ["family", "visitor", "class", "rep"], "left").select("family", *by, "node"), "mixed")
    groups = _groups(mixed, ["family", *by], "groups")
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    sizes = groups.drop("c")
    placed = mixed.join(sizes, [mixed[c].eqNullSafe(sizes[c]) for c in ["family", *by]]).select(*(mixed[c] for c in ["family", *by]), block.alias("block"), mixed["node"])
    everyone = _blocks(groups)
    loose = everyone.where(F.col("of").isNull())
    rank = lambda k: F.struct(*(F.col(f"{c}{k}") for c in ("visitor", "class", "block")))
    pairs = loose.join(_second(everyone, by), "family").where(_near("", "2") & (F.col("of2").isNotNull() | (rank("") <= rank("2"))))
    # components are first paired as such
    kinds = groups.where(F.col("of").isNotNull()).select("family", *by, "blocks")
    other = kinds.select("family", *(F.col(c).alias(f"{c}2") for c in [*by, "blocks"]))
    apart = kinds.join(other, "family").where(_near("", "2") & (F.col("of") < F.col("of2")))
    apart = apart.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    pairs = pairs.unionByName(apart.drop("blocks", "blocks2"))
    pairs = scratch.materialise(pairs.withColumn("unit", _unit(*by, "block", *(f"{c}2" for c in by), "block2")), "pairs")
    return _seated(placed, pairs, by)


def links(described: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(classes (node, rep, n, copies), forest of verified links (a, b) between classes) from the written result of describe()."""
    full = described.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.materialise(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = full.select("doc_id", "node", "bands").join(classes.select(F.col("rep").alias("doc_id"), "node"), ["doc_id", "node"])
    keys = reps.select(F.explode("bands").alias("key"), "node")
    shared = scratch.materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    members = scratch.materialise(keys.join(scratch.small(shared), "key").distinct(), "members")
    wanted = classes.join(members.groupBy("node").agg(F.sum("c").alias("score")), "node")
    items = scratch.materialise(_families(members.select("key", "node")).join(wanted.select("node", "n", "score"), "node"), "items")
    meetings, large = _meetings(items)
    forest = _compared(scratch.materialise(meetings, "meetings"), classes, documents, key, text, percent)
    if large.isEmpty():
        return classes, forest.select("a", "b")
    labels = components(forest.where("large").select("a", "b"), classes)
    rest = scratch.materialise(_rest(items, large, labels).withColumn("large", F.lit(True)), "meetings")
    more = _compared(rest, classes, documents, key, text, percent)
    return classes, forest.select("a", "b").unionByName(more.select("a", "b"))


def _compared(meetings: DataFrame, classes: DataFrame, documents: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """The forest (a, b, large) of the links between those who meet, written."""
    payload = _sets(documents, meetings.select("node").distinct().join(classes.select("node", "rep"), "node"), key, text)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, kind, nodes, sets, left, found = None, False, [], [], [], []

        def close() -> None:
            found.extend((a, b, kind) for a, b in block_forest(nodes, sets, np.array(left, bool), percent) if a != b)
            nodes.clear(), sets.clear(), left.clear()

        for batch in slices(batches):
            for u, node, side, large, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    close()
                    unit, kind = u, large
                nodes.append(node)
                sets.append(np.frombuffer(data, np.uint64))
                left.append(side)
            if len(found) > 10_000:
                yield _edges(found)
                found.clear()
        close()
        yield _edges(found)

    rows = meetings.join(payload, "node").select("unit", "node", "left", "large", "set")
    forest = rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "a binary, b binary, large boolean")
    return scratch.materialise(forest, "forest")


def _edges(found: list[tuple[bytes, bytes, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.bool_()))], names=["a", "b", "large"])


def components(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(node, rep) of each node of edges (a, b): the least rep of its component; order gives each node's rep.

    Rounds of minimum over neighbours and pointer jumping, each a written table. A node of very many edges is on the
    unique side of each join or under a partial aggregate.
    """
    both = scratch.materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    start = both.select(F.col("a").alias("node")).distinct().join(order.select("node", "rep"), "node")
    state = scratch.materialise(start.select("node", F.struct("rep", "node").alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = state.join(near, "node").select("node", F.least("label", "near").alias("low"), "label")
        low = scratch.materialise(low, "labels")
        jump = low.select(F.col("node").alias("to"), F.col("low").alias("next"))
        new = low.withColumn("to", F.col("low.node")).join(jump, "to").select("node", F.least("low", "next").alias("label"), (F.least("low", "next") != F.col("label")).alias("moved"))
        new = scratch.materialise(new, "labels")
        scratch.remove(state)
        scratch.remove(low)
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state.select("node", F.col("label.rep").alias("rep"))


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    described = scratch.materialise(describe(documents, key, text), "described")
    classes, forest = links(described, documents, key, text, percent)
    joined = components(forest, classes)
    # a class of very many copies is dealt to several tasks: its rows by a salt, its label once for each salt
    salts = F.ceil(F.col("copies") / SALT_ROWS).cast("int")
    labels = classes.join(joined.withColumnRenamed("rep", "least"), "node", "left").select("node", F.coalesce("least", "rep").alias("component"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hot = scratch.materialise(classes.where(F.col("copies") > SALT_ROWS).select("node", salts.alias("salts")), "hot")
    linkable = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    rows = described.select("doc_id", "n", linkable.alias("node"), F.monotonically_increasing_id().alias("row")).join(scratch.small(hot), "node", "left")
    out = rows.withColumn("salt", F.pmod(F.col("row"), F.coalesce("salts", F.lit(1))).cast("int")).join(labels, ["node", "salt"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with one document a component: rows of other ids than its smallest go, and copies of a row but for one.

    Rows with a null id stay. Only the ids that go, and ids that occur more than once, are joined to the documents.
    """
    name, again = fresh(documents, "key"), fresh(documents, "repeated")
    found = scratch.materialise(deduplicate(documents, key, text).select(F.col(key).alias(name), "kept"), "verdicts")
    ids = found.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("kept").alias("all"), F.max("kept").alias("any"), F.count(F.lit(1)).alias("c"))
    odd = scratch.materialise(ids.where(~F.col("all") | (F.col("c") > 1)).select(name, (F.col("any") & (F.col("c") > 1)).alias(again)), "odd")
    single = documents.join(scratch.small(odd), F.col(key) == F.col(name), "left_anti")
    if odd.where(again).isEmpty():
        return single
    repeated = documents.join(odd.where(again), F.col(key) == F.col(name), "left_semi").dropDuplicates([key, text])
    return single.unionByName(repeated)
