"""Best-fit packing of documents into sequences of several permitted lengths.

Texts are cut into tokens, runs of one kind of character (letters, digits, signs, white space) of at most TOKEN characters,
a single space being part of what follows it. Documents of more tokens than the largest capacity give full pieces and a
rest, so every piece is a span of code points of its document that begins and ends with a token, and carries its text: the
pieces of a bin in the order of bin_offset are a sequence.

Items go in decreasing length to the open bin with the smallest gap that takes them. If none does, a bin opens with the
capacity of least cost a token: for every permitted capacity the bin's later contents are foreseen from the lengths that
are still to come, and (cost of the capacity) / (foreseen tokens) decides. When all items are placed each bin shrinks to
the smallest permitted capacity that holds its contents. That is done for several sets of capacities that bins may open
with (those from each one up, those up to each one), and the set whose bins cost least in all is taken.

Pieces are dealt to groups of about GROUP_BYTES by a hash of id, place and text, whatever partitions the input has, and
each group is packed by itself: the result doesn't depend on how the table is stored, no key can be hot, and a task holds
one group. Only rows that repeat an id are dealt by their row number, so equal rows may change places.

Defined results: ids must be whole numbers; a null or empty text has no tokens and gets a row without a bin; repeated rows
are packed one by one; equal lengths go in the order of key; texts of any length are cut in one pass; an empty table gives
an empty result; only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tukeyframe.llm import scratch

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence beside its tokens.
OVERHEAD = 16
#: Characters of a token at most, and bytes of text that a group has on average.
TOKEN, GROUP_BYTES = 6, 1 << 24
#: Bytes of text that are cut at once.
CUT_BYTES = 1 << 22
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[range(0x30, 0x3A)] = 2


def token_starts(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes at which tokens begin, characters before each byte) of UTF-8 texts that begin at the bytes docs."""
    first = (data & 0xC0) != 0x80
    count = np.cumsum(first, dtype=np.int64) - first
    kind = _KIND[data]
    run = np.ones(len(data), bool)
    run[1:] = kind[1:] != kind[:-1]
    run[docs[docs < len(data)]] = True
    base = np.maximum.accumulate(np.where(run, count, 0))
    starts = first & ((count - base) % TOKEN == 0)
    if len(data) > 1:
        space = np.flatnonzero(run[:-1] & run[1:] & (data[:-1] == 0x20)) + 1
        doc = np.zeros(len(data) + 1, bool)
        doc[docs] = True
        starts[space[~doc[space]]] = False  # the space has begun the token
    return np.flatnonzero(starts), count


def n_tokens(text: str) -> int:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return len(token_starts(data, np.zeros(1, np.int64))[0])


class _Lengths:
    """A multiset of lengths with the largest one up to a bound."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.bits = sum(1 << x for x in self.count)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.bits &= ~(1 << x)

    def fill(self, gap: int) -> int:
        """Tokens that a gap would get, always the longest that fits."""
        bits, used = self.bits, 0
        while gap - used > 0:
            x = (bits & ((1 << (gap - used + 1)) - 1)).bit_length() - 1
            if x <= 0:
                break
            n = min(self.count[x], (gap - used) // x)
            used += n * x
            bits &= ~(1 << x)
        return used


def _pack_once(lengths: list[int], opening: list[int], overhead: int) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each length, tokens of each bin); a bin opens with one of the capacities of opening."""
    left = _Lengths(lengths)
    by_gap: dict[int, list[int]] = {}
    gaps, used, places = 0, [], []  # gaps: a bit for each gap that an open bin has
    for x in lengths:
        left.take(x)
        fits = gaps >> x
        if fits:
            gap = x + (fits & -fits).bit_length() - 1
            own = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            rate = {c: (c + overhead) / (x + left.fill(c - x)) for c in opening if c >= x}
            gap = min(rate, key=lambda c: (rate[c], c))
            own = len(used)
            used.append(0)
        places.append((own, used[own]))
        used[own] += x
        if rest := gap - x:
            by_gap.setdefault(rest, []).append(own)
            gaps |= 1 << rest
    return places, used


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each length, capacity of each bin). lengths decrease and are from 1 to the largest capacity."""
    sizes = sorted(capacities)
    if not lengths:
        return [], []
    sets = [sizes[k:] for k in range(len(sizes))] + [s for k in range(1, len(sizes)) if (s := sizes[:k])[-1] >= lengths[0]]
    best = None
    for opening in sets:
        places, used = _pack_once(lengths, opening, overhead)
        fitted = [next(c for c in sizes if c >= n) for n in used]
        cost = sum(fitted) + overhead * len(fitted)
        if best is None or cost < best[0]:
            best = cost, places, fitted
    return best[1], best[2]


PIECE = "doc_id long, piece int, start long, stop long, n_tokens int, text string"


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CUT_BYTES of text, its second column."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CUT_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _cut(keys: pa.Array, texts: pa.Array, rows: pa.Array, largest: int) -> pa.RecordBatch:
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, chars = token_starts(data, offsets[:-1]) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.searchsorted(starts, offsets)  # the first token of each text
    tokens = np.diff(first)
    pieces = np.maximum(1, -(-tokens // largest))
    doc = np.repeat(np.arange(len(tokens)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.clip(tokens[doc] - piece * largest, 0, largest)
    at = np.append(starts, len(data))[np.where(size > 0, first[doc] + piece * largest, 0)]
    at = np.append(np.where(size > 0, at, offsets[doc]), len(data))
    chars = np.append(chars, chars[-1] + ((data[-1] & 0xC0) != 0x80) if len(data) else 0)
    start = chars[at[:-1]] - chars[offsets[doc]]
    stop = chars[at[1:]] - chars[offsets[doc]]
    text = pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    take = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [keys.take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(size, pa.int32()), text.cast(pa.string()), rows.take(take)],
        names=["doc_id", "piece", "start", "stop", "n_tokens", "text", "row"],
    )


def cut(documents: DataFrame, key: str = "doc_id", text: str = "text", largest: int = max(CAPACITIES)) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start and stop (code points), n_tokens, text, and the document's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield _cut(part.column(0), part.column(1), part.column(2), largest)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return scratch.text_batches(rows).mapInArrow(run, PIECE + ", row long")


def pack(pieces: DataFrame, groups: int = 1, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, salt: str | None = None) -> DataFrame:
    """Packs rows like those of PIECE, each group by itself: bin_id (unique over the table), capacity and bin_offset are added.

    salt names a column (left out of the result) that is hashed with a row's other places into its group.
    """
    names = [x.split()[0] for x in PIECE.split(", ")]
    by = F.xxhash64("doc_id", "piece", "start", "text", *([salt] if salt else []))
    dealt = pieces.select(*names, F.pmod(by, F.lit(groups)).alias("group"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("n_tokens", pa.int32()), ("text", pa.string()), ("bin_id", pa.int64()), ("capacity", pa.int32()), ("bin_offset", pa.int32())])

    def packed(group: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).drop_columns("group").combine_chunks()
        order = pc.sort_indices(table, sort_keys=[("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        table = table.take(order)
        size = table["n_tokens"].to_numpy()
        some = int((size > 0).sum())
        places, fitted = pack_lengths(size[:some].tolist(), capacities, overhead)
        own, offset = np.array(places, np.int64).reshape(-1, 2).T
        made = np.lexsort((offset, own))  # a sequence's pieces stand together
        full = table.take(pa.array(made))
        rest = table.slice(some)
        columns = [full["doc_id"], full["piece"], full["start"], full["stop"], full["n_tokens"], full["text"], pa.array((group << 32) + own[made]), pa.array(np.array(fitted, np.int32)[own[made]], pa.int32()), pa.array(offset[made], pa.int32())]
        none = [pa.nulls(rest.num_rows, f.type) for f in list(schema)[6:]]
        out = pa.concat_tables([pa.Table.from_arrays(columns, schema=schema), pa.Table.from_arrays([*(rest[n] for n in names), *none], schema=schema)])
        return out.combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            of = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if of[a] != group and held:
                    yield from packed(group, held).to_batches(max_chunksize=4096)
                    held = []
                group = int(of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(group, held).to_batches(max_chunksize=4096)

    return scratch.text_batches(dealt).repartition("group").sortWithinPartitions("group").mapInArrow(run, PIECE + ", bin_id long, capacity int, bin_offset int")


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The pieces of all documents with their places in sequences: a row a piece."""
    size = documents.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long")).alias("b")).first()["b"] or 0
    ids = documents.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    repeated = scratch.materialise(ids.where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    pieces = cut(documents, key, text, max(capacities))
    if repeated.isEmpty():
        return pack(pieces, max(1, math.ceil(size / group_bytes)), capacities, overhead)
    there = repeated.withColumnRenamed("doc_id", "same")
    pieces = pieces.join(scratch.small(there), F.col("doc_id").eqNullSafe(F.col("same")), "left")
    return pack(pieces.withColumn("salt", F.when(F.col("again"), F.col("row"))), max(1, math.ceil(size / group_bytes)), capacities, overhead, "salt")
