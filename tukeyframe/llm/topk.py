"""Exact top-k by integer inner product: descending norms, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are quantised to whole numbers. A rotation (the right singular vectors of a bounded sample) gathers most of the
length in the first coordinates; it only serves the bounds, so the sample can't make a result wrong. Once quantised, all vectors
are written in ranges of descending length, and that table serves every pass. It is read in blocks. A block's bound for
a query is the partial sum over the first rotated coordinates plus the product of the residual lengths; only pairs whose
bound reaches the query's threshold (its k-th best score so far, at first among the longest vectors) get the exact
integer product. A length that reaches no threshold of a pass is a filter on its scan, so whole files and row groups of
short vectors aren't read, and blocks are skipped likewise. Pruning keeps ties: a pair goes only if its bound is below the
threshold.

Queries go out in chunks of about ``QUERY_CHUNK`` rows, one pass over the candidates each, so what is broadcast is
bounded whatever the size of the table. A task emits at most k rows a query, and few beyond the thresholds.

Defined results: ids must be whole numbers; vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; rows that repeat a query's id and vector are one query, whose id excludes all rows with that id;
repeated candidates each take a rank; ties go to the smaller id; a null id takes no part; an empty table gives no rows;
a score that 64 bits don't hold is an error; only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tukeyframe.llm import scratch

SCALE = 1024
#: Rows of the sample for the rotation and of the longest vectors that give the first thresholds.
SAMPLE, SEEDS = 20_000, 4_096
QUERY_CHUNK, QUERY_BLOCK, ROW_BLOCK = 16_384, 512, 4_096
#: Whole numbers up to this are exact in doubles.
EXACT = 2.0**53


def quantised(vectors: DataFrame, key: str, vector: str, is_query: Column, scale: int = SCALE) -> DataFrame:
    """Rows that take part: id, x (whole numbers as doubles), norm, and asked."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(F.lit(float(scale)) * v).cast("double"))
    fine = F.forall(F.col(vector).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine)
    return good.select(F.col(key).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asked")).withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))


def _matrix(column: pa.ChunkedArray | pa.Array | list, width: int) -> np.ndarray:
    rows = column.to_pylist() if hasattr(column, "to_pylist") else column
    if hasattr(column, "flatten") and len(rows) and all(len(r) == width for r in rows[:1]) and len(flat := column.flatten()) == len(rows) * width and all(len(r) == width for r in rows):
        return flat.to_numpy(zero_copy_only=False).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Row-wise inner products as whole numbers."""
    if exact:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)], dtype=np.int64)


class Search:
    """The queries of a chunk with their k best scores so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, rotation: np.ndarray, head: int):
        self.ids, self.q, self.k, self.rotation, self.head = ids, queries, k, rotation, head
        turned = queries @ rotation
        self.first, self.norm = turned[:, :head], np.linalg.norm(queries, axis=1)
        self.rest = np.linalg.norm(turned[:, head:], axis=1)
        self.floor = np.full(len(ids), -np.inf)  # what a score must reach
        self.top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, id, score

    def add(self, ids: np.ndarray, rows: np.ndarray) -> bool:
        """Takes a block of rows; False if none of them is long enough to matter, nor any that is no longer."""
        norms = np.linalg.norm(rows, axis=1)
        longest = norms.max(initial=0.0)
        slack = 1e-9 * self.norm * longest + 1e-3  # rounding of the bounds
        reach = self.norm * longest + slack >= self.floor
        if not reach.any():
            return False
        exact = rows.shape[1] * np.abs(rows).max(initial=0) * np.abs(self.q).max(initial=0) < EXACT
        turned = rows @ self.rotation
        first, rest = turned[:, : self.head], np.linalg.norm(turned[:, self.head :], axis=1)
        live, found = np.flatnonzero(reach), []
        for start in range(0, len(live), QUERY_BLOCK):
            part = live[start : start + QUERY_BLOCK]
            bound = self.first[part] @ first.T + self.rest[part, None] * rest
            i, j = np.nonzero(bound >= (self.floor[part] - slack[part])[:, None])
            if len(i) * 4 > len(part) * len(rows) and exact:
                scores = (self.q[part] @ rows.T)[i, j].astype(np.int64)
            else:
                scores = np.concatenate([_products(self.q[part[i[s : s + 65536]]], rows[j[s : s + 65536]], exact) for s in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
            own = part[i]
            good = (scores >= self.floor[own] - 1e-12 * np.abs(self.floor[own])) & (ids[j] != self.ids[own])
            found.append((own[good], ids[j][good], scores[good]))
            if sum(len(x[0]) for x in found) > 2_000_000:
                self._keep(found)
                found = []
        self._keep(found)
        return True

    def least_length(self) -> float:
        """A length below which no vector reaches any threshold."""
        reach = np.where(self.norm > 0, self.floor, np.where(self.floor > 0, np.inf, -np.inf)) / np.maximum(self.norm, 1.0)
        return max(0.0, float(reach.min()) * (1 - 1e-6) - 1e-2) if len(reach) and np.isfinite(reach.min()) else 0.0

    def _keep(self, found: list[tuple]) -> None:
        own, ids, scores = (np.concatenate(x) for x in zip(self.top, *found, strict=True))
        order = np.lexsort((ids, -scores, own))
        own, ids, scores = own[order], ids[order], scores[order]
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) if len(own) else first
        last = rank == self.k - 1
        self.floor[own[last]] = np.maximum(self.floor[own[last]], scores[last].astype(float))
        keep = rank < self.k
        self.top = own[keep], ids[keep], scores[keep]


def _rotation(sample: np.ndarray) -> tuple[np.ndarray, int]:
    """The right singular vectors, and how many of them hold three quarters of the squared length."""
    _, values, turned = np.linalg.svd(sample, full_matrices=True) if len(sample) else (None, np.zeros(0), np.eye(sample.shape[1]))
    share = np.cumsum(values**2) / max(1e-300, float((values**2).sum())) if len(values) else np.ones(1)
    return turned.T, max(1, min(sample.shape[1], int(np.searchsorted(share, 0.75)) + 1))


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k best rows for each row of vectors that is a query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, query_no long, vec_id long, score long"
    ranges = [F.desc("norm"), F.xxhash64("id")]  # equal lengths are spread over several ranges
    found = quantised(vectors, key, vector, is_query, scale).repartitionByRange(*ranges).sortWithinPartitions(F.desc("norm"))
    rows = scratch.materialise(found, "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    asked = rows.where("asked").select("id", "x").distinct()
    n_queries = asked.count()
    final = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    if not facts["n"] or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, facts["width"])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(place < min(1.0, SAMPLE / facts["n"])).limit(2 * SAMPLE).select("x").toArrow()["x"]
    rotation, head = _rotation(_gram_root(_matrix(sample.combine_chunks(), width)))
    # about as many of the longest vectors; which ones they are only matters for what is pruned
    longest = rows.agg(F.percentile_approx("norm", max(0.0, 1.0 - SEEDS / facts["n"])).alias("q")).first()["q"]
    seeds = rows.where(F.col("norm") >= longest).limit(2 * SEEDS).select("id", "x").toArrow()
    seed_ids, seed_rows = seeds["id"].to_numpy(), _matrix(seeds["x"].combine_chunks(), width)
    by_length = np.argsort(-np.linalg.norm(seed_rows, axis=1), kind="stable")
    seed_ids, seed_rows = seed_ids[by_length], seed_rows[by_length]
    chunks, parts = -(-n_queries // QUERY_CHUNK), []
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id", "x"), F.lit(chunks)))
    asked = scratch.materialise(asked.repartitionByRange("chunk").sortWithinPartitions("chunk") if chunks > 1 else asked, "queries")
    for c in range(chunks):
        mine = asked.where(F.col("chunk") == c).select("id", "x").toArrow().sort_by("id")
        if not mine.num_rows:
            continue
        start = Search(mine["id"].to_numpy(), _matrix(mine["x"].combine_chunks(), width), k, rotation, head)
        for at in range(0, len(seed_ids), ROW_BLOCK):
            start.add(seed_ids[at : at + ROW_BLOCK], seed_rows[at : at + ROW_BLOCK])
        start.top = tuple(x[:0] for x in start.top)  # the seeds come again as candidates
        sent = spark.sparkContext.broadcast(start)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            state = Search(known.ids, known.q, known.k, known.rotation, known.head)
            state.floor = known.floor.copy()
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), known.q.shape[1])
                for at in range(0, len(ids), ROW_BLOCK):
                    state.add(ids[at : at + ROW_BLOCK], x[at : at + ROW_BLOCK])
            own, found, scores = state.top
            yield pa.RecordBatch.from_arrays([pa.array(state.ids[own], pa.int64()), pa.array(own, pa.int64()), pa.array(found, pa.int64()), pa.array(scores.tolist(), pa.int64())], names=["query_id", "query_no", "vec_id", "score"])

        made = rows.where(F.col("norm") >= F.lit(start.least_length())).select("id", "x").mapInArrow(look, schema)
        ranked = made.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(ranked if chunks == 1 else scratch.materialise(ranked, "topk"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _gram_root(sample: np.ndarray) -> np.ndarray:
    """A square matrix with the sample's right singular vectors and singular values."""
    return np.linalg.qr(sample, mode="r") if len(sample) > sample.shape[1] else sample
