"""A quality classifier by co-training on two views: a text's content, and the metadata of its page.

Each view has a logistic model. In every round each model labels the unlabelled pool, and what it is surest of (in the
classes' proportions) is added, with those pseudo-labels, to the training rows of the other. Of the labelled rows that are
held out, one half calibrates both views by Platt scaling, and a small logistic model of their calibrated logits, fitted on
the other half, gives the score: no step is fitted on rows that an earlier one has seen.

Learning takes bounded samples, chosen by the hash of the id: about LABELLED labelled rows and POOL others. Only ids and
features of these reach the driver, and only weights of fixed size go back. All documents are scored on their whole
texts, whatever their length, a few rows at a time and in one pass without a shuffle.

Defined results: ids must be whole numbers; null and empty texts have zero content features and are scored; null metadata are a value of their own;
a row labelled more than once counts by its mean label; labels outside documents or null are ignored; without labels of
both classes every score is the share of the positive class (0.5 without any label); repeated rows get equal scores; rows
with a null id are scored and never learned from; an empty table gives an empty result; columns other than doc_id, text,
source, lang and n_chars are not read, so they may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tukeyframe.llm import scratch, shingles
from tukeyframe.llm.neardup import slices

LABELLED, POOL, ROUNDS, GIVEN = 4_000, 4_000, 5, 0.05
SOURCES, LANGUAGES = 32, 8
_LOW = 96  # bytes 32 to 127 count one by one
#: Places that the hashes of words share.
WORDS = 256
CONTENT = _LOW + WORDS + 9
METADATA = SOURCES + LANGUAGES + 3


def content(text: str | None) -> np.ndarray:
    """Shares of bytes and of hashed words, and shape: lengths of words and lines, how many words and lines differ."""
    out = np.zeros(CONTENT)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    count = np.bincount(data, minlength=256)
    out[:_LOW] = np.sqrt(count[32:128] / len(data))
    starts, ends = shingles._spans(data)
    lines = text.split("\n")
    words = shingles._word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    length = ends - starts
    if len(words):
        out[_LOW : _LOW + WORDS] = np.sqrt(np.bincount((shingles.mix(words, 3) >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64), minlength=WORDS) / len(words))
    out[_LOW + WORDS :] = (
        np.sqrt(count[128:].sum() / len(data)),
        np.sqrt(count[10] / len(data)),
        np.log1p(len(data)),
        np.log1p(len(words)),
        length.mean() if len(words) else 0,
        length.std() if len(words) else 0,
        len(np.unique(words)) / max(1, len(words)),
        len(set(lines)) / len(lines),
        np.log1p(len(data) / len(lines)),
    )
    return out


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(METADATA)
    out[zlib.crc32(repr(source).encode("utf-8", "surrogatepass")) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode("utf-8", "surrogatepass")) % LANGUAGES] = 1
    missing = n_chars is None or n_chars != n_chars or n_chars < 0
    out[-3:] = (1.0, 0.0, 0.0) if missing else (0.0, np.log1p(n_chars), np.log1p(n_chars) ** 2)
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[1:] + self.weights[0], -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
    """Newton's method with an L2 penalty on all weights but the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    ridge = np.full(a.shape[1], penalty)
    ridge[0] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = _sigmoid(np.clip(a @ w, -30, 30))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return Logistic(mean, scale, w)


@dataclass
class Model:
    """Two views with Platt scaling (a logistic model of one logit each), and the model of both calibrated logits."""

    views: list[Logistic]
    platt: list[Logistic]
    both: Logistic
    share: float

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        """Columns: content, metadata and combined probability."""
        if not self.views:
            return np.full((len(features[0]), 3), self.share)
        calibrated = [p.logits(v.logits(x)[:, None]) for v, p, x in zip(self.views, self.platt, features, strict=True)]
        return np.column_stack([*map(_sigmoid, calibrated), _sigmoid(self.both.logits(np.column_stack(calibrated)))])


def cotrain(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, given: float = GIVEN) -> Model:
    """labelled and pool: the feature matrices of both views. Of ten labelled rows one is held out for Platt scaling and
    another one for the combined score; with too few of a class there, all rows serve for both."""
    if len(y) < 20 or y.min() == y.max():
        return Model([], [], None, float(y.mean()) if len(y) else 0.5)
    first, second = np.arange(len(y)) % 10 == 0, np.arange(len(y)) % 10 == 5
    held = first | second
    if any(y[part].min() == y[part].max() for part in (first, second, ~held)):
        held, first, second = np.zeros(len(y), bool), np.ones(len(y), bool), np.ones(len(y), bool)
    train_y = y[~held]
    rows = [[np.zeros(0, np.int64), np.zeros(0)] for _ in range(2)]  # what each view was given: pool rows and labels
    free = [np.ones(len(pool[0]), bool) for _ in range(2)]

    def fit(k: int) -> Logistic:
        return fit_logistic(np.vstack([labelled[k][~held], pool[k][rows[k][0]]]), np.concatenate([train_y, rows[k][1]]))

    views = [fit(0), fit(1)]
    for _ in range(rounds if len(pool[0]) else 0):
        for k in (0, 1):
            logit = views[k].logits(pool[k])
            for label, share in ((1.0, train_y.mean()), (0.0, 1 - train_y.mean())):
                sure = np.argsort(-logit if label else logit, kind="stable")
                right = logit[sure] > 0 if label else logit[sure] < 0
                chosen = sure[right & free[1 - k][sure]][: max(1, round(given * share * len(pool[0])))]
                rows[1 - k] = [np.concatenate([rows[1 - k][0], chosen]), np.concatenate([rows[1 - k][1], np.full(len(chosen), label)])]
                free[1 - k][chosen] = False
        views = [fit(0), fit(1)]
    platt = [fit_logistic(v.logits(x[first])[:, None], y[first]) for v, x in zip(views, labelled, strict=True)]
    calibrated = [p.logits(v.logits(x[second])[:, None]) for p, v, x in zip(platt, views, labelled, strict=True)]
    both = fit_logistic(np.column_stack(calibrated), y[second])
    return Model(views, platt, both, float(y.mean()))


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("long"), F.lit(10)), F.lit(1 << 30)) / float(1 << 30)


def _features(batch: pa.RecordBatch) -> list[np.ndarray]:
    text, source, lang, n_chars = (batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
    first = np.array([content(t) for t in text]).reshape(-1, CONTENT)
    return [first, np.array([metadata(*x) for x in zip(source, lang, n_chars, strict=True)]).reshape(-1, METADATA)]


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def _sampled(documents: DataFrame, ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Features by id, for a bounded list of ids."""
    spark = documents.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = _features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(np.hstack([x, y])), pa.list_(pa.float64()))], names=["doc_id", "x"])

    wanted = spark.createDataFrame(pd.DataFrame({"doc_id": np.array(ids, np.int64)}), "doc_id long")
    found = _columns(documents).join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x array<double>")
    rows = found.dropDuplicates(["doc_id"]).toArrow()
    values = [np.array(x) for x in rows["x"].to_pylist()]
    return {k: [v[:CONTENT], v[CONTENT:]] for k, v in zip(rows["doc_id"].to_pylist(), values, strict=True)}


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> Model:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    n_known, n_docs = known.count(), documents.count()
    chosen = known.where(_place(F.col("doc_id")) < min(1.0, labelled / max(1, n_known))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    y = {r["doc_id"]: float(r["y"] >= 0.5) for r in chosen.collect()}
    ids = documents.where(F.col("doc_id").isNotNull() & (_place(F.col("doc_id")) >= 1 - min(1.0, pool / max(1, n_docs)))).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    others = [r["doc_id"] for r in ids.collect()]
    seen = {r["doc_id"] for r in known.join(F.broadcast(documents.sparkSession.createDataFrame(pd.DataFrame({"doc_id": np.array(others, np.int64)}), "doc_id long")), "doc_id", "left_semi").distinct().collect()}
    found = _sampled(documents, sorted({*y, *others}))
    train = sorted(k for k in y if k in found)
    free = sorted(k for k in others if k not in seen and k in found)
    stack = lambda keys, k, width: np.array([found[i][k] for i in keys]).reshape(-1, width)
    views = lambda keys: [stack(keys, 0, CONTENT), stack(keys, 1, METADATA)]
    return cotrain(views(train), np.array([y[k] for k in train]), views(free))


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, p_content, p_metadata, score, accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = model.score(_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= threshold)], names=["doc_id", "p_content", "p_metadata", "score", "accepted"])

    return scratch.text_batches(_columns(documents)).mapInArrow(run, "doc_id long, p_content double, p_metadata double, score double, accepted boolean")
