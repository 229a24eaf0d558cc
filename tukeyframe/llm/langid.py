"""Language identification with interpolated Kneser-Ney character language models.

A model per language over characters (letters in lower case, every run of other characters one space). Counting takes a
bounded sample of labelled documents; scoring takes whole texts. For each order the n-grams are 64-bit hashes in one sorted
array; behind each hash stand the languages that have the n-gram, with the finished interpolated log probability and the
weight of the n-gram as a context. What the models take is thus the sum of what each language has seen, however many
languages there are. For the lower orders, and all of them where languages are few, the finished log probability in every
language also stands beside each hash, as far as DENSE cells go. Many texts are scored at once: a position gets the row of its
longest n-gram among those orders (with the weights of the contexts in between), and for the orders above them, from the
lower to the higher, the log probability of the n-gram in the languages that have it and the context's weight in the others.
The language of least cross-entropy a character wins.

A document is rejected if it has no letter or if that cross-entropy is above the language's limit for texts of its length.
Limits are calibrated to REJECT, the share of texts that may be rejected although their language is known, on texts that the
counts have not seen: see _calibrate().
The score is a softmax of the cross-entropies at the temperature that has the least log loss on those texts.

Defined results: a null text, or one without letters, gets ``und``, score 0 and is rejected; equal cross-entropies go to
the alphabetically first language; a table without labelled rows gives ``und`` everywhere; an empty table gives none; very
long texts are scored in blocks; repeated rows get equal results; the three added columns replace those of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tukeyframe.llm import scratch
from tukeyframe.llm.native import fresh

ORDER = 5
DISCOUNT = 0.75
#: Share of texts in a known language that the limits may reject; and the shortest length class, in powers of two.
REJECT, SHORTEST = 0.0002, 3
#: Expected size of the sample of each language, the characters taken of a text, and the languages from which on they share
#: what so many would take. In all, about SAMPLE_TOTAL characters reach the driver: windows get shorter as languages get more.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
LANGUAGES = 100
SAMPLE_TOTAL = 16_000_000
UNKNOWN = "und"
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.uint32(32)
#: Cells (positions times languages) that are scored at once.
CELLS = 1 << 18
#: Cells (n-grams of an order times languages) up to which finished log probabilities of all languages are kept.
DENSE = 1 << 22
_LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool)


def _all_characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after the other, how many each text has), in the form of characters()."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    some = np.flatnonzero(sizes)
    counts = np.zeros(len(texts), np.int64)
    if not len(some):
        return codes[:0], counts
    starts = (np.cumsum(sizes) - sizes)[some]
    letter = _LETTERS[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of non-letters
    keep[starts] = letter[starts]
    last = np.maximum.reduceat(np.where(letter, np.arange(len(codes)), -1), starts)
    after = last + 1
    keep[after[(last >= 0) & (after < starts + sizes[some])]] = False  # the run at the end
    inner = np.add.reduceat(keep, starts, dtype=np.int64)
    counts[some] = np.where(inner > 0, inner + 2, 0)
    inner = inner[inner > 0]
    out = np.full(int(counts.sum()), SPACE, np.uint32)
    ends = np.cumsum(inner + 2)
    out[np.arange(int(inner.sum())) + np.repeat(2 * np.arange(len(inner)) + 1, inner)] = np.where(letter, codes, SPACE)[keep]
    assert len(ends) == 0 or ends[-1] == len(out)
    return out, counts


def characters(text: str | None) -> np.ndarray:
    """Code points in lower case, runs of non-letters as one space, a space at both ends; empty if there is no letter."""
    return _all_characters([text])[0]


def _step(before: np.ndarray | np.uint64, chars: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its first n - 1 characters and its last one."""
    out = (before + (chars.astype(np.uint64) + np.uint64(1))) * BASE
    return out ^ (out >> np.uint64(29))


def hashes(chars: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each position from order - 1 on."""
    if len(chars) < order:
        return np.zeros(0, np.uint64)
    out = np.uint64(0)
    for k in range(order):
        out = _step(out, chars[k : len(chars) - order + 1 + k])
    return out


@dataclass
class Grams:
    """The n-grams of one order: sorted hashes, and for each the entries (language, log probability, weight as a context)."""

    keys: np.ndarray = field(repr=False)
    first: np.ndarray = field(repr=False)
    lang: np.ndarray = field(repr=False)
    logp: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    #: Finished log probabilities and weights [n-gram, language], or None.
    finished: np.ndarray | None = field(default=None, repr=False)
    weights: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self):
        # hashes are even over their range, so their first bits say about where they stand
        self.bits = max(1, len(self.keys).bit_length())
        self.bucket = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)
        self.padded = np.append(self.keys, np.uint64(2**64 - 1))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, or the number of hashes if it isn't there."""
        at = self.bucket[wanted >> np.uint64(64 - self.bits)]
        todo = np.flatnonzero(self.padded[at] < wanted)
        while len(todo):
            at[todo] += 1
            todo = todo[self.padded[at[todo]] < wanted[todo]]
        return np.where(self.padded[at] == wanted, at, len(self.keys))

    def entries(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of found, entry) for all entries of the places found."""
        first = self.first[np.minimum(found, len(self.keys))]
        count = self.first[np.minimum(found + 1, len(self.keys))] - first
        rows = np.repeat(np.arange(len(found)), count)
        return rows, np.arange(len(rows)) + np.repeat(first - (np.cumsum(count) - count), count)


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[Grams] = field(repr=False)
    unseen: np.ndarray = field(default=None)
    #: Limits [length class from SHORTEST on, language].
    limits: np.ndarray = field(default=None)
    scale: float = 1.0


def _count(docs: list[np.ndarray], order: int) -> list[dict]:
    """Kneser-Ney statistics of a language: for each order, n-gram -> count (highest) or distinct left neighbours."""
    stats = []
    for n in range(1, order + 1):
        grams = np.concatenate([hashes(d, n) for d in docs] or [np.zeros(0, np.uint64)])
        # the context drops the last character, the suffix the first one
        context = np.concatenate([hashes(d, n - 1)[: max(0, len(d) - n + 1)] if n > 1 else np.zeros(max(0, len(d)), np.uint64) for d in docs] or [np.zeros(0, np.uint64)])
        suffix = np.concatenate([hashes(d, n - 1)[1:] if n > 1 else np.zeros(len(d), np.uint64) for d in docs] or [np.zeros(0, np.uint64)])
        key, first, count = np.unique(grams, return_index=True, return_counts=True)
        stats.append({"key": key, "context": context[first], "suffix": suffix[first], "count": count.astype(float)})
    for n in range(order - 1):  # below the highest order: how many different characters come before
        key, left = np.unique(stats[n + 1]["suffix"], return_counts=True)
        found = np.searchsorted(key, stats[n]["key"])
        hit = (found < len(key)) & (key[np.minimum(found, max(0, len(key) - 1))] == stats[n]["key"]) if len(key) else np.zeros(len(stats[n]["key"]), bool)
        stats[n]["count"] = np.where(hit, left[np.minimum(found, max(0, len(left) - 1))] if len(left) else 0, 1).astype(float)
    return stats


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether it is there) of each wanted hash in the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _context_sums(stats: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, their total count, and their number of different continuations."""
    key, inverse, kinds = np.unique(stats["context"], return_inverse=True, return_counts=True)
    return key, np.bincount(inverse, stats["count"], len(key)), kinds.astype(float)


def train(texts: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT, reject: float = REJECT) -> Model | None:
    """Models of all languages; every fifth text of a language is held back to calibrate its limits."""
    languages = sorted(texts)
    chars = {name: [c for c in map(characters, texts[name]) if len(c)] for name in languages}
    languages = [name for name in languages if chars[name]]
    if not languages:
        return None
    held = {name: chars[name][::5] if len(chars[name]) >= 10 else [] for name in languages}
    counted = {name: [c for i, c in enumerate(chars[name]) if i % 5 or not held[name]] for name in languages}
    alphabet = len(np.unique(np.concatenate([c for name in languages for c in counted[name]]))) + 1
    tables: list[list[tuple]] = [[] for _ in range(order)]
    parts: list[list[tuple]] = [[] for _ in range(order)]
    unseen = np.zeros(len(languages))
    for k, name in enumerate(languages):
        stats, lower = _count(counted[name], order), None
        for n, own in enumerate(stats):
            ctx, total, kinds = _context_sums(own)
            at, _ = _look(ctx, own["context"])
            left = discount * kinds / total
            if n == 0:
                unseen[k] = math.log(left[0] / alphabet)
                below = np.full(len(own["key"]), 1.0 / alphabet)
            else:
                s_at, _ = _look(stats[n - 1]["key"], own["suffix"])
                below = lower[s_at]
                place, there = _look(ctx, stats[n - 1]["key"])
                tables[n - 1][k] = (*tables[n - 1][k][:2], np.log(np.where(there, left[place], 1.0)))
            lower = np.maximum(own["count"] - discount, 0) / total[at] + left[at] * below
            tables[n].append((own["key"], np.log(lower), np.zeros(len(lower))))
            parts[n].append((own["key"], own["context"], own["suffix"]))
    model = Model(languages, order, [_merged(t) for t in tables], unseen)
    _finish(model, parts)
    _calibrate(model, [held[name] or counted[name] for name in languages], [bool(held[name]) for name in languages], reject)
    return model


def _merged(tables: list[tuple]) -> Grams:
    """One sorted array from those of all languages."""
    key = np.concatenate([t[0] for t in tables])
    lang = np.repeat(np.arange(len(tables), dtype=np.int32), [len(t[0]) for t in tables])
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    logp, weight = (np.concatenate([t[i] for t in tables])[order].astype(np.float32) for i in (1, 2))
    return Grams(keys, np.append(first, len(key)).astype(np.int64), lang[order], logp, weight)


def _finish(model: Model, parts: list[list[tuple]]) -> None:
    """Sets the dense rows of the orders that are small enough, from the (hash, context, suffix) of each language's n-grams."""
    width = len(model.languages)
    for n, grams in enumerate(model.grams):
        if len(grams.keys) * width > DENSE:
            break
        if n:
            below, context, suffix = model.grams[n - 1], np.zeros(len(grams.keys), np.uint64), np.zeros(len(grams.keys), np.uint64)
            for key, left, right in parts[n]:  # the same in every language
                at = grams.find(key)
                context[at], suffix[at] = left, right
            out = below.finished[below.find(suffix)] + below.weights[below.find(context)]
        else:
            out = np.tile(model.unseen.astype(np.float32), (len(grams.keys), 1))
        weights = np.zeros_like(out)
        rows, entry = grams.entries(np.arange(len(grams.keys)))
        out[rows, grams.lang[entry]] = grams.logp[entry]
        weights[rows, grams.lang[entry]] = grams.weight[entry]
        grams.finished, grams.weights = out, weights


def _calibrate(model: Model, texts: list[list[np.ndarray]], unseen: list[bool], reject: float) -> None:
    """Sets the limits and the scale from texts of each language (unseen: whether the counts have not seen them).

    Texts count for the language that wins them, as that is whose limit they will meet. Windows of a length class give its
    middle and its spread (the 90 % quantile less the middle); how far texts lie out, in spreads, is pooled over languages, and
    its tail beyond the 90 % quantile taken for exponential, which gives the quantile that the stated share exceeds.
    """
    every = [c for own in texts for c in own]
    label = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    scored = np.array([entropies(model, c) for c in every])
    winner = scored.argmin(1)
    least, sizes = scored[np.arange(len(every)), winner], np.array([len(c) for c in every])
    depth = max(SHORTEST, int(sizes.max()).bit_length() - 1) - SHORTEST + 1
    middle, spread = np.full((depth, len(texts)), np.nan), np.full((depth, len(texts)), np.nan)
    usual = np.zeros(len(every), bool)
    for k in range(len(texts)):
        own = np.flatnonzero(winner == k)
        if not len(own):
            own = np.flatnonzero(label == k)
        low, high = np.quantile(scored[own, k], (0.5, 0.9))
        good = own[scored[own, k] <= low + 10 * (high - low) + 0.5]  # a few junk texts, or in other scripts, don't count
        usual[good] = winner[good] == k
        sums = [np.cumsum(-position_logs(model, every[i])[:, k]) for i in good]
        for c in range(depth):
            size = 1 << (SHORTEST + c)
            h = np.concatenate([np.diff(s[size - 1 :: size], prepend=0.0) for s in sums]) / size
            if len(h) >= 10:
                middle[c, k], high = np.quantile(h, (0.5, 0.9))
                spread[c, k] = high - middle[c, k]
        if np.isnan(middle[:, k]).all():
            middle[:, k], spread[:, k] = low, high - low
    for x in (middle, spread):  # classes with few windows, from the next shorter class, or the next longer one
        for rows in (range(1, depth), range(depth - 2, -1, -1)):
            for c in rows:
                near = c - 1 if rows.step > 0 else c + 1
                x[c] = np.where(np.isnan(x[c]), x[near], x[c])
    spread = np.maximum(spread, 1e-3)
    at = _class_of(sizes, depth)
    out = (least - middle[at, winner])[usual] / spread[at, winner][usual]
    edge = max(1.0, float(np.quantile(out, 0.9))) if len(out) else 1.0
    tail = out[out > edge] - edge
    reach = edge + (tail.mean() if len(tail) else 1.0) * max(0.0, math.log(0.1 / reject))
    model.limits = middle + reach * spread + np.where(unseen, 0.0, 1.0)
    gaps = scored - scored[np.arange(len(every)), label][:, None]
    loss = lambda t: np.log(np.exp(np.clip(-t * gaps, -700.0, 700.0)).sum(1)).sum()
    model.scale = float(min((2.0**i for i in range(11)), key=loss))


def _class_of(sizes: np.ndarray, depth: int) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(sizes, 1))).astype(int) - SHORTEST, 0, depth - 1)


def position_logs(model: Model, chars: np.ndarray) -> np.ndarray:
    """The log probability of each character under each language [position, language]."""
    return np.concatenate([x for _, x in _blocks(model, chars, np.array([len(chars)]))])


def entropies(model: Model, chars: np.ndarray) -> np.ndarray:
    """Cross-entropy a character (nats) under each language; chars is not empty."""
    return all_entropies(model, chars, np.array([len(chars)]))[0]


def all_entropies(model: Model, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cross-entropies [text, language] of texts of so many characters each, one after the other; zeros without characters."""
    total = np.zeros((len(counts), len(model.languages)))
    for texts, logs in _blocks(model, chars, counts):
        starts = np.flatnonzero(np.diff(texts, prepend=-1))
        total[texts[starts]] -= np.add.reduceat(logs, starts, axis=0, dtype=float)
    return total / np.maximum(counts, 1)[:, None]


def _blocks(model: Model, chars: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each position, log probabilities [position, language]) of all characters, block by block."""
    size = max(1 << 12, CELLS // len(model.languages))
    ends = np.cumsum(counts)
    for start in range(0, len(chars), size):
        before = min(start, model.order - 1)  # contexts reach back into the last block
        at = np.arange(start - before, min(len(chars), start + size))
        text = np.searchsorted(ends, at, "right")
        inside = at - (ends - counts)[text]
        yield text[before:], _logs(model, chars[at], inside)[before:]


def _logs(model: Model, chars: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """inside: the position of each character in its text, which n-grams don't begin before."""
    reach = np.minimum(inside, np.arange(len(chars))) + 1  # the longest n-gram that ends at each position
    hashed, before = [], np.zeros(len(chars), np.uint64)
    for _ in model.grams:
        hashed.append(_step(before, chars))
        before = np.append(np.uint64(0), hashed[-1][:-1])
    dense = sum(g.finished is not None for g in model.grams)
    out = np.zeros((len(chars), len(model.languages)))
    rest = np.zeros(0, np.int64)
    for n in range(dense, 0, -1):
        at = np.concatenate([rest, np.flatnonzero(reach >= n if n == dense else reach == n)])
        grams = model.grams[n - 1]
        found = grams.find(hashed[n - 1][at])
        there = found < len(grams.keys)
        out[at[there]] += grams.finished[found[there]]
        rest = at[~there]
        if n > 1:
            context = model.grams[n - 2].find(hashed[n - 2][rest - 1])
            known = context < len(model.grams[n - 2].keys)
            out[rest[known]] += model.grams[n - 2].weights[context[known]]
    out[rest if dense else slice(None)] += model.unseen
    flat, width = out.reshape(-1), len(model.languages)
    for n in range(dense + 1, model.order + 1):
        at = np.flatnonzero(reach >= n)
        if n > 1:
            lower = model.grams[n - 2]
            rows, entry = lower.entries(lower.find(hashed[n - 2][at - 1]))
            flat[at[rows] * width + lower.lang[entry]] += lower.weight[entry]
        grams = model.grams[n - 1]
        rows, entry = grams.entries(grams.find(hashed[n - 1][at]))
        flat[at[rows] * width + grams.lang[entry]] = grams.logp[entry]
    return out


def verdicts(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, score from 0 to 1, rejected) of each whole text."""
    if model is None or not len(texts):
        return [(UNKNOWN, 0.0, True)] * len(texts)
    chars, counts = _all_characters(texts)
    h = all_entropies(model, chars, counts)
    best = h.argmin(1)
    least = h[np.arange(len(h)), best]
    score = 1.0 / np.exp(np.maximum((least[:, None] - h) * model.scale, -700.0)).sum(1)
    over = least > model.limits[_class_of(counts, len(model.limits)), best]
    return [(model.languages[b], float(s), bool(o)) if n else (UNKNOWN, 0.0, True) for b, s, o, n in zip(best, score, over, counts, strict=True)]


def predict(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    """(language, score from 0 to 1, rejected) of a whole text."""
    return verdicts(model, [text])[0]


def remainder(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are never learned from. Null ids count as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES, total: int = SAMPLE_TOTAL) -> Model | None:
    """Learns from a bounded sample of the rows that may be learned from.

    A row is taken if the hash of its id is below a limit, set by its language's row count so that about sample_docs rows
    are taken for each language, fewer if there are more than so many languages, but at least one. Of a long text a window
    is taken, at a place given by the hash of its id: of sample_chars characters, or as many as keep the whole sample at
    about total characters. Counts are over all documents, and every label that occurs is learned.
    """
    ids, label, whole = F.col(key).cast("string"), F.col(lang).cast("string"), F.col(text).cast("string")
    place = F.pmod(F.xxhash64(ids), F.lit(1 << 30)) / float(1 << 30)
    usable = documents.where(label.isNotNull() & whole.isNotNull() & (remainder(F.col(key)) != 0)).select(ids.alias("id"), label.alias("lang"), whole.alias("text"), place.alias("place"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    counts = scratch.materialise(counts, "languages")
    n_languages = counts.count()
    if not n_languages:
        return None
    docs = sample_docs * min(1.0, languages / n_languages)
    window = max(64, min(sample_chars, int(total / (n_languages * max(1.0, docs)))))
    limits = scratch.small(counts.select("lang", F.greatest(F.lit(docs) / F.col("n"), "least").alias("limit")))
    over = F.greatest(F.length("text") - window, F.lit(0))
    start = F.pmod(F.xxhash64("id", F.lit("window")), (over + 1).cast("long")).cast("int") + 1
    sample = usable.join(limits, "lang").where(F.col("place") <= F.col("limit")).select("id", "lang", F.substring("text", start, F.lit(window)).alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["id"] or "", r["text"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    return train(texts)


def _scored(documents: DataFrame, model: Model | None, text: str) -> tuple[DataFrame, str]:
    """documents with a struct of the three results, under a name that no column has."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size

    @F.pandas_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            rows, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size >= CELLS:  # few texts at a time, whatever their length
                    rows += verdicts(known, part)
                    part, size = [], 0
            rows += verdicts(known, part)
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    name = fresh(documents, "found")
    return scratch.text_batches(documents).withColumn(name, score(F.col(text).cast("string"))), name


def identify(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """documents with the columns lang_pred, score and rejected."""
    found, name = _scored(documents, model, text)
    return found.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(name)


def accepted(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns as they were."""
    found, name = _scored(documents, model, text)
    return found.where(~F.col(f"{name}.rejected")).drop(name)
