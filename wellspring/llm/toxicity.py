"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings, trained in
numpy on a bounded sample of labelled rows.  Each training text that names a
group gets a counterfactual with its identity terms swapped, and the loss adds
``LAMBDA`` times the squared change of the logit, so a group's mention alone
carries no weight.  Features come from text only.  Tasks compute the sample's
features; the driver receives at most ``MAX_TRAIN`` rows of them; scoring is one
pass over the documents with the weights in the task, without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import small_batches, text_rows
from wellspring.llm.hashing import Ranges

#: Identity terms and what they are swapped for (fixed values).
SWAPS = (("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("muslims", "christians"),
         ("muslim", "christian"), ("jewish", "catholic"), ("jews", "catholics"), ("black", "white"), ("gay", "straight"),
         ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("immigrants", "natives"), ("immigrant", "native"),
         ("asian", "european"), ("african", "american"), ("disabled", "abled"), ("elderly", "young"))
#: At most so many labelled rows train the model, and of a row's features those with the smallest hashes.
MAX_TRAIN, MAX_FEATURES = 10_000, 4096
#: Bytes of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: A feature is used if it stands in so many training texts and its chi-square is at least this.
MIN_DOCS, MIN_CHI2 = 3, 25.0
LAMBDA, L2, STEPS = 1.0, 1e-4, 400

_WHOLE = np.uint64(0xA5A5A5A55A5A5A5A)
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[97:123] = range(97, 123)
_LETTERS[65:91] = range(97, 123)
_LETTERS[128:] = range(128, 256)


class Features:
    """Sorted distinct hashes of a text's words and word beginnings."""

    def __init__(self):
        self.ranges = Ranges()

    def hashes(self, text: bytes) -> np.ndarray:
        line = _LETTERS[np.frombuffer(text, np.uint8)]
        edge = np.flatnonzero(np.diff(line != 0, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        sums = self.ranges.prefix(line)
        out = [self.ranges.of(sums, start, end) ^ _WHOLE]
        for k in PREFIXES:
            s = start[end - start >= k]
            out.append(self.ranges.of(sums, s, s + k))
        return np.concatenate(out)

    def __call__(self, text: bytes) -> np.ndarray:
        return np.unique(self.hashes(text))


_PAIR = {a.encode(): b.encode() for x, y in SWAPS for a, b in ((x, y), (y, x))}
_TERM = re.compile(rb"(?<![a-z\x80-\xff])(" + b"|".join(sorted(_PAIR, key=len, reverse=True)) + rb")(?![a-z\x80-\xff])")


def swapped(text: bytes) -> bytes:
    """The text, A-Z lower-cased, with each identity term replaced by its counterpart."""
    return _TERM.sub(lambda m: _PAIR[m[0]], text.lower())


def _training_rows(batches):
    features = Features()
    for part, texts in text_rows(batches):
        own, other = [], []
        for t in texts:
            s = swapped(t)
            both = [features(t)] + ([features(s)] if s != t.lower() else [])
            # One bound for a text and its swap, so that they differ only where the words do.
            last = min((x[MAX_FEATURES - 1] for x in both if len(x) > MAX_FEATURES), default=None)
            both = [x if last is None else x[x <= last] for x in both]
            own.append(both[0].view(np.int64))
            other.append(both[1].view(np.int64) if len(both) > 1 else None)
        yield pa.RecordBatch.from_arrays(
            [part.column("y"), pa.array(own, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))],
            names=["y", "own", "swapped"])


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each stands."""
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    return x[first], np.diff(np.append(first, len(x)))


def _places(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``x`` stands in the sorted ``values``, and whether it does."""
    if not len(values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return at, values[at] == x


def fit(y: np.ndarray, seen: np.ndarray, size: np.ndarray, other: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the intercept, from labels, the rows'
    features one after another, how many each row has, and those of swapped rows."""
    none = np.zeros(0, np.uint64), np.zeros(0), -50.0
    if not len(y):
        return none
    row, first = np.repeat(np.arange(len(y), dtype=np.int32), size), np.cumsum(size) - size
    values, n = _counted(seen)
    values, n = values[n >= MIN_DOCS], n[n >= MIN_DOCS].astype(float)
    at, there = _places(values, seen[y[row] > 0])
    a = np.bincount(at[there], minlength=len(values))
    total, pos = float(len(y)), float(y.sum())
    expected = n * pos / total
    spread = expected * (1 - pos / total) * (total - n) / max(total - 1, 1)
    values = values[(a - expected) ** 2 >= MIN_CHI2 * np.maximum(spread, 1e-9)]
    at, there = _places(values, seen)
    r, c = row[there], at[there]
    del at, there, row
    # Counterfactuals: the columns in which a text and its swap differ, signed.
    cr, cc, cs = [], [], []
    for i, x in other.items() if len(values) else ():
        own = seen[first[i]:first[i] + size[i]]
        for these, sign in ((np.setdiff1d(own, x), 1.0), (np.setdiff1d(x, own), -1.0)):
            at, there = _places(values, these)
            at = at[there]
            cr += [i] * len(at)
            cc += at.tolist()
            cs += [sign] * len(at)
    cr, cc, cs = np.array(cr, int), np.array(cc, int), np.array(cs)
    w, bias = np.zeros(len(values)), float(np.log((pos + 0.5) / (total - pos + 0.5)))
    g2, b2 = np.full(len(values), 1e-8), 1e-8
    for _ in range(STEPS):
        z = bias + np.bincount(r, weights=w[c], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        grad = np.bincount(c, weights=error[r], minlength=len(values)) + L2 * w
        if len(cr):
            change = np.bincount(cr, weights=cs * w[cc], minlength=len(y))
            grad += 2 * LAMBDA / total * np.bincount(cc, weights=cs * change[cr], minlength=len(values))
        g2 += grad ** 2
        w -= 0.3 * grad / np.sqrt(g2)
        b2 += error.sum() ** 2
        bias -= 0.3 * error.sum() / b2 ** 0.5
    return values, w, float(bias)


class Scorer:
    """Scores of texts; a table of hash beginnings spares the exact look-up for most words."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, bias: float):
        self.values, self.weights, self.bias = values, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(values >> np.uint64(44)).astype(np.int64)] = True
        self.features = Features()

    def __call__(self, text: bytes) -> float:
        z = self.bias
        if len(self.values):
            h = self.features.hashes(text)
            h = np.unique(h[self.maybe[(h >> np.uint64(44)).astype(np.int64)]])
            at = np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)
            z += float(self.weights[at[self.values[at] == h]].sum())
        return 1 / (1 + float(np.exp(-max(-40.0, min(40.0, z)))))


def crc_part(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) leaves ``part`` modulo ``parts`` (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "toxic", folds: int = 5, held: int = 0, max_train: int = MAX_TRAIN):
    """A column function from text to score, trained as ``score_toxicity`` says."""
    small_batches(docs.sparkSession)
    label = labels[f"`{label_col}`"].cast("int")
    rows = labels.select(labels[f"`{id_col}`"].alias("id"), label.alias("y")).where("id is not null and y in (0, 1)")
    rows = (rows.where(~crc_part(F.col("id"), folds, held)).distinct()
            .orderBy(F.xxhash64(F.col("id").cast("string")), "id", "y").limit(max_train))
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    # At most max_train ids and labels, so the broadcast is bounded.
    drawn = base.join(F.broadcast(rows), F.col("doc_id") == F.col("id"))
    got = drawn.select("y", "text").mapInArrow(_training_rows, "y int, own array<bigint>, swapped array<bigint>").toArrow()
    flat = lambda lists: np.asarray(lists.flatten(), np.int64).view(np.uint64)
    own, other = got.column("own").combine_chunks(), got.column("swapped").combine_chunks()
    swaps = {i: flat(other.slice(i, 1)) for i in np.flatnonzero(np.asarray(other.is_valid()))}
    size = np.asarray(own.value_lengths(), np.int64)
    model = fit(got.column("y").to_numpy().astype(float), flat(own), size, swaps)

    def scored(texts: pa.Array) -> pa.Array:
        scorer = Scorer(*model)
        return pa.array([scorer(t or b"") for t in texts.to_pylist()], pa.float64())

    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scored, "double")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", folds: int = 5, held: int = 0, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    Trains on labelled rows (0 or 1) whose crc32(id as text) modulo ``folds`` is
    not ``held``, at most ``max_train`` of them, the smallest by hash of the id, and
    ``MAX_FEATURES`` features of each, the smallest by hash; scoring takes all.
    Null ids and labels never train; ids with two labels train with each.  Null
    and empty texts get the score of no feature.  Without training rows every
    score is about 0.  Repeated rows are scored alike.
    """
    score = learned(docs, labels, id_col, text_col, label_col, folds, held, max_train)
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), score(docs[f"`{text_col}`"].cast("binary")).alias("score"))
    return rows.select("doc_id", crc_part(F.col("doc_id"), folds, held).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score at most 0.5, columns as they are; a score of
    exactly 0.5 says nothing either way (no feature, balanced labels), so the row stays."""
    score = learned(docs, labels, id_col, text_col, **options)
    return docs.where(score(docs[f"`{text_col}`"].cast("binary")) <= 0.5)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_toxicity(read("documents"), read("labels"))
