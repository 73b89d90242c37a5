"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte trigrams of its words (A-Z lower-cased, word
edges included), hashed to ``BUCKETS`` rows of an embedding; their average goes
through a linear softmax.  Embedding and softmax are trained by stochastic
gradient descent in numpy on a bounded sample.  A part of the sample that takes
no steps sets a temperature, so that scores are probabilities, and the score
under which ``rejected`` says the text resembles no learned language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import small_batches, text_rows
from wellspring.llm.toxicity import crc_part

#: At most so many documents train the model.
MAX_TRAIN = 4000
BUCKETS, DIM = 1 << 12, 16
EPOCHS, BATCH, RATE = 30, 32, 20.0
#: Share of well recognised sample texts that the rejection may cost.
REJECT = 0.01

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = range(97, 123)
_LETTERS[65:91] = range(97, 123)
_LETTERS[128:] = range(128, 256)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Bytes of text hashed at a time.
_PIECE = 1 << 20


def counts(text: bytes) -> np.ndarray:
    """How often each bucket's subwords stand in the text."""
    total = np.zeros(BUCKETS, np.int64)
    text = b" " + text + b" "
    for at in range(0, len(text) - 2, _PIECE):
        line = _LETTERS[np.frombuffer(text[at:at + _PIECE + 2], np.uint8)].astype(np.uint32)
        word = (line[:-2] << np.uint32(16)) | (line[1:-1] << np.uint32(8)) | line[2:]
        word = word[(line[1:-1] != 32)]  # a letter stands in the middle
        total += np.bincount((word * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return total


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Model:
    """Languages, bucket logits (embedding times softmax), intercepts, temperature, least score."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.langs, self.logits, self.bias, self.temperature, self.least = langs, logits, bias, temperature, least

    def __call__(self, text: bytes) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        n = counts(text)
        p = softmax((n @ self.logits / max(1, n.sum()) + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(langs: list[str], y: np.ndarray, x: np.ndarray, seed: int = 17) -> Model:
    """Train on averaged subword counts ``x`` with language numbers ``y``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n_langs = len(langs)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIM, n_langs)).astype(np.float32)
    bias = np.zeros(n_langs, np.float32)
    order = rng.permutation(len(y))
    checked, trained = order[:len(y) // 5], order[len(y) // 5:]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(trained)
        for at in range(0, len(trained), BATCH):
            rows = trained[at:at + BATCH]
            hidden = x[rows] @ embedding
            error = softmax(hidden @ weight + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weight.T
            weight -= rate * 0.05 * (hidden.T @ error)
            bias -= rate * 0.005 * error.sum(axis=0)
            embedding -= rate * (x[rows].T @ back)
    logits = embedding @ weight
    rows = checked if len(checked) >= 50 else order
    z, yc = x[rows] @ logits + bias, y[rows]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(yc)), yc] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == yc]
    least = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return Model(langs, logits.astype(np.float64), bias.astype(np.float64), temperature, least)


def _training_rows(batches):
    for part, texts in text_rows(batches):
        at, n = [], []
        for t in texts:
            c = counts(t)
            where = np.flatnonzero(c)
            at.append(where.astype(np.int32))
            n.append(c[where].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [part.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))],
            names=["lang", "at", "n"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 4, held: int = 2, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` per row of ``docs``.

    Trains on texts with a letter and a non-null language whose crc32(id as text)
    modulo ``folds`` is not ``held``, at most ``max_train``, the smallest by hash
    of the id.  Null texts and texts without a letter are ``und`` with score 0
    and rejected, as is every text when nothing can be learned.  Null ids never
    train and aren't held out; repeated rows are predicted alike.
    """
    small_batches(docs.sparkSession)
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"),
                       docs[f"`{lang_col}`"].cast("string").alias("lang"))
    ids = (base.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang")
           .where(~crc_part(F.col("doc_id"), folds, held)).distinct()
           .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "lang").limit(max_train))
    # At most max_train ids, so the broadcast is bounded.
    chosen = base.join(F.broadcast(ids.withColumnsRenamed({"doc_id": "i", "lang": "l"})),
                       (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")))
    got = chosen.select("lang", "text").mapInArrow(_training_rows, "lang string, at array<int>, n array<int>").toArrow()
    rows = [(lang, a, n) for lang, a, n in zip(*(got.column(c).to_pylist() for c in ("lang", "at", "n"))) if a]
    langs = sorted({r[0] for r in rows})
    model = Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    if rows:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (_, a, n) in enumerate(rows):
            x[i, a] = np.array(n, np.float32) / sum(n)
        model = fit(langs, np.array([langs.index(r[0]) for r in rows]), x)

    def scan(batches):
        for part, texts in text_rows(batches):
            found = [model(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([f[i] for f in found], kind)
                                          for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                names=["doc_id", "lang_pred", "score", "rejected"])
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, lang_pred string, score double, rejected boolean").select(
        "doc_id", crc_part(F.col("doc_id"), folds, held).alias("held_out"), "lang_pred", "score", "rejected")


def op9_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
