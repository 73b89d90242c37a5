"""LM scoring: a hashed maximum-entropy model beside smoothed token counts.

A token falls by its hash into one of ``CLASSES`` x ``MEMBERS`` buckets.  The model
gives a bucket's probability after the tokens before it in two softmaxes, first
the class, then the member in its class, each a sum of weight rows that n-gram
and skip features of the context are hashed to; within its bucket a token has its
share of the training counts.  Training goes in rounds: each document trains in
one round, tasks take Adagrad steps on minibatches from the round's weights and
give their changes, which are averaged per row by the tokens that used it.
Scoring runs over batches of tokens with sparse rows gathered from the weights.

Counts cover every training token.  Documents meet them in shards of tokens: a
shard's counts stream into a task, then the documents' tokens of that shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import PARTIAL_DDL, SLICE, partial_sum, small_batches, stored, summed, text_rows
from wellspring.llm.hashing import Ranges, mix64
from wellspring.llm.toxicity import crc_part

#: Fixed value: what the base adds to each count.
ADD = 0.1
CLASSES, MEMBERS = 32, 32
#: Rows of weights that contexts are hashed to: for classes, for members.
CLASS_ROWS, MEMBER_ROWS = 1 << 15, 1 << 15
#: Which tokens before a token make a feature, 1 the last: two n-grams, a skip.
FEATURES = ((1,), (1, 2), (2,))
#: Rounds over parts of the training documents; tokens of a minibatch.
ROUNDS, MINIBATCH = 3, 4096
#: Step length; what is added to a row's sum of squares, which slows its first steps.
RATE, SOFT = 0.1, 1.0
#: Log odds are held within these bounds.
FLAT = 60.0
#: Training tokens of a task in a round, about.
TASK_TOKENS = 1 << 21
#: Distinct tokens that a task counts before it hands them on.
COUNTED = 1 << 18
#: Shards are the leading bits of a token's hash, at least so many.
LEAST_BITS = 4
#: Counts of a shard, at most on average; tokens of documents that meet one copy of them.
SHARD_TOKENS, SALT_TOKENS = 1 << 19, 1 << 23

_SEED = np.uint64(0x5851F42D4C957F2D)
#: The hash of the end of a text; other tokens' hashes come from their bytes.
END = mix64(np.array([_SEED]))[0]


class Tokens:
    """Hashes of a text's tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then the end."""

    def __init__(self):
        self.ranges = Ranges()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.array([END])
        line = np.frombuffer(b" ".join(words), np.uint8)
        gaps = np.flatnonzero(line == 32)
        start = np.concatenate([[0], gaps + 1])
        end = np.concatenate([gaps, [len(line)]])
        return np.append(self.ranges.of(self.ranges.prefix(line), start, end), END)


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens % np.uint64(CLASSES * MEMBERS)).astype(np.int64)


def contexts(texts: list[np.ndarray]) -> np.ndarray:
    """A hash per token and feature of the tokens before it in its text."""
    flat = np.concatenate(texts)
    start = np.repeat(np.cumsum([0] + [len(t) for t in texts[:-1]]), [len(t) for t in texts])
    place = np.arange(len(flat))
    back = {}
    for d in sorted({d for steps in FEATURES for d in steps}):
        there = place - d >= start
        back[d] = np.where(there, flat[np.maximum(place - d, 0)], _SEED)
    out = np.empty((len(flat), len(FEATURES)), np.uint64)
    for k, steps in enumerate(FEATURES):
        h = np.full(len(flat), k + 1, np.uint64) * _SEED
        for d in steps:
            h = mix64(h ^ back[d])
        out[:, k] = h
    return out


class Model:
    """Weight rows for classes and members and their intercepts."""

    def __init__(self, classes: np.ndarray, members: np.ndarray, class_bias: np.ndarray, member_bias: np.ndarray):
        self.classes, self.members, self.class_bias, self.member_bias = classes, members, class_bias, member_bias

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Model:
        """The model without features: each bucket's share of the training tokens."""
        n = counts.reshape(CLASSES, MEMBERS) + 1.0
        total = n.sum(1)
        return cls(np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((MEMBER_ROWS, MEMBERS), np.float32),
                   np.log(total / total.sum()).astype(np.float32), np.log(n / total[:, None]).astype(np.float32))

    def rows(self, context: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (b // MEMBERS).astype(np.uint64)[:, None]
        return ((context % np.uint64(CLASS_ROWS)).astype(np.int64),
                (mix64(context ^ (own + np.uint64(1)) * _SEED) % np.uint64(MEMBER_ROWS)).astype(np.int64))

    def odds(self, at: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """For classes, and for members of the token's class: odds, unscaled, and their sums."""
        out = []
        for weights, rows, z in ((self.classes, at[0], self.class_bias), (self.members, at[1], self.member_bias.take(b // MEMBERS, axis=0))):
            for k in range(rows.shape[1]):
                z = z + weights.take(rows[:, k], axis=0)
            z = np.exp(np.clip(z, -FLAT, FLAT, out=z), out=z)
            out.append((z, z @ np.ones(z.shape[1], np.float32)))
        return tuple(out)

    def score(self, tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's bucket."""
        out = np.empty(len(tokens))
        for at in range(0, len(tokens), MINIBATCH):
            b, c = bucket(tokens[at:at + MINIBATCH]), context[at:at + MINIBATCH]
            (z, total), (y, whole) = self.odds(self.rows(c, b), b)
            i = np.arange(len(b))
            out[at:at + MINIBATCH] = np.log(z[i, b // MEMBERS].astype(np.float64) / total) + np.log(y[i, b % MEMBERS].astype(np.float64) / whole)
        return out


def group_sums(rows: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the groups of rows that begin at ``edge``, added up one row of each group at a time."""
    n = np.diff(edge, append=len(rows))
    out = rows.take(edge, axis=0)
    longer, r = np.flatnonzero(n > 1), 1
    while len(longer) >= 64:
        out[longer] += rows.take(edge[longer] + r, axis=0)
        r += 1
        longer = longer[n[longer] > r]
    for g in longer:  # few and perhaps long
        out[g] += rows[edge[g] + r:edge[g] + n[g]].sum(0)
    return out


class Trainer:
    """Adagrad steps from a model's weights; what they changed, weighted by the tokens of a row."""

    def __init__(self, model: Model):
        self.start = model
        self.model = Model(model.classes.copy(), model.members.copy(), model.class_bias, model.member_bias)
        self.square = [np.zeros(CLASS_ROWS, np.float32), np.zeros(MEMBER_ROWS, np.float32)]
        self.used = [np.zeros(CLASS_ROWS), np.zeros(MEMBER_ROWS)]

    def step(self, tokens: np.ndarray, context: np.ndarray) -> None:
        b = bucket(tokens)
        at = self.model.rows(context, b)
        i = np.arange(len(b))
        weights = self.model.classes, self.model.members
        for k, ((error, total), target) in enumerate(zip(self.model.odds(at, b), (b // MEMBERS, b % MEMBERS))):
            error /= total[:, None]
            error[i, target] -= 1
            rows = at[k].reshape(-1)
            order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
            rows = rows.take(order)
            edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            own = rows.take(edge)
            gradient = group_sums(error.take(order // at[k].shape[1], axis=0), edge)
            square = self.square[k].take(own) + np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
            self.square[k][own] = square
            self.used[k][own] += np.diff(edge, append=len(rows))
            weights[k][own] -= (RATE / np.sqrt(square + SOFT))[:, None] * gradient

    def share(self) -> np.ndarray:
        """Per row the tokens that used it and the change times them, as one array."""
        out = []
        for now, old, used in zip((self.model.classes, self.model.members), (self.start.classes, self.start.members), self.used):
            out += [used, ((now - old) * used[:, None]).reshape(-1)]
        return np.concatenate(out).astype(np.float32)


def averaged(model: Model, total: np.ndarray) -> Model:
    """The model after a round: each row moved by the tasks' mean change."""
    new = []
    for weights in (model.classes, model.members):
        n, k = weights.shape
        used, change, total = total[:n], total[n:n * (k + 1)].reshape(n, k), total[n * (k + 1):]
        new.append((weights + change / np.maximum(used, 1)[:, None]).astype(np.float32))
    return Model(*new, model.class_bias, model.member_bias)


def _batches(texts, tokens: Tokens, size: int):
    """Texts' tokens in lists of about ``size`` tokens; a longer text is one by itself."""
    held, n = [], 0
    for text in texts:
        held.append(tokens(text))
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _train(model: Model):
    def scan(batches):
        trainer, tokens = Trainer(model), Tokens()
        for texts in _batches((t for _, texts in text_rows(batches) for t in texts), tokens, MINIBATCH):
            flat, context = np.concatenate(texts), contexts(texts)
            for at in range(0, len(flat), MINIBATCH):
                trainer.step(flat[at:at + MINIBATCH], context[at:at + MINIBATCH])
        if trainer.used[0].any():
            yield partial_sum(trainer.share())
    return scan


def _count(batches):
    """How often each token stands in a task's texts, in blocks of ``COUNTED`` distinct ones."""
    tokens = Tokens()
    held_w, held_c, n = [], [], 0

    def merged():
        w, at = np.unique(np.concatenate(held_w), return_inverse=True)
        return w, np.bincount(at, weights=np.concatenate(held_c)).astype(np.int64)

    def out(w, c):
        for at in range(0, len(w), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(w[at:at + (1 << 16)].view(np.int64)), pa.array(c[at:at + (1 << 16)])], names=["w", "c"])
    for texts in _batches((t for _, texts in text_rows(batches) for t in texts), tokens, 1 << 17):
        w, c = np.unique(np.concatenate(texts), return_counts=True)
        held_w.append(w)
        held_c.append(c)
        n += len(w)
        if n > 2 * COUNTED:
            w, c = merged()
            held_w, held_c, n = [w], [c], len(w)
            if n > COUNTED:
                yield from out(w, c)
                held_w, held_c, n = [], [], 0
    if held_w:
        yield from out(*merged())


#: What a batch of texts asks of a shard (distinct tokens, in how many texts each stands, which and how often)
#: and, in the row of its first shard, the texts' own figures.
def _asked_ddl(kind: str) -> str:
    return f"bid bigint, shard bigint, w binary, k binary, at binary, n binary, ids array<{kind}>, n_tokens binary, model binary"


def _score(model: Model, bits: int):
    """Model scores of batches of texts and the tokens they hold, by shard."""
    def scan(batches):
        tokens, bid = Tokens(), TaskContext.get().partitionId() << 33
        for part, texts in text_rows(batches):
            first = 0
            for some in _batches(texts, tokens, 1 << 15):
                flat, sizes = np.concatenate(some), np.array([len(t) for t in some])
                start = np.cumsum(sizes) - sizes
                log = np.add.reduceat(model.score(flat, contexts(some)), start)
                order = np.argsort(flat, kind="stable")
                w, at = flat[order], np.repeat(np.arange(len(some), dtype="<u4"), sizes)[order]
                other = np.concatenate([[True], w[1:] != w[:-1]])
                edge = np.flatnonzero(other | np.concatenate([[True], at[1:] != at[:-1]]))
                n = np.diff(edge, append=len(w)).astype("<u4")
                w, at, other = w[edge], at[edge], other[edge]
                unique = np.flatnonzero(other)
                k, w = np.diff(unique, append=len(at)).astype("<u4"), w[unique]
                shard = w >> np.uint64(64 - bits)
                cut = np.append(np.flatnonzero(np.diff(shard, prepend=shard[:1] + np.uint64(1))), len(w))
                to = np.append(unique, len(at))[cut]
                rows = len(cut) - 1
                piece = lambda x, e: pa.array([x[a:b].tobytes() for a, b in zip(e[:-1], e[1:])], pa.binary())  # noqa: B023, E731
                own = lambda x: pa.array([x.tobytes()] + [None] * (rows - 1), pa.binary())  # noqa: B023, E731
                ids = part.column("doc_id").slice(first, len(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bid] * rows, pa.int64()), pa.array(shard[cut[:-1]].astype(np.int64)), piece(w, cut), piece(k, cut),
                     piece(at, to), piece(n, to), pa.ListArray.from_arrays(pa.array([0] + [len(some)] * rows, pa.int32()), ids),
                     own(sizes), own(log)], names=["bid", "shard", "w", "k", "at", "n", "ids", "n_tokens", "model"])
                first, bid = first + len(some), bid + 1
    return scan


_SUMS = ["known", "base", "inside"]


def _look_up(n: int, v: int, bucket_n: np.ndarray, bucket_v: np.ndarray):
    """A batch's sums per text over its tokens of a shard: known ones, the base's and the within-bucket
    log probabilities.  A shard's counts (rows without ``bid``) come before the batches' tokens."""
    base_of, inside_of = n + ADD * (v + 1), bucket_n + ADD * (bucket_v + 1)

    def scan(batches):
        key, words, counts, table = None, [], [], None
        for batch in batches:
            out, rows = [], []
            for i, (shard, salt, bid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "bid")))):
                if key != (shard, salt):
                    key, words, counts, table = (shard, salt), [], [], None
                w, c = (np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in (("w", np.uint64), ("n", np.uint8)))
                if bid is None:
                    words.append(w)
                    counts.append(c.view(np.int64))
                    continue
                if table is None:
                    known, many = (np.concatenate(words), np.concatenate(counts)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    order = np.argsort(known)
                    table = np.append(known[order], 0), np.append(many[order], 0)
                    words, counts = [], []
                k, at = (np.frombuffer(batch.column(name)[i].as_buffer(), "<u4") for name in ("k", "at"))
                there = np.searchsorted(table[0][:-1], w)
                found = np.where((there < len(table[0]) - 1) & (table[0][there] == w), table[1][there], 0)
                times = c.view("<u4").astype(np.float64)
                size = int(at.max()) + 1
                out.append([np.bincount(at, weights=times * np.repeat(x, k), minlength=size).tobytes() for x in (
                    found > 0, np.log10((found + ADD) / base_of), np.log10((found + ADD) / inside_of[bucket(w)]))])
                rows.append(i)
            if out:
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in _OWN), *(pa.array(c, pa.binary()) for c in zip(*out))],
                                                 names=[*_OWN, *_SUMS])
    return scan


_OWN = ["bid", "ids", "n_tokens", "model"]


def _add_up(batches):
    """The texts of a batch with their sums over all shards; a batch's rows stand together."""
    bid, own, total = None, None, None

    def out():
        ids, sizes, log = own
        known, base, inside = total[:, :len(sizes)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(inside + log / np.log(10))],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
    for batch in batches:
        for i, b in enumerate(batch.column("bid").to_pylist()):
            if b != bid:
                if own is not None:
                    yield out()
                bid, total = b, np.zeros((3, SLICE))
            if batch.column("model")[i].is_valid:
                own = (batch.column("ids")[i].values, *(np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                                                        for c, kind in (("n_tokens", np.int64), ("model", np.float64))))
            for c, name in enumerate(_SUMS):
                x = np.frombuffer(batch.column(name)[i].as_buffer())
                total[c, :len(x)] += x
    if own is not None:
        yield out()


def _pack(batches):
    """Counts of tokens in rows of up to one batch a shard."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        shard, w, c = shard[order], batch.column("w").to_numpy()[order], batch.column("c").to_numpy()[order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
        cut = list(zip(edge[:-1], edge[1:]))
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in cut], pa.int64()), pa.array([w[a:b].tobytes() for a, b in cut], pa.binary()),
                                          pa.array([c[a:b].tobytes() for a, b in cut], pa.binary())], names=["shard", "w", "n"])


def train(texts: DataFrame, bucket_n: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit on all of ``texts`` (text, key): the rows whose key's hash is r modulo ``rounds`` train in round r."""
    model = Model.of_counts(bucket_n)
    tasks = max(1, -(-int(bucket_n.sum()) // (rounds * TASK_TOKENS)))
    for r in range(rounds):
        part = texts.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).select("text").coalesce(tasks)
        total = summed(part.mapInArrow(_train(model), PARTIAL_DDL), np.float32)
        if len(total):
            model = averaged(model, total)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0,
          rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end.  Rows whose
    crc32(id as text) modulo ``folds`` is not ``held`` train; null ids never train and
    aren't held out.  ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over a
    text's tokens, ``score`` the model's log10 probabilities; both give an unknown token
    what the sum leaves (the model: in its bucket).  ``n_known`` counts tokens that
    stand in training.  Null texts are empty: one end.  Repeated rows train and are
    scored as often as they stand.  Without training rows every token is unknown and the
    score that of equally likely buckets.  An empty table gives an empty result.

    Tokens are told apart by 64-bit hashes: among a billion different ones two meet
    with a probability of 3 %, and then share a count.
    """
    small_batches(docs.sparkSession)
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    training = base.where("doc_id is not null").where(~crc_part(F.col("doc_id"), folds, held)).select(
        "text", F.col("doc_id").cast("string").alias("key"))
    counts = stored(training.select("text").mapInArrow(_count, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")), "counts")
    # w is an unsigned hash in a signed column; its low bits are the bucket's number.
    per = counts.groupBy(F.pmod("w", F.lit(CLASSES * MEMBERS)).cast("int").alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    bucket_n, bucket_v = np.zeros(CLASSES * MEMBERS), np.zeros(CLASSES * MEMBERS)
    for r in per:
        bucket_n[r["b"]], bucket_v[r["b"]] = r["n"], r["v"]
    n, v = sum(int(r["n"]) for r in per), sum(int(r["v"]) for r in per)
    model = train(training, bucket_n, rounds)

    bits = max(LEAST_BITS, (max(1, v) // SHARD_TOKENS).bit_length())
    salts = max(1, -(-n // (SALT_TOKENS << bits)))
    kind = base.schema["doc_id"].dataType.simpleString()
    ddl = _asked_ddl(kind)
    asked = (base.mapInArrow(_score(model, bits), ddl)
             .withColumn("salt", F.pmod(F.xxhash64("bid"), F.lit(salts)).cast("long")))
    known = (counts.select("w", "c", F.shiftrightunsigned("w", 64 - bits).alias("shard"))
             .mapInArrow(_pack, "shard bigint, w binary, n binary")
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    met = (asked.unionByName(known, allowMissingColumns=True).repartition("shard", "salt")
           .sortWithinPartitions("shard", "salt", F.col("bid").isNotNull(), "bid"))
    sums = met.mapInArrow(_look_up(n, v, bucket_n, bucket_v), f"bid bigint, ids array<{kind}>, n_tokens binary, model binary, "
                          "known binary, base binary, inside binary")
    found = (sums.withColumn("own", F.col("model").isNotNull()).repartition("bid").sortWithinPartitions("bid", F.desc("own"), "inside")
             .mapInArrow(_add_up, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"))
    return found.select("doc_id", crc_part(F.col("doc_id"), folds, held).alias("held_out"), "n_tokens", "n_known",
                        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op12_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
