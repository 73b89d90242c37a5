"""MinHash near-dedup with b-bit signatures.

Each document's distinct 5-word shingles get 128 minima.  Bands of four whole
minima give candidates; the low four bits of every minimum, packed, estimate a
candidate pair's similarity by bit counts, corrected for the 1 in 16 chance of
equal bits, and only pairs within five standard errors of the threshold are
confirmed on their full shingle sets.  At a similarity of 0.75 a pair shares no
band with probability (1 - 0.75^4)^32 = 5e-6 and is estimated too low with 3e-7.

Copies (equal shingle sets) are one vertex throughout.  A band's bucket first
links its vertices to its smallest one.  Buckets whose vertices then still lie
in different components are compared pair by pair across components, in blocks
of bounded size, so no link is lost to the star and no bucket is one task.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import components, free_name, rekey, small_batches, stored, text_rows
from wellspring.llm.hashing import Shingles, mix64

PERMUTATIONS, BANDS, BITS = 128, 32, 4
ROWS = PERMUTATIONS // BANDS
#: Elements of a set and permutations handled at a time.
_CHUNK, _AT_ONCE = 1 << 14, 16
#: Members of a bucket in one block, and shingles of their sets, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_RNG = np.random.Generator(np.random.PCG64(71))
_MULTIPLY = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Ids that stand for rows without one lie above this.
NO_ID = 1 << 62


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of a non-empty set under each permutation."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), _CHUNK):
        part = values[None, at:at + _CHUNK]
        for p in range(0, PERMUTATIONS, _AT_ONCE):
            s = slice(p, p + _AT_ONCE)
            low[s] = np.minimum(low[s], (_MULTIPLY[s, None] * part).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of whole minima; the band is part of the key."""
    rows = mix64(low.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD)
    return mix64(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of every minimum in eight 64-bit words."""
    nibbles = (low & np.uint32(15)).astype(np.uint8)
    return (nibbles[0::2] | (nibbles[1::2] << 4)).view(np.int64)


def estimate(agreeing):
    """Similarity from the number of equal b-bit minima, corrected for chance."""
    chance = 2.0 ** -BITS
    return (agreeing / PERMUTATIONS - chance) / (1 - chance)


def least_agreeing(threshold: float) -> int:
    """Equal minima that a pair at ``threshold`` has but for five standard errors."""
    chance = 2.0 ** -BITS
    p = chance + (1 - chance) * threshold
    return int(PERMUTATIONS * p - 5 * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def _sketches(k: int):
    def scan(batches):
        shingles = Shingles(k)
        for part, texts in text_rows(batches):
            n, cls, bands, sigs = [], [], [], []
            for text in texts:
                s = shingles(text)
                n.append(len(s))
                if len(s):
                    low = minima(s)
                    cls.append(blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(low))
                    sigs.append(packed(low))
                else:
                    cls.append(None)
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "cls", "bands", "sig"])
    return scan


def _agreeing(a: Column, b: Column) -> Column:
    """Equal 4-bit minima of two packed signatures, by bit counts."""
    ones = F.lit(0x1111111111111111).cast("long")
    unequal = F.lit(0)
    for i in range(8):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unequal = unequal + F.bit_count(x.bitwiseAND(ones))
    return F.lit(PERMUTATIONS) - unequal


def _confirm(k: int, share: int):
    """Keep pairs with ``100 * intersection >= share * union`` of their full sets."""
    def scan(batches):
        shingles = Shingles(k)
        last, own = None, None
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            a, keep = batch.column("a").to_pylist(), []
            for i, v in enumerate(a):
                if v != last:
                    last, own = v, shingles(ta[i].as_py() or b"")
                other = shingles(tb[i].as_py() or b"")
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= share * (len(own) + len(other) - both))
            at = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(at), batch.column("b").filter(at)], names=["a", "b"])
    return scan


def _across(k: int, share: int, least: int):
    """Links between the components of a bucket's pair of blocks: pairs whose
    signatures agree enough are compared on their full sets, in the first bucket
    that they share, and one link is handed on for each two components that meet."""
    def scan(keys, table):
        vid, comp = table.column("vid").to_numpy(), table.column("component").to_numpy()
        blk, texts = table.column("blk").to_numpy(), table.column("text")
        matrix = lambda name, n: np.array(table.column(name).to_pylist(), np.int64).reshape(-1, n)
        sig, bands = matrix("sig", 8).view(np.uint64), matrix("bands", BANDS)
        left, right = np.flatnonzero(blk == keys[1].as_py()), np.flatnonzero(blk == keys[2].as_py())
        shingles, sets, one = Shingles(k), {}, np.uint64(0x1111111111111111)
        roots, root = np.unique(comp, return_inverse=True)
        out = []

        def full(i):
            if i not in sets:
                sets[i] = shingles(texts[i].as_py() or b"")
            return sets[i]

        for at, i in enumerate(left):
            others = left[at + 1:] if keys[1] == keys[2] else right
            others = others[root[others] != root[i]]
            x = sig[others] ^ sig[i]
            x = x | (x >> np.uint64(1))
            x = (x | (x >> np.uint64(2))) & one
            others = others[PERMUTATIONS - np.bitwise_count(x).sum(axis=1, dtype=np.int64) >= least]
            here = int((bands[i] == keys[0].as_py()).argmax())
            others = others[(bands[others] == bands[i]).argmax(axis=1) == here]
            if not len(others):
                continue
            own, rest = full(i), [full(j) for j in others]
            size = np.array([len(r) for r in rest])
            both = np.concatenate(rest)
            hit = own[np.minimum(np.searchsorted(own, both), len(own) - 1)] == both
            both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
            for j in others[100 * both >= share * (len(own) + size - both)]:
                if root[j] != root[i]:
                    out.append((vid[i], vid[j]))
                    root[root == root[j]] = root[i]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})
    return scan


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: documents whose sets of
    distinct k-word shingles have ``100 * intersection >= share * union`` are
    linked, ``component_id`` is the smallest id reachable.

    Null or empty texts and texts of whitespace have no shingles and no links.
    A row without an id takes part but never gives a component its id: a
    component of such rows alone has a null ``component_id``.  Rows that repeat
    an id are one vertex.  ``kept`` is ``doc_id <=> component_id``.  An empty
    table gives an empty result.  Ids lie under 2**62.
    """
    small_batches(docs.sparkSession)
    base = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    drawn = stored(base.mapInArrow(
        _sketches(k), "doc_id bigint, n_shingles bigint, cls binary, bands array<bigint>, sig array<bigint>"), "sketches")
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("cls"), 3)
    classes = stored(drawn.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
                     .select(F.col("cls").alias("k"), F.coalesce("low", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("cls"), 3)).alias("vid")),
                     "classes")
    # The row that stands for its class.
    reps = drawn.where("cls is not null").withColumn("own", F.coalesce("doc_id", stand_in)).join(
        classes, (F.col("cls") == F.col("k")) & (F.col("own") == F.col("vid"))).select("vid", "cls", "bands", "sig", F.col("n_shingles").alias("size"))

    banded = reps.select("vid", "size", F.explode("bands").alias("band"))
    tops = (banded.groupBy("band").agg(F.min("vid").alias("top"), F.max("vid").alias("end")).where("top < end")
            .select(rekey(F.col("band")).alias("k"), "top"))
    buckets = stored(banded.join(tops, F.col("band") == F.col("k")).select("band", "vid", "top", "size").distinct(), "buckets")
    members = buckets.select("vid").distinct()
    # Texts and signatures of everything that shares a bucket: all that is compared below.
    needed = stored(
        base.withColumn("own", F.col("doc_id")).join(members, F.col("own") == F.col("vid"), "left_semi")
        .select(F.col("own").alias("v"), "text")
        .unionByName(_nameless(base, drawn, k, members)), "texts")
    sigs = stored(reps.join(members.select(rekey(F.col("vid")).alias("k")), F.col("vid") == F.col("k"), "left_semi")
                  .select(F.col("vid").alias("v"), "sig", "bands").dropDuplicates(["v"]), "signatures")

    least = least_agreeing(share / 100)
    pairs = buckets.where("vid <> top").select(F.col("top").alias("a"), F.col("vid").alias("b")).distinct()
    pairs = _with(_with(pairs, sigs, "a", "sig", "sa"), sigs, "b", "sig", "sb").where(
        _agreeing(F.col("sa"), F.col("sb")) >= least).select("a", "b")
    links = stored(_confirmed(pairs, needed, k, share), "links")
    found = stored(components(links), "components")

    label = buckets.select("band", "vid", "size").join(found.select(rekey(F.col("v")).alias("v"), "component"),
                                               F.col("vid") == F.col("v"), "left").select(
        "band", "vid", "size", F.coalesce("component", "vid").alias("component"))
    mixed = (label.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"),
                                       F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES).alias("m"))
             .where("c0 < c1").select(rekey(F.col("band")).alias("k"), F.ceil("m").cast("long").alias("blocks")))
    split = label.join(mixed, F.col("band") == F.col("k")).withColumn("blk", F.pmod(F.xxhash64("vid"), F.col("blocks")))
    split = split.select("band", "vid", "component", "blk", "blocks")
    right = sigs.select(F.col("v").alias("key__"), "sig", "bands")
    split = _with(split.join(right, F.col("vid") == F.col("key__")).drop("key__"), needed, "vid", "text", "text")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    split = split.withColumn("other", other).select(
        "band", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "vid", "component",
        "sig", "bands", "text")
    more = stored(split.groupBy("band", "i", "j").applyInArrow(_across(k, share, least), "a bigint, b bigint").distinct(), "links")
    if not more.isEmpty():
        found = stored(components(links.unionByName(more)), "components")

    out = (drawn.select("doc_id", "n_shingles", "cls")
           .join(classes.select(F.col("k"), F.col("vid")), F.col("cls") == F.col("k"), "left")
           .join(found.select(F.col("v"), "component"), F.col("vid") == F.col("v"), "left"))
    component = F.coalesce("component", "vid", "doc_id")
    component = F.when(component < NO_ID, component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def _nameless(base: DataFrame, drawn: DataFrame, k: int, members: DataFrame) -> DataFrame:
    """Texts of rows without an id, under the id that stands for their set."""
    def scan(batches):
        shingles = Shingles(k)
        for part, texts in text_rows(batches):
            cls = [blake2b(s.tobytes(), digest_size=16).digest() if len(s := shingles(t)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), part.column("text")], names=["cls", "text"])
    rows = base.where("doc_id is null").select("text").mapInArrow(scan, "cls binary, text binary").where("cls is not null")
    rows = rows.select((F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("cls"), 3)).alias("v"), "text")
    return rows.join(members, F.col("v") == F.col("vid"), "left_semi").select("v", "text")


def _with(rows: DataFrame, table: DataFrame, on: str, value: str, name: str) -> DataFrame:
    right = table.select(F.col("v").alias("key__"), F.col(value).alias(name))
    return rows.join(right, F.col(on) == F.col("key__")).drop("key__")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    rows = _with(_with(pairs, texts, "b", "text", "tb"), texts, "a", "text", "ta")
    return rows.mapInArrow(_confirm(k, share), "a bigint, b bigint").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 75) -> DataFrame:
    """The rows of ``docs`` that stand for their group (``kept`` above), columns as they are."""
    own = free_name(docs, "kept_id")
    kept = near_groups(docs, id_col, text_col, k, share).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col(own)), "left_semi")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
