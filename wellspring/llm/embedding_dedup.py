"""Embedding near-dedup by product quantisation.

Coarse centroids and the residuals' subspace codebooks are fitted on a bounded
sample; every vector is indexed.  A vector's list is its nearest centroid within
its label; it is stored with the codes of its residual and the exact length of
what the codes leave out.  A query goes to every list whose border (the plane
midway between the list's centroid and the query's own) is within the distance
of a link, so it meets every vector that it may be linked with.  In a list, table
look-ups give the distance to each coded vector; since a vector lies no further
from its code than the stored length, pairs beyond link distance plus that length
can't be links and the rest is decided by the cosine in double precision.

The number of lists grows with the vectors of the largest label.  Many lists have
their centroids in two levels: coarse ones plus offsets that all of them share.
Vectors of each width have an index of their own; ``WIDTHS`` of them are fitted and
searched in one job.

Equal vectors of a label are one vertex with a count.  Lists and their queries
are cut into blocks, and a pair of blocks gives counts per vector and a spanning
forest of its links, so a group of thousands of near copies needs neither one
task nor its pairs as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import components, rekey, stored

THRESHOLD = 0.93
#: Vectors that fit the indices of one job, at most; widths of one job.
MAX_TRAIN, WIDTHS = 20_000, 64
#: Vectors of a list, about; centroids fitted at one level, at most, and vectors that fit each.
LIST, LEVEL, PER_CENTRE = 2048, 256, 20
SUBSPACES, CODES = 8, 16
#: Vectors of a list, and queries to it, in one block.
BLOCK = 2048


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T * -2 + (centres ** 2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, d], minlength=len(centres))
            centres[:, d] = np.where(n > 0, total / np.maximum(n, 1), centres[:, d])
    return centres


class Index:
    """Coarse centroids and residual codebooks for unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centres = _kmeans(sample, min(lists, LEVEL, max(1, len(sample) // PER_CENTRE)), rng)
        own = self.nearest(sample)
        if lists > len(self.centres):
            offsets = _kmeans(sample - self.centres[own], -(-lists // len(self.centres)), rng)
            self.centres = (self.centres[:, None] + offsets[None]).reshape(-1, sample.shape[1])
            own = self.nearest(sample)
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        rest = sample - self.centres[own]
        self.books = [_kmeans(rest[:, a:b], codes, rng) for a, b in self._spans()]

    def _spans(self):
        return list(zip(self.cuts[:-1], self.cuts[1:]))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T * -2 + (self.centres ** 2).sum(1)).argmin(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what they leave out."""
        rest = x - self.centres[own]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        for m, ((a, b), book) in enumerate(zip(self._spans(), self.books)):
            part = rest[:, a:b]
            codes[:, m] = (part @ book.T * -2 + (book ** 2).sum(1)).argmin(1)
            rest[:, a:b] = part - book[codes[:, m]]
        return codes, np.sqrt((rest ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, margin: float) -> np.ndarray:
        """For each vector and list, whether its border is within ``margin`` (its own list is)."""
        square = (x @ self.centres.T * -2 + (self.centres ** 2).sum(1))
        home, at = np.unique(own, return_inverse=True)
        norm = (self.centres ** 2).sum(1)
        apart = np.sqrt(np.maximum(norm[home][:, None] + norm[None] - 2 * self.centres[home] @ self.centres.T, 1e-12))
        beyond = (square - square[np.arange(len(x)), own][:, None]) / (2 * apart[at])
        near = beyond <= margin
        near[np.arange(len(x)), own] = True
        return near

    def distances(self, x: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the coded vectors of list ``of``, by table look-ups."""
        rest = x - self.centres[of]
        total = np.zeros((len(x), len(codes)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self._spans(), self.books)):
            table = ((rest[:, None, a:b] - book[None]) ** 2).sum(2).astype(np.float32)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # no over- or underflow in the squares
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _reach(threshold: float) -> float:
    """The distance of unit vectors whose cosine is ``threshold``, and a little more for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-5


def _indexed(indices: dict[int, Index], margin: float):
    def scan(batches):
        for batch in (part for whole in batches for part in by_width(whole)):
            x = _unit(_matrix(batch.column("vec")))
            index = indices[x.shape[1]]
            own = index.nearest(x)
            codes, left = index.encode(x, own)
            near = index.probes(x, own, margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("vid"), batch.column("n"), batch.column("vec"),
                 pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(left), pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32()))],
                names=["grp", "vid", "n", "vec", "own", "codes", "rest", "probes"])
    return scan


def by_width(batch: pa.RecordBatch):
    """The batch's rows by the width of their vectors."""
    width = batch.column("vec").value_lengths().to_numpy()
    for w in np.unique(width):
        yield batch.filter(pa.array(width == w))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite relation given as a Boolean matrix."""
    edges, free_q, free_v = [], near.any(1), near.any(0)
    for root in np.flatnonzero(free_q):
        if not free_q[root]:
            continue
        free_q[root], todo = False, [(root, True)]
        while todo:
            at, is_query = todo.pop()
            if is_query:
                new = np.flatnonzero(near[at] & free_v)
                free_v[new] = False
                edges += [(at, v) for v in new]
            else:
                new = np.flatnonzero(near[:, at] & free_q)
                free_q[new] = False
                edges += [(q, at) for q in new]
            todo += [(v, not is_query) for v in new]
    return edges


def _compare(indices: dict[int, Index], threshold: float):
    reach = _reach(threshold)

    def scan(key, queries, members):
        if not queries.num_rows or not members.num_rows:
            return _OUT.empty_table()
        q, v = _unit(_matrix(queries.column("qvec"))), _unit(_matrix(members.column("mvec")))
        q_id, v_id = queries.column("qid").to_numpy(), members.column("mid").to_numpy()
        v_n, left = members.column("mn").to_numpy(), members.column("mrest").to_numpy()
        codes = np.frombuffer(b"".join(members.column("mcodes").to_pylist()), np.uint8).reshape(len(v), -1)
        near = indices[q.shape[1]].distances(q, key[1].as_py(), codes) <= reach + left[None]
        rows, columns = np.nonzero(near)
        near[:] = False
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at:at + (1 << 16)], columns[at:at + (1 << 16)]
            ok = (np.einsum("ij,ij->i", q[r], v[c]) >= threshold) & (q_id[r] != v_id[c])
            near[r[ok], c[ok]] = True
        links = near @ v_n
        some = np.flatnonzero(links)
        edges = np.array(_forest(near), np.int64).reshape(-1, 2)
        return pa.table({"a": np.concatenate([q_id[some], q_id[edges[:, 0]]]),
                         "b": pa.array([None] * len(some) + v_id[edges[:, 1]].tolist(), pa.int64()),
                         "n": pa.array(links[some].tolist() + [None] * len(edges), pa.int64())}, schema=_OUT)
    return scan


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, grp, vec)``: grp is null where a vector links with nothing."""
    single = vectors.schema[vec_col].dataType.elementType.simpleString() == "float"
    kind = "float" if single else "double"
    # Adding 0 turns -0.0 into 0.0, so equal vectors hash alike.
    vec = F.transform(vectors[f"`{vec_col}`"], lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    good = (vectors[f"`{label_col}`"].isNotNull() & vec.isNotNull()
            & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vec, lambda x: x != 0))
    group = F.concat_ws(":", vectors[f"`{label_col}`"].cast("string"), F.size(vec).cast("string"))
    good = F.coalesce(good, F.lit(False))
    return vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), F.when(good, group).alias("grp"),
                          F.when(good, vec).alias("vec"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: vectors of equal labels
    whose cosine is at least ``threshold`` are linked.

    Null and zero vectors, vectors with null or non-finite components and null
    labels link with nothing; vectors of different lengths never link.
    ``n_links`` counts the other rows linked directly, equal vectors included.
    Ids are integers.
    Rows without an id link and count but don't name a component: one of such
    rows alone has a null ``component_id``.  Repeated ids are one vertex.  An
    empty table gives an empty result.  Ids lie under 2**62.
    """
    rows = stored(valid(vectors, id_col, vec_col, label_col), "vectors")
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("grp", "vec"), 3)
    good = rows.where("grp is not null")
    classes = stored(good.groupBy("grp", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
                     .withColumn("vid", F.coalesce("low", stand_in)), "classes")
    parts = []
    groups = classes.groupBy("grp", F.size("vec").alias("w")).count()
    widths = [(r["w"], r["m"]) for r in groups.groupBy("w").agg(F.max("count").alias("m")).orderBy("w").collect()]
    for at in range(0, len(widths), WIDTHS):
        parts.append(_links(classes, dict(widths[at:at + WIDTHS]), threshold, max_train))
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        found = stored(found, "links")
        groups = stored(components(found.where("b is not null").select("a", "b")), "components")
        direct = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("links"))
        classes = (classes.join(direct.select(rekey(F.col("a")).alias("a"), "links"), F.col("vid") == F.col("a"), "left")
                   .join(groups.select(rekey(F.col("v")).alias("v"), "component"), F.col("vid") == F.col("v"), "left"))
    else:
        classes = classes.withColumns({"links": F.lit(0).cast("long"), "component": F.col("vid")})
    per = classes.select(F.col("grp").alias("g"), F.xxhash64("vec").alias("h"), F.col("vec").alias("x"), "n", "vid", "links", "component")
    joined = rows.withColumn("hash", F.xxhash64("vec")).join(
        per, (F.col("hash") == F.col("h")) & (F.col("grp") == F.col("g")) & (F.col("vec") == F.col("x")), "left")
    top = F.coalesce("component", "vid", "vec_id")
    top = F.when(top < (1 << 62), top)
    return joined.select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
                         top.alias("component_id"), F.col("vec_id").eqNullSafe(top).alias("kept"))


def _links(classes: DataFrame, largest: dict[int, int], threshold: float, max_train: int) -> DataFrame:
    """Rows (a, null, links) and forest links (a, b, null) of the classes whose width is a key of
    ``largest``, which gives the size of the width's largest label."""
    classes = classes.where(F.size("vec").isin(*largest))
    first = Window.partitionBy("w").orderBy("hash", "vec")
    drawn = (classes.select(F.size("vec").alias("w"), F.xxhash64("vec").alias("hash"), "vec")
             .withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(1, max_train // len(largest))).orderBy("w", "r")
             .select("vec").toArrow())
    indices = {}
    for part in (p for batch in drawn.combine_chunks().to_batches() for p in by_width(batch)):
        sample = _unit(_matrix(part.column("vec")))
        lists = min(-(-largest[sample.shape[1]] // LIST), max(1, len(sample) // PER_CENTRE) ** 2, LEVEL ** 2)
        indices[sample.shape[1]] = Index(sample, lists)
    indexed = stored(classes.select("grp", "vid", "n", "vec").mapInArrow(
        _indexed(indices, _reach(threshold)), f"grp string, vid bigint, n bigint, vec {classes.schema['vec'].dataType.simpleString()}, "
        "own int, codes binary, rest double, probes array<int>"), "index")
    asked = indexed.select("grp", "vid", "vec", F.explode("probes").alias("own"))
    sizes = (indexed.groupBy("grp", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vb"))
             .join(asked.groupBy("grp", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb")), ["grp", "own"])
             .select(rekey(F.col("grp"), "string").alias("g"), F.col("own").alias("o"), "vb", "qb"))
    sizes = stored(sizes, "blocks")
    same = (F.col("grp") == F.col("g")) & (F.col("own") == F.col("o"))
    block = lambda n: F.pmod(F.xxhash64("vid", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = asked.join(sizes, same).select(
        F.col("grp").alias("qg"), F.col("own").alias("qo"), every("vb").alias("qv"), block("qb").alias("qq"),
        F.col("vid").alias("qid"), F.col("vec").alias("qvec"))
    members = indexed.join(sizes, same).withColumn("mq", every("qb")).select(
        F.col("grp").alias("mg"), F.col("own").alias("mo"), block("vb").alias("mv"), "mq",
        F.col("vid").alias("mid"), F.col("n").alias("mn"), F.col("vec").alias("mvec"), F.col("codes").alias("mcodes"),
        F.col("rest").alias("mrest"))
    return queries.groupBy("qg", "qo", "qv", "qq").cogroup(members.groupBy("mg", "mo", "mv", "mq")).applyInArrow(
        _compare(indices, threshold), "a bigint, b bigint, n bigint")


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
