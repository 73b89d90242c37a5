"""Benchmark decontamination, in DataFrame operations only.

Every 5-word shingle of every document is looked up among the benchmark's; a
window that shares none has similarity 0 with every item.  Where shingle ``o``
of an item of ``n`` words stands at word ``p``, the window of ``n`` words from
``p - o`` is item-sized.  Windows and items get 64-bit SimHashes of their words.

Multi-index search: fingerprints are cut into four blocks of 16 bits; an item is
indexed under every value within 3 bits of each of its blocks, a window looks up
its four blocks.  Two fingerprints within 15 bits differ by at most 3 in some
block, so all of them meet; pairs further apart are dropped.  The rest is
decided by the weighted similarity of the 5-word shingles (weight: how often a
shingle stands in the window or item): sum of minima over sum of maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import free_name, id_order, stored

K, SHARE = 5, 75
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 3
#: All fingerprints within so many bits meet in some block.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text (null: none)."""
    line = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, r"[\x20\x09-\x0D]+"))


def shingles(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, in order."""
    def one(i):
        return F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(
        F.array().cast("array<bigint>"))


def simhash(w: Column) -> Column:
    """64-bit SimHash of an array of words: each bit is the majority of the words' hashes."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))

    def ones(b):
        return F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda bits, b: bits.bitwiseOR(F.when(ones(b) * 2 > F.size(w), F.call_function("shiftleft", F.lit(1).cast("long"), b))
                                       .otherwise(F.lit(0).cast("long"))))


def blocks(fingerprint: Column) -> Column:
    """The fingerprint's blocks as ``number * 2**16 + value``."""
    return F.array(*[F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
                     + F.lit(b << BLOCK_BITS) for b in range(BLOCKS)])


def overlap(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller of their counts in two arrays."""
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, s: n + F.least(count(a, s), count(b, s)))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", k: int = K, share: int = SHARE) -> DataFrame:
    """``(doc_id, th, item_id, similarity, start_word, n_words)``: the best window of
    each document for each item at ``100 * similarity >= share``, the first on ties.

    Null, empty or blank texts match nothing, on either side.  Items with fewer
    than ``k`` words have their whole sequence as one shingle.  Rows of equal id
    and text give one result; null ids are kept apart by ``th``, the text's
    digest.  An empty table on either side gives an empty result.  Windows that
    an item's place would push over a text's edge are cut there.
    """
    item_words = items.select(items[f"`{item_col}`"].alias("item_id"), words(items[f"`{item_text_col}`"]).alias("w"))
    item_words = stored(item_words.where(F.size("w") > 0).distinct().withColumn("k", F.least(F.size("w"), F.lit(k))), "items")
    kinds = sorted(r["k"] for r in item_words.select("k").distinct().collect())  # at most k rows
    own = F.coalesce(*[F.when(F.col("k") == n, shingles(F.col("w"), n)) for n in kinds], F.array().cast("array<bigint>"))
    item_shingles = stored(item_words.select("item_id", "w", F.size("w").alias("size"), own.alias("sh")), "item-shingles")
    places = stored(item_shingles.select("size", F.posexplode("sh").alias("o", "h")).distinct(), "places")

    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"),
                       id_order(None, docs[f"`{text_col}`"]))
    split = base.select("doc_id", "th", words(F.col("text")).alias("w"))
    hits = []
    for n in kinds or [k]:
        rows = split.select("doc_id", "th", F.size("w").alias("size_d"), F.posexplode(shingles(F.col("w"), n)).alias("p", "hash"))
        hits.append(rows.join(places, F.col("hash") == F.col("h")).select(
            "doc_id", "th", F.greatest(F.lit(0), F.col("p") - F.col("o")).alias("a"),
            F.least(F.col("size_d"), F.col("p") - F.col("o") + F.col("size")).alias("b")))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    per = found.groupBy(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")).agg(
        F.collect_set(F.struct("a", "b")).alias("windows"))
    windows = (base.join(per, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
               .select("doc_id", "th", words(F.col("text")).alias("w"), "windows")
               .select("doc_id", "th", "w", F.explode("windows").alias("at"))
               .select("doc_id", "th", "at.a", "at.b", F.slice("w", F.col("at.a") + 1, F.col("at.b") - F.col("at.a")).alias("ww")))
    windows = stored(windows.withColumn("fw", simhash(F.col("ww"))), "windows")

    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long")), lambda m: F.bit_count(m) <= BLOCK_RADIUS)
    index = item_shingles.withColumn("fi", simhash(F.col("w"))).select("item_id", "sh", "fi", F.hash("w").alias("wh"))
    index = stored(index, "fingerprints")
    keys = index.select("item_id", "wh", "fi", F.explode(blocks(F.col("fi"))).alias("block")).select(
        "item_id", "wh", "fi", "block", F.explode(near).alias("flip")).select(
        "item_id", "wh", "fi", F.col("block").bitwiseXOR(F.col("flip")).alias("key"))
    probes = windows.select("doc_id", "th", "a", "b", "fw", F.explode(blocks(F.col("fw"))).alias("probe"))
    # The index grows with the benchmark by 2,788 rows an item, which Spark's estimate before the explode
    # doesn't see: both sides are exchanged, never broadcast.
    pairs = probes.join(keys.hint("merge"), F.col("probe") == F.col("key")).where(
        F.bit_count(F.col("fw").bitwiseXOR(F.col("fi"))) <= RADIUS).select(
        F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), F.col("a").alias("p_a"), F.col("b").alias("p_b"),
        F.col("item_id").alias("p_item"), F.col("wh").alias("p_wh"), F.col("fi").alias("p_fi")).distinct()
    pairs = pairs.join(index, F.col("p_item").eqNullSafe(F.col("item_id")) & (F.col("p_wh") == F.col("wh")) & (F.col("p_fi") == F.col("fi"))
                       ).select("p_id", "p_th", "p_a", "p_b", F.col("item_id"), F.col("sh"))
    same = (F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th"))
            & (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b")))
    kind = F.least(F.lit(k), F.size("ww"))
    of_window = F.coalesce(*[F.when(kind == n, shingles(F.col("ww"), n)) for n in range(1, k + 1)])
    both = windows.withColumn("ws", of_window).join(pairs, same).withColumn("m", overlap(F.col("sh"), F.col("ws")))
    union = F.size("sh") + F.size("ws") - F.col("m")
    good = both.where(F.col("m") * 100 >= F.lit(share) * union).withColumn("s", F.col("m") / union)
    best = good.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct(
        F.col("s"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("best"))
    return best.select("doc_id", "th", "item_id", F.col("best.s").alias("similarity"),
                       (-F.col("best.a")).cast("long").alias("start_word"),
                       (F.col("best.a") - F.col("best.b")).cast("long").alias("n_words"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a leak, columns as they are."""
    own, th = free_name(docs, "leak_id"), free_name(docs, "leak_digest")
    bad = leaks(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias(own), F.col("th").alias(th)).distinct()
    digest = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    return docs.join(bad, docs[f"`{id_col}`"].eqNullSafe(F.col(own)) & (digest == F.col(th)), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return leaks(read("documents"), read("benchmark")).drop("th")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
item AS (SELECT item_id, w, len(w) AS size, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ish AS (
  SELECT item_id, size, k, o, array_to_string(w[o + 1:o + k], ' ') AS s
  FROM (SELECT *, unnest(range(0, size - k + 1)) AS o FROM item)),
dsh AS (
  SELECT doc_id, k, len(w) AS n, p, array_to_string(w[p + 1:p + k], ' ') AS s
  FROM (SELECT d.doc_id, d.w, kk.k, unnest(range(0, len(d.w) - kk.k + 1)) AS p
        FROM d JOIN (SELECT DISTINCT k FROM item) kk ON len(d.w) >= kk.k)),
hit AS (SELECT dsh.doc_id, dsh.n, dsh.p, dsh.k, ish.item_id, ish.o, ish.size FROM dsh JOIN ish ON dsh.k = ish.k AND dsh.s = ish.s),
win AS (SELECT DISTINCT doc_id, greatest(0, p - o) AS a, least(n, p - o + size) AS b FROM hit),
pair AS (
  SELECT DISTINCT win.doc_id, a, b, hit.item_id, hit.k, hit.size
  FROM win JOIN hit ON win.doc_id = hit.doc_id AND hit.p >= a AND hit.p + hit.k <= b
  WHERE hit.k = least(5, b - a)),
cw AS (
  SELECT pair.doc_id, a, b, item_id, s, count(*) AS c
  FROM pair JOIN dsh ON pair.doc_id = dsh.doc_id AND dsh.k = pair.k AND p >= a AND p + dsh.k <= b GROUP BY ALL),
ci AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL),
met AS (
  SELECT pair.doc_id, pair.a, pair.b, pair.item_id, (pair.b - pair.a - pair.k + 1) AS nw, (pair.size - pair.k + 1) AS ni,
         sum(least(cw.c, ci.c))::BIGINT AS m
  FROM pair JOIN cw ON pair.doc_id = cw.doc_id AND pair.a = cw.a AND pair.b = cw.b AND pair.item_id = cw.item_id
       JOIN ci ON ci.item_id = cw.item_id AND ci.s = cw.s GROUP BY ALL),
good AS (SELECT *, m / (nw + ni - m) AS similarity FROM met WHERE 100 * m >= 75 * (nw + ni - m))
SELECT doc_id, item_id, similarity, a AS start_word, b - a AS n_words
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a, b) = 1
"""
