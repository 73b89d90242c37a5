"""Source divergence audit: how far the sources of a language stand apart in their terms.

Indexing is single-pass and in memory: a task counts (language, term) postings per
source in a block until ``BLOCK_ENTRIES`` are held, then spills the block as a run
sorted by hash shard, language and term, cut into chunks.  A shard's chunks arrive
in the order of their first terms and a heap merges those that are open into
frequencies, so a task holds one chunk a run, whatever the shard's size.

The distance of two sources sums a term's value over every kept term.  Most terms
are in neither source and have one value, and most of the rest are in one of the
two: their values follow from how many terms have which count.  What remains are
corrections of the terms that both hold, which tasks stream into cells of
``CELL`` x ``CELL`` sources.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import rekey, small_batches, stored, text_rows

#: Terms need as many documents of their language.
MIN_DOCS = 3
#: Ranks of part ``term``.
TOP = 200
#: Parts in which probabilities are counted, and what is added to each count.
SCALE, ADD = 1_000_000_000, 1
#: Postings that a block holds before it is spilled; terms of a chunk; hash shards.
BLOCK_ENTRIES, CHUNK, SHARDS = 400_000, 256, 1024
#: Sources on one side of a cell of corrections; pairs of postings corrected at a time.
CELL, PAIRS = 256, 1 << 20

#: Bytes of terms, A-Z lower-cased; all others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_RUN = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())),
                  ("docs", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("source", pa.list_(pa.string())),
                  ("count", pa.list_(pa.int64()))])
_RUN_DDL = ("shard int, lang string, first binary, terms array<binary>, docs array<bigint>, n array<int>, "
            "source array<string>, count array<bigint>")
_FREQ = ["lang", "term", "docs", "total", "postings"]
_FREQ_DDL = "lang string, term string, docs bigint, total bigint, postings array<struct<source: string, count: bigint>>"


class Block:
    """Postings in memory: per language, terms with their documents and, by source, their counts."""

    def __init__(self, shards: int):
        self.shards = shards
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        terms = text.translate(_TERM).split()
        if terms:
            count = self.counts[lang][source]
            before = len(count)
            count.update(terms)
            self.docs[lang].update(set(terms))
            self.held += len(count) - before

    def run(self, chunk: int) -> pa.RecordBatch:
        """The block as chunks of a run sorted by (shard, language, term)."""
        parts: dict[str, list] = {name: [] for name in _RUN.names}
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            shard = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % self.shards
            order = np.argsort(shard, kind="stable")
            shard, terms = shard[order], [terms[i] for i in order.tolist()]
            place = dict(zip(terms, range(len(terms)))).__getitem__
            names = sorted(self.counts[lang])
            counters = [self.counts[lang][s] for s in names]
            sizes = [len(c) for c in counters]
            row = np.concatenate([np.fromiter(map(place, c), np.int64, n) for c, n in zip(counters, sizes)])
            count = np.concatenate([np.fromiter(c.values(), np.int64, n) for c, n in zip(counters, sizes)])
            order = np.argsort(row, kind="stable")
            n = np.bincount(row, minlength=len(terms))
            start = np.concatenate([[0], np.cumsum(n)])
            edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(terms)]])
            cut = np.concatenate([np.arange(lo, hi, chunk) for lo, hi in zip(edge[:-1], edge[1:])] + [[len(terms)]])
            whole = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
            k = len(cut) - 1
            parts["shard"].append(pa.array(shard[cut[:-1]].astype(np.int32)))
            parts["lang"].append(pa.array([lang] * k, pa.string()))
            parts["first"].append(pa.array([terms[i] for i in cut[:-1].tolist()], pa.binary()))
            parts["terms"].append(whole(cut, pa.array(terms, pa.binary())))
            parts["docs"].append(whole(cut, pa.array(np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)))))
            parts["n"].append(whole(cut, pa.array(n.astype(np.int32))))
            source = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(names)), sizes)[order].astype(np.int32)),
                                                    pa.array(names, pa.string())).dictionary_decode()
            parts["source"].append(whole(start[cut], source))
            parts["count"].append(whole(start[cut], pa.array(count[order])))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(parts[name]) if parts[name] else pa.array([], _RUN.field(name).type)
                                           for name in _RUN.names], schema=_RUN)


def _index(block_entries: int, chunk: int, shards: int):
    def scan(batches):
        block = Block(shards)
        spill = lambda run: (run.slice(at, 256) for at in range(0, run.num_rows, 256))
        for part, texts in text_rows(batches):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts):
                block.add(lang, source, text)
                if block.held >= block_entries:
                    yield from spill(block.run(chunk))
                    block = Block(shards)
        yield from spill(block.run(chunk))
    return scan


class Chunk:
    """A chunk of a run: terms, their documents, and per term the postings from ``start`` on."""

    def __init__(self, shard: int, lang: str, terms: list, docs: list, start: list, sources: list, count: list):
        self.key, self.terms, self.docs, self.start = (shard, lang), terms, docs, start
        self.sources, self.count = sources, count
        self.at = 0


def chunks(batch: pa.RecordBatch):
    """The chunks that the rows of a batch are."""
    lists = {}
    for name in ("terms", "docs", "n", "source", "count"):
        column = batch.column(name)
        at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        values = column.flatten()
        if name == "source":
            values = values.dictionary_encode()
            names = values.dictionary.to_pylist()
            lists[name] = at, [names[i] for i in values.indices.to_numpy().tolist()]
        else:
            lists[name] = at, values.to_numpy().tolist() if pa.types.is_integer(values.type) else values.to_pylist()
    for i, (shard, lang) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist())):
        terms, docs, n, sources, count = (values[at[i]:at[i + 1]] for at, values in lists.values())
        yield Chunk(shard, lang, terms, docs, [0, *accumulate(n)], sources, count)


def merged(arriving, min_docs: int):
    """``(lang, term, documents, {source: count})`` of the terms in at least ``min_docs``
    documents, from chunks in the order of (shard, language, first term)."""
    heap: list = []
    key, number = None, 0

    def drain(until: bytes | None):
        while heap and (until is None or heap[0][0] < until):
            term, docs, parts = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                _, no, c = heap[0]
                i = c.at
                docs += c.docs[i]
                parts.append((c, i))
                c.at = i + 1
                if i + 1 < len(c.terms):
                    heapq.heapreplace(heap, (c.terms[i + 1], no, c))
                else:
                    heapq.heappop(heap)
            if docs >= min_docs:
                counts: dict = {}
                for c, i in parts:
                    for j in range(c.start[i], c.start[i + 1]):
                        s = c.sources[j]
                        counts[s] = counts.get(s, 0) + c.count[j]
                yield key[1], term, docs, counts

    for c in arriving:
        if key != c.key:
            yield from drain(None)
            key = c.key
        else:
            yield from drain(c.terms[0])
        number += 1
        heapq.heappush(heap, (c.terms[0], number, c))
    yield from drain(None)


def _merge(min_docs: int):
    def scan(batches):
        rows = merged((c for batch in batches for at in range(0, batch.num_rows, 64) for c in chunks(batch.slice(at, 64))), min_docs)
        while out := list(islice(rows, 4096)):
            lang, term, docs, counts = zip(*out)
            at = pa.array([0, *accumulate(map(len, counts))], pa.int32())
            total = [sum(c.values()) for c in counts]
            postings = pa.StructArray.from_arrays(
                [pa.array([s for c in counts for s in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())],
                names=["source", "count"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()),
                 pa.array(total, pa.int64()), pa.ListArray.from_arrays(at, postings)], names=_FREQ)
    return scan


def frequencies(base: DataFrame, min_docs: int = MIN_DOCS, block_entries: int = BLOCK_ENTRIES, chunk: int = CHUNK,
                shards: int = SHARDS) -> DataFrame:
    """``(lang, term, docs, total, postings)`` of the kept terms of ``base``'s (lang, source, text) rows."""
    runs = base.mapInArrow(_index(block_entries, chunk, shards), _RUN_DDL)
    return (runs.repartition("shard").sortWithinPartitions("shard", "lang", "first")
            .mapInArrow(_merge(min_docs), _FREQ_DDL))


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + ADD) / (n + ADD * v)), exact."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(ADD)).cast("decimal(20,0)")
    return F.call_function("div", over, (n + F.lit(ADD) * v).cast("decimal(20,0)")) + F.lit(1).cast("long")


def term_value(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


_CELL = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("more", pa.int64())])


def _corrections(batches):
    """Sums over the rows of a cell of what two postings of a term add to what each adds alone."""
    value = lambda p, q: (p - q) * (p - q) // q
    key, total = None, None

    def out():
        if key is not None:
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(i), pa.string()), pa.array((i + key[1] * CELL).astype(np.int32)),
                 pa.array((j + key[2] * CELL).astype(np.int32)), pa.array(total[i, j])], schema=_CELL)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "bi", "bj"))))
        edges = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
        sides = []
        for name in ("li", "lj"):
            column = batch.column(name)
            cells = column.flatten()
            sides.append((column.value_lengths().to_numpy(), *(cells.field(f).to_numpy() for f in ("idx", "p", "p0"))))
        start = [np.concatenate([[0], np.cumsum(s[0])]) for s in sides]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if keys[lo] != key:
                yield from out()
                key, total = keys[lo], np.zeros((CELL, CELL), np.int64)
            size = sides[0][0][lo:hi].astype(np.int64) * sides[1][0][lo:hi]
            ends = np.cumsum(size)
            at = 0
            while at < hi - lo:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                n, width = size[at:stop], sides[1][0][lo + at:lo + stop]
                row = np.repeat(np.arange(at, stop), n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a = start[0][lo + row] + off // np.repeat(width, n)
                b = start[1][lo + row] + off % np.repeat(width, n)
                (_, i, p, p0), (_, j, q, q0) = ((None, s[1][x], s[2][x], s[3][x]) for s, x in zip(sides, (a, b)))
                more = value(p, q) - value(p, q0) - value(p0, q) + value(p0, q0)
                apart = i != j
                np.add.at(total, (i[apart] - key[1] * CELL, j[apart] - key[2] * CELL), more[apart])
                at = stop
    yield from out()


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for each (lang, source) group of ``docs``.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased; a language keeps
    those in at least ``min_docs`` of its documents.  A group gives a kept term with
    ``count`` places p = 1 + floor(10^9 (count + 1) / (N + V)) of V kept terms and N places;
    so does the whole language.  Part ``pair`` has a row per other source of the
    language, its value the sum over all V terms of floor((p - q)^2 / q) with that
    source's q (0 where V is 0), every rank.  Part ``term`` has the ``top`` terms
    that the group holds and that are more probable in it than in the language (q).

    Null texts, languages and sources are empty ones.  Each row is a document, repeated rows
    too.  Groups without terms have pairs; a language's only source has none.  Ties go by
    the item's UTF-8 bytes.  An empty table gives an empty result.  All arithmetic is on
    integers; a posting list (one entry a source) is one row.
    """
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit(""))
    base = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    freq = stored(frequencies(base, min_docs, block_entries), "frequencies")
    places = freq.select("lang", "term", "total", F.inline("postings"))

    langs = freq.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    counts = places.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    hist = (places.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")).groupBy("lang", "source")
            .agg(F.collect_list(F.struct("count", "terms")).alias("hist")))
    zero = F.lit(0).cast("long")
    groups = (base.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(hist, ["lang", "source"], "left")
              .join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"),
                      F.coalesce("lang_n", zero).alias("lang_n"),
                      F.coalesce("hist", F.array().cast("array<struct<count: bigint, terms: bigint>>")).alias("hist"),
                      (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("idx")))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, probability(zero, F.col("n"), F.col("v"))))
    groups = stored(groups, "groups")

    known = groups.select(rekey(F.col("lang"), "string").alias("gl"), rekey(F.col("source"), "string").alias("gs"), "n", "v", "lang_n", "idx", "p0")
    places = places.join(known, (F.col("lang") == F.col("gl")) & (F.col("source") == F.col("gs"))).withColumn(
        "p", probability(F.col("count"), F.col("n"), F.col("v")))
    places = places.select("lang", "source", "term", "p", "p0", "idx",
                           probability(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    terms = places.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         term_value(F.col("p"), F.col("q")).alias("value"))

    # A term's postings, cut into blocks of sources; blocks meet in cells.
    lists = (places.groupBy("lang", "term", F.floor(F.col("idx") / CELL).cast("int").alias("b"))
             .agg(F.collect_list(F.struct("idx", "p", "p0")).alias("l")))
    left = lists.select("lang", "term", F.col("b").alias("bi"), F.col("l").alias("li"))
    right = lists.select(F.col("lang").alias("rl"), F.col("term").alias("rt"), F.col("b").alias("bj"), F.col("l").alias("lj"))
    cells = (left.join(right, (F.col("lang") == F.col("rl")) & (F.col("term") == F.col("rt")))
             .where("bi <> bj or size(li) > 1")
             .select("lang", "bi", "bj", "li", "lj", F.pmod(F.xxhash64("term"), F.lit(256)).alias("salt"))
             .repartition("lang", "bi", "bj", "salt").sortWithinPartitions("lang", "bi", "bj"))
    more = (cells.select("lang", "bi", "bj", "li", "lj").mapInArrow(_corrections, "lang string, i int, j int, more bigint")
            .groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
            .select(F.col("lang").alias("ml"), "i", "j", "more"))

    side = lambda p: groups.select(*[F.col(c).alias(f"{p}_{c}") for c in ("lang", "source", "idx", "p0", "n", "v", "hist")])
    alone = term_value(F.col("a_p0"), F.col("b_p0"))

    def one_sided(side_: str, f) -> Column:
        p = lambda h: probability(h["count"], F.col(f"{side_}_n"), F.col(f"{side_}_v"))
        return F.aggregate(f"{side_}_hist", zero, lambda s, h: s + h["terms"] * (f(p(h)) - alone))

    total = (F.col("a_v") * alone + one_sided("a", lambda p: term_value(p, F.col("b_p0")))
             + one_sided("b", lambda q: term_value(F.col("a_p0"), q)) + F.coalesce("more", zero))
    pairs = (side("a").join(side("b"), (F.col("a_lang") == F.col("b_lang")) & (F.col("a_source") != F.col("b_source")))
             .join(more, (F.col("a_lang") == F.col("ml")) & (F.col("a_idx") == F.col("i")) & (F.col("b_idx") == F.col("j")), "left")
             .select(F.col("a_lang").alias("lang"), F.col("a_source").alias("source"), F.lit("pair").alias("part"),
                     F.col("b_source").alias("item"), F.when(F.col("a_v") > 0, total).otherwise(zero).alias("value")))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (pairs.withColumn("rank", F.row_number().over(order))
            .unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source),
probs AS (
  SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1) // (n + v)::HUGEINT)::BIGINT AS p
  FROM sizes s JOIN vs USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1) // (ln + v)::HUGEINT)::BIGINT AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term)
  JOIN (SELECT lang, sum(c) AS ln FROM counts GROUP BY lang) USING (lang) JOIN vs USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p)::HUGEINT * (a.p - b.p)) // b.p) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q)::HUGEINT * (p - q)) // q)::BIGINT AS value
  FROM probs JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""
