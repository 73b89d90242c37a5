"""Suffix dedup: remove the bytes of strings of ``LENGTH`` that start more than once.

Windows meet by content: each window of ``LENGTH`` bytes belongs to the smallest
``GRAM``-byte gram in it (by hash, leftmost on ties), its anchor, so equal windows
have equal anchors at the same place.  Neighbouring windows of one anchor are a
region.  Regions whose anchor is nowhere else hold no repeat.  Of the rest, equal
regions are one class (all its windows repeat where it has two members), and
classes that share an anchor are searched together.

The search sorts the suffixes of a batch of classes and extends intervals of its
Burrows-Wheeler transform backwards, breadth first, so that the common prefixes
of neighbours are derived by increasing value; it stops at ``LENGTH``.  What has
no value then shares a window with its neighbour.  Batches hold whole anchors up
to ``MAX_CLASSES`` classes (about 3 MB of text); the windows of an anchor with
more are counted by their hashes instead, over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import OUT_BYTES, id_order, rekey, small_batches, stored, text_rows
from wellspring.llm.hashing import Ranges

LENGTH, GRAM = 400, 100
#: Classes of one anchor searched in one batch; bytes of a batch aimed at (its arrays fit
#: a core's cache); batches of a task.
MAX_CLASSES, BATCH_BYTES, TASK_BATCHES = 4096, 1 << 17, 8
#: Window starts of a text handled at a time.
_PIECE = 1 << 20
#: Prefix length at which the breadth-first extension starts.
_START = 32


def regions(text: bytes, ranges: Ranges, length: int, gram: int):
    """Arrays (anchor hash, region hash, first start, starts) that divide the text's windows."""
    grams = length - gram + 1
    for at in range(0, len(text) - length + 1, _PIECE):
        piece = np.frombuffer(text[at:at + _PIECE + length - 1], np.uint8)
        starts = len(piece) - length + 1
        sums = ranges.prefix(piece)
        where = np.arange(len(piece) - gram + 1)
        h = ranges.of(sums, where, where + gram)
        # The upper half is the order, the lower the place: the least is the leftmost smallest.
        low, span = (h & np.uint64(0xFFFFFFFF00000000)) | where.astype(np.uint64), 1
        while 2 * span <= grams:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < grams:
            low = np.minimum(low[:span - grams], low[grams - span:])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.diff(anchor, prepend=-1))
        hi = np.append(lo[1:], starts)
        yield (h[anchor[lo]].view(np.int64), ranges.of(sums, lo, hi - 1 + length).view(np.int64), at + lo, hi - lo)


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols; where prefixes of ``_START`` symbols
    begin to differ; where they differ from the one before in the last of them alone."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i:n + i]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + 2 * depth, np.int32)  # of a group: its first place + 1; behind the end: 0
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0)) + 1
    width, half = 8, None
    begins = nearly = first
    while width < depth:
        if 2 * width == _START:
            half = rank.copy()
        ends = np.append(first[1:], True)
        slots = np.flatnonzero(~(first & ends))
        some = order[slots]
        key = (rank[some].astype(np.uint64) << np.uint64(32)) | rank[some + width].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[slots] = some
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(slots) else np.zeros(0, bool)
        first = first.copy()
        first[slots] = new
        rank[some] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1 if len(slots) else 0
        width *= 2
        if width == _START:
            begins = first
    p, q = order[1:], order[:-1]
    back = _START // 2 - 1
    nearly = np.concatenate([[False], begins[1:] & (half[p] == half[q]) & (half[p + back] == half[q + back])])
    return order, begins, nearly


def shares_prefix(symbols: np.ndarray, order: np.ndarray, begins: np.ndarray, nearly: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix array, whether its suffix has ``length`` symbols in common with the one before.

    A border between suffixes at level v (they share v symbols) puts a border at
    level v + 1 between the backward extensions by any symbol that the transform
    holds on both sides of it: its last place before the border and its next one
    from there on.  The next one of those that aren't known yet stands before the
    next border, so only the places up to there are looked at.
    """
    n = len(symbols)
    before = symbols[order - 1].astype(np.int16)
    before[order == 0] = 256  # nothing stands before the first symbol
    place = np.argsort(before, kind="stable").astype(np.int32)  # the transform's places by symbol
    present, count = np.unique(symbols, return_counts=True)
    # Places by symbol lead to the suffixes by first symbol in the same order; the last symbol's own
    # suffix comes first in its bucket and follows no place, and the first symbol's place leads nowhere.
    alone = int(count[:np.searchsorted(present, symbols[-1])].sum())
    leads = np.empty(n, np.int32)
    leads[place[:-1]] = np.delete(np.arange(n, dtype=np.int32), alone)
    leads[place[-1]] = 0
    last = np.full(n, n, np.int32)  # the symbol's place before; n: none
    same = before[place[1:]] == before[place[:-1]]
    last[place[1:][same]] = place[:-1][same]
    known = begins.copy()
    frontier = np.flatnonzero(nearly)
    for _ in range(_START, length):
        if not len(frontier):
            break
        borders = np.append(np.flatnonzero(known), n)
        size = borders[np.searchsorted(borders, frontier) + 1] - frontier
        j = np.repeat(frontier - np.cumsum(size) + size, size) + np.arange(size.sum())
        to = np.unique(leads[j[last[j] < np.repeat(frontier, size)]])
        frontier = to[~known[to]]
        known[frontier] = True
    return ~known


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, a Boolean per window start: whether that window is also elsewhere in the texts."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # 0xFF, not in UTF-8, becomes 0
    order, begins, nearly = suffix_array(symbols, 1 << (length - 1).bit_length())
    same = shares_prefix(symbols, order, begins, nearly, length)
    hit = np.zeros(len(symbols), bool)
    hit[order[same]] = True
    hit[order[:-1][same[1:]]] = True
    return [hit[s:s + max(0, n - length + 1)] for s, n in zip(starts, sizes)]


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[0::2], edge[1::2])]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _occurrences(length: int, gram: int):
    def scan(batches):
        ranges = Ranges()
        for part, texts in text_rows(batches):
            row, columns = [], ([], [], [], [])
            for i, text in enumerate(texts):
                for found in regions(text, ranges, length, gram):
                    row.append(np.full(len(found[0]), i))
                    for c, x in zip(columns, found):
                        c.append(x)
            if row:
                at = pa.array(np.concatenate(row))
                h, d, lo, n = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("th").take(at), pa.array(h), pa.array(d),
                     pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc_id", "th", "h", "d", "lo", "n"])
    return scan


def _cut(length: int):
    """The bytes of the regions asked for from each text."""
    def scan(batches):
        out, held = [], 0
        for part, texts in text_rows(batches):
            for text, asked in zip(texts, part.column("asked").to_pylist()):
                for r in asked:
                    out.append({"h": r["h"], "d": r["d"], "c": r["c"], "bytes": text[r["lo"]:r["lo"] + r["n"] - 1 + length]})
                    held += len(out[-1]["bytes"])
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _CUT)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _CUT)
    return scan


_CUT = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("c", pa.int64()), ("bytes", pa.binary())])
_MARKS = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("runs", _RUNS)])


def _search(length: int):
    def scan(key, table):
        found = [_runs(f) for f in repeated_starts(table.column("bytes").to_pylist(), length)]
        keep = pa.array([bool(f) for f in found], pa.bool_())
        return pa.table([table.column("h"), table.column("d"), pa.array(found, _RUNS)], schema=_MARKS).filter(keep)
    return scan


def _window_hashes(length: int):
    def scan(batches):
        ranges = Ranges()
        for batch in batches:
            for i, text in enumerate(batch.column("bytes").to_pylist()):
                where = np.arange(len(text) - length + 1)
                w = ranges.of(ranges.prefix(np.frombuffer(text, np.uint8)), where, where + length).view(np.int64)
                at = pa.array(np.full(len(w), i))
                yield pa.RecordBatch.from_arrays([batch.column("h").take(at), batch.column("d").take(at), pa.array(w),
                                                  pa.array(where.astype(np.int32))], names=["h", "d", "w", "off"])
    return scan


def _remove(length: int):
    def scan(batches):
        for part, texts in text_rows(batches):
            marks = part.column("marks").to_pylist()
            kept, n_bytes, n_removed, n_spans, first, held = [], [], [], [], 0, 0

            def flush(end):
                return pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(first, end - first), part.column("row").slice(first, end - first),
                     pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(n_spans, pa.int64())], names=["doc_id", "row", "kept", "n_bytes", "n_removed", "n_spans"])

            for i, text in enumerate(texts):
                n_bytes.append(len(text))
                spans = 0
                if marks[i]:
                    change = np.zeros(len(text) + 1, np.int32)
                    for m in marks[i]:
                        for r in m["runs"]:
                            change[m["lo"] + r["a"]] += 1
                            change[m["lo"] + r["b"] - 1 + length] -= 1
                    gone = np.cumsum(change[:-1]) > 0
                    spans = len(_runs(gone))
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_spans.append(spans)
                n_removed.append(n_bytes[-1] - len(text))
                kept.append(text)
                held += len(text)
                if held > OUT_BYTES:
                    yield flush(i + 1)
                    kept, n_bytes, n_removed, n_spans, first, held = [], [], [], [], i + 1, 0
            yield flush(len(texts))
    return scan


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, max_classes: int = MAX_CLASSES) -> DataFrame:
    """``(doc_id, row, kept, n_bytes, n_removed, n_spans)`` per row: ``kept`` is the
    UTF-8 text (binary: a cut may fall inside a character) without each byte that
    a string of ``length`` bytes covers which also starts elsewhere, in this row
    or another; ``row`` has the other columns as a struct.

    Null texts are empty.  Every row counts as a text of its own, so rows that
    repeat lose all their long strings; null ids are no different.  Texts under
    ``length`` bytes stay as they are.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.struct(F.lit(None).cast("string").alias("none"))
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"),
                       row.alias("row"), id_order(None, docs[f"`{text_col}`"]))
    kind = base.schema["doc_id"].dataType.simpleString()
    # Written once: both readers would scan every text for its anchors.
    found = stored(base.select("doc_id", "th", "text").mapInArrow(
        _occurrences(length, gram), f"doc_id {kind}, th bigint, h bigint, d bigint, lo int, n int"), "occurrences")
    often = found.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select(rekey(F.col("h")).alias("k"))
    found = stored(found.join(often, F.col("h") == F.col("k"), "left_semi"), "regions")

    # Any member stands for its class; first() takes all its columns from one row.
    classes = stored(found.groupBy("h", "d").agg(
        F.count("*").alias("m"), F.max("n").alias("n"), F.first("doc_id").alias("c_id"), F.first("th").alias("c_th"),
        F.first("lo").alias("lo")), "classes")
    several = (classes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
               .select(rekey(F.col("h")).alias("k"), "c"))
    asked = (classes.join(several, F.col("h") == F.col("k"))
             .groupBy("c_id", "c_th").agg(F.collect_list(F.struct("h", "d", "c", "lo", "n")).alias("asked")))
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))
    texts = base.select("doc_id", "th", "text").join(asked, same).select("text", "asked")
    cut = stored(texts.mapInArrow(_cut(length), "h bigint, d bigint, c bigint, bytes binary"), "texts").dropDuplicates(["h", "d"])

    size = classes.join(several, F.col("h") == F.col("k")).agg(F.sum(F.col("n") + F.lit(length))).first()[0] or 0
    batches = max(1, -(-int(size) // BATCH_BYTES))
    part_of = F.pmod(F.xxhash64("h"), F.lit(batches))
    runs = "array<struct<a: int, b: int>>"
    # A number of partitions that is given keeps AQE from merging them by bytes: what a batch costs is time.
    batched = cut.where(F.col("c") <= max_classes).withColumn("batch", part_of).repartition(-(-batches // TASK_BATCHES), "batch")
    marks = (batched.groupBy("batch").applyInArrow(_search(length), f"h bigint, d bigint, runs {runs}"))
    windows = cut.where(F.col("c") > max_classes).mapInArrow(_window_hashes(length), "h bigint, d bigint, w bigint, off int")
    twice = (windows.groupBy("h", "w").agg(F.count("*").alias("m")).where("m > 1")
             .select(rekey(F.col("h")).alias("h2"), F.col("w").alias("w2")))
    more = (windows.join(twice, (F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2"))).groupBy("h", "d")
            .agg(F.collect_list(F.struct(F.col("off").alias("a"), (F.col("off") + 1).alias("b"))).alias("runs")))
    single = marks.unionByName(more).join(classes.where("m > 1").select(F.col("h").alias("h2"), F.col("d").alias("d2")),
                                          (F.col("h") == F.col("h2")) & (F.col("d") == F.col("d2")), "left_anti")
    copies = classes.where("m > 1").select("h", "d", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
    marks = stored(single.unionByName(copies).select(F.col("h").alias("mh"), F.col("d").alias("md"), "runs"), "marks")

    per = (found.join(marks, (F.col("h") == F.col("mh")) & (F.col("d") == F.col("md")))
           .groupBy(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"))
           .agg(F.collect_list(F.struct("lo", "runs")).alias("marks")))
    row_kind = base.schema["row"].dataType.simpleString()
    return (base.join(per, same, "left").select("doc_id", "text", "row", "marks")
            .mapInArrow(_remove(length), f"doc_id {kind}, row {row_kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
