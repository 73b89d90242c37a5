"""Line dedup: lines that many documents share go from every document.

Tasks split whole texts into lines and emit ``(document, position, hash of the
normalised line)``; distinct (hash, document) pairs are counted per hash; lines
whose hash is over the threshold are joined back as positions to drop, and each
text is reassembled from the positions that stay.  Texts move through one
shuffle (the join that brings a document its positions), hashes through three;
a line that a third of all documents hold is pre-aggregated before counting,
and the join on hashes is left to AQE's skew handling.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import OUT_BYTES, id_order, rekey, small_batches, text_rows

#: Characters stripped at both ends of a line (fixed values): [\x20\x09-\x0D]
STRIP = b" \t\n\x0b\x0c\r"


def _line_hashes(min_len: int):
    def scan(batches):
        for part, texts in text_rows(batches):
            row, pos, key = [], [], []
            for i, text in enumerate(texts):
                for p, line in enumerate(text.split(b"\n")):
                    line = line.strip(STRIP).lower()  # bytes: only A-Z change
                    if line and (min_len <= 1 or len(line.decode("utf-8", "replace")) >= min_len):
                        row.append(i)
                        pos.append(p)
                        key.append(blake2b(line, digest_size=16).digest())
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(at), part.column("th").take(at),
                 pa.array(pos, pa.int32()), pa.array(key, pa.binary())],
                names=["doc_id", "th", "pos", "h"])
    return scan


def _reassemble(batches):
    for part, texts in text_rows(batches):
        drops = part.column("drop").to_pylist()
        kept, n_lines, n_dropped, start, held = [], [], [], 0, 0

        def flush(end):
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id").slice(start, end - start), part.column("row").slice(start, end - start),
                 pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["doc_id", "row", "kept", "n_lines", "n_dropped"])

        for i, text in enumerate(texts):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if drops[i]:
                gone = np.zeros(len(lines), bool)
                gone[drops[i]] = True
                text = b"\n".join([x for x, g in zip(lines, gone) if not g])
                n_dropped.append(int(gone.sum()))
            else:
                n_dropped.append(0)
            kept.append(text)
            held += len(text)
            if held > OUT_BYTES:
                yield flush(i + 1)
                kept, n_lines, n_dropped, start, held = [], [], [], i + 1, 0
        yield flush(len(texts))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_docs: int = 10, min_len: int = 1) -> DataFrame:
    """``(doc_id, row, kept, n_lines, n_dropped)`` per row of ``docs``: ``kept``
    is the text without the dropped lines, ``row`` the other columns as a struct
    (so names never clash).

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
    A-Z lower-cased; keys of at least ``min_len`` code points that occur in at
    least ``min_docs`` documents lose all their lines.

    Null or empty texts are one empty line and stay; an empty key is never
    dropped.  Rows that repeat a ``doc_id`` count as one document; a null
    ``doc_id`` makes each different text a document of its own.  An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.struct(F.lit(None).cast("string").alias("none"))
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"),
                       row.alias("row"), id_order(None, docs[f"`{text_col}`"]))
    id_type = base.schema["doc_id"].dataType.simpleString()
    lines = base.select("doc_id", "th", "text").mapInArrow(
        _line_hashes(min_len), f"doc_id {id_type}, th bigint, pos int, h binary")
    pairs = lines.select("h", "doc_id", F.when(F.col("doc_id").isNull(), F.col("th")).alias("own")).distinct()
    common = (pairs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
              .select(rekey(F.col("h"), "binary").alias("k")))
    drops = (lines.join(common, F.col("h") == F.col("k"))
             .groupBy(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"))
             .agg(F.collect_set("pos").alias("drop")))
    kind = base.schema["row"].dataType.simpleString()
    out = (base.join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")), "left")
           .select("doc_id", "text", "row", "drop")
           .mapInArrow(_reassemble, f"doc_id {id_type}, row {kind}, kept binary, n_lines bigint, n_dropped bigint"))
    return out.withColumn("kept", F.col("kept").cast("string"))


def like_input(result: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line_dedup``'s rows with the columns of ``docs`` again; ``n_chars`` follows the text."""
    def column(c: str):
        if c == id_col:
            return F.col("doc_id").alias(c)
        if c == text_col:
            return F.col("kept").alias(c)
        if c == "n_chars":
            return F.length("kept").cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)
    return result.select(*[column(c) for c in docs.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k
GROUP BY doc_id
"""
