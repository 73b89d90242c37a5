"""WARC archives: write page captures with revisit records, read them back by
boundary-chain verification.

Writing: a record is one text row (headers, HTTP block, payload) and the text
writer's line separator is the CRLF CRLF that ends a record, so the written
files are valid ``.warc`` contents, gzip-compressed, on any file system that
Spark writes to.

Reading: each file is read as pieces that the magic ``WARC/1.`` separates; one
that doesn't go on with a digit and CRLF begins no record.  A task streams the
pieces of a file (a plain file that Spark reads in splits is put together
again by an exchange of its pieces), keeps the running offset and emits, for
each piece whose headers parse, a candidate ``(file, offset, successor offset)``;
the successor follows from Content-Length alone.  A magic inside a payload makes
a candidate too.  Pointer jumping over the light (file, offset, successor) rows
from each file's offset 0 then marks what the chain reaches, in a number of
rounds logarithmic in the records of a file; everything else is rejected.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm.common import rekey, shared_path, small_batches, stored, text_rows

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
FAMILY = "WARC/1."
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are always stored whole.
MIN_PAYLOAD = 100
#: Records of one archive, at most.
ARCHIVE_RECORDS = 50_000


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_payload: int = MIN_PAYLOAD,
                   date: str = "1970-01-01T00:00:00Z", compression: str = "gzip",
                   records: int = ARCHIVE_RECORDS) -> None:
    """Write one record per row of ``pages`` to archives under ``path``, at most
    ``records`` in each, gzip-compressed or as ``compression`` says (``none``).

    Of the rows with equal payloads of at least ``min_payload`` bytes those with
    the smallest id are responses, the others revisits that refer to it; smaller
    payloads are all responses.  A null payload is empty; a null url leaves out
    the target line; a null id is written empty and never is the smallest
    (when all ids of equal payloads are null, all are responses).  Rows that
    repeat the smallest id are responses each.
    """
    base = pages.select(pages[f"`{id_col}`"].alias("id"), pages[f"`{url_col}`"].cast("string").alias("url"),
                        F.coalesce(pages[f"`{payload_col}`"].cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    first = (base.where(F.col("n") >= min_payload).groupBy("digest")
             .agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
             .select(rekey(F.col("digest"), "string").alias("k"), "first"))
    rows = base.join(first, F.col("digest") == F.col("k"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                     F.col("n").cast("string"), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.withColumn("block", block)
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("first")),
                                 F.lit("\r\nWARC-Profile: " + PROFILE))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(END), F.col("block"))
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option(
        "maxRecordsPerFile", records).text(path)


def _headers(piece: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """The header fields after a magic and where the block starts, if they are a record's."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or not piece[:1].isdigit() or piece[1:3] != b"\r\n":
        return None
    fields = {}
    for line in piece[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit() or b"warc-type" not in fields or b"warc-record-id" not in fields:
        return None
    return fields, end + 4


class _Candidate:
    """A record whose block is still being read: its HTTP head, then a digest of its payload."""

    def __init__(self, off: int, fields: dict, start: int, keep: bool):
        self.off, self.fields = off, fields
        self.left = int(fields[b"content-length"])
        self.next = off + len(FAMILY) + start + self.left + len(END)
        self.head: bytes | None = b"" if b"application/http" in fields.get(b"content-type", b"") else None
        self.declared = None
        self.sha, self.n, self.parts = sha256(), 0, [] if keep else None

    def feed(self, data: bytes) -> bool:
        """Take what belongs to the block; whether it is whole."""
        data = data[:self.left] if len(data) > self.left else data
        self.left -= len(data)
        if self.head is not None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return not self.left
            for line in self.head[:end].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    self.declared = int(value)
            data, self.head = self.head[end + 4:], None
        self.sha.update(data)
        self.n += len(data)
        if self.parts is not None:
            self.parts.append(data)
        return not self.left

    def row(self, file: str) -> dict:
        text = lambda k: (v := self.fields.get(k)) and v.decode("utf-8", "replace")
        kind = text(b"warc-type")
        revisit = kind == "revisit"
        digest = (text(b"warc-payload-digest") or "").removeprefix("sha256:")
        row = {"file": file, "off": self.off, "next": self.next, "record_type": kind,
               "record_id": text(b"warc-record-id"), "refers_to": text(b"warc-refers-to"),
               "target_uri": text(b"warc-target-uri"), "declared_digest": digest,
               "payload_bytes": self.declared if revisit and self.declared is not None else self.n,
               "payload_digest": digest if revisit else self.sha.hexdigest()}
        if self.parts is not None:
            row["payload"] = b"".join(self.parts)
        return row


_FIELDS = [("file", pa.string()), ("off", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()),
           ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
           ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_DDL = ("file string, off bigint, next bigint, record_type string, record_id string, refers_to string, "
        "target_uri string, declared_digest string, payload_bytes bigint, payload_digest string")


def _scan(keep: bool):
    schema = pa.schema(_FIELDS + ([("payload", pa.binary())] if keep else []))
    magic = FAMILY.encode()

    def scan(batches):
        file, at, open_, out, held = None, 0, [], [], 0
        for part, pieces in text_rows(batches, "value"):
            for path, piece in zip(part.column("file").to_pylist(), pieces):
                if path != file:  # what stands before a file's first magic
                    file, at, open_ = path, len(piece), []
                    continue
                still = []
                for c in open_:
                    if c.feed(magic) or c.feed(piece):
                        out.append(c.row(file))
                    else:
                        still.append(c)
                open_ = still
                if (found := _headers(piece)) is not None:
                    c = _Candidate(at, *found, keep)
                    if c.feed(piece[found[1]:]):
                        out.append(c.row(file))
                    else:
                        open_.append(c)
                at += len(magic) + len(piece)
                held += len(piece)
            if out and (len(out) > 2000 or held > (8 << 20)):
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return scan


def candidates(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Every piece under ``path`` that parses as a record and is whole, with its successor's offset."""
    small_batches(spark)
    pieces = spark.read.option("lineSep", FAMILY).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    packed = F.col("file").endswith(".gz")
    # Splits of a plain file hold its pieces in turn: together and in order they are the whole file.
    plain = (pieces.where(~packed).withColumn("no", F.monotonically_increasing_id()).repartition("file")
             .sortWithinPartitions("file", "start", "no"))
    pieces = pieces.where(packed).select("value", "file").unionByName(plain.select("value", "file"))
    return pieces.mapInArrow(_scan(payload), _DDL + (", payload binary" if payload else ""))


def reachable(links: DataFrame) -> DataFrame:
    """``(file, off)`` of the records that the chain of successors from each file's offset 0 reaches."""
    state = stored(links.select("file", "off", F.col("next").alias("jump"), (F.col("off") == 0).alias("hit")), "chain")
    while not state.where("jump is not null").isEmpty():
        far = state.select(F.col("file").alias("f"), F.col("off").alias("o"), F.col("jump").alias("j"))
        steps = state.join(far, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("o")), "left").select(
            "file", "off", F.col("j").alias("jump"), "hit", F.lit(True).alias("real"))
        marks = state.where("hit and jump is not null").select(
            "file", F.col("jump").alias("off"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("hit"),
            F.lit(False).alias("real"))
        state = stored(steps.unionByName(marks).groupBy("file", "off").agg(
            F.max("jump").alias("jump"), F.max("hit").alias("hit"), F.max("real").alias("real"))
            .where("real").drop("real"), "chain")
    return state.where("hit").select("file", "off")


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives (``WARC/1.``, gzip or plain) under ``path``: file, off, next, record_type,
    record_id, refers_to, target_uri, declared_digest, payload_bytes and
    payload_digest (both of what was read; a revisit's are those it declares),
    and ``payload`` if asked for.  Records after a broken link of the chain, cut
    off at a file's end or inside a payload are not returned."""
    found = stored(candidates(spark, path), "candidates")
    true = reachable(found).select(F.col("file").alias("f"), F.col("off").alias("o"))
    rows = candidates(spark, path, True) if payload else found
    return rows.join(true, (F.col("file") == F.col("f")) & (F.col("off") == F.col("o"))).drop("f", "o")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    return read_archives(spark, path).select(
        F.when(F.col("record_id") != "<urn:page:>", number("record_id")).alias("page_id"), "payload_bytes",
        "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))


OP2_SQL = """
WITH base AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (
  SELECT digest, min(page_id) AS first FROM base WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN f.first IS NULL OR page_id IS NOT DISTINCT FROM f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM base b LEFT JOIN first f ON b.digest = f.digest
"""
