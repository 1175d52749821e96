"""Legacy archives to WARC.

`write_arcs` files pages in ARC archives of versions 1 and 2, as an old crawler would have. `convert_archives` reads ARC files by the header lines of
their version and the lengths these declare, and writes WARC files: each record gets an identifier (a UUID of its file and place), a WARC date, its type and its digests.
Of records with equal payloads of at least 1000 bytes the one with the largest page id is a response, the others are revisit records that
refer to it and carry only their HTTP head. `read_archives` reads WARC files back and finds the page that each revisit refers to.

How it is distributed: an archive is at most `ARCHIVE_BYTES` (or one record), so a file is one task's. Only (digest, length, page id, place) of records are grouped, with map-side
aggregation. Digests found twice set bits of a bitmap of bounded size, which is broadcast; records whose bit is not set can't have copies and are written where they were read,
the others go through a join by digest, which splits a digest of many copies like any skewed join. Within a file only the copy with the largest id takes its
payload along.

Defined results: a null html is an empty payload, a null url is written as `-`; a null page id is less than all others; rows with equal id and payload are told apart by url, then by their
place in the archives, so one of several alike is the response; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm import archives as A
from vocalith.llm.common import materialize, shared_path, small_batches, table

LEAST_PAYLOAD = 1000
ARCHIVE_BYTES = 16 << 20
#: Bits by which a digest is known to have copies; 2 MB at most are broadcast.
DIGEST_BITS = 1 << 24
#: The crawl that the archives stand for began then; a page's date follows from its id.
FIRST_DATE = datetime(2000, 1, 1, tzinfo=timezone.utc)

RECORDS = "file string, place long, identifier string, uri string, date string, address string, mime string, kind string, truncated boolean, page long, head binary, payload binary, payload_bytes long, digest string, crowded boolean"


def _archive_files(records, begin, most: int):
    """Archives of records one after another, cut before they pass `most` bytes. begin(number) gives an archive's first bytes, each of records(offset, number) a record's."""
    number, parts, size = 0, [], 0
    for make in records:
        if not parts:
            parts = [begin(number)]
            size = len(parts[0])
        data = make(size, number)
        if size + len(data) > most and len(parts) > 1:
            yield b"".join(parts)
            number += 1
            parts = [begin(number)]
            size = len(parts[0])
            data = make(size, number)
        parts.append(data)
        size += len(data)
    if parts:
        yield b"".join(parts)


def _contents(archives):
    for data in archives:
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])


def _write_files(contents: DataFrame, path: str, line_end: str) -> None:
    """One file for each row; the writer puts line_end after it. Bytes pass through it as they are."""
    contents.select(F.col("content").cast("string").alias("value")).write.option("lineSep", line_end).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def write_arcs(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = ARCHIVE_BYTES) -> None:
    """Pages as ARC files; tasks take turns with versions 1 and 2."""
    small_batches(pages.sparkSession)

    def over(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        version = "12"[part % 2]
        name = lambda number: f"pages-{part:06d}-{number:06d}.arc.gz"
        start = FIRST_DATE.strftime("%Y%m%d%H%M%S")

        def records():
            for batch in batches:
                for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    known = "" if i is None else f"{A.ID_HEADER}: {i}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                    date = (FIRST_DATE + timedelta(seconds=(i or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                    yield lambda offset, number: A.arc_record(version, name(number), offset, url, date, block)

        yield from _contents(_archive_files(records(), lambda number: A.arc_version_block(version, name(number), start), most))

    _write_files(pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(over, "content binary"), path, "\n")


def _digest_bit(digests) -> np.ndarray:
    return np.array([int(d[:15], 16) % DIGEST_BITS for d in digests], np.int64)


def _files(spark: SparkSession, path: str) -> DataFrame:
    small_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def arc_records(spark: SparkSession, path: str, least: int = LEAST_PAYLOAD, payloads: bool = True, copies=None) -> DataFrame:
    """The records of all ARC files under path, with digests. crowded: a longer record of the same file's payload stands for this one's.

    payloads: whether to take blocks along. copies: a broadcast bitmap of digests; `maybe` is whether the record's is in it.
    """

    def over(batches):
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, best = [], {}
                for r in A.read_arc(raw):
                    page = A.head_field(r.head, A.ID_HEADER)
                    page = int(page) if page and page.lstrip("-").isdigit() else None
                    digest = hashlib.sha1(r.payload).hexdigest()
                    order = (page is not None, page or 0, r.uri, r.place)
                    best[digest] = max(best.get(digest, order), order)
                    rows.append((order, r, page, digest))
                bits = _digest_bit([digest for *_, digest in rows])
                maybe = (copies.value[bits >> 3] >> (bits & 7) & 1).astype(bool).tolist() if copies is not None else [False] * len(rows)
                out, size = [], 0
                for (order, r, page, digest), m in zip(rows, maybe):
                    crowded = len(r.payload) >= least and best[digest] != order
                    out.append((file, r.place, A.record_id(file.rpartition("/")[2], r.place), r.uri, r.date, r.address, r.mime, r.kind, bool(r.named), page, r.head if payloads else None, r.payload if payloads and not crowded else None, len(r.payload), digest, crowded, m and len(r.payload) >= least))
                    size += len(r.payload) if payloads else 0
                    if size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
                yield _batch(out)

    return _files(spark, path).mapInArrow(over, RECORDS + ", maybe boolean")


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str = RECORDS + ", maybe boolean") -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, names)], names=[n for n, _ in names])


def repeated_payloads(records: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """key, first (identifier, uri and date of the response) of every payload of at least `least` bytes that several records have."""
    order = F.struct(F.col("page").isNotNull().alias("known"), "page", "uri", "file", "place", "identifier", "date")
    by = records.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max(order).alias("first"), F.count("*").alias("n"))
    return by.where("n > 1").select(F.concat_ws(":", "digest", "payload_bytes").alias("same"), F.col("first.identifier").alias("first_identifier"), F.col("first.uri").alias("first_uri"), F.col("first.date").alias("first_date"))


def _digest_bitmap(spark: SparkSession, keys: DataFrame):
    """The digests' bits, of bounded number, broadcast."""
    cell = F.conv(F.substring("same", 1, 15), 16, 10).cast("long") % DIGEST_BITS + 1
    blocks = keys.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    bits = np.zeros(DIGEST_BITS // 8, np.uint8)
    for row in blocks:  # bucket b holds the values from (b - 1) * 32768 + 1 on
        data = np.frombuffer(row.bits, np.uint8)
        at = (row.block - 1) * 4096
        bits[at : at + len(data)] = data[: max(0, len(bits) - at)]
    return spark.sparkContext.broadcast(bits)


def _write_warcs(records: DataFrame, path: str, most: int) -> None:
    """records with first_identifier, first_uri and first_date (null for those that refer to no other) as WARC files."""

    def over(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        date = FIRST_DATE.strftime("%Y-%m-%dT%H:%M:%SZ")

        def begin(number: int) -> bytes:
            name = f"pages-{part:06d}-{number:06d}.warc.gz"
            about = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
            return A.warc_record("warcinfo", A.record_id(path, part, number), date, about, "application/warc-fields", {"WARC-Filename": name})

        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        def record(r: dict) -> bytes:
            named = {"WARC-Target-URI": r["uri"], "WARC-Payload-Digest": A.sha1_label(r["digest"])}
            if r["address"] not in ("", "0.0.0.0"):
                named["WARC-IP-Address"] = r["address"]
            if r["truncated"]:
                named["WARC-Truncated"] = "length"
            kind, block = r["kind"], (r["head"] or b"")
            if r["first_identifier"] and r["first_identifier"] != r["identifier"]:
                kind = "revisit"
                named |= {"WARC-Profile": A.REVISIT_PROFILE, "WARC-Refers-To": r["first_identifier"], "WARC-Refers-To-Target-URI": r["first_uri"], "WARC-Refers-To-Date": r["first_date"]}
            else:
                block += r["payload"]
            return A.warc_record(kind, r["identifier"], r["date"], block, "application/http; msgtype=response" if r["head"] else r["mime"], named)

        def records():
            for r in rows():
                data = record(r)
                yield lambda offset, number: b"\r\n\r\n" + data

        yield from _contents(_archive_files(records(), begin, most))

    _write_files(records.mapInArrow(over, "content binary"), path, "\r\n\r\n")


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_PAYLOAD, most: int = ARCHIVE_BYTES) -> None:
    """The ARC files under arc_path as WARC files under warc_path (folders `single` and `shared`: records without copies, and those that may have some)."""
    keys = materialize(repeated_payloads(arc_records(spark, arc_path, least, payloads=False), least), "repeated-payloads")
    records = arc_records(spark, arc_path, least, copies=_digest_bitmap(spark, keys))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("first_identifier", "first_uri", "first_date")]
    _write_warcs(records.where("NOT maybe").select("*", *nothing), f"{warc_path}/single", most)
    shared = records.where("maybe").withColumn("same", F.concat_ws(":", "digest", "payload_bytes"))
    _write_warcs(shared.join(keys, "same", "left"), f"{warc_path}/shared", most)


INDEX = "identifier string, refers string, kind string, page long, payload_bytes long, digest string"


def read_archives(spark: SparkSession, warc_path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records under warc_path but warcinfo. A payload that has another digest
    than its record says raises ValueError."""

    def over(batches):
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                out = []
                for named, block in A.read_warc(raw):
                    if named["warc-type"] == "warcinfo":
                        continue
                    head, payload = A.split_block(block)
                    page = A.head_field(head, A.ID_HEADER)
                    digest, size = A.hex_of_label(named["warc-payload-digest"]), None
                    if named["warc-type"] != "revisit":
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{named['warc-record-id']}: payload and digest differ")
                    out.append((named["warc-record-id"], named.get("warc-refers-to"), named["warc-type"], int(page) if page and page.lstrip("-").isdigit() else None, size, digest))
                yield _batch(out, INDEX)

    index = materialize(_files(spark, warc_path).mapInArrow(over, INDEX), "warc-index")
    whole = index.where("kind <> 'revisit'")
    same = whole.select(F.col("identifier").alias("refers"), F.col("page").alias("first_page"), F.col("payload_bytes").alias("first_bytes"))
    rows = whole.select("page", "payload_bytes", "digest", "kind", F.lit(None).cast("long").alias("first_page"))
    revisits = index.where("kind = 'revisit'").join(same, "refers", "left").select("page", F.col("first_bytes").alias("payload_bytes"), "digest", "kind", "first_page")
    return rows.unionByName(revisits).toDF("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arcs(table(spark, sf_dir, "pages"), arcs)
    convert_archives(spark, arcs, warcs)
    return read_archives(spark, warcs)


_ORACLE = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY digest, n ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY digest, n) AS best FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n < 1000 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 1000 AND place > 1 THEN best END AS refers_to FROM o
"""
QUERIES = {"op11_warc": (op11_warc, _ORACLE)}
