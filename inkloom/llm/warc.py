"""Operator 8, WARC archives by way of a chunked record table.

A payload is streamed as rows of record identifier and chunk number; each chunk becomes one WARC record: the first a
``response``, the others ``continuation`` records of WARC's segmentation, so no record, and no row, is larger than a
chunk and its headers. A running SHA-1 goes along: each chunk carries the digest of the payload up to its end, which
the reader checks as it feeds the chunks, in order, to a running digest of its own. Of equal payloads from ``dup_bytes``
on, the one of the largest page_id is stored and the others are ``revisit`` records.

Spark's text writer and reader do the input and output, so archives can be in any store that Spark reaches: a record is
a row, CR LF CR LF ends it, and the version line separates the records that are read. Chunks are cut within each
``WARC/1.1`` that a payload holds, so that no payload looks like a version line.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.session import Scratch

VERSION = b"WARC/1.1"
DUP_BROADCAST = 500_000
SALTS = 16
FLUSH = 4 << 20


def cuts(payload, chunk: int) -> list[int]:
    """Ends of a payload's chunks: every ``chunk`` bytes, and within each version line's text."""
    inner = {m.start() + 4 for m in re.finditer(re.escape(VERSION), payload)}
    return sorted({*range(chunk, len(payload), chunk), *inner, len(payload)})


def _head(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def _urn(page, digest: str, segment: int) -> str:
    return f"<urn:x-inkloom:{'' if page is None else page}:{digest}:{segment}>"


def records(chunk: int, date: str):
    """WARC records of rows (page_id, url, html, payload_bytes, payload_digest, refers_to, copy)."""

    def write(batches):
        held, size = [_head([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", 28)]) + b"format: WARC File Format 1.1"], 0
        for batch in batches:
            names = batch.schema.names
            get = {n: batch.column(k) for k, n in enumerate(names)}
            for i in range(batch.num_rows):
                page, copy, digest, refers, n = (get[c][i].as_py() for c in ("page_id", "copy", "payload_digest", "refers_to", "payload_bytes"))
                url = get["url"][i].as_py()
                common = [("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")), ("X-Page-ID", page), ("X-Copy", copy), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", n)]
                if refers is not None:
                    held.append(_head([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page, digest, 1)), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers, digest, 1)), ("X-Refers-To-Page", refers), ("Content-Length", 0)]))
                    size += len(held[-1])
                else:
                    cell = get["html"][i]
                    payload = memoryview(cell.as_buffer()) if cell.is_valid else memoryview(b"")
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
                    ends, at, running = cuts(payload, chunk), 0, hashlib.sha1()
                    for k, end in enumerate(ends, 1):
                        block = (http if k == 1 else b"") + payload[at:end]
                        running.update(payload[at:end])
                        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", _urn(page, digest, k)), *common, ("Content-Type", "application/http;msgtype=response")]
                        if len(ends) > 1:
                            fields += [("WARC-Segment-Number", k), ("X-Prefix-Digest", f"sha1:{running.hexdigest()}")]
                            fields += [("WARC-Segment-Origin-ID", _urn(page, digest, 1))] if k > 1 else []
                            fields += [("WARC-Segment-Total-Length", len(http) + len(payload))] if k == len(ends) else []
                        held.append(_head([*fields, ("Content-Length", len(block))]) + block)
                        size, at = size + len(held[-1]), end
                        if size > FLUSH:
                            yield pa.record_batch({"record": pa.array(held, pa.binary())})
                            held, size = [], 0
        if held:
            yield pa.record_batch({"record": pa.array(held, pa.binary())})

    return write


def decide(pages: DataFrame, dup_bytes: int, scratch: Scratch) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (null for a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html")})
    again = pages.where(F.col("payload_bytes") >= dup_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = scratch.save(again, "again")
    if again.count() <= DUP_BROADCAST:
        joined = pages.join(F.broadcast(again), ["payload_digest", "payload_bytes"], "left")
    else:  # decided without payloads, a very common one in SALTS parts; payloads then go by page and digest
        salted = again.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        keys = pages.select(F.col("page_id").alias("p"), "payload_digest", "payload_bytes").withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int"))
        later = keys.join(salted, ["payload_digest", "payload_bytes", "salt"]).where(~F.col("p").eqNullSafe(F.col("keep")))
        later = later.select("p", F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "keep").distinct()
        joined = pages.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    refers = F.when((F.col("payload_bytes") >= dup_bytes) & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, chunk_bytes: int = 64 << 10, dup_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, html; other columns are not read) to archives in ``path``.

    A null html is an empty payload; a null url has no target; a null page_id is written without one, never larger than
    another. Repeated rows are repeated records. Rows that share the largest page_id of a payload are all responses. An
    empty table gives archives without pages. ``date`` goes into every record, so that a retried task writes the same.
    """
    ready = decide(pages, dup_bytes, Scratch(pages.sparkSession, "warc")).withColumn("copy", F.monotonically_increasing_id())
    rows = ready.mapInArrow(records(chunk_bytes, date), "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


CHUNK = "copy string, page_id long, record_type string, refers_to long, segment int, total_bytes long, payload_digest string, prefix_digest string, data binary"


def _parse(batches):
    for batch in batches:
        cols: dict[str, list] = {k.split()[0]: [] for k in CHUNK.split(", ")}
        for cell in batch.column(0):
            raw = memoryview(cell.as_buffer())
            if len(raw) == 0:
                continue
            end = re.search(rb"\r\n\r\n", raw).start()
            head = dict(line.split(": ", 1) for line in bytes(raw[:end]).decode().split("\r\n"))
            kind = head["WARC-Type"]
            if kind not in ("response", "revisit", "continuation"):
                continue
            block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
            if len(block) < int(head["Content-Length"]):
                raise ValueError(f"record {head['WARC-Record-ID']} holds a version line; only archives with chunks cut there can be split")
            data, digest, n = None, head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
            if kind == "response":
                block = block[re.search(rb"\r\n\r\n", block).end() :]
            if kind != "revisit" and "WARC-Segment-Number" in head:
                data = bytes(block)
            elif kind == "response":
                digest, n = hashlib.sha1(block).hexdigest(), len(block)
                if digest != head["WARC-Payload-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"record {head['WARC-Record-ID']} doesn't match its digest")
            for k, v in (
                ("copy", head["X-Copy"]), ("page_id", int(head["X-Page-ID"]) if "X-Page-ID" in head else None), ("record_type", kind), ("refers_to", int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None),
                ("segment", int(head.get("WARC-Segment-Number", 1))), ("total_bytes", n), ("payload_digest", digest), ("prefix_digest", head.get("X-Prefix-Digest", "").removeprefix("sha1:")), ("data", data),
            ):
                cols[k].append(v)
        kinds = {"copy": pa.string(), "page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "segment": pa.int32(), "total_bytes": pa.int64(), "payload_digest": pa.string(), "prefix_digest": pa.string(), "data": pa.binary()}
        yield pa.record_batch([pa.array(v, kinds[k]) for k, v in cols.items()], names=list(cols))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: a row for each record; data only where a payload has several chunks."""
    raw = spark.read.option("lineSep", VERSION.decode() + "\r\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(_parse, CHUNK)


def _digest(batches):
    """One row for each record, from its chunks in order; holds a running digest, never a payload."""
    now = None  # (copy, page_id, refers_to, running digest, bytes so far, announced bytes, announced digest)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def close(x):
        if x[4] != x[5] or x[3].hexdigest() != x[6]:
            raise ValueError(f"page {x[1]}: chunks are missing or damaged")
        return (x[1], x[4], x[3].hexdigest(), "response", x[2])

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is not None and r["copy"] != now[0]:
                out.append(close(now))
                now = None
            if r["data"] is None:
                out.append((r["page_id"], r["total_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
                continue
            if now is None:
                now = (r["copy"], r["page_id"], r["refers_to"], hashlib.sha1(), 0, r["total_bytes"], r["payload_digest"])
            now[3].update(r["data"])
            now = (*now[:4], now[4] + len(r["data"]), *now[5:])
            if now[3].hexdigest() != r["prefix_digest"]:
                raise ValueError(f"page {r['page_id']}: chunk {r['segment']} doesn't match its digest")
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)
    if now is not None:
        yield pa.record_batch([pa.array([v], k) for v, k in zip(close(now), kinds)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page in the archives of ``path``; bytes
    and digest of responses are of what was read, and an archive that doesn't match its digests is an error."""
    chunks = read_chunks(spark, path).repartition("copy").sortWithinPartitions("copy", "segment")
    return chunks.mapInArrow(_digest, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archive")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path)
