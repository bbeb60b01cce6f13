"""WARC archives of captures: writing them, reading them back, and assembling each capture's transaction.

A capture is a request, a response (or a revisit of an equal payload) and a metadata
record that names the other through WARC-Concurrent-To. Archives are written by
Spark's text writer, one record a row, so they land in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, shared_dir, stored

#: Captures and, about, bytes of payload per archive file, which bound what a reading task holds.
CAPTURES_PER_ARCHIVE, ARCHIVE_BYTES = 2_000, 64 << 20
#: Payloads are archived by size: class k holds those up to 8^k times the size of which so many fit, the last class all larger ones, one a file.
CLASSES = 5
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_sha1(hexed: Column) -> Column:
    """The 32 base-32 digits of a SHA-1 given as 40 hexadecimal ones: every five of these make four of those."""
    group = lambda k: F.conv(F.substring(hexed, 1 + 5 * (k // 4), 5), 16, 10).cast("int")
    digit = lambda k: F.shiftright(group(k), 15 - 5 * (k % 4)).bitwiseAND(F.lit(31)) + 1
    letters = F.array(*[F.lit(x) for x in BASE32])
    return F.concat(*[F.element_at(letters, digit(k)) for k in range(32)])


def _urn(kind: str) -> Column:
    """A record id that depends on the row alone, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("nonce"), F.col("sha256"), F.col("url")))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, own: Column, fields: list[Column], mime: str, *block: Column) -> Column:
    """A record, its block in parts, without its last newline, which the text writer adds."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Date: "), F.col("date")]
    uri = F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("uri")), F.lit(""))
    size = sum((F.octet_length(part) for part in block[1:]), F.octet_length(block[0])).cast("string")
    return F.concat(*head, uri, *fields, F.lit(f"\r\nContent-Type: {mime}\r\nContent-Length: "), size, F.lit("\r\n\r\n"), *block, F.lit("\r\n\r"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """A request, a response or revisit, and a metadata record for every input row, gzipped under path.

    Of rows with equal payloads of least_bytes or more, the one with the smallest id
    (null last, then first read) is the response; the others are revisits that refer to it.
    Null payloads are empty. A page's id and url stand in its metadata record; line ends
    in urls become spaces. Rows are numbered and stored first, so that a task that runs
    again numbers none anew; a file holds captures of one size class, so that many
    small ones or a few large ones make an archive.
    """
    nul, spark = F.lit(""), pages.sparkSession
    rows = pages.select(
        F.monotonically_increasing_id().alias("nonce"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), nul).alias("payload")
    )
    raw, fitting = F.col("payload").cast("binary"), ARCHIVE_BYTES // CAPTURES_PER_ARCHIVE
    size = reduce(lambda out, k: F.when(F.octet_length("payload") <= fitting * 8**k, k).otherwise(out), range(CLASSES - 2, -1, -1), F.lit(CLASSES - 1))
    rows = rows.withColumns({"sha256": F.sha2(raw, 256), "sha1": base32_of_sha1(F.sha1(raw)), "bytes": F.octet_length("payload"), "size_class": size})
    numbered = f"{shared_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.partitionBy("size_class").parquet(numbered)
    rows = spark.read.schema(rows.schema).parquet(numbered)
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "nonce", "url")
    lean = rows.where(F.col("bytes") >= least_bytes).select("sha256", order.alias("own"))
    firsts = lean.groupBy("sha256").agg(F.count("*").alias("n"), F.min("own").alias("first")).where("n > 1").drop("n")
    again = lean.join(firsts, "sha256").where("own.nonce <> first.nonce").select(F.col("own.nonce").alias("nonce"), F.col("first.nonce").alias("first_nonce"), F.col("first.url").alias("first_url"))
    # a table of known size: small ones are broadcast by Spark's own threshold, others joined by sorting
    rows = rows.join(stored(again), "nonce", "left").withColumns({"date": F.lit(date), "uri": F.regexp_replace("url", r"[\r\n]", " ")})
    own, revisits = _urn("response"), F.col("first_nonce").isNotNull()
    first = F.struct(F.col("first_nonce").alias("nonce"), F.col("first_url").alias("url"))
    refers = F.md5(F.concat_ws("|", F.lit("response"), first["nonce"], F.col("sha256"), first["url"]))
    refers = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(refers, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"))
    concurrent = F.concat(F.lit("\r\nWARC-Concurrent-To: "), own)
    line = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    profile = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), refers)
    get = F.concat(F.lit("GET "), F.coalesce("uri", nul), F.lit(" HTTP/1.1\r\n\r\n"))
    about = F.concat(F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), nul), F.lit("via: table\r\n"))
    http = "application/http; msgtype="
    main = F.when(revisits, _record("revisit", own, [digest, profile], http + "response", line)).otherwise(_record("response", own, [digest], http + "response", line, F.col("payload")))
    three = F.array(_record("request", _urn("request"), [concurrent], http + "request", get), main, _record("metadata", _urn("metadata"), [concurrent], "application/warc-fields", about))
    for k in sorted(r.size_class for r in rows.select("size_class").distinct().collect()) or [0]:
        out = rows.where(F.col("size_class") == k).select(F.explode(three).alias("value")).write.mode("append").option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        out.option("maxRecordsPerFile", 3 * max(1, CAPTURES_PER_ARCHIVE // 8**k if k < CLASSES - 1 else 1)).text(path)


RECORD = "archive string, record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, payload_digest string, payload_bytes long, computed_digest string, fields map<string,string>, payload binary"


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(lower-cased header fields, block) of each record of an open archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no record starts with {line[:40]!r}")
            continue
        head: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        length = int(head["content-length"][0])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("an archive ends inside a record")
        yield head, block


def read_archives(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """Every record of the archives under path (plain or gzipped): RECORD; payloads are null unless keep_payload.

    A task holds archives of spark.sql.execution.arrow.maxBytesPerBatch bytes, or one,
    and the records of one. A record that is cut off or has no header raises.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                rows = []
                for head, block in parse_records(stream):
                    one = lambda k, h=head: h.get(k, [None])[0]
                    fields: dict[str, str] = {}
                    payload, size = block, None
                    if (one("content-type") or "").startswith("application/http"):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in top.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                        if one("warc-type") == "revisit":
                            size = int(fields.get("Content-Length", 0))
                    elif one("warc-type") == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
                    digest = (one("warc-payload-digest") or "").partition(":")[2] or None
                    computed = base64.b32encode(hashlib.sha1(payload).digest()).decode() if one("warc-type") == "response" else None
                    rows.append((path, one("warc-record-id"), one("warc-type"), head.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), digest, len(payload) if size is None else size, computed, fields, payload if keep_payload else None))
                yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in RECORD.replace("<string,string>", "").split(",")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (array, by record id), refers_to.

    The capture is a response or revisit record. Others join it through the ids they
    are concurrent to, at once or by way of another record (metadata of a request);
    records whose ids lead to no capture drop out. Of several requests the one with the
    smallest id is taken. request and metadata are null for captures without other records.
    """
    kept = [c for c in records.columns if c not in ("concurrent_to", "type")]
    body = F.struct("type", *kept)
    main = records.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), body.alias("main"))
    links = records.where("type NOT IN ('response', 'revisit')").select(F.explode("concurrent_to").alias("target"), body.alias("other"))
    hops = links.select(F.col("other.record_id").alias("target"), F.col("target").alias("next"))
    further = links.join(hops, "target").select(F.col("next").alias("target"), "other")
    tied = links.unionByName(further).groupBy(F.col("target").alias("capture_id")).agg(
        F.min_by("other", F.when(F.col("other.type") == "request", F.col("other.record_id"))).alias("request"),
        F.array_sort(F.collect_set(F.when(F.col("other.type") == "metadata", F.struct("other.record_id", "other.uri", F.to_json("other.fields").alias("fields"))))).alias("metadata"),
    )
    out = main.join(tied, "capture_id", "left")
    return out.select("capture_id", F.col("main").alias("response"), "request", "metadata", F.col("main.refers_to").alias("refers_to"))


def captures_of(pages: DataFrame, path: str, **columns) -> DataFrame:
    """pages written as archives under path, read back and assembled: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    write_archives(pages, path, **columns)
    found = assemble(stored(read_archives(pages.sparkSession, path, keep_payload=False).drop("payload")))
    page = F.get_json_object(F.get("metadata", F.lit(0))["fields"], "$.page_id").cast("long")
    flat = durable(found.select("capture_id", page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.payload_bytes").alias("payload_bytes"), F.coalesce("response.computed_digest", "response.payload_digest").alias("payload_digest"), "refers_to"))
    cited = flat.where("refers_to IS NOT NULL").select("capture_id", "refers_to").join(
        flat.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first_page")), "refers_to"
    )
    told = flat.drop("refers_to").join(cited.select("capture_id", "first_page"), "capture_id", "left")
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first_page").alias("refers_to"))
