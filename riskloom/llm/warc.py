"""WARC archives: write captures as request, response or revisit, and metadata records; read them and assemble transactions.

Writing is Spark's text writer: a row is a record, and the line separator is the two line ends that close one. Files are gzip,
so a file is read by one task, as a stream of lines that the reader puts together by each record's Content-Length: a task holds
one record at a time, however long the archive. Reading needs no path that Python opens itself.

A capture's records name each other by WARC-Concurrent-To, in either direction and over one record in between; they are joined
by it into one nested row per capture. Of equal payloads of at least `least` bytes, the first page (smallest page_id, nulls
last, then url) is written as response and the others as revisits that refer to it. Rows equal in page_id, url and html are
captures of their own too: they are numbered, and the number stands in the ids of the second and later ones.

Nulls and odd input: a null html is an empty payload; a null url an empty target; a null page_id stays null. A record that can't be parsed is kept as a row of type `broken` with the reason and
ends the reading of its file's remainder only up to the next version line. Records without a capture make a row without
response. Empty tables and folders without files give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import checked_broadcast, numbered
from riskloom.session import cut_lineage, ensure_checkpoint_dir, ship_package

LEAST_BYTES = 100
FILE_RECORDS = 30_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("file string, type string, record_id string, target_uri string, date string, concurrent_to array<string>, "
          "refers_to string, payload_digest string, payload_bytes long, http_status string, fields map<string,string>, "
          "payload binary, problem string")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def captures(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, response_id, and first_id (the response that a revisit refers to)."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text.alias("payload")) \
        .withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)) \
        .withColumn("n_bytes", F.octet_length("payload").cast("long"))
    identity = [F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), F.col("digest")]
    rows = rows.withColumn("response_id", _uuid(F.lit("response"), *identity)).withColumn("copy_", F.lit(0).cast("long"))
    repeats = cut_lineage(rows.groupBy(F.col("response_id").alias("again")).agg(F.count("*").alias("rows")).where("rows > 1").select("again"))
    if repeats.limit(1).count():
        is_repeat = F.col("response_id") == F.col("again")
        copies = numbered(rows.drop("copy_").join(checked_broadcast(repeats), is_repeat, "left_semi"), "response_id")
        own_id = _uuid(F.lit("response"), *identity, F.col("copy_").cast("string"))
        copies = copies.withColumn("response_id", F.when(F.col("copy_") > 0, own_id).otherwise(F.col("response_id")))
        rows = rows.join(checked_broadcast(repeats), is_repeat, "left_anti").unionByName(copies)
    # Only digests that several captures share matter; they are few, and the payloads needn't move for them.
    first = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull(), "page_id", "url", "copy_", "response_id")).alias("f"),
        F.max("response_id").alias("high"), F.min("response_id").alias("low")) \
        .where("high != low").select("digest", F.col("f.response_id").alias("first_id"))
    joined = rows.join(checked_broadcast(cut_lineage(first)), "digest", "left")
    return joined.withColumn("first_id", F.when((F.col("n_bytes") >= least) & (F.col("first_id") != F.col("response_id")), F.col("first_id")))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it. A header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(END)) for name, value in
             [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *headers,
              ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit(VERSION + END), F.concat_ws("", *lines), F.lit(END), block)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, "[\r\n]", " ")


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """One row per record, as text."""
    c = captures(pages, least)
    revisit = F.col("first_id").isNotNull()
    uri = ("WARC-Target-URI", _one_line(F.col("url")))
    to = ("WARC-Concurrent-To", F.col("response_id"))
    request_block = F.concat(F.lit("GET "), _one_line(F.col("url")), F.lit(" HTTP/1.1" + END + END))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(END + END))
    request = _record(F.lit("request"), _uuid(F.lit("request"), F.col("response_id")),
                      [uri, to, ("Content-Type", F.lit("application/http; msgtype=request"))], request_block)
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("response_id"),
        [uri, ("WARC-Refers-To", F.col("first_id")), ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))))
    page = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit(""))
    metadata = _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("response_id")),
                       [uri, to, ("Content-Type", F.lit("application/warc-fields"))], page)
    return c.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    records(pages, least).write.option("lineSep", END + END).option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors see it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


class _Reader:
    """Puts the lines of one file together to records."""

    def __init__(self, file: str, with_payload: bool):
        self.file, self.with_payload = file, with_payload
        self.headers: list[bytes] | None = None
        self.need, self.block, self.size = -1, [], 0

    def line(self, line: bytes) -> dict | None:
        if self.need >= 0:
            self.block.append(line)
            self.size += len(line) + (2 if len(self.block) > 1 else 0)
            if self.size < self.need:
                return None
            return self._done()
        if self.headers is None:
            if line.startswith(b"WARC/"):
                self.headers = []
            elif line:
                return {"file": self.file, "type": "broken", "problem": "no version line"}
            return None
        if line:
            self.headers.append(line)
            return None
        length = self._header().get("content-length", "")
        if not length.isdigit():
            self.headers = None
            return {"file": self.file, "type": "broken", "problem": "no content length"}
        self.need, self.block, self.size = int(length), [], 0
        return None

    def end(self) -> dict | None:
        if self.headers is None:
            return None
        return {"file": self.file, "type": "broken", "problem": "the file ends inside a record"}

    def _pairs(self) -> list[tuple[str, str]]:
        out = []
        for line in self.headers or []:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out.append((name.strip().lower(), value.strip()))
        return out

    def _header(self) -> dict[str, str]:
        return dict(self._pairs())

    def _done(self) -> dict:
        pairs, head, block = self._pairs(), self._header(), b"\r\n".join(self.block)
        too_long = self.size > self.need
        self.headers, self.need, self.block = None, -1, []
        if too_long:
            return {"file": self.file, "type": "broken", "record_id": head.get("warc-record-id"), "problem": "longer than its content length"}
        out = {"file": self.file, "type": head.get("warc-type"), "record_id": head.get("warc-record-id"),
               "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
               "concurrent_to": [v for n, v in pairs if n == "warc-concurrent-to"], "refers_to": head.get("warc-refers-to")}
        payload, kind = block, head.get("content-type", "")
        if kind.startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            lines = top.split(b"\r\n")
            parts = lines[0].decode("latin-1").split(" ")
            fields = {n.strip().lower(): v.strip() for n, _, v in (x.decode("latin-1").partition(":") for x in lines[1:])}
            out |= {"http_status": parts[1] if parts[0].startswith("HTTP/") and len(parts) > 1 else None, "fields": fields}
        elif kind.startswith("application/warc-fields"):
            out["fields"] = {n.strip().lower(): v.strip() for n, _, v in
                             (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
        if out["type"] == "revisit":      # the payload is that of the record it refers to; its headers tell the size
            declared = out.get("fields", {}).get("content-length", "")
            out |= {"payload_bytes": int(declared) if declared.isdigit() else None,
                    "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2].lower() or None}
        else:
            out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
                    "payload": payload if self.with_payload else None}
        return out


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all gzip archives in a folder. Digests are computed from the payloads read."""
    ship_package(spark)
    lines = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    kinds = spark.createDataFrame([], RECORD).schema
    arrow = pa.schema([("file", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                       ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
                       ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("http_status", pa.string()),
                       ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, size = None, [], 0

        def taken() -> pa.RecordBatch:
            maps = [r | {"fields": list((r.get("fields") or {}).items())} for r in out]
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in maps], schema=arrow)

        for batch in batches:
            for file, line in zip(batch.column("file").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()):
                if reader is None or reader.file != file:
                    if reader is not None and (rest := reader.end()):
                        out.append(rest)
                    reader = _Reader(file, with_payload)
                if (record := reader.line(line)) is not None:
                    out.append(record)
                    size += len(record.get("payload") or b"")
                if len(out) >= 5000 or size > 16 << 20:
                    yield taken()
                    out, size = [], 0
        if reader is not None and (rest := reader.end()):
            out.append(rest)
        if out:
            yield taken()

    return lines.mapInArrow(run, kinds)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response, request, metadata (a list, by record id), and the capture that it revisits."""
    fields = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    named = records.where(F.col("record_id").isNotNull() & (F.col("type") != "broken") & (F.col("type") != "warcinfo")) \
        .withColumn("record", fields)
    main = F.col("type").isin("response", "revisit")
    others = named.where(~main)
    links = cut_lineage(named.select("record_id", main.alias("main"), F.explode("concurrent_to").alias("other")))
    mains = named.where(main).select(F.col("record_id").alias("other"))
    direct = links.where(~F.col("main")).join(mains.distinct(), "other", "left_semi") \
        .select(F.col("record_id").alias("member"), F.col("other").alias("capture")) \
        .union(links.where("main").select("other", "record_id")).distinct()
    direct = cut_lineage(direct)
    over_one = links.where(~F.col("main")).select("record_id", "other") \
        .union(links.where(~F.col("main")).select("other", "record_id")).toDF("member", "middle") \
        .join(direct.select(F.col("member").alias("middle"), "capture"), "middle").select("member", "capture") \
        .join(direct.select("member"), "member", "left_anti")
    placed = direct.union(over_one).groupBy("member").agg(F.min("capture").alias("capture"))
    rest = others.join(placed.withColumnRenamed("member", "record_id"), "record_id", "left") \
        .select(F.coalesce("capture", "record_id").alias("capture_id"), "type", "record")
    rows = named.where(main).select(F.col("record_id").alias("capture_id"), F.lit("main").alias("type"), "record").union(rest)

    kind = F.col("type")

    def first(wanted: Column) -> Column:
        return F.min_by(F.when(wanted, F.col("record")), F.when(wanted, F.col("record.record_id")))

    by_id = F.array_sort("metadata", lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))
    return rows.groupBy("capture_id").agg(
        first(kind == "main").alias("response"), first(kind == "request").alias("request"),
        F.collect_list(F.when(~kind.isin("main", "request"), F.col("record"))).alias("metadata")) \
        .withColumn("metadata", by_id)


def page_digests(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write the pages as archives, read these back, and tell per page what was read: the round trip of `op4`."""
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    write_archives(pages, path, least)
    read = cut_lineage(read_archives(spark, path, with_payload=False))     # narrow rows, so that the archives are read once
    found = assemble(read).where(F.col("response").isNotNull()).select(
        "capture_id", F.get(F.col("metadata"), F.lit(0))["fields"]["page_id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("first_id"))
    found = cut_lineage(found)
    wanted = found.where(F.col("first_id").isNotNull()).select(F.col("first_id").alias("capture_id")).distinct()
    first = found.select("capture_id", F.col("page_id").alias("refers_to")).join(wanted, "capture_id", "left_semi") \
        .withColumnRenamed("capture_id", "first_id")
    return found.join(first, "first_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
