"""Web archives: writing records, reading them back and assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, stored

#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 1000
#: Bytes of a file's records before compression, about (one capture may have more): a file is one row when it is read.
FILE_BYTES = 64 << 20
#: Payloads fall into classes by size, each class of up to so many times the bytes of the one before; a class has its own files.
GROWTH = 8
END = "\r\n"

RECORD = "type string, record_id string, concurrent_to string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def urn(kind: str, content: str = "content", copy: str | Column = "copy") -> Column:
    """A record's id, from what its page is alone and the number of the copy, so that it is the same whenever it is computed."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col(content), F.col(copy) if isinstance(copy, str) else copy))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text; a header whose value is null is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)) for name, value in headers]
    return F.concat(F.lit(f"WARC/1.1{END}WARC-Type: "), kind, F.lit(END), F.concat_ws("", *lines), F.lit("Content-Length: "),
                    F.octet_length(block).cast("string"), F.lit(END * 2), block, F.lit(END * 2))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row (page_id, url, html), as gzip files.

    Of rows with equal payloads of ``least`` bytes or more, those with the largest page_id are responses and the others
    revisits of one of them, without payload. Payload owners are found on digests alone, stored and joined back, so that
    a payload that very many pages share is a join that Spark can split. A null html is an empty payload, a null url an
    empty URI. A row with a null page_id revisits if another row of its payload has an id, else it is a response.
    Repeated rows are captures of their own; an empty table gives an empty folder of archives. Files are bounded by
    bytes: each class of payload sizes has as many captures a file as its largest allow. A file is one gzip member,
    since Spark's writer makes it; readers that want a member a record have to compress it anew.
    """
    p = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    p = p.withColumn("content", F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "sha1", F.md5("url"))))
    size_class = F.greatest(F.floor(F.log(float(GROWTH), F.greatest("bytes", F.lit(1)) / 65536.0)) + 1, F.lit(0)).cast("int")
    digests = stored(p.select("page_id", "sha1", "bytes", "content", size_class.alias("class")), "digests")
    owners = digests.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "content"))).alias("o"), F.count("*").alias("same"))
    owners = stored(owners.where("same > 1 and o is not null").select("sha1", "bytes", F.col("o.page_id").alias("owner"), F.col("o.content").alias("owner_content")), "owners")
    repeated = stored(digests.groupBy("content").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    classes = sorted(r["class"] for r in digests.select("class").distinct().collect())
    for k in classes or [0]:
        largest = 65536 * GROWTH**k + 4096
        write_class(numbered(p.where(size_class == k), repeated), owners, f"{path}/{k}", max(1, file_bytes // largest))


def numbered(p: DataFrame, repeated: DataFrame) -> DataFrame:
    """Pages with the number of their copy. Rows that are equal in all are one row until the shuffle is over."""
    once = p.join(repeated, "content", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    if repeated.isEmpty():
        return once
    rest = [c for c in p.columns if c != "content"]
    more = p.join(repeated, "content").groupBy("content").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in rest])
    return once.unionByName(more.select(*p.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))


def write_class(p: DataFrame, owners: DataFrame, path: str, captures_per_file: int) -> None:
    p = p.join(owners, ["sha1", "bytes"], "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    p = p.withColumn("owner", F.when(revisit, F.col("owner")))
    date = ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    uri, page = ("WARC-Target-URI", F.col("url")), ("X-Page-Id", F.col("page_id"))
    main, host = urn("response"), F.regexp_extract("url", r"^[^:/]+://([^/]*)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    captured = record(F.when(F.col("owner").isNull(), "response").otherwise("revisit"), [
        ("WARC-Record-ID", main), date, uri, page, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        ("WARC-Profile", F.when(F.col("owner").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(F.col("owner").isNotNull(), urn("response", "owner_content", F.lit(0)))), ("X-Refers-To-Page", F.col("owner")), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(F.col("owner").isNull(), F.concat(http, "html")).otherwise(http))
    request = record("request", [("WARC-Record-ID", urn("request")), date, uri, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))],
                     F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2)))
    metadata = record("metadata", [("WARC-Record-ID", urn("metadata")), date, uri, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
                      F.concat(F.lit("payload-length: "), F.col("bytes").cast("string"), F.lit(END)))
    # the text writer ends each row with the record's last newline
    lines = p.select(F.explode(F.array(request, captured, metadata)).alias("value")).select(F.expr("substr(value, 1, length(value) - 1)").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of one file, by their lengths."""
    data = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := data.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, data.read(int(headers["content-length"]))


def parsed(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, size, payload = headers["warc-type"], None, None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    elif kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode("utf-8").split(END) if ": " in line)
        size = int(fields["payload-length"]) if "payload-length" in fields else None
    return (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), int(headers["x-page-id"]) if "x-page-id" in headers else None, headers.get("warc-target-uri"), size, digest,
            int(headers["x-refers-to-page"]) if "x-refers-to-page" in headers else None, payload if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record. A file is one row to Spark, so its size is bounded where it is written; records stream out of it."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                rows: list[tuple] = []
                for headers, block in records_of(b.column(0)[i].as_py()):
                    rows.append(parsed(headers, block, with_payload))
                    if len(rows) >= 512:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(mapped, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, capture, request, metadata (an array).

    Records meet under the id of their response or revisit: its own, or the one they are concurrent to. A capture may
    lack a request or metadata; records that are concurrent to none that is there give no row; an empty table gives none.
    """
    fields = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    is_main = F.col("type").isin("response", "revisit")
    return records.groupBy(F.when(is_main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("record_id")).agg(
        F.first(F.when(is_main, fields), ignorenulls=True).alias("capture"), F.first(F.when(F.col("type") == "request", fields), ignorenulls=True).alias("request"),
        F.collect_list(F.when(F.col("type") == "metadata", fields)).alias("metadata")).where("capture is not null")


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
