"""WARC archives with revisit records.

1. Headers (id, payload digest, payload length) are shuffled by digest; of equal payloads the
   smallest id keeps its response, every other record refers to it.
2. Records get fresh headers and are written by Spark's own writer: a WARC record ends with two
   line ends, which is the writer's row separator, so a file is a plain WARC file in gzip.
3. Archives are read back file by file, record by record, by content length; revisit records are
   joined to the responses they refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import scratch_path

#: Payloads below this length are always written whole.
LEAST_BYTES = 100
#: Records of one archive file at most.
RECORDS_PER_FILE = 2000
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest); a null payload is empty, a null url too."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))


def revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the records that repeat a payload.

    Copies are counted before the shuffle. Rows that repeat id and payload of a response stay responses.
    """
    headers = headers.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    originals = headers.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n"))
    originals = originals.filter((F.col("_n") > 1) & F.col("refers_to").isNotNull()).drop("_n")
    found = headers.join(originals, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "payload_digest", "refers_to").distinct()


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def records(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One text column with a whole WARC record, from rows with `refers_to` (null for a response)."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    fields = [
        (F.lit("WARC-Type"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        (F.lit("WARC-Record-ID"), _record_id(F.col("page_id"))),
        (F.lit("WARC-Date"), F.lit(date)),
        (F.lit("WARC-Target-URI"), F.regexp_replace("url", r"[\r\n]", "")),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        (F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
        (F.lit("Content-Length"), F.octet_length("block").cast("string")),
    ]
    extra = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(END))).otherwise(F.lit(""))
    head = F.concat(F.lit(f"WARC/1.1{END}"), *[F.concat(name, F.lit(": "), value, F.lit(END)) for name, value in fields], extra, F.lit(END))
    return rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, **columns: str) -> None:
    """Writes every page as a record of the gzip archives in `folder`; an empty table gives no record."""
    rows = payloads(pages, **columns)
    found = revisits(rows, least_bytes).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to")
    rows = rows.join(found, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_page", "_digest")
    writer = records(rows).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.text(folder)


def parse_records(stream):
    """(fields, block) of each record of an open, uncompressed archive; names of fields in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block


_READ = "record_id string, record_type string, refers_to_id string, url string, stated_digest string, payload_bytes long, payload_digest string, payload string"


def _read(keep_payload: bool):
    def run(batches):
        import gzip
        import hashlib
        import io

        import pyarrow as pa

        names = [x.split()[0] for x in _READ.split(", ")]
        types = [pa.int64() if x == "payload_bytes" else pa.string() for x in names]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)], names)

        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for fields, block in parse_records(stream):
                    kind = fields["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    known = (len(payload), hashlib.sha256(payload).hexdigest()) if payload is not None else (None, None)
                    text = payload.decode() if keep_payload and payload is not None else None
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-refers-to"), fields.get("warc-target-uri"), stated, *known, text))
                    size += len(block)
                    if size > 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    return run


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records of all archives in a folder, with length and digest of the payloads they hold."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = files.mapInArrow(_read(keep_payload), _READ)
    return rows if keep_payload else rows.drop("payload")


def resolve(found: DataFrame) -> DataFrame:
    """Every record, with length and digest of its full payload; a revisit takes them from its original."""
    originals = found.filter(F.col("record_type") == "response").groupBy("record_id", "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    again = found.filter(F.col("record_type") == "revisit").select("record_id", "record_type", "refers_to_id", "stated_digest").alias("again")
    joined = again.join(originals.alias("original"), (F.col("again.refers_to_id") == F.col("original.record_id")) & (F.col("stated_digest") == F.col("payload_digest")))
    columns = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"]
    joined = joined.select("again.record_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id")
    return found.filter(F.col("record_type") == "response").select(columns).unionByName(joined)


def _page_of(record: str) -> Column:
    return F.regexp_extract(record, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES, **columns: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from fresh archives."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "archives")
    write_archives(pages, folder, least_bytes, **columns)
    rows = resolve(read_archives(spark, folder))
    return rows.select(_page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_of("refers_to_id").alias("refers_to"))
