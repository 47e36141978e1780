"""WARC archives: written from page rows, read back, and deduplicated by
revisit records.

An archive is a folder of gzip files that Spark's text sink commits, a
record a line: the record separator is the line separator. A file cannot
be split, so a task reads it from its start, cut at the version mark that
begins a record; Content-Length tells whether a piece is a whole record
or whether the mark stood inside a payload and the next piece belongs to
it. A task holds one record at a time.

Revisit resolution: only headers are shuffled, pre-aggregated by payload
digest and length. Where several responses have equal payloads of at
least ``min_bytes`` bytes, the one with the largest page id (ties: the
largest record id) stays, and the others become revisit records that
name it. The deduplicated archive has fresh headers: new record ids,
lengths and, for revisits, the reference, its date and its URI in place
of the payload. ``resolve`` joins revisits back to their responses.

A digest or response that more than a thousandth of all rows share is
hot; there are fewer than a thousand, so these alone are broadcast and
their rows join in place. All other keys are shuffled.

Defined cases: null html is an empty payload; a null page id is written
as none, read as null and smaller than any other; a null url gives no
target URI; line breaks in a url are written percent-encoded; payloads
may hold anything, record marks too; repeated rows are records of their
own; an empty table gives an empty archive; extra columns are ignored;
equal SHA-1 and length count as equal payloads.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from lodestar.llm.common import SLICE_ROWS, arrow_map, materialise
from lodestar.sources.files import scratch_path

# Marks, field names and the revisit profile of the format.
MARK = "WARC/1.1\r\n"
CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

# A key is hot from this share of the rows on, so hot keys are fewer.
HOT_SHARE = 1000
# Payload bytes handed on at once.
SLICE_BYTES = 4 << 20

_HEAD = [StructField("record_id", StringType()), StructField("type", StringType()), StructField("page_id", LongType()),
         StructField("uri", StringType()), StructField("date", StringType()), StructField("refers_to", StringType()),
         StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()),
         StructField("intact", BooleanType())]


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits become 8 digits at a time."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record(kind: Column, record_id: Column, fields: dict[str, Column], block: Column) -> Column:
    head = {"WARC-Type": kind, "WARC-Record-ID": F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">")), **fields,
            "Content-Type": F.lit("application/http; msgtype=response"), "Content-Length": F.octet_length(block)}
    return F.concat(F.lit(MARK), *[_field(n, v) for n, v in head.items()], F.lit(CRLF), block)


def _block(payload: Column | None, size: Column) -> Column:
    head = F.concat(F.lit(HTTP), _field("Content-Length", size), F.lit(CRLF))
    return head if payload is None else F.concat(head, payload)


def _save(records: DataFrame, path: str) -> str:
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").text(path)
    return path


def write(pages: DataFrame, path: str | None = None, date: str = "2025-01-01T00:00:00Z", seed: int = 1,
          page: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write a response record per row; the archive's folder."""
    payload = F.coalesce(F.col(html), F.lit(""))
    uri = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = {"WARC-Date": F.lit(date), "WARC-Target-URI": uri, "X-Page-Id": F.col(page).cast("long"),
              "WARC-Payload-Digest": F.concat(F.lit("sha1:"), digest(payload.cast("binary")))}
    record = _record(F.lit("response"), F.uuid(F.lit(seed)), fields, _block(payload, F.octet_length(payload)))
    return _save(pages.select(record.alias("value")), path or scratch_path(pages.sparkSession, "warc"))


def _whole_records(batches):
    """(file, header bytes, block bytes) of each record."""
    mark, end = MARK.encode(), SEPARATOR.encode()
    file, parts, size, total = None, [], 0, None
    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != file:
                if parts:
                    raise ValueError(f"record cut off at the end of {file}")
                if piece:
                    raise ValueError(f"{name} does not begin with a record")
                file = name
                continue
            if parts:
                parts += [mark, piece]
                size += len(mark) + len(piece)
            else:
                head = piece.find(end)
                lines = piece[:head].split(b"\r\n")
                length = next(int(x.split(b":", 1)[1]) for x in lines if x.lower().startswith(b"content-length:"))
                parts, size, total = [piece], len(piece), head + 2 * len(end) + length
            if size > total:
                raise ValueError(f"record of {file} longer than its Content-Length")
            if size == total:
                whole = b"".join(parts) if len(parts) > 1 else parts[0]
                yield whole[:head], whole[head + len(end):-len(end)]
                parts = []
    if parts:
        raise ValueError(f"record cut off at the end of {file}")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of a gzip archive: record_id, type, page_id, uri, date,
    refers_to (record id), payload_bytes, payload_digest and intact (it is
    the digest that the header states), and payload if asked for. The last
    ones come from the payload read; a revisit has none."""
    schema = StructType([*_HEAD, *([StructField("payload", BinaryType())] if payloads else [])])
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    end, most, rows = SEPARATOR.encode(), SLICE_BYTES, SLICE_ROWS

    def parsed(head, block):
        field = dict((k.strip().lower().decode(), v.strip().decode()) for k, v in (
            x.split(b":", 1) for x in head.split(b"\r\n") if b":" in x))
        bare = {k: field[k][10:-1] for k in ("warc-record-id", "warc-refers-to") if k in field}
        stated = field.get("warc-payload-digest", "").removeprefix("sha1:")
        payload = None
        if field.get("warc-type") == "response":
            payload = block[block.index(end) + len(end):]
        found = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return (bare.get("warc-record-id"), field.get("warc-type"), int(field["x-page-id"]) if "x-page-id" in field else None,
                field.get("warc-target-uri"), field.get("warc-date"), bare.get("warc-refers-to"),
                None if payload is None else len(payload), found, None if payload is None else found == stated, payload)

    def run(batches):
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

        for head, block in _whole_records(batches):
            held.append(parsed(head, block))
            size += len(block)
            if len(held) >= rows or size >= most:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    pieces = spark.read.schema("value string").option("lineSep", MARK).text(path)
    return arrow_map(pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")), run, schema)


def _joined(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows with a match in ``keyed`` (unique keys, ``n`` rows each)."""
    hot = F.col("n") * HOT_SHARE > total
    often, seldom = F.broadcast(keyed.where(hot)), keyed.where(~hot)
    rest = rows.join(F.broadcast(keyed.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(often, keys).unionByName(rest.join(seldom, keys)).drop("n")


def revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record_id, kept): the responses that become revisits, and the
    (page_id, record_id, uri, date) of the response that each repeats."""
    keys = ["payload_digest", "payload_bytes"]
    large = heads.where((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes)).select(
        *keys, "page_id", "record_id", "uri", "date")
    copies = materialise(large.groupBy(*keys).agg(
        F.max(F.struct("page_id", "record_id", "uri", "date")).alias("kept"), F.count(F.lit(1)).alias("n")).where(
        "n > 1"), "copies")
    return _joined(large.select(*keys, "record_id"), copies, keys, heads.count()).where(
        F.col("record_id") != F.col("kept.record_id")).select("record_id", "kept")


def _fresh(record_id: Column) -> Column:
    """The id that a record has in the archive written next."""
    hexes = F.md5(F.concat(F.lit("fresh "), record_id))
    return F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def deduplicate(spark: SparkSession, source: str, path: str | None = None, min_bytes: int = 0) -> str:
    """Write the archive anew: payloads that repeat become revisit
    records; the new archive's folder. Payloads are shuffled only where
    the list of revisits is too large for Spark to broadcast it."""
    heads = materialise(read(spark, source), "heads")
    gone = materialise(revisits(heads, min_bytes), "revisits")
    records = read(spark, source, payloads=True).select("record_id", "page_id", "uri", "date", "payload",
                                                        "payload_bytes", "payload_digest")
    rows = records.join(gone, "record_id", "left")
    again = F.col("kept").isNotNull()
    payload = F.when(~again, F.col("payload").cast("string")).otherwise(F.lit(""))
    fields = {"WARC-Date": F.col("date"), "WARC-Target-URI": F.col("uri"), "X-Page-Id": F.col("page_id"),
              "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("payload_digest")),
              "WARC-Profile": F.when(again, PROFILE),
              "WARC-Refers-To": F.concat(F.lit("<urn:uuid:"), _fresh(F.col("kept.record_id")), F.lit(">")),
              "WARC-Refers-To-Target-URI": F.col("kept.uri"), "WARC-Refers-To-Date": F.col("kept.date")}
    record = _record(F.when(again, "revisit").otherwise("response"), _fresh(F.col("record_id")), fields,
                     _block(payload, F.col("payload_bytes")))
    return _save(rows.select(record.alias("value")), path or scratch_path(spark, "warc"))


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type,
    refers_to): revisits get length and digest of the response that they
    name, and its page id."""
    heads = materialise(records.where(F.col("type").isin("response", "revisit")), "heads")
    named = heads.where("type = 'revisit'").select("page_id", "uri", F.col("refers_to").alias("record_id"))
    often = named.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    responses = heads.where("type = 'response'")
    targets = materialise(often.join(responses.select("record_id", "payload_bytes", "payload_digest", F.col(
        "page_id").alias("refers_to")), "record_id"), "targets")
    found = _joined(named, targets, ["record_id"], heads.count())
    columns = ["page_id", "uri", "payload_bytes", "payload_digest"]
    return responses.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias(
        "refers_to")).unionByName(found.select(*columns, F.lit("revisit").alias("record_type"), "refers_to"))
