"""Legacy web archives: ARC files are read by their declared lengths and rewritten as equivalent WARC files.

An ARC file begins with a version block that says which fields a record's header line has; versions 1 and 2 differ
in these fields, and records are parsed by the block's own definition. Each record becomes a WARC record: its
identifier is derived from the place and digest of the ARC record (the same on every run), the 14-digit date becomes
an ISO timestamp, the type follows from the record's scheme, and block and payload get digests. A payload of at
least ``least_revisit`` bytes that other records repeat is stored once; the others revisit it.

Files are written by Spark's text writer with a record separator of the format's own, one file per task, gzipped,
and read back with Spark's binary reader, so they can be in any store that Spark reaches. A task holds one file.

Defined cases: null html is an empty payload, null or spaced URLs are written as ``-`` or percent-encoded; pages
without an id get no page field and never win a tie against an id; repeated pages are records of their own; of
equal payloads with one page id, the record that stands last by file and offset is the response; an empty table
gives files without records and an empty result; further columns are not looked at.
"""

import base64
import gzip
import hashlib
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm.common import settled, small_side
from wardstone.session import checkpoint_dir

#: Header fields of the two ARC versions, and the profile that marks a revisit (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_RECORD = (
    "file string, offset long, url string, ip string, date string, mime string, block binary, head long, "
    "page_id long, payload_bytes long, digest string, record_id string"
)
WARC_RECORD = (
    "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, "
    "payload_digest string, refers_to_id string, intact boolean"
)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"


def _headed(batches, head: bytes):
    """The file's first record before a task's records."""
    yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary())], ["value"])
    for batch in batches:
        yield batch.cast(pa.schema([("value", pa.binary())]))


def _write(records: DataFrame, path: str, head: bytes, separator: str) -> None:
    files = records.select("value").mapInArrow(partial(_headed, head=head), "value binary")
    fast = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}  # packing is most of the work of writing
    files.select(F.col("value").cast("string")).write.option("lineSep", separator).options(**fast).text(path)


def _field(value: Column) -> Column:
    """A header value without spaces: they and control characters are percent-encoded; null or empty is ``-``."""
    clean = F.regexp_replace(F.regexp_replace(value, " ", "%20"), r"[\x00-\x1F\x7F]", "%00")
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit("-"))


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20200101000000") -> None:
    """ARC files of ``page_id, url, html``: HTTP responses with the html as UTF-8 body."""
    body = F.coalesce(F.col("html"), F.lit(""))
    page = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), page, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body
    )
    values = {"URL": _field(F.col("url")), "IP-address": F.lit("0.0.0.0"), "Archive-date": F.lit(date), "Content-type": F.lit("text/html"), "Result-code": F.lit("200")}
    values |= {"Archive-length": F.octet_length("_block").cast("string")}
    header = F.concat_ws(" ", *[values.get(name, F.lit("-")) for name in ARC_FIELDS[version].split()])
    records = pages.select("url", block.alias("_block")).select(F.concat(header, F.lit("\n"), "_block").alias("value"))
    info = f"{version} 0 archive\n{ARC_FIELDS[version]}\n"
    first = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(info))}
    line = " ".join(first.get(name, "-") for name in ARC_FIELDS[version].split())
    _write(records, path, f"{line}\n{info}".encode(), "\n")


def _unzipped(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_records(data: bytes):
    """(offset, header fields, block) of the records of an ARC file, the version block left out."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    info = data[end + 1 : end + 1 + length]
    names = info.split(b"\n")[1].decode().split()
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        if len(values) != len(names):  # a URL with spaces in it
            values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
        fields = dict(zip(names, values, strict=True))
        stop = end + 1 + int(fields["Archive-length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield at, fields, data[end + 1 : stop]
        at = stop


def http_parts(block: bytes) -> tuple[int, dict[str, str]]:
    """Length of the HTTP head with its empty line, and its fields in lower case; 0 without a head."""
    if not block.startswith(b"HTTP/"):
        return 0, {}
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return len(block), {}
    lines = block[:end].decode("latin-1").split("\r\n")[1:]
    return end + 4, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _whole(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _columns(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [r[f.name] for r in rows] for f in schema}, schema=schema)


def _batched(rows, schema: pa.Schema, most: int = 8 << 20):
    """Record batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("block") or b"")
        if size > most:
            yield _columns(held, schema)
            held, size = [], 0
    yield _columns(held, schema)


ARC_SCHEMA = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("block", pa.binary()), ("head", pa.int64()),
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_id", pa.string()),
])
WARC_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("intact", pa.bool_()),
])


def _files(batches):
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield path.as_py(), _unzipped(content.as_py())


def _parse_arc(batches):
    def rows():
        for path, data in _files(batches):
            name = path.rsplit("/", 1)[-1]
            for offset, fields, block in arc_records(data):
                head, http = http_parts(block)
                payload = memoryview(block)[head:]
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                page = _whole(http.get("x-page-id"))
                seed = f"{name}@{offset} {fields['URL']} {fields['Archive-date']} {digest}"
                yield {
                    "file": name, "offset": offset, "url": fields["URL"], "ip": fields["IP-address"], "date": fields["Archive-date"], "mime": fields["Content-type"], "block": block,
                    "head": head, "page_id": page, "payload_bytes": len(payload), "digest": digest, "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}",
                }

    yield from _batched(rows(), ARC_SCHEMA)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files in a folder, with payload digest and the identifier of the WARC record to be."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse_arc, ARC_RECORD)


def _iso(date: Column) -> Column:
    """ISO timestamp of a date of up to 14 digits; missing digits are the least that they can be."""
    full = F.concat(F.substring(date, 1, 14), F.substring(F.lit("00000101000000"), F.length(F.substring(date, 1, 14)) + 1, F.lit(14)))
    return F.regexp_replace(full, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def revisits(records: DataFrame, least: int) -> DataFrame:
    """``record_id`` of each repeated payload's later copies and what it refers to: a narrow table, no payloads.

    The response of a digest is found by aggregation, so a digest shared by a third of the pages is no hot group.
    """
    narrow = settled(records.select("record_id", "digest", "payload_bytes", F.coalesce("page_id", F.lit(-(1 << 62))).alias("_page"), "file", "offset", "url", "date").filter(F.col("payload_bytes") >= least))
    best = narrow.groupBy("digest").agg(F.count("*").alias("_n"), F.max(F.struct("_page", "file", "offset", "record_id", "url", "date")).alias("to")).filter("_n > 1")
    best = settled(best.select("digest", "to"))
    joined = narrow.select("record_id", "digest").join(small_side(best.select("digest", F.col("to.record_id").alias("to_id"), F.col("to.url").alias("to_url"), F.col("to.date").alias("to_date"))), "digest")
    return settled(joined.filter("record_id != to_id").select("record_id", "to_id", "to_url", "to_date"))


def convert(arc: DataFrame, path: str, least_revisit: int = 1000) -> None:
    """WARC files equivalent to the ARC records of ``read_arc``.

    Revisits are looked up by record id: payloads stay where they are while the table of revisits is small,
    and move once, by a key without repetitions, where it isn't.
    """
    known = arc.join(small_side(revisits(arc.drop("block"), least_revisit)), "record_id", "left")
    again, is_http = F.col("to_id").isNotNull(), F.col("head") > 0
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    given = lambda name, value: F.when(value.isNotNull() & (value != "-"), line(name, value)).otherwise(F.lit(""))
    block = F.when(again, F.substring(F.col("block"), F.lit(1), F.col("head").cast("int"))).otherwise(F.col("block"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").when(is_http, "response").otherwise("resource")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", _iso(F.col("date"))),
        given("WARC-Target-URI", F.col("url")),
        given("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("_block", 256))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), F.coalesce("to_id", F.lit("")), F.lit(">"))), given("WARC-Refers-To-Target-URI", F.col("to_url")), line("WARC-Refers-To-Date", F.coalesce(_iso(F.col("to_date")), F.lit(""))))).otherwise(F.lit("")),
        line("Content-Type", F.when(is_http, "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    records = known.withColumn("_block", block).select(F.concat(header.cast("binary"), F.col("_block")).alias("value"))
    info = b"software: legacy archive converter\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, path)
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
    _write(records, path, head + info, "\r\n\r\n")


def warc_records(data: bytes):
    """(header fields in lower case, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(fields["content-length"])
        yield fields, data[end + 4 : stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        at = stop + 4


def _parse_warc(batches):
    def rows():
        for _, data in _files(batches):
            for fields, block in warc_records(data):
                if fields["warc-type"] == "warcinfo":
                    continue
                head, http = http_parts(block)
                stated = fields["warc-payload-digest"].partition(":")[2]
                payload = memoryview(block)[head:]
                again = fields["warc-type"] == "revisit"
                yield {
                    "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"), "date": fields["warc-date"], "page_id": _whole(http.get("x-page-id")),
                    "payload_bytes": int(http["content-length"]) if again else len(payload), "payload_digest": base64.b32decode(stated).hex(), "refers_to_id": fields["warc-refers-to"].strip("<>") if again else None,
                    "intact": again or base64.b32encode(hashlib.sha1(payload).digest()).decode() == stated,
                }

    yield from _batched(rows(), WARC_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in a folder; ``intact`` says that a stored payload has its stated digest."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse_warc, WARC_RECORD)


def archived_pages(pages: DataFrame, version: int = 1, least_revisit: int = 1000) -> DataFrame:
    """Pages through ARC and WARC files and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    arc, warc = archive_folder(spark), archive_folder(spark)
    write_arc(pages, arc, version)
    convert(read_arc(spark, arc), warc, least_revisit)
    back = settled(read_warc(spark, warc))
    ids = back.filter("record_type != 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    named = back.filter("record_type = 'revisit'").join(ids, "refers_to_id")
    rest = back.filter("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return named.unionByName(rest, allowMissingColumns=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
