"""WARC archives in Zstandard: one frame per record, the dictionary in front.

An archive file is a skippable frame (magic 0x184D2A5D) that holds the
dictionary, then one frame per record, each with its content size.  Archives
are real files in the folder given, written whole under another name and then
renamed, so a task that runs again leaves one good file.  They are read with
Spark's binary file source, which reaches every store Spark reaches.

A record is ``response`` with an HTTP message as its block, or ``revisit``
(identical payload digest) without a payload.  The reader checks magic
numbers, frame sizes, the WARC version, required headers, both digests and
both lengths, and fails on the first damaged record, naming file and place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Equal payloads from this many bytes on are stored once.
REVISIT_BYTES = 1000
#: A new archive file is begun after this many bytes of blocks.
ARCHIVE_BYTES = 16_000_000
#: The dictionary is trained on the archive's first records, up to this many bytes.
SAMPLE_BYTES = 400_000
DICTIONARY_BYTES = 16_384
LEVEL = 3
#: Compressed bytes that a frame's decoder is given at a time.
FEED_BYTES = 16_384

RECORD_TYPE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class DamagedArchive(ValueError):
    pass


def _digest(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def _page_uri(page: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"none" if page is None else b"%d" % page)


def _page_of(uri: bytes) -> int | None:
    if not uri.startswith(b"<urn:x-page:") or not uri.endswith(b">"):
        raise DamagedArchive(f"not a page record id: {uri!r}")
    name = uri[12:-1]
    return None if name == b"none" else int(name)


def build_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None,
                 revisit: bool, date: str) -> bytes:
    if revisit:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        block = http
    else:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        block = http + payload
    head = [(b"WARC-Type", b"revisit" if revisit else b"response"), (b"WARC-Record-ID", _page_uri(page)),
            (b"WARC-Date", date.encode())]
    if url is not None:
        # A header ends at a line break, so those are written as in URLs.
        head.append((b"WARC-Target-URI", url.strip().replace("\r", "%0D").replace("\n", "%0A").encode()))
    if revisit:
        head += [(b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", _page_uri(refers_to))]
    head += [(b"WARC-Payload-Digest", _digest(payload)), (b"WARC-Block-Digest", _digest(block)),
             (b"Content-Type", b"application/http; msgtype=response"),
             (b"Content-Length", b"%d" % len(block))]
    return (VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in head)
            + b"\r\n" + block + b"\r\n\r\n")


def parse_record(record: bytes) -> dict:
    """Checked fields of one record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise DamagedArchive(f"no WARC header: {version[:20]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise DamagedArchive(f"bad header line {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if name not in fields:
            raise DamagedArchive(f"header {name.decode()} is missing")
    size = int(fields[b"content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise DamagedArchive(f"the block is {len(rest) - 4} bytes, Content-Length says {size}")
    if fields.get(b"warc-block-digest", _digest(block)) != _digest(block):
        raise DamagedArchive("block digest differs")
    out = {"type": fields[b"warc-type"].decode(), "page": _page_of(fields[b"warc-record-id"]),
           "digest": fields.get(b"warc-payload-digest", b""), "payload": None, "refers_to": None}
    if out["type"] == "revisit":
        out["refers_to"] = _page_of(fields[b"warc-refers-to"])
    elif out["type"] == "response":
        http, gap, payload = block.partition(b"\r\n\r\n")
        said = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n")
                     if x.lower().startswith(b"content-length:")), len(payload))
        if not gap or said != len(payload):
            raise DamagedArchive(f"the payload is {len(payload)} bytes, HTTP says {said}")
        if out["digest"] != _digest(payload):
            raise DamagedArchive("payload digest differs")
        out["payload"] = payload
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; too few of them give an empty one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes]) -> bytes:
    sample, size = [], 0
    for record in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(record[:SAMPLE_BYTES // 8])
        size += len(sample[-1])
    dictionary = _dictionary(sample)
    used = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **used).compress
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *map(compress, records)])


def read_archive(content: bytes):
    """Each record's bytes, one frame at a time."""
    if len(content) < 8:
        raise DamagedArchive("no leading frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC or 8 + size > len(content):
        raise DamagedArchive("the leading frame holds no dictionary")
    dictionary = content[8:8 + size]
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):  # the format allows a compressed one
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    used = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    decoder = zstandard.ZstdDecompressor(**used)
    view, at = memoryview(content), 8 + size
    while at < len(content):
        if content[at:at + 4] != struct.pack("<I", FRAME_MAGIC):
            raise DamagedArchive(f"no frame at byte {at}")
        said = zstandard.get_frame_parameters(view[at:at + 18]).content_size
        frame = decoder.decompressobj()
        parts, end = [], at
        try:
            # Fed by parts: what lies behind a frame is copied, so the whole rest would be per record.
            while not frame.eof and end < len(content):
                parts.append(frame.decompress(view[end:end + FEED_BYTES]))
                end = min(end + FEED_BYTES, len(content))
        except zstandard.ZstdError as error:
            raise DamagedArchive(f"frame at byte {at}: {error}") from error
        record = b"".join(parts)
        if not frame.eof or len(record) != said:
            raise DamagedArchive(f"frame at byte {at} is cut off or not {said} bytes long")
        at = end - len(frame.unused_data)
        yield record


def plan_records(pages: DataFrame, threshold: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html`` plus ``revisit`` and ``refers_to``: of equal payloads of at
    least ``threshold`` bytes the largest page_id is kept, the others point to it."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    body = F.encode("html", "UTF-8")
    pages = pages.withColumn("digest", F.when(F.octet_length("html") >= threshold, F.sha1(body)))
    # Written, so that the join reads it as it is and a digest with many pages can be split.
    kept = materialize(pages.where("digest IS NOT NULL").groupBy("digest")
                       .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
                       .where("n > 1").drop("n"), "warc_keepers")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    # Small payloads have no digest, one key for all of them: they pass the join by.
    joined = (pages.where("digest IS NOT NULL").join(kept, "digest", "left")
              .unionByName(pages.where("digest IS NULL"), allowMissingColumns=True))
    return (joined
            .select("page_id", "url", "html", revisit.alias("revisit"),
                    F.when(revisit, F.col("keeper")).alias("refers_to")))


def store_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` as pyarrow names it: qualified by Spark's default file system, S3 under its own scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.toUri().getScheme() is None:
        path = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path)
    scheme, rest = path.toString().split(":", 1)
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``plan_records`` rows as archives below ``folder`` and returns
    ``(path, records)``; it is lazy, so run it once."""
    uri = store_uri(records.sparkSession, folder)

    def run(batches):
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)

        def flush(group):
            name = f"{root}/{uuid.uuid4().hex}"
            content = write_archive(group)
            with store.open_output_stream(f"{name}.part") as out:
                out.write(content)
            store.move(f"{name}.part", f"{name}.warc.zst")
            return {"path": f"{name}.warc.zst", "records": len(group)}

        done, group, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, revisit, refers_to = (c[i].as_py() for c in batch.columns)
                group.append(build_record(page, url, html.encode(), refers_to, revisit, date))
                size += len(group[-1])
                if size >= ARCHIVE_BYTES:
                    done.append(flush(group))
                    group, size = [], 0
        if group:
            done.append(flush(group))
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return records.select("page_id", "url", "html", "revisit", "refers_to").mapInArrow(run, "path string, records long")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of a ``(path, content)`` table, as the binary file source gives it.

    A revisit has the digest but not the size of its payload.
    """
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for path, content in zip(batch.column(names.index("path")), batch.column(names.index("content"))):
                rows = []
                for number, record in enumerate(read_archive(content.as_py())):
                    try:
                        found = parse_record(record)
                    except DamagedArchive as error:
                        raise DamagedArchive(f"{path}, record {number}: {error}") from error
                    payload = found["payload"]
                    row = {"page_id": found["page"], "payload_bytes": None if payload is None else len(payload),
                           "payload_digest": base64.b32decode(found["digest"][5:]).hex(),
                           "record_type": found["type"], "refers_to": found["refers_to"]}
                    rows.append(row | ({"payload": payload} if with_payload else {}))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())]
                       + [("payload", pa.binary())] * with_payload)
    return files.select("path", "content").mapInArrow(run, RECORD_TYPE + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page, reads the archives back, one row per page: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url gives no target, a null page_id
    is a record without a number (it is never the one that others refer to
    unless all of its equals have none).  Rows with an equal page_id are a
    record each; no rows give no archives.  Other columns are not read.
    """
    spark = pages.sparkSession
    written = materialize(write_archives(plan_records(pages), folder), "warc_index")
    if written.isEmpty():
        return spark.createDataFrame([], RECORD_TYPE)
    # The index names the archives of the tasks that counted: one that was run twice left others.
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
             .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    names = written.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    records = materialize(read_archives(files.join(names, "name", "left_semi")), "warc_records")
    sizes = (records.where("record_type = 'response'").groupBy(F.col("page_id").alias("to"), "payload_digest")
             .agg(F.max("payload_bytes").alias("size")))
    joined = records.alias("r").join(
        sizes.alias("s"), (F.col("r.refers_to") == F.col("s.to"))
        & (F.col("r.payload_digest") == F.col("s.payload_digest")), "left")
    return joined.select("r.page_id", F.coalesce("r.payload_bytes", "s.size").alias("payload_bytes"),
                         "r.payload_digest", "r.record_type", "r.refers_to")
