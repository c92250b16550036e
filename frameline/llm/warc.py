"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive starts with a skippable frame that holds a dictionary built from the archive's own records, followed by
one Zstandard frame for each record. Of the rows with equal payloads of ``revisit_from`` bytes or more, that with the
largest id is the response and the others are revisits that name it; smaller payloads are always responses.

Tasks write archives of about ``archive_bytes`` to the shared folder through Arrow's file systems under names of their
own, and list them in a manifest that Spark commits; what a lost or repeated task left behind is not in the manifest
and is not read. Archives are read back with Spark's binary file reader.

Edge cases: a null payload is the empty payload; equal rows with the same largest id are all responses; null ids and
urls are kept as null; a url that is no URI is escaped in the target and kept whole in a header of its own; records of under 1,000 bytes in all give an archive without a dictionary; a payload of any size is one record;
other columns, of any name, play no part; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPABLE = 0x184D2A5D  # magic number of the frame that holds the dictionary
URI_MARKS = ":/?#[]@!$&'()*+,;=~-._"  # what a URI may hold besides letters, digits and escapes
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def classify_records(pages: DataFrame, key: str, url: str, payload: str, revisit_from: int) -> DataFrame:
    """Adds digest, size, record type and the response that a revisit refers to; revisits lose their payload.

    Only digests that occur more than once are joined back, so that pages need no shuffle while those are few; if they
    are many, Spark joins by digest and splits a digest that holds many pages.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest")
    )
    again = (
        rows.filter(F.col("payload_bytes") >= revisit_from)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(again, "payload_digest", "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )


def target_uri(url: str) -> str:
    """``url`` as a URI: its escapes stay as they are, and what no URI may hold is escaped."""
    return re.sub("%(?![0-9A-Fa-f]{2})", "%25", quote(url, safe=URI_MARKS + "%"))


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC 1.1 record."""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {target_uri(row['url'])}")
        if target_uri(row["url"]) != row["url"]:
            head.append(f"X-Source-URL: {quote(row['url'], safe=URI_MARKS)}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {row['payload_bytes']}"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        payload = row["payload"].encode("utf-8")
        block = HTTP % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the records' own bytes: pieces of equal size at equal distances, so records of any size take part. None below 1,000 bytes."""
    total = sum(map(len, records))
    if total < 1000:
        return None
    piece = max(64, min(2048, total // 16))
    step = piece * max(1, -(-total // sample_bytes))
    samples, skip = [], 0
    for r in records:
        samples += [r[at : at + piece] for at in range(skip, len(r), step)]
        skip = (skip - len(r)) % step
    size = max(256, min(dictionary_bytes, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=level)
    except zstandard.ZstdError:  # nothing repeats in the samples: they are the dictionary as they are
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def build_archive(records: list[bytes], level: int = 3, dictionary_bytes: int = 32 << 10, sample_bytes: int = 1 << 20) -> bytes:
    """The dictionary is built from pieces spread over the archive, of ``sample_bytes`` in all; every record is written."""
    dictionary, out = build_dictionary(records, dictionary_bytes, sample_bytes, level), []
    if dictionary is not None:
        dictionary.precompute_compress(level=level)
        body = dictionary.as_bytes()
        out = [struct.pack("<II", SKIPPABLE, len(body)), body]
    pack = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True).compress
    out += [pack(r) for r in records]
    return b"".join(out)


def parse_archive(body: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    view, dictionary = memoryview(body), None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size]))
        view = view[8 + size :]
    with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(view, read_across_frames=True) as reader:
        raw = reader.read()
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, raw[start:stop]
        at = stop + 4


def write_archives(records: DataFrame, folder: str, date: str = "2025-01-01T00:00:00Z", archive_bytes: int = 64 << 20) -> None:
    """Writes ``folder/archives/*.warc.zst`` and the manifest ``folder/manifest`` of those that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{root}/archives", recursive=True)

        def put(part: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{root}/archives/.{name}.part") as f:
                f.write(body := build_archive(part))
            files.move(f"{root}/archives/.{name}.part", f"{root}/archives/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([len(part)], pa.int64()), "n_bytes": pa.array([len(body)], pa.int64())})

        part, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                part.append(record_bytes(batch.slice(k, 1).to_pylist()[0], date))
                size += len(part[-1])
                if size >= archive_bytes:
                    yield put(part)
                    part, size = [], 0
        if part:
            yield put(part)

    records.mapInArrow(run, "archive string, n_records long, n_bytes long").write.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives in the manifest. Sizes and digests of responses are taken from what is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda x: int(x[len("<urn:page:") : -1] or -1) if x else None
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for head, block in parse_archive(body.as_py()):
                    kind, payload = head["WARC-Type"], None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        size, digest = int(head["X-Payload-Length"]), base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    own = head["WARC-Record-ID"]
                    rows.append((path.rsplit("/", 1)[-1], None if own == "<urn:page:>" else page(own), unquote(head["X-Source-URL"]) if "X-Source-URL" in head else head.get("WARC-Target-URI"), size, digest, kind, page(head.get("WARC-Refers-To")), payload if with_payload else None))
                names = ["archive", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: 8 if with_payload else 7], names=names[: 8 if with_payload else 7])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/archives").select("path", "content")
    rows = files.mapInArrow(run, "archive string, " + RECORD_SCHEMA + (", payload binary" if with_payload else ""))
    counted = spark.read.schema("archive string").parquet(f"{folder}/manifest")
    return rows.join(counted, "archive", "left_semi")


def archive_pages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 1000) -> DataFrame:
    """Writes all pages to archives in ``folder`` and reads them back."""
    write_archives(classify_records(pages, key, url, payload, revisit_from), folder)
    spark = pages.sparkSession
    if spark.read.schema("archive string").parquet(f"{folder}/manifest").isEmpty():
        return spark.createDataFrame([], "archive string, " + RECORD_SCHEMA)
    return read_archives(spark, folder)
