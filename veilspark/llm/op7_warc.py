"""WARC archives with a Zstandard dictionary, and their reader.

Each task writes archives of about ARCHIVE bytes of records: the first records of an archive train its dictionary, which stands
in a leading skippable frame; every record is a frame of its own, compressed with that dictionary. So any record can be read
alone once the first frame is known. Of equal payloads one record holds the payload, the others refer to it.

Archives go to the shared folder under names of their own, and a written manifest lists the ones whose task ended. The reader
takes those of the manifest only, so a lost or repeated task neither loses nor doubles a record. Equal payloads are found by
their SHA-256 (the SHA-1 of the header names them, but colliding pages are publicly known) in an aggregation of plain (id, digest)
rows with partial results; its verdict meets the rows by digest and salt, so a hot payload is spread over SALTS parts.

Defined results: null html is the empty payload, equal to other empty ones; of repeated rows with one id and payload each is written,
and all are responses if that id is the smallest; a null url has no target line; a null id stays null and is never referred to unless
all copies lack ids, which then are all responses; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content, each_salt, materialize, salt_of, salts_met, table, workspace

#: Bytes of records in an archive, of records that train its dictionary, and of the dictionary.
ARCHIVE, TRAINING, DICTIONARY = 24 << 20, 1 << 20, 32 << 10
#: The skippable frame that holds a dictionary.
MAGIC = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """One WARC record; refers_to: the id of the page whose payload this one repeats, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A dictionary built from the first records, then each record compressed by itself."""
    sample, size = [], 0
    for r in records:
        sample.append(r[: TRAINING // 8])
        size += len(sample[-1])
        if size >= TRAINING:
            break
    try:
        words = zstandard.train_dictionary(DICTIONARY, sample)
    except zstandard.ZstdError:  # too few records to train on
        words = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = words.as_bytes()
    press = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
    return struct.pack("<II", MAGIC, len(raw)) + raw + b"".join(map(press.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        end = _end(data, at)
        yield unpack.decompress(data[at:end])
        at = end


def _end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends: by its header and the sizes of its blocks."""
    head = zstandard.frame_header_size(data[at : at + 18])
    checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    at += head
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def parse(raw: bytes) -> dict:
    """page_id (as text), url, type, digest, refers_to (as text), payload and its full length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(lines["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    name = lambda x: x and (x[len("<urn:page:") : -1] or None)
    url = lines.get("WARC-Target-URI")
    found = {"page_id": name(lines["WARC-Record-ID"]), "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": lines["WARC-Type"], "payload_digest": lines["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": name(lines.get("WARC-Refers-To")), "payload_bytes": full, "payload": None}
    if found["record_type"] == "response":
        if len(payload) != full or digest(payload) != found["payload_digest"]:
            raise ValueError(f"record {found['page_id']}: the payload does not agree with its digest")
        found["payload"] = payload
    return found


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", size_limit: int = ARCHIVE) -> DataFrame:
    """Writes archives of about ``size_limit`` bytes of records below ``folder``, a URI that all executors reach; returns the manifest
    (path, records), written too."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), content(html_col).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256))).withColumn("salt", salt_of("page_id", "url"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"), salts_met(F.col("salt")).alias("met"))
    first = first.select("sha", "first", each_salt(F.col("met")).alias("salt"))
    refers = F.when((F.octet_length("html") >= least) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first"))
    dealt = rows.join(first, ["sha", "salt"]).select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(archive(records))
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64())})

        records, size = [], 0
        for batch in batches:
            for page_id, url, html, to in zip(*batch.columns):
                payload = html.as_py().encode("utf-8")
                records.append(record(page_id.as_py(), url.as_py(), payload, digest(payload), to.as_py()))
                size += len(records[-1])
                if size >= size_limit:
                    yield close(records)
                    records, size = [], 0
        if records:
            yield close(records)

    return materialize(dealt.mapInArrow(run, "path string, records bigint"), "manifest")


def read(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """The records of the archives of a manifest; kind: the type of page ids."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    data = f.read()
                rows, size = [], 0
                for raw in frames(data):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size >= 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    spread = manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    out = spread.mapInArrow(run, "page_id string, url string, record_type string, payload_digest string, refers_to string, payload_bytes bigint, payload binary")
    return out.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = read(write(pages, workspace(spark, "warc")), pages.schema["page_id"].dataType.simpleString())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS s FROM pages),
x AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first FROM p),
d AS (SELECT *, list_transform(range(0, 32), lambda i: CAST(('0x' || substr(s, 1 + 5 * (i // 4), 5)) AS BIGINT)) AS h FROM x)
SELECT page_id, octet_length(b) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((h[i + 1] // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
