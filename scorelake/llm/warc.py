"""WARC archives compressed by Zstandard: one frame per record, with the dictionary in a leading skippable frame.

The writer streams the records of a Spark partition into archives and begins a new one at ARCHIVE_BYTES. An archive's
dictionary comes from its first records, a bounded sample, and is stored in a skippable frame with the magic number
0x184D2A5D, as the public draft for .warc.zst says. Every record is then a frame of its own. What the tasks that counted
have written is listed in a manifest beside the archives, so that leavings of lost attempts are never read.

The reader takes whole archives as binary files, loads the dictionary, finds each frame's end from its block headers,
decodes it alone, whether or not the frame tells its size, and checks version, mandatory headers, block length, record
end and SHA-1 digests. A broken record is returned with its `error`, and reading goes on at the next frame that is whole.

Defined cases: a null payload is empty; a null url or id leaves its header out or written as `null`; of rows with equal
payloads one with the largest page_id is the response and the rest, rows repeated with that page_id too, revisit it; null
ids never serve as the visited page, and if all ids of a payload are null its rows are all responses; an empty table gives
no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import fresh_path, stored

DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 32 << 10
#: Records and bytes of each that a dictionary is made from.
SAMPLE_RECORDS, SAMPLE_BYTES = 200, 8 << 10
#: Bytes of records that wait for the dictionary, compressed bytes of an archive, and bytes of a record that is read.
HEAD_BYTES, ARCHIVE_BYTES, MAX_RECORD = 16 << 20, 64 << 20, 1 << 30
MANIFEST = "_manifest"
#: Repeated payloads that are broadcast at most, about 100 bytes each.
FEW = 200_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    if not urn or not urn.startswith("<urn:page:") or urn == page_urn(None):
        return None
    return int(urn[10:-1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one WARC/1.1 record. A revisit keeps the HTTP headers, with the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packer_of(records: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressor]:
    """The leading frame of an archive that begins with records, and the compressor of its record frames."""
    trained = b""
    sample = [r[:SAMPLE_BYTES] for r in records[:: max(1, len(records) // SAMPLE_RECORDS)][:SAMPLE_RECORDS]]
    if len(sample) >= 16:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
        except zstandard.ZstdError:  # samples too small or too alike for a dictionary
            trained = b""
    packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}))
    return struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained, packer


def archive(records: list[bytes]) -> bytes:
    """A whole .warc.zst file."""
    head, packer = packer_of(records)
    return head + b"".join(map(packer.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its block headers."""
    seen = zstandard.get_frame_parameters(data[at : at + 32])
    end = at + zstandard.frame_header_size(data[at : at + 32])
    while True:
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3 or end + 3 > len(data):
            raise ValueError("broken block")
        end += 3 + (1 if kind == 1 else size)
        if last:
            break
    end += 4 if seen.has_checksum else 0
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def scan(data: bytes, most: int = MAX_RECORD) -> Iterator[tuple[bytes | None, str | None]]:
    """The decoded frames of an archive in order, each (bytes, None); (None, error) where a stretch of it is broken."""
    view, at, known = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        known, at = bytes(view[8 : 8 + size]), 8 + size
        if len(known) != size:
            yield None, "truncated dictionary"
            return
        if known.startswith(ZSTD_MAGIC):
            known = zstandard.ZstdDecompressor().stream_reader(known).read()
    unpacker = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(known)} if known else {}))

    def decoded(end: int) -> bytes:
        parts, size = [], 0
        with unpacker.stream_reader(view[at:end]) as source:
            while part := source.read(1 << 20):
                parts.append(part)
                size += len(part)
                if size > most:
                    raise ValueError(f"record of over {most} bytes")
        return b"".join(parts)

    lost = False
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else 0
        if 0x184D2A50 <= magic <= 0x184D2A5F and at + 8 <= len(data):  # other skippable frames hold no record
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = None
        try:
            end = frame_end(view, at)
            whole = decoded(end)
        except (ValueError, struct.error, zstandard.ZstdError) as broken:
            if not lost:
                yield None, str(broken)[:500]
            # the next frame begins where this one says it ends, or else at the next magic number that leads a whole frame
            lost = True
            told = end is not None and (end == len(data) or data[end : end + 4] == ZSTD_MAGIC or 0x184D2A50 <= int.from_bytes(data[end : end + 4], "little") <= 0x184D2A5F)
            at = end if told else data.find(ZSTD_MAGIC, at + 1)
            if at < 0:
                return
            lost = not told
            continue
        lost = False
        yield whole, None
        at = end


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive; ValueError where it is broken."""
    for whole, error in scan(data):
        if error is not None:
            raise ValueError(error)
        yield whole


MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parsed(raw: bytes) -> dict:
    """Headers and block of one record; ValueError if the record breaks a rule."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without colon: {line[:40]}")
        fields[name.strip().lower()] = value.strip()
    for name in MANDATORY:
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    block = rest[:length]
    if (told := fields.get("warc-block-digest", "").removeprefix("sha1:")) and told != sha1_base32(block):
        raise ValueError("wrong block digest")
    http, gap, body = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if not gap or sizes and sizes[0] != len(body):
            raise ValueError("wrong HTTP length")
        if digest and digest != sha1_base32(body):
            raise ValueError("wrong payload digest")
    elif fields["warc-type"] == "revisit" and not (digest and fields.get("warc-profile") and sizes):
        raise ValueError("revisit without digest, profile or length")
    return {"page_id": urn_page(fields["warc-record-id"]), "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"), "refers_to": urn_page(fields.get("warc-refers-to")), "payload_bytes": sizes[0] if sizes else len(body), "payload_digest": digest, "payload": body if fields["warc-type"] == "response" else None, "error": None}


RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()), ("archive", pa.string())])
RECORDS_SQL = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string, archive string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows, held, name = [], 0, path.as_py()
            for raw, error in scan(content.as_py()):
                try:
                    row = parsed(raw) if error is None else dict.fromkeys(RECORDS.names) | {"error": error}
                except ValueError as broken:
                    row = dict.fromkeys(RECORDS.names) | {"error": str(broken)[:500]}
                rows.append(row | {"archive": name})
                held += len(rows[-1]["payload"] or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORDS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives under folder: of those in its manifest, or of all where there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.Directory:
        listed = spark.read.parquet(f"{folder}/{MANIFEST}").select("archive")
        files = files.join(listed, F.element_at(F.split("path", "/"), -1) == F.col("archive"), "left_semi")
    return files.select("path", "content").mapInArrow(_read, RECORDS_SQL)


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for a in range(0, len(batch), 256):
                    for row in batch.slice(a, 256).to_pylist():
                        payload = row["payload"] or b""
                        yield record(row["page_id"], row["url"], payload, sha1_base32(payload), row["refers_to"], row["revisit"])

        source, number = records(), 0
        while first := _head(source):
            # the name holds the attempt: no attempt touches what another one wrote
            name = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
            count = 0
            head, packer = packer_of(first)
            with store.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(head)
                size = len(head)
                for one in itertools.chain(first, source):
                    frame = packer.compress(one)
                    out.write(frame)
                    size, count = size + len(frame), count + 1
                    if size >= archive_bytes and count >= len(first):
                        break
            store.move(f"{root}/.{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": count}])
            number += 1

    return write


def _head(source: Iterator[bytes]) -> list[bytes]:
    """The next records, up to SAMPLE_RECORDS of them or HEAD_BYTES."""
    out, size = [], 0
    while len(out) < SAMPLE_RECORDS and size < HEAD_BYTES and (one := next(source, None)) is not None:
        out.append(one)
        size += len(one)
    return out


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, page: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write pages as archives under folder; the number of records. Equal payloads of at least min_payload bytes are
    stored once, by the row with the largest id, and revisited by the others. Up to FEW repeated payloads are broadcast
    and the pages stay where they are; with more, both are dealt by digest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    # the response is the row with the largest id and, of those, url; times: how often that very row occurs
    each = rows.where(F.octet_length("payload") >= min_payload).groupBy("same", "page_id", "url").agg(F.count("*").alias("times"))
    tops = each.groupBy("same").agg(F.max(F.struct("page_id", "url", "times")).alias("top"), F.sum("times").alias("copies")).where("copies > 1 AND top.page_id IS NOT NULL")
    kept = stored(tops.select("same", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("top_url"), F.col("top.times").alias("times")), "repeated-payloads")
    is_top = (F.col("page_id") == F.col("refers_to")) & F.col("url").eqNullSafe(F.col("top_url"))
    joined = rows.join(F.broadcast(kept) if kept.count() <= FEW else kept, "same", "left")
    columns = ["page_id", "url", "payload", "refers_to"]
    rows = joined.select(*columns, (F.col("refers_to").isNotNull() & ~F.coalesce(is_top, F.lit(False))).alias("revisit"))
    repeated = kept.where("times > 1")
    if not repeated.isEmpty():
        # wholly equal responses: one row of them is the response, the others revisit it
        rest = joined.where(~F.coalesce(is_top & (F.col("times") > 1), F.lit(False))).select(*columns, (F.col("refers_to").isNotNull() & ~F.coalesce(is_top, F.lit(False))).alias("revisit"))
        one = joined.where(is_top & (F.col("times") > 1)).groupBy("page_id", "url", "refers_to", "same").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
        rows = rest.union(one.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).select(*columns, (F.col("k") > 1).alias("revisit")))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows.mapInArrow(_writer(folder, archive_bytes), "archive string, records long").write.parquet(f"{folder}/{MANIFEST}")
    return spark.read.schema("archive string, records long").parquet(f"{folder}/{MANIFEST}").agg(F.sum("records").alias("n")).first()["n"] or 0


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Digest columns of the records read back from archives of pages."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    write_archives(pages, folder)
    back = read_archives(spark, folder)
    broken = F.raise_error(F.concat(F.lit("broken WARC record: "), F.col("error")))
    return back.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("record_type")).cast("string").alias("record_type"), "refers_to")
