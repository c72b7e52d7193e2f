"""WARC archives compressed record by record with a shared Zstandard dictionary."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, store_of, texts_of

#: The skippable frame that carries a dictionary, as its first four bytes (little-endian).
DICTIONARY_MAGIC = 0x184D2A5D
#: Fixed value: the profile of a revisit record whose payload is equal to the one it refers to.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no block; it names the response, the payload's digest and length."""
    clean = (url or "").translate({13: "%0D", 10: "%0A"})
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    return "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    return fields, block


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary of the records; where they are too few to train one, their raw content serves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one at a time, with the dictionary its leading frame holds."""
    import zstandard

    magic, n = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary")
    dictionary = zstandard.ZstdCompressionDict(stream.read(n))
    decoder, rest = zstandard.ZstdDecompressor(dict_data=dictionary), b""
    frame, out = decoder.decompressobj(), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        out.append(frame.decompress(data))
        rest = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield read_record(b"".join(out))
            frame, out = decoder.decompressobj(), []
    if out and any(out):
        raise ValueError("the archive ends within a record")


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, scratch: Scratch, dictionary_size: int = 32_768, samples: int = 256, roll: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write a record for every row of pages(page_id, url, html) below `folder`; (path, records) of each archive.

    The first `samples` records of an archive make its dictionary. Archives roll over at `roll` bytes
    of payload. A task writes under a name of its own attempt and renames the finished file to a name
    that depends on its partition alone, so a lost or repeated task leaves no half or second archive.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("sha", F.sha1("html"))
    first = scratch.save(base.groupBy("sha").agg(F.min("page_id").alias("first")), "first")
    # rows without an id come after all others; without any id among them, each is a response
    revisit = F.coalesce((F.col("page_id") > F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    rows = base.join(first, "sha").select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        store, top = store_of(folder)
        store.create_dir(top, recursive=True)
        task, number, done = TaskContext.get(), 0, []
        held, size, n, out, packer, draft = [], 0, 0, None, None, ""

        def begin():
            nonlocal out, packer, draft, held
            dictionary = train_dictionary(held, dictionary_size)
            draft = f"{top}/.part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}"
            out = store.open_output_stream(draft, compression=None)
            out.write(dictionary_frame(dictionary))
            packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
            for x in held:
                out.write(packer.compress(x))
            held = []

        def end():
            nonlocal out, number, size, n
            if held:
                begin()
            if out is not None:
                out.close()
                final = f"{top}/part-{task.partitionId():06d}-{number:04d}.warc.zst"
                store.move(draft, final)
                done.append((final, n))
                out, number, size, n = None, number + 1, 0, 0

        for b in batches:
            for page, url, html, to, again in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), texts_of(b, "html"), b.column("refers_to").to_pylist(), b.column("revisit").to_pylist()):
                record = write_record(page, url, html, payload_digest(html), to, again)
                size, n = size + len(record), n + 1
                if out is None:
                    held.append(record)
                    if len(held) >= samples or size > roll // 8:
                        begin()
                else:
                    out.write(packer.compress(record))
                if size >= roll:
                    end()
        end()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return scratch.save(rows.mapInArrow(run, "path string, records long"), "written")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of archives(path).

    The digest of a response is taken anew from its payload, and must agree with the record's.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, _ = store_of(folder)
        number = lambda x: None if x in (None, "<urn:page:null>") else int(x[10:-1])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for f, block in read_archive(stream):
                        digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                        if kind == "response" and (payload_digest(block) != digest or len(block) != int(f["X-Payload-Length"])):
                            raise ValueError(f"{path}: payload and digest differ")
                        rows.append((number(f["WARC-Record-ID"]), int(f["X-Payload-Length"]), digest, kind, number(f.get("WARC-Refers-To"))))
                        if len(rows) == 10_000:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    return archives.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages as WARC archives in the shared folder and read them back; a row for every page.

    Of records with equal payloads, that with the smallest page_id is a response and the others revisit
    it; rows that repeat the smallest page_id are responses too. A null html is an empty payload; a
    page without an id comes after all ids, and is a response only if no page with an id has its
    payload. Null urls are written as empty; further columns are not read.
    """
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archives"
    written = write_archives(spark, pages, folder, scratch)
    n = max(1, written.count())
    return read_archives(written.repartition(min(n, 10_000)), folder)
