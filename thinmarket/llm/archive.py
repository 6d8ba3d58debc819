"""WARC archives of scraped pages, records compressed one by one with a dictionary of their own file."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinmarket.session import checkpoint_root, ensure_checkpoint_dir

#: Fixed value of the format: the magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
FILE_BYTES, DICTIONARY_BYTES = 64 << 20, 64 << 10
READ_BYTES, BATCH_ROWS = 16 << 10, 10_000
COLUMNS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, is_revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP head only."""
    own = digest(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}/{own}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if is_revisit else payload)
    head = {
        "WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Payload-Digest": f"sha1:{own}",
        "Content-Type": "application/http; msgtype=response", "Page-ID": None if page_id is None else quote(page_id, safe=""),
    }
    if is_revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to), "Refers-To-Page-ID": None if refers_to is None else quote(refers_to, safe="")}
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[str | None, int, str, str, str | None]:
    """The row of a record; length and digest of a response are taken from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rsplit(b": ", 1)[1])
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != own):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page_id, refers_to = (None if fields.get(k) is None else unquote(fields[k]) for k in ("Page-ID", "Refers-To-Page-ID"))
    return page_id, size, own, fields["WARC-Type"], refers_to


def archive_bytes(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """The file: the dictionary of all its records in a leading skippable frame, then a frame per record."""
    import zstandard as z

    try:
        trained = z.train_dictionary(dictionary_bytes, records)
    except z.ZstdError:  # too few or too small to train on: their own bytes serve as content
        trained = z.ZstdCompressionDict(b"".join(records)[-dictionary_bytes:] or b"WARC/1.1", dict_type=z.DICT_TYPE_RAWCONTENT)
    packed = z.ZstdCompressor().compress(trained.as_bytes())
    write = z.ZstdCompressor(dict_data=trained, write_content_size=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed + b"".join(map(write.compress, records))


def archive_records(source: BinaryIO) -> Iterator[bytes]:
    """The records of an open file in order. Only the record at hand is in memory, and each byte is read once."""
    import zstandard as z

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    content = z.ZstdDecompressor().decompress(source.read(size))
    kind = z.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else z.DICT_TYPE_RAWCONTENT
    read, waiting = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(content, dict_type=kind)), source.read(READ_BYTES)
    while waiting:
        one, parts = read.decompressobj(), []
        while not one.eof:
            if not waiting:
                raise ValueError("the last record is cut off")
            parts.append(one.decompress(waiting))
            waiting = one.unused_data if one.eof else source.read(READ_BYTES)
        yield b"".join(parts)
        waiting = waiting or source.read(READ_BYTES)


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, size, made = TaskContext.get(), [], 0, 0
        store, base = _open(folder)

        def close():
            nonlocal waiting, size, made
            path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(path) as out:
                out.write(archive_bytes(waiting))
            told = pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([len(waiting)], pa.int64())], ["file", "n"])
            waiting, size, made = [], 0, made + 1
            return told

        for batch in batches:
            for page_id, url, payload, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append(record(page_id, url, payload, refers_to, is_revisit))
                size += len(waiting[-1])
                if size >= file_bytes:
                    yield close()
        if waiting:
            yield close()

    return run


def _reader(folder: str):
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}") as f:
                    records = map(parsed, archive_records(f))
                    while some := list(islice(records, BATCH_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64() if k == 1 else pa.string()) for k, r in enumerate(zip(*some))], names)

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages as WARC files; returns (file, n), the files that count.

    Of pages with equal payloads of at least ``revisit_from`` bytes the smallest id is a response, the
    others are revisits that name it; rows repeated with that id are responses too. The payload is the
    html in UTF-8. A file is what one task has gathered up to ``file_bytes``, and its dictionary is
    built from all of its records, so any file can be read alone. Files of lost or repeated attempts
    lie beside the others but are not in the list. The list is stored, so nothing is written twice.

    Null html is an empty payload. Ids are percent-encoded in the heads. A null id never is the smallest unless there is no other. Null urls
    have no target. Empty tables write nothing. ``folder`` must be shared by driver and executors.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    equal = F.when(F.octet_length("payload") >= revisit_from, F.unhex(F.sha1("payload")))
    rows = rows.withColumn("digest", equal)
    first = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    told = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    ready = told.select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(again, F.col("first").cast("string")).alias("refers_to"), again.alias("again"))
    return ready.mapInArrow(_writer(folder, file_bytes), "file string, n long").checkpoint()


def read_archives(files: DataFrame, folder: str, page_id_type: str = "long") -> DataFrame:
    """One row per record of the listed files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The list is far too small for the engine to split by its size, so the number of tasks is stated: one
    per file, up to four per core. Null file names are left out.
    """
    names = files.select("file").filter("file IS NOT NULL")
    tasks = min(names.count(), 4 * names.sparkSession.sparkContext.defaultParallelism)
    rows = names.repartitionByRange(max(tasks, 1), "file").mapInArrow(_reader(folder), COLUMNS)
    return rows.withColumn("page_id", F.col("page_id").cast(page_id_type)).withColumn("refers_to", F.col("refers_to").cast(page_id_type))


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the pages, by default below the session's shared folder, and reads the archives back."""
    folder = folder or f"{checkpoint_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[options.get("page_id", "page_id")].dataType.simpleString()
    return read_archives(write_archives(pages, folder, **options), folder, kind)
