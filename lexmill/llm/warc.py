"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: each task appends its records to an archive of its own in a shared folder and
tells where its runs of frames start and end; a file counts only once its task's rows are
committed, so a task that is repeated leaves at most a file nobody reads. Of pages with
equal payloads one is a response and the others revisit it; which one is found by
pre-aggregated, salted keys, so that a payload of a third of all pages meets in no task.

Reading: one task for each run. The dictionary is loaded from the head of the archive,
frames are cut by their block headers (so one that can't be decoded hides no other), and
each is decoded by itself to one record, whose version, headers, lengths and digests are
checked; what fails has an error code instead of being left out.

The folder may be on any file system that pyarrow.fs opens from its URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

ARCHIVE_BYTES = 1 << 30  #: an archive is closed at this size
RUN_BYTES = 32 << 20  #: frames that one task reads, about
SALTS = 64  #: parts of a group of equal payloads
#: The dictionary only helps to compress; it is learnt from the beginnings of about so many pages, twice as many at most.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8192, 64 << 10
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
FRAME, DICTIONARY_FRAME = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
_FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*:")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    """A url as a header value: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"


def _page(page_id: int | None, url: str | None, html: str, refers_to: int | None, date: str) -> bytes:
    payload = html.encode()
    own = digest(payload)
    name = lambda x: f"<urn:page:{'null' if x is None else x}:{own}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        return record([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))], http)
    return record(headers, http + payload)


_RUNS = "path string, start long, end long, records long"


def _write(folder: str, dictionary: bytes, date: str, archive_bytes: int, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = _open(folder)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        out, runs, n = None, [], 0

        def add(data: bytes) -> None:
            nonlocal at, records
            out.write(data)
            at += len(data)
            records += 1
            if at - runs[-1][1] >= run_bytes:
                runs[-1][2:] = [at, records]
                runs.append([runs[-1][0], at, None, None])
                records = 0

        def closed() -> pa.RecordBatch:
            out.close()
            if runs[-1][1] == at:
                runs.pop()
            else:
                runs[-1][2:] = [at, records]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in runs], t) for k, t in enumerate((pa.string(), *[pa.int64()] * 3))], names=[x.split()[0] for x in _RUNS.split(", ")])

        at = records = 0
        for batch in batches:
            for page in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                if out is not None and at >= archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{n}.warc.zst"
                    n += 1
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    head = DICTIONARY_FRAME + struct.pack("<I", len(dictionary)) + dictionary if dictionary else b""
                    out.write(head)
                    at, records, runs = len(head), 0, [[f"{folder}/{name}", len(head), None, None]]
                    add(pack.compress(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                add(pack.compress(_page(*(x.as_py() for x in page), date)))
        if out is not None:
            yield closed()

    return run


def dictionary_of(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from a bounded sample of pages; empty where they are too few or too short for one."""
    # a hash threshold, for a top-k would send its k of every partition to the driver
    share = SAMPLE_PAGES / max(1, pages.count())
    rows = pages.select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html")).where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))
    rows = rows.select("html").limit(2 * SAMPLE_PAGES)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [_page(0, "http://a.example/", r.html or "", None, DATE) for r in rows.collect()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, dictionary: bytes = b"", date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``pages(page_id, url, html, refers_to)`` as archives in ``folder`` -> their runs ``path, start, end, records``. Write the result: reading it twice writes twice."""
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), F.col("refers_to").cast("long"))
    return rows.mapInArrow(_write(folder, dictionary, date, archive_bytes, run_bytes), _RUNS)


class Frames:
    """The frames of an open archive, from byte ``start`` up to ``end``: (offset, bytes or None where the file ends within it)."""

    def __init__(self, file, start: int, end: int | None):
        self.file, self.at, self.end, self.held = file, start, end, b""
        file.seek(start)

    def _need(self, n: int) -> bool:
        while len(self.held) < n:
            more = self.file.read(max(1 << 20, n - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def _size(self) -> int | None:
        """Bytes of the frame that starts here, by its header and its blocks' headers; None where there is none."""
        if not self._need(8):
            return None
        magic = self.held[:4]
        if 0x50 <= magic[0] <= 0x5F and magic[1:] == b"\x2a\x4d\x18":
            return 8 + struct.unpack("<I", self.held[4:8])[0]
        if magic != FRAME:
            return None
        self._need(18)
        try:
            at = zstandard.frame_header_size(self.held[:18])
            checksum = zstandard.get_frame_parameters(self.held[:18]).has_checksum
        except zstandard.ZstdError:
            return None
        while self._need(at + 3):
            head = int.from_bytes(self.held[at : at + 3], "little")
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                return at + 4 * checksum
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes | None]]:
        while (self.end is None or self.at < self.end) and self._need(1):
            size = self._size()
            if size is None or not self._need(size):
                yield self.at, None
                return
            frame, self.held = self.held[:size], self.held[size:]
            yield self.at, frame
            self.at += size


def load_dictionary(file) -> zstandard.ZstdCompressionDict | None:
    """The dictionary in the skippable frame at the head of an archive, itself compressed or not; None if it starts otherwise."""
    for _, frame in Frames(file, 0, 1):
        if frame and frame[:4] == DICTIONARY_FRAME:
            data = frame[8:]
            return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data) if data[:4] == FRAME else data)
    return None


def _http(block: bytes) -> tuple[int, int | None] | None:
    """(bytes of the HTTP head, its Content-Length) of a block; None if it has no whole head."""
    end = block.find(b"\r\n\r\n")
    if end < 0 or not block.startswith(b"HTTP/"):
        return None
    m = re.search(rb"(?mi)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", block[:end])
    return end + 4, int(m[1]) if m else None


def parse(data: bytes) -> dict:
    """The record in a decoded frame: ``headers`` (names in lower case), ``payload``, ``payload_bytes``, ``payload_digest``, ``error``.

    Errors: bad_version, bad_header (a line without a field name, or no end of the headers),
    missing_header, bad_length (the block isn't as long as Content-Length says, or more
    follows than the two line ends), bad_http, bad_block_digest, bad_payload_digest.
    """
    out = {"headers": {}, "payload": None, "payload_bytes": None, "payload_digest": None, "error": None}

    def failed(error: str) -> dict:
        return {**out, "payload": None, "error": error}

    end = data.find(b"\r\n\r\n")
    first, *lines = re.sub(rb"\r\n[ \t]+", b" ", data[: max(end, 0)]).split(b"\r\n")
    if not data.startswith(VERSIONS):
        return failed("bad_version")
    if end < 0 or first not in VERSIONS or not all(_FIELD.match(x) for x in lines):
        return failed("bad_header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}
    out["headers"] = headers
    if any(not headers.get(k) for k in MANDATORY):
        return failed("missing_header")
    size, block, kind = headers["content-length"], data[end + 4 : -4], headers["warc-type"]
    if not re.fullmatch("[0-9]+", size) or int(size) != len(data) - end - 8 or data[-4:] != b"\r\n\r\n":
        return failed("bad_length")
    if headers.get("warc-block-digest", "").startswith("sha1:") and headers["warc-block-digest"][5:] != digest(block):
        return failed("bad_block_digest")
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        http = _http(block)
        if http is None:
            return failed("bad_http")
        head, length = http
        if kind == "revisit":  # the full payload's length and digest, as the head and the headers tell them
            return {**out, "payload_bytes": length, "payload_digest": told}
        out["payload"] = block[head:]
        if length is not None and length != len(block) - head:
            return failed("bad_http")
    elif kind != "revisit":
        out["payload"] = block
    if out["payload"] is None:
        return {**out, "payload_digest": told}
    own = digest(out["payload"])
    if told is not None and told != own:
        return failed("bad_payload_digest")
    return {**out, "payload_bytes": len(out["payload"]), "payload_digest": own}


_RECORDS = "path string, offset long, record_type string, headers map<string,string>, payload binary, payload_bytes long, payload_digest string, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])


def _read(payloads: bool, held_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                system, name = _open(path)
                rows, size = [], 0
                with system.open_input_file(name) as file:
                    unpack = zstandard.ZstdDecompressor(dict_data=load_dictionary(file))
                    for offset, frame in Frames(file, start, end):
                        if frame is not None and frame[:4] != FRAME:
                            continue  # a skippable frame
                        try:
                            data = None if frame is None else unpack.decompressobj().decompress(frame)
                        except zstandard.ZstdError:
                            data = None
                        r = {"headers": {}, "error": "bad_frame"} if data is None else parse(data)
                        size += len(data or b"") if payloads else 500
                        rows.append({**r, "path": path, "offset": offset, "record_type": r["headers"].get("warc-type"), "headers": list(r["headers"].items()), "payload": r.get("payload") if payloads else None})
                        if size >= held_bytes or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def read_archives(runs: DataFrame, payloads: bool = True) -> DataFrame:
    """``runs(path, start, end)`` -> one row for each record: ``path, offset, record_type, headers, payload, payload_bytes, payload_digest, error``.

    Archives of others are read by rows (path, 0, null). Errors are those of ``parse`` and
    bad_frame: a frame that can't be decoded; one that is cut off, or bytes that are no
    frame, end the run. A frame with more than one record has bad_length.
    """
    return runs.select("path", F.col("start").cast("long"), F.col("end").cast("long")).mapInArrow(_read(payloads), _RECORDS)


def archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole archives, each to be read by one task."""
    return spark.createDataFrame([(p, 0, None) for p in paths], "path string, start long, end long").repartition(max(1, len(paths)))


def revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``refers_to``: the largest page_id with an equal payload of at least ``least_bytes``, null for that page itself."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256)))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    parts = scratch.save(rows.where("same is not null").groupBy("same", "salt").agg(F.max("page_id").alias("target"), F.count("*").alias("n")))
    shared = parts.groupBy("same").agg(F.max("target").alias("target"), F.sum("n").alias("n")).where("n > 1").drop("n")
    targets = parts.select("same", "salt").join(shared, "same")
    out = rows.join(targets, ["same", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("target")), F.col("target"))
    return out.select("page_id", "url", "html", refers.alias("refers_to"))


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``page_id, payload_bytes, payload_digest, record_type, refers_to``, as read back from archives.

    Each row is a record with the html in UTF-8 as its payload. Of payloads that are equal
    and have ``least_bytes`` the one with the largest page_id is a response, the others
    revisit it; they hold no payload, but its length and digest. Smaller ones are responses.
    The archives stay in ``folder``; where none is given they go when they have been read.

    Edge cases: a null html is an empty payload. Rows that repeat the largest page_id of their
    group are responses all; a row without page_id revisits the group's largest one, or is
    a response where the group has none. A null url is ``about:blank``, control characters in
    urls are percent-encoded. Extra columns are ignored. An empty table gives an empty one.
    A record that fails its checks ends the query with its error.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    runs = scratch.save(write_archives(revisits(pages, scratch, least_bytes), folder or f"{scratch.root}/archives", dictionary_of(pages)))
    found = read_archives(runs.repartition(max(1, min(runs.facts["n"], 10_000))), payloads=False)
    found = found.where("error is not null or record_type in ('response', 'revisit')")
    name = lambda h: F.regexp_extract(F.col("headers")[h], "^<urn:page:(-?[0-9]+|null):", 1).try_cast("long")
    fine = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "path", "offset", "error")))
    out = scratch.save(found.select(name("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest", fine.alias("record_type"), name("warc-refers-to").alias("refers_to")))
    scratch.drop(runs)
    if folder is None:
        scratch.delete("archives")
    return out
