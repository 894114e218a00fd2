"""Archives: round trips, what a record has to be, and damaged frames."""

import base64
import hashlib
import random
import struct
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from lexmill.llm import scratch, warc


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages, least_bytes=0):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        top = max(ids) if ids and len(data) >= least_bytes else i
        out.append((i, len(data), sha(data), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


def table(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", 5, "y") for i, u, h in pages], "page_id long, url string, html string, path string, n long, target string")


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["<p>", "été", "😀", "\r\n\r\n", "WARC/1.1", "the", "\x00", "Content-Length: 5\r\n", "(\xb5/\xfd"] + [f"w{i}" for i in range(40)]
    shared = [" ".join(r.choices(words, k=30)) for _ in range(5)] + ["", None]
    pages = [(k if k % 7 else -k, r.choice(["http://a.example/é x", None, "", "http://b/\r\nX: y"]), r.choice(shared) if r.random() < 0.6 else " ".join(r.choices(words, k=r.randrange(200)))) for k in range(1, n)]
    return pages + pages[:5] + [(None, "u", shared[0]), (None, "v", "alone without id"), (None, "w", "alone without id"), (9000, "long", "long text \n" * 200_000), (9001, "hot", None)] + [(10_000 + k, "hot", "hot payload") for k in range(400)]


@pytest.mark.parametrize("least_bytes", [0, 12])
def test_pages_come_back_as_they_went(spark, least_bytes):
    pages = corpus(1 + least_bytes)
    assert got(warc.archive_pages(table(spark, pages).repartition(4), least_bytes)) == brute(pages, least_bytes)


def test_few_or_no_pages(spark):
    assert got(warc.archive_pages(table(spark, []))) == []
    pages = [(1, None, None), (2, "u", "")]
    assert got(warc.archive_pages(table(spark, pages))) == brute(pages)


def test_archives_of_bounded_size_are_read_in_runs(spark, tmp_path):
    """Small bounds: several archives a task and several runs an archive; every record is read once, with its payload."""
    pages = corpus(3)
    own = scratch.Scratch(spark, "test")
    dictionary = warc.dictionary_of(table(spark, pages))
    assert dictionary[:4] == b"\x37\xa4\x30\xec"
    rows = warc.revisits(table(spark, pages), own).repartition(2)
    runs = own.save(warc.write_archives(rows, str(tmp_path), dictionary, archive_bytes=6000, run_bytes=1500))
    paths = sorted({r.path for r in runs.collect()})
    assert len(paths) > 4 and runs.count() > len(paths)
    read = warc.read_archives(runs).cache()
    assert read.where("error is not null").count() == 0
    assert runs.agg(F.sum("records")).first()[0] == read.count() == len(pages) + len(paths)
    want = {(r.page_id, (r.html or "").encode()) for r in rows.collect() if r.refers_to is None}
    assert {(None if (i := r.headers["warc-record-id"].split(":")[2]) == "null" else int(i), bytes(r.payload)) for r in read.where("record_type = 'response'").collect()} == want
    # each revisit's response is in the archives, with the same digest
    ids = {r.headers["warc-record-id"]: r.payload_digest for r in read.where("record_type = 'response'").collect()}
    assert all(ids[r.headers["warc-refers-to"]] == r.payload_digest for r in read.where("record_type = 'revisit'").collect())
    # the same by whole archives, without the runs
    assert sorted((r.path, r.offset) for r in warc.read_archives(warc.archives(spark, paths)).collect()) == sorted((r.path, r.offset) for r in read.collect())


def rec(headers=(), block=b"body", length=None, version="WARC/1.0", end=b"\r\n\r\n"):
    base = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block) if length is None else length), **dict(headers)}
    return (version + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in base.items() if v is not None) + "\r\n").encode() + block + end


HTTP = b"HTTP/1.1 200 OK\r\ncontent-length:  4 \r\n\r\nbody"
WEB = {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
CASES = [
    (rec(), None),
    (rec({"warc-payload-digest": "sha1:" + sha(b"body"), "WARC-Block-Digest": "sha1:" + sha(b"body")}), None),
    (rec(WEB, HTTP), None),
    (rec({**WEB, "WARC-Payload-Digest": "sha1:" + sha(b"body")}, HTTP), None),
    (rec({"X": "a: b"}), None),
    (rec({"X": "folded\r\n  over lines"}), None),
    (b"", "bad_version"),
    (rec(version="WARC/2.0"), "bad_version"),
    (rec(version="WARC/1.0x"), "bad_header"),
    (b"WARC/1.0\r\nWARC-Type: x\r\n", "bad_header"),
    (rec().replace(b"WARC-Date:", b"WARC-Date"), "bad_header"),
    (rec({"WARC-Record-ID": None}), "missing_header"),
    (rec({"WARC-Type": ""}), "missing_header"),
    (rec({"Content-Length": None}), "missing_header"),
    (rec(length=3), "bad_length"),
    (rec(length=5), "bad_length"),
    (rec({"Content-Length": "4x"}), "bad_length"),
    (rec(end=b"\r\n"), "bad_length"),
    (rec() + rec(), "bad_length"),
    (rec({"WARC-Block-Digest": "sha1:" + sha(b"other")}), "bad_block_digest"),
    (rec({"WARC-Payload-Digest": "sha1:" + sha(b"other")}), "bad_payload_digest"),
    (rec({**WEB, "WARC-Payload-Digest": "sha1:" + sha(HTTP)}, HTTP), "bad_payload_digest"),
    (rec(WEB, HTTP.replace(b"4", b"5")), "bad_http"),
    (rec(WEB, b"HTTP/1.1 200 OK\r\n"), "bad_http"),
]


@pytest.mark.parametrize("data, error", CASES)
def test_what_a_record_has_to_be(data, error):
    r = warc.parse(data)
    assert r["error"] == error
    if error is None:
        assert r["payload"] == b"body" and r["payload_digest"] == sha(b"body") and r["payload_bytes"] == 4


def test_foreign_archives_and_damage(spark, tmp_path):
    """Archives without a dictionary, with a compressed one, with skippable frames; a damaged frame is reported and hides no other."""
    samples = [rec({"WARC-Record-ID": f"<urn:x:{k}>"}, f"words of text {k} ".encode() * 30) for k in range(300)]
    trained = zstandard.train_dictionary(4096, samples)
    plain, packed = zstandard.ZstdCompressor(write_checksum=True), zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    skip = lambda data, kind=0x5D: bytes([kind]) + b"\x2a\x4d\x18" + struct.pack("<I", len(data)) + data
    compressed_dictionary = skip(zstandard.ZstdCompressor().compress(trained.as_bytes()))
    frames = [packed.compress(s) for s in samples]
    hurt = bytearray(frames[5])
    hurt[-3] ^= 1  # its checksum
    long = plain.compress(rec(block=random.Random(1).randbytes(700_000) + bytes(900_000)))  # raw and repeated blocks
    files = {
        "a": b"".join(plain.compress(s) for s in samples[:20]) + skip(b"any", 0x50) + long,
        "b": compressed_dictionary + b"".join(frames[:5] + [bytes(hurt)] + frames[6:20]),
        "c": skip(trained.as_bytes()) + b"".join(frames[:3]) + frames[3][:-10],
        "d": skip(trained.as_bytes()) + frames[0] + b"no frame at all",
        "e": b"".join(frames[:2]),  # the dictionary is missing
        "f": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_archives(warc.archives(spark, [f"file:{tmp_path}/{n}" for n in files])).collect()
    seen = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.path, r.offset)):
        seen[r.path[-1]].append(r.error)
    assert seen == {"a": [None] * 21, "b": [None] * 5 + ["bad_frame"] + [None] * 14, "c": [None] * 3 + ["bad_frame"], "d": [None, "bad_frame"], "e": ["bad_frame"] * 2}
    assert max(r.payload_bytes or 0 for r in rows) == 1_600_000


