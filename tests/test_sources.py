"""Scanning, arrays cut by ranges, hidden and broken files: against plain readers of whole files."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lexmill.sources import arrays, raw, scan

GOOD = {"record_id": "r", "dataset_id": "d", "event_date": None, "record_type": "article", "title": None, "raw_text": "t", "category_signal": "c", "source_batch": "b", "synthetic": True}


def sha(data):
    return "sha256:" + hashlib.sha256(data).hexdigest()


def test_scan_of_hidden_large_and_unreadable_files(spark, tmp_path):
    root = tmp_path / "in"
    for folder in ("a/.hidden", "_b", "target", "a/__pycache__", "x.git", ".git"):
        (root / folder).mkdir(parents=True)
    files = {
        "a/.hidden/one.JSONL": b"{}\n", "_b/two.tsv": b"\xef\xbb\xbfx", ".dot": b"z", "no-extension": b"", "empty.json": b"", "x.git/kept.html": b"\xff", "plain.txt": "é".encode() * 700_000, "cut.json": b"[" + "é".encode()[:1],
        "target/skipped.json": b"[]", "a/__pycache__/skipped.json": b"[]", ".git/skipped": b"", "end.": b"q", "out.jsonl": b"the manifest itself",
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    os.symlink(root / "a", root / "loop")
    os.symlink(root / "nowhere", root / "dangling.json")
    large = root / "large.json"
    with large.open("wb") as f:  # over 2 GB, most of it a hole
        f.seek((2 << 30) + 5)
        f.write(b"]")
    got = {r.relative_path: r for r in scan.scan(spark, str(root), str(root / "out.jsonl")).collect()}
    want = {n: d for n, d in files.items() if "skipped" not in n and n != "out.jsonl"}
    assert list(got) == sorted([*want, "large.json"])
    for name, data in want.items():
        assert (got[name].byte_size, got[name].sha256) == (len(data), sha(data)), name
    assert got["large.json"].byte_size == (2 << 30) + 6 and got["large.json"].file_status == "ok"
    state = {n: (r.extension, r.detected_format, r.encoding_status, r.file_status) for n, r in got.items()}
    assert state["a/.hidden/one.JSONL"] == (".jsonl", "jsonl", "utf8", "ok") and state["_b/two.tsv"] == (".tsv", "tsv", "utf8_bom", "ok")
    assert state[".dot"] == ("", "unknown", "utf8", "unsupported") and state["no-extension"] == ("", "unknown", "empty", "empty") and state["empty.json"][2:] == ("empty", "empty")
    assert state["x.git/kept.html"][2:] == ("invalid_utf8", "encoding_error") and state["cut.json"][2:] == ("invalid_utf8", "encoding_error") and state["plain.txt"][2:] == ("utf8", "unsupported")


def test_a_file_that_cannot_be_read_is_a_row(tmp_path):
    reader = scan.ScanReader(str(tmp_path), None)
    (tmp_path / "gone.json").write_text("[]")
    found = reader.partitions()
    (tmp_path / "gone.json").unlink()
    assert list(reader.read(found[0])) == [("gone.json", 0, sha(b""), ".json", "json", "empty", "io_error", "file-manifest-entry-v1")]
    assert list(scan.ScanReader(str(tmp_path / "no such folder"), None).partitions()[0].files) == []


def test_scan_deals_files_to_partitions(tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "PARTITION_BYTES", 10)
    for k, n in enumerate((4, 4, 4, 30, 1, 1)):
        (tmp_path / f"{k}").write_bytes(b"x" * n)
    assert [[name for name, _ in p.files] for p in scan.ScanReader(f"file:{tmp_path}", None).partitions()] == [["0", "1"], ["2"], ["3"], ["4", "5"]]


def whole(data: bytes):
    """What a parser of the whole file gives: the elements, or the error."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return "invalid_encoding"
    try:
        value = json.loads(text.removeprefix("﻿"))
    except ValueError:
        return "invalid_json"
    return value if isinstance(value, list) else "type_error"


def cut(spark, tmp_path, files: dict, size: int):
    """The same by ranges of ``size`` bytes; errors of any kind are "bad"."""
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    table = spark.createDataFrame([(n, str(tmp_path / n), len(d)) for n, d in files.items()], "name string, path string, byte_size long")
    make = lambda name, offset, value: {"name": name, "k": offset, "v": json.dumps(value)}
    import pyarrow as pa

    rows = arrays.elements(arrays.states(arrays.ranges(table, size)), make, "name string, k long, v string", pa.schema([("name", pa.string()), ("k", pa.int64()), ("v", pa.string())])).collect()
    out = {}
    for name in files:
        own = sorted((r.k, r.v) for r in rows if r.name == name)
        keys = [k for k, _ in own]
        bad = -2 in keys or (-1 in keys and len(keys) > 1) or not keys
        out[name] = "bad" if bad else [json.loads(v) for k, v in own if k >= 0]
        if not bad and keys != [-1]:
            assert keys == list(range(len(keys))), name
    return out


def value(r, depth=0):
    k = r.randrange(9 if depth < 3 else 6)
    if k == 0:
        return r.choice([None, True, False, 0, -1.5, 1e300])
    if k < 6:
        return "".join(r.choice(['"', "\\", "[", "]", "{", "}", ",", "é", "😀", "a", "\n", " "]) for _ in range(r.randrange(12)))
    if k == 6:
        return {value_key(r): value(r, depth + 1) for _ in range(r.randrange(4))}
    return [value(r, depth + 1) for _ in range(r.randrange(5))]


def value_key(r):
    return "".join(r.choice('ab"\\],[{}') for _ in range(r.randrange(4)))


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_arrays_by_ranges_equal_the_whole_file(spark, tmp_path, size):
    r = random.Random(size)
    files = {}
    for k in range(14):
        data = json.dumps([value(r) for _ in range(r.randrange(6))], ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])).encode()
        files[f"good{k}"] = r.choice([b"", b" \n", b"\xef\xbb\xbf", b"\xef\xbb\xbf\r\t "]) + data + r.choice([b"", b"\n \n"])
        hurt = bytearray(data)
        for _ in range(r.randrange(1, 3)):
            at = r.randrange(len(hurt))
            hurt[at : at + r.randrange(2)] = r.choice([b"", b'"', b"\\", b"]", b"[", b",", b"}", b"\xff"])
        files[f"hurt{k}"] = bytes(hurt)
    for k, data in enumerate([b"[]", b"[ \n ]", b"[,]", b"[1,]", b"[,1]", b"[1][2]", b"[1] x", b"x [1]", b"[1]]", b"[[1]", b"[1", b'["a]', b"[1] [", b"{}", b'{"a":[1,2]}', b'"[1]"', b"[{]}", b"[\\]", b'["\\\\","\\""]', b'["' + b"\\" * 40 + b'",1]', b"  ", b"[1 2]", b"[NaN, Infinity]", b"[1]\xef\xbb\xbf", b"[\xef\xbb\xbf1]"]):
        files[f"case{k:02}"] = data
    got = cut(spark, tmp_path, files, size)
    for name, data in files.items():
        want = whole(data)
        assert json.dumps(got[name]) == json.dumps("bad" if isinstance(want, str) else want), (name, data)


def test_one_line_array_of_many_ranges(spark, tmp_path):
    """Ranges far smaller than the elements' number, and one element over many ranges."""
    values = [{"k": i, "t": "x],[" * (i % 9)} for i in range(4000)] + ["long \\\" " * 30_000, [], {}]
    assert cut(spark, tmp_path, {"f": json.dumps(values).encode()}, 1 << 12)["f"] == values


def test_directory_with_arrays_hidden_and_broken_files(spark, tmp_path, monkeypatch):
    row = lambda k, **more: json.dumps(GOOD | {"record_id": k} | more, ensure_ascii=False)
    tsv = "\t".join(raw.HEADER) + "\n"
    line = "\t".join(["t1", "d", "null", "article", "null", '"x"', '"c"', "b", "true"]) + "\n"
    files = {
        "a.json": f"[{row('a0')}, 5, {row('a2')}, {{\"record_id\": 1}}]".encode(), "bom.json": b"\xef\xbb\xbf[" + row("b0").encode() + b"]", "bad.json": b"\xef\xbb\xbf[1, 2", "object.json": b'{"a": 1}', "none.json": b"[]", "enc.json": b'["\xff"]', "late.json": f"[{row('l0')}, tru]".encode(),
        ".hidden/h.jsonl": b"\xef\xbb\xbf" + row("h0").encode() + b"\r\n{\n" + row("h2").encode(), "_t.tsv": (tsv + line + "a\tb\n").encode(), ".drift.tsv": b"a\tb\nc\td\n", "_p.html": b"<html>\n<ARTICLE>\n", ".e.jsonl": b"", "_enc.jsonl": b"\xff\n",
        "v.jsonl": b"\xef\xbb\xbf{\n" + row("v1").encode() + b"\n", "u.bin": b"\x00\xff", "venc.tsv": b"\xfe",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for size in (16, 1 << 20):
        monkeypatch.setattr(raw, "RANGE_BYTES", size)
        good, bad = raw.parse_directory(spark, str(tmp_path))
        assert [(r.record_id, r.source_file, r.source_offset) for r in good.collect()] == [("h0", ".hidden/h.jsonl", 0), ("h2", ".hidden/h.jsonl", 2), ("t1", "_t.tsv", 0), ("a0", "a.json", 0), ("a2", "a.json", 2), ("b0", "bom.json", 0), ("v1", "v.jsonl", 1)]
        assert [(r.source_file, r.source_offset, r.detected_format, r.error_code, r.raw_fragment_hash) for r in bad.collect()] == [
            (".drift.tsv", 0, "tsv", "unknown_schema_drift", sha(b"a\tb")), (".hidden/h.jsonl", 1, "jsonl", "invalid_json", sha(b"{")), ("_enc.jsonl", 0, "jsonl", "invalid_encoding", sha(b"\xff\n")), ("_p.html", 0, "html", "invalid_html", sha(b"<ARTICLE>")), ("_t.tsv", 1, "tsv", "malformed_tsv", sha(b"a\tb")),
            ("a.json", 1, "json", "type_error", sha(b"5")), ("a.json", 3, "json", "missing_field", sha(b'{"record_id":1}')), ("bad.json", 0, "json", "invalid_json", sha(b"[1, 2")), ("enc.json", 0, "json", "invalid_encoding", sha(files["enc.json"])), ("late.json", 0, "json", "invalid_json", sha(files["late.json"])),
            ("object.json", 0, "json", "type_error", sha(b'{"a": 1}')), ("u.bin", 0, "unknown", "unsupported_format", sha(b"\x00\xff")), ("v.jsonl", 0, "jsonl", "invalid_json", sha(b"{")), ("venc.tsv", 0, "tsv", "invalid_encoding", sha(b"\xfe")),
        ]


def test_ranges_are_spread_over_tasks(spark, tmp_path):
    """A file of 3 GB and more is no special case: its ranges are rows of their own."""
    table = spark.createDataFrame([("f", "/f", (3 << 30) + 1)], "name string, path string, byte_size long")
    r = arrays.ranges(table).agg(F.count("*"), F.min("start"), F.max("end"), F.sum(F.col("end") - F.col("start"))).first()
    assert tuple(r) == (385, 0, (3 << 30) + 1, (3 << 30) + 1)
