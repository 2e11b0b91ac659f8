import hashlib

import pytest
from pyspark.sql import functions as F

from srcloom.functions import text as tx
from srcloom.sources.files import LOADED, QUARANTINED, filter_sources, load_files, load_status, scan_files


def column(spark, values, expression, name="x"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col(name))).collect()]


LINES = {
    "": 0, "one": 1, "one\n": 1, "\n": 1, "\n\n": 2, "p\n\nq": 3, "p\r\nq\r\n": 2, "p\rq": 2, "p\x0bq\x0cr": 3,
    "p\x1cq\x1dr\x1es\x85t\u2028u\u2029": 6, "k\n\r\nm": 3, "k\r\n": 1, "{\n}\n": 2,
}


def test_line_count(spark):
    assert column(spark, list(LINES), tx.line_count) == list(LINES.values())


def test_token_estimate(spark):
    counts = {"": 0, "ab": 0, "abc": 1, "12345": 2, "ü" * 10: 4, "z" * 7: 2, "\U0001f600pq": 1, "y" * 100: 40}
    assert column(spark, list(counts), tx.token_estimate) == list(counts.values())


def test_hash(spark):
    # Known digests of SHA-256.
    digests = {
        "": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        "abc": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",
    }
    assert column(spark, list(digests), tx.content_hash) == list(digests.values())


def test_language_and_suffix(spark):
    paths = ["test.c", "test.cpp", "test.cc", "test.h", "test.hpp", "X.C", "a.h++", "a.cxx", "d.c/x", ".c", "a.b.HXX"]
    assert column(spark, paths, tx.detect_language) == [
        "c", "cpp", "cpp", "c", "cpp", "c", "cpp", "cpp", "c", "c", "cpp",
    ]
    assert column(spark, paths, tx.suffix) == [
        ".c", ".cpp", ".cc", ".h", ".hpp", ".c", ".h++", ".cxx", "", "", ".hxx",
    ]


def test_extension_filter(spark):
    paths = ["a.c", "a.cpp", "a.cc", "a.h", "a.hpp", "a.txt", "a.py", "A.C"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in filter_sources(df).collect()} == {"a.c", "a.cpp", "a.cc", "a.h", "a.hpp", "A.C"}
    assert {r.path for r in filter_sources(df, False).collect()} == {"a.c", "a.cpp", "a.cc", "A.C"}


STRIPPED = {
    "p = 1; // one\nq = 2;": "p = 1; \nq = 2;",
    "p /* long\nnote */ q": "p  q",
    'say("ftp://host") + 1': 'say("ftp:',
    "#pragma once\n\t# undef Z\nint c;": "\n\nint c;",
    "p // q */ r\n/* never closed": "p \n/* never closed",
}


def test_comment_removal_ignores_literals(spark):
    assert column(spark, list(STRIPPED), tx.strip_comments) == list(STRIPPED.values())


def test_unknown_token_mode():
    with pytest.raises(ValueError):
        tx.token_count(None, mode="other")
    with pytest.raises(ValueError):
        tx.token_count(None, mode="accurate")


def test_scan_and_load(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.c").write_bytes(b"int a;\r\nint b;\r\n")
    (tmp_path / "sub" / "B.HPP").write_bytes("é\n".encode())
    (tmp_path / "sub" / "c.c").write_bytes(b"\xe9\xff\rx")
    (tmp_path / "notes.txt").write_text("no")
    root = str(tmp_path)
    files = {r.path: r for r in load_files(scan_files(spark, root), root).collect()}
    assert set(files) == {"a.c", "sub/B.HPP", "sub/c.c"}
    a, b, c = files["a.c"], files["sub/B.HPP"], files["sub/c.c"]
    assert (a.content, a.line_count, a.language, a.encoding, a.name) == ("int a;\nint b;\n", 2, "c", "utf-8", "a.c")
    assert a.hash == hashlib.sha256(b"int a;\nint b;\n").hexdigest()
    assert (b.language, b.encoding, b.name) == ("cpp", "utf-8", "B.HPP")
    assert (c.content, c.encoding) == ("éÿ\nx", "latin-1")
    assert c.hash == hashlib.sha256("éÿ\nx".encode()).hexdigest()
    assert {r.path for r in load_files(scan_files(spark, root, False), root).collect()} == {"a.c", "sub/c.c"}


def test_scan_one_file_and_missing_root(spark, tmp_path):
    one = tmp_path / "one.c"
    one.write_text("int x;")
    assert scan_files(spark, str(one)).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_files(spark, str(tmp_path / "none")).count()


def test_quarantine(spark):
    df = spark.createDataFrame([("a.c", bytearray(b"x")), ("b.c", None), ("c.c", bytearray(b"\xff"))], "path string, bytes binary")
    strict = {r.path: (r.status, r.reason) for r in load_status(df, strict=True).collect()}
    assert strict == {
        "a.c": (LOADED, None), "b.c": (QUARANTINED, "no content"), "c.c": (QUARANTINED, "not utf-8"),
    }
    assert {r.path for r in load_status(df).where("status = 'loaded'").collect()} == {"a.c", "c.c"}
