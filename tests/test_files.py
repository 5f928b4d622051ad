"""Listing, hashing and line reading by executors."""

import hashlib
import os
import random
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelscope.operators import reconcile as R
from labelscope.sources import documents, files, tables


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "a" / "deep" / "er").mkdir(parents=True)
    (root / "empty folder").mkdir()
    made = {"plain.txt": b"one\ntwo", "empty": b"", ".hidden": b"h\r\n\r", "_under": b"u\r\nv\r", "a/run.sh": b"#!/bin/sh\n", "a/deep/er/x y.bin": bytes(range(256)) * 99}
    for name, data in made.items():
        (root / name).write_bytes(data)
    os.chmod(root / "a/run.sh", 0o755)
    os.symlink(root, root / "a" / "loop")
    return root, made


def lines_of(data):
    text = data.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n")
    return len(text.removesuffix("\n").split("\n")) if text else 0


def blob(data):
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def test_walk_lists_hidden_empty_and_deep_files(spark, tree):
    root, made = tree
    got = {r.path: (r.bytes, r.git_mode) for r in files.walk_files(spark, str(root) + "/").collect()}
    assert got == {f"{root}/{n}": (len(d), "100755" if n.endswith(".sh") else "100644") for n, d in made.items()}


@pytest.mark.parametrize("chunk", [1, 2, 3, 8 << 20])
def test_identities_do_not_depend_on_chunks(tree, chunk):
    _, made = tree
    for data in (*made.values(), b"\r\n" * 7 + b"\r" * 3 + b"\n", b"a\rb\nc\r\nd"):
        found = files._Hashes(len(data))
        for at in range(0, len(data), chunk):
            found.add(data[at:at + chunk])
        assert (found.length, found.lines(), found.sha256.hexdigest(), found.sha1.hexdigest()) == (
            len(data), lines_of(data), hashlib.sha256(data).hexdigest(), blob(data))


def test_inventory_equals_the_hashes_of_whole_contents(spark, tree):
    root, made = tree
    got = {r.path: r for r in files.file_inventory(spark, str(root)).collect()}
    assert {n: (r.byte_length, r.line_count, r.sha256, r.git_blob_sha1) for n, r in got.items()} == {
        n: (len(d), lines_of(d), hashlib.sha256(d).hexdigest(), blob(d)) for n, d in made.items()}


def test_file_urls(spark, tree):
    root, made = tree
    assert {r.path for r in files.file_inventory(spark, f"file://{root}").collect()} == set(made)


def test_attestation_reads_every_file(spark, tree):
    root, made = tree
    before = files.file_inventory(spark, str(root))
    manifest = spark.createDataFrame([tuple(r) for r in before.collect()], before.schema)
    (root / ".hidden").write_bytes(b"h\r\n\n")  # same length and lines
    (root / "empty").unlink()
    os.chmod(root / "plain.txt", 0o755)
    codes = {r.path: r.code for r in R.attest_identities(files.file_inventory(spark, str(root)), manifest).collect()}
    assert codes == {**dict.fromkeys(made), ".hidden": "file.sha256", "empty": "file.missing", "plain.txt": "file.git_mode"}


def test_a_sparse_file_over_two_gigabytes(spark, tmp_path):
    root = tmp_path / "large"
    root.mkdir()
    size = (2 << 30) + 5
    with open(root / "sparse", "wb") as f:
        f.truncate(size)
    row = files.file_inventory(spark, str(root)).first()
    want = subprocess.run(["sha256sum", str(root / "sparse")], capture_output=True, text=True, check=True).stdout.split()[0]
    assert (row.byte_length, row.line_count, row.sha256, len(row.git_blob_sha1)) == (size, 1, want, 40)


def brute_lines(data):
    out, at = [], 0
    for line in data.splitlines(keepends=True):  # bytes: LF, CR and CRLF only
        out.append((at, line.rstrip(b"\r\n") if line.endswith((b"\r", b"\n")) else line))
        at += len(line)
    return out


def test_lines_have_the_same_keys_under_any_split(tmp_path, monkeypatch):
    draw = random.Random(4)
    for n in range(60):
        data = b"".join(draw.choice([b"a", b"bc", b"\n", b"\r", b"\r\n", b"long line"]) for _ in range(draw.randint(0, 30)))
        path = tmp_path / f"f{n}"
        path.write_bytes(data)
        want = brute_lines(data)
        for split in (1, 2, 3, 7, 1000):
            for chunk in (1, 2, 5, 1000):
                chunks = lambda p, start=0, size=0, step=chunk: iter([data[i:i + step] for i in range(start, len(data), step)])
                monkeypatch.setattr(files, "_chunks", chunks)
                got = [x for start in range(0, max(1, len(data)), split) for x in files._lines_from(str(path), start, start + split, 4)]
                assert got == [(at, len(c), c if len(c) <= 4 else None) for at, c in want]


def test_long_lines_are_rejects_and_keys_are_stable(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    good = '{"case_id":"a","max_length":8,"schema_version":"token-boundary-synthetic-case-v1","source":"c","target":"d"}'
    (folder / "_one.jsonl").write_text(good + "\n" + "x" * 3_000_000 + "\n" + good + "\nnot json\n")
    (folder / "two.jsonl").write_text(good)
    seen = []
    for split in (5000, 1 << 20):
        valid, rejects = documents.read_cases(spark, str(folder), "offsets", split_bytes=split)
        assert valid.count() == 3
        seen.append(sorted((r.record_key, r.error_code) for r in rejects.collect()))
    first = len(good) + 1
    assert seen[0] == seen[1] == [(f"_one.jsonl#{first}", "document.size"), (f"_one.jsonl#{first + 3_000_001 + first}", "document.json")]


def test_no_files(spark, tmp_path):
    (tmp_path / "nothing").mkdir()
    assert files.file_inventory(spark, str(tmp_path / "nothing")).count() == 0
    assert files.read_lines(spark, str(tmp_path / "nothing"), 10).count() == 0


def test_keys_of_lines(spark, tmp_path):
    Path(tmp_path / "k").mkdir()
    (tmp_path / "k" / "x").write_bytes(b"a\r\n\nb")
    got = files.read_lines(spark, str(tmp_path / "k"), 10).orderBy("offset").select("path", "offset", "size", F.col("payload").cast("string")).collect()
    assert [tuple(r) for r in got] == [("x", 0, 1, "a"), ("x", 3, 0, ""), ("x", 4, 1, "b")]


def test_many_small_files_are_laid_out_as_spark_does(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 1, None), ("b/c=%", 2, "é\ny"), (None, None, "z"), ("", 3, "")]
    frame = spark.createDataFrame(rows, "source string, part long, text string").repartition(3, "source", "part").sortWithinPartitions("source", "part", F.col("text").desc())
    files.write_lines(frame, str(tmp_path / "ours"))
    frame.write.partitionBy("source", "part").text(str(tmp_path / "theirs"))
    seen = [sorted((str(p.relative_to(tmp_path / top).parent), p.read_bytes()) for p in (tmp_path / top).rglob("*") if p.is_file() and not p.name.endswith(".crc"))
            for top in ("ours", "theirs")]
    assert seen[0] == seen[1]


def test_documents_are_listed_and_read_by_executors(spark, tree, monkeypatch):
    root, made = tree

    def listed(*args):
        raise AssertionError("listed by the driver")

    monkeypatch.setattr(tables, "list_files", listed)
    raw = documents.read_raw(spark, str(root), "files", 20).collect()
    got = {r.record_key.removeprefix(f"file:{root}/"): (None if r.payload is None else bytes(r.payload), r.oversize) for r in raw}
    assert got == {n: (None if n.startswith((".", "_")) or len(d) > 20 else d, len(d) > 20) for n, d in made.items()}
    one = documents.read_raw(spark, str(root / "plain.txt"), "files", 20).collect()
    assert [bytes(r.payload) for r in one] == [b"one\ntwo"]
