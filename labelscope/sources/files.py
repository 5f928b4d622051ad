"""Files of any name and size: listed by executors, hashed in chunks; lines by byte offset.

Directories are listed level by level, each in a task of its own, so neither names
nor sizes pass the driver. A file is read in chunks of ``CHUNK`` bytes and never
held whole. Paths are what ``pyarrow.fs`` opens: local or mounted folders and the
object stores it knows.
"""

import hashlib
import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.session import reliable_checkpoint

CHUNK = 8 << 20
#: Files and lines handed to Spark at once.
BATCH_ROWS = 10_000
BATCH_BYTES = 16 << 20
#: Tasks that files are dealt to.
TASKS_PER_CORE = 3
#: Bytes of a file that one task reads as lines.
SPLIT_BYTES = 128 << 20
#: What Spark spells with a percent sign in the names of partition folders, and its name for no value.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_LISTED = "path string, bytes long, git_mode string, folder boolean"
_IDENTITY = "path string, bytes long, git_mode string, byte_length long, line_count long, sha256 string, git_blob_sha1 string"
_LINE_END = re.compile(rb"\r\n|\n|\r")
_LINES = "path string, offset long, size long, payload binary"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/?@&=%")) if "://" in path else (fs.LocalFileSystem(), path)


def opens(path: str) -> bool:
    """Whether ``pyarrow.fs`` knows the store of ``path``."""
    try:
        _opened(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def _mode(system: fs.FileSystem, path: str) -> str:
    """Git's mode; stores without permissions have plain files only."""
    runs = isinstance(system, fs.LocalFileSystem) and os.stat(path).st_mode & 0o100
    return "100755" if runs else "100644"


def _entries(folder: str) -> Iterator[tuple[str, int | None, str | None, bool]]:
    system, at = _opened(folder)
    head = folder.rstrip("/")
    if (own := system.get_file_info(at)).type == fs.FileType.File:
        yield head, own.size, _mode(system, at), False
        return
    for entry in system.get_file_info(fs.FileSelector(at)):
        path = f"{head}/{entry.base_name}"
        if entry.type == fs.FileType.Directory:
            # A link to a folder may lead back; what it holds is listed where it lies.
            if not (isinstance(system, fs.LocalFileSystem) and os.path.islink(entry.path)):
                yield path, None, None, True
        elif entry.type == fs.FileType.File:
            yield path, entry.size, _mode(system, entry.path), False


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for folder in batch["path"].to_pylist():
            for entry in _entries(folder):
                rows.append(entry)
                if len(rows) >= BATCH_ROWS:
                    yield _listed(rows)
                    rows = []
    yield _listed(rows)


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[r[i] for r in rows] for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)],
                                      ["path", "bytes", "git_mode", "folder"])


def _spread(paths: DataFrame) -> DataFrame:
    """Paths over all cores: their rows are short, so tasks cut by size would be few."""
    return paths.repartition(TASKS_PER_CORE * paths.sparkSession.sparkContext.defaultParallelism, "path")


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes, git_mode`` of every file below ``root``, itself if it is one: empty and hidden ones too."""
    folders = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    levels = []
    while True:
        # Each level is kept: a folder is listed once, whatever is read from the result.
        found = reliable_checkpoint(_spread(folders).mapInArrow(_list, _LISTED))
        levels.append(found.where(~F.col("folder")).drop("folder"))
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


class _Hashes:
    """Length, lines and hashes of content that comes in chunks of any cut."""

    def __init__(self, size: int):
        self.sha256, self.sha1 = hashlib.sha256(), hashlib.sha1(b"blob %d\0" % size)
        self.length = self.ends = 0
        self.last = b""

    def add(self, chunk: bytes) -> None:
        self.sha256.update(chunk)
        self.sha1.update(chunk)
        self.length += len(chunk)
        # CR, LF and CRLF each end one line; a CRLF may lie across two chunks.
        self.ends += chunk.count(b"\n") + chunk.count(b"\r") - chunk.count(b"\r\n")
        if self.last == b"\r" and chunk.startswith(b"\n"):
            self.ends -= 1
        self.last = chunk[-1:] or self.last

    def lines(self) -> int:
        return self.ends + (self.length > 0 and self.last not in b"\r\n")


def _chunks(path: str, start: int = 0, size: int = CHUNK) -> Iterator[bytes]:
    system, at = _opened(path)
    with system.open_input_file(at) as file:
        file.seek(start)
        while chunk := file.read(size):
            yield chunk


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"byte_length": [], "line_count": [], "sha256": [], "git_blob_sha1": []}
        for path, size in zip(batch["path"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
            found = _Hashes(size)
            for chunk in _chunks(path):
                found.add(chunk)
            if found.length != size:
                raise OSError(f"{path} changed while it was read")
            for name, value in zip(rows, (found.length, found.lines(), found.sha256.hexdigest(), found.sha1.hexdigest()), strict=True):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [batch["path"], batch["bytes"], batch["git_mode"], pa.array(rows["byte_length"], pa.int64()), pa.array(rows["line_count"], pa.int64()),
             pa.array(rows["sha256"], pa.string()), pa.array(rows["git_blob_sha1"], pa.string())], [c.split()[0] for c in _IDENTITY.split(", ")])


def hash_files(files: DataFrame) -> DataFrame:
    """``path, git_mode, byte_length, line_count, sha256, git_blob_sha1`` of listed files, read in chunks."""
    return _spread(files.select("path", "bytes", "git_mode")).mapInArrow(_hash, _IDENTITY).drop("bytes")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Identities of every file below ``root``; paths relative to it."""
    base = root.rstrip("/") + "/"
    return hash_files(walk_files(spark, root)).withColumn("path", F.substring("path", len(base) + 1, F.length("path")))


def _folder(names: list[str], values: tuple) -> str:
    spelled = (_ESCAPED.sub(lambda m: f"%{ord(m.group()):02X}", str(v)) if v is not None and v != "" else _NO_VALUE for v in values)
    return "/".join(f"{n}={v}" for n, v in zip(names, spelled, strict=True))


def write_lines(rows: DataFrame, folder: str) -> None:
    """The last column of ``rows`` as lines of one file for each run of equal other columns, laid out as ``partitionBy`` does.

    Rows come grouped: a run that is split would write its file twice. Lines are
    streamed, and a task that runs again writes the same files; the empty
    ``_SUCCESS`` comes last. A committed write makes, moves and sets the rights of each
    of many small files one by one.
    """
    *keys, line = rows.columns
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, made = None, None, 0
        for batch in batches:
            for *values, text in zip(*(batch[c].to_pylist() for c in (*keys, line)), strict=True):
                if out is None or values != last:
                    if out is not None:
                        out.close()
                    system, at = _opened(f"{root}/{_folder(keys, values)}")
                    system.create_dir(at, recursive=True)
                    last, out, made = values, system.open_output_stream(f"{at}/part-00000.txt"), made + 1
                out.write((text or "").encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["files"])

    rows.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()
    system, at = _opened(root)
    system.create_dir(at, recursive=True)
    system.open_output_stream(f"{at}/_SUCCESS").close()


def _hidden(path: str) -> bool:
    """Whether Spark's scans leave out a path below their folder."""
    return any(name.startswith(".") or (name.startswith("_") and "=" not in name) for name in path.split("/"))


def _contents(root: str, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, size, mode in zip(*(batch[c].to_pylist() for c in ("path", "bytes", "git_mode")), strict=True):
                read = size <= max_bytes and (size == 0 or not _hidden(path[len(root):].strip("/")))
                rows.append((path, size, mode, b"".join(_chunks(path)) if read else None))
                held += (size if read else 0) + 128
                if held >= BATCH_BYTES:
                    yield _content_batch(rows)
                    rows, held = [], 0
        yield _content_batch(rows)

    return run


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[r[i] for r in rows] for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                                      ["path", "bytes", "git_mode", "content"])


def read_files(spark: SparkSession, root: str, max_bytes: int) -> DataFrame:
    """``path, bytes, git_mode, content`` of every file below ``root``, listed and read by executors.

    Content is NULL for files over ``max_bytes`` and for hidden ones; the checksum
    files that a local file system keeps beside each are left out.
    """
    found = walk_files(spark, root).where(~F.col("path").rlike(r"(^|/)\.[^/]*\.crc$"))
    return _spread(found).mapInArrow(_contents(root.rstrip("/"), max_bytes), "path string, bytes long, git_mode string, content binary")


# --- lines -------------------------------------------------------------------


def _lines_from(path: str, start: int, stop: int, limit: int) -> Iterator[tuple[int, int, bytes | None]]:
    """``(offset, size, content)`` of lines that begin in ``[start, stop)``.

    A line ends at LF, CR or CRLF, as in Spark's text source. Past ``limit`` bytes a
    line is counted, not held: its content is None.
    """
    began: int | None = 0 if start == 0 else None  # None: the line began in an earlier split
    size, held, carry = 0, [], b""
    at = max(0, start - 1)  # the byte before says whether a line begins at ``start``
    chunks, ended = _chunks(path, at, min(CHUNK, stop - at)), False
    while not ended:
        chunk = next(chunks, b"")
        ended = not chunk
        buffer, carry = carry + chunk, b""
        if not ended and buffer.endswith(b"\r"):  # it may be half of a CRLF
            buffer, carry = buffer[:-1], b"\r"
        place = 0
        for end in _LINE_END.finditer(buffer):
            if began is not None:
                size += end.start() - place
                yield began, size, b"".join([*held, buffer[place:end.start()]]) if size <= limit else None
            place = end.end()
            began, size, held = at + place, 0, []
            if began >= stop:
                return
        if began is not None:
            size += len(buffer) - place
            held = [*held, buffer[place:]] if size <= limit else []
        elif at + len(buffer) >= stop:
            return  # the whole split lies inside one line
        at += len(buffer)
    if began is not None and size:
        yield began, size, b"".join(held) if size <= limit else None


def _read_lines(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop")), strict=True):
                for offset, size, payload in _lines_from(path, start, stop, limit):
                    rows.append((path, offset, size, payload))
                    held += len(payload or b"") + 64
                    if held >= BATCH_BYTES:
                        yield _line_batch(rows)
                        rows, held = [], 0
        yield _line_batch(rows)

    return run


def _line_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[r[i] for r in rows] for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                      ["path", "offset", "size", "payload"])


def read_lines(spark: SparkSession, root: str, limit: int, split_bytes: int = SPLIT_BYTES, files: DataFrame | None = None) -> DataFrame:
    """``path, offset, size, payload`` of every line of the files below ``root``; paths relative to it.

    ``offset`` is where the line's first byte stands, so file and offset are the
    same key however files are split. Lines over ``limit`` bytes have no payload
    and are never held. ``files`` (path, bytes) takes the place of a listing.
    """
    base = root.rstrip("/") + "/"
    listed = walk_files(spark, root) if files is None else files
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = listed.where("bytes > 0").select("path", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + split_bytes)
    lines = splits.repartition("path", "start").mapInArrow(_read_lines(limit), _LINES)
    return lines.withColumn("path", F.substring("path", len(base) + 1, F.length("path")))
