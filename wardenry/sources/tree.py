"""Folders of files as a Spark source, and rows written out as such folders.

The driver lists folders only, until there are enough to deal out; tasks walk what lies below them. Which files are left out by name, link or size is decided by
columns before any is opened; the others are dealt over the cluster by number, wherever they lie, so that one folder may hold most of them.
Works on folders that all executors mount; object stores are read by corpus.files().
"""

from __future__ import annotations

import codecs
import os
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .corpus import BINARY_SUFFIXES, DEFAULT_EXCLUDES, HEAD, matches_any, materialised, shared_folder

#: Bytes of text in a batch that a task gives back, and bytes of files that a task is dealt on average.
BATCH_BYTES, TASK_BYTES = 16 << 20, 64 << 20
#: A file of this size or more does not fit a string column: it is told as an error.
MOST_BYTES = (1 << 31) - 64

# How notes begin.
NOTES = {"symlink": "skipped symlink: ", "not included": "excluded by include filter: ", "excluded": "excluded by exclude filter: ", "empty": "skipped empty file: ", "binary": "skipped binary file: "}


def mounted(root: str) -> str:
    """The local path of a folder, which may be named by file:."""
    parts = urlsplit(root)
    if parts.scheme not in ("", "file") or parts.netloc:
        raise ValueError(f"not a mounted folder: {root}")
    return os.path.realpath(unquote(parts.path) if parts.scheme else root)


@dataclass
class Folder(InputPartition):
    path: bytes
    deep: bool  # whether its folders are walked too


_ENTRY = pa.schema([("relative_path", pa.string()), ("place", pa.binary()), ("size", pa.int64()), ("is_link", pa.bool_()), ("error", pa.string())])


class FileTree(DataSource):
    """One row a file below `path`: relative_path, place (the bytes of its name), size, is_link; a folder that can't be listed is a row with an error.

    Links to files are told and not followed; links to folders, links to nothing and what is no file are not seen. Option folders: how many the driver looks for before it deals them out.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "relative_path string, place binary, size bigint, is_link boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(os.fsencode(mounted(self.options["path"])), int(self.options.get("folders", "256")))


class FileTreeReader(DataSourceReader):
    def __init__(self, root: bytes, folders: int):
        self.root, self.folders = root, folders

    def partitions(self) -> list[Folder]:
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"no such file or folder: {self.root!r}")
        if not os.path.isdir(self.root):
            return [Folder(self.root, False)]
        waiting, shallow = deque([self.root]), []
        while waiting and len(waiting) < self.folders:
            path = waiting.popleft()
            shallow.append(Folder(path, False))
            try:
                with os.scandir(path) as entries:
                    waiting.extend(sorted(e.path for e in entries if e.is_dir(follow_symlinks=False)))
            except OSError:
                pass  # the task that lists its files tells
        return shallow + [Folder(p, True) for p in waiting]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self.entries(partition):
            rows.append(row)
            if len(rows) == 10_000:
                yield _batch(rows, _ENTRY)
                rows = []
        yield _batch(rows, _ENTRY)

    def entries(self, partition: Folder) -> Iterator[tuple]:
        if partition.path == self.root and not os.path.isdir(self.root):
            yield shown(os.path.basename(self.root)), self.root, os.path.getsize(self.root), False, None
            return
        folders = [partition.path]
        while folders:
            folder = folders.pop()
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            if partition.deep:
                                folders.append(e.path)
                        elif e.is_file():
                            link = e.is_symlink()
                            yield shown(os.path.relpath(e.path, self.root)), e.path, None if link else e.stat().st_size, link, None
            except OSError as problem:
                yield shown(os.path.relpath(folder, self.root)), folder, None, False, f"can't be listed: {problem.strerror}"


def shown(path: bytes) -> str:
    return path.decode("utf-8", "replace")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def reason_by_name(include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Why an entry is left out before it is opened; the first of these that holds."""
    path = F.col("relative_path")
    suffix = F.lower(path).rlike("(?:" + "|".join(x.replace(".", "[.]") for x in BINARY_SUFFIXES) + ")$")
    out = F.when(F.col("is_link"), "symlink")
    if include:
        out = out.when(~matches_any(path, include), "not included")
    return out.when(matches_any(path, exclude), "excluded").when(F.col("size") == 0, "empty").when(suffix, "binary")


def is_binary(head: bytes, whole: bool) -> bool:
    """Whether a file that begins so is binary: a NUL, or no UTF-8. A character that the end of the head cuts tells nothing."""
    if b"\0" in head:
        return True
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, whole)
    except UnicodeDecodeError:
        return True
    return False


def text_of(content: bytes) -> str:
    """Bytes as text: what is no UTF-8 is left out, newlines are of one kind."""
    return content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def read_file(place: bytes) -> tuple[str | None, str | None, str | None]:
    """A file's text, why it is left out, what went wrong."""
    try:
        with open(place, "rb") as file:
            head, more = file.read(HEAD), file.read(1)
            if is_binary(head, not more):
                return None, "binary", None
            if os.fstat(file.fileno()).st_size >= MOST_BYTES:
                return None, None, "can't be read: too long for a column"
            return text_of(head + more + file.read()), None, None
    except OSError as problem:
        return None, None, f"can't be read: {problem.strerror}"


_FILE = pa.schema([("relative_path", pa.string()), ("size", pa.int64()), ("text", pa.string()), ("skip_reason", pa.string()), ("error", pa.string())])
FILES = "relative_path string, size bigint, text string, skip_reason string, error string"


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            text, reason, error = (None, r["skip_reason"], r["error"]) if r["skip_reason"] or r["error"] else read_file(r["place"])
            rows.append((r["relative_path"], r["size"], text, reason, error))
            held += len(text or "") + 100
            if held > BATCH_BYTES:
                yield _batch(rows, _FILE)
                rows, held = [], 0
    if rows:
        yield _batch(rows, _FILE)


def scanned(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), fail_fast: bool = False) -> DataFrame:
    """Every file below root, or the file that root names: relative_path, size (of a link: null), text, skip_reason, error. A file is selected if it has neither; blank globs don't count.

    Of the reasons the first that holds: symlink, not included, excluded (the default ones too), empty, binary. What can't be listed or read has an error, or raises with fail_fast. The listing is written once, so that a lost task reads the same files again.
    """
    spark.dataSource.register(FileTree)
    named = lambda globs: tuple(g for g in globs if g.strip())
    entries = spark.read.format("file_tree").load(root)
    listed = materialised(entries.withColumn("skip_reason", F.when(F.col("error").isNull(), reason_by_name(named(include), (*DEFAULT_EXCLUDES, *named(exclude))))), "file-tree")
    todo = listed.where("skip_reason IS NULL AND error IS NULL").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-todo // TASK_BYTES))
    out = listed.repartition(int(tasks)).mapInArrow(opened, FILES)
    if fail_fast:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("relative_path", F.lit(": "), "error"))))
    return out


def selected(files: DataFrame) -> DataFrame:
    return files.where("skip_reason IS NULL AND error IS NULL").select("relative_path", "size", "text")


def notes(files: DataFrame, all_: bool = False) -> DataFrame:
    """relative_path, note: links and errors, with all_ everything that was left out."""
    told = F.concat(F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair))[F.col("skip_reason")], "relative_path")
    out = files.select("relative_path", F.coalesce(F.concat("relative_path", F.lit(" "), "error"), told).alias("note"), "skip_reason", "error")
    return out.where("note IS NOT NULL" if all_ else "error IS NOT NULL OR skip_reason = 'symlink'").select("relative_path", "note")


def counters(files: DataFrame) -> DataFrame:
    """One row: files_seen, files_selected. A folder that can't be listed is no file."""
    listed = F.coalesce(F.col("error").startswith("can't be listed"), F.lit(False))
    return files.agg(F.count_if(~listed).alias("files_seen"), F.count_if(F.col("skip_reason").isNull() & F.col("error").isNull()).alias("files_selected"))


def written(rows: DataFrame, name: str) -> str:
    """rows (relative_path, content as bytes, link: a relative path that a link instead points to) as files below a new folder in spark.checkpoint.dir, whose path is returned. A task that runs again replaces its files whole."""
    root = mounted(shared_folder(rows.sparkSession, name))
    # Files in the making lie beside the tree, so what a lost task leaves is no part of it.
    making = f"{root}-making"

    def put(batches):
        os.makedirs(making, exist_ok=True)
        for batch in batches:
            for path, content, link in zip(*(batch.column(c) for c in ("relative_path", "content", "link")), strict=True):
                to, own = os.path.join(root, path.as_py()), os.path.join(making, uuid.uuid4().hex)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                if link.is_valid:
                    os.symlink(link.as_py(), own)
                else:
                    with open(own, "wb") as file:
                        file.write(content.as_py() or b"")
                os.replace(own, to)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    os.makedirs(root, exist_ok=True)
    rows.select("relative_path", F.col("content").cast("binary").alias("content"), F.col("link").cast("string").alias("link")).mapInArrow(put, "n bigint").agg(F.sum("n")).first()
    return root
