"""Corpora as (path, text) tables: from the driver's tables, from directories, from rows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from stat import S_ISREG

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATES = "path string, size long, mtime_ns long"
RECORD = f"{CANDIDATES}, content_hash string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    """Where a row of `documents` stands in the corpus."""
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".md")))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(document_path().alias("path"), "text", "doc_id")


#: The driver lists directories until it knows so many that are not listed yet; the executors list these with all below.
LISTED = 64


def _entries(root: str, at: str, excluded: tuple[str, ...]) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Regular files and directories in one directory, links not followed."""
    files, directories = [], []
    try:
        with os.scandir(os.path.join(root, at)) as entries:
            for e in entries:
                rel = f"{at}/{e.name}" if at else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name not in excluded:
                        directories.append(rel)
                elif e.is_file(follow_symlinks=False):
                    stat = e.stat(follow_symlinks=False)
                    files.append((rel, stat.st_size, stat.st_mtime_ns))
    except OSError:
        pass
    return files, directories


def list_directory(spark: SparkSession, root: str, excluded_directories: tuple[str, ...] = ()) -> DataFrame:
    """Regular files below root, links not followed, hidden ones included: path, size, mtime_ns.

    The driver lists the upper directories, some LISTED of them, and the executors the rest, each some whole subtrees; contents
    are read by the executors too (read_files). Root is in a file system that all of them mount.
    """
    found, todo = [], [""]
    while todo and len(todo) < LISTED:
        files, directories = _entries(root, todo.pop(0), excluded_directories)
        found += files
        todo += directories
    near = spark.createDataFrame(found, CANDIDATES)
    if not todo:
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column(0).to_pylist()
            while left:
                files, directories = _entries(root, left.pop(), excluded_directories)
                left += directories
                if files:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], ["path", "size", "mtime_ns"])

    below = spark.createDataFrame([(x,) for x in todo], "path string").repartition(min(len(todo), 4 * spark.sparkContext.defaultParallelism))
    return near.unionAll(below.mapInArrow(run, CANDIDATES))


def one_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The one regular file at a path below root, or nothing; no directory is listed."""
    at = os.path.join(root, path)
    try:
        stat = os.stat(at, follow_symlinks=False)
    except OSError:
        stat = None
    inside = os.path.realpath(at).startswith(os.path.realpath(root) + os.sep)
    return spark.createDataFrame([(path, stat.st_size, stat.st_mtime_ns)] if stat and S_ISREG(stat.st_mode) and inside else [], CANDIDATES)


def read_files(candidates: DataFrame, root: str) -> DataFrame:
    """candidates with their bytes, `content`, read where the rows are; files that have gone are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # one file at a time
                try:
                    with open(os.path.join(root, row["path"]), "rb") as f:
                        yield pa.RecordBatch.from_pylist([row | {"content": f.read()}], schema)
                except OSError:
                    continue

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("content", pa.binary())])
    return candidates.select("path", "size", "mtime_ns").mapInArrow(run, f"{CANDIDATES}, content binary")


def stat_files(rows: DataFrame, root: str) -> DataFrame:
    """(path, size, mtime_ns) of the regular files among rows (path), as they are now; looked at where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    stat = os.stat(os.path.join(root, path), follow_symlinks=False)
                except OSError:
                    continue
                if S_ISREG(stat.st_mode):
                    found.append((path, stat.st_size, stat.st_mtime_ns))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["path", "size", "mtime_ns"])

    return rows.select("path").mapInArrow(run, CANDIDATES)


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """The same by Spark's own source, for stores that only Spark reads; it skips names that begin with . or _ ."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    start = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    return files.select(start.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def decoded(content: str | Column = "content") -> Column:
    """Text of bytes; what is not UTF-8 becomes U+FFFD."""
    return F.decode(content, "UTF-8")
