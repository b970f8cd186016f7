"""File records: what is indexed, content hashes, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import paths
from gleanery.functions.text import col

#: Bytes that are looked at to tell binary files.
SNIFFED = 4096
RECORD = ["path", "size", "mtime_ns", "content_hash"]


def is_binary(content: str | Column) -> Column:
    """A NUL, or no valid UTF-8, in the first bytes. A character that is cut there counts as invalid."""
    head = F.substring(col(content), 1, SNIFFED)
    return F.contains(head, F.lit(b"\x00")) | ~F.is_valid_utf8(head.cast("string"))


def selected(candidates: DataFrame, extensions: tuple[str, ...], exclude_globs: tuple[str, ...]) -> DataFrame:
    """Candidates with an allowed suffix that no pattern excludes."""
    return candidates.where(paths.suffix("path").isin(*[x.lower() for x in extensions]) & ~paths.excluded("path", exclude_globs))


def file_records(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime_ns, content_hash) of files (path, size, mtime_ns, content). A previous record of equal size and time lends its hash,
    then the bytes are neither hashed nor checked; other binary files are left out."""
    if previous is None:
        return files.where(~is_binary("content")).select("path", "size", "mtime_ns", F.sha2("content", 256).alias("content_hash"))
    old = previous.select("path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_time"), F.col("content_hash").alias("old_hash"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_time"))
    joined = files.join(old, "path", "left").withColumn("same", F.coalesce(same, F.lit(False)))
    return joined.where(F.col("same") | ~is_binary("content")).select("path", "size", "mtime_ns", F.when(F.col("same"), F.col("old_hash")).otherwise(F.sha2("content", 256)).alias("content_hash"))


def delta(previous: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """(path, change): added, updated, unchanged or removed. Any differing field updates; with force, all that stay do. One shuffle by path."""
    fields = ["size", "mtime_ns", "content_hash"]
    old = previous.select("path", F.struct(*fields).alias("old"))
    new = current.select("path", F.struct(*fields).alias("new"))
    same = F.lit(False) if force else F.col("old") == F.col("new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return old.join(new, "path", "full_outer").select("path", change.alias("change"))


def counters(candidates: DataFrame, extensions: tuple[str, ...], exclude_globs: tuple[str, ...]) -> DataFrame:
    """One row: total, excluded_by_glob, excluded_by_extension, selected."""
    globbed = paths.excluded("path", exclude_globs)
    suffixed = paths.suffix("path").isin(*[x.lower() for x in extensions])
    return candidates.agg(F.count("*").alias("total"), F.count_if(globbed).alias("excluded_by_glob"), F.count_if(~globbed & ~suffixed).alias("excluded_by_extension"), F.count_if(~globbed & suffixed).alias("selected"))
