"""Index tables in immutable segments, with deletion marks and size-tiered merges."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from gleanery.errors import SchemaUnsupported

SCHEMA_VERSION = 2
SEGMENT = "id string, seq long, bytes long, marks long, tables array<string>"
MANIFEST = f"schema_version int, version long, last_refresh_timestamp string, indexed_file_count long, indexed_chunk_count long, python_enabled boolean, segments array<struct<{SEGMENT.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"
#: Of which segment a row is, and after which it counts no more.
SEG, UNTIL = "_seg", "_until"
#: Segments of one size that are merged into one of the next, and the size of the smallest tier.
FANOUT, TIER_BYTES = 4, 4 << 20
#: A table of a segment up to this size is left as its tasks wrote it; larger ones are dealt by ranges of their keys.
SMALL_BYTES = 32 << 20
#: Of the tables' files: half of what Spark's own choice takes on disk.
CODEC = "zstd"
#: Deletion marks that are sent to all tasks; more are joined by shuffle. Manifests that are kept, so that readers of the one before the last still find its segments.
SMALL_MARKS, KEPT = 100_000, 2

#: By which columns each table lies: a query reads the row groups of its names, terms or paths.
LAYOUT = {
    "files": ["path"], "texts": ["path"], "chunks": ["path", "start_line"], "blocks": ["term", "range"], "symbols": ["short", "path", "start_line"],
    "uses": ["short", "path", "line"], "names": ["name", "path"], "vectors": ["cluster", "path", "chunk_id"], "centroids": ["cluster"], "latent": ["term"],
}
#: Documents whose postings of a term lie in one block: ranges of 2^RANGE_BITS chunks in the order of paths.
RANGE_BITS = 8


def now() -> str:
    return datetime.now(tz=UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with their number (doc) in the segment and its range, in the order in which they lie."""
    return chunks.withColumn("doc", F.monotonically_increasing_id()).withColumn("range", F.shiftright("doc", RANGE_BITS))


def _apart(rows: DataFrame) -> DataFrame:
    """rows with arrays of numbers for arrays of structs: to be shuffled, these take a third of the bytes."""
    flat = lambda f: [F.col(f"{f.name}.{x}").alias(f"{f.name}_{x}") for x in f.dataType.elementType.names] if _structs(f) else [F.col(f.name)]
    return rows.select(*(c for f in rows.schema for c in flat(f)))


def _together(rows: DataFrame, schema: StructType) -> DataFrame:
    """What _apart() was given, of that schema."""
    zipped = lambda f: F.arrays_zip(*(F.col(f"{f.name}_{x}").alias(x) for x in f.dataType.elementType.names)).cast(f.dataType).alias(f.name) if _structs(f) else F.col(f.name)
    return rows.select(*(zipped(f) for f in schema))


def _structs(field: StructField) -> bool:
    return isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType)


class Store:
    """A list of segments, oldest first, in a manifest that is written last: readers see the old or the new list, never a mixture.

    A refresh writes one segment of what changed, and marks (path) of the files whose rows in older segments are dead. Rows
    are never changed; reading takes the marks into account. FANOUT neighbouring segments of like size become one,
    which leaves out the dead rows, so each row is rewritten some log(corpus) times. There is one writer at a time; a lost executor costs
    tasks of one table, a lost driver leaves a segment that no manifest names, which the next commit deletes.
    """

    def __init__(self, spark: SparkSession, root: str, derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        """derived: tables that a merge makes anew from the merged chunks, since their rows are of more than one path."""
        self.spark, self.root, self.derived, self._read = spark, root.rstrip("/"), derived or {}, {}

    # -- folders

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._fs(path)
        return fs.exists(at)

    def _delete(self, path: str) -> None:
        at, fs = self._fs(path)
        fs.delete(at, True)

    def _names(self, path: str) -> list[str]:
        at, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _bytes(self, path: str) -> int:
        at, fs = self._fs(path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    # -- manifest

    def _versions(self) -> list[str]:
        return [v for v in self._names(f"{self.root}/manifest") if v.startswith("v-") and self._exists(f"{self.root}/manifest/{v}/_SUCCESS")]

    def _manifest(self, version: str) -> dict:
        at, fs = self._fs(f"{self.root}/manifest/{version}/_SUCCESS")
        key = version, fs.getFileStatus(at).getModificationTime()
        if key not in self._read:  # a version is never changed
            found = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{version}").collect()[0].asDict(recursive=True)
            self._read = dict([*self._read.items(), (key, found | {"segments": found["segments"] or []})][-2 * KEPT :])
        return self._read[key]

    def manifest(self) -> dict | None:
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else None

    def status(self) -> str:
        found = self.manifest()
        return "not_indexed" if found is None else "ready" if found["schema_version"] == SCHEMA_VERSION else "schema_mismatch"

    def _checked(self) -> dict | None:
        found = self.manifest()
        if found is not None and found["schema_version"] != SCHEMA_VERSION:
            raise SchemaUnsupported(f"The index has schema version {found['schema_version']}, not {SCHEMA_VERSION}.", "Refresh with force.")
        return found

    # -- reading

    def _folder(self, segment: dict) -> str:
        return f"{self.root}/segments/{segment['id']}"

    def _files(self, segment: dict, name: str, prefix: str | None) -> list[str]:
        """A table's folder, or those of its files whose paths may begin with the prefix, by the bounds that were written with it."""
        folder, bounds = f"{self._folder(segment)}/{name}", f"{self._folder(segment)}/_bounds-{name}"
        if not prefix or not self._exists(bounds):
            return [folder]
        rows = self.spark.read.schema("file string, low string, high string").parquet(bounds).where((F.substring("low", 1, len(prefix)) <= prefix) & (F.col("high") >= prefix))
        return [f"{folder}/{r['file']}" for r in rows.collect()]  # a row for each file

    def _raw(self, segments: list[dict], name: str, prefix: str | None = None) -> DataFrame | None:
        having = [s for s in segments if name in s["tables"]]
        if not having:
            return None
        schema = self.spark.read.parquet(f"{self._folder(having[0])}/{name}").schema  # one table's footer is read, not every segment's
        chosen = [(s, files) for s in having if (files := self._files(s, name, prefix))]
        if not chosen:
            return self.spark.createDataFrame([], schema).withColumn(SEG, F.lit(0).cast("long"))
        return reduce(lambda a, b: a.unionByName(b), [self.spark.read.schema(schema).parquet(*files).withColumn(SEG, F.lit(s["seq"]).cast("long")) for s, files in chosen])

    def _live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """rows but those whose path a later segment marks. The marks are sent to all if the manifest says that they are few."""
        marking = [s for s in segments if s["marks"]]
        if not marking:
            return rows
        marks = reduce(DataFrame.unionAll, [self.spark.read.schema("path string").parquet(f"{self._folder(s)}/marks").select(F.col("path").alias("_marked"), F.lit(s["seq"]).alias(UNTIL)) for s in marking])
        marks = marks.groupBy("_marked").agg(F.max(UNTIL).alias(UNTIL))
        marks = F.broadcast(marks) if sum(s["marks"] for s in marking) <= SMALL_MARKS else marks
        return rows.join(marks, (F.col("path") == F.col("_marked")) & (F.col(SEG) < F.col(UNTIL)), "left_anti")

    def read(self, name: str, live: bool = True, segment: bool = False, prefix: str | None = None) -> DataFrame | None:
        """Rows of a table in all segments, without the dead ones (live), with their segment's number (segment); None if no segment has the table.

        prefix: only files that may hold paths with this prefix are opened; the rows are still to be filtered.
        """
        found = self._checked()
        rows = self._raw(found["segments"], name, prefix) if found else None
        if rows is None:
            return None
        rows = self._live(rows, found["segments"]) if live else rows
        return rows if segment else rows.drop(SEG)

    def has_marks(self) -> bool:
        found = self._checked()
        return bool(found and any(s["marks"] for s in found["segments"]))

    def complete(self, name: str) -> bool:
        """Whether every segment with chunks has this table too."""
        found = self._checked()
        return bool(found) and all(name in s["tables"] for s in found["segments"] if "chunks" in s["tables"])

    # -- writing

    def begin(self) -> str:
        """A new segment's name; it counts once commit() has named it in a manifest."""
        return f"s-{uuid.uuid4().hex}"

    def made(self, segment: str, name: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/segments/{segment}/{name}")

    def put(self, segment: str, name: str, rows: DataFrame, of: str | None = None) -> DataFrame:
        """Write a table of a segment, and read it. It is computed once: its tasks write it as it comes, sorted; a large one is then dealt by ranges of its keys.

        of: the segment's table that rows are made from; if that is large, they are expected to be, and are first sorted when they are dealt.
        """
        keys, finish = LAYOUT.get(name), numbered if name == "chunks" else (lambda df: df)
        path = f"{self.root}/segments/{segment}/{name}"
        unsorted = of is not None and self._bytes(f"{self.root}/segments/{segment}/{of}") > SMALL_BYTES
        first = rows if keys is None else finish(rows if unsorted else rows.sortWithinPartitions(*keys))
        first.write.option("compression", CODEC).parquet(path)
        if keys is None:
            return self.made(segment, name, first.schema)
        if (large := self._bytes(path) > SMALL_BYTES) or unsorted:
            at, fs = self._fs(path)
            stage, _ = self._fs(f"{self.root}/segments/{segment}/_stage-{name}")
            fs.rename(at, stage)
            staged = self.spark.read.parquet(f"{self.root}/segments/{segment}/_stage-{name}").select(*rows.columns)
            dealt = _together((_apart(staged).repartitionByRange(*keys) if large else _apart(staged)).sortWithinPartitions(*keys), staged.schema)
            finish(dealt).write.option("compression", CODEC).parquet(path)
            fs.delete(stage, True)
            if keys[0] == "path":
                file = F.element_at(F.split(F.input_file_name(), "/"), -1)
                self.made(segment, name).groupBy(file.alias("file")).agg(F.min("path").alias("low"), F.max("path").alias("high")).coalesce(1).write.parquet(f"{self.root}/segments/{segment}/_bounds-{name}")
        return self.made(segment, name, first.schema)

    def _segment(self, name: str, seq: int) -> dict:
        folder = f"{self.root}/segments/{name}"
        tables = [t for t in self._names(folder) if t in LAYOUT]
        marks = self.spark.read.parquet(f"{folder}/marks").count() if self._exists(f"{folder}/marks") else 0
        return {"id": name, "seq": seq, "bytes": self._bytes(folder), "marks": marks, "tables": tables}

    def commit(self, segment: str | None, file_count: int, chunk_count: int, python_enabled: bool = True, replace: bool = False) -> dict:
        """Name the segment in a new manifest, after those in force or instead of them, merge what is due, and delete what the last KEPT manifests don't name."""
        old = None if replace and self.status() == "schema_mismatch" else self._checked()
        segments = [] if replace or old is None else old["segments"]
        seq = 1 + max([s["seq"] for s in (old["segments"] if old else [])], default=0)
        if segment is not None:
            segments = [*segments, self._segment(segment, seq)]
        segments = self._merged(segments)
        versions = self._names(f"{self.root}/manifest")
        version = 1 + max([int(v[2:]) for v in versions if v.startswith("v-")], default=0)
        kinds = [f.split()[0] for f in SEGMENT.split(", ")]
        row = (SCHEMA_VERSION, version, now(), file_count, chunk_count, python_enabled, [tuple(s[k] for k in kinds) for s in segments])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/v-{version:012d}")
        self.vacuum()
        return self.manifest()

    def vacuum(self) -> None:
        """Delete manifests but the last KEPT, and segments that none of these names."""
        versions = self._versions()
        named = {s["id"] for v in versions[-KEPT:] for s in self._manifest(v)["segments"]}
        for v in versions[:-KEPT]:
            self._delete(f"{self.root}/manifest/{v}")
        for s in self._names(f"{self.root}/segments"):
            if s not in named:
                self._delete(f"{self.root}/segments/{s}")

    # -- merging

    @staticmethod
    def tier(size: int) -> int:
        tier = 0
        while size > TIER_BYTES * FANOUT**tier:
            tier += 1
        return tier

    def _due(self, segments: list[dict]) -> tuple[int, int] | None:
        """A run of FANOUT or more neighbours up to the newest, none of a higher tier than the oldest of the run."""
        for low in range(len(segments) - FANOUT + 1):
            tiers = [self.tier(s["bytes"]) for s in segments[low:]]
            if max(tiers) == tiers[0] and tiers.count(tiers[0]) >= FANOUT:
                return low, len(segments)
        return None

    def _merged(self, segments: list[dict]) -> list[dict]:
        while (due := self._due(segments)) is not None:
            low, high = due
            segments = [*segments[:low], self.merge(segments, low, high), *segments[high:]]
        return segments

    def merge(self, segments: list[dict], low: int, high: int) -> dict:
        """One segment for segments[low:high], without their dead rows, with the number of the newest. Its marks are theirs, and none if there is nothing older."""
        name, some = self.begin(), segments[low:high]
        for table in LAYOUT:
            if table not in self.derived and (rows := self._raw(some, table)) is not None:
                rows = self._live(rows, segments[low:]) if "path" in rows.columns else rows  # centroids and terms are of no file
                self.put(name, table, rows.drop(SEG, *(["doc", "range"] if table == "chunks" else [])))
        for table, make in self.derived.items():
            if any(table in s["tables"] for s in some):
                self.put(name, table, make(self.made(name, "chunks")), "chunks")
        if low and (marking := [s for s in some if s["marks"]]):
            reduce(DataFrame.unionAll, [self.spark.read.parquet(f"{self._folder(s)}/marks") for s in marking]).distinct().write.parquet(f"{self.root}/segments/{name}/marks")
        return self._segment(name, some[-1]["seq"])

    def optimize(self) -> dict | None:
        """All segments as one."""
        found = self._checked()
        if found and len(found["segments"]) > 1:
            merged = self.merge(found["segments"], 0, len(found["segments"]))
            kinds = [f.split()[0] for f in SEGMENT.split(", ")]
            version = found["version"] + 1
            row = (SCHEMA_VERSION, version, found["last_refresh_timestamp"], found["indexed_file_count"], found["indexed_chunk_count"], found["python_enabled"], [tuple(merged[k] for k in kinds)])
            self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/v-{version:012d}")
            self.vacuum()
        return self.manifest()
