"""A directory tree as a Spark source, for batches and for streams of listings.

    register(spark)
    spark.read.format("gleanery_files").option("root", "/path").load()             # path, size, mtime_ns
    spark.readStream.format("gleanery_listings").option("root", "/path").load()    # a listing at each trigger, for streams.file_changes()

Root is in a file system that driver and executors mount. Filters on the start and end of the path and on the size are taken
into the listing: whole directories outside a prefix are not entered. Spark asks for spark.sql.python.filterPushdown.enabled
to be true in a session that reads a source with filters; the caller sets it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from gleanery.sources.corpus import CANDIDATES, LISTED, _entries


@dataclass(frozen=True)
class Wanted:
    """What filters ask of a file."""

    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None

    def has(self, path: str, size: int) -> bool:
        return all(map(path.startswith, self.prefixes)) and all(map(path.endswith, self.suffixes)) and (self.least is None or size >= self.least) and (self.most is None or size <= self.most)

    def may_hold(self, directory: str) -> bool:
        """Whether a file below a directory may have all prefixes."""
        below = f"{directory}/"
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def taken(self, f: Filter) -> Wanted | None:
        """These wishes and a filter's, or None if the listing can't tell."""
        if isinstance(f, StringStartsWith) and f.attribute == ("path",):
            return replace(self, prefixes=(*self.prefixes, f.value))
        if isinstance(f, StringEndsWith) and f.attribute == ("path",):
            return replace(self, suffixes=(*self.suffixes, f.value))
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("size",) and isinstance(f.value, int):
            low = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f))
            high = {EqualTo: f.value, LessThan: f.value - 1, LessThanOrEqual: f.value}.get(type(f))
            return replace(self, least=max(x for x in (self.least, low, 0) if x is not None), most=min((x for x in (self.most, high) if x is not None), default=None))
        return None


@dataclass
class Part(InputPartition):
    """Files that the planner has found, or a directory that a task lists with all below."""

    files: list[tuple[str, int, int]] = field(default_factory=list)
    directory: str | None = None
    seen: float = 0.0


class _Tree:
    def __init__(self, options: dict):
        if not options.get("root"):
            raise ValueError("the option root names the directory")
        self.root, self.excluded = options["root"], tuple(x for x in options.get("excluded", "").split(",") if x)
        self.wanted = Wanted()

    def plan(self) -> list[Part]:
        """The planner lists the upper directories, until it knows LISTED that are not listed yet; each of those is a task."""
        found, todo = [], [""]
        while todo and len(todo) < LISTED:
            files, directories = _entries(self.root, todo.pop(0), self.excluded)
            found += [f for f in files if self.wanted.has(f[0], f[1])]
            todo += [d for d in directories if self.wanted.may_hold(d)]
        return [Part(files=found), *(Part(directory=d) for d in todo)]

    def rows(self, part: Part) -> Iterator[tuple[str, int, int]]:
        yield from part.files
        left = [part.directory] if part.directory is not None else []
        while left:
            files, directories = _entries(self.root, left.pop(), self.excluded)
            left += [d for d in directories if self.wanted.may_hold(d)]
            yield from (f for f in files if self.wanted.has(f[0], f[1]))


class Listing(_Tree, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            taken = self.wanted.taken(f)
            if taken is None:
                yield f
            else:
                self.wanted = taken

    def partitions(self) -> list[Part]:
        return self.plan()

    def read(self, part: Part):
        yield from self.rows(part)


class Listings(_Tree, DataSourceStreamReader):
    """A whole listing at each trigger; its offset is the time."""

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [replace(p, seen=end["ms"] / 1000) for p in self.plan()]

    def read(self, part: Part):
        at = datetime.fromtimestamp(part.seen, tz=UTC)
        for path, size, mtime in self.rows(part):
            yield path, size, mtime, None, at


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleanery_files"

    def schema(self) -> str:
        return CANDIDATES

    def reader(self, schema) -> Listing:
        return Listing(dict(self.options))


class ListingsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleanery_listings"

    def schema(self) -> str:
        return f"{CANDIDATES}, content_hash string, seen timestamp"

    def streamReader(self, schema) -> Listings:
        return Listings(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
    spark.dataSource.register(ListingsSource)
