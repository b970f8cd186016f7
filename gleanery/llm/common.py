"""What the training-data operators share: words, row ids, caches of workers, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java and Python regular expressions both read it. bytes.split() without arguments yields the same words.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own on this machine
    in local mode (tests), and an error on a cluster, whose executors would not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    return _own_dirs[app]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and the table's path: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str) -> DataFrame:
    return kept(df, name)[0]


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, by the paths that kept() gave."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A written table of up to so many bytes is sent to all tasks.
SMALL_BYTES = 16 << 20


def to_all(df: DataFrame, path: str) -> DataFrame:
    """A table that kept() wrote, as the small side of a join with texts: sent to all tasks if its files are small (measured), else shuffled and hashed, so that texts are not sorted."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if size <= SMALL_BYTES else df.hint("shuffle_hash")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end: for callers that write out an operator's result inside."""
    _scopes.append(mine := [])
    try:
        yield
    finally:
        _scopes.remove(mine)
        delete(spark, *mine)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() gives, written; what it wrote on its way is deleted."""
    with scratch(spark):
        out, path = make(), f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, made longer until no column of docs has them: for helper columns beside a user's own."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: What a plan may consist of if its rows are to be numbered alike in every scan.
PLAIN_SCAN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "DataSourceV2Relation", "RelationV2"}


def stored_rows(docs: DataFrame) -> DataFrame:
    """docs if it is a scan of a stored table, with columns and rows chosen at most; else its rows, written and read back.

    Operators that number rows by with_uid() more than once begin with this: after a shuffle, a union or a join the numbers
    would follow partitions that depend on the columns read.
    """
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in PLAIN_SCAN:
            return stash(docs, "rows")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return docs


def with_uid(docs: DataFrame, name: str = "uid") -> DataFrame:
    """docs with a row id, so that repeated doc_ids stay apart.

    The id follows the scan's splits, so docs has to be a stored table (stored_rows() sees to that). Spark splits small inputs by the number of cores, which
    changes when executors come or go; the number it starts from is therefore fixed for the session, so that every later
    scan of the same files gives the same ids. A lost task gets the same ids anyhow.
    """
    spark, key = docs.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism))
    return docs.withColumn(name, F.monotonically_increasing_id())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, with a worker's free memory given back at the end of each task: workers outlive their tasks."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


class Recent:
    """A worker's cache of `size` entries or little more, in two generations: what was not asked for since the last turn goes."""

    def __init__(self, size: int):
        self.half, self.young, self.old = size // 2, {}, {}

    def missing(self, keys: set) -> set:
        """Which of the keys are not held; the others are in `young` after this."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        absent = keys.difference(self.young)
        again = {k: self.old[k] for k in absent if k in self.old}  # not absent.intersection(), which would walk through all of `old`
        self.young.update(again)
        return absent.difference(again)

    def values(self, keys: pa.Array, make: Callable[[pa.Array], list]) -> list:
        """The values of distinct keys (texts); make gives those that are not held."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        names = keys.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, names))
        absent = [k for k, x in enumerate(found) if x is None]
        if self.old:
            for k in absent:
                found[k] = self.old.get(names[k])
        new = [k for k in absent if found[k] is None]
        if new:
            for k, x in zip(new, make(keys.take(pa.array(new, pa.int64()))), strict=True):
                found[k] = x
        self.young.update((names[k], found[k]) for k in absent)
        return found
