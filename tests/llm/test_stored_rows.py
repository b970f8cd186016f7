"""Operators that number rows give the same over tables that are not plain scans."""

import pytest
from pyspark.sql import functions as F

from gleanery.llm import line_dedup, mixing, packing, simhash, substring_dedup
from gleanery.llm.common import stored_rows

SF = "/root/testdata/sf0.001"
#: Small partitions, so that adaptive coalescing differs with the columns read.
CONF = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def rows(df):
    return sorted(map(str, df.collect()))


OPERATORS = {
    "repeats": lambda d: substring_dedup.repeats(d).select("doc_id", "start", "end", "copies", "first_doc_id", "removed"),
    "dedup_lines": lambda d: line_dedup.dedup_lines(d).select("doc_id", "text"),
    "one_of_each_group": lambda d: simhash.one_of_each_group(d).select("doc_id"),
    "repeated": lambda d: mixing.repeated(d).select("doc_id"),
    "pack": lambda d: packing.pack(d).select("doc_id", "start", "length", "ids_crc32"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_shuffled_tables_give_the_same(spark, small_partitions, name):
    stored = spark.read.parquet(f"{SF}/documents.parquet")
    want = rows(OPERATORS[name](stored))
    assert want and rows(OPERATORS[name](stored.repartition("doc_id"))) == want
    if name in ("repeated", "dedup_lines"):
        halves = stored.where("doc_id % 2 = 0").union(stored.where("doc_id % 2 = 1")).join(stored.select("doc_id").distinct(), "doc_id")
        assert rows(OPERATORS[name](halves)) == want


def test_plain_scans_are_not_written(spark):
    stored = spark.read.parquet(f"{SF}/documents.parquet")
    chosen = stored.where("doc_id > 3").select("doc_id", F.upper("text").alias("text"))
    assert stored_rows(stored) is stored and stored_rows(chosen) is chosen
    for other in (stored.repartition(3), stored.union(stored), stored.distinct(), stored.limit(5), spark.createDataFrame([(1, "x")], "doc_id long, text string")):
        assert stored_rows(other) is not other and rows(stored_rows(other).select("doc_id")) == rows(other.select("doc_id"))
