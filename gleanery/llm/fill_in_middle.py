"""Fill-in-the-middle samples, made by SQL of an embedded database over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import lean
from gleanery.llm.words import ranges

#: The marks of the parts, the share of rows that change, and the share of those whose suffix comes first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST, SEED = 50, 80, 42
#: A unit is a word with the blanks before it, or the blanks at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Bytes of text that the database sees at once (at least one text), and what it may hold in memory before it says so.
BYTES, MEMORY = 1 << 22, "1GB"

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string, restored string"

#: $-names are filled in by sample(). The restored text is read from output and form alone: a mark never begins inside another, so the first one found is the mark itself.
SQL = """
WITH units AS (
  SELECT doc_id, coalesce(body, '') AS body, regexp_extract_all(coalesce(body, ''), '$unit') AS u, sha256('$seed:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch
), drawn AS (
  SELECT doc_id, body, u, len(u) AS n, [CAST('0x' || substr(h, 1 + 8 * k, 8) AS UBIGINT) FOR k IN [0, 1, 2, 3]] AS d FROM units
), cut AS (
  SELECT doc_id, body, u, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
         CASE WHEN body = '' OR contains(body, '$P') OR contains(body, '$S') OR contains(body, '$M') OR d[3] % 100 >= $changed THEN 'plain'
              WHEN d[4] % 100 < $first THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, body, n, form, array_to_string(list_slice(u, 1, low), '') AS prefix, array_to_string(list_slice(u, low + 1, high), '') AS middle,
         array_to_string(list_slice(u, high + 1, n), '') AS suffix
  FROM cut
), made AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
         CASE form WHEN 'plain' THEN body WHEN 'psm' THEN concat('$P', prefix, '$S', suffix, '$M', middle) ELSE concat('$S', suffix, '$P', prefix, '$M', middle) END AS output
  FROM parts
), seen AS (
  SELECT *, strpos(output, '$P') AS p, strpos(output, '$S') AS s, strpos(output, '$M') AS m FROM made
), undone AS (
  SELECT *, CASE form WHEN 'plain' THEN output
                      WHEN 'psm' THEN concat(substr(output, 4, s - 4), substr(output, m + 3), substr(output, s + 3, m - s - 3))
                      ELSE concat(substr(output, p + 3, m - p - 3), substr(output, m + 3), substr(output, 4, p - 4)) END AS restored
  FROM seen
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars,
       sha256(output) AS output_sha256, sha256(restored) AS restored_sha256, $out
FROM undone
"""

_databases: list = []


def _database():
    """The worker's own database, in memory, kept between tasks: one thread, and nothing on a local disk."""
    if not _databases:
        import duckdb

        _databases.append(duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}))
    return _databases[0]


def statement(texts: bool) -> str:
    filled = SQL
    for name, value in {"unit": UNIT, "seed": SEED, "changed": CHANGED, "first": SUFFIX_FIRST, "P": PREFIX, "S": SUFFIX, "M": MIDDLE, "out": "output, restored" if texts else "CAST(NULL AS VARCHAR) AS output, CAST(NULL AS VARCHAR) AS restored"}.items():
        filled = filled.replace(f"${name}", str(value))
    return filled


def transform(docs: DataFrame, text: str = "text", texts: bool = True) -> DataFrame:
    """A fill-in-the-middle sample of each row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output, restored.

    Draws follow the sha256 of seed and doc_id, so reruns, repeated rows and any partitioning agree. Whole texts are cut, of any
    length; the database sees some BYTES of them at once. Form is plain for empty and null texts (n is 0, both
    hashes are of the empty text), for texts that contain a mark already, and for those not drawn; a null doc_id draws as
    the empty text. texts=False leaves output and restored null. Extra columns are ignored; an empty table gives an empty
    result. No shuffle, no Python for a row; a lost executor costs its tasks.
    """
    query = statement(texts)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.string()), ("restored", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        database = _database()
        for batch in batches:
            for low, high in ranges(batch.column(1), BYTES):
                database.register("batch", pa.Table.from_batches([batch.slice(low, high - low)]))
                try:
                    yield from database.sql(query).to_arrow_table().cast(schema).to_batches()
                finally:
                    database.unregister("batch")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")).mapInArrow(lean(run), SCHEMA)
