"""The first rows of each key, with how many the key has, in stages that merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which a key's rows go between the tasks and its last stage, and rows that a task holds before it passes them on.
SALTS, HELD = 16, 100_000

Batches = Iterator[pa.RecordBatch]


def _table(batch: pa.RecordBatch, held: pa.Table | None) -> pa.Table:
    """batch after what is held; columns that may not be null are like others."""
    table = pa.Table.from_batches([batch])
    table = table.cast(pa.schema([f.with_nullable(True) for f in table.schema]))
    return table if held is None else pa.concat_tables([held, table])


def _reduced(table: pa.Table, by: str, order: list[str], k: int) -> tuple[pa.Table, np.ndarray]:
    """(rows, starts): table sorted, k rows of each key, its count on the first of them; and where keys begin."""
    at = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (by, *order)], null_placement="at_start")
    table = table.take(at)
    keys = table[by].combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1]) if len(codes) else np.zeros(0, dtype=np.int64)
    n = table["n"].to_numpy()
    counts = np.zeros(len(codes), dtype=np.int64)
    if len(codes):
        counts[starts] = np.add.reduceat(n, starts)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    keep = np.flatnonzero(place < k)
    table = table.set_column(table.schema.get_field_index("n"), "n", pa.array(counts)).take(pa.array(keep))
    return table, np.flatnonzero(place[keep] == 0)


def first_with_totals(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """rows' columns with rank (from 1) and total: the k first rows of each key `by` along `order` (ascending, nulls first), and
    how many rows the key has.

    Each task keeps k rows of a key and its count, and passes on only these; they are merged in SALTS parts of a key, and
    then by key. So a key with a third of all rows sends k rows and a number from each task, no stage sees a key whole, and
    `rows` is computed once. A task holds HELD rows, and k of a key, whatever the number of keys. Rows that are equal along `order` are interchangeable.
    """
    own = rows.columns

    def partial(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            held, _ = _reduced(_table(batch, held), by, order, k)
            if held.num_rows > HELD:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    def ranked(table: pa.Table, starts: np.ndarray) -> Batches:
        sizes = np.diff(np.append(starts, table.num_rows))
        rank = np.arange(table.num_rows) - np.repeat(starts, sizes) + 1
        totals = np.repeat(table["n"].to_numpy()[starts], sizes)
        out = table.drop_columns(["n"]).append_column("rank", pa.array(rank.astype(np.int32))).append_column("total", pa.array(totals))
        yield from out.combine_chunks().to_batches()

    def last(batches: Batches) -> Batches:
        """Rows come sorted by key: all but the last key of a batch are whole."""
        held = None
        for batch in batches:
            if batch.num_rows:
                table, starts = _reduced(_table(batch, held), by, order, k)
                held = table.slice(starts[-1])
                if starts[-1]:
                    yield from ranked(table.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from ranked(held, np.zeros(1, dtype=np.int64))

    counted = rows.withColumn("n", F.lit(1).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    some = counted.mapInArrow(partial, f"{kinds}, n long")
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    fewer = some.repartition(F.col(by), salt).mapInArrow(partial, f"{kinds}, n long")
    return fewer.repartition(by).sortWithinPartitions(by, *order).mapInArrow(last, f"{kinds}, rank int, total long").select(*own, "rank", "total")
