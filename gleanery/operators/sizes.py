"""Broadcasting behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table that may be sent to all executors.
SMALL_ROWS = 20_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcasting if it has few rows; otherwise as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
