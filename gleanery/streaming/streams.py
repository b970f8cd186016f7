"""Streams: audit events, their counts per window, files that arrive, and changes of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators import audit, chunking


def audit_stream(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """Audit events as they are appended to a folder of JSON lines, at or after `since`. Stateless."""
    events = spark.readStream.schema(audit.EVENT).json(folder)
    return events if since is None else events.where(F.col("timestamp") >= since)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, by, n) per tumbling window; windows close `late` after the newest event, so state stays bounded."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def chunk_arrivals(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Chunks of (path, text) Parquet files that arrive in a folder, handed to sink batch by batch until all are read."""
    arrived = spark.readStream.schema("path string, text string").parquet(folder)
    return chunking.chunks(arrived).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a stream of listings says of a file, what the stream of changes says, and what is remembered of a path.
LISTED = "path string, size long, mtime_ns long, content_hash string, seen timestamp"
CHANGED = "path string, change string, seen timestamp"
REMEMBERED = "size long, mtime_ns long, content_hash string, seen_us long"


def file_changes(listed: DataFrame, absent: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(path, change, seen): added, updated and removed files, of a stream of listings (LISTED) in which each file that is there comes again and again.

    State is one record for each path: its last size, time and hash. A listing that differs is an update; a path that no
    listing has named for `absent` after its last one is removed by a timer of event time, and its record goes, so state is bounded by the
    files there are. Listings of one batch are taken in the order of `seen`, older ones than the record are ignored, so
    any split of the listings into batches gives the same state, and a restart goes on from the checkpoint. `seen` of a removal is the last listing's.
    """
    wait_ms = int(pd.Timedelta(absent).total_seconds() * 1000)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], "removed", pd.Timestamp(state.get[3], unit="us")))
            state.remove()
        else:
            known = state.get if state.exists else None
            rows = pd.concat(list(frames)).sort_values(["seen", "mtime_ns", "content_hash"], kind="stable")
            for size, mtime, content, seen in zip(rows["size"], rows["mtime_ns"], rows["content_hash"], rows["seen"], strict=True):
                at = pd.Timestamp(seen).value // 1000
                if known is not None and at < known[3]:
                    continue
                now = (int(size), int(mtime), content, at)
                if known is None or known[:3] != now[:3]:
                    out.append((key[0], "added" if known is None else "updated", pd.Timestamp(seen)))
                known = now
            if known is not None:
                state.update(known)
                state.setTimeoutTimestamp(known[3] // 1000 + wait_ms)
        if out:
            yield pd.DataFrame(out, columns=["path", "change", "seen"])

    rows = listed.select("path", "size", "mtime_ns", "content_hash", "seen").where("path is not null").withWatermark("seen", late)
    return rows.groupBy("path").applyInPandasWithState(follow, CHANGED, REMEMBERED, "append", GroupStateTimeout.EventTimeTimeout)
