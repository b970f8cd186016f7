"""Audit events: sanitized, appended, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "seq long, timestamp string, request_id string, tool string, ok boolean, blocked boolean, error_code string, metadata map<string,string>"

# Arguments that may be logged as they are, by type.
PLAIN = {str: ("path", "glob", "file_glob", "mode"), int: ("start_line", "end_line", "top_k", "max_results", "limit"), bool: ("include_hidden", "force", "include_tests")}


def sanitized(arguments: dict) -> dict:
    """Arguments without what may hold secrets: other texts become presence and length, lists and objects their shape."""
    out: dict = {}
    for key in sorted(arguments):
        value = arguments[key]
        if isinstance(value, str) and key not in PLAIN[str]:
            out |= {f"{key}_present": True, f"{key}_length": len(value)}
        elif isinstance(value, (str, int, float, bool)) or value is None:
            out[key] = value
        elif isinstance(value, list):
            out |= {f"{key}_type": "list", f"{key}_length": len(value)}
        elif isinstance(value, dict):
            out |= {f"{key}_type": "dict", f"{key}_keys": sorted(map(str, value))}
        else:
            out[f"{key}_type"] = type(value).__name__
    return out


def sanitized_texts(rows: DataFrame, arguments: str = "arguments") -> DataFrame:
    """The same for a map column of texts, in the JVM: allowed keys pass, others become <key>_present and <key>_length."""
    entries = F.map_entries(arguments)
    plain = F.filter(entries, lambda e: e["key"].isin(*PLAIN[str]))
    marks = F.flatten(F.transform(F.filter(entries, lambda e: ~e["key"].isin(*PLAIN[str])), lambda e: F.array(F.struct(F.concat(e["key"], F.lit("_present")).alias("key"), F.lit("true").alias("value")), F.struct(F.concat(e["key"], F.lit("_length")).alias("key"), F.length(e["value"]).cast("string").alias("value")))))
    return rows.withColumn("metadata", F.map_from_entries(F.concat(plain, marks)))


def recent(events: DataFrame, since: str | None = None, limit: int = 50, order: str = "seq") -> DataFrame:
    """The last `limit` events at or after `since`, in the order of appending. Top-k before any sort."""
    kept = events if since is None else events.where(F.col("timestamp") >= since)
    return kept.orderBy(F.desc(order)).limit(max(0, limit)).orderBy(order)
