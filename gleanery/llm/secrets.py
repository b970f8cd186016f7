"""Secret scans with multipart credential linking."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import lean

#: Base patterns with the least length of the group that counts; runs of the last two are maximal, so a least length in the pattern drops the same matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "weak_id", "weak_key", "endpoint")
#: What a part of a credential stands for.
ROLE = {"assign": "key", "access": "id", "hex": "key", "weak_id": "id", "weak_key": "key", "endpoint": "endpoint"}
#: Weak candidates: alone they are ordinary text. A weak key mixes upper and lower case and digits.
WEAK = {
    "weak_id": re.compile(r"""(?:(?<![A-Za-z0-9])(?-i:(?:ABIA|ACCA|AGPA|AIDA|AIPA|ANPA|ANVA|APKA|AROA|ASCA|ASIA)[A-Z0-9]{12,})|(?:user(?:name)?|login|client_?id|access_?key_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,})""", re.I | re.A),
    "weak_key": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"(?:(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+amazonaws\.com|\b(?:host|endpoint|region)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:/-]{3,})", re.I | re.A),
}
#: A narrower scope than the block (between blank lines), for callers that want one: so many characters either side.
REACH = 400
BLANK = re.compile(r"\n[\x20\x09\x0B-\x0D]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)], key=lambda s: (s[0], KINDS.index(s[2])))


def linked_spans(text: str, base: list[Span], reach: int | None = REACH) -> list[Span]:
    """Weak candidates whose scope holds their complement: an identifier needs a key, a key an identifier or an endpoint, and an endpoint both others.

    The scope of a candidate is its block, cut to `reach` characters either side unless that is None. Identifiers, keys and
    endpoints are lists sorted by place; each candidate finds those that extend into its scope by bisection and passes over
    what it overlaps, so the join is n log n. A weak candidate
    that overlaps a base span is dropped, and one never links to what it overlaps.
    """
    weak: list[Span] = []
    for kind, pattern in WEAK.items():
        weak += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if not weak or not base and len({ROLE[k] for *_, k in weak}) < 2:
        return []
    starts, top = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    weak = [w for w in weak if not ((k := bisect_left(starts, w[1])) and top[k - 1] > w[0])]
    by_role: dict[str, list[tuple[int, int]]] = {"id": [], "key": [], "endpoint": []}
    for s, e, kind in sorted(base + weak):
        by_role[ROLE[kind]].append((s, e))
    reached = {role: list(accumulate((e for _, e in parts), max)) for role, parts in by_role.items()}
    cuts, reach = [m.start() for m in BLANK.finditer(text)], len(text) if reach is None else reach

    def near(role: str, span: Span) -> bool:
        k = bisect_right(cuts, span[0])
        low = max(span[0] - reach, cuts[k - 1] if k else 0)
        high = min(span[1] + reach, cuts[k] if k < len(cuts) else len(text))
        parts = by_role[role]
        for at in range(bisect_right(reached[role], low), bisect_left(parts, (high, 0))):
            s, e = parts[at]
            if e > low and (e <= span[0] or s >= span[1]):
                return True
        return False

    need = {"weak_id": lambda s: near("key", s), "weak_key": lambda s: near("id", s) or near("endpoint", s), "endpoint": lambda s: near("id", s) and near("key", s)}
    return sorted((w for w in set(weak) if need[w[2]](w)), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, text: str = "text", reach: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Base spans are reported always, weak ones if their complement is in their block (linked_spans), or
    within `reach` characters in it. Null and empty texts have no spans
    (the hash is that of the empty string); null and repeated doc_ids and repeated rows keep their rows; extra columns are
    ignored; texts of any length are scanned whole, one at a time; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py() or ""
                base = base_spans(body)
                more = linked_spans(body, base, reach)
                count = {k: sum(s[2] == k for s in base) for k in KINDS[:3]}
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append((doc_id, *count.values(), sha256(joined(base).encode()).hexdigest(), joined(every), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
