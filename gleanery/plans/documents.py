"""Whole bundles as JSON and Markdown documents, one row per prompt."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.plans import bundle


def _listed(rows: DataFrame, order: str, fields: list[str], name: str, most: int | None = None) -> DataFrame:
    """(prompt_id, name): structs of fields in order, the first `most`."""
    kept = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), *fields)))
    rest = F.transform(kept if most is None else F.slice(kept, 1, most), lambda s: F.struct(*(s[f].alias(f) for f in fields)))
    return rows.groupBy("prompt_id").agg(rest.alias(name))


def documents(prompts: DataFrame, budgets: DataFrame, queries: DataFrame, kept_hits: DataFrame, judged: DataFrame, selections: DataFrame, strategy: str) -> DataFrame:
    """(prompt_id, bundle_id, document): everything about a bundle, with what was searched, kept, skipped and why.

    kept_hits are the raw hits after the filter of test paths. Every part is an aggregate per prompt over bounded lists.
    """
    sums = bundle.totals(judged)
    ids = bundle.bundle_ids(prompts, sums, selections)
    asked = _listed(queries, "query_index", ["query"], "q").select("prompt_id", F.col("q.query").alias("search_queries"))
    chosen = _listed(selections, "selection_index", ["path", "start_line", "end_line", "excerpt", "score", "source_query", "rationale", "why_selected"], "selections")
    cited = _listed(selections.withColumn("at", F.col("selection_index")), "at", ["path", "start_line", "end_line", "selection_index"], "citations")
    noted = _listed(bundle.notes(judged), "rank_position", ["note"], "n").select("prompt_id", F.col("n.note").alias("budget_enforcement"))
    signals = ["path", "start_line", "end_line", "source_query", "rank_position", "definition_match", "reference_count_in_range", "min_definition_distance", "path_name_relevance", "score", "range_size_penalty", "selected"]
    top = _listed(judged.where(F.col("rank_position") <= bundle.TOP).withColumn("selected", F.col("verdict") == "selected").withColumn("at", F.col("rank_position")), "at", signals, "top_candidates")
    skipped = _listed(judged.where("verdict <> 'selected'").withColumn("reason", F.col("verdict")), "rank_position", ["path", "start_line", "end_line", "source_query", "reason"], "top_skipped", bundle.TOP)
    counts = judged.groupBy("prompt_id").agg(F.count("*").alias("candidate_count"), F.count_if("definition_match").alias("definition_match_count"), F.count_if(F.col("reference_count_in_range") > 0).alias("reference_proximity_count"))
    before = kept_hits.groupBy("prompt_id").agg(F.count("*").alias("before"))
    rows = ids.join(budgets, "prompt_id")
    for part in (sums, asked, chosen, cited, noted, top, skipped, counts, before):
        rows = rows.join(part, "prompt_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.struct(*(zero(r).alias(r) for r in sorted(bundle.REASONS)))
    audit = F.struct(
        F.coalesce("budget_enforcement", F.array().cast("array<string>")).alias("budget_enforcement"),
        F.struct(zero("candidate_count").alias("after"), zero("before").alias("before")).alias("dedupe_counts"),
        F.struct(zero("candidate_count").alias("candidate_count"), zero("definition_match_count").alias("definition_match_count"), zero("reference_proximity_count").alias("reference_proximity_count"), "top_candidates").alias("ranking_debug"),
        "search_queries",
        F.struct(F.struct(reasons.alias("reason_counts"), "top_skipped", zero("total_skipped_candidates").alias("total_skipped_candidates")).alias("why_not_selected_summary")).alias("selection_debug"),
    )
    totals = F.struct(zero("selected_files").alias("selected_files"), zero("selected_lines").alias("selected_lines"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    whole = F.struct(audit.alias("audit"), F.struct("max_files", "max_total_lines").alias("budget"), "bundle_id", "citations", "prompt_fingerprint", "selections", F.lit(strategy).alias("strategy"), totals.alias("totals"))
    return rows.select("prompt_id", "bundle_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


def markdown(made: dict) -> str:
    """A bundle document for readers."""
    sums = made["totals"]
    out = ["# Last Context Bundle", "", *(f"- {k}: `{made[k]}`" for k in ("bundle_id", "prompt_fingerprint", "strategy")), "", "## Totals", *(f"- {k}: `{sums[k]}`" for k in ("selected_files", "selected_lines", "truncated")), "", "## Selections"]
    for i, s in enumerate(made["selections"] or [], 1):
        out += [f"### Selection {i}", f"- path: `{s['path']}`", f"- range: `{s['start_line']}`-`{s['end_line']}`", f"- score: `{s['score']}`", f"- why_selected: `{s['why_selected']}`", f"- rationale: {s['rationale']}", "", "```text", s["excerpt"], "```", ""]
    return "\n".join(out).rstrip() + "\n"


def export(document: str, folder: str) -> list[str]:
    """Writes last_bundle.json and last_bundle.md; what fails is returned as warnings."""
    made, warnings = json.loads(document), []
    for name, text in (("last_bundle.json", json.dumps(made, sort_keys=True, indent=2) + "\n"), ("last_bundle.md", markdown(made))):
        try:
            Path(folder).mkdir(parents=True, exist_ok=True)
            (Path(folder) / name).write_text(text)
        except OSError as error:
            warnings.append(f"Failed to write {name}: {error}")
    return warnings
