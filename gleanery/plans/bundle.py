"""Context bundles: multi-query search, alignment, ranking, budget and explanation, for batches of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import paths
from gleanery.functions import text as T
from gleanery.operators import intervals

# Fixed values of the contract.
MAX_KEYWORDS, LEAST_KEYWORD, FAR, TOP = 8, 3, 1_000_000_000, 20
REASONS = ("file_budget", "line_budget", "zero_lines", "other")
PLACE = ["prompt_id", "path", "start_line", "end_line"]


def keywords(prompt: str | Column) -> Column:
    """The first eight different tokens of three characters or more."""
    return F.slice(F.array_distinct(F.filter(T.tokens(prompt), lambda t: F.length(t) >= LEAST_KEYWORD)), 1, MAX_KEYWORDS)


def queries(prompts: DataFrame, base_top_k: int) -> DataFrame:
    """(prompt_id, query_index, query, k): the prompt itself, then its keywords, which get a quarter of the hits, five at least."""
    rows = prompts.select("prompt_id", F.posexplode(F.concat(F.array("prompt"), keywords("prompt"))).alias("query_index", "query"))
    base = max(1, base_top_k)
    return rows.withColumn("k", F.when(F.col("query_index") == 0, base).otherwise(min(base, max(5, base_top_k // 4))))


def align(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hits with the range and name (aligned_symbol) of the smallest symbol range on the path that overlaps; without one they stay.

    hits: hit_id, path, start_line, end_line and more. A range overlaps if it begins inside the hit, or begins before it and goes on
    to its first line. Each is an equi-join by binary blocks of lines: ranges and places meet in the blocks that
    make up the one and contain the other, and a block keeps its smallest range only. So rows grow with the inputs
    times the logarithm of a line number, however many hits and symbols a file has.
    """
    usable = symbols.where(T.blank_to_null("name").isNotNull() & T.blank_to_null("kind").isNotNull() & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    ranges = usable.select("path", F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), "name", "kind").alias("range"))
    spots = hits.select("hit_id", "path", F.greatest("start_line", F.lit(1)).alias("a"), F.col("end_line").alias("b"))
    inside, through = F.lit(0).alias("way"), F.lit(1).alias("way")
    begun = ranges.select("path", "range", inside, F.explode(intervals.containing(F.col("range.s"))).alias("block"))
    open_ = ranges.select("path", "range", through, F.explode(intervals.covering(F.col("range.s") + 1, F.col("range.e"))).alias("block"))
    least = begun.unionAll(open_).select("path", "way", "block.level", "block.at", "range").groupBy("path", "way", "level", "at").agg(F.min("range").alias("range"))
    within = spots.select("hit_id", "path", inside, F.explode(intervals.covering(F.col("a"), F.col("b"))).alias("block"))
    at_start = spots.select("hit_id", "path", through, F.explode(intervals.containing(F.col("a"))).alias("block"))
    asked = within.unionAll(at_start).select("hit_id", "path", "way", "block.level", "block.at")
    best = asked.join(least, ["path", "way", "level", "at"]).groupBy("hit_id").agg(F.min("range").alias("range"))
    joined = hits.join(best, "hit_id", "left")
    return joined.withColumns({"start_line": F.coalesce("range.s", "start_line"), "end_line": F.coalesce("range.e", "end_line"), "aligned_symbol": F.col("range.name")}).drop("range")


def dedupe(hits: DataFrame) -> DataFrame:
    """The best hit of each place: highest score, then smallest query, then earliest."""
    order = Window.partitionBy(*PLACE).orderBy(F.desc("score"), "source_query", "hit_id")
    return hits.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def proximity(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """hits with reference_count_in_range and min_definition_distance, from reference lines (symbol, path, line) of the aligned symbol on the path: an as-of join on either side of the hit."""
    lines = refs.where("line >= 1").select("symbol", "path", F.col("line").cast("long").alias("line")).distinct()
    keyed = hits.select("hit_id", "path", F.col("aligned_symbol").alias("symbol"), F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("b")).where("symbol is not null")
    near = intervals.nearest_and_inside(keyed, lines, ["symbol", "path"], "line")
    distance = F.when(F.col("inside") > 0, F.lit(0)).otherwise(F.least(F.col("a") - F.col("before"), F.col("after") - F.col("b")))
    found = near.where("inside > 0 or before is not null or after is not null").select("hit_id", F.col("inside").alias("c"), distance.alias("d"))
    return hits.join(found, "hit_id", "left").withColumns({"reference_count_in_range": F.coalesce("c", F.lit(0)).cast("long"), "min_definition_distance": F.coalesce("d", F.lit(FAR)).cast("long")}).drop("c", "d")


def ranked(hits: DataFrame, prompts: DataFrame) -> DataFrame:
    """hits (with proximity) and the other signals, and rank_position by the total order of eleven keys."""
    terms = prompts.select("prompt_id", F.array_distinct(T.tokens("prompt")).alias("prompt_terms"))
    symbol_terms = T.tokens(F.regexp_replace("aligned_symbol", r"\.", " "))
    path_terms = F.array_distinct(T.tokens(F.regexp_replace("path", "[/.]", " ")))
    signals = hits.join(terms, "prompt_id").withColumns(
        {
            "definition_match": F.coalesce(F.arrays_overlap(symbol_terms, F.col("prompt_terms")), F.lit(False)),
            "path_name_relevance": F.size(F.array_intersect(path_terms, F.col("prompt_terms"))).cast("long"),
            "range_size_penalty": F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1).cast("long"),
            "candidate_id": F.concat_ws(":", "path", "start_line", "end_line", "source_query"),
        }
    )
    order = Window.partitionBy("prompt_id").orderBy(
        F.desc("definition_match"), F.desc("reference_count_in_range"), "min_definition_distance", F.desc("path_name_relevance"), F.desc("score"), "range_size_penalty", "path", "start_line", "end_line", "source_query", "candidate_id"
    )
    return signals.withColumn("rank_position", F.row_number().over(order)).drop("prompt_terms")


def verdicts(candidates: DataFrame, budgets: DataFrame) -> DataFrame:
    """candidates (prompt_id, rank_position, path, start_line, end_line, ...) with `verdict`: selected, or why not.

    Each skip changes nothing and each selection uses budget, so this is a fold in rank order; a prompt's candidates are
    bounded by its queries' hit limits. budgets: prompt_id, max_files, max_total_lines.
    """
    size = F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)
    rows = candidates.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("rank_position", "path", size.alias("size")))).alias("rows")).join(budgets, "prompt_id")
    empty = F.struct(F.array().cast("array<string>").alias("files"), F.lit(0).alias("lines"), F.array().cast("array<string>").alias("verdicts"))

    def step(acc: Column, row: Column) -> Column:
        known = F.array_contains(acc["files"], row["path"])
        files = F.size(acc["files"]) + F.when(known, 0).otherwise(1)
        verdict = F.when(row["size"] == 0, "zero_lines").when(files > F.col("max_files"), "file_budget").when(acc["lines"] + row["size"] > F.col("max_total_lines"), "line_budget").otherwise("selected")
        taken = verdict == "selected"
        return F.struct(
            F.when(taken & ~known, F.concat(acc["files"], F.array(row["path"]))).otherwise(acc["files"]).alias("files"),
            F.when(taken, acc["lines"] + row["size"]).otherwise(acc["lines"]).alias("lines"),
            F.concat(acc["verdicts"], F.array(verdict)).alias("verdicts"),
        )

    folded = rows.select("prompt_id", "rows", F.aggregate("rows", empty, step)["verdicts"].alias("verdicts"))
    flat = folded.select("prompt_id", F.explode(F.zip_with("rows", "verdicts", lambda r, v: F.struct(r["rank_position"].alias("rank_position"), v.alias("verdict")))).alias("x")).select("prompt_id", "x.rank_position", "x.verdict")
    return candidates.join(flat, ["prompt_id", "rank_position"])


def totals(judged: DataFrame) -> DataFrame:
    """Per prompt: selected_files, selected_lines, truncated, total_skipped_candidates and a count for each reason."""
    chosen = F.col("verdict") == "selected"
    return judged.groupBy("prompt_id").agg(
        F.count_distinct(F.when(chosen, F.col("path"))).alias("selected_files"),
        F.coalesce(F.sum(F.when(chosen, F.col("end_line") - F.col("start_line") + 1)), F.lit(0)).cast("long").alias("selected_lines"),
        F.coalesce(F.bool_or(F.col("verdict").isin("file_budget", "line_budget")), F.lit(False)).alias("truncated"),
        F.count_if(~chosen).alias("total_skipped_candidates"),
        *(F.count_if(F.col("verdict") == r).alias(r) for r in REASONS),
    )


def explained(judged: DataFrame, corpus: DataFrame) -> DataFrame:
    """The selections, with selection_index, excerpt, rationale and why_selected; a citation is its index and range."""
    chosen = judged.where("verdict = 'selected'").withColumn("selection_index", F.row_number().over(Window.partitionBy("prompt_id").orderBy("rank_position")) - 1)
    texts = corpus.select("path", T.lines("text").alias("lines"))
    terms = F.when(F.size("matched_terms") > 0, F.array_join("matched_terms", ", ")).otherwise("none")
    rationale = F.concat(F.format_string("Selected from query '%s' with score %.6f; matched_terms=%s.", "source_query", "score", terms), F.coalesce(F.concat(F.lit(" aligned_symbol="), "aligned_symbol", F.lit(".")), F.lit("")))
    signals = F.array_compact(F.array(F.lit("search_score"), F.when(F.size("matched_terms") > 0, "matched_terms"), F.when(F.col("definition_match"), "definition_match"), F.when(F.col("reference_count_in_range") > 0, "reference_proximity"), F.when(F.col("aligned_symbol").isNotNull(), "aligned_symbol")))
    components = F.struct(F.col("score").alias("search_score"), "definition_match", "reference_count_in_range", "min_definition_distance", "path_name_relevance", "range_size_penalty")
    why = F.struct(signals.alias("matched_signals"), components.alias("score_components"), "source_query", "matched_terms", F.col("aligned_symbol").alias("symbol_reference"))
    joined = chosen.join(texts, "path", "left").withColumn("excerpt", F.coalesce(T.line_slice("lines", F.col("start_line"), F.col("end_line")), F.lit("")))
    return joined.select("prompt_id", "selection_index", "path", "start_line", "end_line", "excerpt", "score", "source_query", rationale.alias("rationale"), why.alias("why_selected"))


def notes(judged: DataFrame) -> DataFrame:
    """(prompt_id, rank_position, note) of skipped candidates."""
    return judged.where("verdict <> 'selected'").select("prompt_id", "rank_position", F.format_string("skipped_%s:%s:%d-%d", "verdict", "path", "start_line", "end_line").alias("note"))


def candidates(hits: DataFrame, prompts: DataFrame, symbols: DataFrame | None, refs: DataFrame | None, include_tests: bool = False) -> DataFrame:
    """Ranked candidates from the raw hits of all queries: prompt_id, query_index, source_query, path, start_line, end_line, score, matched_terms."""
    kept = hits if include_tests else hits.where(~paths.test_path("path"))
    kept = kept.withColumn("hit_id", F.concat_ws(":", "prompt_id", F.lpad(F.col("query_index").cast("string"), 3, "0"), "path", "start_line", "end_line"))
    aligned = align(kept, symbols) if symbols is not None else kept.withColumn("aligned_symbol", F.lit(None).cast("string"))
    best = dedupe(aligned)
    near = proximity(best, refs) if refs is not None else best.withColumns({"reference_count_in_range": F.lit(0).cast("long"), "min_definition_distance": F.lit(FAR).cast("long")})
    return ranked(near, prompts)


def bundle_ids(prompts: DataFrame, sums: DataFrame, selections: DataFrame) -> DataFrame:
    """(prompt_id, prompt_fingerprint, bundle_id): ids follow from the prompt, the totals and the selections alone."""
    listed = selections.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("selection_index", "path", "start_line", "end_line", "excerpt", "source_query"))).alias("selections"))
    rows = prompts.select("prompt_id", F.sha2("prompt", 256).alias("prompt_fingerprint")).join(sums, "prompt_id", "left").join(listed, "prompt_id", "left")
    return rows.select("prompt_id", "prompt_fingerprint", F.sha2(F.to_json(F.struct("prompt_fingerprint", "selected_files", "selected_lines", "truncated", "selections")), 256).alias("bundle_id"))
