"""Repeated line runs by prefix doubling over line ids, and longest-common-prefix intervals. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, delete, fresh, kept, stash, stored_rows, to_all, with_uid

#: A single line of so many words is a passage of its own: its later copies go, whatever stands around them.
LONG = 20
_LAST = (1 << 63) - 1


def _place() -> Column:
    return F.struct("id", "uid", "seq")


def _ranked(keyed: DataFrame, level: int) -> tuple[DataFrame, str]:
    """(uid, id, seq, rank, first, level) for the places of `keyed` (uid, id, seq, a, b) whose key occurs again, and the table's path.

    `rank` (long) follows the order of (a, b): range partitioning, a sort inside, running ids. The keys' table is written
    before it is joined, since sampled range borders may differ if a lost task were run again, and so that Spark can split the
    join's partition of a very common key.
    """
    spark, name = keyed.sparkSession, f"lines-{1 << level}"
    groups = keyed.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min(_place()).alias("first")).where("copies > 1")
    groups, path = kept(groups.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()), f"{name}-groups")
    found = kept(keyed.join(groups, ["a", "b"]).select("uid", "id", "seq", "rank", "first", F.lit(level).alias("level")), name)
    delete(spark, path)
    return found


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, id, seq, pos, words, a, b) of each line with a word: row, doc_id (null last), number among such lines, place among all, words, content."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("a"), F.hash(x).cast("long").alias("b")))
    rows = with_uid(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), text))
    rows = rows.select("uid", "id", F.posexplode(F.filter(lines, lambda x: x["words"] > 0)).alias("seq", "line"))
    return rows.select("uid", "id", "seq", "line.*")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(uid, seq, length): at every place where a run of lines begins that also begins earlier, the longest such run.

    Prefix doubling, as for a suffix array: rank_1 is the order of the lines' ids, rank_2k that of pairs (rank_k here, rank_k k
    lines on). Suffixes of equal rank_k are an interval of the suffix array whose longest common prefix is k lines or more; the
    first in it (by doc_id, row, line) is the original. A suffix alone in its interval is sorted for good and leaves, so
    the rounds end at the longest repeated run, after log2 of its length. Then the prefixes are made exact: a suffix that was
    a later copy at k lines, but not at 2k, shares between k and 2k lines with an earlier one. Its interval is split by the
    ranks of k/2, k/4, ..., 1 lines behind what is known; wherever a suffix is not the first of its part, its prefix is that much longer. The first of
    each part stays in the whole interval too, for the suffixes that did not grow: it stands for all of its part. So
    each suffix of an interval is compared with groups, never with other suffixes one by one.
    """
    spark = lines.sparkSession
    ranks: list[tuple[DataFrame, str]] = [_ranked(lines.select("uid", "id", "seq", "a", "b"), 0)]
    while not ranks[-1][0].isEmpty():
        by = 1 << (len(ranks) - 1)
        at = ranks[-1][0].select("uid", "id", "seq", F.col("rank").alias("a"))
        on = ranks[-1][0].select("uid", (F.col("seq") - by).alias("seq"), F.col("rank").alias("b"))
        ranks.append(_ranked(at.join(on, ["uid", "seq"]), len(ranks)))
    empty = lines.select("uid", "seq", F.lit(0).alias("length")).limit(0)
    if len(ranks) == 1:
        delete(spark, ranks[0][1])
        return empty
    # state: a suffix in an interval (level, group) that shares `length` lines; target: its prefix is sought, else it is the first one.
    # All levels are read as one table, so that the plan is as large for any number of them.
    later = spark.read.schema(ranks[0][0].schema).parquet(*(p for _, p in ranks)).where(_place() != F.col("first"))
    ends = later.join(later.select("uid", "seq", (F.col("level") - 1).alias("level")), ["uid", "seq", "level"], "left_anti")
    heads = ends.groupBy("level", "rank").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"), F.col("first.id").alias("id"), F.col("first.seq").alias("seq"), "rank", "level")
    own = ends.select("uid", "id", "seq", "rank", "level", F.lit(True).alias("target")).unionAll(heads.select("uid", "id", "seq", "rank", "level", F.lit(False).alias("target")))
    state = own.select("uid", "id", "seq", F.xxhash64("level", "rank").alias("g1"), F.hash("level", "rank").alias("g2"), F.expr("shiftleft(1, level)").alias("length"), "target")
    state, path = kept(state, "lines-state")
    for level in range(len(ranks) - 3, -1, -1):
        step = 1 << level
        on = ranks[level][0].select("uid", F.col("seq").alias("on"), F.col("rank").alias("next"))
        joined = state.withColumn("on", F.col("seq") + F.col("length"))
        # shorter ones are of a lower level; what goes on as some other place does has a rank there
        open_, open_path = kept(joined.where(F.col("length") > step).join(on, ["uid", "on"], "left").drop("on"), "lines-open")
        parts = open_.where("next is not null").groupBy("g1", "g2", "next").agg(F.count("*").alias("n"), F.min(_place()).alias("head"))
        parts, parts_path = kept(parts.where("n > 1"), "lines-parts")
        split = open_.join(parts, ["g1", "g2", "next"], "left").withColumn("grows", F.coalesce(_place() != F.col("head"), F.lit(False)))
        deeper = [F.xxhash64("g1", "g2", "next", F.lit(level)).alias("g1"), F.hash("g1", "g2", "next", F.lit(level)).alias("g2"), (F.col("length") + step).alias("length")]
        grown = split.where("grows").select("uid", "id", "seq", *deeper, "target")
        heads = split.where("n is not null and not grows").select("uid", "id", "seq", *deeper, F.lit(False).alias("target"))
        stay = split.where("not grows").select("uid", "id", "seq", "g1", "g2", "length", "target")
        done = state.where(F.col("length") <= step)
        last = path
        state, path = kept(done.unionAll(stay).unionAll(grown).unionAll(heads), f"lines-state-{step}")
        delete(spark, last, open_path, parts_path)
    delete(spark, *(p for _, p in ranks))
    return state.where("target").select("uid", "seq", "length")


def dedup_lines(docs: DataFrame, min_lines: int = 2, text: str = "text", long_words: int | None = LONG, report: bool = True) -> DataFrame:
    """docs without later copies of line runs: the columns of docs, `text` changed; with report n_lines, n_removed, longest_run
    too, which replace columns of docs of these names.

    A line is what \\n separates; lines without words are not part of runs, and stay, unless all other lines of their document
    go: then the text is empty. A run of lines is a later copy if it also occurs earlier, by (doc_id, row, line); runs may
    overlap. Of every maximal later copy of `min_lines` lines or more all lines go, and so do single later copies of lines of
    `long_words` words or more (None: no such rule). longest_run is the number of lines of the longest later copy in the
    document, 0 if that is under min_lines. Null texts stay null with no lines; null doc_ids come last; repeated rows are copies
    of each other, the first stays whole; very long texts cost as many rows as lines; an empty table gives an empty
    result; all other columns are kept, whatever their names. Texts are shuffled only if the list of lines to delete is too large to broadcast.
    """
    docs = stored_rows(docs)
    lines = stash(line_table(docs, text), "lines-all")
    runs = stash(repeated_runs(lines), "lines-runs")
    uid, of, gone, n, longest = fresh(docs, "uid", "of", "gone", "n", "longest")
    whole = F.col("length") >= min_lines
    # a run that begins where the one before it goes on adds its last lines only: one line, as a rule
    before = runs.select("uid", (F.col("seq") + 1).alias("seq"), (F.col("length") - 1).alias("known"))
    ends = runs.where(whole).join(before.where(F.col("known") >= min_lines - 1), ["uid", "seq"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    new = ends.where("length > known").select("uid", F.explode(F.sequence(F.col("seq") + F.col("known"), F.col("seq") + F.col("length") - 1)).alias("seq"))
    covered = new.select("uid", "seq").distinct().join(lines.select("uid", "seq", "pos"), ["uid", "seq"]).select("uid", "pos")
    if long_words is not None:
        single = runs.join(lines.where(F.col("words") >= long_words).select("uid", "seq", "pos"), ["uid", "seq"]).select("uid", "pos")
        covered = covered.unionAll(single).distinct()
    most = runs.groupBy("uid").agg(F.max(F.when(whole, F.col("length")).otherwise(0)).alias(longest))
    cut = covered.groupBy("uid").agg(F.collect_list("pos").alias(gone)).join(most, "uid").withColumnRenamed("uid", of)
    joined = with_uid(docs, uid).join(to_all(*kept(cut, "lines-removed")), F.col(uid) == F.col(of), "left")
    # of rows that lose nothing the number of lines is not asked unless it is reported
    count = F.greatest(F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))), F.lit(0)), F.lit(0)).cast("long")
    joined = joined.withColumn(n, count if report else F.when(F.col(gone).isNotNull(), count))

    def without(all_parts: Column) -> Column:  # the outer array binds the split text once
        rest = F.array_except(F.sequence(F.lit(0), F.size(all_parts) - 1), F.col(gone))
        return F.array_join(F.transform(rest, lambda i: F.get(all_parts, i)), "\n")

    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    rest = F.get(F.transform(F.array(F.split(text, "\n")), without), F.lit(0))
    after = F.when(F.col(gone).isNull(), F.col(text)).when(F.col(n) == removed, F.lit("")).otherwise(rest)
    if not report:
        return joined.withColumn(text, after).drop(uid, of, gone, n, longest)
    kept_columns = [after.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", "longest_run")]
    return joined.select(*kept_columns, F.col(n).alias("n_lines"), removed.alias("n_removed"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest_run"))
