"""The prefix trie of conversations, with subtree totals by leaf peeling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, delete, kept, lean, settled

#: The contract's rebuilding: conversations of each FAMILY of ids share up to LONGEST - 1 first turns.
FAMILY, LONGEST = 20, 4
#: Rows of one conversation that a window holds together; longer ones are summed block by block.
BLOCK = 1024
#: Ids in one piece of a list of ids.
PIECE = 256

NODE = ["conv_id", "n_convs"]


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): turns (conv_id, pos from 1, digest, words) in order, and (conv_id, total).

    Turns stand by turn (null first); those of one turn by the md5 of role's byte length, a colon, role and text, which is also
    their digest. Null role or text is empty; rows without conv_id belong to no conversation. A sort by range
    spreads one conversation of any length over tasks; its positions follow from the counts of its parts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", "turn", "digest", "salt"]  # the salt spreads equal rows
    placed = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed, _ = kept(placed.select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("seq")), "trie-placed")
    placed = placed.withColumn("part", F.shiftright("seq", 33))
    parts, _ = kept(placed.groupBy("conv_id", "part").agg(F.min("seq").alias("least"), F.count("*").alias("n")), "trie-parts")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts, _ = kept(parts.select("conv_id", "part", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total")), "trie-starts")
    turns = placed.join(parts.drop("total"), ["conv_id", "part"]).select("conv_id", (F.col("seq") - F.col("least") + 1 + F.col("start")).alias("pos"), "digest", "words")
    return turns, parts.where("start = 0").select("conv_id", "total")


def with_shared_openings(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of rebuilt conversations: (conv_id, depth, digest, words, length) and (conv_id, length).

    A conversation c begins with the first h turns of the first of its family, and goes on with its own after its first h. A
    family's opening has LONGEST - 1 turns at most and goes to FAMILY members (twice as many around zero), so no key is hot.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST
    plan = convs.withColumns({"base": base, "h": h})
    first = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    plan = plan.join(first, "base", "left").withColumn("m", F.least("h", F.coalesce("base_total", F.lit(0))))
    plan, _ = kept(plan.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    own = turns.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "digest", "words", "length")
    heads = turns.where((F.col("pos") < LONGEST) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    opened = plan.join(heads, "base").where("pos <= m").select("conv_id", F.col("pos").alias("depth"), "digest", "words", "length")
    return kept(own.unionByName(opened), "trie-turns")[0], plan.select("conv_id", "length")


def running(rows: DataFrame, keys: list[str], order: str, sums: list[str], name: str) -> DataFrame:
    """rows with run_<column> for each of sums: its running sum within keys along `order`, whose values are dense and not
    below 0. A window holds BLOCK rows of a key at most; sums of whole blocks, of which there are few, stand before it."""
    rows = rows.withColumn("block", F.floor(F.col(order) / BLOCK))
    whole = rows.groupBy(*keys, "block").agg(*(F.sum(c).alias(f"off_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = kept(whole.select(*keys, "block", *(F.sum(f"off_{c}").over(before).alias(f"off_{c}") for c in sums)).where(f"off_{sums[0]} is not null"), name)
    within = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(offsets, [*keys, "block"], "left").withColumns({f"run_{c}": F.sum(c).over(within) + F.coalesce(f"off_{c}", F.lit(0)) for c in sums})
    return summed.drop("block", *(f"off_{c}" for c in sums))


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(k), depth.cast("long"), *sums) for k in (1, 2)]


def _steps(turns: DataFrame) -> DataFrame:
    """turns with the keys of their node (k1, k2) and its parent (q1, q2): hashes of depth and the sum, up to there, of hashes of (depth, digest), kept as four numbers of 32 bits."""
    halves = [F.xxhash64(F.lit(k), F.col("depth").cast("long"), "digest") for k in (1, 2)]
    pieces = {f"e{i}": c for i, c in enumerate(x for e in halves for x in (e.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(e, 32)))}
    summed = running(turns.withColumns(pieces), ["conv_id"], "depth", list(pieces), "trie-offsets")
    here, above = [F.col(f"run_{e}") for e in pieces], [F.col(f"run_{e}") - F.col(e) for e in pieces]
    (k1, k2), (q1, q2) = _key(F.col("depth"), here), _key(F.col("depth") - 1, above)
    return summed.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", (F.col("depth") == F.col("length")).alias("last"), k1.alias("k1"), k2.alias("k2"), q1.alias("q1"), q2.alias("q2"))


def peeled(segments: DataFrame) -> DataFrame:
    """(conv_id, n_convs, leaves, saved): totals of each segment's subtree, by leaf peeling. segments: conv_id, n_convs, up_conv, up_n (its parent, null for the root) and its own saved.

    Each waiting segment counts the children it has not heard of. In a round those that wait for none are done and send their
    totals to their parents, summed before the shuffle, so that a parent of very many children gets a row from each task. There are as
    many rounds as the trie of segments is high, over what still waits only; a round is a written table, so a lost
    executor costs tasks of one round.
    """
    spark = segments.sparkSession
    children = segments.where("up_n is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("remaining"))
    waiting, path = kept(segments.join(children, NODE, "left").select(*NODE, "up_conv", "up_n", "saved", F.coalesce("remaining", F.lit(0)).alias("remaining"), F.lit(0).cast("long").alias("leaves")), "trie-waiting")
    done = []
    while True:
        ready, _ = kept(waiting.where("remaining = 0").select(*NODE, "up_conv", "up_n", "saved", F.greatest("leaves", F.lit(1)).cast("long").alias("leaves")), "trie-done")
        done.append(ready.select(*NODE, "leaves", "saved"))
        rest = waiting.where("remaining > 0")
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, done)
        told = ready.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("heard"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        next_ = rest.join(told, NODE, "left").select(*NODE, "up_conv", "up_n", (F.col("saved") + zero("more_saved")).alias("saved"), (F.col("remaining") - zero("heard")).alias("remaining"), (F.col("leaves") + zero("more_leaves")).alias("leaves"))
        last, (waiting, path) = path, kept(next_, "trie-waiting")
        delete(spark, last)


def id_lists(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (k1, k2, conv_id): the SHA-256 of a key's ids, ascending, comma-joined.

    A key with one id is hashed where it is. Of others, a sort by range makes pieces of PIECE ids in many tasks, however many
    ids one key has; a key's pieces then go to one task in order, which feeds them to its digest one by one, as a digest must
    be, and holds one batch.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            turns = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            bounds = [0, *turns.tolist(), len(ids)] if len(ids) else [0]
            starts = [s for a, b in zip(bounds, bounds[1:], strict=False) for s in range(a, b, PIECE)]
            ends = [*starts[1:], len(ids)]
            text = ids.astype(str).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array([",".join(text[a:b]) for a, b in zip(starts, ends, strict=True)] if starts else [], pa.string())], ["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (a, b) == now:
                    state.update(b"," + ids.encode())
                else:
                    out += [(*now, state.hexdigest())] if now else []
                    now, state = (a, b), sha256(ids.encode())
            yield _digests(out)
        if now:
            yield _digests([(*now, state.hexdigest())])

    each, _ = kept(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("conv_id").alias("only")), "trie-ends")
    alone = each.where("n = 1").select("k1", "k2", F.sha2(F.col("only").cast("string"), 256).alias("ends_sha256"))
    many = rows.join(each.where("n > 1").select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "conv_id")
    pieces, _ = kept(many.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(lean(join), "k1 long, k2 long, first long, ids string"), "trie-pieces")
    lists = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids").mapInArrow(lean(digest), "k1 long, k2 long, ends_sha256 string")
    return alone.unionAll(lists)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["k1", "k2", "ends_sha256"])


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per node of the trie of sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth from 1 without gaps, digest, words, length (of the whole sequence); members: conv_id (each once), length, also those
    without turns. A node is named by its smallest member and its depth. Nodes on one path with equal members are a
    segment, named by conv_id and n_convs; only segments are peeled, so a long conversation that nobody shares is one leaf.
    Nodes are told apart by 128 bits of hashes.
    """
    steps, _ = kept(_steps(turns), "trie-steps")
    r1, r2 = _key(F.lit(0), [F.lit(0).cast("long")] * 4)
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(r1.alias("k1"), r2.alias("k2"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), none.alias("q1"), none.alias("q2"))
    nodes = steps.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("depth", "words", "q1", "q2")))
    nodes, _ = kept(nodes.unionByName(root), "trie-nodes")
    above = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    linked = nodes.join(above, ["q1", "q2"], "left").withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    linked, _ = kept(linked.select("k1", "k2", *NODE, "depth", "parent_conv_id", "parent_n", "own", "q1", "q2"), "trie-linked")
    top = F.col("parent_n").isNull() | (F.col("parent_n") != F.col("n_convs"))
    segments = linked.groupBy(*NODE).agg(F.min(F.when(top, F.col("parent_conv_id"))).alias("up_conv"), F.min(F.when(top, F.col("parent_n"))).alias("up_n"), F.sum("own").alias("saved"))
    totals = peeled(segments)
    shared = running(linked.where("n_convs > 1"), NODE, "depth", ["own"], "trie-own")  # what a segment's nodes above and including this one save
    shared = shared.join(totals, NODE).select("k1", "k2", *NODE, "depth", "parent_conv_id", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("run_own") + F.col("own")).alias("saved_tokens"))
    alone = linked.where("n_convs = 1").select("k1", "k2", *NODE, "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    children = linked.where("q1 is not null").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"))
    ends = steps.where("last").select("k1", "k2", "conv_id").unionByName(members.where("length = 0").select(r1.alias("k1"), r2.alias("k2"), "conv_id"))
    out = shared.unionByName(alone).join(children, ["k1", "k2"], "left").join(id_lists(ends), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text): numbered, with_shared_openings, prefix_trie.

    Null turns come first, null roles and texts are empty, rows without conv_id count nowhere, repeated rows are turns like
    others, extra columns are ignored, texts of any length are hashed whole; an empty table has no node, not even a root. The
    result is a written table; what was written for it is deleted.
    """

    def make() -> DataFrame:
        return prefix_trie(*with_shared_openings(*numbered(conversations)))

    return settled(conversations.sparkSession, make, "trie")
