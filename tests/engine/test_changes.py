import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.engine import Engine
from gleanery.operators import discovery
from gleanery.streaming import streams

START = datetime(2025, 1, 1)


def history(seed, steps=6):
    """Successive listings: dicts of path -> (size, mtime, hash), some files changed, added, removed."""
    rng, now, out = random.Random(seed), {}, []
    for step in range(steps):
        now = dict(now)
        for path in rng.sample("abcdefgh", 4):
            if path in now and rng.random() < 0.3:
                del now[path]
            else:
                now[path] = (rng.randint(1, 3), step, f"h{rng.randint(0, 2)}")
        out.append(now)
    return out


def run(spark, folder, out, checkpoint):
    listed = spark.readStream.schema(streams.LISTED).option("maxFilesPerTrigger", 1).parquet(folder)
    query = streams.file_changes(listed, absent="30 minutes", late="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.mark.parametrize("files_each,restart", [(1, True), (3, False)])
def test_changes_follow_the_listings(spark, tmp_path, files_each, restart):
    """Each path's changes tell its last state, for two splits into batches, with a restart between."""
    listings = history(7)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [[(p, *v, START + timedelta(minutes=10 * k)) for p, v in now.items()] for k, now in enumerate(listings)]
    rows += [[("clock", 1, 1, "x", START + timedelta(days=d))] for d in (1, 2)]  # time goes on, so timers run
    chunks = [sum(rows[i : i + files_each], []) for i in range(0, len(rows), files_each)]
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, streams.LISTED).coalesce(1).write.mode("append").parquet(folder)
        if restart and i == 2:
            run(spark, folder, out, checkpoint)
    run(spark, folder, out, checkpoint)
    found = spark.read.schema(streams.CHANGED).parquet(out).collect()
    last_seen = {}
    for k, now in enumerate(listings):
        for p, v in now.items():
            last_seen[p] = (k, v)
    by_path = {}
    for r in sorted(found, key=lambda r: (r.seen, r.change == "removed")):
        by_path.setdefault(r.path, []).append(r.change)
    assert set(by_path) - {"clock"} == set(last_seen)
    for path in last_seen:
        # absent for 30 minutes is removed, and so is every file in the end, as only the clock is listed
        want, known, since = [], None, None
        for k, now in enumerate(listings):
            if known is not None and path not in now and (k - since) * 10 > 30:
                want, known = [*want, "removed"], None
            if path in now:
                if known is None:
                    want.append("added")
                elif known != now[path]:
                    want.append("updated")
                known, since = now[path], k
        assert by_path[path] == [*want, *(["removed"] if known is not None else [])], path


def test_two_listings_equal_the_delta(spark, tmp_path):
    old, new = history(3)[2:4]
    frame = lambda now, t: spark.createDataFrame([(p, *v, t) for p, v in now.items()], streams.LISTED)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k, now in enumerate((old, new)):
        frame(now, START + timedelta(minutes=20 * k)).repartition(2).write.mode("append").parquet(folder)
    run(spark, folder, out, checkpoint)
    frame({"clock": (1, 1, "x")}, START + timedelta(minutes=35)).write.mode("append").parquet(folder)  # the old listing's files time out, the new one's don't
    run(spark, folder, out, checkpoint)
    found = spark.read.schema(streams.CHANGED).parquet(out).where("path <> 'clock'")
    later = found.where(F.col("change").isin("updated", "removed") | ((F.col("change") == "added") & (F.col("seen") > F.lit(START)))).select("path", "change")
    want = discovery.delta(frame(old, START), frame(new, START)).where("change <> 'unchanged'")
    assert sorted(map(str, later.collect())) == sorted(map(str, want.collect())) and want.count() > 2


def test_audit_files_become_one(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"), files=spark.createDataFrame([("a.md", "x")], "path string, text string"))
    for k in range(4):
        engine.log("repo.search", {"top_k": k})
    before = list(map(str, engine.audit_log().collect()))
    assert engine.compact_audit() == 4 and engine.compact_audit() == 0
    assert len([f for f in engine.store._names(f"{engine.data_dir}/audit") if f.endswith(".json")]) == 1
    engine.log("repo.status", {})
    after = list(map(str, engine.audit_log().collect()))
    assert after[:4] == before and len(after) == 5
