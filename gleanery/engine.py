"""The engine: a corpus, its index, and the ten verbs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import Settings
from gleanery.errors import EngineError, InvalidArgument, PolicyBlocked
from gleanery.functions import paths
from gleanery.functions import text as T
from gleanery.operators import audit, blocks, chunking, clusters, discovery, fusion, latent, names, outline, references, search, semantic
from gleanery.operators.languages import FALLBACK, SUFFIXES
from gleanery.plans import bundle, documents
from gleanery.plans.store import Store, now
from gleanery.sources import corpus as sources
from gleanery.sources.work import written

MODES = ("bm25", "semantic", "hybrid")
#: Hashes of paths, of 8 bytes each, that are sent to all.
SMALL_HASHES = 1_000_000


def _whole(name: str, value, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise InvalidArgument(f"{name} must be an integer of at least {least}")
    return value


class Engine:
    """Verbs over one directory (root) or one table (files: path, text).

    DataFrames come back lazily. The index lies under data_dir, in segments: a refresh writes what changed. Once there is an
    index, outline, references, find_definition and bundle read its symbols, names and texts, as of the last refresh, and
    open no source file; before that, and for a single path, they read the sources. `embed` is a pandas UDF from text to
    array<double>, or "latent" for vectors learned from the index's own postings; semantic and hybrid search need it.
    """

    def __init__(self, spark: SparkSession, data_dir: str, root: str | None = None, files: DataFrame | None = None, settings: Settings | None = None, embed: Callable | str | None = None):
        if isinstance(embed, str) and embed != "latent":
            raise InvalidArgument('embed must be a function or "latent"')
        if (root is None) == (files is None):
            raise InvalidArgument("Give either root or files.")
        self.spark, self.root, self.table, self._embed = spark, root, files, embed
        self.settings, self.store, self.data_dir = settings or Settings(), Store(spark, f"{data_dir}/index", {"blocks": blocks.build}), data_dir
        self.limits = self.settings.limits

    # -- corpus

    def candidates(self, pruned: bool = False) -> DataFrame:
        """All files: path, size, mtime_ns and, for tables, content. pruned: without directories that a pattern excludes whole, which are not entered."""
        if self.table is not None:
            content = F.col("text").cast("binary")
            return self.table.where("path is not null and text is not null").select("path", F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), content.alias("content"))
        own = self.data_dir.rstrip("/") + "/"
        found = sources.list_directory(self.spark, self.root, paths.whole_directories(self.settings.exclude_globs) if pruned else ())
        return found.where(~F.concat(F.lit(self.root.rstrip("/") + "/"), "path").startswith(own))

    def _with_content(self, rows: DataFrame) -> DataFrame:
        return rows if self.table is not None else sources.read_files(rows, self.root)

    def corpus(self, path: str | None = None) -> DataFrame:
        """(path, text) of what may be read: selected by suffix and patterns, not denied, not too large, not binary. A single path is checked and raises instead."""
        if path is not None:
            path = paths.resolve(path, self.root)
            rows = self.candidates().where(F.col("path") == path) if self.table is not None else sources.one_file(self.spark, self.root, path)
            if self.table is None and f"{self.root.rstrip('/')}/{path}/".startswith(self.data_dir.rstrip("/") + "/"):
                rows = rows.limit(0)
            reason = rows.select(paths.block_reason("path", "size", self.limits.max_file_bytes).alias("reason")).first()
            denied = reason["reason"] if reason else ("denylist" if self.spark.range(1).select(paths.denied(F.lit(path))).first()[0] else None)
            if denied:
                raise PolicyBlocked(f"{path} is blocked: {denied}.", "Choose another file.")
        else:
            rows = discovery.selected(self.candidates(pruned=True), self.settings.include_extensions, self.settings.exclude_globs)
            rows = rows.where(paths.block_reason("path", "size", self.limits.max_file_bytes).isNull())
        files = self._with_content(rows)
        return (files if path is not None else files.where(~discovery.is_binary("content"))).select("path", sources.decoded().alias("text"))

    # -- the ten verbs

    def status(self) -> dict:
        found = self.store.manifest() or {}
        adapters = [n for n in (*SUFFIXES, FALLBACK) if n != "python" or self.settings.python_enabled]
        return {"index_status": self.store.status(), "enabled_adapters": adapters, "indexed_file_count": found.get("indexed_file_count", 0), "indexed_chunk_count": found.get("indexed_chunk_count", 0), "last_refresh_timestamp": found.get("last_refresh_timestamp")}

    def list_files(self, glob: str | None = None, include_hidden: bool = False, max_results: int | None = None) -> DataFrame:
        limit = min(max(1, max_results if max_results is not None else self.limits.max_search_hits), self.limits.max_search_hits)
        rows = self.candidates().where(paths.block_reason("path", "size", self.limits.max_file_bytes).isNull())
        rows = rows if include_hidden else rows.where(~paths.hidden("path"))
        rows = rows.where(paths.matches_glob("path", glob)) if glob is not None else rows
        return rows.select("path", "size", F.col("mtime_ns").alias("mtime")).orderBy(paths.parts("path")).limit(limit)

    def open_file(self, path: str, start_line: int = 1, end_line: int | None = None) -> DataFrame:
        """(line, text) from start to end; without an end the whole file, which must not have too many lines."""
        _whole("start_line", start_line)
        if end_line is not None and _whole("end_line", end_line) < start_line:
            raise InvalidArgument("end_line must not be before start_line")
        rows = self.corpus(path).select(F.posexplode(T.lines("text")).alias("at", "text")).select((F.col("at") + 1).alias("line"), "text")
        if end_line is None:
            if rows.count() > self.limits.max_open_lines:
                raise PolicyBlocked("The file has too many lines.", "Give end_line.")
            return rows.where(F.col("line") >= start_line).orderBy("line")
        if end_line - start_line + 1 > self.limits.max_open_lines:
            raise PolicyBlocked("Too many lines asked for.", "Ask for fewer.")
        return rows.where(F.col("line").between(start_line, end_line)).orderBy("line")

    # -- the index

    def _stored(self, path: str | None = None) -> bool:
        """Whether the index answers: it is there, complete, and made under the same settings; a single path is read itself."""
        if path is not None:
            return False
        found = self.store.manifest()
        return bool(found) and self.store.status() == "ready" and found["python_enabled"] == self.settings.python_enabled and self.store.complete("symbols")

    def _texts(self) -> DataFrame:
        return self.store.read("texts").where("allowed")

    def _differing(self, chosen: DataFrame, old: DataFrame | None, force: bool) -> DataFrame:
        """(path, size, mtime_ns, had, opened): files that are new or of another size or time (tables: of another content), all with force, and those that are gone."""
        if self.root is None:
            chosen = discovery.file_records(chosen)
        fields = [c for c in discovery.RECORD[1:] if c in chosen.columns]
        new = chosen.select("path", F.struct(*fields).alias("new"))
        was = old.select("path", F.struct(*fields).alias("old")) if old is not None else self.spark.createDataFrame([], sources.RECORD).select("path", F.struct(*fields).alias("old"))
        both = new.join(was, "path", "full_outer")
        opened = F.col("new").isNotNull() & (F.lit(force) | F.col("old").isNull() | (F.col("new") != F.col("old")))
        return both.select("path", F.col("new.size").alias("size"), F.col("new.mtime_ns").alias("mtime_ns"), F.col("old").isNotNull().alias("had"), F.coalesce(opened, F.lit(True)).alias("opened"), F.col("new").isNull().alias("gone")).where("opened or gone")

    def refresh(self, force: bool = False) -> dict:
        """Brings the index up to date: one segment with what changed, and marks on the files whose older rows are dead.

        Only files of another size or time are opened, each once; what is written grows with them, not with the corpus. With force, or under
        another schema or setting, the index is written anew.
        """
        status, manifest = self.store.status(), self.store.manifest()
        old = None if status == "not_indexed" or force and status != "ready" else self.store.read("files")
        anew = force or old is None or manifest["python_enabled"] != self.settings.python_enabled
        chosen = discovery.selected(self.candidates(pruned=True), self.settings.include_extensions, self.settings.exclude_globs)
        segment = self.store.begin()
        put, made = (lambda name, rows, of=None: self.store.put(segment, name, rows, of)), (lambda name: self.store.made(segment, name))
        differing = put("differing", self._differing(chosen, old, anew))
        opened, had = differing.where("opened and not gone"), differing.where("had").select("path")
        fresh = anew or not opened.isEmpty()
        if fresh:
            self._put_content(put, opened, chosen, anew)
        files, chunks = (made(n) if fresh else None for n in ("files", "chunks"))
        was_there = had.withColumn("was", F.lit(1))
        now_there = (files.select("path") if fresh else had.limit(0)).withColumn("now", F.lit(1))
        added, updated, removed = now_there.join(was_there, "path", "full_outer").agg(*(F.count_if(F.expr(e)) for e in ("was is null", "now = was", "now is null"))).first()
        changed, gone_chunks = anew or bool(added or updated or removed), 0
        if not anew and (updated or removed):
            put("marks", had)
            gone_chunks = names.looked_up(self.store.read("chunks"), "path", had).count()
        if (embed := self._embedder(segment if fresh else None, anew)) is not None:
            changed = self._put_vectors(segment, self._new_vectors(chunks if fresh else self.store.read("chunks").limit(0), had, anew, embed), anew) or changed
        self.store._delete(f"{self.store.root}/segments/{segment}/differing")
        file_count, chunk_count = (0, 0) if anew else (manifest["indexed_file_count"], manifest["indexed_chunk_count"])
        done = self.store.commit(segment if changed else None, file_count + added + (updated if anew else -removed), chunk_count - gone_chunks + (chunks.count() if fresh else 0), self.settings.python_enabled, replace=anew)
        return {"added": added, "updated": updated, "removed": removed, "timestamp": done["last_refresh_timestamp"]}

    def _opened_rows(self, chosen: DataFrame, opened: DataFrame, anew: bool) -> DataFrame:
        """The rows of a table (chosen) that are opened. No text is shuffled if all are; else only texts whose path has the hash of an opened one, as long as these hashes are few."""
        if anew:
            return chosen
        if opened.count() <= SMALL_HASHES:
            hashes = F.broadcast(opened.select(F.xxhash64("path").alias("_hash")))
            chosen = chosen.withColumn("_hash", F.xxhash64("path")).join(hashes, "_hash", "left_semi").drop("_hash")
        return chosen.join(opened.select("path"), "path", "left_semi")

    def _put_content(self, put: Callable, opened: DataFrame, chosen: DataFrame, anew: bool) -> None:
        """A segment's tables of the opened files; each is read once, and what follows is made from what was written."""
        content = self._with_content(opened.select("path", "size", "mtime_ns") if self.root else self._opened_rows(chosen, opened, anew))
        text, tongue = sources.decoded(), outline.language("path", self.settings.python_enabled)
        allowed = paths.block_reason("path", "size", self.limits.max_file_bytes).isNull()
        rows = content.where(~discovery.is_binary("content")).select("path", "size", "mtime_ns", F.sha2("content", 256).alias("content_hash"), tongue.alias("language"), allowed.alias("allowed"), text.alias("text"))
        texts = put("texts", rows.withColumn("masked", F.when(F.col("allowed") & ~F.col("language").isin("python", FALLBACK), T.masked("text"))))
        chunks = chunking.chunks(texts.select("path", "text")).withColumns({"dl": F.regexp_count("text", F.lit(T.TOKEN)), "snippet": T.snippet(T.lines(F.substring("text", 1, search.HEAD)))})
        code = texts.where("allowed")
        uses = references.python_candidates(code.where("language = 'python'")).withColumn("short", outline.short("candidate"))
        makers = [
            lambda: put("blocks", blocks.build(put("chunks", chunks)), "chunks"),
            lambda: put("symbols", self._outline(code).withColumn("short", outline.short("name"))),
            lambda: put("uses", uses),
            lambda: put("names", names.build(code)),
            lambda: put("files", texts.select(*discovery.RECORD)),
        ]
        with ThreadPoolExecutor(len(makers)) as pool:  # independent jobs, side by side
            for done in [pool.submit(inheritable_thread_target(self.spark)(m)) for m in makers]:
                done.result()

    def _embedder(self, segment: str | None = None, anew: bool = False) -> Callable | None:
        """The embedder given, or the index's own. The latter is learned from the first segment that has terms, lies with it, and serves until the index is made anew."""
        if self._embed != "latent":
            return self._embed
        known = None if anew else self.store.read("latent", live=False)
        if known is None and segment is not None:
            postings = self.store.made(segment, "blocks").select("term", F.explode("docs").alias("x")).select("term", "x.doc", "x.tf")
            model = latent.fit(postings, ["doc"], self.store.made(segment, "chunks").count(), lambda rows: self.store.put(segment, "matrix", rows))
            self.store._delete(f"{self.store.root}/segments/{segment}/matrix")
            known = self.store.put(segment, "latent", latent.table(self.spark, model)) if model else None
        model = latent.stored(known)
        return latent.embedder(self.spark, model) if model else None

    def _new_vectors(self, chunks: DataFrame, had: DataFrame, anew: bool, embed: Callable) -> DataFrame:
        """(chunk_id, path, vector) of new chunks, and of those that have none yet. Vectors that are there stay where they are; those of changed files are taken over by chunk."""
        have, wanted = self._old_vectors(), chunks.select("chunk_id", "path", "text")
        pool = have.join(had, "path", "left_semi")
        if anew:
            pool = have if self._embed != "latent" else have.limit(0)  # another model, other vectors
        else:
            stay = have.join(had, "path", "left_anti")
            rest = self.store.read("chunks").select("chunk_id", "path", "text").join(had, "path", "left_anti").join(stay.select("chunk_id"), "chunk_id", "left_anti")
            wanted = wanted.unionByName(rest)
        return semantic.refreshed(pool, wanted, embed).join(wanted.select("chunk_id", "path"), "chunk_id").select("chunk_id", "path", "vector")

    def _put_vectors(self, segment: str, vectors: DataFrame, anew: bool) -> bool:
        """Write a segment's vectors by cluster; whether there are any. Centroids are fitted once, on the first vectors, and serve until the index is made anew."""
        made = self.store.put(segment, "embedded", vectors)
        old = None if anew else self.store.read("centroids", live=False)
        if old is None and not made.isEmpty():
            fitted = [(i, c.tolist()) for i, c in enumerate(clusters.fit(made))]
            old = self.store.put(segment, "centroids", self.spark.createDataFrame(fitted, "cluster int, centroid array<double>"))
        self.store.put(segment, "vectors", clusters.assigned(made, clusters.stored(old)))
        some = not made.isEmpty()
        self.store._delete(f"{self.store.root}/segments/{segment}/embedded")
        return some

    def _old_vectors(self) -> DataFrame:
        found = self.store.read("vectors") if self.store.status() == "ready" else None
        return found if found is not None else self.spark.createDataFrame([], "chunk_id string, path string, vector array<double>")

    def optimize(self) -> None:
        """Merges all segments of the index into one."""
        self.store.optimize()

    def _outline(self, corpus: DataFrame) -> DataFrame:
        return outline.checked(outline.outline(corpus, self.settings.python_enabled))

    def outline(self, path: str | None = None) -> DataFrame:
        if self._stored(path):
            return outline.ordered(self.store.read("symbols").drop("short"))
        return outline.ordered(self._outline(self.corpus(path)))

    def _references(self, symbols: DataFrame, path: str | None = None, within: DataFrame | None = None) -> DataFrame:
        """References by the index, or of the sources themselves. within: only in these paths."""
        if not self._stored(path):
            corpus = self.corpus(path)
            return references.checked(references.references(corpus if within is None else corpus.join(within, "path", "left_semi"), symbols, self.settings.python_enabled))
        scoped = lambda rows: rows if within is None else rows.join(within, "path", "left_semi")
        return references.checked(names.stored_references(scoped(self.store.read("names")), self._texts(), scoped(self.store.read("uses")), symbols))

    def vector_plan(self) -> DataFrame:
        """(chunk_id, action): what a refresh of the vectors would embed, reuse and remove, by the index as it is."""
        chunks = self.store.read("chunks")
        if chunks is None:
            raise EngineError("There is no index.", "Refresh first.")
        return semantic.refresh_plan(self._old_vectors(), chunks)

    def _hits(self, queries: DataFrame, top_k, file_glob: str | None, path_prefix: str | None, mode: str) -> DataFrame:
        stored = self.store.read("chunks", segment=True, prefix=paths.normal_prefix(path_prefix))
        if stored is None:
            raise EngineError("There is no index.", "Refresh first.")
        docs = search.filtered(stored, file_glob, path_prefix)
        words = None if mode == "semantic" else self._search(queries, top_k, docs, bool(file_glob or path_prefix)).hits()
        if mode == "bm25":
            return words
        if self._embed is None:
            raise EngineError("Semantic search needs an embedder.")
        stored_vectors = self.store.read("vectors")
        if stored_vectors is None:
            raise EngineError("The index has no vectors.", "Refresh with an embedder.")
        vectors = docs.select("chunk_id", "path", "start_line", "end_line").join(stored_vectors.drop("path"), "chunk_id")
        asked = queries.select("query_id", self._embedder()("query").alias("query_vector"))
        centroids = clusters.stored(self.store.read("centroids", live=False))
        near = clusters.Search(vectors, centroids, asked, top_k, ["path", "start_line"]).hits().withColumns({"snippet": F.lit(""), "matched_terms": F.array().cast("array<string>")})
        return near if mode == "semantic" else fusion.fuse(words, near, top_k)

    def _search(self, queries: DataFrame, top_k: int, docs: DataFrame, filtered: bool) -> blocks.Search:
        every = self.store.read("chunks", live=False, segment=True)
        return blocks.Search(self.store.read("blocks", live=False, segment=True), every, queries, top_k, docs if filtered or self.store.has_marks() else None)

    def search_report(self, queries: str | list[str] | DataFrame, top_k: int | None = None, file_glob: str | None = None, path_prefix: str | None = None) -> DataFrame:
        """(query_id, blocks, scored_blocks, ranges, scored_ranges): how much of the queries' postings a bm25 search opens."""
        docs = search.filtered(self.store.read("chunks", segment=True), file_glob, path_prefix)
        return self._search(self._asked(queries), self._top_k(top_k, self.limits.max_search_hits), docs, bool(file_glob or path_prefix)).report()

    def _asked(self, queries: str | list[str] | DataFrame) -> DataFrame:
        if isinstance(queries, str):
            queries = [queries]
        return self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string") if isinstance(queries, list) else queries

    def search(self, queries: str | list[str] | DataFrame, top_k: int | None = None, file_glob: str | None = None, path_prefix: str | None = None, mode: str = "bm25") -> DataFrame:
        """Hits of one query, a list, or a table (query_id, query)."""
        top_k = self._top_k(top_k, self.limits.max_search_hits)
        if mode not in MODES:
            raise InvalidArgument(f"mode must be one of {', '.join(MODES)}")
        return self._hits(self._asked(queries), top_k, file_glob, path_prefix, mode).orderBy("query_id", "rank")

    def marked_stale(self, hits: DataFrame) -> DataFrame:
        """hits (path, ...) with stale: whether the file has changed or gone since the refresh that the hit comes from. Only the hits' files are looked at."""
        met, known = hits.select("path").distinct(), self.store.read("files")
        if self.root is None:
            now = discovery.file_records(self.candidates().join(met, "path", "left_semi")).select("path", F.struct("size", "content_hash").alias("now"))
            was = known.select("path", F.struct("size", "content_hash").alias("was"))
        else:
            now = sources.stat_files(met, self.root).select("path", F.struct("size", "mtime_ns").alias("now"))
            was = known.select("path", F.struct("size", "mtime_ns").alias("was"))
        fresh = was.join(now, "path").where("was = now").select("path", F.lit(False).alias("stale"))
        return hits.join(fresh, "path", "left").withColumn("stale", F.coalesce("stale", F.lit(True)))

    def _top_k(self, value: int | None, limit: int) -> int:
        if value is None:
            return limit
        if _whole("top_k", value) > limit:
            raise PolicyBlocked(f"top_k is over {limit}.", "Reduce top_k or change the limits.")
        return value

    def _symbols(self, symbols: str | list[str]) -> DataFrame:
        names = [symbols] if isinstance(symbols, str) else symbols
        if not names or not all(isinstance(x, str) and x.strip() for x in names):
            raise InvalidArgument("symbol must be a non-empty string")
        return self.spark.createDataFrame([(x.strip(),) for x in names], "symbol string")

    def references(self, symbols: str | list[str], path: str | None = None, top_k: int | None = None) -> DataFrame:
        limit = self._top_k(top_k, self.limits.max_references)
        return references.limited(self._references(self._symbols(symbols), path), limit).orderBy("symbol", "rank")

    def profile_references(self, symbols: str | list[str], path: str | None = None, sink: str | None = None) -> DataFrame:
        """Per language: files, characters and references to the symbols. sink: a folder to which the rows are appended as JSON."""
        corpus = self._texts().select("path", "text") if self._stored(path) else self.corpus(path)
        found = references.profile(corpus, self._references(self._symbols(symbols), path), self.settings.python_enabled)
        if sink is not None:
            found.withColumn("timestamp", F.lit(now())).coalesce(1).write.mode("append").json(sink)
        return found.orderBy("language")

    def find_definition(self, symbols: str | list[str], path: str | None = None, top_k: int | None = None) -> DataFrame:
        limit = self._top_k(top_k, self.limits.max_references)
        asked = self._symbols(symbols)
        if self._stored(path):
            known = names.looked_up(self.store.read("symbols"), "short", asked.select(outline.short("symbol").alias("short"))).drop("short")
        else:
            known = self._outline(self.corpus(path))
        return outline.definitions(known, asked, limit).orderBy("symbol", "rank")

    def bundle(self, prompts: str | list[str], max_files: int, max_total_lines: int, include_tests: bool = False, mode: str = "bm25") -> dict[str, DataFrame]:
        """documents (JSON), and their parts: selections, totals, ranking, notes, ids, by prompt_id. documents.export writes files."""
        _whole("max_files", max_files), _whole("max_total_lines", max_total_lines)
        names = [prompts] if isinstance(prompts, str) else prompts
        if not names or not all(isinstance(x, str) and x.strip() for x in names):
            raise InvalidArgument("prompt must be a non-empty string")
        asked = self.spark.createDataFrame([(i, p) for i, p in enumerate(names)], "prompt_id long, prompt string")
        queries = bundle.queries(asked, self.limits.max_search_hits).withColumn("query_id", F.col("prompt_id") * 16 + F.col("query_index"))
        hits = self._hits(queries, self.limits.max_search_hits, None, None, mode)
        # a few hundred rows a prompt, read by every part of the result: written once, deleted by clean()
        work = f"{self.data_dir}/work"
        hits = written(hits.join(queries, "query_id").where("rank <= k").withColumnRenamed("query", "source_query"), "hits", work)
        corpus, paths_hit = (self._texts().select("path", "text") if self._stored() else self.corpus()), hits.select("path").distinct()
        known = self.store.read("symbols").drop("short").join(paths_hit, "path", "left_semi") if self._stored() else self._outline(corpus.join(paths_hit, "path", "left_semi"))
        symbols = written(known, "symbols", work)
        refs = self._references(symbols.select(F.col("name").alias("symbol")).distinct(), within=paths_hit)
        ranked = bundle.candidates(hits, asked, symbols, refs, include_tests)
        budgets = asked.select("prompt_id", F.lit(max_files).alias("max_files"), F.lit(max_total_lines).alias("max_total_lines"))
        judged = written(bundle.verdicts(ranked, budgets), "judged", work)
        selections, sums = bundle.explained(judged, corpus), bundle.totals(judged)
        kept = hits if include_tests else hits.where(~paths.test_path("path"))
        whole = documents.documents(asked, budgets, queries, kept, judged, selections, mode)
        return {"documents": whole, "selections": selections, "totals": sums, "ranking": judged.where(F.col("rank_position") <= bundle.TOP), "notes": bundle.notes(judged), "ids": bundle.bundle_ids(asked, sums, selections)}

    def clean(self) -> None:
        """Deletes what bundles have written for themselves; their DataFrames can't be read after this."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.data_dir}/work")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # -- audit

    def log(self, tool: str, arguments: dict, ok: bool = True, blocked: bool = False, error_code: str | None = None) -> None:
        meta = {k: json.dumps(v, sort_keys=True) for k, v in audit.sanitized(arguments).items()}
        row = (time.time_ns(), now(), uuid.uuid4().hex, tool, ok, blocked, error_code, meta)
        self.spark.createDataFrame([row], audit.EVENT).coalesce(1).write.mode("append").json(f"{self.data_dir}/audit")

    def audit_log(self, since: str | None = None, limit: int = 50) -> DataFrame:
        if not self.store._exists(f"{self.data_dir}/audit"):
            return self.spark.createDataFrame([], audit.EVENT).drop("seq")
        events = self.spark.read.schema(audit.EVENT).option("mode", "DROPMALFORMED").json(f"{self.data_dir}/audit").dropDuplicates(["request_id"])
        return audit.recent(events, since, min(max(1, limit), self.limits.max_search_hits)).drop("seq")

    def compact_audit(self) -> int:
        """Writes the events of all audit files there are into one, then deletes those; how many went. Between the two an event may stand twice, which reading leaves out."""
        folder = f"{self.data_dir}/audit"
        old = [f for f in self.store._names(folder) if f.endswith(".json")]
        if len(old) < 2:
            return 0
        events = self.spark.read.schema(audit.EVENT).option("mode", "DROPMALFORMED").json([f"{folder}/{f}" for f in old])
        events.dropDuplicates(["request_id"]).coalesce(1).sortWithinPartitions("seq").write.mode("append").json(folder)
        for f in old:
            self.store._delete(f"{folder}/{f}")
        return len(old)

    def response(self, rows: DataFrame) -> str:
        """JSON of a result, unless it is too long."""
        out = json.dumps([json.loads(x) for x in rows.toJSON().collect()], sort_keys=True)
        if len(out.encode()) > self.limits.max_total_bytes_per_response:
            raise PolicyBlocked("The response is too large.", "Ask for fewer rows.")
        return out
