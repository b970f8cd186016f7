"""SQL twins of the queries, for an independent engine."""

from __future__ import annotations

from gleanery.config import EXCLUDED_DIRECTORIES, INCLUDE_EXTENSIONS

CORPUS = "corpus AS (SELECT doc_id, source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.md' AS path, text FROM documents)"
#: Without the empty piece after a last line feed.
LINED = "lined AS (SELECT doc_id, path, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM corpus WHERE text <> '')"
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda x: lower(x))"
#: A character cut at byte 4096 makes a file binary: the next byte continues it.
CUT = "(strlen(text) > 4096 AND substr(hex(encode(text)), 8193, 1) IN ('8', '9', 'A', 'B'))"
RECORDS = f"records AS (SELECT path, CAST(strlen(text) AS BIGINT) AS size, doc_id AS mtime_ns, sha256(text) AS content_hash FROM corpus WHERE NOT {CUT})"


def chunks(size: int = 200, overlap: int = 30) -> str:
    step = size - overlap
    return f"""{CORPUS}, {LINED}, chunked AS (
  SELECT path, j * {step} + 1 AS start_line, least(j * {step} + {size}, len(ls)) AS end_line, array_to_string(list_slice(ls, j * {step} + 1, least(j * {step} + {size}, len(ls))), chr(10)) AS text
  FROM (SELECT path, ls, unnest(range(0, CASE WHEN len(ls) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(ls) - {size}) / {step}.0) AS BIGINT) END)) AS j FROM lined)
), chunks AS (
  SELECT path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, text, sha256(path || '|' || start_line || '|' || end_line || '|' || text) AS chunk_id FROM chunked
)"""


def bm25(queries: str, where: str = "true", docs: str = "chunks", key: str = "chunk_id", name: str = "hits") -> str:
    """Common tables up to `name`: all hits of `queries` (query_id, query) with score, terms and rank."""
    return f"""docs AS (SELECT * FROM {docs} WHERE {where}), toks AS (SELECT {key}, {TOKENS.format('text')} AS words FROM docs),
post AS (SELECT {key}, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT {key}, len(words) AS dl, unnest(words) AS term FROM toks) GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS avgdl FROM toks),
qt AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS term FROM {queries}),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
ws AS (SELECT query_id, {key}, term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w FROM post JOIN dfs USING (term) JOIN qt USING (term), st),
scored AS (SELECT query_id, {key}, list_reduce(list(CAST(w AS DOUBLE) ORDER BY term), lambda a, b: a + b) AS score, list(term ORDER BY term) AS terms FROM ws GROUP BY ALL),
{name} AS (SELECT query_id, {key}, path, start_line, end_line, score, terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line) AS rank FROM scored JOIN docs USING ({key}) WHERE score > 0)"""


SHOWN = "query_id, path, start_line, end_line, rank, round(score, 8) AS score, array_to_string(terms, ' ') AS matched_terms"
ONE = "one AS (SELECT CAST(0 AS BIGINT) AS query_id, 'the of and that' AS query)"
BENCH = "bench AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

STRANGE = """strange AS (SELECT source || '/' || ['src/.env', 'keys/server.PEM', 'a/b/id_rsa.pub', 'x/.git/config', 'conf/Secrets.toml', 'dist/app.js', 'src/app.py',
  'src/node_modules/m/i.ts', 'README.md', 'docs/guide.rst', 'image.png', '.hidden/x.py', 'tests/test_a.py', 'pkg/tests/b.py', 'pkg/c_test.py', 'Makefile'][doc_id % 16 + 1] AS path, n_chars AS size FROM documents)"""
NAME = "list_last(string_split(lower(path), '/'))"
DENIED = f"({NAME} = '.env' OR regexp_matches({NAME}, '[.](pem|key|pfx|p12)$') OR {NAME} LIKE 'id_rsa%' OR {NAME} LIKE 'secrets.%' OR list_contains(string_split(lower(path), '/'), '.git'))"
HIDDEN = "regexp_matches('/' || path, '/[.]')"
TEST = "('/' || lower(path) || '/' LIKE '%/tests/%' OR lower(path) LIKE '%\\_test.py' ESCAPE '\\')"
EXCLUDED = "regexp_matches('/' || path, '/(" + "|".join(d.replace(".", "[.]") for d in EXCLUDED_DIRECTORIES) + ")/.')"
ALLOWED = "lower(regexp_extract(path, '[^/.][^/]*([.][^./]+)$', 1)) IN (" + ", ".join(f"'{e}'" for e in INCLUDE_EXTENSIONS) + ")"
#: A directory pattern needs something before the directory's slash, or the path's start.
VECTORS = "vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
NEAR = """asked AS (SELECT vec_id AS query_id, v AS q FROM vectors WHERE vec_id % 100 = 0), sims AS (
  SELECT query_id, vec_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM {vectors}, asked
), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, {tie}) AS rank FROM sims)"""

MASK = r"""(//|#)[^\n]*|/\*(?s:.*?)(\*/|\z)|'''(?s:.*?)('''|\z)|\"\"\"(?s:.*?)(\"\"\"|\z)|'([^'\\]|\\(?s:.))*('|\\?\z)|"([^"\\]|\\(?s:.))*("|\\?\z)|`([^`\\]|\\(?s:.))*(`|\\?\z)""".replace('\\"', '"')
MASK_SQL = MASK.replace("'", "''")
#: Pieces of text between matches, and the matches, interleaved.
def masked(text: str = "html") -> str:
    return f"""masked AS (SELECT url AS path, html AS text,
  (SELECT string_agg(coalesce(c, '') || coalesce(regexp_replace(h, '[^\\n]', ' ', 'g'), ''), '' ORDER BY i) FROM (
    SELECT unnest(range(1, len(code) + 1)) AS i, unnest(code) AS c, unnest(list_resize(hidden, len(code))) AS h)) AS masked
  FROM (SELECT url, html, regexp_split_to_array(html, '{MASK_SQL}') AS code, regexp_extract_all(html, '{MASK_SQL}') AS hidden FROM (SELECT url, {text} AS html FROM pages)))"""


MASKED = masked()
STEPS = """steps AS (SELECT path, ln, k, brace, CASE brace WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END AS value
  FROM (SELECT path, ln, unnest(range(1, len(bs) + 1)) AS k, unnest(bs) AS brace FROM (SELECT path, ln, CASE WHEN len(regexp_extract_all(line, '[{}]')) = 0 THEN [''] ELSE regexp_extract_all(line, '[{}]') END AS bs FROM mlines))),
run AS (SELECT *, sum(value) OVER w AS s FROM steps WINDOW w AS (PARTITION BY path ORDER BY ln, k ROWS UNBOUNDED PRECEDING)),
low AS (SELECT *, least(0, min(s) OVER (PARTITION BY path ORDER BY ln, k ROWS UNBOUNDED PRECEDING)) AS low FROM run)"""
LINES_OF = "(SELECT path, unnest(range(1, len(ls) + 1)) AS ln, unnest(ls) AS line FROM (SELECT path, string_split(CASE WHEN right({0}, 1) = chr(10) THEN left({0}, length({0}) - 1) ELSE {0} END, chr(10)) AS ls FROM masked))"
MLINES = f"mlines AS {LINES_OF.format('masked')}"
OLINES = f"olines AS {LINES_OF.format('text')}"

PARAGRAPHS = f"""paragraphs AS (SELECT path, 'paragraph' AS kind, {TOKENS.format("array_to_string(list_slice(ls, j, j + 3), chr(10))")}[1] AS name, CAST(j AS BIGINT) AS start_line, CAST(least(j + 3, len(ls)) AS BIGINT) AS end_line
  FROM (SELECT path, ls, unnest(range(1, len(ls) + 1, 4)) AS j FROM lined)), symbols AS (SELECT * FROM paragraphs WHERE name IS NOT NULL)"""
MENTIONS = f"""mentions AS (SELECT DISTINCT symbol, path, line FROM (SELECT path, line, unnest({TOKENS.format('t')}) AS symbol FROM (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM lined))
  WHERE (path, symbol) IN (SELECT path, name FROM symbols))"""
PROMPTS = f"""prompts AS (SELECT item_id AS prompt_id, text AS prompt, {TOKENS.format('text')} AS words FROM benchmark), firsts AS (
  SELECT prompt_id, w, min(i) AS i FROM (SELECT prompt_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM prompts) WHERE length(w) >= 3 GROUP BY ALL
), keyed AS (
  SELECT prompt_id, 0 AS query_index, prompt AS query FROM prompts
  UNION ALL SELECT prompt_id, k AS query_index, w FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY i) AS k FROM firsts) WHERE k <= 8
)"""


def asked(base: int) -> str:
    return f"asked AS (SELECT prompt_id, CAST(query_index AS BIGINT) AS query_index, query, CAST(CASE WHEN query_index = 0 THEN {base} ELSE least({base}, greatest(5, {base} // 4)) END AS BIGINT) AS k, prompt_id * 16 + query_index AS query_id FROM keyed)"


HITS = f"""{chunks(12, 3)}, {PROMPTS}, {asked(20)}, {bm25('asked', name='every')}, hits AS (
  SELECT prompt_id, query_index, query AS source_query, path, start_line, end_line, score, terms FROM every JOIN asked USING (query_id) WHERE rank <= k AND NOT {TEST}
)"""
RAW_HITS = HITS.replace(f" AND NOT {TEST}", "")
RANKED = f"""{HITS}, {PARAGRAPHS}, {MENTIONS}, numbered AS (SELECT *, row_number() OVER (ORDER BY prompt_id, query_index, path, start_line) AS id FROM hits),
met AS (SELECT id, s.name, s.start_line AS s, s.end_line AS e, row_number() OVER (PARTITION BY id ORDER BY s.end_line - s.start_line, s.start_line, s.end_line, s.name, s.kind) AS k
  FROM numbered n JOIN symbols s ON n.path = s.path AND s.end_line >= n.start_line AND s.start_line <= n.end_line),
aligned AS (SELECT n.* REPLACE (coalesce(m.s, n.start_line) AS start_line, coalesce(m.e, n.end_line) AS end_line), m.name AS aligned_symbol FROM numbered n LEFT JOIN met m ON n.id = m.id AND m.k = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, path, start_line, end_line ORDER BY score DESC, source_query, query_index, id) AS n FROM aligned) WHERE n = 1),
near AS (SELECT b.id, count(*) FILTER (line BETWEEN b.start_line AND b.end_line) AS c, min(greatest(b.start_line - line, line - b.end_line, 0)) AS d FROM best b JOIN mentions m ON m.symbol = b.aligned_symbol AND m.path = b.path GROUP BY b.id),
signals AS (SELECT b.*, coalesce(c, 0) AS reference_count_in_range, coalesce(d, 1000000000) AS min_definition_distance,
  coalesce(list_has_any({TOKENS.format("replace(aligned_symbol, '.', ' ')")}, words), false) AS definition_match,
  CAST(len(list_intersect(list_distinct({TOKENS.format("regexp_replace(path, '[/.]', ' ', 'g')")}), list_distinct(words))) AS BIGINT) AS path_name_relevance,
  CAST(greatest(0, end_line - start_line + 1) AS BIGINT) AS range_size_penalty, path || ':' || start_line || ':' || end_line || ':' || source_query AS candidate_id
  FROM best b LEFT JOIN near USING (id) JOIN prompts USING (prompt_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY definition_match DESC, reference_count_in_range DESC, min_definition_distance, path_name_relevance DESC, score DESC, range_size_penalty, path, start_line, end_line, source_query, candidate_id) AS rank_position FROM signals)"""
JUDGED = f"""{RANKED}, fold AS (
  SELECT prompt_id, CAST(0 AS BIGINT) AS at, CAST([] AS VARCHAR[]) AS files, CAST(0 AS BIGINT) AS lines, '' AS verdict, '' AS path FROM prompts
  UNION ALL
  SELECT prompt_id, rank_position, CASE WHEN verdict = 'selected' AND NOT list_contains(files, path) THEN list_append(files, path) ELSE files END, CASE WHEN verdict = 'selected' THEN lines + size ELSE lines END, verdict, path FROM (
    SELECT f.prompt_id, r.rank_position, f.files, f.lines, r.path, r.range_size_penalty AS size,
      CASE WHEN r.range_size_penalty = 0 THEN 'zero_lines' WHEN len(f.files) + CASE WHEN list_contains(f.files, r.path) THEN 0 ELSE 1 END > 3 THEN 'file_budget' WHEN f.lines + r.range_size_penalty > 12 THEN 'line_budget' ELSE 'selected' END AS verdict
    FROM fold f JOIN ranked r ON r.prompt_id = f.prompt_id AND r.rank_position = f.at + 1)
), judged AS (SELECT r.*, f.verdict FROM ranked r JOIN fold f ON f.prompt_id = r.prompt_id AND f.at = r.rank_position)"""
SNAPSHOTS = f"""{CORPUS}, {RECORDS}, old AS (SELECT *, mtime_ns AS id FROM records WHERE mtime_ns % 11 <> 0), new AS (
  SELECT path, size, CASE WHEN mtime_ns % 19 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns, CASE WHEN mtime_ns % 13 = 0 THEN reverse(content_hash) ELSE content_hash END AS content_hash FROM records WHERE mtime_ns % 17 <> 0)"""
AUDIT = "audit AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(date_part('millisecond', ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS timestamp, event_type AS tool, props FROM events)"
LEAVES = "regexp_matches(lower(path), '[.]({0})$')"

SQL: dict[str, str] = {
    "tokenize_terms": f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "snippets": f"WITH {CORPUS}, {LINED} SELECT doc_id, left(array_to_string(list_slice(ls, 1, 3), chr(10)), 300) AS snippet FROM lined",
    "binary_sniff": f"SELECT doc_id, {CUT} OR contains(text, chr(0)) AS is_binary FROM documents",
    "evidence_lines": r"SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS at, left(trim(regexp_replace(l, '\s+', ' ', 'g')), 160) AS evidence FROM (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT conv_id, turn, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM conversations WHERE text <> ''))",
    "prompt_fingerprints": "SELECT item_id, sha256(text) AS fingerprint FROM benchmark",
    "discovery_ext_glob_filter": f"WITH {STRANGE} SELECT path, count(*) AS n FROM strange WHERE {ALLOWED} AND NOT {EXCLUDED} GROUP BY path",
    "discovery_counters": f"WITH {STRANGE} SELECT count(*) AS total, count(*) FILTER ({EXCLUDED}) AS excluded_by_glob, count(*) FILTER (NOT {EXCLUDED} AND NOT {ALLOWED}) AS excluded_by_extension, count(*) FILTER (NOT {EXCLUDED} AND {ALLOWED}) AS selected FROM strange",
    "policy_denylist": f"WITH {STRANGE} SELECT path, count(*) AS n, count(*) FILTER (size > 2000) AS large, bool_or({DENIED}) AS denied, bool_or({HIDDEN}) AS hidden, bool_or({TEST}) AS test FROM strange GROUP BY path",
    "block_reasons": f"WITH {STRANGE} SELECT CASE WHEN {DENIED} THEN 'denylist' WHEN size > 5000 THEN 'file_size' ELSE 'allowed' END AS reason, count(*) AS n FROM strange GROUP BY reason",
    "index_delta": f"WITH {SNAPSHOTS} SELECT path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN old.size = new.size AND old.mtime_ns = new.mtime_ns AND old.content_hash = new.content_hash THEN 'unchanged' ELSE 'updated' END AS change FROM old FULL JOIN new USING (path)",
    "index_delta_force": f"WITH {SNAPSHOTS} SELECT CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'updated' END AS change, count(*) AS n FROM old FULL JOIN new USING (path) GROUP BY change",
    "list_files_component_order": f"WITH {STRANGE}, kept AS (SELECT path, max(size) AS size FROM strange WHERE NOT {HIDDEN} AND NOT {DENIED} GROUP BY path) SELECT path, size, position FROM (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM kept) WHERE position <= 50",
    "open_file_slice": f"WITH {CORPUS}, {LINED} SELECT path, line, text FROM (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM lined) WHERE line BETWEEN 3 AND 6",
    "chunks_default": f"WITH {chunks()} SELECT path, start_line, end_line, chunk_id FROM chunks",
    "chunks_small": f"WITH {chunks(12, 3)} SELECT path, start_line, end_line, chunk_id FROM chunks",
    "postings": f"WITH {chunks()} SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(words) AS dl, unnest(words) AS term FROM (SELECT chunk_id, {TOKENS.format('text')} AS words FROM chunks)) GROUP BY ALL",
    "doc_freq": f"WITH {chunks()} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM (SELECT chunk_id, unnest({TOKENS.format('text')}) AS term FROM chunks) GROUP BY term",
    "corpus_stats": f"WITH {chunks()} SELECT count(*) AS n, round(sum(len({TOKENS.format('text')})) / count(*), 6) AS avgdl FROM chunks",
    "bm25_top10": f"WITH {chunks()}, {ONE}, {bm25('one')} SELECT {SHOWN} FROM hits WHERE rank <= 10",
    "bm25_prefix": f"WITH {chunks()}, {ONE}, {bm25('one', 'starts_with(path, $$src1/en/$$)')} SELECT {SHOWN} FROM hits WHERE rank <= 10",
    "bm25_glob": f"WITH {chunks()}, {ONE}, {bm25('one', 'regexp_full_match(path, $$src[^0-4]/.*/doc_.......[.]md$$)')} SELECT {SHOWN} FROM hits WHERE rank <= 10",
    "bm25_batch": f"WITH {chunks()}, {BENCH}, {bm25('bench')} SELECT {SHOWN} FROM hits WHERE rank <= 10",
    "bm25_small_chunks": f"WITH {chunks(12, 3)}, {BENCH}, {bm25('bench')} SELECT {SHOWN} FROM hits WHERE rank <= 5",
    "cosine_topk": f"WITH {VECTORS}, {NEAR.format(vectors='vectors', tie='vec_id')} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM near WHERE rank <= 10",
    "cosine_scoped": f"WITH {VECTORS}, scoped AS (SELECT * FROM vectors WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)), {NEAR.format(vectors='scoped', tie='vec_id')} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM near WHERE rank <= 5",
    "vector_refresh_plan": "WITH stored AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id FROM embeddings WHERE vec_id % 7 <> 0), wanted AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id % 5 <> 0) SELECT chunk_id, CASE WHEN stored.chunk_id IS NULL THEN 'embed' WHEN wanted.chunk_id IS NULL THEN 'remove' ELSE 'reuse' END AS action FROM stored FULL JOIN wanted USING (chunk_id)",
    "mean_pool_l2": f"WITH {VECTORS}, means AS (SELECT label, dim, avg(value) AS m FROM (SELECT label, unnest(range(0, len(v))) AS dim, unnest(v) AS value FROM vectors) GROUP BY ALL), norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY label) SELECT label, dim, round(CASE WHEN n = 0 THEN m ELSE m / n END, 6) AS value FROM means JOIN norms USING (label)",
    "rrf_hybrid": f"""WITH {CORPUS}, {LINED}, whole AS (SELECT l.doc_id, l.path, CAST(1 AS BIGINT) AS start_line, CAST(len(ls) AS BIGINT) AS end_line, c.text FROM lined l JOIN corpus c USING (doc_id)), {VECTORS},
bench AS (SELECT item_id * 100 AS query_id, text AS query FROM benchmark WHERE item_id * 100 IN (SELECT vec_id FROM embeddings)), {bm25('bench', docs='whole', key='doc_id', name='words')},
placed AS (SELECT v.*, w.path, w.start_line, w.end_line FROM vectors v JOIN whole w ON w.doc_id = v.vec_id), asked AS (SELECT vec_id AS query_id, v AS q FROM vectors WHERE vec_id IN (SELECT query_id FROM bench)),
sims AS (SELECT query_id, path, start_line, end_line, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM placed, asked),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line) AS rank FROM sims),
both_ AS (SELECT query_id, path, start_line, end_line, rank, terms FROM words WHERE rank <= 20 UNION ALL SELECT query_id, path, start_line, end_line, rank, CAST([] AS VARCHAR[]) FROM near WHERE rank <= 20),
fused AS (SELECT query_id, path, start_line, end_line, sum(1.0 / (60 + rank)) AS score, list_sort(list_distinct(flatten(list(terms)))) AS terms FROM both_ GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line, end_line) AS rank FROM fused) SELECT {SHOWN} FROM hits WHERE rank <= 20""",
    "mask_code": f"WITH {MASKED} SELECT path, md5(masked) AS masked_md5 FROM masked",
    "identifier_tokens": f"WITH {MASKED}, {MLINES} SELECT token, count(*) AS n, count(DISTINCT path) AS paths, max(ln) AS last_line FROM (SELECT path, ln, unnest(regexp_extract_all(line, '[A-Za-z_$][A-Za-z0-9_$]*')) AS token FROM mlines) GROUP BY token",
    "brace_depth": f"WITH {MASKED}, {MLINES}, {STEPS}, ends AS (SELECT path, ln, arg_max(s - low, k) AS after FROM low GROUP BY ALL) SELECT path, ln AS line, CAST(lag(after, 1, 0) OVER (PARTITION BY path ORDER BY ln) AS BIGINT) AS depth FROM ends",
    "brace_blocks": f"WITH {MASKED}, {MLINES}, {STEPS}, braces AS (SELECT *, lag(low, 1, 0) OVER (PARTITION BY path ORDER BY ln, k) AS before FROM low), kept AS (SELECT *, s - low + CASE WHEN value = 1 THEN 0 ELSE 1 END AS depth FROM braces WHERE value = 1 OR (value = -1 AND low = before)), pairs AS (SELECT *, lead(ln) OVER (PARTITION BY path, depth ORDER BY ln, k) AS e FROM kept) SELECT path, ln AS start_line, e AS end_line, CAST(depth AS BIGINT) AS depth FROM pairs WHERE value = 1 AND e IS NOT NULL",
    "lexical_refs": rf"""WITH {masked("replace(replace(html, ';', ';' || chr(10)), '><', '>' || chr(10) || '<')")}, {MLINES}, {OLINES}, asked AS (SELECT unnest(['track', 'window.track', 'document', 'push']) AS symbol, unnest(['track', 'track', 'document', 'push']) AS short, unnest([NULL, 'window\s*([.]|::)\s*track', NULL, NULL]) AS seq),
lines_ AS (SELECT path, ln, m.line AS masked, o.line AS original FROM mlines m JOIN olines o USING (path, ln)), met AS (SELECT *, regexp_matches(masked, '(^|[^A-Za-z0-9_$])' || short || '($|[^A-Za-z0-9_$])') AS alone,
  regexp_matches(masked, short || '\s*\(') AS called, regexp_matches(masked, '\bnew\s+' || short || '\b') AS created, regexp_matches(masked, '\b(import|from|using|use|require|include)\b') AS imports,
  regexp_matches(masked, '\b(extends|implements|inherits|:\s*public|:\s*private)\b') AS inherits, regexp_matches(masked, '\b(class|struct|interface|enum|record|trait|type|namespace|package|module|impl|func|fn|def)\b') AS declares,
  coalesce(regexp_matches(masked, '(^|[^A-Za-z0-9_$])' || seq || '($|[^A-Za-z0-9_$])'), false) AS sequenced FROM lines_, asked WHERE list_contains(regexp_extract_all(masked, '[A-Za-z_$][A-Za-z0-9_$]*'), short))
SELECT symbol, path, ln AS line, CASE WHEN imports THEN 'import' WHEN inherits THEN 'inheritance' WHEN created THEN 'instantiation' WHEN called THEN 'call' ELSE 'read' END AS kind,
  left(trim(regexp_replace(original, '\s+', ' ', 'g')), 160) AS evidence, CASE WHEN imports OR inherits OR created THEN 'high' WHEN called THEN 'medium' ELSE 'low' END AS confidence
FROM met WHERE (sequenced OR (alone AND (called OR created OR imports OR inherits))) AND NOT (declares AND alone) AND trim(original) <> ''""",
    "keyword_queries": f"WITH {PROMPTS}, {asked(50)} SELECT prompt_id, query_index, query, k FROM asked",
    "dedupe_hits": f"WITH {RAW_HITS} SELECT prompt_id, path, start_line, end_line, source_query, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, path, start_line, end_line ORDER BY score DESC, source_query, query_index) AS n FROM hits) WHERE n = 1",
    "align_hits": f"WITH {chunks(12, 3)}, {PARAGRAPHS}, met AS (SELECT chunk_id, s.name, s.start_line AS s, s.end_line AS e, row_number() OVER (PARTITION BY chunk_id ORDER BY s.end_line - s.start_line, s.start_line, s.end_line, s.name) AS k FROM chunks c JOIN symbols s ON s.path = c.path AND s.end_line >= c.start_line AND s.start_line <= c.end_line) SELECT c.chunk_id AS hit_id, c.path, coalesce(s, start_line) AS start_line, coalesce(e, end_line) AS end_line, name AS aligned_symbol FROM chunks c LEFT JOIN met m ON m.chunk_id = c.chunk_id AND m.k = 1",
    "reference_proximity": f"WITH {CORPUS}, {LINED}, {PARAGRAPHS}, {MENTIONS} SELECT s.path || ':' || s.start_line AS hit_id, count(*) FILTER (line BETWEEN start_line AND end_line) AS reference_count_in_range, coalesce(min(greatest(start_line - line, line - end_line, 0)), 1000000000) AS min_definition_distance FROM symbols s LEFT JOIN mentions m ON m.path = s.path AND m.symbol = s.name GROUP BY s.path, s.start_line",
    "bundle_rank": f"WITH {RANKED} SELECT prompt_id, rank_position, path, start_line, end_line, source_query, aligned_symbol, definition_match, reference_count_in_range, min_definition_distance, path_name_relevance, range_size_penalty FROM ranked",
    "ranking_debug": f"WITH RECURSIVE {JUDGED} SELECT prompt_id, rank_position, candidate_id, verdict = 'selected' AS selected FROM judged WHERE rank_position <= 20",
    "bundle_select": f"WITH RECURSIVE {JUDGED} SELECT prompt_id, rank_position, path, verdict FROM judged",
    "why_not_selected": f"WITH RECURSIVE {JUDGED} SELECT prompt_id, count(DISTINCT path) FILTER (verdict = 'selected') AS selected_files, CAST(coalesce(sum(end_line - start_line + 1) FILTER (verdict = 'selected'), 0) AS BIGINT) AS selected_lines, bool_or(verdict IN ('file_budget', 'line_budget')) AS truncated, count(*) FILTER (verdict <> 'selected') AS total_skipped_candidates, count(*) FILTER (verdict = 'file_budget') AS file_budget, count(*) FILTER (verdict = 'line_budget') AS line_budget, count(*) FILTER (verdict = 'zero_lines') AS zero_lines, count(*) FILTER (verdict = 'other') AS other FROM judged GROUP BY prompt_id",
    "bundle_citations": f"WITH RECURSIVE {JUDGED} SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY rank_position) - 1 AS selection_index, j.path, start_line, end_line, array_to_string(list_slice(ls, start_line, end_line), chr(10)) AS excerpt, source_query FROM judged j JOIN lined l ON l.path = j.path WHERE verdict = 'selected'",
    "bundle_notes": f"WITH RECURSIVE {JUDGED} SELECT prompt_id, rank_position, 'skipped_' || verdict || ':' || path || ':' || start_line || '-' || end_line AS note FROM judged WHERE verdict <> 'selected'",
    "audit_since_limit": f"WITH {AUDIT} SELECT seq, timestamp, tool FROM audit WHERE timestamp >= '2024-01-01T00:00:00.000Z' ORDER BY seq DESC LIMIT 50",
    "audit_sanitized": f"WITH {AUDIT} SELECT seq, tool AS path, 'true' AS query_present, CAST(length(props) AS VARCHAR) AS query_length, CAST(3 AS BIGINT) AS entries FROM audit",
    "adapter_stats": f"WITH {STRANGE} SELECT CASE WHEN {LEAVES.format('py')} THEN 'python' WHEN {LEAVES.format('cs')} THEN 'csharp_lexical' WHEN {LEAVES.format('cpp|cc|cxx|hpp|hh|hxx|h')} THEN 'cpp_lexical' WHEN {LEAVES.format('go')} THEN 'go_lexical' WHEN {LEAVES.format('java')} THEN 'java_lexical' WHEN {LEAVES.format('rs')} THEN 'rust_lexical' WHEN {LEAVES.format('ts|tsx|mts|cts|js|jsx|mjs|cjs')} THEN 'ts_js_lexical' ELSE 'lexical' END AS language, count(*) AS paths, CAST(sum(size) AS BIGINT) AS chars FROM strange GROUP BY language",
    "bench_drift": "WITH g AS (SELECT l_returnflag AS scenario, l_linestatus AS step, min(l_quantity) FILTER (l_orderkey % 2 <> 0) AS min_now, max(l_quantity) FILTER (l_orderkey % 2 <> 0) AS max_now, avg(l_quantity) FILTER (l_orderkey % 2 <> 0) AS a, avg(l_quantity) FILTER (l_orderkey % 2 = 0) AS b FROM lineitem GROUP BY ALL) SELECT scenario, step, min_now, max_now, round(a, 6) AS mean_now, round(b, 6) AS mean_base, round(100.0 * (a - b) / b, 4) AS drift_percent, 100.0 * (a - b) / b > 20.0 AS warn FROM g",
}
SQL["file_records_sha256"] = f"WITH {CORPUS}, {RECORDS} SELECT * FROM records"

# Sources made from rows by fixed templates: what is declared and used stands at known lines.
PATH = "'gen/f' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || ['.py', '.go', '.rs'][doc_id % 3 + 1]"
SYMBOLS = f"""symbols AS (SELECT {PATH} AS path, * EXCLUDE (doc_id, k) FROM (
  SELECT doc_id, 0 AS k, 'python' AS language, 'class' AS kind, 'C' || doc_id AS name, '(Base)' AS signature, 3 AS start_line, 7 AS end_line, 'Doc ' || doc_id || '.' AS doc, NULL AS parent_symbol, 'module' AS scope_kind, false AS is_conditional FROM documents
  UNION ALL SELECT doc_id, 0, 'python', 'method', 'C' || doc_id || '.load', '(self, x)', 6, 7, NULL, 'C' || doc_id, 'class', false FROM documents
  UNION ALL SELECT doc_id, 0, 'python', 'function', 'main' || doc_id % 5, '()', 9, 10, NULL, NULL, 'module', false FROM documents
  UNION ALL SELECT doc_id, 1, 'go_lexical', 'type', 'gen.T' || doc_id, NULL, 3, 5, NULL, NULL, 'module', NULL FROM documents
  UNION ALL SELECT doc_id, 1, 'go_lexical', 'method', 'gen.T' || doc_id || '.Run', '(x int)', 7, 9, NULL, 'gen.T' || doc_id, 'class', NULL FROM documents
  UNION ALL SELECT doc_id, 1, 'go_lexical', 'function', 'gen.make' || doc_id % 5, '()', 11, 13, NULL, NULL, 'module', NULL FROM documents
  UNION ALL SELECT doc_id, 2, 'rust_lexical', 'struct', 'S' || doc_id, NULL, 1, 1, NULL, NULL, 'module', NULL FROM documents
  UNION ALL SELECT doc_id, 2, 'rust_lexical', 'impl', 'S' || doc_id, NULL, 2, 6, NULL, NULL, 'module', NULL FROM documents
  UNION ALL SELECT doc_id, 2, 'rust_lexical', 'method', 'S' || doc_id || '.turn', '(&self)', 3, 5, NULL, 'S' || doc_id, 'class', NULL FROM documents
  UNION ALL SELECT doc_id, 2, 'rust_lexical', 'const', 'L' || doc_id % 5, NULL, 7, 7, NULL, NULL, 'module', NULL FROM documents
) WHERE doc_id % 3 = k)"""
SQL["outline_sources"] = f"WITH {SYMBOLS} SELECT path, language, kind, name, signature, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, doc, parent_symbol, scope_kind, is_conditional, CAST(NULL AS VARCHAR) AS decl_context FROM symbols"
USES = f"""found AS (SELECT 'helper' || doc_id % 7 AS symbol, {PATH} AS path, [7, 8, 4][doc_id % 3 + 1] AS line, 'call' AS kind,
  CASE doc_id % 3 WHEN 0 THEN 'helper' || doc_id % 7 || '()' WHEN 1 THEN 'return helper' || doc_id % 7 || '(x)' ELSE 'helper' || doc_id % 7 || '(self.n)' END AS evidence, CASE doc_id % 3 WHEN 0 THEN 'ast' ELSE 'lexical' END AS strategy, 'medium' AS confidence FROM documents)"""
SQL["python_refs"] = f"""SELECT symbol, {PATH} AS path, CAST(line AS BIGINT) AS line, kind, evidence, 'ast' AS strategy, confidence FROM (
  SELECT doc_id, 'json' AS symbol, 1 AS line, 'import' AS kind, 'import json' AS evidence, 'high' AS confidence FROM documents
  UNION ALL SELECT doc_id, 'helper' || doc_id % 7, 7, 'call', 'helper' || doc_id % 7 || '()', 'medium' FROM documents
  UNION ALL SELECT doc_id, unnest(['load', 'Store.load']), 10, 'call', 'C' || doc_id || '.load()', 'medium' FROM documents) WHERE doc_id % 3 = 0"""
SQL["references_limited"] = f"""WITH {USES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS rank, count(*) OVER (PARTITION BY symbol) AS total_candidates FROM found)
SELECT symbol, path, CAST(line AS BIGINT) AS line, kind, evidence, strategy, confidence, rank, total_candidates, total_candidates > 50 AS truncated FROM numbered WHERE rank <= 50"""
SQL["reference_profile"] = "SELECT ['python', 'go_lexical', 'rust_lexical'][doc_id % 3 + 1] AS language, count(*) AS files, CAST(sum([126, 124, 121][doc_id % 3 + 1] + [3, 4, 2][doc_id % 3 + 1] * length(CAST(doc_id AS VARCHAR))) AS BIGINT) AS chars, count(*) AS files_with_references, count(*) AS references, count(*) FILTER (doc_id % 3 = 0) AS ast FROM documents GROUP BY 1"
SQL["find_definition"] = f"""WITH {SYMBOLS}, asked AS (SELECT unnest(['load', 'gen.Run', 'turn', 'main3', 'C12.load', 'nothing']) AS symbol), met AS (
  SELECT symbol, s.* FROM symbols s, asked WHERE name = symbol OR name = list_last(string_split(symbol, '.')) OR list_last(string_split(name, '.')) = symbol
), numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, start_line, end_line, name, kind) AS rank, count(*) OVER (PARTITION BY symbol) AS total_candidates FROM met)
SELECT symbol, path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, kind, name, signature, scope_kind, rank, total_candidates, total_candidates > 50 AS truncated FROM numbered WHERE rank <= 50"""
SQL["vector_refresh"] = "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(len(embedding) AS BIGINT) AS size, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, CAST(length(text) AS DOUBLE) FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0)"
SQL["mean_pool_masked"] = f"WITH {VECTORS}, means AS (SELECT label, dim, coalesce(avg(value) FILTER (vec_id % 3 <> 0), 0.0) AS m FROM (SELECT vec_id, label, unnest(range(0, len(v))) AS dim, unnest(v) AS value FROM vectors) GROUP BY ALL), norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY label) SELECT label, dim, round(CASE WHEN n = 0 THEN m ELSE m / n END, 6) AS value FROM means JOIN norms USING (label)"
SQL["identifier_columns"] = f"""WITH {MASKED}, {MLINES}, cut AS (SELECT path, ln, regexp_extract_all(line, '[A-Za-z_$][A-Za-z0-9_$]*') AS ts, regexp_split_to_array(line, '[A-Za-z_$][A-Za-z0-9_$]*') AS gs FROM mlines),
flat AS (SELECT path, ln, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS token, unnest(list_slice(gs, 1, len(ts))) AS gap FROM cut WHERE len(ts) > 0),
placed AS (SELECT token, sum(length(gap) + length(token)) OVER (PARTITION BY path, ln ORDER BY i) AS e FROM flat)
SELECT token, count(*) AS n, CAST(min(e - length(token) + 1) AS BIGINT) AS first_col, CAST(max(e) AS BIGINT) AS last_col, CAST(sum(e - length(token) + 1) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM placed GROUP BY token"""
SQL["unmatched_braces"] = f"""WITH {masked("repeat('}', page_id % 4) || html || repeat('{{ ', page_id % 3)").replace("{{ ", "{ ")}, bs AS (SELECT path, regexp_extract_all(masked, '[{{}}]') AS b FROM masked), each AS (SELECT path, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS c FROM bs),
sums AS (SELECT path, i, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY i) AS s FROM each), ends AS (SELECT path, arg_max(s, i) AS s, least(0, min(s)) AS low FROM sums GROUP BY path)
SELECT path, CAST(sum(coalesce(s - low, 0)) AS BIGINT) AS unmatched_open, CAST(sum(coalesce(-low, 0)) AS BIGINT) AS unmatched_close FROM (SELECT path FROM masked) LEFT JOIN ends USING (path) GROUP BY path"""
SQL["bundle_documents"] = f"""WITH RECURSIVE {JUDGED}, chosen AS (SELECT j.prompt_id, j.path, start_line, end_line, row_number() OVER (PARTITION BY prompt_id ORDER BY rank_position) - 1 AS i, array_to_string(list_slice(ls, start_line, end_line), chr(10)) AS excerpt FROM judged j JOIN lined l ON l.path = j.path WHERE verdict = 'selected'),
sums AS (SELECT prompt_id, count(*) AS after, least(count(*), 20) AS n_top, count(DISTINCT path) FILTER (verdict = 'selected') AS files, coalesce(sum(end_line - start_line + 1) FILTER (verdict = 'selected'), 0) AS lines, bool_or(verdict IN ('file_budget', 'line_budget')) AS truncated, count(*) FILTER (verdict = 'selected') AS n, count(*) FILTER (verdict <> 'selected') AS skipped, count(*) FILTER (verdict = 'line_budget') AS line_budget FROM judged GROUP BY prompt_id),
counted AS (SELECT prompt_id, count(*) AS before FROM hits GROUP BY prompt_id), questions AS (SELECT prompt_id, count(*) AS n_queries FROM asked GROUP BY prompt_id)
SELECT p.prompt_id, sha256(p.prompt) AS fingerprint, CAST(3 AS BIGINT) AS max_files, coalesce(files, 0) AS files, CAST(coalesce(lines, 0) AS BIGINT) AS lines, coalesce(truncated, false) AS truncated, CASE WHEN n > 0 THEN n END AS n_selections, CASE WHEN n > 0 THEN n END AS n_citations, n_queries, coalesce(skipped, 0) AS n_notes, coalesce(before, 0) AS before, coalesce(after, 0) AS after, n_top,
  c.path AS first_path, c.excerpt AS first_excerpt, coalesce(line_budget, 0) AS line_budget, coalesce(skipped, 0) AS skipped
FROM prompts p LEFT JOIN sums USING (prompt_id) LEFT JOIN counted USING (prompt_id) LEFT JOIN questions USING (prompt_id) LEFT JOIN chosen c ON c.prompt_id = p.prompt_id AND c.i = 0"""
SQL["bundle_explanations"] = f"""WITH RECURSIVE {JUDGED} SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY rank_position) - 1 AS selection_index,
  'Selected from query ' || chr(39) || source_query || chr(39) || ' with score; matched_terms=' || CASE WHEN len(terms) > 0 THEN array_to_string(terms, ', ') ELSE 'none' END || '.' || coalesce(' aligned_symbol=' || aligned_symbol || '.', '') AS rationale,
  array_to_string(list_filter(['search_score', CASE WHEN len(terms) > 0 THEN 'matched_terms' END, CASE WHEN definition_match THEN 'definition_match' END, CASE WHEN reference_count_in_range > 0 THEN 'reference_proximity' END, CASE WHEN aligned_symbol IS NOT NULL THEN 'aligned_symbol' END], lambda x: x IS NOT NULL), ',') AS signals, array_to_string(terms, ' ') AS terms FROM judged WHERE verdict = 'selected'"""

# What an index holds after its refreshes is what a plain pass finds; files that look binary are not in it.
INDEXED = CORPUS.replace("FROM documents)", f"FROM documents WHERE text IS NOT NULL AND NOT {CUT} AND NOT contains(text, chr(0)))")
SQL |= {f"indexed_{new}": SQL[old].replace(CORPUS, INDEXED) for new, old in (("search", "bm25_batch"), ("prefix", "bm25_prefix"), ("references", "references_limited"), ("definitions", "find_definition"), ("outline", "outline_sources"))}
SQL["cosine_pruned"] = SQL["cosine_topk"]

# Of more languages: (which of the eight templates, kind, name, signature, first and last line in the template, owner); {0} is the row's id.
DECLARED = [
    (0, "interface", "Runner{0}", "()", 2, 4, ""), (0, "enum", "Mode{0}", "()", 5, 5, ""), (0, "type_alias", "Result{0}", None, 6, 6, ""), (0, "class", "Service{0}", "()", 7, 12, ""),
    (0, "method", "Service{0}.constructor", "(private n: number)", 8, 8, "Service{0}"), (0, "async_method", "Service{0}.run", "(x: string)", 9, 11, "Service{0}"),
    (0, "async_function", "build{0}", "(x: number)", 13, 15, ""), (0, "exported_variable", "NAME{0}", None, 16, 16, ""),
    (1, "class", "Worker{0}", "()", 1, 6, ""), (1, "method", "Worker{0}.run", "(task)", 2, 4, "Worker{0}"), (1, "method", "Worker{0}.from", "(x)", 5, 5, "Worker{0}"),
    (1, "function", "helper{0}", "(a, b)", 7, 10, ""), (1, "exported_variable", "main{0}", None, 11, 11, ""),
    (2, "interface", "org.made.p{0}.Runner", "()", 3, 5, ""), (2, "method", "org.made.p{0}.Runner.run", "(int n)", 4, 4, "org.made.p{0}.Runner"), (2, "enum", "org.made.p{0}.Mode", "()", 6, 6, ""),
    (2, "type", "org.made.p{0}.Pair{0}", "()", 7, 7, ""), (2, "class", "org.made.p{0}.Service{0}", "()", 8, 16, ""),
    (2, "constructor", "org.made.p{0}.Service{0}.Service{0}", "(int n)", 10, 12, "org.made.p{0}.Service{0}"), (2, "method", "org.made.p{0}.Service{0}.run", "(int n)", 13, 15, "org.made.p{0}.Service{0}"),
    (3, "const", "work.First{0}", None, 4, 4, ""), (3, "const", "work.Second{0}", None, 5, 5, ""), (3, "var", "work.Flag{0}", None, 8, 8, ""), (3, "var", "work.left{0}", None, 11, 11, ""),
    (3, "type", "work.Box{0}", None, 14, 16, ""), (3, "method", "work.Box{0}.Open", "(x int)", 18, 20, "work.Box{0}"), (3, "function", "work.Make{0}", "()", 22, 24, ""),
    (4, "mod", "engine{0}", None, 1, 2, ""), (4, "enum", "Mode{0}", None, 3, 5, ""), (4, "trait", "Turn{0}", None, 6, 8, ""), (4, "impl", "Box", None, 9, 13, ""),
    (4, "method", "Box.turn", "(&self)", 10, 12, "Box"), (4, "type", "Text{0}", None, 14, 14, ""), (4, "function", "build{0}", "(n: u32)", 15, 17, ""),
    (5, "namespace", "made{0}", None, 1, 14, ""), (5, "class", "Gear{0}", "()", 2, 6, ""), (5, "method", "Gear{0}.Gear{0}", "(int teeth)", 4, 4, "Gear{0}"), (5, "method", "Gear{0}.turn", "(int by)", 5, 5, "Gear{0}"),
    (5, "struct", "Config{0}", "()", 7, 9, ""), (5, "enum", "Mode{0}", None, 10, 10, ""), (5, "function", "parse{0}", "(int x)", 11, 13, ""),
    (6, "namespace", "Made.N{0}", None, 1, 1, ""), (6, "interface", "Made.N{0}.IRunner", "()", 3, 6, ""), (6, "method", "Made.N{0}.IRunner.Run", "(int n)", 5, 5, "Made.N{0}.IRunner"), (6, "enum", "Made.N{0}.Mode", "()", 7, 11, ""),
    (6, "record", "Made.N{0}.Result{0}", "()", 12, 12, ""), (6, "class", "Made.N{0}.Tool{0}", "()", 13, 26, ""), (6, "property", "Made.N{0}.Tool{0}.Name", None, 15, 15, ""), (6, "event", "Made.N{0}.Tool{0}.Changed", None, 16, 16, ""),
    (6, "constructor", "Made.N{0}.Tool{0}.Tool{0}", "(string name)", 17, 20, "Made.N{0}.Tool{0}"), (6, "method", "Made.N{0}.Tool{0}.Run", "(int n)", 21, 24, "Made.N{0}.Tool{0}"), (6, "method", "Made.N{0}.Tool{0}.Build", "(int n)", 25, 25, "Made.N{0}.Tool{0}"),
]
_value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"
MANY = f"""many AS (SELECT doc_id, doc_id % 8 AS which, 'many/f' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || ['.ts', '.js', '.java', '.go', '.rs', '.cpp', '.cs', '.txt'][doc_id % 8 + 1] AS path,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) END AS above FROM documents),
declared(which, kind, name, signature, first, last, owner) AS (VALUES {", ".join("(" + ", ".join(map(_value, d)) + ")" for d in DECLARED)})"""
_filled = lambda c: f"replace({c}, '{{0}}', CAST(doc_id AS VARCHAR))"
SQL["outline_languages"] = f"""WITH {MANY} SELECT path, ['ts_js_lexical', 'ts_js_lexical', 'java_lexical', 'go_lexical', 'rust_lexical', 'cpp_lexical', 'csharp_lexical'][which + 1] AS language, kind, {_filled("name")} AS name, signature,
  CAST(first + above AS BIGINT) AS start_line, CAST(last + above AS BIGINT) AS end_line, nullif({_filled("owner")}, '') AS parent_symbol, CASE WHEN kind IN ('method', 'async_method', 'constructor') THEN 'class' ELSE 'module' END AS scope_kind
FROM many JOIN declared USING (which)"""
SQL["references_languages"] = f"""WITH {MANY}, used(which, symbol, kind, confidence, line, only_id) AS (VALUES (0, 'draw', 'import', 'high', 1, -1), (0, 'draw', 'call', 'medium', 10, -1), (2, 'call', 'call', 'medium', 14, -1), (0, 'Service8', 'instantiation', 'high', 14, 8))
SELECT symbol, kind, 'lexical' AS strategy, confidence, count(*) AS n, count(DISTINCT path) AS paths, CAST(sum(line + above) AS BIGINT) AS lines FROM many JOIN used USING (which) WHERE only_id IN (-1, doc_id) GROUP BY ALL"""
