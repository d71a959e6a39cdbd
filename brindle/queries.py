"""Registered queries of the retrieval operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import views as V
from .functions import chunking, text as T
from .operators import history, kb, postings, present, transcript, tree, vector
from .sources import transcripts, tsv
from .storage import drop_shuffles, shared_folder

QUERIES, SQL = {}, {}
KB_QUERY, PHRASE_QUERY, ARCHIVE_QUERY, TRANSCRIPT_QUERY = "thatin ononst inoran", "of the", "src5 archive", "thtion thing user ering"

TURNS = """
turns AS (
    SELECT conv_id, 'conv-' || lpad(conv_id::VARCHAR, 6, '0') AS doc_id, 'sessions/conv-' || lpad(conv_id::VARCHAR, 6, '0') || '.jsonl' AS source_path,
           role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, conv_id % 7 = 3 AS has_tool_use,
           CASE WHEN role = 'assistant' AND conv_id % 7 = 3 THEN 2 ELSE 0 END AS tool_call_count
    FROM conversations WHERE role <> 'system'
)"""
TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
CUT = lambda x, n: f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"
TITLE = lambda x: f"CASE WHEN {x} = '' THEN '<empty turn>' ELSE {CUT(TRIM(f'string_split({x}, chr(10))[1]'), 80)} END"
RENDER = f"""CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || CASE WHEN {TRIM('text')} = '' AND tool_call_count > 0 THEN '<' || tool_call_count || ' tool call(s)>' ELSE text END"""
NODES = TURNS + f""",
grouped AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY doc_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING) AS g FROM turns),
raw AS (
    SELECT doc_id, g, min(turn_index) AS start_turn, max(turn_index) AS end_turn, arg_min(text, turn_index) AS first_text,
           count(*) FILTER (role = 'user' AND {TRIM('text')} <> '') AS u, count(*) FILTER (role <> 'user' AND {TRIM('text')} <> '') AS a,
           sum(CASE WHEN role <> 'user' THEN tool_call_count ELSE 0 END)::BIGINT AS t, string_agg({RENDER}, chr(10) || chr(10) ORDER BY turn_index) AS text
    FROM grouped GROUP BY doc_id, g
),
nodes AS (
    SELECT doc_id, lpad((row_number() OVER (PARTITION BY doc_id ORDER BY g))::VARCHAR, 6, '0') AS node_id, {TITLE('first_text')} AS title,
           u || ' user text turn(s), ' || a || ' assistant text turn(s)' || CASE WHEN t > 0 THEN ', ' || t || ' tool call(s)' ELSE '' END AS summary,
           'turns:' || start_turn || '-' || end_turn AS source_locator, start_turn, end_turn, text
    FROM raw
),
docs AS (
    SELECT doc_id, doc_id AS doc_name, {TITLE('arg_min(text, turn_index)')} AS doc_description, 'transcript' AS source_family, min(source_path) AS source_path,
           count(*) AS turn_count, string_agg({RENDER}, chr(10) || chr(10) ORDER BY turn_index) AS text
    FROM turns GROUP BY doc_id
)"""
MESSAGES = TURNS + """,
messages AS (
    SELECT CASE role WHEN 'user' THEN 'prompt' ELSE 'answer' END AS type, CASE WHEN conv_id % 5 = 0 THEN 'archive' ELSE 'session' END AS source, source_path AS path,
           doc_id AS session_id, turn_index AS line_no, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text AS text
    FROM turns WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
),
streams AS (SELECT type, source, path, session_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM messages GROUP BY ALL)"""


def chunk_sql(source: str, keys: str) -> str:
    """Recursive CTE over (keys, t): windows of 1600 with an overlap of 320."""
    return f""",
cut AS (
    SELECT {keys}, t, length(t) AS n, 0 AS s, 0 AS e, 0 AS stop, -1 AS k FROM {source} WHERE t <> ''
    UNION ALL
    SELECT {keys}, t, n, CASE WHEN stop - s0 - 320 > 0 THEN s0 + stop - s0 - 320 ELSE e END, e, stop, k + 1
    FROM (
        SELECT *, CASE WHEN n > 1600 AND e < n AND p > 320 THEN s0 + p + 1 ELSE e END AS stop
        FROM (SELECT {keys}, t, n, s AS s0, least(s + 1600, n) AS e, k,
                     CASE WHEN contains(substr(t, s + 1, 1600), chr(10)) THEN length(substr(t, s + 1, 1600)) - strpos(reverse(substr(t, s + 1, 1600)), chr(10)) ELSE -1 END AS p
              FROM cut WHERE s < n AND (n > 1600 OR k < 0))
    )
),
windows AS (
    SELECT {keys}, t, n, k, stop, lag(s) OVER (PARTITION BY {keys} ORDER BY k) AS s0 FROM cut
),
pieces AS (SELECT {keys}, k, {TRIM("substr(t, s0 + 1, stop - s0)")} AS text FROM windows WHERE k >= 0),
chunks AS (
    SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1 AS chunk_idx, text, left(sha256(text), 16) AS hash FROM pieces WHERE text <> ''
)"""


HISTORY = "WITH RECURSIVE " + MESSAGES + f", trimmed AS (SELECT type, source, path, session_id, {TRIM('text')} AS t FROM streams)" + chunk_sql("trimmed", "type, source, path, session_id") + """,
identified AS (
    SELECT *, type || ':' || source || ':' || hash AS history_hash,
           regexp_replace(left(sha256(type || ':' || source || ':' || hash), 32), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS point_id
    FROM chunks
),
firsts AS (
    SELECT * FROM identified
    QUALIFY row_number() OVER (PARTITION BY history_hash ORDER BY type DESC, string_split(path, '/'), chunk_idx) = 1
),
store AS (
    SELECT f.*, embedding FROM (SELECT *, ('0x' || left(point_id, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM firsts) f JOIN embeddings USING (vec_id)
),
q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id = 0),
scored AS (
    SELECT * EXCLUDE (v, qv), CASE WHEN nn = 0 THEN 0 ELSE dot / nn END AS score FROM (
        SELECT *, list_reduce(list_transform(list_zip(v, qv), lambda z: z[1] * z[2]), lambda a, b: a + b, 0.0::DOUBLE) AS dot,
               sqrt(list_reduce(list_transform(v, lambda z: z * z), lambda a, b: a + b, 0.0::DOUBLE)) * sqrt(list_reduce(list_transform(qv, lambda z: z * z), lambda a, b: a + b, 0.0::DOUBLE)) AS nn
        FROM (SELECT * EXCLUDE embedding, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM store), q)
)"""
MD = """
WITH RECURSIVE split AS (
    SELECT doc_id, CASE WHEN regexp_extract(source, '(\\d+)$', 1)::INT % 5 = 0 THEN 'archive/' ELSE '' END || source || '/' || lang || '/doc-' || doc_id || '.md' AS path,
           string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), numbered AS (
    SELECT doc_id, path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM (
        SELECT doc_id, path, CASE WHEN parts[-1] = '' THEN parts[1 : len(parts) - 1] ELSE parts END AS parts FROM split)
), lines AS (
    SELECT path, line_no::INT AS line_no, CASE WHEN line_no % 7 = 2 THEN repeat('#', (1 + (doc_id + line_no) % 3)::INT) || ' ' || left(line, 40)
           WHEN line_no % 11 = 5 THEN '```' ELSE regexp_replace(line, '\\r$', '') END AS line FROM numbered
)"""
SECTIONS = MD + """, flagged AS (
    SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM lines
), shown AS (
    SELECT *, sum(fence::INT) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside,
           length(regexp_extract(line, '^\\s*(#{1,6})([^#].*)?$', 1)) AS lv,
           trim(regexp_replace(trim(regexp_extract(line, '^\\s*(#{1,6})([^#].*)?$', 2)), '^#+|#+$', '', 'g')) AS title FROM flagged
), marked AS (
    SELECT path, line_no, line, title, CASE WHEN NOT fence AND NOT inside AND lv > 0 AND title <> '' THEN lv ELSE 0 END AS level FROM shown
), keyed AS (
    SELECT *, sum((level > 0)::INT) OVER w AS k, sum((regexp_replace(line, '\\s+', '', 'g') <> '')::INT) OVER w AS filled, max(line_no) OVER (PARTITION BY path) AS line_count
    FROM marked WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), raw AS (
    SELECT path, k, min(line_no) AS line_start, max(line_count) AS line_count, arg_min(level, line_no) AS level, arg_min(title, line_no) AS title,
           arg_min(line, line_no) AS first_line, string_agg(line, chr(10) ORDER BY line_no) AS body,
           coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no > first_no), '') AS rest
    FROM (SELECT *, min(line_no) OVER (PARTITION BY path, k) AS first_no FROM keyed WHERE NOT (k = 0 AND filled = 0)) GROUP BY path, k
), stack AS (
    SELECT path, k, [title] AS s FROM raw WHERE k = 1
    UNION ALL
    SELECT r.path, r.k, list_append(s[1 : r.level - 1], r.title) FROM stack JOIN raw r ON r.path = stack.path AND r.k = stack.k + 1
), sections AS (
    SELECT path, line_start, coalesce(lead(line_start) OVER (PARTITION BY path ORDER BY line_start) - 1, line_count) AS line_end,
           coalesce(array_to_string(s, ' > '), regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')) AS heading_path,
           regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS text,
           trim(regexp_replace(CASE WHEN k > 0 THEN rest ELSE body END, '\\s+', ' ', 'g')) AS normalized_body
    FROM raw LEFT JOIN stack USING (path, k)
), nodes AS (SELECT path, line_start, line_end, heading_path, normalized_body FROM sections),
tok AS (
    SELECT *, regexp_extract_all(lower(heading_path), '[\\p{L}\\p{N}]+') AS h, regexp_extract_all(lower(path), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(normalized_body), '[\\p{L}\\p{N}]+') AS b FROM nodes
)"""


def scored_sql(query: str) -> str:
    phrase = T.python_tokens(query)
    terms = list(dict.fromkeys(phrase))
    count = lambda x, t: f"least(len(list_filter({x}, lambda w: w = '{t}')), 3)"
    matched = " + ".join(f"(list_contains(h, '{t}') OR list_contains(a, '{t}') OR list_contains(b, '{t}'))::BIGINT" for t in terms)
    structure = " + ".join(f"600 * {count('h', t)} + 400 * {count('a', t)}" for t in terms)
    body = " + ".join(f"100 * {count('b', t)}" for t in terms)
    return SECTIONS + f""", scored AS (
    SELECT *, (matched * {T.stride(len(terms))} + 100 * structure + (100 * body) // greatest(1, floor(sqrt(greatest(1, len(b))))::BIGINT)
               + CASE WHEN contains(' ' || array_to_string(b, ' ') || ' ', ' {" ".join(phrase)} ') THEN 1000 ELSE 0 END)::BIGINT AS score
    FROM (SELECT *, {matched} AS matched, {structure} AS structure, {body} AS body FROM tok) WHERE matched > 0
), tier AS (SELECT *, contains(lower(path), 'archive') AS arch FROM scored WHERE matched = (SELECT max(matched) FROM scored)),
kept AS (SELECT *, line_start || '-' || line_end AS node_id FROM tier WHERE NOT arch OR (SELECT bool_and(arch) FROM tier)),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, heading_path, node_id) = 1),
results AS (
    SELECT path AS doc_id, path, heading_path AS heading, normalized_body AS text, score, node_id, string_split(heading_path, ' > ')[-1] AS title,
           'matched deterministic text index; score ' || score AS reason
    FROM best ORDER BY score DESC, path, heading, node_id LIMIT 5
)"""


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@register("turns_normalized", f"WITH {TURNS} SELECT doc_id, turn_index, role, text, has_tool_use, tool_call_count FROM turns")
def turns_normalized(spark: SparkSession, d: str) -> DataFrame:
    return V.turns(spark, d).select("doc_id", F.col("turn_index").cast("long"), "role", "text", "has_tool_use", "tool_call_count")


@register("history_messages", f"WITH {MESSAGES} SELECT * FROM messages")
def history_messages(spark, d):
    return V.messages(spark, d).drop("seq").withColumn("line_no", F.col("line_no").cast("long"))


@register("history_streams", f"WITH {MESSAGES} SELECT * FROM streams")
def history_streams(spark, d):
    return V.stream_rows(spark, d)


TYPED = f"""WITH {TURNS} SELECT source_path AS path, turn_index + 1 AS line_no, {{}} || text AS text FROM turns
WHERE turn_index % 11 <> 7 AND role = '{{}}' AND {TRIM('text')} <> ''"""


@register("typed_jsonl_prompts", TYPED.format("'User: '", "user") + " AND conv_id % 5 <> 1")
def typed_jsonl_prompts(spark, d):
    return transcripts.typed_prompts(V.jsonl(spark, d, "typed"), "path").select("path", F.col("line_no").cast("long"), "text")


@register("typed_jsonl_answers", TYPED.format("'Assistant: '", "assistant") + " AND turn_index % 4 <> 0")
def typed_jsonl_answers(spark, d):
    return transcripts.typed_answers(V.jsonl(spark, d, "typed"), "path").select("path", F.col("line_no").cast("long"), "text")


@register("typed_jsonl_turns", f"""WITH {TURNS} SELECT path, line_no, role, text, n > 0 AS has_tool_use, n AS tool_call_count, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS turn_index FROM (
    SELECT source_path AS path, turn_index + 1 AS line_no, role, CASE WHEN turn_index % 4 = 0 THEN text ELSE {TRIM('text')} END AS text, CASE WHEN turn_index % 4 <> 0 AND has_tool_use THEN 1 ELSE 0 END AS n
    FROM turns WHERE turn_index % 11 <> 7) WHERE text <> '' OR n > 0""")
def typed_jsonl_turns(spark, d):
    out = transcripts.typed_turns(V.jsonl(spark, d, "typed"), "path")
    return out.select("path", F.col("line_no").cast("long"), "role", "text", "has_tool_use", "tool_call_count", F.col("turn_index").cast("long"))


ENVELOPED = f"""WITH {TURNS} SELECT source_path AS path, turn_index + 1 AS line_no, {{}} || {TRIM('text')} AS text FROM turns WHERE turn_index % 11 <> 7 AND role = '{{}}' AND {TRIM('text')} <> ''"""


@register("enveloped_jsonl_prompts", ENVELOPED.format("'User: '", "user") + " AND NOT (conv_id % 6 = 2 AND turn_index = 0)")
def enveloped_jsonl_prompts(spark, d):
    return transcripts.enveloped_messages(V.jsonl(spark, d, "enveloped"), "user", "path").select("path", F.col("line_no").cast("long"), "text")


@register("enveloped_jsonl_answers", ENVELOPED.format("'Assistant: '", "assistant"))
def enveloped_jsonl_answers(spark, d):
    return transcripts.enveloped_messages(V.jsonl(spark, d, "enveloped"), "assistant", "path").select("path", F.col("line_no").cast("long"), "text")


@register("format_sniff", f"WITH {TURNS} SELECT source_path AS path, 'typed' AS format FROM turns WHERE turn_index % 11 <> 7 GROUP BY ALL UNION ALL SELECT 'e/' || source_path, 'enveloped' FROM turns WHERE turn_index % 11 <> 7 GROUP BY ALL")
def format_sniff(spark, d):
    both = V.jsonl(spark, d, "typed").unionByName(V.jsonl(spark, d, "enveloped").withColumn("path", F.concat(F.lit("e/"), "path")))
    return transcripts.sniff(both, "path")


@register("chunk_documents", f"WITH RECURSIVE trimmed AS (SELECT doc_id, {TRIM('text')} AS t FROM documents WHERE text IS NOT NULL)" + chunk_sql("trimmed", "doc_id") + " SELECT doc_id, chunk_idx, text AS chunk, hash FROM chunks")
def chunk_documents(spark, d):
    return chunking.chunks(V.table(spark, d, "documents").select("doc_id", "text")).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@register("history_identity", HISTORY + " SELECT type, source, path, session_id, chunk_idx, text, hash, history_hash, point_id FROM identified")
def history_identity(spark, d):
    return V.chunk_rows(spark, d).select("type", "source", "path", "session_id", F.col("chunk_idx").cast("long"), "text", "hash", "history_hash", "point_id")


@register("dedup_within", HISTORY + " SELECT path, chunk_idx, history_hash FROM firsts")
def dedup_within(spark, d):
    return history.first_of_each(V.chunk_rows(spark, d)).select("path", F.col("chunk_idx").cast("long"), "history_hash")


@register("dedup_incremental", HISTORY + """, old AS (SELECT DISTINCT history_hash FROM identified WHERE substr(session_id, 6)::INT % 2 = 0)
SELECT path, chunk_idx, history_hash FROM firsts ANTI JOIN old USING (history_hash)""")
def dedup_incremental(spark, d):
    rows = V.chunk_rows(spark, d)
    old = rows.where(F.substring("session_id", 6, 6).cast("int") % 2 == 0).select("history_hash").distinct()
    return history.unseen(rows, old).select("path", F.col("chunk_idx").cast("long"), "history_hash")


@register("collection_stats", HISTORY + " SELECT type, source, count(*) AS points, count(DISTINCT session_id) AS sessions FROM firsts GROUP BY ALL")
def collection_stats(spark, d):
    return history.first_of_each(V.chunk_rows(spark, d)).groupBy("type", "source").agg(F.count("*").alias("points"), F.countDistinct("session_id").alias("sessions"))


FOUND = " SELECT point_id, type, source, path, session_id, text, round(score, 6) AS score FROM scored {} ORDER BY scored.score DESC, point_id LIMIT {}"


def found(spark, d, limit=10, **filters):
    return vector.search(V.store(spark, d), V.query_vector(spark, d), limit, **filters).select("point_id", "type", "source", "path", "session_id", "text", F.round("score", 6).alias("score"))


register("vector_search_all", HISTORY + FOUND.format("", 10))(lambda s, d: found(s, d))
register("vector_search_prompts", HISTORY + FOUND.format("WHERE type = 'prompt'", 10))(lambda s, d: found(s, d, kind="prompt"))
register("vector_search_answers", HISTORY + FOUND.format("WHERE type = 'answer'", 10))(lambda s, d: found(s, d, kind="answer"))
register("vector_search_sources", HISTORY + FOUND.format("WHERE source IN ('archive')", 10))(lambda s, d: found(s, d, sources=["archive"]))
register("vector_search_session", HISTORY + FOUND.format("WHERE contains(session_id, '00001')", 10))(lambda s, d: found(s, d, session="00001"))


@register("session_substring_ids", HISTORY + " SELECT DISTINCT session_id FROM store WHERE contains(session_id, '00001')")
def session_substring_ids(spark, d):
    return vector.session_ids(V.store(spark, d), "00001")


@register("paired_search", HISTORY + " SELECT type, rank, point_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, point_id)::INT AS rank FROM scored) WHERE rank <= 5")
def paired_search(spark, d):
    return vector.paired(V.store(spark, d), V.query_vector(spark, d), 5).select("type", "rank", "point_id", F.round("score", 6).alias("score"))


@register("search_ndjson", HISTORY + " SELECT type, text, source, path, session_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, point_id LIMIT 5")
def search_ndjson(spark, d):
    lines = present.ndjson(found(spark, d, 5))
    return lines.select(F.from_json("line", "type string, text string, source string, path string, session_id string, score double").alias("r")).select("r.*")


register("md_lines", MD + " SELECT * FROM lines")(lambda s, d: V.md_lines(s, d))
register("md_headings", SECTIONS + " SELECT path, line_no, level FROM marked WHERE level > 0")(lambda s, d: kb.marked(V.md_lines(s, d)).where("level > 0").select("path", "line_no", F.col("level").cast("long").alias("level")))
register("md_sections", SECTIONS + " SELECT path, line_start, line_end, heading_path, text FROM sections")(lambda s, d: kb.sections(V.md_lines(s, d)))
register("kb_nodes", SECTIONS + " SELECT * FROM nodes")(lambda s, d: V.kb_nodes(s, d))
register("kb_tokens", SECTIONS + " SELECT path, line_start, h AS h_tok, a AS a_tok, b AS b_tok FROM tok")(lambda s, d: kb.tokenized(V.kb_nodes(s, d)).select("path", "line_start", "h_tok", "a_tok", "b_tok"))
register("kb_scores", scored_sql(KB_QUERY) + " SELECT path, line_start, matched, score FROM scored")(lambda s, d: kb.scored(V.kb_nodes(s, d), KB_QUERY).select("path", "line_start", "matched", "score"))
for _name, _query in (("kb_search", KB_QUERY), ("kb_search_phrase", PHRASE_QUERY), ("kb_search_archive", ARCHIVE_QUERY)):
    register(_name, scored_sql(_query) + " SELECT * FROM results")(lambda s, d, q=_query: kb.search(V.kb_nodes(s, d), q))


def stored_notes(spark, d):
    """The nodes and their postings as tables of the shared folder."""
    at = shared_folder(spark, "notes")
    postings.numbered(V.kb_nodes(spark, d)).write.parquet(f"{at}/nodes")
    drop_shuffles(spark)
    postings.write(postings.of_notes(spark.read.parquet(f"{at}/nodes")), f"{at}/terms")
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/terms")


for _name, _query in (("kb_search_stored", KB_QUERY), ("kb_search_stored_phrase", PHRASE_QUERY), ("kb_search_stored_archive", ARCHIVE_QUERY)):
    register(_name, scored_sql(_query) + " SELECT * FROM results")(lambda s, d, q=_query: postings.search_notes(*stored_notes(s, d), q))


@register("kb_context_fetch", scored_sql(KB_QUERY) + """ SELECT r.path, node_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM results r JOIN lines l
ON l.path = r.path AND line_no BETWEEN string_split(node_id, '-')[1]::INT AND string_split(node_id, '-')[2]::INT GROUP BY ALL""")
def kb_context_fetch(spark, d):
    lines = V.md_lines(spark, d)
    return kb.with_source_text(kb.search(kb.nodes(lines), KB_QUERY), lines).select("path", "node_id", "text")


@register("kb_manifest_staleness", """WITH base AS (SELECT doc_id, source || '/doc-' || doc_id || '.md' AS path FROM documents)
SELECT path, CASE doc_id % 10 WHEN 3 THEN 'added' WHEN 4 THEN 'removed' ELSE 'changed' END AS status FROM base WHERE doc_id % 10 IN (3, 4, 5, 6)""")
def kb_manifest_staleness(spark, d):
    return kb.changed(*V.manifests(spark, d))


@register("tsv_roundtrip", SECTIONS + " SELECT path, line_start, line_end, heading_path, text FROM sections")
def tsv_roundtrip(spark, d):
    rows = kb.sections(V.md_lines(spark, d))
    fields = tuple((c, "string" if t == "string" else "long") for c, t in rows.dtypes)
    back = tsv.parse(tsv.render(rows, fields).withColumn("row", F.lit(0)), fields)
    return back.select(*[F.col(c).cast(t) for c, t in rows.dtypes])


register("exchange_nodes", f"WITH {NODES} SELECT * FROM nodes")(lambda s, d: longs(transcript.nodes(V.turns(s, d))))
register("node_summaries", f"WITH {NODES} SELECT doc_id, node_id, title, summary FROM nodes")(lambda s, d: transcript.nodes(V.turns(s, d)).select("doc_id", "node_id", "title", "summary"))
register("transcript_docs", f"WITH {NODES} SELECT * FROM docs")(lambda s, d: transcript.documents(V.turns(s, d)))
register("doc_metadata", f"WITH {NODES} SELECT * EXCLUDE text FROM docs")(lambda s, d: transcript.metadata(transcript.documents(V.turns(s, d))))
register("doc_structure", f"WITH {NODES} SELECT doc_id, node_id, title, summary, source_locator, start_turn, end_turn FROM nodes")(lambda s, d: longs(transcript.structure(transcript.nodes(V.turns(s, d))).select("doc_id", F.inline("nodes"))))
register("doc_outline", f"WITH {NODES} SELECT doc_id, doc_id || ' — ' || doc_name || chr(10) || string_agg(node_id || '. ' || title || ' [' || start_turn || '-' || end_turn || '] — ' || summary, chr(10) ORDER BY node_id) AS outline FROM docs JOIN nodes USING (doc_id) GROUP BY doc_id, doc_name")(
    lambda s, d: transcript.outline(transcript.documents(V.turns(s, d)), transcript.nodes(V.turns(s, d)))
)
register("content_by_node", f"WITH {NODES} SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END AS content FROM nodes WHERE node_id = '000002'")(lambda s, d: transcript.content_of_node(transcript.nodes(V.turns(s, d)), "000002"))
register("content_by_range", f"WITH {NODES}, parts AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM docs) SELECT doc_id, array_to_string(p[2:4], chr(10) || chr(10)) || chr(10) AS content FROM parts WHERE len(p) > 1")(
    lambda s, d: transcript.content_of_turns(transcript.documents(V.turns(s, d)), 1, 3)
)


def longs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("start_turn", "end_turn")})


TREES = "WITH " + TURNS + """, grouped AS (
    SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY doc_id ORDER BY turn_index))::BIGINT AS g FROM turns
), every AS (
    SELECT doc_id, [p, g, turn_index] AS k, 't' || turn_index AS node_id, 'e' || g AS parent_id, 3 AS depth, turn_index AS start_turn, turn_index AS end_turn, text FROM (SELECT *, g // 4 AS p FROM grouped)
    UNION ALL
    SELECT doc_id, [g // 4, g], 'e' || g, 'p' || (g // 4), 2, min(turn_index), max(turn_index), '' FROM grouped GROUP BY doc_id, g
    UNION ALL
    SELECT doc_id, [g // 4], 'p' || (g // 4), NULL, 1, min(turn_index), max(turn_index), '' FROM grouped GROUP BY doc_id, g // 4
), tree AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position FROM every)"""


@register("tree_nodes", TREES + " SELECT doc_id, position, node_id, parent_id, depth::BIGINT AS depth, start_turn, end_turn, text FROM tree")
def tree_nodes(spark, d):
    return tree.flatten(V.trees(spark, d)).select("doc_id", F.col("position").cast("long"), "node_id", "parent_id", F.col("depth").cast("long"), "start_turn", "end_turn", "text")


@register("tree_counts", TREES + " SELECT doc_id, count(*) AS nodes, max(depth)::BIGINT AS depth FROM tree GROUP BY doc_id")
def tree_counts(spark, d):
    return tree.count(tree.flatten(V.trees(spark, d))).withColumn("depth", F.col("depth").cast("long"))


@register("tree_below", TREES + " SELECT a.doc_id, a.node_id, a.position FROM tree a JOIN tree b ON a.doc_id = b.doc_id AND b.node_id = 'p0' AND a.k[1] = b.k[1]")
def tree_below(spark, d):
    return tree.below(tree.flatten(V.trees(spark, d)), "p0").select("doc_id", "node_id", F.col("position").cast("long"))


@register("tree_structure", TREES + " SELECT doc_id, 'p' || k[1] AS part, 'e' || k[2] AS exchange, node_id AS turn FROM tree WHERE depth = 3")
def tree_structure(spark, d):
    shown = tree.structure(tree.flatten(V.trees(spark, d)))
    for level in ("part", "exchange", "turn"):
        rest = [c for c in shown.columns if c != "nodes"]
        shown = shown.select(*rest, F.explode(F.from_json("nodes", "array<struct<node_id:string,nodes:string>>")).alias("n")).select(*rest, F.col("n.node_id").alias(level), F.col("n.nodes").alias("nodes"))
    return shown.drop("nodes")


_terms = T.query_terms(TRANSCRIPT_QUERY)


@register("transcript_query", f"""WITH {NODES}, hit AS (
    SELECT nodes.*, source_path, list_filter({_terms}, lambda t: contains(lower(doc_id || chr(10) || title || chr(10) || summary || chr(10) || nodes.text), t)) AS hits FROM nodes JOIN (SELECT doc_id, source_path FROM docs) USING (doc_id)
) SELECT doc_id, source_path, node_id, title, len(hits) * 10 AS score, 'matched query terms: ' || array_to_string(hits, ', ') AS reason, 'brindle transcript content ' || doc_id || ' ' || node_id AS next_content_command
FROM hit WHERE len(hits) > 0 ORDER BY score DESC, doc_id, node_id LIMIT 20""")
def transcript_query(spark, d):
    turns = V.turns(spark, d)
    return transcript.query(transcript.documents(turns), transcript.nodes(turns), TRANSCRIPT_QUERY, 20)


@register("transcript_query_stored", SQL["transcript_query"])
def transcript_query_stored(spark, d):
    turns, at = V.turns(spark, d), shared_folder(spark, "transcripts")
    transcript.nodes(turns).write.parquet(f"{at}/nodes")
    nodes = spark.read.parquet(f"{at}/nodes")
    postings.write(postings.of_transcripts(nodes), f"{at}/grams")
    return postings.search_transcripts(transcript.documents(turns), nodes, spark.read.parquet(f"{at}/grams"), TRANSCRIPT_QUERY, 20)


@register("enrich_session_section", HISTORY + f""", top AS (
    SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, point_id) AS rank FROM scored QUALIFY rank <= 3
), line AS (
    SELECT type, rank, chr(10) || '- (' || printf('%.2f', score) || ') source: claude source_type: ' || source || ' session_id: ' || session_id || chr(10) || '  path: ' || path || chr(10) || '  text: ' || {CUT("replace(text, chr(10), ' ')", 300)} AS s FROM top
) SELECT '{present.SESSION_TITLE}' || coalesce(chr(10) || '### prompts' || string_agg(s, '' ORDER BY rank) FILTER (type = 'prompt'), '') || coalesce(chr(10) || '### answers' || string_agg(s, '' ORDER BY rank) FILTER (type = 'answer'), '') AS section FROM line""")
def enrich_session_section(spark, d):
    return present.session_section(vector.paired(V.store(spark, d), V.query_vector(spark, d), present.MOST))


@register("enrich_kb_section", scored_sql(KB_QUERY) + f""", line AS (
    SELECT *, chr(10) || '- (' || score || ') ' || path || ' > ' || heading || ' [' || node_id || ']: ' || {CUT("replace(text, chr(10), ' ')", 500)} AS s FROM (SELECT * FROM results ORDER BY score DESC, path LIMIT 3)
) SELECT '{present.KB_TITLE}' || string_agg(s, '' ORDER BY score DESC, path, heading, node_id) AS section FROM line""")
def enrich_kb_section(spark, d):
    return present.kb_section(kb.search(V.kb_nodes(spark, d), KB_QUERY, present.MOST))


@register("embed_documents")
def embed_documents(spark, d):
    """Rows only: the hashing embedder has no SQL."""
    from .embed import HashingEmbedder, embedded

    return embedded(V.table(spark, d, "documents").select("doc_id", "text"), lambda: HashingEmbedder(64)).drop("text")
