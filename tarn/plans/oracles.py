"""DuckDB SQL of the registered queries, over the same Parquet tables."""

from __future__ import annotations

from tarn.functions.tokenize import STOP_WORDS
from tarn.plans.registered import QUERY, SYMBOL_QUERY

_CLASS = r"""[\s.,;:!?(){}\[\]<>''"/\\|@#$%^&*+=`~-]+"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _parts(token: str) -> str:
    inner = f"regexp_replace({token}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    inner = f"regexp_replace({inner}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    inner = f"regexp_replace({inner}, '([0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"string_split({inner}, ' ')"


_EMIT = """list_transform(s, lambda x: lower(x))
  || list_transform(range(1, len(s)), lambda i: lower(s[i] || s[i + 1]))
  || CASE WHEN lower(token) <> lower(s[1]) THEN [lower(token)] ELSE [] END"""


def _terms(source: str, key: str, text: str, name: str = "p") -> str:
    """CTEs up to {name}: (chunk_id, term, frequency); source may be a table or a subquery."""
    return f"""{name}_tok AS (
  SELECT {key} AS chunk_id, unnest(regexp_split_to_array({text}, '{_CLASS}')) AS token FROM {source}
), {name}_sub AS (
  SELECT chunk_id, token, {_parts("token")} AS s FROM {name}_tok WHERE token <> ''
), {name}_all AS (SELECT chunk_id, unnest({_EMIT}) AS term FROM {name}_sub
), {name} AS (
  SELECT chunk_id, term, count(*) AS frequency FROM {name}_all
  WHERE length(term) BETWEEN 2 AND 50 AND term NOT IN ({_STOP}) AND NOT regexp_full_match(term, '[0-9]+')
  GROUP BY chunk_id, term
)"""


_P = _terms("documents", "doc_id", "text")
_DL = "dl AS (SELECT chunk_id, sum(frequency) AS doc_len FROM p GROUP BY chunk_id)"
_ST = "st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM dl)"
_DF = "df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"


def _one(query: str) -> str:
    return f"(SELECT 0 AS query_id, '{query}' AS text)"


def _bm25(queries: str, limit: int, out: str = "bm", where: str = "true") -> str:
    """CTEs up to {out}: (query_id, chunk_id, score, rank) over p, dl, st, df."""
    return f"""{_terms(queries, "query_id", "text", "q")}, {out}_s AS (
  SELECT q.chunk_id AS query_id, p.chunk_id,
    sum({_IDF} * p.frequency * 2.5 / (p.frequency + 1.5 * (0.25 + 0.75 * dl.doc_len / st.avgdl))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl ON dl.chunk_id = p.chunk_id CROSS JOIN st
  WHERE {where} GROUP BY ALL
), {out}_r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {out}_s
), {out} AS (
  SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS score, rank
  FROM {out}_r WHERE rank <= {limit}
)"""


_CH = """ch AS (SELECT doc_id AS chunk_id, source AS document_id, text AS content, lang AS language,
  regexp_extract(text, '([A-Za-z0-9_]+)', 1) AS name,
  ['function', 'method', 'class', 'interface', 'type'][CAST(doc_id % 5 AS INTEGER) + 1] AS chunk_type FROM documents)"""
_RANKED = "SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"
_VECTOR_QUERY = "(SELECT CAST(0 AS BIGINT) AS query_id, embedding AS v FROM embeddings WHERE vec_id = 0)"


def _vec(queries: str, limit: int, out: str = "ve") -> str:
    return f"""{out}_s AS (
  SELECT query_id, vec_id AS chunk_id, coalesce(list_cosine_similarity(
    list_transform(v, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0.0) AS score
  FROM embeddings CROSS JOIN {queries} qv
), {out}_r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {out}_s
), {out} AS (SELECT * FROM {out}_r WHERE rank <= {limit})"""


_SHARE = "coalesce(0.5 / (60 + b.rank), 0.0) + coalesce(0.5 / (60 + v.rank), 0.0)"
_FUSED = f"""fu_s AS (
  SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.chunk_id, v.chunk_id) AS chunk_id, {_SHARE} AS score,
    b.rank AS lexical_rank, v.rank AS vector_rank
  FROM bm b FULL JOIN ve v ON b.query_id = v.query_id AND b.chunk_id = v.chunk_id
), fu AS (SELECT * REPLACE (score / max(score) OVER (PARTITION BY query_id) AS score) FROM fu_s)"""
_BOTH = f"{_P}, {_DL}, {_ST}, {_DF}, {_bm25(_one(QUERY), 20)}, {_vec(_VECTOR_QUERY, 20)}, {_FUSED}"

_G = """g AS (
  SELECT 'r' || r_regionkey AS chunk_id, CAST(r_regionkey AS VARCHAR) AS document_id, r_name AS name, 'interface' AS chunk_type,
    NULL AS parent, [] AS extends FROM region
  UNION ALL SELECT 'n' || n_nationkey, CAST(n_regionkey AS VARCHAR), n_name, 'class', NULL, [r_name, 'MISSING']
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 's' || s_suppkey, CAST(n_regionkey AS VARCHAR), n_name || '.' || s_name, 'method', n_name, []
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'c' || c_custkey, CAST(n_regionkey AS VARCHAR), n_name || '.' || c_name, 'method', n_name, []
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_GE = """ge_contains AS (
  SELECT c.chunk_id AS from_chunk_id, m.chunk_id AS to_chunk_id, m.name AS to_name, 'contains' AS edge_type, 1.0::DOUBLE AS weight, true AS resolved
  FROM g m JOIN g c ON c.chunk_type = 'class' AND m.chunk_type = 'method' AND c.document_id = m.document_id AND c.name = m.parent
), ge_unique AS (
  SELECT name, min(chunk_id) AS id FROM g WHERE chunk_type IN ('class', 'interface') GROUP BY name HAVING count(*) = 1
), ge_heritage AS (
  SELECT x.chunk_id AS from_chunk_id, u.id AS to_chunk_id, x.to_name, 'extends' AS edge_type, 0.9::DOUBLE AS weight, u.id IS NOT NULL AS resolved
  FROM (SELECT chunk_id, unnest(extends) AS to_name FROM g WHERE chunk_type IN ('class', 'interface')) x
  LEFT JOIN ge_unique u ON u.name = x.to_name
), ge_short AS (
  SELECT regexp_extract(name, '([^.]*)$', 1) AS short, min(chunk_id) AS id FROM g WHERE chunk_type IN ('function', 'method')
  GROUP BY 1 HAVING count(*) = 1 AND length(short) >= 4
), ge_calls AS (
  SELECT m.chunk_id AS from_chunk_id, s.id AS to_chunk_id, s.short AS to_name, 'calls' AS edge_type, 0.6::DOUBLE AS weight, true AS resolved
  FROM g m JOIN ge_short s ON s.short = regexp_extract(m.name, '([^.]*)$', 1) AND m.chunk_id <> s.id WHERE m.chunk_type = 'method'
), ge AS (SELECT * FROM ge_contains UNION ALL SELECT * FROM ge_heritage UNION ALL SELECT * FROM ge_calls)"""
_SEEDS = f"""ns_w AS (
  SELECT min(pos) AS pos, token FROM (SELECT unnest(string_split('{SYMBOL_QUERY}', ' ')) AS token, unnest(range(0, 3)) AS pos)
  WHERE length(token) >= 2 GROUP BY token
), ns_h AS (
  SELECT g.chunk_id, g.name, pos, token, row_number() OVER (PARTITION BY token ORDER BY length(g.name), g.chunk_id) AS near,
    CASE WHEN lower(name) = lower(token) THEN 1.0 WHEN starts_with(lower(name), lower(token)) THEN 0.9 ELSE 0.75 END AS score
  FROM g JOIN ns_w ON lower(name) LIKE '%' || lower(token) || '%'
), ns_f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS f FROM ns_h WHERE near <= 20
), ns AS (
  SELECT * FROM (SELECT CAST(0 AS BIGINT) AS query_id, chunk_id, CAST(score AS DOUBLE) AS score,
    row_number() OVER (ORDER BY score DESC, pos, length(name), chunk_id) AS seed FROM ns_f WHERE f = 1) WHERE seed <= 20
)"""
_ALL_SEEDS = f"""{_terms("g", "chunk_id", "name")}, {_DL}, {_ST}, {_DF}, {_bm25(_one(SYMBOL_QUERY), 20)}, seeds AS (
  SELECT coalesce(n.chunk_id, b.chunk_id) AS chunk_id, coalesce(n.score, b.score * 0.65) AS score,
    coalesce(b.rank, n.seed + 1000000) AS seed
  FROM ns n FULL JOIN bm b ON n.chunk_id = b.chunk_id
), links AS (
  SELECT from_chunk_id AS here, to_chunk_id AS there, weight, 0 AS way, CASE edge_type WHEN 'contains' THEN 1 WHEN 'extends' THEN 2 ELSE 4 END AS kind, from_chunk_id, to_chunk_id, to_name
  FROM ge WHERE resolved
  UNION ALL SELECT to_chunk_id, from_chunk_id, weight, 1, CASE edge_type WHEN 'contains' THEN 1 WHEN 'extends' THEN 2 ELSE 4 END, from_chunk_id, to_chunk_id, to_name FROM ge WHERE resolved
), one AS (
  SELECT there AS chunk_id, s.score * weight * 0.6 AS score,
    row_number() OVER (PARTITION BY there ORDER BY seed, way, kind, from_chunk_id, to_chunk_id, to_name) AS f
  FROM seeds s JOIN links l ON s.chunk_id = l.here
), two AS (
  SELECT there AS chunk_id, o.score * weight * 0.6 AS score FROM one o JOIN links l ON o.chunk_id = l.here
  WHERE f = 1 AND o.chunk_id NOT IN (SELECT chunk_id FROM seeds)
), best AS (
  SELECT chunk_id, max(score) AS score, min(level) AS level FROM (
    SELECT chunk_id, score, 0 AS level FROM seeds UNION ALL SELECT chunk_id, score, 1 FROM one UNION ALL SELECT chunk_id, score, 2 FROM two)
  GROUP BY chunk_id
)"""
_PATH = r"regexp_replace(url, '[?#].*$', '')"
_BASE = f"string_split({_PATH}, '/')[-1]"
_FIRST_DOT = rf"lower(regexp_extract({_BASE}, '(\..*)$', 1))"
_IGNORED = "'.json','.yaml','.yml','.toml','.xml','.csv','.tsv','.md','.mdx','.txt','.rst','.pdf','.png','.jpg','.jpeg','.gif','.svg','.ico','.webp','.woff','.woff2','.ttf','.eot','.otf','.mp4','.mp3','.wav','.avi','.mov','.zip','.tar','.gz','.rar','.7z','.exe','.dll','.so','.dylib','.class','.pyc','.lock','.env','.min.js','.min.css','.d.ts','.map'"
_NAMES = "thing", "on", "eau"
_MATCH = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, '{n}' AS text" for i, n in enumerate(_NAMES))
_SHORT_CALLS = """sc AS (SELECT name AS short, min(chunk_id) AS id FROM ch WHERE chunk_type IN ('function', 'method')
  GROUP BY name HAVING count(*) = 1 AND length(name) >= 4)"""
_STATUS = """
SELECT 'doc/' || doc_id AS source_path, sha256(t) AS checksum, CASE WHEN sha256(t) = sha256(text) THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT doc_id, text, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS t FROM documents)
UNION ALL SELECT 'page/' || page_id, sha256(html), 'new' FROM pages"""

_MAP = """l AS (SELECT document_id, CAST(regexp_replace(chunk_id, '[a-z]', '') AS INTEGER) AS n, chunk_type, parent, name FROM g),
        x AS (SELECT l.document_id, CASE chunk_type WHEN 'interface' THEN 1 ELSE 0 END AS gr,
            CASE chunk_type WHEN 'method' THEN o.n ELSE l.n END AS pos, CAST(chunk_type = 'method' AS INTEGER) AS inn, l.n,
            CASE chunk_type WHEN 'class' THEN '  class ' || name WHEN 'method' THEN '    ' || name || '()' ELSE '  interface ' || name END AS line
          FROM l LEFT JOIN (SELECT document_id, name AS owner, min(n) AS n FROM l WHERE chunk_type = 'class' GROUP BY ALL) o
            ON o.document_id = l.document_id AND o.owner = l.parent)"""
ORACLES = {
    "tokenize_terms": f"WITH {_P} SELECT * FROM p",
    "camel_split": f"""WITH t AS (SELECT unnest(regexp_split_to_array(text, '{_CLASS}')) AS token FROM documents)
        SELECT token, array_to_string({_parts("token")}, ' ') AS parts, count(*) AS n FROM t WHERE token <> '' GROUP BY token""",
    "emitted_terms": f"""WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '{_CLASS}')) AS token FROM documents),
        u AS (SELECT token, {_parts("token")} AS s FROM t WHERE token <> '')
        SELECT token, array_to_string({_EMIT}, ',') AS emitted FROM u""",
    "term_frequencies": f"WITH {_P} SELECT term, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS df FROM p GROUP BY term",
    "doc_lengths": f"WITH {_P}, {_DL} SELECT chunk_id, CAST(doc_len AS BIGINT) AS doc_len FROM dl",
    "corpus_stats": f"WITH {_P}, {_DL}, {_ST} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "document_frequency": f"WITH {_P}, {_DF} SELECT term, df FROM df",
    "idf": f"WITH {_P}, {_DL}, {_ST}, {_DF} SELECT term, round({_IDF}, 6) AS idf FROM df CROSS JOIN st",
    "bm25_search": f"WITH {_P}, {_DL}, {_ST}, {_DF}, {_bm25(_one(QUERY), 10)} {_RANKED} FROM bm",
    "bm25_batch": f"""WITH {_P}, {_DL}, {_ST}, {_DF},
        {_bm25("(SELECT item_id AS query_id, text FROM benchmark)", 10)} {_RANKED} FROM bm""",
    "bm25_conversations": f"""WITH {_terms("conversations", "conv_id * 1000000 + turn", "text")}, {_DL}, {_ST}, {_DF},
        {_bm25(_one(QUERY), 10)} {_RANKED} FROM bm""",
    "filtered_search": f"""WITH {_P}, {_DL}, {_ST}, {_DF},
        {_bm25(_one(QUERY), 10, where="p.chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")} {_RANKED} FROM bm""",
    "hydrate_chunks": f"""WITH {_P}, {_DL}, {_ST}, {_DF}, {_bm25(_one(QUERY), 10)}, {_CH},
        dc AS (SELECT source AS document_id, count(*) AS chunk_count FROM documents GROUP BY source)
        SELECT chunk_id, document_id, name, chunk_type, language, chunk_count, round(score, 6) AS score,
          CAST(rank AS INTEGER) AS rank, 'bm25' AS strategy, sha256(content) AS content_sha
        FROM bm JOIN ch USING (chunk_id) JOIN dc USING (document_id)""",
    "name_match": f"""WITH {_CH}, q AS ({_MATCH}), h AS (SELECT query_id, chunk_id, name, text,
          row_number() OVER (PARTITION BY query_id ORDER BY length(name), chunk_id) AS rank
          FROM ch JOIN q ON lower(name) LIKE '%' || lower(text) || '%')
        SELECT query_id, chunk_id, name, CAST(CASE WHEN lower(name) = text THEN 1.0 WHEN starts_with(lower(name), text) THEN 0.9
          ELSE 0.75 END AS DOUBLE) AS tier, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 20""",
    "find_symbol": f"WITH {_CH} SELECT chunk_id, name, chunk_type, '/' || document_id AS source_path FROM ch WHERE lower(name) LIKE '%the%' ORDER BY name, chunk_id LIMIT 20",
    "find_symbol_typed": f"""WITH {_CH} SELECT chunk_id, name, chunk_type FROM ch
        WHERE chunk_type = 'class' AND lower(name) LIKE '%t_%' ORDER BY name, chunk_id LIMIT 20""",
    "part_names": """SELECT p_partkey AS chunk_id, p_name AS name, p_type AS chunk_type FROM part
        WHERE lower(p_name) LIKE '%ring%' ORDER BY name, chunk_id LIMIT 20""",
    "file_context": f"""WITH {_CH} SELECT chunk_id, name, chunk_type,
          CAST(list_position(['class', 'interface', 'type', 'function', 'method'], chunk_type) AS INTEGER) AS type_order,
          array_to_string(string_split(content, chr(10))[1:2], chr(10)) AS preview FROM ch WHERE document_id = 'src3'""",
    "chunks_of_document": f"WITH {_CH} SELECT chunk_id, name, language FROM ch WHERE document_id = 'src1'",
    "point_lookup": f"WITH {_CH} SELECT chunk_id, document_id, name FROM ch WHERE chunk_id = 7",
    "documents_listing": "SELECT source AS document_id, count(*) AS chunk_count, max(doc_id) AS updated_at FROM documents GROUP BY source",
    "stats_totals": """SELECT count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, max(u) AS last_indexed
        FROM (SELECT count(*) AS n, max(doc_id) AS u FROM documents GROUP BY source)""",
    "stats_by_language": "SELECT lang AS language, count(*) AS chunks FROM documents GROUP BY lang",
    "stats_by_type": f"WITH {_CH} SELECT chunk_type, count(*) AS chunks FROM ch GROUP BY chunk_type",
    "stats_last_indexed": "SELECT max(ts) AS last_indexed FROM events",
    "json_metadata": """SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total
        FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        WHERE k IS NOT NULL GROUP BY event_type""",
    "stats_postings": f"WITH {_P} SELECT count(*) AS postings, CAST(sum(frequency) AS BIGINT) AS frequency FROM p",
    "vector_search": f"WITH {_vec(_VECTOR_QUERY, 10)} {_RANKED} FROM ve",
    "vector_batch": f"""WITH {_vec("(SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)", 10)}
        {_RANKED} FROM ve""",
    "embedding_dims": "SELECT CAST(len(embedding) AS INTEGER) AS dimensions, count(*) AS n FROM embeddings GROUP BY 1",
    "unembedded": f"WITH {_CH} SELECT chunk_id, name FROM ch WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings)",
    "with_embedding": """SELECT doc_id AS chunk_id, CAST(coalesce(len(embedding), 0) AS INTEGER) AS dimensions
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "rrf_fusion": f"""WITH {_BOTH} SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, round(score, 6) AS score,
        CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(vector_rank AS INTEGER) AS vector_rank FROM fu""",
    "hybrid_search": f"""WITH {_BOTH}, {_CH}, w AS (SELECT list_filter(string_split(lower('{QUERY}'), ' '), lambda t: length(t) > 1) AS w),
        be AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, lexical_rank NULLS LAST, vector_rank) AS b FROM fu),
        bo AS (SELECT query_id, chunk_id, b,
          least(score + 0.25 * len(list_filter(w, lambda t: contains(lower(name), t))) / len(w), 1.0) AS score
          FROM be JOIN ch USING (chunk_id) CROSS JOIN w WHERE b <= 40),
        rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, b) AS rank FROM bo)
        {_RANKED} FROM rk WHERE rank <= 10""",
    "edges_contains": f"WITH {_G}, {_GE} SELECT * FROM ge_contains",
    "edges_heritage": f"WITH {_G}, {_GE} SELECT * FROM ge_heritage",
    "edges_calls": f"""WITH {_CH}, {_SHORT_CALLS}, m AS (
          SELECT DISTINCT chunk_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS short FROM ch WHERE chunk_type IN ('function', 'method'))
        SELECT CAST(m.chunk_id AS VARCHAR) AS from_chunk_id, CAST(sc.id AS VARCHAR) AS to_chunk_id, short AS to_name, 'calls' AS edge_type,
          0.6::DOUBLE AS weight, true AS resolved FROM m JOIN sc USING (short) WHERE m.chunk_id <> sc.id""",
    "edge_counts": f"WITH {_G}, {_GE} SELECT edge_type, count(*) AS n, count(*) FILTER (resolved) AS resolved FROM ge GROUP BY edge_type",
    "ambiguous_names": f"""WITH {_CH} SELECT name AS short, count(*) AS n FROM ch WHERE chunk_type IN ('function', 'method')
        GROUP BY name HAVING count(*) > 1""",
    "graph_seeds": f"WITH {_G}, {_SEEDS} SELECT query_id, chunk_id, score, CAST(seed AS INTEGER) AS seed FROM ns",
    "graph_expansion": f"""WITH {_G}, {_GE}, {_SEEDS}, {_ALL_SEEDS}
        SELECT CAST(0 AS BIGINT) AS query_id, chunk_id, round(score, 6) AS score, CAST(level AS INTEGER) AS level FROM best""",
    "graph_search": f"""WITH {_G}, {_GE}, {_SEEDS}, {_ALL_SEEDS}, cut AS (
          SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, level, chunk_id) AS c FROM best),
        ty AS (SELECT chunk_id, score AS raw, score * CASE WHEN chunk_type = 'method' AND name LIKE '%.constructor' THEN 0.2
          WHEN chunk_type = 'class' THEN 0.9 WHEN chunk_type = 'interface' THEN 0.8 ELSE 1.0 END AS score
          FROM cut JOIN g USING (chunk_id) WHERE c <= 30),
        rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, round(raw, 9) DESC, chunk_id) AS rank FROM ty),
        out AS (SELECT CAST(0 AS BIGINT) AS query_id, chunk_id, score / max(score) OVER () AS score, rank FROM rk WHERE rank <= 10)
        {_RANKED} FROM out""",
    "type_multipliers": f"""WITH {_CH} SELECT chunk_type, round(sum(CASE WHEN chunk_type IN ('function', 'method') THEN 1.0
        WHEN chunk_type = 'class' THEN 0.9 WHEN chunk_type = 'interface' THEN 0.8 ELSE 0.4 END)::DOUBLE, 4) AS total FROM ch GROUP BY chunk_type""",
    "checksum_status": _STATUS,
    "job_counts": f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status",
    "upsert_documents": """SELECT doc_id, lang, CASE WHEN lang = 'de' THEN source ELSE 'new' END AS source,
          CASE WHEN lang = 'de' THEN n_chars ELSE n_chars + 1 END AS n_chars FROM documents
        UNION ALL SELECT -1 - page_id, 'xx', 'new', length(html) FROM pages""",
    "cascade_delete": f"""WITH {_G}, {_GE}, dead AS (SELECT chunk_id FROM g WHERE document_id = '2')
        SELECT from_chunk_id, CASE WHEN to_chunk_id IN (SELECT chunk_id FROM dead) THEN NULL ELSE to_chunk_id END AS to_chunk_id,
          to_name, edge_type, weight, resolved AND coalesce(to_chunk_id NOT IN (SELECT chunk_id FROM dead), true) AS resolved
        FROM ge WHERE from_chunk_id NOT IN (SELECT chunk_id FROM dead)""",
    "skip_reasons": f"""SELECT reason, count(*) AS files FROM (SELECT CASE WHEN starts_with({_BASE}, '.') THEN 'hidden_file'
          WHEN {_FIRST_DOT} IN ({_IGNORED}) THEN 'ignored_extension' WHEN ends_with({_BASE}, '.d.ts') THEN 'declaration_file'
          WHEN strlen(html) > 20000 THEN 'too_large' WHEN strlen(html) = 0 THEN 'empty_file'
          WHEN regexp_matches({_PATH}, '.[^/]*/fr/[^/]*') THEN 'exclude_pattern' ELSE 'kept' END AS reason FROM pages) GROUP BY reason""",
    "path_parts": rf"""SELECT page_id, {_BASE} AS name, {_FIRST_DOT} AS first_dot,
        regexp_extract({_BASE}, '(\.[^.]*)$', 1) AS last_dot FROM pages""",
    "breadcrumbs": f"""WITH {_G} SELECT chunk_id, concat_ws(chr(10), 'File: ' || document_id,
        CASE WHEN chunk_type = 'method' THEN 'Class: ' || parent END,
        CASE chunk_type WHEN 'method' THEN 'Method: ' WHEN 'class' THEN 'Class: ' ELSE 'Interface: ' END || name) AS breadcrumb FROM g""",
    "embedding_text": f"""WITH {_CH} SELECT chunk_id, sha256(CASE WHEN chunk_type IN ('function', 'method') THEN content ELSE
        language || ' ' || chunk_type || ': ' || name || chr(10) || 'Preview:' || chr(10)
        || trim(array_to_string(string_split(content, chr(10))[1:20], chr(10)), ' ') END) AS text_sha FROM ch""",
    "preview_lines": f"WITH {_CH} SELECT chunk_id, array_to_string(string_split(content, chr(10))[1:3], chr(10)) AS preview FROM ch",
    "project_map": f"""WITH {_G}, {_MAP}
        SELECT document_id AS source_path, sha256(document_id || ' [tpch]' || chr(10)
          || string_agg(line, chr(10) ORDER BY gr, pos, inn, n, line) || chr(10)) AS block_sha FROM x GROUP BY document_id""",
    "project_map_lines": f"""WITH {_G}, {_MAP}, y AS (SELECT document_id AS source_path, 1 AS part, gr AS g, pos AS at, inn AS inner, n AS start_line, line FROM x
        UNION ALL SELECT DISTINCT document_id, 0, 0, 0, 0, 0, document_id || ' [tpch]' FROM x
        UNION ALL SELECT DISTINCT document_id, 2, 0, 0, 0, 0, '' FROM x) SELECT * FROM y""",
    "term_counts_in_row": f"""WITH {_P}, {_DL} SELECT doc_id AS chunk_id, CAST(coalesce(doc_len, 0) AS INTEGER) AS n_terms,
        CAST(coalesce(nd, 0) AS INTEGER) AS n_distinct FROM documents LEFT JOIN dl ON doc_id = chunk_id
        LEFT JOIN (SELECT chunk_id AS c2, count(*) AS nd FROM p GROUP BY 1) ON doc_id = c2""",
}
