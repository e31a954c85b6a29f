"""SQL statements that give the registered queries' results independently."""

from __future__ import annotations

from . import adapters as AD
from . import queries as Q

TOKEN = "[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*"


def _tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda t: lower(t))"


def _fold(text: str) -> str:
    return f"lower(replace(replace({text}, 'ß', 'ss'), 'ẞ', 'ss'))"


def _normalize(text: str) -> str:
    return f"trim(regexp_replace({_fold(text)}, '[^a-z0-9]+', ' ', 'g'))"


def _slug(text: str) -> str:
    dashed = f"trim(regexp_replace({_fold(text)}, '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif({dashed}, ''), 'item')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _half_even(x: str) -> str:
    """Six digits, half to even on the exact binary value of x (product error included)."""
    big = f"({x} * 134217729::DOUBLE)"
    high = f"({big} - ({big} - {x}))"
    product = f"({x} * 1e6::DOUBLE)"
    error = f"(({high} * 1e6::DOUBLE - {product}) + ({x} - {high}) * 1e6::DOUBLE)"
    whole = f"floor({product})"
    beyond = f"({product} - {whole} - 0.5::DOUBLE)"
    up = f"{beyond} > 0 OR ({beyond} = 0 AND ({error} > 0 OR ({error} = 0 AND {whole}::BIGINT % 2 = 1)))"
    return f"({whole} + CASE WHEN {up} THEN 1 ELSE 0 END) / 1e6::DOUBLE"


CHUNKS = """
chunks AS (
  SELECT doc_id AS chunk_seq, 'doc-' || doc_id AS chunk_id,
         (doc_id % 9 + 1) || '.' || substr(source, 4) AS section,
         split_part(text, chr(10), 1) AS section_title,
         lang AS content_type, text, source AS source_file
  FROM documents WHERE regexp_matches(text, '\\S')
)"""

INDEX = f"""{CHUNKS},
tokens AS (
  SELECT chunk_id, section, content_type,
         list_concat({_tokens('text')},
           list_concat(list_concat({_tokens('section_title')}, {_tokens('section_title')}),
                       list_concat({_tokens('section_title')}, {_tokens('section_title')})),
           [lower(section)]) AS toks
  FROM chunks
),
docs AS (SELECT chunk_id, section, content_type, CAST(len(toks) AS INTEGER) AS doc_len FROM tokens),
postings AS (
  SELECT chunk_id, term, CAST(count(*) AS INTEGER) AS tf
  FROM (SELECT chunk_id, unnest(toks) AS term FROM tokens) GROUP BY ALL
),
stats AS (SELECT count(*) AS n, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avg_len FROM docs),
idf AS (
  SELECT term, count(*) AS df,
         ln(1.0::DOUBLE + ((SELECT n FROM stats)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf
  FROM postings GROUP BY term
)"""


def _search(queries: str) -> str:
    """Scores of ``queries``: a SELECT of (query_id, query)."""
    return f"""{INDEX},
queries AS ({queries}),
qterms AS (
  SELECT query_id, term, min(pos) AS pos FROM (
    SELECT query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos
    FROM (SELECT query_id, {_tokens('query')} AS toks FROM queries)
  ) GROUP BY ALL
),
parts AS (
  SELECT q.query_id, p.chunk_id, q.pos, q.term,
         i.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.doc_len / s.avg_len)) AS part
  FROM qterms q JOIN postings p USING (term) JOIN idf i USING (term) JOIN docs d USING (chunk_id), stats s
),
scored AS (
  SELECT query_id, chunk_id, d.section, d.content_type,
         list_reduce(list(part ORDER BY pos), lambda a, b: a + b) AS score,
         array_to_string(list(term ORDER BY pos), '|') AS matched_terms
  FROM parts JOIN docs d USING (chunk_id) GROUP BY ALL
)"""


def _single(where: str, columns: str, k: int = 20) -> str:
    body = _search(f"SELECT 0 AS query_id, '{Q.SEARCH_TEXT}' AS query")
    return f"""WITH {body},
ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY score DESC, section, chunk_id) AS INTEGER) AS rank
  FROM scored WHERE {where}
)
SELECT {columns} FROM ranked WHERE rank <= {k}"""


_HIT = "rank, chunk_id, section, round(score, 6) AS score"
_QUESTIONS = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _many(k: int) -> str:
    return f"""WITH {_search(_QUESTIONS)},
hits AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section, chunk_id) AS INTEGER) AS rank
    FROM scored
  ) WHERE rank <= {k}
)"""


_EVAL = _many(5) + """,
results AS (
  SELECT b.item_id AS id, CAST(b.item_id % 9 + 1 AS VARCHAR) AS required_sections,
         coalesce(string_agg(h.section, '|' ORDER BY h.rank), '') AS retrieved_sections,
         min(CASE WHEN h.section = CAST(b.item_id % 9 + 1 AS VARCHAR)
                    OR starts_with(h.section, (b.item_id % 9 + 1) || '.') THEN h.rank END) AS first_relevant_rank
  FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id GROUP BY b.item_id
)"""

_VECTOR = """
query AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
vscored AS (
  SELECT vec_id, 'doc-' || vec_id AS chunk_id,
         list_dot_product(CAST(embedding AS DOUBLE[]), q)
           / (greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)
              * greatest(sqrt(list_dot_product(q, q)), 1e-12)) AS score
  FROM embeddings, query
),
vhits AS (
  SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM vscored QUALIFY rank <= 20
)"""

# -- document graph -----------------------------------------------------------

_TYPE = """CASE WHEN starts_with(section, '8.') THEN 'NASMessage' WHEN starts_with(section, '9.') THEN 'InformationElement'
  WHEN starts_with(section, '5.') THEN 'Procedure' WHEN starts_with(section, '4.') THEN 'SecurityConcept' ELSE 'Term' END"""


def _span_start(value: str) -> str:
    return f"CASE WHEN {value} = '' THEN 0 ELSE strpos({_fold('text')}, {_fold(value)}) END"


_LICENSE = AD.LICENSE_PATTERN

DOC_GRAPH = f"""{CHUNKS},
facts AS (
  SELECT *, regexp_replace(section, '\\.[^.]*$', '') AS parent, {_strip('section_title')} AS label,
         {_TYPE} AS kind, length(text) AS text_len,
         {_span_start('section_title')} AS title_at, {_span_start(_strip('section_title'))} AS label_at
  FROM chunks
),
base AS (
  SELECT *, 'section:' || section AS section_id,
         CASE WHEN label <> '' THEN lower(kind) || ':' || {_slug('label')} END AS entity_node,
         CASE WHEN title_at > 0 THEN title_at - 1 ELSE 0 END AS t0,
         CASE WHEN title_at > 0 THEN title_at - 1 + length(section_title)
              ELSE least(text_len, greatest(length(section_title), 1)) END AS t1,
         CASE WHEN label_at > 0 THEN label_at - 1 ELSE 0 END AS l0,
         CASE WHEN label_at > 0 THEN label_at - 1 + length(label)
              ELSE least(text_len, greatest(length(label), 1)) END AS l1
  FROM facts
),
found AS (
  SELECT *, generate_subscripts(ms, 1) AS ref_no, unnest(ms) AS m
  FROM (SELECT *, regexp_extract_all(text, '{_LICENSE}') AS ms, string_split_regex(text, '{_LICENSE}') AS gaps FROM base)
),
refs AS (
  SELECT *, list_sum(list_transform(gaps[1:ref_no], lambda g: length(g)))
            + coalesce(list_sum(list_transform(ms[1:ref_no - 1], lambda g: length(g))), 0) AS r0,
         upper(m) AS ref_label
  FROM found
),
node_rows AS (
  SELECT chunk_seq, 0 AS step, section_id AS node_id, trim(section || ' ' || section_title) AS entity_id, 'Section' AS node_type,
         section, section_title, chunk_id, t0 AS c0, t1 AS c1, 'verified' AS confidence_label FROM base
  UNION ALL
  SELECT chunk_seq, 1, 'section:' || parent, parent, 'Section', parent, '', chunk_id, 0, least(text_len, length(parent)), 'candidate' FROM base
  UNION ALL
  SELECT chunk_seq, 2, entity_node, label, kind, section, section_title, chunk_id, l0, l1, 'verified' FROM base WHERE label <> ''
  UNION ALL
  SELECT chunk_seq, 2 + ref_no, 'external_spec:' || {_slug('ref_label')}, ref_label, 'ExternalSpec', section, section_title, chunk_id,
         r0, r0 + length(m), 'verified' FROM refs
),
nodes AS (
  SELECT node_id, entity_id, node_type, section, section_title, chunk_id, CAST(CAST(c0 AS BIGINT) AS VARCHAR) AS char_start,
         CAST(CAST(c1 AS BIGINT) AS VARCHAR) AS char_end, confidence_label
  FROM node_rows QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY chunk_seq, step) = 1
),
edge_rows AS (
  SELECT chunk_seq, 1 AS step, section_id AS source, 'Section' AS st, 'SUBCLAUSE_OF' AS keywords, 'section:' || parent AS target,
         chunk_id, section, 0 AS c0, least(text_len, greatest(length(section), 1)) AS c1, 'section_hierarchy' AS extraction_method, source_file FROM base
  UNION ALL
  SELECT chunk_seq, 2, entity_node, kind, 'DEFINED_IN', section_id, chunk_id, section, l0, l1, 'section_title', source_file FROM base WHERE label <> ''
  UNION ALL
  SELECT chunk_seq, 2 + ref_no, coalesce(entity_node, section_id), CASE WHEN label <> '' THEN kind ELSE 'Section' END, 'REFERENCES',
         'external_spec:' || {_slug('ref_label')}, chunk_id, section, r0, r0 + length(m), 'reference_pattern', source_file FROM refs
),
legal_rows AS (SELECT *, NOT (st = 'InformationElement' AND keywords = 'REFERENCES') AS legal FROM edge_rows),
edges AS (
  SELECT 'edge:' || {_slug('source')} || ':' || lower(keywords) || ':' || {_slug('target')} AS edge_id, source, target, keywords,
         chunk_id, section, CAST(CAST(c0 AS BIGINT) AS VARCHAR) AS char_start, CAST(CAST(c1 AS BIGINT) AS VARCHAR) AS char_end,
         'verified' AS confidence_label, extraction_method, source_file
  FROM legal_rows WHERE legal QUALIFY row_number() OVER (PARTITION BY source, keywords, target ORDER BY chunk_seq, step) = 1
)"""

# -- trade graph --------------------------------------------------------------

TRADE = """
tnodes AS (
  SELECT 'region:' || r_regionkey AS node_id, 1000000000000 + r_regionkey AS node_seq, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 2000000000000 + n_nationkey, n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 3000000000000 + c_custkey, c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 4000000000000 + s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 5000000000000 + p_partkey, p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 6000000000000 + o_orderkey, '' FROM orders
),
named AS (SELECT node_id, node_seq, coalesce(nullif(name, ''), node_id) AS label FROM tnodes),
raw_edges AS (
  SELECT 1 AS kind, 'IN_REGION' AS relation, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, n_nationkey::BIGINT AS k1, NULL::BIGINT AS k2 FROM nation
  UNION ALL SELECT 2, 'IN_NATION', 'customer:' || c_custkey, 'nation:' || c_nationkey, c_custkey, NULL FROM customer
  UNION ALL SELECT 3, 'BASED_IN', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, s_suppkey, NULL FROM supplier
  UNION ALL SELECT 4, 'PLACED', 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey, NULL FROM orders
  UNION ALL SELECT DISTINCT 5, 'CONTAINS', 'order:' || l_orderkey, 'part:' || l_partkey, l_orderkey, l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 6, 'SUPPLIED_BY', 'part:' || l_partkey, 'supplier:' || l_suppkey, l_partkey, l_suppkey FROM lineitem
),
tedges AS (
  SELECT relation || ':' || k1 || coalesce('-' || k2, '') AS edge_id, source, target, relation AS relations,
         (kind::HUGEINT * 1000000000000000000 + k1) * 1000000000000000000 + coalesce(k2, 0) AS edge_seq FROM raw_edges
)"""


def _neighbors(where: str, columns: str) -> str:
    return f"""WITH {TRADE}
SELECT {columns} FROM tedges
LEFT JOIN named a ON a.node_id = source LEFT JOIN named b ON b.node_id = target
WHERE {where} ORDER BY lower(source), lower(target), edge_id LIMIT 50"""


def _paths(source: str, target: str, hops: int, directed: bool) -> str:
    back = "" if directed else (
        "UNION ALL SELECT target, source, 100000000000000000000000000000000000000::HUGEINT + edge_seq, edge_id FROM tedges"
    )
    return f"""WITH RECURSIVE {TRADE},
adj AS (SELECT source AS here, target AS there, edge_seq AS step, edge_id FROM tedges {back}),
walk AS (
  SELECT '{source}' AS here, ['{source}'] AS visited, CAST([] AS HUGEINT[]) AS key, CAST([] AS VARCHAR[]) AS path
  UNION ALL
  SELECT a.there, list_append(visited, a.there), list_append(key, a.step), list_append(path, a.edge_id)
  FROM walk w JOIN adj a ON a.here = w.here
  WHERE w.here <> '{target}' AND len(path) < {hops} AND NOT list_contains(visited, a.there)
)
SELECT CAST(row_number() OVER (ORDER BY len(path), key) AS INTEGER) AS rank, CAST(len(path) AS INTEGER) AS hops,
       array_to_string(path, '|') AS path
FROM walk WHERE here = '{target}' AND len(path) > 0 QUALIFY rank <= 5"""


_SIX_HOPS = f"""WITH {TRADE},
adj AS (
  SELECT source AS here, target AS there, edge_seq AS step, edge_id FROM tedges WHERE relations NOT IN ('PLACED', 'CONTAINS', 'IN_NATION')
  UNION ALL
  SELECT target, source, 100000000000000000000000000000000000000::HUGEINT + edge_seq, edge_id FROM tedges
  WHERE relations NOT IN ('PLACED', 'CONTAINS', 'IN_NATION')
),
near AS (SELECT a.step AS s1, a.edge_id AS e1, b.there AS mid, b.step AS s2, b.edge_id AS e2, c.there AS part, c.step AS s3, c.edge_id AS e3
  FROM adj a JOIN adj b ON a.here = '{Q.REGION_ENDS[0]}' AND b.here = a.there AND b.there <> a.here
  JOIN adj c ON c.here = b.there AND c.there <> a.there),
far AS (SELECT d.here AS part, d.there AS mid, d.step AS s4, d.edge_id AS e4, e.step AS s5, e.edge_id AS e5, f.step AS s6, f.edge_id AS e6
  FROM adj f JOIN adj e ON f.there = '{Q.REGION_ENDS[1]}' AND e.there = f.here AND e.here <> f.there
  JOIN adj d ON d.there = e.here AND d.here <> f.here),
met AS (SELECT [s1, s2, s3, s4, s5, s6] AS key, [e1, e2, e3, e4, e5, e6] AS path FROM near n JOIN far USING (part) WHERE n.mid <> far.mid)
SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS rank, 6 AS hops, array_to_string(path, '|') AS path
FROM met QUALIFY rank <= 8"""

# -- topic graph --------------------------------------------------------------

TOPICS = f"""
topics AS (
  SELECT doc_id, lang, (doc_id % 9 + 1) || '.' || substr(source, 4) AS section,
         split_part(text, chr(10), 1) AS line0,
         array_to_string(string_split(text, chr(10))[2:], chr(10)) AS description FROM documents
),
paths AS (
  SELECT *, CASE WHEN doc_id % 10 = 0 THEN ''
    WHEN doc_id % 10 = 1 THEN '{AD.PROVENANCE}' || section || '<SEP>{AD.PROVENANCE}4.7'
    WHEN doc_id % 10 = 2 THEN '{AD.OTHER_PROVENANCE}' ELSE '{AD.PROVENANCE}' || section END AS file_path,
    array_to_string(string_split(line0, ' ')[1:2], ' ') AS entity_id
  FROM topics
),
gnodes AS (
  SELECT doc_id, 'topic:' || doc_id AS node_id, entity_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS entity_type,
         description, file_path, CASE WHEN contains(file_path, '24501-j20') THEN '24501-j20.docx' ELSE '' END AS source_file FROM paths
),
gedges AS (
  SELECT doc_id, 'edge:' || doc_id AS edge_id, 'topic:' || doc_id AS source,
         'topic:' || CASE WHEN doc_id % 25 = 0 THEN doc_id ELSE doc_id + 1 END AS target,
         'FOLLOWS<SEP> ' || lang AS keywords, lang,
         CASE WHEN doc_id % 2 = 0 THEN file_path ELSE '{AD.OTHER_PROVENANCE}' END AS file_path FROM paths
),
nmatch AS (
  SELECT *, contains(replace(file_path, '.', ''), '24501') OR contains(replace(source_file, '.', ''), '24501')
            OR contains(replace(description, '.', ''), '24501') AS matched FROM gnodes
),
ematch AS (SELECT *, contains(replace(file_path, '.', ''), '24501') AS matched FROM gedges)"""

AUDIT = f"""{TOPICS},
sections AS (
  SELECT trim(split_part(raw, '24501-j20.md', 2)) AS section FROM (
    SELECT unnest(list_distinct(string_split(file_path, '<SEP>'))) AS raw FROM nmatch WHERE matched
    UNION ALL SELECT unnest(list_distinct(string_split(file_path, '<SEP>'))) FROM ematch WHERE matched
  ) WHERE contains(raw, '24501-j20.md')
),
counts AS (
  SELECT 'nodes' AS metric, '' AS key, count(*) AS n FROM gnodes
  UNION ALL SELECT 'edges', '', count(*) FROM gedges
  UNION ALL SELECT 'self_loops', '', count(*) FROM gedges WHERE source = target HAVING count(*) > 0
  UNION ALL SELECT 'entity_type', coalesce(nullif(entity_type, ''), 'UNKNOWN'), count(*) FROM gnodes GROUP BY 2
  UNION ALL SELECT 'node_attribute', k, count(*) FROM (
    SELECT unnest(['entity_id', 'entity_type', 'description', 'file_path', 'source_file']) AS k,
           unnest([entity_id, entity_type, description, file_path, source_file]) AS v FROM gnodes) WHERE v <> '' GROUP BY k
  UNION ALL SELECT 'edge_attribute', k, count(*) FROM (
    SELECT unnest(['keywords', 'file_path']) AS k, unnest([keywords, file_path]) AS v FROM gedges) WHERE v <> '' GROUP BY k
  UNION ALL SELECT 'relation', r, count(*) FROM (SELECT unnest(['FOLLOWS', lang]) AS r FROM gedges) GROUP BY r
  UNION ALL SELECT 'matching_spec_nodes', '', count(*) FROM nmatch WHERE matched HAVING count(*) > 0
  UNION ALL SELECT 'matching_spec_edges', '', count(*) FROM ematch WHERE matched HAVING count(*) > 0
  UNION ALL SELECT 'section', section, count(*) FROM sections WHERE section <> '' GROUP BY section
  UNION ALL SELECT 'source_token', '24501-j20', count(*) FROM nmatch WHERE matched AND contains(source_file, '24501-j20') HAVING count(*) > 0
)"""

EXPORT = f"""{TOPICS},
direct AS (SELECT node_id FROM nmatch WHERE matched),
retained AS (
  SELECT node_id FROM direct UNION SELECT source FROM ematch WHERE matched UNION SELECT target FROM ematch WHERE matched
),
kept AS (
  SELECT edge_id, source, target, matched AS provenance FROM ematch
  WHERE matched OR (source IN (FROM retained) AND target IN (FROM retained))
)"""

_ITEMS = f"""{TOPICS},
marked AS (
  SELECT node_id AS graph_item_id, 'node' AS graph_item_type, coalesce(nullif(entity_id, ''), node_id) AS label, description, file_path FROM gnodes
  UNION ALL
  SELECT source || '->' || target || '#' || (doc_id + 1), 'edge', 'FOLLOWS ' || lang, '', file_path FROM gedges
),
items AS (
  SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(file_path, '(?i)24501-j20\\.md([0-9A-Z.]+)', 1),
            lambda s: trim(s, '.')), lambda s: s <> ''))) AS sections FROM marked
)"""

_ALIGN_BASE = _search("SELECT graph_item_id AS query_id, trim(label || ' ' || description) AS query FROM lonely")

ALIGN = f"""{_ITEMS},
{_ALIGN_BASE.replace('queries AS (', '''direct AS (
  SELECT i.graph_item_id, c.chunk_id FROM items i JOIN chunks c ON list_contains(i.sections, c.section)
),
lonely AS (SELECT * FROM items WHERE graph_item_id NOT IN (SELECT graph_item_id FROM direct)),
queries AS (''', 1)},
candidates AS (
  SELECT graph_item_id, chunk_id FROM direct
  UNION ALL
  SELECT query_id, chunk_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section, chunk_id) AS r FROM scored) WHERE r <= 6
),
chunk_facts AS (
  SELECT chunk_id, section, {_normalize('text')} AS norm_text, list_distinct({_tokens('text')}) AS chunk_tokens FROM chunks
),
item_facts AS (
  SELECT *, {_normalize('label')} AS norm_label,
         list_distinct({_tokens("coalesce(nullif(description, ''), label)")}) AS item_tokens FROM items
),
signals AS (
  SELECT i.graph_item_id, i.graph_item_type, c.chunk_id,
         i.norm_label <> '' AND contains(c.norm_text, i.norm_label) AS name_match,
         list_contains(i.sections, c.section) AS section_match,
         len(list_intersect(i.item_tokens, c.chunk_tokens)) AS shared, len(i.item_tokens) AS ni, len(c.chunk_tokens) AS nc
  FROM candidates JOIN item_facts i USING (graph_item_id) JOIN chunk_facts c USING (chunk_id)
),
components AS (
  SELECT *, CASE WHEN section_match THEN 0.45::DOUBLE ELSE 0 END AS section_score,
         CASE WHEN name_match THEN 0.4::DOUBLE ELSE 0 END AS name_score,
         CASE WHEN ni = 0 OR nc = 0 THEN 0::DOUBLE ELSE shared::DOUBLE / (ni + nc - shared) END AS overlap
  FROM signals
),
scaled AS (SELECT *, least(overlap / 0.3::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE AS raw_overlap FROM components),
rounded AS (SELECT *, {_half_even('raw_overlap')} AS overlap_score FROM scaled),
totals AS (SELECT *, round(section_score + name_score + overlap_score, 6) AS confidence FROM rounded),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY graph_item_id ORDER BY confidence DESC, chunk_id) AS INTEGER) AS rank FROM totals
),
aligned AS (
  SELECT graph_item_id, graph_item_type, rank, chunk_id, round(confidence, 6) AS confidence,
         CASE WHEN confidence >= 0.88 AND name_match AND section_match THEN 'verified'
              WHEN confidence >= 0.68 AND section_match THEN 'high' ELSE 'candidate' END AS confidence_label,
         array_to_string(list_filter([CASE WHEN section_match THEN 'provenance_section' END, CASE WHEN name_match THEN 'entity_name' END,
           CASE WHEN overlap > 0 THEN 'description_overlap' END], lambda m: m IS NOT NULL), '|') AS match_methods,
         section_score, name_score, overlap_score
  FROM ranked WHERE rank <= 3 AND confidence > 0
)"""

# -- ingestion ----------------------------------------------------------------

INGEST = f"""
raw_blocks AS (
  SELECT doc_id AS doc, CAST(doc_id % 9 + 1 AS VARCHAR) AS top, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
),
shaped AS (
  SELECT doc, i, i % 4 = 0 AS styled, (i // 4) % 3 + 1 AS level,
         CASE WHEN i % 4 = 3 THEN 'table' ELSE 'paragraph' END AS kind,
         trim(regexp_replace(CASE WHEN i % 4 = 0 THEN top || '.' || (i // 4) || chr(9) || line ELSE line END, '[ \\t]+', ' ', 'g')) AS text
  FROM raw_blocks
),
blocks AS (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i) AS ord,
         styled AND regexp_matches(text, '^\\d+[A-Z]?(?:\\.[0-9A-Z]+)*\\s+\\S') AS is_head,
         regexp_extract(text, '^(\\d+[A-Z]?(?:\\.[0-9A-Z]+)*)\\s+', 1) AS number
  FROM shaped WHERE text <> ''
),
walk AS (
  SELECT doc, ord, is_head, CASE WHEN is_head THEN number END AS section, CASE WHEN is_head THEN ord END AS head_ord,
         0 AS grp, 0 AS idx, NULL::VARCHAR AS open_kind, 0 AS size
  FROM blocks WHERE ord = 1
  UNION ALL
  SELECT b.doc, b.ord, b.is_head,
         CASE WHEN b.is_head THEN b.number ELSE w.section END, CASE WHEN b.is_head THEN b.ord ELSE w.head_ord END,
         CASE WHEN NOT b.is_head AND w.section IS NOT NULL AND (b.kind = 'table' OR w.open_kind IS NULL OR w.open_kind = 'table'
              OR w.size + length(b.text) + 2 > {Q.PACK_CHARS}) THEN w.grp + 1 ELSE w.grp END,
         CASE WHEN b.is_head THEN 0 WHEN w.section IS NOT NULL AND (b.kind = 'table' OR w.open_kind IS NULL OR w.open_kind = 'table'
              OR w.size + length(b.text) + 2 > {Q.PACK_CHARS}) THEN w.idx + 1 ELSE w.idx END,
         CASE WHEN b.is_head THEN NULL WHEN w.section IS NOT NULL THEN b.kind ELSE w.open_kind END,
         CASE WHEN b.is_head THEN 0 WHEN w.section IS NOT NULL AND (b.kind = 'table' OR w.open_kind IS NULL OR w.open_kind = 'table'
              OR w.size + length(b.text) + 2 > {Q.PACK_CHARS}) THEN length(b.text) + 2 ELSE w.size + length(b.text) + 2 END
  FROM walk w JOIN blocks b ON b.doc = w.doc AND b.ord = w.ord + 1
),
packed AS (
  SELECT w.doc, CAST(w.grp - 1 AS INTEGER) AS chunk_no, w.section, w.head_ord, w.idx, any_value(b.kind) AS content_type,
         {_strip("string_agg(b.text, chr(10) || chr(10) ORDER BY b.ord)")} AS text
  FROM walk w JOIN blocks b USING (doc, ord) WHERE NOT w.is_head AND w.section IS NOT NULL GROUP BY ALL
),
heads AS (SELECT doc, ord, level, number FROM blocks WHERE is_head),
trails AS (
  SELECT h.doc, h.ord, string_agg(u.number, '|' ORDER BY u.ord) AS heading_path
  FROM heads h JOIN heads u ON u.doc = h.doc AND u.ord <= h.ord
  WHERE NOT EXISTS (SELECT 1 FROM heads x WHERE x.doc = h.doc AND x.ord > u.ord AND x.ord <= h.ord AND x.level <= u.level)
  GROUP BY h.doc, h.ord
)"""

_PAGE = "CASE WHEN split_part(section, '.', 2) IN ('0', '1', '2') THEN CAST(doc % 50 + CAST(split_part(section, '.', 2) AS INTEGER) AS INTEGER) END"

SQL: dict[str, str] = {
    "bm25_postings": f"WITH {INDEX} SELECT chunk_id, term, tf FROM postings",
    "bm25_doc_len": f"WITH {INDEX} SELECT chunk_id, doc_len FROM docs",
    "bm25_stats": f"WITH {INDEX} SELECT n, round(avg_len, 6) AS avg_len FROM stats",
    "bm25_idf": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _single("true", _HIT),
    "bm25_stored_topk": _single("true", _HIT),
    "bm25_section_filter": _single("section = '4' OR starts_with(section, '4.')", _HIT),
    "bm25_type_filter": _single("content_type IN ('de', 'fr')", _HIT),
    "bm25_matched_terms": _single("true", "rank, chunk_id, matched_terms"),
    "bm25_search_many": _many(10)
    + " SELECT query_id, rank, chunk_id, section, round(score, 6) AS score, matched_terms FROM hits",
    "excerpt_projection": _single(
        "true",
        """rank, ranked.chunk_id, c.section_title, substr(c.text, 1, 1600) AS excerpt,
        CASE WHEN length(c.text) > 700 THEN substr(c.text, 1, 700) || '...' ELSE c.text END AS display""",
    ).replace("FROM ranked WHERE", "FROM ranked JOIN chunks c USING (chunk_id) WHERE"),
    "eval_per_question": f"{_EVAL} SELECT *, first_relevant_rank IS NOT NULL AS passed FROM results",
    "eval_recall_mrr": f"""{_EVAL} SELECT count(*) AS questions, 5 AS top_k,
        round(avg(CASE WHEN first_relevant_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall_at_k,
        round(avg(coalesce(1.0::DOUBLE / first_relevant_rank, 0.0::DOUBLE)), 6) AS mean_reciprocal_rank FROM results""",
    "vector_normalize": """SELECT 'doc-' || vec_id AS chunk_id, CAST(pos - 1 AS INTEGER) AS pos,
        round(v / greatest(norm, 1e-12), 5) AS value
        FROM (SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) AS pos, sqrt(list_dot_product(e, e)) AS norm
              FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""",
    "vector_topk": f"WITH {_VECTOR} SELECT rank, chunk_id, round(score, 6) AS score FROM vhits",
    "rrf_fusion": _single("true", "*").replace("SELECT * FROM ranked WHERE rank <= 20", "")
    + f""", lhits AS (SELECT chunk_id, rank FROM ranked WHERE rank <= 20), {_VECTOR},
fused AS (
  SELECT coalesce(l.chunk_id, v.chunk_id) AS chunk_id, l.rank AS lexical_rank, v.rank AS vector_rank,
         coalesce(1.0::DOUBLE / (60 + l.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + v.rank), 0.0::DOUBLE) AS score
  FROM lhits l FULL OUTER JOIN vhits v ON l.chunk_id = v.chunk_id
)
SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score,
       lexical_rank, vector_rank FROM fused QUALIFY rank <= 10""",
    "graph_nodes": f"WITH {DOC_GRAPH} SELECT * FROM nodes",
    "graph_edges": f"WITH {DOC_GRAPH} SELECT * FROM edges",
    "graph_round_trip": f"""WITH {DOC_GRAPH} SELECT 'node' AS kind, row_number() OVER (ORDER BY node_id) AS seq, node_id AS id,
        CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target, trim(entity_id) AS entity_id,
        CAST(NULL AS VARCHAR) AS keywords, section, CAST(char_start AS VARCHAR) AS char_start FROM nodes
        UNION ALL SELECT 'edge', row_number() OVER (ORDER BY edge_id), edge_id, source, target, NULL, keywords, section,
        CAST(char_start AS VARCHAR) FROM edges""",
    "graph_whitelist": f"""WITH {DOC_GRAPH} SELECT split_part(source, ':', 1) AS source_kind, keywords AS relation, legal,
        count(*) AS proposals FROM legal_rows GROUP BY ALL""",
    "graph_build_counts": f"""WITH {DOC_GRAPH} SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM nodes) AS nodes,
        (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE chunk_id <> '') AS provenance_edges,
        (SELECT count(*) FROM legal_rows WHERE NOT legal) AS skipped_illegal_triples""",
    "neighbors_both": _neighbors(
        f"source = '{Q.HUB}' OR target = '{Q.HUB}'", "edge_id, source, target, relations"
    ),
    "neighbors_relation": _neighbors(
        f"target = '{Q.HUB}' AND relations = 'BASED_IN'", "edge_id, source, target, relations"
    ),
    "edge_labels": _neighbors(
        f"source = '{Q.HUB}' OR target = '{Q.HUB}'",
        "edge_id, source, target, relations, a.label AS source_label, b.label AS target_label",
    ),
    "node_degree": f"""WITH {TRADE} SELECT n.node_id, coalesce(i.c, 0) AS incoming_count, coalesce(o.c, 0) AS outgoing_count
        FROM tnodes n LEFT JOIN (SELECT target, count(*) AS c FROM tedges GROUP BY 1) i ON i.target = n.node_id
        LEFT JOIN (SELECT source, count(*) AS c FROM tedges GROUP BY 1) o ON o.source = n.node_id""",
    "node_inspect": f"""WITH {TRADE} SELECT node_id, label,
        (SELECT count(*) FROM tedges WHERE target = node_id) AS incoming_count,
        (SELECT count(*) FROM tedges WHERE source = node_id) AS outgoing_count FROM named WHERE node_id = '{Q.HUB}'""",
    "paths_undirected": _paths(*Q.PATH_ENDS, 3, False),
    "paths_directed": _paths("customer:10", "region:1", 5, True),
    "paths_six_hops": _SIX_HOPS,
    "resolve_exact_token_substring": f"""WITH {TRADE},
normal AS (SELECT *, {_normalize('label')} AS l, '{Q.ENTITY_TEXT}' AS q FROM named),
tested AS (
  SELECT *, CASE WHEN l = q THEN 'exact' WHEN list_contains(string_split(l, ' '), q) THEN 'token'
                 WHEN contains(l, q) OR contains(q, l) THEN 'substring' END AS method FROM normal
)
SELECT node_id, label, method, round(CASE method WHEN 'exact' THEN 1.0::DOUBLE WHEN 'token' THEN 0.98::DOUBLE
       ELSE 0.85::DOUBLE + 0.14::DOUBLE * (least(length(q), length(l))::DOUBLE / greatest(length(q), length(l))) END, 6) AS score
FROM tested WHERE method IS NOT NULL ORDER BY score DESC, length(label), lower(label), node_seq LIMIT 100""",
    "resolve_terms": f"""WITH {TRADE},
terms AS (
  SELECT DISTINCT 'part ' || p_name AS term_id, p_name AS term FROM part
  UNION ALL SELECT 'supplier ' || s_suppkey, upper(s_name) FROM supplier
  UNION ALL SELECT 'place ' || n_nationkey, n_name || ', ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
),
asked AS (SELECT term_id, {_normalize('term')} AS q FROM terms),
normal AS (SELECT *, {_normalize('label')} AS l FROM named),
tested AS (
  SELECT *, CASE WHEN l = q THEN 'exact' WHEN list_contains(string_split(l, ' '), q) THEN 'token' ELSE 'substring' END AS method
  FROM asked JOIN normal ON contains(l, q) OR contains(q, l) WHERE q <> ''
),
scored AS (
  SELECT *, CASE method WHEN 'exact' THEN 1.0::DOUBLE WHEN 'token' THEN 0.98::DOUBLE
    ELSE 0.85::DOUBLE + 0.14::DOUBLE * (least(length(q), length(l))::DOUBLE / greatest(length(q), length(l))) END AS score FROM tested
)
SELECT term_id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY score DESC, length(label), lower(label), node_seq) AS INTEGER) AS rank,
  node_id, label, round(score, 6) AS score, method FROM scored QUALIFY rank <= 6""",
    "audit_counts": f"WITH {AUDIT} SELECT metric, key, n FROM counts",
    "audit_summary": f"""WITH {AUDIT} SELECT {', '.join(
        f"CAST(coalesce(sum(n) FILTER (WHERE metric = '{m}'), 0) AS BIGINT) AS {m}"
        for m in ('nodes', 'edges', 'self_loops', 'matching_spec_nodes', 'matching_spec_edges'))} FROM counts""",
    "audit_trade_relations": f"WITH {TRADE} SELECT relations AS key, count(*) AS n FROM tedges GROUP BY 1",
    "audit_histogram": f"""WITH {TOPICS},
raw AS (
  SELECT 0 AS side, doc_id, unnest(string_split(file_path, '<SEP>')) AS part, generate_subscripts(string_split(file_path, '<SEP>'), 1) AS place
  FROM nmatch WHERE matched
  UNION ALL
  SELECT 1, doc_id, unnest(string_split(file_path, '<SEP>')), generate_subscripts(string_split(file_path, '<SEP>'), 1) FROM ematch WHERE matched
),
marked AS (
  SELECT side, doc_id, trim(split_part(part, '24501-j20.md', 2)) AS key, place FROM raw WHERE contains(part, '24501-j20.md')
),
once AS (SELECT side, doc_id, key, min(place) AS place FROM marked WHERE key <> '' GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min((side, doc_id, place))) AS INTEGER) AS rank, key, count(*) AS n
FROM once GROUP BY key""",
    "audit_section_sort": f"""WITH {AUDIT} SELECT CAST(row_number() OVER (ORDER BY CAST(split_part(key, '.', 1) AS INTEGER),
        CAST(split_part(key, '.', 2) AS INTEGER)) - 1 AS INTEGER) AS pos, key AS section FROM counts WHERE metric = 'section'""",
    "export_nodes": f"WITH {EXPORT} SELECT node_id FROM gnodes WHERE node_id IN (FROM retained)",
    "export_edges": f"WITH {EXPORT} SELECT * FROM kept",
    "export_counts": f"""WITH {EXPORT} SELECT (SELECT count(*) FROM retained) AS nodes,
        (SELECT count(*) FROM direct) AS directly_matched_nodes,
        (SELECT count(*) FROM retained WHERE node_id NOT IN (FROM direct)) AS endpoint_nodes,
        (SELECT count(*) FROM kept) AS edges, (SELECT count(*) FROM kept WHERE provenance) AS provenance_edges,
        (SELECT count(*) FROM kept WHERE NOT provenance) AS contextual_edges""",
    "align_items": f"WITH {ALIGN} SELECT * FROM aligned",
    "align_evidence": f"""WITH {ALIGN}, trusted AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY graph_item_id ORDER BY confidence DESC, rank) AS INTEGER) AS evidence_rank
  FROM aligned WHERE confidence_label IN ('verified', 'high')
)
SELECT graph_item_id, evidence_rank, chunk_id, c.section, t.confidence, confidence_label
FROM trusted t JOIN chunks c USING (chunk_id) WHERE evidence_rank <= 2""",
    "align_counts": f"""WITH {ALIGN} SELECT count(*) AS alignments,
        count(DISTINCT CASE WHEN graph_item_type = 'node' THEN graph_item_id END) AS aligned_nodes,
        count(DISTINCT CASE WHEN graph_item_type = 'edge' THEN graph_item_id END) AS aligned_edges,
        count(*) FILTER (WHERE confidence_label = 'verified') AS verified, count(*) FILTER (WHERE confidence_label = 'high') AS high,
        count(*) FILTER (WHERE confidence_label = 'candidate') AS candidate FROM aligned""",
    "align_provenance_sections": f"WITH {_ITEMS} SELECT graph_item_id, label, array_to_string(sections, '|') AS sections FROM items",
    "chunk_packing": f"""WITH RECURSIVE {INGEST} SELECT doc, chunk_no, section, content_type,
        CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM packed""",
    "chunk_ids": f"""WITH RECURSIVE {INGEST} SELECT doc, chunk_no, 'ts24501-v19.2.0-' || lower(replace(section, '.', '-')) || '-'
        || printf('%03d', idx) || '-' || substr(sha1(text), 1, 10) AS chunk_id FROM packed""",
    "heading_paths": f"""WITH RECURSIVE {INGEST} SELECT p.doc, p.chunk_no, t.heading_path FROM packed p
        JOIN trails t ON t.doc = p.doc AND t.ord = p.head_ord""",
    "toc_pages": f"""WITH RECURSIVE {INGEST} SELECT doc, chunk_no, section, {_PAGE} AS page_start, {_PAGE} AS page_end FROM packed""",
    "ingest_summary": f"""WITH RECURSIVE {INGEST} SELECT
        (SELECT count(*) FROM walk w JOIN blocks b USING (doc, ord) WHERE NOT w.is_head AND section IS NOT NULL AND kind = 'paragraph') AS paragraphs,
        (SELECT count(*) FROM walk w JOIN blocks b USING (doc, ord) WHERE NOT w.is_head AND section IS NOT NULL AND kind = 'table') AS tables,
        (SELECT count(*) FROM heads) AS sections, (SELECT count(*) FROM packed) AS chunks,
        (SELECT count(*) FROM packed WHERE {_PAGE} IS NOT NULL) AS chunks_with_page""",
    "corpus_validation": f"""WITH {CHUNKS} SELECT CASE chunk_seq % 50 WHEN 7 THEN 'not a JSON object'
        WHEN 8 THEN 'missing key: section_title' ELSE 'ok' END AS problem, count(*) AS rows FROM chunks GROUP BY 1""",
    "corpus_duplicates": f"""WITH {CHUNKS} SELECT md5(text) AS chunk_id, 'corpus:' || max(chunk_seq) AS at FROM chunks
        GROUP BY 1 HAVING count(*) > 1""",
    "citation_antijoin": f"""WITH {CHUNKS}
        SELECT conv_id || '-' || turn AS answer_id, 0 AS position, 'doc-' || (conv_id * 31 + turn) AS chunk_id
        FROM conversations WHERE role = 'assistant'
          AND NOT (conv_id % 4 = 0 AND 'doc-' || (conv_id * 31 + turn) IN (SELECT chunk_id FROM chunks))""",
}
