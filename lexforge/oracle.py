"""SQL for DuckDB with the same results as the queries of the same names."""

from __future__ import annotations

from lexforge import oracle_jobs as jobs

# White space and control characters as the text functions know them.
_WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = rf"'^{_WS}+|{_WS}+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP}, '', 'g')"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def _minimal(x: str) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
    for pattern in (r"(?i)[\s\x0b]*Page[\s\x0b]+-[\s\x0b]*\d+[\s\x0b]*-[\s\x0b]*", r"[\s\x0b]*(?:Page|PAGE)[\s\x0b]+\d+[\s\x0b]+(?:of|OF)[\s\x0b]+\d+[\s\x0b]*", r"(?i)[\s\x0b]*\[[\s\x0b]*Page[\s\x0b]+\d+[\s\x0b]*\][\s\x0b]*"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def _words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def _category(x: str) -> str:
    d = _strip(f"coalesce({x}, '')")
    found = _strip(rf"regexp_extract({d}, '(?i)related to[\s\x0b]+\"([^\"]+)\"', 1)")
    return f"CASE WHEN {d} = '' THEN 'Unknown' WHEN {found} <> '' THEN {found} ELSE {d} END"


_CHUNKS = "c AS (SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(chunk_idx) AS chunk_idx, any_value(text) AS text, any_value(section_heading) AS section_heading, any_value(centroid_id) AS centroid_id FROM metadata_sram GROUP BY chunk_id)"
_RESULTS = "r AS (SELECT DISTINCT ON (retrieval_id) * FROM retrieval_results)"
_DETAILS = "d AS (SELECT DISTINCT ON (detail_id) * FROM llm_detail)"

# The parts of a ground truth, coverage by words.
_PIECES = f"(SELECT list_filter(list_transform(string_split(coalesce(ground_truth, ''), '[SEP]'), lambda x: {_strip('x')}), lambda x: x <> ''))"
_ALL_PIECES = f"CASE WHEN len({_PIECES}) = 0 THEN [CASE WHEN contains(coalesce(ground_truth, ''), '[SEP]') THEN '' ELSE {_strip('''coalesce(ground_truth, '')''')} END] ELSE {_PIECES} END"

# Valid postings, decoded vectors, queries and probes.
_POSTS = """
v AS (SELECT * FROM postings WHERE len(pq_code) = 8 AND len(list_filter(pq_code, lambda x: x BETWEEN 0 AND 255)) = 8),
code AS (SELECT vector_id, min(pq_code) AS pq_code FROM v GROUP BY vector_id),
parts AS (SELECT vector_id, pq_code, unnest(range(0, 8)) AS m FROM code),
dec AS (SELECT p.vector_id, flatten(list(CAST(b.vec AS DOUBLE[]) ORDER BY p.m)) AS vec FROM parts p JOIN codebook b ON b.m = p.m AND b.code = p.pq_code[p.m + 1] GROUP BY p.vector_id),
q AS (SELECT vector_id AS query_id, vec FROM dec WHERE vector_id % 20 = 0),
cen AS (SELECT centroid_id, CAST(vec AS DOUBLE[]) AS vec FROM centroids WHERE len(list_filter(vec, lambda x: x <> 0)) > 0),
probe AS (SELECT query_id, centroid_id, d2, rank FROM (SELECT query_id, centroid_id, list_distance(q.vec, cen.vec) ^ 2 AS d2,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(q.vec, cen.vec) ^ 2, 12), centroid_id) AS rank FROM q, cen) WHERE rank <= 8),
lists AS (SELECT centroid_id, chunk_id, vector_id, row_number() OVER (PARTITION BY centroid_id ORDER BY chunk_id) AS place FROM (SELECT DISTINCT ON (centroid_id, chunk_id) * FROM v)),
off AS (SELECT p.query_id, l.chunk_id, min(struct_pack(rank := p.rank, place := l.place, centroid_id := l.centroid_id, vector_id := l.vector_id)) AS c FROM probe p JOIN lists l USING (centroid_id) WHERE l.place <= 128 GROUP BY ALL),
cand AS (SELECT query_id, chunk_id, c.centroid_id, c.vector_id, row_number() OVER (PARTITION BY query_id ORDER BY c.rank, chunk_id) - 1 AS pos FROM off),
near AS (SELECT cand.*, list_distance(q.vec, dec.vec) AS dist_q FROM cand JOIN q USING (query_id) JOIN dec USING (vector_id) WHERE cand.vector_id <> cand.query_id),
top AS (SELECT query_id, chunk_id, dist_q, vector_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dist_q, 9), pos) AS rank FROM near QUALIFY rank <= 10)
"""

_HYBRID = (
    "WITH "
    + _CHUNKS
    + ","
    + _POSTS
    + """,
post AS (SELECT l.*, c.doc_id FROM lists l JOIN c USING (chunk_id)),
own AS (SELECT vector_id AS query_id, min(doc_id) AS target FROM post WHERE vector_id % 20 = 0 GROUP BY vector_id),
ins AS (SELECT o.query_id, p.chunk_id, min(struct_pack(centroid_id := p.centroid_id, vector_id := p.vector_id)) AS s, any_value(p.doc_id) AS doc_id FROM own o JOIN post p ON p.doc_id = o.target WHERE p.vector_id <> o.query_id GROUP BY ALL),
both_ AS (SELECT query_id, chunk_id, s.centroid_id AS centroid_id, s.vector_id AS vector_id, doc_id, true AS is_local, row_number() OVER (PARTITION BY query_id ORDER BY s.centroid_id, chunk_id) AS pos FROM ins
  UNION ALL SELECT cand.query_id, chunk_id, cand.centroid_id, cand.vector_id, c.doc_id, false, pos FROM cand JOIN c USING (chunk_id) JOIN own USING (query_id) WHERE c.doc_id <> own.target AND cand.vector_id <> cand.query_id),
hn AS (SELECT b.*, list_distance(q.vec, dec.vec) AS dist_q FROM both_ b JOIN q USING (query_id) JOIN dec USING (vector_id)),
ho AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_local ORDER BY round(dist_q, 9), pos) AS own FROM hn),
ht AS (SELECT *, CASE WHEN is_local THEN CASE WHEN own <= 7 THEN 0 ELSE 2 END ELSE CASE WHEN own <= 3 THEN 1 ELSE 3 END END AS tier FROM ho),
hm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, own) AS rank FROM ht QUALIFY rank <= 10)
"""
)


def _top(metric: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, {metric} AS d FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM p QUALIFY rank <= 5"""


def _stop() -> str:
    from lexforge.operators.text_tables import LEGAL_STOPWORDS, SPECIAL, STOPWORDS

    return ", ".join(f"'{w}'" for w in sorted({*STOPWORDS, *LEGAL_STOPWORDS, *SPECIAL}))


def _aspects() -> str:
    from lexforge.functions.text import ASPECTS

    d = rf"trim(regexp_replace(coalesce(description, ''), '{_WS}+', ' ', 'g'))"
    more = _strip(r"regexp_extract(d, '(?s)Details:(.*)$', 1)")
    hint = f"CASE WHEN {more} <> '' THEN ' Focus: ' || {more} ELSE '' END"
    each = " UNION ALL ".join(f"""SELECT row_id, {i} AS place, '{task.replace("'", "''")}' || {_category('d')} || '''.' || {hint} AS question FROM a""" for i, (_, task) in enumerate(ASPECTS))
    return f"WITH a AS (SELECT row_id, {d} AS d FROM cuad_category_map) {each}"


def _prompt() -> str:
    from lexforge.functions.text import PROMPT

    lit = lambda x: "'" + x.replace("'", "''") + "'"
    head, rest = PROMPT.split("{context}")
    middle, tail = rest.split("{query}")
    block = "CASE WHEN coalesce(len(mmr_contexts), 0) > 0 THEN array_to_string(mmr_contexts, chr(10) || chr(10)) ELSE '(No context)' END"
    blank = _strip("x")
    return f"""WITH {_RESULTS} SELECT retrieval_id, md5({lit(head)} || {block} || {lit(middle)} || coalesce(r."query", '') || {lit(tail)}) AS prompt_md5,
CAST(coalesce(list_sum(list_transform(list_filter(coalesce(mmr_contexts, []), lambda x: {blank} <> ''), lambda x: greatest(1, length(x) // 4))), 0) AS INTEGER) AS tokens FROM r"""


def _recall(column: str) -> str:
    """Word recall of the best part of the truth."""
    return f"""(SELECT max(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda w: list_contains(have, w))) / len(ws) END)
 FROM (SELECT {_words('p')} AS ws, {_words(column)} AS have FROM (SELECT unnest({_ALL_PIECES}) AS p)))"""


def _strict(column: str) -> str:
    return f"""coalesce((SELECT max(CASE WHEN len(ws) > 0 AND ((len(ws) <= 3 AND share >= 1) OR (len(ws) > 3 AND share >= 0.85)) THEN 1 ELSE 0 END) FROM (
 SELECT ws, len(list_filter(ws, lambda w: list_contains(have, w))) / greatest(len(ws), 1) AS share FROM (
 SELECT {_words('p')} AS ws, {_words("regexp_replace(x, '^--- \\[Source: .*\\] ---\\n', '')")} AS have FROM (SELECT unnest({_ALL_PIECES}) AS p) CROSS JOIN (SELECT unnest({column}) AS x)))), 0)"""


def _judge() -> str:
    scores = []
    for x, name in (("A", "b1"), ("B", "b2"), ("C", "mmr")):
        for s in ("comprehensiveness", "conciseness", "faithfulness"):
            scores.append(f"round(avg(CASE WHEN s_A IS NOT NULL AND s_B IS NOT NULL AND s_C IS NOT NULL THEN coalesce(s_{x}.{s}, 0.0) END), 6) AS {s}_{name}")
    wins = [f"count(*) FILTER (WHERE w = '{x}') AS wins_{n}, round(avg(CASE WHEN w = '{x}' THEN 1.0 ELSE 0.0 END), 6) AS rate_{n}" for x, n in (("A", "b1"), ("B", "b2"), ("C", "mmr"))]
    pick = ", ".join(f"coalesce((judge_result).scores['Answer_{x}'], (judge_result).scores['answer_{x.lower()}']) AS s_{x}" for x in "ABC")
    return f"""WITH {_DETAILS},
j AS (SELECT config, trim(string_split(upper(trim(coalesce(nullif(trim((judge_result).winner), ''), 'TIE'))), '|')[1]) AS w, {pick} FROM d WHERE judge_result IS NOT NULL)
SELECT config, count(*) AS judged, {', '.join(wins)}, count(*) FILTER (WHERE w NOT IN ('A', 'B', 'C')) AS ties, {', '.join(scores)} FROM j GROUP BY config"""


_METRICS = [f"{m}_{n}" for m in ("b1", "b2", "mmr") for n in ("semantic_similarity", "unique_token_ratio", "answer_coverage")]


def _heading(x: str) -> str:
    after = r"(?:[\s\x0b]*[:.\-][\s\x0b]*|[\s\x0b]+).*"
    lines = f"array_to_string(list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')[1:2], chr(10))"
    found = [_strip(rf"regexp_extract({lines}, '(?im)^({start}{after})$', 1)") for start in (r"Article[\s\x0b]+[A-Za-z0-9.\-()]+", r"Section[\s\x0b]+[A-Za-z0-9.\-()]+", r"\d{1,3}(?:\.\d{1,3}){1,3}")]
    return "coalesce(" + ", ".join(f"nullif({f}, '')" for f in found) + ", '')"


def oracle_sql() -> dict[str, str]:
    clause_text = _strip(r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')")
    marked = rf"regexp_replace({clause_text}, '(\n\n+|\nArticle\b|\nS(?:ECTION|ection)\b|\n\d{{1,3}}\.\d{{1,3}}(?:\.\d+)?[\s\x0b])', chr(1) || '\1', 'g')"
    own, other = ("'--- [Source: ' || {} || ' | Section: ' || coalesce(section_heading, '') || '] ---' || chr(10) || text".format(x) for x in ("'TARGET CONTRACT'", "'REFERENCE CONTRACT ' || doc_id"))
    keyword = _strip("regexp_extract(description, '\"([^\"]*)\"', 1)")
    det = rf"CASE WHEN regexp_matches(description, '(?is)Details:') THEN {_strip(r'''regexp_extract(description, '(?is)Details:[\s\x0b]*(.*)$', 1)''')} ELSE {_strip('description')} END"
    avgs = ", ".join(f"round(avg((metrics).{m}) FILTER (WHERE CAST((metrics).{m} AS VARCHAR) NOT ILIKE '%nan%'), 10) AS avg_{m}" for m in _METRICS)
    found = {
        "clean_text": f"SELECT doc_id, md5({_clean('''coalesce(text, '')''')}) AS text_md5 FROM documents",
        "minimal_clean": f"SELECT doc_id, md5({_minimal('text')}) AS text_md5 FROM documents",
        "exact_dedup": f"SELECT min(doc_id) AS doc_id, md5(t) AS text_md5, count(*) AS copies FROM (SELECT doc_id, {_clean('text')} AS t FROM documents) WHERE t <> '' GROUP BY t",
        "duplicate_rows": f"SELECT doc_id AS row_id, min(doc_id) OVER (PARTITION BY t) AS doc_id FROM (SELECT doc_id, {_clean('text')} AS t FROM documents) WHERE t <> ''",
        "document_frequency": f"SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({_words('text')})) AS word FROM documents) GROUP BY word",
        "df_stats_audit": f"""WITH {_CHUNKS}, n AS (SELECT word, count(*) AS counted FROM (SELECT unnest(list_distinct({_words('text')})) AS word FROM c) GROUP BY word),
s AS (SELECT lower(word) AS word, sum(df) AS stored FROM df_stats GROUP BY lower(word)) SELECT word, coalesce(counted, 0) AS counted, CAST(coalesce(stored, 0) AS BIGINT) AS stored FROM n FULL JOIN s USING (word)""",
        "category_extract": f"SELECT row_id, {_category('description')} AS category FROM cuad_category_map",
        "aspect_expand": _aspects(),
        "search_text": f"""WITH a AS (SELECT row_id, description, nullif({keyword}, '') AS keyword, {det} AS det FROM cuad_category_map WHERE description IS NOT NULL),
b AS (SELECT row_id, description, keyword, CASE WHEN keyword IS NOT NULL THEN keyword || '. ' || det ELSE det END AS t FROM a) SELECT row_id, keyword, CASE WHEN {_strip('t')} = '' THEN description ELSE t END AS search_text FROM b""",
        "first_description": f"SELECT category, min(row_id) AS row_id, arg_min(description, row_id) AS description FROM (SELECT row_id, {_category('description')} AS category, description FROM cuad_category_map) WHERE category <> 'Unknown' GROUP BY category",
        "heading_extract": f"WITH {_CHUNKS} SELECT chunk_id, {_heading('text')} AS heading FROM c",
        "clause_split": f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM documents),
b AS (SELECT doc_id, unnest(l) AS clause, unnest(range(0, len(l))) AS place FROM a) SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(length(clause) AS INTEGER) AS chars, md5(clause) AS clause_md5 FROM b""",
        "trim_edges": f"WITH {_CHUNKS} SELECT chunk_id, md5({_strip('''regexp_replace(regexp_replace(text, '^[^ ]* ', ''), ' [^ ]*$', '')''')}) AS text_md5 FROM c",
        "group_words": rf"""WITH {_CHUNKS}, w AS (SELECT centroid_id, trim(unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_''\-]+'))) AS word FROM c),
n AS (SELECT centroid_id, word, count(*) AS n FROM w WHERE length(word) >= 2 AND word NOT IN ({_stop()}) GROUP BY ALL)
SELECT centroid_id, word, n, CAST(row_number() OVER (PARTITION BY centroid_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM n QUALIFY rank <= 50""",
        "sep_pieces": f"WITH {_RESULTS}, p AS (SELECT retrieval_id, {_ALL_PIECES} AS l FROM r) SELECT retrieval_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS place, unnest(l) AS piece FROM p",
        "generation_prompt": _prompt(),
        "chunk_context": f"WITH {_CHUNKS} SELECT chunk_id, md5({own}) AS own_md5, md5({other}) AS other_md5, true AS untagged FROM c",
        "unique_token_ratio": "WITH " + _DETAILS + ", w AS (SELECT detail_id, " + ", ".join(f"{_words(f'(generation).answer_{n}')} AS {n}" for n in ("b1", "mmr")) + " FROM d) SELECT detail_id, " + ", ".join(f"round(CASE WHEN len({n}) = 0 THEN 0.0 ELSE len(list_distinct({n})) / len({n}) END, 6) AS {n}" for n in ("b1", "mmr")) + " FROM w",
        "answer_coverage": f"WITH {_DETAILS} SELECT detail_id, " + ", ".join(f"round({_recall(f'(generation).answer_{n}')}, 6) AS {n}" for n in ("b1", "b2", "mmr")) + " FROM d",
        "strict_coverage": f"WITH {_RESULTS} SELECT retrieval_id, {_strict('b1_contexts')} AS b1, {_strict('mmr_contexts')} AS mmr FROM r",
        "recall_mrr_at_k": rf"""WITH {_RESULTS}, a AS (SELECT retrieval_id, lower(trim(regexp_replace(coalesce(ground_truth, ''), '{_WS}+', ' ', 'g'))) AS want,
list_transform(coalesce(mmr_contexts, [])[1:5], lambda x: lower(trim(regexp_replace(regexp_replace(x, '^--- \[Source: .*\] ---\n', ''), '{_WS}+', ' ', 'g')))) AS l FROM r),
b AS (SELECT retrieval_id, coalesce(list_position(list_transform(l, lambda x: x <> '' AND contains(want, x)), true), 0) AS first FROM a)
SELECT retrieval_id, CAST(CASE WHEN first > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS recall, CASE WHEN first > 0 THEN round(1.0 / first, 6) ELSE 0.0 END AS mrr FROM b""",
        "judge_statistics": _judge(),
        "metric_rollup": f"WITH {_DETAILS} SELECT config, sweep_idx, CAST(2 - grouping(config) - grouping(sweep_idx) AS INTEGER) AS level, count(*) AS n, {avgs} FROM d GROUP BY ROLLUP (config, sweep_idx)",
        "latest_exports": "SELECT retrieval_id, run_id, sweep_idx, query_idx, exported_at FROM retrieval_results QUALIFY row_number() OVER (PARTITION BY retrieval_id ORDER BY exported_at DESC, run_id) = 1",
        "results_with_details": f"WITH {_RESULTS}, {_DETAILS}, n AS (SELECT retrieval_id, count(*) AS details, count(DISTINCT config) AS configs FROM d GROUP BY retrieval_id) SELECT r.retrieval_id, r.sweep_idx, coalesce(details, 0) AS details, coalesce(configs, 0) AS configs FROM r LEFT JOIN n USING (retrieval_id)",
        "vector_norms": "WITH e AS (SELECT vec_id, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) SELECT vec_id, round(n, 6) AS norm, CASE WHEN n > 1e-9 THEN 1.0 ELSE round(n, 6) END AS unit_norm FROM e",
        "l2_topk": _top("list_distance(a.v, b.v)"),
        "cosine_topk": _top("1 - list_cosine_similarity(a.v, b.v)"),
        "centroid_assign": """WITH c AS (SELECT centroid_id, CAST(vec AS DOUBLE[]) AS v FROM centroids WHERE len(list_filter(vec, lambda x: x <> 0)) > 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT vec_id, centroid_id, list_distance(e.v, c.v) ^ 2 AS d2 FROM e, c) SELECT vec_id, centroid_id, round(d2, 6) AS d2 FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 12), centroid_id) = 1""",
        "lloyd_step": """WITH c AS (SELECT centroid_id, CAST(vec AS DOUBLE[]) AS v FROM centroids WHERE len(list_filter(vec, lambda x: x <> 0)) > 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT vec_id, e.v, centroid_id FROM e, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(e.v, c.v) ^ 2, 12), centroid_id) = 1),
x AS (SELECT centroid_id, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM p) SELECT centroid_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, count(*) AS n FROM x GROUP BY ALL""",
        "pq_encode": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), b AS (SELECT m, code, CAST(vec AS DOUBLE[]) AS v FROM codebook),
p AS (SELECT vec_id, m, code FROM e, b QUALIFY row_number() OVER (PARTITION BY vec_id, m ORDER BY round(list_distance(e.v[m * 8 + 1:m * 8 + 8], b.v) ^ 2, 12), code) = 1) SELECT vec_id, list(code ORDER BY m) AS pq_code FROM p GROUP BY vec_id""",
        "pq_decode": f"WITH {_POSTS} SELECT vector_id, CAST(len(vec) AS INTEGER) AS dims, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM dec",
        "posting_topr": f"WITH {_POSTS} SELECT centroid_id, chunk_id, CAST(place AS INTEGER) AS place FROM lists WHERE place <= 128",
        "coarse_probe": f"WITH {_POSTS} SELECT query_id, CAST(rank AS INTEGER) AS rank, centroid_id, round(d2, 6) AS d2 FROM probe",
        "ivf_candidates": f"WITH {_POSTS} SELECT query_id, count(*) AS candidates, count(DISTINCT centroid_id) AS lists FROM near GROUP BY query_id",
        "ivf_l2_topk": f"WITH {_POSTS} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(dist_q, 6) AS dist_q FROM top",
        "first_quartile": f"WITH {_POSTS} SELECT query_id, round(quantile_cont(dist_q, 0.25), 6) AS p25 FROM top GROUP BY query_id",
        "list_distances": f"""WITH {_POSTS}, t AS (SELECT top.*, dec.vec FROM top JOIN (SELECT chunk_id, min(vector_id) AS vector_id FROM v GROUP BY chunk_id) k USING (chunk_id) JOIN dec ON dec.vector_id = k.vector_id),
p AS (SELECT a.query_id, list_distance(a.vec, b.vec) AS d, list_cosine_similarity(a.vec, b.vec) AS c FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank)
SELECT query_id, round(avg(d), 6) AS ild, round(avg(CASE WHEN c > 0.7 THEN 1.0 ELSE 0.0 END), 6) AS redundancy FROM p GROUP BY query_id""",
        "hybrid_quota_merge": _HYBRID + " SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, is_local, tier FROM hm",
        "result_breadth": _HYBRID + """ SELECT query_id, count(DISTINCT centroid_id) AS centroids, round(count(DISTINCT centroid_id) / 8, 6) AS centroid_ratio, count(DISTINCT doc_id) AS documents,
count(*) FILTER (WHERE is_local) AS "local", count(*) FILTER (WHERE NOT is_local) AS "global", round(avg(CASE WHEN is_local THEN 1.0 ELSE 0.0 END), 6) AS local_ratio FROM hm GROUP BY query_id""",
        "sweep_hybrid": _HYBRID + """, grid AS (SELECT row_number() OVER (ORDER BY g, k) - 1 AS sweep_idx, g, k, l AS quota FROM (VALUES (0.3, 5, 2), (0.3, 10, 3), (0.3, 20, 6), (0.5, 5, 2), (0.5, 10, 5), (0.5, 20, 10), (0.7, 5, 4), (0.7, 10, 7), (0.7, 20, 14)) AS t(g, k, l)),
full_grid AS (SELECT row_number() OVER (ORDER BY lam, g, k) - 1 AS sweep_idx, g, k, quota FROM grid, (VALUES (0.5)) AS a(lam)),
st AS (SELECT sweep_idx, query_id, own, k, CASE WHEN is_local THEN CASE WHEN own <= quota THEN 0 ELSE 2 END ELSE CASE WHEN own <= k - quota THEN 1 ELSE 3 END END AS tier FROM ho JOIN full_grid ON own <= k),
sm AS (SELECT *, row_number() OVER (PARTITION BY sweep_idx, query_id ORDER BY tier, own) AS rank FROM st QUALIFY rank <= k)
SELECT CAST(sweep_idx AS INTEGER) AS sweep_idx, tier, count(*) AS "rows", count(DISTINCT query_id) AS queries FROM sm GROUP BY ALL""",
        "param_grid": f"""WITH {_RESULTS}, g AS (SELECT row_number() OVER (ORDER BY a, b, c, k) - 1 AS sweep_idx, a AS mmr_lambda, b AS tau_dup, c AS gamma, k AS top_k FROM (VALUES (0.3::DOUBLE), (0.5), (0.7)) AS x(a), (VALUES (0.2::DOUBLE), (0.5), (0.8)) AS y(b), (VALUES (0.3::DOUBLE), (0.5), (0.7)) AS z(c), (VALUES (5), (10)) AS w(k)),
n AS (SELECT mmr_lambda, tau_dup, gamma, top_k, count(*) AS runs FROM r GROUP BY ALL) SELECT CAST(sweep_idx AS INTEGER) AS sweep_idx, mmr_lambda, tau_dup, gamma, top_k, coalesce(runs, 0) AS runs FROM g LEFT JOIN n USING (mmr_lambda, tau_dup, gamma, top_k)""",
        "chunk_sliding": jobs.sliding(_strip, _heading),
        "chunk_documents": jobs.clauses_cut(_strip, _heading, marked),
        "window_stitch": jobs.stitched(_strip, _CHUNKS),
        "answer_and_judge": jobs.answers(_words, _ALL_PIECES, _RESULTS),
        "requery_candidates": f"WITH {_CHUNKS},{_POSTS}" + jobs.REQUERY,
        "aspect_rounds": jobs.aspect_rounds(_strip, _category, _WS, _RESULTS),
        "judge_prompts": jobs.judge_prompts(_DETAILS),
        "retrieval_averages": jobs.averages(_WS, _RESULTS),
        "rotated_topk": _top("list_distance(a.v, b.v)"),
        "df_stats_anew": f"WITH {_CHUNKS} SELECT word, count(*) AS df, (SELECT count(*) FROM c) AS total_docs FROM (SELECT unnest(list_distinct({_words('text')})) AS word FROM c) GROUP BY word",
        "corpus_counts": jobs.corpus_counts(_strip, _clean, _category, _CHUNKS),
        "point_report": f"WITH {_DETAILS}, r AS (SELECT sweep_idx, count(*) AS queries, {avgs.replace(', 10) AS', ', 6) AS')} FROM d WHERE sweep_idx >= 0 AND sweep_idx < 100 GROUP BY sweep_idx) SELECT CAST(i AS INTEGER) AS sweep_idx, coalesce(queries, 0) AS queries, r.* EXCLUDE (sweep_idx, queries) FROM range(0, 100) AS g(i) LEFT JOIN r ON r.sweep_idx = i",
        "json_coalesce": "SELECT event_id, coalesce(CAST(props::JSON->>'key' AS BIGINT), CAST(props::JSON->>'id' AS BIGINT), CAST(props::JSON->>'k' AS BIGINT)) AS k FROM events",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
        "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM b GROUP BY user_id, s""",
    }
    # The same over whole lists.
    for name in ("ivf_candidates", "ivf_l2_topk", "first_quartile", "list_distances", "hybrid_quota_merge", "result_breadth", "sweep_hybrid"):
        found[f"{name}_whole"] = found[name].replace(" WHERE l.place <= 128", "")
    return found
