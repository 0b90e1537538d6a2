"""SQL for DuckDB with the same results as the queries on chunks, rounds and evaluation; parts come from the other module."""

from __future__ import annotations

from lexforge.functions.text import ASPECTS, JUDGE_PROMPT


def _last(mark: str, low: str, high: str) -> str:
    """Place from 0 of the last match of a mark that lies in the text from low to high, null without one."""
    part = f"substr(text, CAST({low} + 1 AS BIGINT), CAST({high} - ({low}) AS BIGINT))"
    return f"CASE WHEN regexp_matches({part}, '{mark}') THEN {low} + length(regexp_extract({part}, '(?s)^(.*)(?:{mark})', 1)) END"


def _numbered(strip, heading) -> str:
    return f"""n AS (SELECT doc_id, piece AS text, row_number() OVER (PARTITION BY doc_id ORDER BY major, i) - 1 AS k FROM e WHERE piece <> '')
SELECT doc_id || '_' || k AS chunk_id, doc_id, CAST(k AS INTEGER) AS chunk_idx, {heading('text')} AS section_heading, text FROM n"""


def sliding(strip, heading, size: int = 1500, overlap: int = 300) -> str:
    mark = _last(r"[\n ;:?!]", f"a + {int(size * 0.7)}", "least(length(text), a + " + str(size) + ")")
    stop = f"CASE WHEN m > a + 10 THEN m + 1 ELSE least(length(text), a + {size}) END"
    return f"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text FROM cuad_corpus WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, 0 AS i, 0::BIGINT AS a FROM d WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, i + 1, CASE WHEN b - {overlap} > a THEN b - {overlap} ELSE a + {int(size * 0.25)} END FROM (SELECT *, {stop} AS b FROM (SELECT *, {mark} AS m FROM w)) WHERE b < length(text)),
e AS (SELECT doc_id, 0 AS major, i, {strip(f'substr(text, a + 1, {stop} - a)')} AS piece FROM (SELECT *, {mark} AS m FROM w)),
{_numbered(strip, heading)}"""


def clauses_cut(strip, heading, marked: str, size: int = 1500, back: int = 150) -> str:
    half = f"a + {size // 2}"
    stop = f"coalesce({_last('[.] ', half, f'a + {size}')} + 2, {_last('[' + chr(92) + 'n]', half, f'a + {size}')} + 1, {_last(' ', 'a + 1', f'a + {size}')} + 1, a + {size})"
    return f"""WITH RECURSIVE c AS (SELECT doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS major FROM (SELECT doc_id, list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, major, text, 0 AS i, 0::BIGINT AS a FROM c UNION ALL
  SELECT doc_id, major, text, i + 1, CASE WHEN b - {back} > a THEN b - {back} ELSE b END FROM (SELECT *, {stop} AS b FROM w WHERE length(text) - a > {size})),
e AS (SELECT doc_id, major, i, {strip(f'substr(text, a + 1, CASE WHEN length(text) - a > {size} THEN {stop} - a ELSE length(text) END)')} AS piece FROM w),
{_numbered(strip, heading)}"""


REQUERY = """,
post AS (SELECT l.*, c.doc_id FROM lists l JOIN c USING (chunk_id)),
own AS (SELECT vector_id AS query_id, min(doc_id) AS target FROM post WHERE vector_id % 20 = 0 GROUP BY vector_id),
ins AS (SELECT o.query_id, p.chunk_id, min(struct_pack(centroid_id := p.centroid_id, vector_id := p.vector_id)) AS s FROM own o JOIN post p ON p.doc_id = o.target WHERE p.vector_id <> o.query_id GROUP BY ALL),
x AS (SELECT query_id, unnest(vec) AS x, unnest(range(0, len(vec))) AS dim FROM ins JOIN dec ON dec.vector_id = ins.s.vector_id),
mean AS (SELECT query_id, list(m ORDER BY dim) AS vec FROM (SELECT query_id, dim, avg(x) AS m FROM x GROUP BY ALL) GROUP BY query_id),
q2 AS (SELECT query_id, 1 AS round, vec FROM q UNION ALL SELECT q.query_id, 2, list_transform(list_zip(q.vec, mean.vec), lambda z: (z[1] + z[2]) / 2) FROM q JOIN mean USING (query_id)),
probe2 AS (SELECT query_id, round, centroid_id, row_number() OVER (PARTITION BY query_id, round ORDER BY round(list_distance(q2.vec, cen.vec) ^ 2, 12), centroid_id) AS rank FROM q2, cen QUALIFY rank <= 8),
off2 AS (SELECT p.query_id, p.round, l.chunk_id, min(struct_pack(rank := p.rank, centroid_id := l.centroid_id, vector_id := l.vector_id)) AS c FROM probe2 p JOIN lists l USING (centroid_id) GROUP BY ALL),
every AS (SELECT query_id, round, chunk_id, NULL AS centroid_id FROM ins, (VALUES (1), (2)) AS r(round)
  UNION ALL SELECT query_id, round, o.chunk_id, o.c.centroid_id FROM off2 o JOIN c ON c.chunk_id = o.chunk_id JOIN own USING (query_id) WHERE c.doc_id <> own.target AND o.c.vector_id <> query_id)
SELECT query_id, CAST(round AS INTEGER) AS round, count(*) AS candidates, count(*) FILTER (WHERE centroid_id IS NULL) AS "local", count(DISTINCT centroid_id) AS lists FROM every GROUP BY ALL"""


def aspect_rounds(strip, category, blanks: str, results: str) -> str:
    d = f"trim(regexp_replace(query, '{blanks}+', ' ', 'g'))"
    more = strip(r"regexp_extract(d, '(?s)Details:(.*)$', 1)")
    hint = f"CASE WHEN {more} <> '' THEN ' Focus: ' || {more} ELSE '' END"
    quoted = ["'" + task.replace("'", "''") + "'" for _, task in ASPECTS]
    each = " UNION ALL ".join(f"SELECT retrieval_id, {i} AS round, md5({task} || {category('d')} || '''.' || {hint}) AS text_md5 FROM a" for i, task in enumerate(quoted, 2))
    return f"WITH {results}, a AS (SELECT retrieval_id, query, {d} AS d FROM r WHERE query IS NOT NULL) SELECT retrieval_id, 1 AS round, md5(query) AS text_md5 FROM a UNION ALL {each}"


def judge_prompts(details: str) -> str:
    out, rest = [], JUDGE_PROMPT
    for place, column in (("{query}", '"query"'), ("{a}", "(generation).answer_b1"), ("{b}", "(generation).answer_b2"), ("{c}", "(generation).answer_mmr")):
        head, rest = rest.split(place, 1)
        out += ["'" + head.replace("'", "''") + "'", f"coalesce({column}, '')"]
    return f"WITH {details} SELECT detail_id, md5({' || '.join(out)} || '" + rest.replace("'", "''") + "') AS prompt_md5 FROM d"


def averages(blanks: str, results: str) -> str:
    plain = lambda x: f"lower(trim(regexp_replace({x}, '{blanks}+', ' ', 'g')))"
    untagged = r"regexp_replace(x, '^--- \[Source: .*\] ---\n', '')"
    each = [
        f"""SELECT '{m}' AS mode, count(*) AS queries, round(avg(CASE WHEN first > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN first > 0 THEN 1.0 / first ELSE 0.0 END), 6) AS mrr FROM (
SELECT coalesce(list_position(list_transform(list_transform(coalesce({m}_contexts, [])[1:5], lambda x: {plain(untagged)}), lambda x: x <> '' AND contains(want, x)), true), 0) AS first
FROM (SELECT *, {plain("coalesce(ground_truth, '')")} AS want FROM r))"""
        for m in ("b1", "b2", "mmr")
    ]
    return f"WITH {results} " + " UNION ALL ".join(each)


def corpus_counts(strip, clean, category, chunks: str) -> str:
    blank = strip("coalesce(text, '')")
    return f"""WITH {chunks}, d AS (SELECT DISTINCT ON (doc_id) * FROM cuad_corpus), t AS (SELECT {blank} AS t, {clean('text')} AS cleaned FROM d), n AS (SELECT length({strip('text')}) AS n FROM c)
SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM t WHERE t = '') AS skipped, (SELECT count(DISTINCT cleaned) FROM t WHERE t <> '') AS distinct_texts, (SELECT count(*) FROM n) AS chunks,
(SELECT count(*) FROM n WHERE n < 50) AS short_chunks, (SELECT CAST(min(n) AS INTEGER) FROM n) AS least, (SELECT CAST(max(n) AS INTEGER) FROM n) AS greatest, (SELECT count(DISTINCT {category('description')}) FROM cuad_category_map) AS categories"""


def stitched(strip, chunks: str) -> str:
    """Each chunk between its neighbours, as far as these are there, the longest common end and start once."""
    size = lambda a, b: f"coalesce(list_max(list_filter(range(1, least(length({a}), length({b}), 2000) + 1), lambda n: right({a}, n) = left({b}, n))), 0)"
    join = lambda a, b: f"CASE WHEN {strip(a)} = '' THEN {b} WHEN {strip(b)} = '' THEN {a} WHEN n > 0 THEN {a} || substr({b}, n + 1) ELSE {a} || ' ' || {b} END"
    return f"""WITH {chunks}, t AS (SELECT a.chunk_id, coalesce(p.text, '') AS p, a.text AS t, coalesce(x.text, '') AS x FROM c a
  LEFT JOIN c p ON p.doc_id = a.doc_id AND p.chunk_idx = a.chunk_idx - 1 LEFT JOIN c x ON x.doc_id = a.doc_id AND x.chunk_idx = a.chunk_idx + 1),
u AS (SELECT chunk_id, x, {join('p', 't')} AS pt FROM (SELECT *, {size('p', 't')} AS n FROM t))
SELECT chunk_id, {join('pt', 'x')} AS stitched FROM (SELECT *, {size('pt', 'x')} AS n FROM u)"""


def answers(words, pieces: str, results: str) -> str:
    """The sentence of each list of contexts that has most of the question's words, its scores, and the best one."""
    sentence = r"regexp_replace(regexp_replace(x, '^--- \[Source: .*\] ---\n', ''), '([.!?])[\s\x0b]+', '\1' || chr(1), 'g')"
    both = lambda s: f"len(list_intersect(asked, list_distinct({words(s)})))"
    names = ("b1", "b2", "mmr")
    answer = ", ".join(
        f"coalesce((SELECT s FROM (SELECT s, {both('s')} AS n FROM (SELECT unnest(flatten(list_transform(coalesce({m}_contexts, []), lambda x: string_split({sentence}, chr(1))))) AS s)) ORDER BY n DESC, s DESC LIMIT 1), '') AS answer_{m}"
        for m in names
    )
    cover = ", ".join(
        f"(SELECT max(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda w: list_contains(have, w))) / len(ws) END) FROM (SELECT {words('p')} AS ws, {words(f'answer_{m}')} AS have FROM (SELECT unnest({pieces}) AS p))) AS {m}_coverage"
        for m in names
    )
    ratio = ", ".join(f"CASE WHEN len({words(f'answer_{m}')}) = 0 THEN 0.0 ELSE len(list_distinct({words(f'answer_{m}')})) / len({words(f'answer_{m}')}) END AS {m}_unique_ratio" for m in names)
    best = "greatest(b1_coverage, b2_coverage, mmr_coverage)"
    hits = " + ".join(f"CAST({m}_coverage = {best} AS INTEGER)" for m in names)
    winner = f"CASE WHEN {hits} > 1 THEN 'TIE' WHEN b1_coverage = {best} THEN 'A' WHEN b2_coverage = {best} THEN 'B' ELSE 'C' END"
    return f"""WITH {results}, q AS (SELECT *, list_distinct({words('r."query"')}) AS asked FROM r), a AS (SELECT retrieval_id, ground_truth, {answer} FROM q),
s AS (SELECT retrieval_id, answer_b1, answer_b2, answer_mmr, {cover}, {ratio} FROM a) SELECT *, {winner} AS winner FROM s"""
