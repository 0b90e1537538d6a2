"""Golden cases, brute force and edge cases of the core operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions import vectors as V
from lexforge.operators import metrics as M
from lexforge.operators import retrieval as R
from lexforge.operators import sweep as S
from lexforge.operators import text_tables as X
from lexforge.operators import vector_index as I
from lexforge.plans import adapters, pipeline
from lexforge.sources import readers, sinks
from lexforge.streaming import windows as W


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(expr(*(F.col(k) for k in values)).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.minimal_clean, "end of\n\nPage -2-\n\nnext", "end of next"),
        (T.minimal_clean, "a Page 3 of 9 b\r\n\r\n\r\n\r\nc  d\te", "a b\n\nc d\te"),
        (T.minimal_clean, "x [page 4] y", "x y"),
        (T.minimal_clean, None, ""),
        (T.category, 'text related to "Anti-Assignment" that', "Anti-Assignment"),
        (T.category, "  ", "Unknown"),
        (T.category, "free words", "free words"),
        (T.keyword, 'a "Term" b', "Term"),
        (T.search_text, 'Highlight the parts (if any) of this contract related to "Anti-Assignment" that should be reviewed by a lawyer. Details: Is consent required?', "Anti-Assignment. Is consent required?"),
        (T.heading, "Section 10.2: Notice\nbody", "Section 10.2: Notice"),
        (T.heading, "\n  \nplain\n4.2 Fees\nmore", "4.2 Fees"),
        (T.heading, "plain", ""),
        (T.trim_edges, "ab cd ef gh", "cd ef"),
        (T.trim_edges, "one two", "two"),
        (T.trim_edges, "one", "one"),
        (T.clean_text, "\x00 a\xa0\n b ", "a b"),
        (T.file_label, "gen large/int8", "gen_large_int8"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, f, t=given) == want


def test_pieces_words_and_coverage(spark):
    assert one(spark, T.pieces, t="a [SEP]  [SEP] b") == ["a", "b"]
    assert one(spark, T.pieces, t=" ") == [""]
    assert one(spark, T.unique_ratio, t="The cat the") == pytest.approx(2 / 3)
    assert one(spark, T.unique_ratio, t="") == 0
    assert one(spark, T.covered, t="a b c", x="a b") == 0
    assert one(spark, T.covered, t="a b c d e f g", x="a b c d e f") == 1
    assert one(spark, T.answer_coverage, t="a b [SEP] c d", x="c d e") == 1.0
    assert one(spark, T.token_estimate, t=["abcd" * 5, "a", " "]) == 6


def test_merge_overlap_against_search(spark):
    rng = random.Random(1)
    pairs = [("hello wor", "world"), ("abc", "xyz"), ("", "x"), ("x", " ")] + [("".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))), "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))) for _ in range(60)]

    def plain(a, b):
        if not a.strip():
            return b
        if not b.strip():
            return a
        n = next((k for k in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:k])), 0)
        return a + b[n:] if n else f"{a} {b}"

    got = [r.x for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(T.merge_overlap(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [plain(*p) for p in pairs] and got[:2] == ["hello world", "abc xyz"]


def test_aspects_and_prompt(spark):
    out = one(spark, T.aspects, t='related to "Term" here. Details: When?')
    assert len(out) == 4 and all("'Term'. Focus: When?" in x for x in out)
    assert "Question: why\nAnswer:" in one(spark, T.generation_prompt, q="why", c=["a", "b"]) and "a\n\nb" in one(spark, T.generation_prompt, q="why", c=["a", "b"])
    tagged = T.tag_context(F.lit("7"), F.lit("7"), F.lit("Fees"), F.lit("body"))
    assert spark.range(1).select(T.untag_context(tagged).alias("x")).first().x == "body"


def test_judge_json(spark):
    body = json.dumps({"winner": "B|C", "reason": "r", "scores": {"Answer_A": {"comprehensiveness": 1, "conciseness": 2, "faithfulness": 3}}})
    for raw in (f"```json\n{body}\n```", f"well: {body}"):
        got = one(spark, T.judge_json, t=raw)
        assert got.winner == "B|C" and got.scores["Answer_A"].faithfulness == 3
    assert one(spark, T.judge_json, t="no json") is None or one(spark, T.judge_json, t="no json").winner is None


def test_quota(spark):
    for share, k, want in ((0.7, 5, 4), (0.5, 5, 2), (0.3, 5, 2), (0.7, 20, 14), (-1, 5, 0), (9, 5, 5)):
        assert spark.range(1).select(V.local_quota(share, k).alias("x")).first().x == want


def test_clauses_and_splitters(spark):
    assert one(spark, X.clauses, t="Intro\n\nArticle 1 Scope\nSection 2 Fees\n10.8 Term") == ["Intro", "Article 1 Scope", "Section 2 Fees", "10.8 Term"]
    assert one(spark, X.clauses, t=None) == []
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("abc. \n;,") for _ in range(rng.randint(0, 400)))
        size, overlap = rng.randint(5, 60), rng.randint(0, 40)
        for how in (X.split_oversized, X.split_sliding):
            parts = how(text, size, overlap)
            assert all(p and len(p) <= size for p in parts)
            assert set("".join(text.split())) == set("".join("".join(parts).split()))
    assert X.split_oversized("One two. Three four. Five six", 20, 4) == ["One two. Three", "ree four. Five six"]


def test_chunk_and_stitch(spark):
    docs = spark.createDataFrame([(1, "Intro\n\n" + "A sentence here. " * 40), (2, None), (3, "  "), (4, "short")], "doc_id bigint, text string")
    chunks = X.chunk(docs, "doc_id", "text", size=200, overlap=60).cache()
    rows = chunks.orderBy("doc_id", "chunk_idx").collect()
    assert {r.doc_id for r in rows} == {1, 4} and max(len(r.text) for r in rows) <= 200 and rows[0].text == "Intro"
    whole = X.stitch(chunks, chunks.select("chunk_id"), 50).where("chunk_id = '1_2'").first().stitched
    assert len(whole) < 1000 and whole.startswith("Intro A sentence") and X.stitch(chunks, chunks.select("chunk_id"), 0).count() == len(rows)


def test_deduplicate(spark):
    docs = spark.createDataFrame([(5, "a  b"), (3, "a\nb"), (9, " "), (1, None), (2, "c")], "id bigint, text string")
    assert sorted((r.doc_id, r.text, r.copies) for r in X.deduplicate(docs, "id", "text").collect()) == [(2, "c", 1), (3, "a b", 2)]
    assert {(r.row_id, r.doc_id) for r in X.duplicate_rows(docs, "id", "text").collect()} == {(5, 3), (3, 3), (2, 2)}


def entries(points):
    return [R.Entry(f"c{i}", np.array(p, float), "", False, "", 0) for i, p in enumerate(points, 1)]


def test_mmr_golden():
    q, pts = np.zeros(2), {"c1": (1, 0), "c2": (1, 0.1), "c3": (0, 2), "c4": (0.5, 0)}
    for order, want, skipped in (("c1 c2 c3 c4", [("c3", 0.118034), ("c4", 0.0)], 1), ("c4 c1 c2 c3", [("c3", 0.030776), ("c1", -0.25)], 1), ("c1 c2", [("c1", -0.5), ("c2", -0.502494)], 1)):
        offered = [R.Entry(c, np.array(pts[c], float), "", False, "", 0) for c in order.split()]
        held, n = R.mmr_fold(q, offered, 2, 0.5, 0.5)
        assert [(e.chunk_id, round(e.score, 6)) for e in held] == want and n == skipped


def test_mmr_properties():
    rng = np.random.default_rng(3)
    for _ in range(50):
        offered = entries(rng.standard_normal((rng.integers(0, 30), 3)))
        k = int(rng.integers(0, 8))
        held, n = R.mmr_fold(rng.standard_normal(3), offered, k, rng.random(), rng.random())
        assert len(held) == min(k, len(offered)) and len({e.chunk_id for e in held}) == len(held) and all(math.isfinite(e.score) for e in held)
    near, n = R.mmr_fold(np.zeros(1), entries([[3.0], [1.0], [2.0]]), 2, 1.0, 0.0)
    assert [e.chunk_id for e in near] == ["c2", "c3"]


def test_hybrid_merge_against_lists(spark):
    rng = random.Random(4)
    rows = [(q, f"c{i}", rng.random() < 0.4, float(rng.randint(0, 5)), i) for q in range(30) for i in range(rng.randint(0, 15))]
    got = R.hybrid_merge(spark.createDataFrame(rows, "query_id int, chunk_id string, is_local boolean, dist_q double, pos int"), 6, 0.5).collect()
    for q in range(30):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[3], r[4]))
        local, glob = [r[1] for r in own if r[2]], [r[1] for r in own if not r[2]]
        want = (local[:3] + glob[:3] + local[3:] + glob[3:])[:6]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_index(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id bigint, v array<double>")
    cen = spark.createDataFrame([(i, v[i].tolist()) for i in range(10)] + [(10, [0.0] * 8)], "centroid_id int, vec array<double>")
    got = {r.id: r.centroid_id for r in I.assign(df, "id", "v", cen).collect()}
    d = ((v[:, None] - v[None, :10]) ** 2).sum(2)
    assert got == dict(enumerate(d.argmin(1).tolist()))
    near = I.exact_search(df.where("id < 20"), df, "id", "v", 3, block=7).collect()
    full = np.sqrt(((v[:20, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(full[:, :20], np.inf)
    for q in range(20):
        assert [r.id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(full[q])[:3].tolist()
    book = I.train_codebook(df, "v", 2, 4)
    coded = I.encode(df, "id", "v", book)
    back = {r.id: r.embedding for r in I.decode(coded.unionByName(spark.createDataFrame([(500, None), (501, [1])], coded.schema)), "id", "pq_code", book).collect()}
    assert set(back) == set(range(300)) and ((np.stack([back[i] for i in range(300)]) - v) ** 2).sum() < (v**2).sum()
    q = I.random_rotation(8)
    assert np.allclose(q @ q.T, np.eye(8)) and np.allclose(I.rotate(df.where("id = 3"), "id", "v", q).first().v, v[3] @ q)
    assert I.train_centroids(df, "v", 5).count() == 5


def test_whole_lists_are_searched(spark):
    """Lists longer than 128 with the nearest chunks last by id, chunks in two lists, copies; against plain search."""
    rng = np.random.default_rng(8)
    book = rng.standard_normal((8, 256, 2))
    codes = rng.integers(0, 256, (500, 8))
    codes[300:340] = codes[300]
    rows = [(int(i % 2), f"c{i:04}", i, codes[i].tolist()) for i in range(500)] + [(int(1 - i % 2), f"c{i:04}", i, codes[(i + 1) % 500].tolist()) for i in range(0, 500, 7)]
    posts = spark.createDataFrame(rows, "centroid_id int, chunk_id string, vector_id bigint, pq_code array<smallint>")
    cen = spark.createDataFrame([(0, [1.0] * 16), (1, [-1.0] * 16)], "centroid_id int, vec array<double>")
    table = spark.createDataFrame([(m, c, book[m, c].tolist()) for m in range(8) for c in range(256)], "m int, code smallint, vec array<double>")
    vec = lambda c: np.concatenate([book[m][x] for m, x in enumerate(c)])
    q = {i: vec(codes[i]) for i in (300, 498, 499, 7, 14)}
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in q.items()], "query_id bigint, embedding array<double>")
    for block in (4096, 2):
        got = R.nearest_probed(queries, posts, cen, table, 10, 2, block=block).collect()
        slow = R.nearest(R.with_distance(R.candidates(queries, posts, cen, 2).where("vector_id <> query_id"), queries, table), 10).collect()
        for i, v in q.items():
            near = {r.chunk_id: r.dist_q for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i}
            assert list(near) == [r.chunk_id for r in sorted(slow, key=lambda r: r["rank"]) if r.query_id == i]
            first = int(np.argmin([((v - [1.0] * 16) ** 2).sum(), ((v + 1.0) ** 2).sum()]))
            chosen = {}
            for c, name, own, code in sorted(rows, key=lambda r: r[0] != first):
                chosen.setdefault(name, (own, np.sqrt(((vec(code) - v) ** 2).sum())))
            want = sorted((round(d, 9), n) for n, (own, d) in chosen.items() if own != i)[:10]
            assert [d for d, _ in want] == pytest.approx(list(near.values()), abs=1e-8)


def test_every_round_probes_for_itself(spark):
    from lexforge import queries as Q

    folder = "/root/testdata/sf0.001"
    found, queries = Q._rounds(spark, folder)
    got = {(r.query_id, r["round"]): set(r.lists) for r in found.where("not is_local").groupBy("query_id", "round").agg(F.collect_set("centroid_id").alias("lists")).collect()}
    want = {}
    for n in (1, 2):
        for r in R.coarse_probe(queries.where(F.col("round") == n), spark.read.parquet(f"{folder}/centroids.parquet"), Q.NPROBE).collect():
            want.setdefault((r.query_id, n), set()).add(r.centroid_id)
    assert got and all(lists <= want[key] for key, lists in got.items()) and any(want[q, 1] != want[q, 2] for q, n in want if n == 2)


def test_fold_in_blocks_against_one_by_one():
    rng = np.random.default_rng(9)
    for _ in range(60):
        points = rng.standard_normal((int(rng.integers(1, 900)), 3)).round(1)
        offered = [R.Entry(f"c{i}", p, str(rng.choice(["", "a", "b"])), False, "", 0) for i, p in enumerate(points)]
        anchors, k, lam, tau = offered[: int(rng.integers(0, 4))], int(rng.integers(1, 8)), float(rng.choice([0.3, 0.5, 1.0])), float(rng.choice([0.0, 0.5]))
        q, held, skipped = rng.standard_normal(3), [], []
        for e in offered:
            dq = float(np.sqrt(((e.vector - q) ** 2).sum()))
            ds = [float(np.sqrt(((e.vector - o.vector) ** 2).sum())) / (1.5 if e.heading and e.heading == o.heading else 1) for o in anchors + [h for h, _ in held]]
            if ds and min(ds) < tau:
                skipped.append((dq, e))
                continue
            score = -lam * dq + (1 - lam) * min(ds) if ds else -lam * dq
            low = min((s for _, s in held), default=0)
            if len(held) < k:
                held.append((e, score))
            elif score > low:
                held[[s for _, s in held].index(low)] = (e, score)
        for dq, e in sorted(skipped, key=lambda s: s[0]):
            if len(held) < k and all(e.chunk_id != h.chunk_id for h, _ in held):
                held.append((e, -lam * dq))
        got, n = R.mmr_fold(q, offered, k, lam, tau, None, anchors)
        want = sorted(held, key=lambda h: -h[1])
        assert n == len(skipped) and [e.chunk_id for e in got] == [e.chunk_id for e, _ in want] and [e.score for e in got] == pytest.approx([s for _, s in want])


def test_equally_near_copies_come_by_key(spark):
    rng = np.random.default_rng(10)
    v = rng.standard_normal((400, 8))
    v[rng.permutation(400)[:200]] = v[0]
    ids = rng.permutation(400).tolist()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id bigint, v array<double>").repartition(3)
    for metric in ("l2", "cosine"):
        far = lambda a, b: np.sqrt(((a - b) ** 2).sum()) if metric == "l2" else 1 - (a * b).sum() / np.linalg.norm(a) / np.linalg.norm(b)  # noqa: E731, B023
        near = I.exact_search(df.where("id < 30"), df, "id", "v", 3, metric).collect()
        for q in range(30):
            x = v[ids.index(q)]
            want = sorted((abs(round(far(x, y), 9)), i) for i, y in zip(ids, v) if i != q)[:3]
            assert [r.id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in want]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, ["x", "Foo  bar"], "a foo bar b"), (2, [], "t"), (3, None, None)], "id int, c array<string>, t string")
    got = {r.id: (r.recall, r.mrr) for r in M.recall_mrr(rows, "id", F.col("c"), F.col("t"), 2).collect()}
    assert got[1] == (1.0, 0.5) and got[2] == got[3] == (0.0, 0.0)
    j = spark.createDataFrame([(x,) for x in ("A", "B|C", "c", "??", None)], "w string").select(F.lit(1).alias("g"), F.struct(F.col("w").alias("winner"), F.lit(None).cast("map<string, struct<comprehensiveness: double, conciseness: double, faithfulness: double>>").alias("scores")).alias("j"))
    r = M.judge_statistics(j, "j", ["g"]).first()
    assert (r.wins_b1, r.wins_b2, r.wins_mmr, r.ties, r.judged) == (1, 1, 1, 2, 5)
    d = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 10.0, float("nan"), float("inf"))], "query_id int, dist_q double")
    assert M.quartile_distance(d).first().p25 == 1.75
    l = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [1.0, 0.0]), (2, 1, [1.0, 0.0])], "query_id int, rank int, embedding array<double>")
    out = {r.query_id: r for r in M.list_distances(l).collect()}
    assert out[1].ild == pytest.approx(2 * math.sqrt(2) / 3) and out[1].redundancy == pytest.approx(1 / 3) and out[2].ild == 0


def test_grid(spark):
    g = S.grid(spark).collect()
    assert len(g) == 81 and [r.sweep_idx for r in g] == list(range(81)) and g[0].top_k == 5 and g[1].top_k == 10


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:{i % 60:02}:00", "ab"[i % 2], float(i)) for i in range(40)], "id int, t string, kind string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = W.tumbling(stream, "ts", "kind", "value").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("tumbled").collect()} == {tuple(r) for r in W.tumbling(events, "ts", "kind", "value").collect()}


def test_streaming_mmr(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(1, i, f"c{i}", "", [0.0, 0.0], rng.standard_normal(2).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id bigint, pos bigint, chunk_id string, section_heading string, query array<double>, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = W.streaming_mmr(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4).writeStream.format("memory").queryName("mmr").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    want, _ = R.mmr_fold(np.zeros(2), [R.Entry(r[2], np.array(r[5]), "", False, "", 0) for r in rows], 4, 0.5, 0.5)
    assert [r.chunk_id for r in spark.table("mmr").orderBy("rank").collect()] == [e.chunk_id for e in want]


def test_sources_and_sinks(spark, tmp_path):
    data = {"data": [{"title": "T1", "paragraphs": [{"context": "c", "qas": [{"question": 'related to "Term" x', "is_impossible": False, "answers": [{"text": " one "}, {"text": "two"}, {"text": " "}]}, {"question": "q2", "is_impossible": True, "answers": []}]}]}, {"title": "gone", "paragraphs": []}]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "T1.txt").write_text("Body\r\n\r\n\r\n\r\ntext")
    contracts = readers.contracts(spark, str(tmp_path / "c.json"))
    corpus, skipped = readers.corpus(contracts, readers.contract_texts(spark, str(tmp_path / "txt")))
    assert [(r.doc_id, r.text) for r in corpus.collect()] == [(0, "Body\n\ntext")] and [r.title for r in skipped.collect()] == ["gone"]
    q = readers.contract_queries(contracts, corpus).collect()
    assert len(q) == 1 and q[0].answers == "one [SEP] two" and q[0].category == "Term" and q[0].ref_doc_id == 0 and set(q[0].aspects) == {a for a, _ in T.ASPECTS}
    (tmp_path / "e.json").write_text(json.dumps({"queries": [{"question": "q", "answer": "g", "mmr_contexts": ["a"]}, {"query": "", "question": "r", "ground_truth": "h"}]}))
    items = readers.eval_items(spark, str(tmp_path / "e.json")).collect()
    assert [(r["query"], r.ground_truth, r.mmr_contexts) for r in items] == [("q", "g", ["a"]), ("r", "h", [])]
    (tmp_path / "retrieval_run7.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    lines = readers.json_lines(spark, str(tmp_path / "retrieval_run7.jsonl"), "a int").collect()
    assert [r.a for r in lines] == [1, 2] and {r.run_id for r in lines} == {"run7"}
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("y", 2, 3)], "v string, k int, more int")
    for df in (a, b):
        sinks.append_csv(df, str(tmp_path / "out.csv"), ["v"])
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "out.csv"), header=True).collect()) == [("x", "1"), ("y", "2")]


def test_pipeline_round_trip(spark, tmp_path):
    rng = random.Random(7)
    nouns = "fee term notice ledger pallet invoice audit licence escrow carrier".split()
    docs = spark.createDataFrame([(i, " ".join(f"The {rng.choice(nouns)} governs the {rng.choice(nouns)}." for _ in range(6))) for i in range(60)], "doc_id bigint, text string")
    index = pipeline.build_index(docs, "doc_id", "text", adapters.HashEmbedder(16), centroids=4, parts=4, codes=16)
    sinks.write_index(index, str(tmp_path / "index"))
    back = readers.index_bundle(spark, str(tmp_path / "index"))
    assert back["metadata"].count() == index["metadata"].count() == back["postings"].count()
    found = pipeline.retrieve(back, spark.createDataFrame([(0, "fee term notice"), (1, "escrow carrier")], "query_id bigint, query string"), adapters.HashEmbedder(16), k=5, nprobe=4)
    assert {r.query_id for r in found.collect()} == {0, 1} and found.count() == 10
    with pytest.raises(FileNotFoundError):
        readers.index_bundle(spark, str(tmp_path / "nothing"))


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_rough_near_leaves_out_none():
    """the single-precision search gives all pairs that may be among the nearest, ties and rows that aren't numbers included, and few others."""
    rng = np.random.default_rng(8)
    q, v = rng.standard_normal((40, 6)), np.repeat(rng.standard_normal((600, 6)), 2, 0)
    v[5] = np.nan
    d = np.sqrt(((q[:, None] - v) ** 2).sum(2))
    kth = np.sort(d, 1)[:, 6]
    for bound in (np.full(40, np.inf), np.where(np.arange(40) % 2, kth, np.inf)):
        i, j = I.rough_near(q, v, 7, bound)
        want = {(a, b) for a, b in zip(*np.nonzero(d <= kth[:, None]))}
        assert want <= set(zip(i.tolist(), j.tolist())) and len(i) < len(want) + 40
    assert len(I.rough_near(q, v[:0], 7, np.full(40, np.inf))[0]) == 0 and len(I.rough_near(q, v, 7, np.full(40, 1e-9))[0]) == 0
