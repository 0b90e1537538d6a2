"""Evaluation, sweeps, judge records, readers and writers of runs, and lookups beyond one broadcast."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import metrics as M
from lexforge.operators import retrieval as R
from lexforge.operators import sweep as S
from lexforge.operators import text_tables as X
from lexforge.operators import vector_index as I
from lexforge.plans import adapters, pipeline
from lexforge.plans import evaluation as E
from lexforge.sources import readers, sinks

WORDS = "fee term notice ledger pallet invoice audit licence escrow carrier permit crate".split()


@pytest.fixture(scope="module")
def case(spark):
    """Twelve queries over sixty chunks of ten contracts, two rounds each."""
    rng = np.random.default_rng(3)
    text = random.Random(3)
    book = spark.createDataFrame([(m, c, rng.standard_normal(2).tolist()) for m in range(4) for c in range(16)], "m int, code smallint, vec array<double>")
    chunks, codes = [], {}
    for i in range(60):
        name = f"{i % 10}_{i // 10}"
        codes[name] = [int(x) for x in rng.integers(0, 16, 4)]
        chunks.append((name, str(i % 10), i // 10, " ".join(text.choice(WORDS) for _ in range(30)), f"Section {i % 3}" if i % 2 else None))
    found, queries, truth = [], [], []
    for q in range(12):
        target = str(q % 10)
        for number in (1, 2):
            queries.append((q, number, rng.standard_normal(8).tolist()))
            for pos, at in enumerate(rng.permutation(60)[:40]):
                name, doc, _, _, heading = chunks[at]
                found.append((q, number, pos, name, doc, doc == target, int(at) % 7, heading, codes[name]))
        truth.append((q, f"question {q}", target, chunks[q][3]))
    return {
        "book": book, "codes": codes,
        "chunks": spark.createDataFrame(chunks, "chunk_id string, doc_id string, chunk_idx int, text string, section_heading string"),
        "found": spark.createDataFrame(found, "query_id int, round int, pos int, chunk_id string, doc_id string, is_local boolean, centroid_id int, section_heading string, pq_code array<smallint>"),
        "queries": spark.createDataFrame(queries, "query_id int, round int, embedding array<double>"),
        "truth": spark.createDataFrame(truth, "query_id int, query string, target string, truth string"),
    }


def test_folds_together_are_the_folds_alone(spark, case):
    folds = [R.Fold("b2", 5), R.Fold("proposed", 5, 0.5, 0.5), R.Fold("proposed", 8, 0.3, 1.5, 0.3)]
    rows = R.rerank_all(case["found"], case["queries"], case["book"], folds).collect()
    for i, f in enumerate(folds):
        alone = R.rerank(case["found"], case["queries"], case["book"], f.k, f.lam, f.tau, f.share, f.nprobe, f.mode).collect()
        key = lambda r: (r.query_id, r["rank"])
        assert [(r.query_id, r.chunk_id, r.score) for r in sorted((r for r in rows if r.fold == i), key=key)] == [(r.query_id, r.chunk_id, r.score) for r in sorted(alone, key=key)]
    # By distance alone: the first round's local places, then whatever is nearest in its own round.
    book = I.code_book(case["book"])
    queries = {(r.query_id, r["round"]): np.array(r.embedding) for r in case["queries"].collect()}
    offered = [r for r in case["found"].collect() if r.query_id == 0]
    far = lambda r: float(np.sqrt(((np.concatenate([book[m][c] for m, c in enumerate(r.pq_code)]) - queries[(0, r["round"])]) ** 2).sum()))
    local = sorted((far(r), r.pos, r.chunk_id) for r in offered if r["round"] == 1 and r.is_local)[:4]
    got = [r.chunk_id for r in sorted((r for r in rows if r.fold == 0 and r.query_id == 0), key=lambda r: r["rank"])]
    assert got[: len(local)] == [c for _, _, c in local]
    rest = sorted((far(r), r.pos, r.chunk_id) for r in offered if r["round"] == 2 and r.chunk_id not in got[: len(local)])
    assert got[len(local) :] == [c for _, _, c in rest[: 5 - len(local)]]


def test_modes_summaries_and_export(spark, case):
    results = E.mode_results(case["found"], case["queries"], case["book"], 5, nprobe=4).cache()
    contexts = E.stitched_contexts(results, case["chunks"])
    codes = spark.createDataFrame(list(case["codes"].items()), "chunk_id string, pq_code array<smallint>")
    summary = E.result_summary(results, case["truth"], contexts, codes, case["book"], 4).collect()
    assert len(summary) == 36 and {r.mode for r in summary} == {"b1", "b2", "mmr"}
    book, texts = I.code_book(case["book"]), {r.chunk_id: r.raw for r in contexts.collect()}
    truths = {r.query_id: set(T_words(r.truth)) for r in case["truth"].collect()}
    wanted = {r.query_id: T_words(r.truth) for r in case["truth"].collect()}
    for s in summary:
        own = sorted((r for r in results.collect() if r.mode == s.mode and r.query_id == s.query_id), key=lambda r: r["rank"])
        vectors = np.stack([np.concatenate([book[m][c] for m, c in enumerate(case["codes"][r.chunk_id])]) for r in own])
        pairs = [(i, j) for i in range(len(own)) for j in range(i)]
        ild = np.mean([np.linalg.norm(vectors[i] - vectors[j]) for i, j in pairs]) if pairs else 0.0
        hit = max(sum(w in set(T_words(texts[r.chunk_id])) for w in wanted[s.query_id]) / len(wanted[s.query_id]) >= 0.85 for r in own)
        assert s.ild == pytest.approx(ild, abs=1e-5) and s.recall == hit and s.documents == len({r.doc_id for r in own}) and s.local == sum(r.is_local for r in own)
    assert truths
    averages = {r.mode: r for r in E.mode_averages(spark.createDataFrame(summary)).collect()}
    assert averages["mmr"].queries == 12 and averages["mmr"].avg_ild == pytest.approx(np.mean([s.ild for s in summary if s.mode == "mmr"]), abs=1e-5)
    exported = {r.query_id: r for r in E.retrieval_export(results, case["truth"], contexts, case["chunks"]).collect()}
    assert len(exported) == 12 and all(c.startswith("--- [Source: ") for c in exported[0].b1_contexts) and len(exported[0].b1_contexts) == 5
    sides = {r.query_id: r for r in E.side_by_side(results).collect()}
    assert all(r.shared + r.only_one == 5 for r in sides.values())


def T_words(text):
    import re

    return re.findall(r"[^\W]+", (text or "").lower())


def test_sweep_against_single_points(spark, case, tmp_path):
    points = S.grid(spark, (0.3, 0.7), (0.5,), (0.3, 0.7), (4,))
    contexts = E.stitched_contexts(case["found"], case["chunks"])
    table = E.sweep(case["found"], case["queries"], case["truth"], case["book"], contexts, points, 4).orderBy("sweep_idx").collect()
    assert [r.sweep_idx for r in table] == [0, 1, 2, 3] and table[0].b1_ild == table[2].b1_ild  # the same share and size
    codes = spark.createDataFrame(list(case["codes"].items()), "chunk_id string, pq_code array<smallint>")
    for r in table[:2]:
        results = E.mode_results(case["found"], case["queries"], case["book"], 4, r.gamma, 4, r.mmr_lambda, r.tau_dup)
        own = {x.mode: x for x in E.mode_averages(E.result_summary(results, case["truth"], contexts, codes, case["book"], 4)).collect()}
        for mode in ("b1", "b2", "mmr"):
            assert r[f"{mode}_recall"] == pytest.approx(own[mode].avg_recall, abs=1e-5) and r[f"{mode}_ild"] == pytest.approx(own[mode].avg_ild, abs=1e-4) and r[f"{mode}_rr"] == pytest.approx(own[mode].avg_redundancy, abs=1e-4)
    metrics = spark.createDataFrame(table)
    records = spark.createDataFrame([(i, q, "a") for i in range(4) for q in range(2)], "sweep_idx int, query_idx int, query string")
    sinks.write_sweep(metrics, records, str(tmp_path), "r9", "cuad", 12)
    written = spark.read.csv(str(tmp_path / "sweep_r9.csv"), header=True)
    assert written.columns == E.SWEEP_COLUMNS and written.count() == 4
    folder, path, run = readers.run_records(spark, manifest_path=str(tmp_path / "run_manifest.json"))
    assert (folder, run) == (str(tmp_path), "r9") and readers.run_records(spark, records_path=path)[2] == "r9"
    back = readers.json_lines(spark, path, "sweep_idx int, query_idx int, query string, run_id string")
    assert back.count() == 8 and {r.run_id for r in back.collect()} == {"r9"}
    kept, missing = E.requested_points(back, [1, 3, 7])
    assert {r.sweep_idx for r in kept.collect()} == {1, 3} and missing == [7]
    with pytest.raises(FileNotFoundError):
        readers.run_records(spark, records_path=str(tmp_path / "retrieval_none.jsonl"))


def test_no_line_is_lost(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "run_id": "z"}\nnot json\n\n{"a": 3}\n')
    kept = readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", "keep").collect()
    assert sorted((r.a or 0, r.malformed) for r in kept) == [(0, "not json"), (1, None), (3, None)]
    with pytest.raises(Exception, match="no record"):
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_truth_aspects_and_rounds(spark):
    queries = spark.createDataFrame([(0, "Term", "q0", "an answer", 1), (1, "Fee", "q1", " ", 1), (2, "Fee", "q2", None, 9)], "query_id int, category string, query string, answers string, ref_doc_id int")
    docs = spark.createDataFrame([(1, "the contract")], "doc_id int, text string")
    assert {r.query_id: r.truth for r in E.with_truth(queries, docs).collect()} == {0: "an answer", 1: "the contract", 2: ""}
    known = spark.createDataFrame([("Term", ["a", "b"]), ("Other", [])], "category string, sub_queries array<string>")
    aspects = {r.query_id: r.aspects for r in E.with_aspects(queries, known).collect()}
    assert aspects[0] == ["a", "b"] and len(aspects[1]) == 4
    rounds = E.round_queries(spark.createDataFrame([(0, "q", ["x", " ", None, "y"]), (1, "r", None)], "query_id int, query string, aspects array<string>"), adapters.HashEmbedder(8))
    assert sorted((r.query_id, r["round"]) for r in rounds.collect()) == [(0, 1), (0, 2), (0, 3), (1, 1)]


def test_judge_records_and_scores(spark):
    raws = [('{"winner": "B", "reason": "r", "scores": {}}', "B", False), ("nonsense", "TIE", True), (None, "TIE", True), ("```json\n{\"winner\": \"A\"}\n```", "A", False)]
    rows = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(raws)], "id int, raw string").select("id", T.judge_record(F.col("raw"), F.lit("p")).alias("j")).orderBy("id").collect()
    assert [(r.j.winner, r.j.parse_error) for r in rows] == [(w, e) for _, w, e in raws] and rows[1].j.raw_response == "nonsense" and rows[0].j.provider == "p"
    prompt = spark.range(1).select(T.judge_prompt(F.lit("cost $5 {a}?"), F.lit("x"), F.lit(None).cast("string"), F.lit("z"))).first()[0]
    assert "Question: cost $5 {a}?" in prompt and "Answer B: \n" in prompt
    df = spark.createDataFrame([(1, "alpha beta [SEP] gamma", "gamma", "", "delta"), (2, None, None, "x", "y")], "id int, t string, a string, b string, c string")
    got = {r.id: r for r in E.semantic_scores(df, "id", "t", {"a": "a", "b": "b", "c": "c"}, adapters.HashEmbedder(512)).collect()}
    assert got[1].a == pytest.approx(1.0, abs=1e-6) and got[1].b == 0 and got[1].c < 0.5 and got[2].a == 0
    names = spark.createDataFrame([(None, "m1"), (" ", None), ("own", "m1")], "o string, c string").select(T.model_name(F.col("o"), F.col("c"), default="d").alias("n")).collect()
    assert [r.n for r in names] == ["m1", "d", "own"]


def test_more_centroids_than_one_broadcast(spark):
    rng = np.random.default_rng(5)
    centroids = spark.createDataFrame([(i, rng.standard_normal(3).tolist()) for i in range(90)] + [(90, [0.0, 0.0, 0.0])], "centroid_id int, vec array<double>")
    rows = spark.createDataFrame([(i, rng.standard_normal(3).tolist()) for i in range(40)], "id int, v array<double>")
    at_once, in_parts = (sorted(tuple(r) for r in I.nearest_of(rows, "id", "v", centroids, 3, block).select("id", "rank", "centroid_id").collect()) for block in (1000, 40))
    assert at_once == in_parts and len(at_once) == 120
    with pytest.raises(ValueError):
        I.same_width(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, v array<double>"), "v")


def test_rotated_index_and_its_files(spark, tmp_path):
    text = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(f"The {text.choice(WORDS)} governs the {text.choice(WORDS)}." for _ in range(6))) for i in range(50)], "doc_id bigint, text string")
    index = pipeline.build_index(docs, "doc_id", "text", adapters.HashEmbedder(16), centroids=4, parts=4, codes=16, rotated=True)
    sinks.write_index(index, str(tmp_path / "index"))
    back = readers.index_bundle(spark, str(tmp_path / "index"))
    assert "rotation" in back and readers.index_config(back) == {"embedding_dim": 16, "num_centroids": 4, "num_subspaces": 4}
    assert {p.name for p in (tmp_path / "index" / "postings.parquet").iterdir() if p.name.startswith("centroid_id=")}
    queries = spark.createDataFrame([(0, "fee term notice")], "query_id int, query string")
    turned = [r.chunk_id for r in pipeline.retrieve(back, queries, adapters.HashEmbedder(16), 5, 4).orderBy("rank").collect()]
    assert len(turned) == 5
    sinks.write_df_stats(X.document_frequency(docs, "text"), 50, str(tmp_path / "index"))
    assert readers.index_bundle(spark, str(tmp_path / "index"))["df_stats"].first().total_docs == 50


def test_preprocessed_corpus_and_datasets(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id bigint, text string")
    queries = spark.createDataFrame([("q", 0, "x", "q more", ["more"], "Term"), ("r", 5, "x", "r", [], "Fee"), ("p", 1, "x", "p", [], "Term")], "query string, ref_doc_id bigint, answers string, query_concat string, query_aspects array<string>, category string")
    categories = readers.category_map(spark, queries, str(tmp_path / "map.json"))
    assert {r.category: r.description for r in categories.collect()} == {"Term": "p", "Fee": "r"}
    again = readers.category_map(spark, queries.limit(0), str(tmp_path / "map.json"))  # from what was stored
    assert again.count() == 2
    sinks.write_preprocessed(corpus, queries, categories, spark.createDataFrame([("Term", ["a"])], "category string, sub_queries array<string>"), str(tmp_path / "pre"))
    docs, known = readers.processed(spark, str(tmp_path / "pre"))
    assert docs.count() == 2 and {r["query"] for r in known.collect()} == {"q", "p"} and readers.processed(spark, str(tmp_path / "pre"), 1)[1].count() == 1
    (tmp_path / "d.json").write_text("\n".join(json.dumps(x) for x in ({"id": "7", "dict": {"text": "ctx"}, "question": "q1"}, {"contexts": ["u", "v"], "input": "q2"}, {"question": "no context"})))
    contexts, asked = readers.dataset(spark, str(tmp_path / "d.json"), "json")
    assert {r.context for r in contexts.collect()} == {"ctx", "u v"} and {r["query"] for r in asked.collect()} == {"q1", "q2"} and "7" in {r.row_id for r in contexts.collect()}
    (tmp_path / "e.json").write_text(json.dumps([{"query": "q", "b1_contexts": [{"text": "one"}, {"chunk": "two"}, "three"]}]))
    assert readers.eval_items(spark, str(tmp_path / "e.json")).first().b1_contexts == ["one", "two", "three"]


def test_corpus_is_numbered_in_parts(spark):
    articles = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "article_idx int, title string").repartition(7).withColumn("paragraphs", F.array().cast("array<struct<context: string>>"))
    texts = spark.createDataFrame([(f"t{i}", "x") for i in range(300) if i % 3], "title string, text string")
    docs, skipped = readers.corpus(articles, texts)
    rows = sorted((r.doc_id, r.article_idx) for r in docs.collect())
    assert [a for _, a in rows] == [i for i in range(300) if i % 3] and [d for d, _ in rows] == list(range(200)) and skipped.count() == 100


def test_requested_groups_and_chunk_report(spark):
    docs = spark.createDataFrame([(0, "fee fee term"), (2, "a"), (3, "notice period")], "g int, t string")
    counts = X.group_word_counts(docs, "g", "t")
    kept, outside, empty = X.requested_groups(counts, docs, "g", [0, 2, 9])
    assert {r.word for r in kept.collect()} == {"fee", "term"} and outside == [9] and empty == [2]
    r = X.chunk_report(docs, "t", 5).first()
    assert (r.chunks, r.short_chunks, r.least, r.greatest) == (3, 1, 1, 13)


def test_splitters_against_a_plain_walk():
    rng = random.Random(4)

    def sliding(text, size, overlap):  # character by character
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + size)
            best = max((p for p in range(at + max(1, int(size * 0.7)), end) if text[p] in "\n ;:?!"), default=-1)
            end = best + 1 if best > at + 10 else end
            out += [text[at:end].strip()] if text[at:end].strip() else []
            if end >= len(text):
                break
            at = end - overlap if end - overlap > at else at + max(1, int(size * 0.25))
        return out

    for _ in range(300):
        text = "".join(rng.choice("abcd. \n;:?!,") for _ in range(rng.randint(0, 300)))
        size, overlap = rng.randint(4, 60), rng.randint(0, 40)
        assert X.split_sliding(text, size, overlap) == sliding(text, size, overlap)
        pieces = X.split_oversized(text, size, overlap)
        at = 0
        for p in pieces:  # every piece follows in the text, with nothing but white space between one and the next
            ends = [s + len(p) for s in range(len(text)) if text.startswith(p, s) and not text[at:s].strip()]
            assert ends and len(p) <= size
            at = max(at, *ends)
        assert not text[at:].strip()


def test_means_of_stored_lists(spark):
    rows = spark.createDataFrame([(1, ["x"], "a x b"), (2, [], "t")], "id int, c array<string>, t string")
    assert M.recall_mrr(rows, "id", F.col("c"), F.col("t"), 2).agg(F.avg("recall")).first()[0] == 0.5
