"""Evaluating retrieval: three modes over one set of queries, their contexts, summaries and averages; sweeps over parameter grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions import vectors as V
from lexforge.operators import retrieval as R
from lexforge.operators import text_tables as X
from lexforge.plans.adapters import Embedder
from lexforge.sources.readers import cut

#: The columns of a sweep's table, in their order (fixed values).
SWEEP_COLUMNS = [
    "mmr_lambda", "tau_dup", "gamma", "top_k", "window_size", "b1_recall", "b2_recall", "mmr_recall", "b1_ild", "b2_ild", "mmr_ild", "b1_rr", "b2_rr", "mmr_rr", "b1_breadth", "b2_breadth", "mmr_breadth", "combo_artifact",
]

#: The columns of the modes' results.
RESULT = ("mode", "query_id", "rank", "chunk_id", "centroid_id", "doc_id", "is_local", "rounds", "skipped", "p25")


def round_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """(query_id, round, embedding): a query's rounds: its own text first, then its aspects that aren't blank, in their order.

    queries: query_id, query and, if there are any, aspects array<string>.
    """
    aspects = F.coalesce(F.col("aspects"), F.array().cast("array<string>")) if "aspects" in queries.columns else F.array().cast("array<string>")
    texts = F.concat(F.array(F.coalesce("query", F.lit(""))), F.filter(aspects, lambda a: T.strip(F.coalesce(a, F.lit(""))) != ""))
    rounds = queries.select("query_id", F.posexplode(texts).alias("at", "text")).select("query_id", (F.col("at") + 1).alias("round"), T.search_text(F.col("text")).alias("text"))
    return embedder.embed(rounds, "text", "embedding").select("query_id", "round", "embedding")


def with_truth(queries: DataFrame, docs: DataFrame, answers: str = "answers", ref: str = "ref_doc_id") -> DataFrame:
    """queries with `truth`: the answers, or where these are blank the text of the document they refer to, or nothing.

    docs: doc_id, text. A reference to no document of the table is dropped.
    """
    texts = docs.select(F.col("doc_id").alias(ref), F.col("text").alias("_text")).dropDuplicates([ref])
    own = F.nullif(T.strip(F.coalesce(F.col(answers), F.lit(""))), F.lit(""))
    joined = queries.join(texts, ref, "left")
    return joined.withColumn("truth", F.coalesce(own, F.col("_text"), F.lit(""))).drop("_text")


def with_aspects(queries: DataFrame, aspect_map: DataFrame) -> DataFrame:
    """queries (category, query) with `aspects`: those that the map (category, sub_queries) has for the category, else computed ones."""
    known = aspect_map.where(F.size("sub_queries") > 0).groupBy("category").agg(F.min("sub_queries").alias("_known"))
    return queries.join(known, "category", "left").withColumn("aspects", F.coalesce("_known", T.aspects(F.col("query")))).drop("_known")


def mode_results(found: DataFrame, queries: DataFrame, codebook: DataFrame, k: int = 10, share: float = 0.7, nprobe: int = 8, lam: float = 0.5, tau: float = 0.5) -> DataFrame:
    """(mode, query_id, rank, chunk_id, centroid_id, doc_id, is_local, rounds, skipped, p25): the results of b1 (nearest chunks of the first
    round, merged by quota), b2 (all rounds by distance alone) and mmr (all rounds re-ranked).

    found: candidates of all rounds, as rerank_all takes them; queries: query_id, round, embedding.
    """
    first = found.where("round = 1")
    near = R.with_distance(first.select("query_id", "chunk_id", "centroid_id", "doc_id", "is_local", "pos", "pq_code"), queries.where("round = 1"), codebook)
    top = R.hybrid_merge(near, k, share).select("query_id", "chunk_id", "rank")
    b1 = top.join(near.drop("pos", "pq_code", "dist_q"), ["query_id", "chunk_id"]).select(F.lit("b1").alias("mode"), "query_id", "rank", "chunk_id", "centroid_id", "doc_id", "is_local", F.lit(1).alias("rounds"), F.lit(0).alias("skipped"), F.lit(None).cast("double").alias("p25"))
    folds = [R.Fold("b2", k, share=share, nprobe=nprobe), R.Fold("proposed", k, lam, tau, share, nprobe)]
    others = R.rerank_all(found, queries, codebook, folds).withColumn("mode", F.when(F.col("fold") == 0, "b2").otherwise("mmr"))
    return b1.unionByName(others.select(*RESULT))


def stitched_contexts(results: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """(chunk_id, raw): the text of every chunk that is in a result, with its neighbours, without broken edges; each chunk once.

    chunks: chunk_id, doc_id, chunk_idx, text, section_heading.
    """
    return X.stitch(chunks, results.select("chunk_id"), radius).select("chunk_id", T.trim_edges(F.col("stitched")).alias("raw"))


def result_summary(results: DataFrame, queries: DataFrame, contexts: DataFrame, codes: DataFrame, codebook: DataFrame, nprobe: int = 8) -> DataFrame:
    """One row per query and mode: distinct centroids and their ratio to those probed, documents, first quartile of the distances, chunks skipped,
    mean distance and redundancy of the list, tokens for a generator, local and global chunks, strict recall of the truth.

    queries: query_id, truth; contexts: see stitched_contexts; codes: chunk_id, pq_code. The codes of the results alone are decoded.
    """
    shared = results.sparkSession.sparkContext.broadcast(R.I.code_book(codebook))
    # Texts meet once for each query and chunk, whatever the modes that found it; numbers go on.
    tasks = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes are much work here
    pairs = results.select("query_id", "chunk_id").distinct().join(queries.select("query_id", "truth"), "query_id").repartition(tasks, "chunk_id").join(contexts.repartition(tasks, "chunk_id"), "chunk_id", "left")
    texts = pairs.select("query_id", "chunk_id", F.length("raw").alias("chars"), T.token_estimate(F.array(F.coalesce("raw", F.lit("")))).alias("tokens"), T.covered(F.col("truth"), F.col("raw")).alias("hit"))
    rows = results.join(codes, "chunk_id", "left").join(texts, ["query_id", "chunk_id"])

    @F.pandas_udf("struct<ild: double, redundancy: double>")
    def spread(codes):
        import numpy as np
        import pandas as pd

        book = shared.value
        out = []
        for c in codes:
            c = [x for x in c if x is not None]
            out.append(R.list_spread(np.stack([np.concatenate([book[m][v] for m, v in enumerate(x)]) for x in c])) if c else (0.0, 0.0))
        return pd.DataFrame(out, columns=["ild", "redundancy"])

    out = rows.groupBy("mode", "query_id").agg(
        F.count("*").alias("results"), F.count_distinct("centroid_id").alias("centroids"), F.count_distinct("doc_id").alias("documents"), F.max("rounds").alias("rounds"), F.max("skipped").alias("skipped"),
        F.max("p25").alias("p25"), F.sum("tokens").alias("tokens"), F.count_if("is_local").alias("local"), F.count_if(~F.col("is_local")).alias("global"), F.max("hit").alias("recall"),
        F.avg(F.when(F.col("rank") <= 10, F.col("chars"))).alias("chars"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "pq_code"))), lambda r: r["pq_code"]).alias("codes"),
    )
    out = out.withColumn("s", spread("codes"))
    ratio = F.col("centroids") / (F.lit(nprobe) * F.col("rounds"))
    return out.select(
        "mode", "query_id", "results", "rounds", "centroids", F.round(ratio, 6).alias("centroid_ratio"), "documents", F.round("p25", 6).alias("p25"), "skipped", F.round("s.ild", 6).alias("ild"), F.round("s.redundancy", 6).alias("redundancy"),
        "tokens", "local", "global", F.round(F.col("local") / F.col("results"), 6).alias("local_ratio"), F.coalesce("recall", F.lit(0)).alias("recall"), F.round("chars", 6).alias("chars"),
    )


def mode_averages(summary: DataFrame, by: str = "mode") -> DataFrame:
    """Means over the queries of every mode; what a query has no value for is left out of its mean."""
    values = ("centroids", "centroid_ratio", "documents", "skipped", "ild", "recall", "redundancy", "p25", "chars")
    return summary.groupBy(by).agg(F.count("*").alias("queries"), *(F.round(F.avg(v), 6).alias(f"avg_{v}") for v in values))


def retrieval_export(results: DataFrame, queries: DataFrame, contexts: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """(query_id, query, ground_truth, b1_contexts, b2_contexts, mmr_contexts): the tagged contexts of every query in the order of their ranks.

    queries: query_id, query, truth, target. Without contexts they are stitched here and go to their queries straight from their documents.
    """
    meta = chunks.select("chunk_id", "section_heading").dropDuplicates(["chunk_id"])
    tasks = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = results.repartition(tasks, "chunk_id").groupBy("query_id", "chunk_id", "doc_id").agg(F.collect_list(F.struct("mode", "rank")).alias("places"))  # a text goes to its query once, whatever the modes
    places = places.join(meta, "chunk_id")
    if contexts is None:
        asked = places.groupBy("chunk_id").agg(F.collect_list(F.struct("query_id", "doc_id", "section_heading", "places")).alias("asked"))
        stitched = X.stitch(chunks, asked, 1, along="asked").select("chunk_id", T.trim_edges(F.col("stitched")).alias("raw"), F.explode("asked").alias("a"))
        rows = stitched.select("chunk_id", "raw", "a.*").join(queries, "query_id")
    else:
        rows = places.join(contexts, "chunk_id").join(queries, "query_id")
    tagged = rows.withColumn("context", T.tag_context(F.col("doc_id"), F.coalesce(F.col("target"), F.lit("")), F.col("section_heading"), F.col("raw")))
    given = tagged.groupBy("query_id").agg(F.first("query").alias("query"), F.first("truth").alias("ground_truth"), F.collect_list(F.struct("places", "context")).alias("all"))

    def contexts_of(m: str) -> Column:
        placed = F.transform("all", lambda r: F.transform(F.filter(r["places"], lambda p: p["mode"] == m), lambda p: F.struct(p["rank"].alias("rank"), r["context"].alias("context"))))
        return F.transform(F.array_sort(F.flatten(placed)), lambda r: r["context"]).alias(f"{m}_contexts")

    return given.select("query_id", "query", "ground_truth", *map(contexts_of, ("b1", "b2", "mmr")))


def side_by_side(results: DataFrame, one: str = "b1", other: str = "mmr") -> DataFrame:
    """(query_id, shared, only_one, only_other, first_differs): what two modes' results of every query have in common, and the first rank at which they differ."""
    a, b = (results.where(F.col("mode") == m).select("query_id", "chunk_id", F.col("rank").alias(n)) for m, n in ((one, "rank_one"), (other, "rank_other")))
    both = a.join(b, ["query_id", "chunk_id"], "full")
    differs = F.col("rank_one").isNull() | F.col("rank_other").isNull() | (F.col("rank_one") != F.col("rank_other"))
    return both.groupBy("query_id").agg(
        F.count_if(F.col("rank_one").isNotNull() & F.col("rank_other").isNotNull()).alias("shared"), F.count_if(F.col("rank_other").isNull()).alias("only_one"), F.count_if(F.col("rank_one").isNull()).alias("only_other"),
        F.min(F.when(differs, F.least("rank_one", "rank_other"))).alias("first_differs"),
    )


def sweep(found: DataFrame, queries: DataFrame, truths: DataFrame, codebook: DataFrame, contexts: DataFrame, points: DataFrame, nprobe: int = 8, window_size: int = 1) -> DataFrame:
    """(sweep_idx, ... SWEEP_COLUMNS without combo_artifact): the metrics of b1, b2 and mmr at every point of a grid.

    Candidates don't depend on the points: they are brought together once per query, and each fold runs over them. b1 and b2
    depend on gamma and top_k alone and run once for these. points is a grid (a handful of rows); contexts hold every chunk that may be found.
    """
    grid = points.orderBy("sweep_idx").collect()
    quotas = sorted({(p.gamma, p.top_k) for p in grid})
    folds = [R.Fold("b2", k, share=g, nprobe=nprobe) for g, k in quotas] + [R.Fold("proposed", p.top_k, p.mmr_lambda, p.tau_dup, p.gamma, nprobe) for p in grid]
    spark = found.sparkSession
    first = found.where("round = 1")
    near = R.with_distance(first.select("query_id", "chunk_id", "centroid_id", "doc_id", "is_local", "pos", "pq_code"), queries.where("round = 1"), codebook)
    own = F.row_number().over(Window.partitionBy("query_id", "is_local").orderBy(F.round("dist_q", 9), "pos"))
    near = near.withColumn("own", own).where(F.col("own") <= max(k for _, k in quotas))
    merged = None
    for i, (g, k) in enumerate(quotas):  # nine of them: each ranks no more than the nearest of either kind
        top = R.hybrid_merge(near, k, g).select("query_id", "chunk_id", "rank", F.lit(i).alias("quota"))
        merged = top if merged is None else merged.unionByName(top)
    b1 = merged.join(near.select("query_id", "chunk_id", "centroid_id", "pq_code"), ["query_id", "chunk_id"])
    shared = spark.sparkContext.broadcast(R.I.code_book(codebook))

    @F.pandas_udf("struct<ild: double, redundancy: double>")
    def spread(codes):
        import numpy as np
        import pandas as pd

        book = shared.value
        return pd.DataFrame([R.list_spread(np.stack([np.concatenate([book[m][v] for m, v in enumerate(x)]) for x in c])) for c in codes], columns=["ild", "redundancy"])

    folded = cut(R.rerank_all(found, queries, codebook, folds))
    b1 = cut(b1)
    hits = truths.select("query_id", "truth")
    # Whether a chunk covers a query's truth doesn't depend on the point at which it is found.
    pairs = b1.select("query_id", "chunk_id").unionByName(folded.select("query_id", "chunk_id")).distinct()
    covers = cut(pairs.join(contexts, "chunk_id").join(hits, "query_id").select("query_id", "chunk_id", T.covered(F.col("truth"), F.col("raw")).alias("hit")))

    def measured(rows: DataFrame, by: str, spread_of: list[Column]) -> DataFrame:
        hit = rows.join(covers, ["query_id", "chunk_id"], "left")
        return hit.groupBy(by, "query_id").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("recall"), F.count_distinct("centroid_id").alias("breadth"), *spread_of)

    b1_lists = measured(b1, "quota", [F.collect_list("pq_code").alias("codes")]).withColumn("s", spread("codes")).select("quota", "query_id", "recall", "breadth", F.col("s.ild").alias("ild"), F.col("s.redundancy").alias("redundancy"))
    lists = measured(folded, "fold", [F.max("ild").alias("ild"), F.max("redundancy").alias("redundancy")])
    total = hits.select("query_id").distinct().count()  # a query without results counts with zeros
    mean = lambda v: F.round(F.sum(F.coalesce(v, F.lit(0))) / F.lit(max(1, total)), 6)
    means = lambda d, by, p: d.groupBy(by).agg(*(mean(c).alias(f"{p}_{n}") for c, n in (("recall", "recall"), ("ild", "ild"), ("redundancy", "rr"), ("breadth", "breadth"))))
    b1_means, b2_means, mmr_means = means(b1_lists, "quota", "b1"), means(lists.where(F.col("fold") < len(quotas)), "fold", "b2"), means(lists.where(F.col("fold") >= len(quotas)), "fold", "mmr")
    keys = spark.createDataFrame([(p.sweep_idx, p.mmr_lambda, p.tau_dup, p.gamma, p.top_k, quotas.index((p.gamma, p.top_k)), len(quotas) + i) for i, p in enumerate(grid)], "sweep_idx int, mmr_lambda double, tau_dup double, gamma double, top_k int, quota int, fold int")
    out = keys.join(F.broadcast(b1_means), "quota", "left").join(b2_means.withColumnRenamed("fold", "quota"), "quota", "left").join(mmr_means, "fold", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in SWEEP_COLUMNS[5:-1]]
    return out.select("sweep_idx", "mmr_lambda", "tau_dup", "gamma", "top_k", F.lit(window_size).alias("window_size"), *zero)


def sweep_probed(asked: DataFrame, shared, truths: DataFrame, chunks: DataFrame, points: DataFrame, nprobe: int = 8, window_size: int = 1, top_cut: bool = False, most: int = 64_000_000) -> DataFrame:
    """As sweep, over the candidates of `asked` (see probed.probes): neither candidates nor results of every point become rows.

    chunks: see stitched_contexts. Truths of up to `most` characters are sent to all tasks.
    """
    from lexforge.operators import probed as P

    grid = points.orderBy("sweep_idx").collect()
    quotas = sorted({(p.gamma, p.top_k) for p in grid})
    folds = [R.Fold("b2", k, share=g, nprobe=nprobe) for g, k in quotas] + [R.Fold("proposed", p.top_k, p.mmr_lambda, p.tau_dup, p.gamma, nprobe) for p in grid]
    many = len(quotas) + len(folds)
    rows = cut(P.sweep_all(asked, shared, folds, quotas, top_cut))
    sums = [sum(v) for v in zip(*(r.sums for r in rows.where("sums is not null").select("sums").collect()))] or [0.0] * 3 * many
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes are much work here
    # Texts and those that ask for them meet by document, where the neighbours are: one shuffle, after which chunks given twice are one.
    texts = chunks.select("doc_id", "chunk_id", F.struct("chunk_idx", "text").alias("c"), F.lit(None).cast(rows.select(F.struct("query_id", "found").alias("a")).schema["a"].dataType).alias("a"))
    pairs = rows.where("chunk_id is not null").select("doc_id", "chunk_id", F.lit(None).cast(texts.schema["c"].dataType).alias("c"), F.struct("query_id", "found").alias("a"))
    both = texts.unionByName(pairs).repartition(tasks, "doc_id").groupBy("doc_id", "chunk_id").agg(F.max("c").alias("c"), F.collect_list("a").alias("asked")).where("c is not null")
    both = both.select("doc_id", "chunk_id", "c.*", F.when(F.size("asked") > 0, F.col("asked")).alias("asked"))
    stitched = X.stitch(both, None, 1, along="asked").select(T.trim_edges(F.col("stitched")).alias("raw"), "asked")
    hits = cut(truths.select("query_id", "truth"))
    size = hits.agg(F.count_distinct("query_id").alias("n"), F.sum(F.length("truth")).alias("chars")).first()
    if (size.chars or 0) <= most:
        covers = _covering(stitched, hits)
    else:
        covers = stitched.select("raw", F.explode("asked").alias("a")).select("raw", "a.*").join(hits, "query_id").where(T.covered(F.col("truth"), F.col("raw")) == 1)
    numbers = range(many // 62 + 1)
    covers = covers.groupBy("query_id").agg(*(F.bit_or(F.col("found")[i]).alias(f"f{i}") for i in numbers))
    recalled = covers.agg(*(F.coalesce(F.sum(F.shiftright(f"f{i // 62}", i % 62).bitwiseAND(F.lit(1))), F.lit(0)).alias(f"r{i}") for i in range(many))).first()
    total = max(1, size.n)  # a query without results counts with zeros
    means = [[v / total for v in (recalled[i], *sums[3 * i : 3 * i + 3])] for i in range(many)]  # recall, mean distance, redundancy, breadth
    out = []
    for i, p in enumerate(grid):
        q = quotas.index((p.gamma, p.top_k))
        three = [means[q], means[len(quotas) + q], means[2 * len(quotas) + i]]
        out.append((p.sweep_idx, p.mmr_lambda, p.tau_dup, p.gamma, p.top_k, window_size, *(float(m[j]) for j in range(4) for m in three)))
    names = SWEEP_COLUMNS[5:-1]
    table = rows.sparkSession.createDataFrame(out, "sweep_idx int, mmr_lambda double, tau_dup double, gamma double, top_k int, window_size int, " + ", ".join(f"{n} double" for n in names))
    return table.select("sweep_idx", "mmr_lambda", "tau_dup", "gamma", "top_k", "window_size", *(F.round(n, 6).alias(n) for n in names))


def _covering(texts: DataFrame, truths: DataFrame) -> DataFrame:
    """(query_id, found) of those that ask for a text which covers their truth (see text.covered): the truths' words are sent to all tasks, and a text's words are found once for all that ask.

    texts: raw, asked array<struct<query_id, found>>; truths: query_id, truth.
    """
    words = F.transform(F.transform(T.pieces(F.col("truth")), T.words), lambda p: F.array_join(p, " "))
    known = truths.select("query_id", words.alias("parts")).toArrow().combine_chunks().sort_by("query_id")
    shared = texts.sparkSession.sparkContext.broadcast((known["query_id"].to_numpy(), known["parts"].combine_chunks()))
    kind = {f.name: f.dataType.simpleString() for f in texts.schema["asked"].dataType.elementType}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = shared.value
        for b in batches:
            asked = b.column(1)
            each, flat = np.diff(asked.offsets.to_numpy()), asked.flatten()
            query = flat.field("query_id").to_numpy()
            start, stop = np.searchsorted(names, query, "left").tolist(), np.searchsorted(names, query, "right").tolist()
            kept, at = [], 0
            for have, n in zip(b.column(0), each.tolist()):
                have = set(have.as_py())
                for i in range(at, at + n):
                    if any(_covers(p.split(), have) for j in range(start[i], stop[i]) for p in parts[j].as_py()):
                        kept.append(i)
                at += n
            rows = flat.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.field("query_id"), rows.field("found")], ["query_id", "found"])

    return texts.select(F.array_distinct(T.words(F.col("raw"))).alias("have"), "asked").mapInArrow(apply, f"query_id {kind['query_id']}, found {kind['found']}")


def _covers(part: list[str], have: set[str]) -> bool:
    n = len(part)
    return n > 0 and sum(map(have.__contains__, part)) / n >= (1 if n <= 3 else 0.85)


def semantic_scores(rows: DataFrame, key: str, truth: str, answers: dict[str, str], embedder: Embedder) -> DataFrame:
    """(key, name ...): for each named answer the greatest cosine of its vector with that of a part of the truth; at least 0.

    rows: a key, the truth and the answers' columns or paths. Blank texts are embedded as a blank.
    """
    text = lambda c: F.when(F.coalesce(c, F.lit("")) == "", " ").otherwise(c)
    parts = rows.select(key, F.explode(T.pieces(F.col(truth))).alias("t"), F.lit("").alias("name")).select(key, "name", text(F.col("t")).alias("t"))
    given = None
    for name, path in answers.items():
        one = rows.select(key, F.lit(name).alias("name"), text(F.expr(path)).alias("t"))
        given = one if given is None else given.unionByName(one)
    parts, given = (embedder.embed(d, "t", "v").select(key, "name", "v") for d in (parts, given))
    pairs = given.join(parts.select(key, F.col("v").alias("part")), key)
    cosine = V.dot(F.col("v"), F.col("part")) / (V.norm(F.col("v")) * V.norm(F.col("part")) + F.lit(1e-9))
    best = pairs.groupBy(key, "name").agg(F.greatest(F.lit(0.0), F.max(F.when(F.isnan(cosine), 0.0).otherwise(cosine))).alias("score"))
    return best.groupBy(key).pivot("name", list(answers)).agg(F.first("score"))


def requested_points(rows: DataFrame, wanted: list[int] | None) -> tuple[DataFrame, list[int]]:
    """The rows of valid grid points (sweep_idx from 0), of those asked for if any are, and which of these have no rows."""
    valid = rows.where(F.coalesce(F.col("sweep_idx"), F.lit(-1)) >= 0)
    if wanted is None:
        return valid, []
    asked = rows.sparkSession.createDataFrame([(int(w),) for w in sorted(set(wanted))], "sweep_idx int")
    missing = asked.join(valid.select("sweep_idx").distinct(), "sweep_idx", "left_anti").orderBy("sweep_idx")
    return valid.join(F.broadcast(asked), "sweep_idx", "left_semi"), [r.sweep_idx for r in missing.collect()]


def point_report(scored: DataFrame, values: list[str]) -> DataFrame:
    """One row per grid point: its queries and the mean of each value, in the order of the points."""
    return scored.groupBy("sweep_idx").agg(F.count("*").alias("queries"), *(F.round(F.avg(F.when(~F.isnan(v), F.col(v))), 6).alias(f"avg_{v}") for v in values)).orderBy("sweep_idx")
