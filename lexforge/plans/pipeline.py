"""Whole jobs: building an index, retrieving from it, answering and judging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import retrieval as R
from lexforge.operators import text_tables as X
from lexforge.operators import vector_index as I
from lexforge.plans.adapters import Embedder, ExtractiveGenerator, OverlapJudge
from lexforge.sources.readers import cut


def build_index(docs: DataFrame, key: str, text: str, embedder: Embedder, centroids: int = 256, parts: int = 8, codes: int = 256, size: int = 1500, overlap: int = 300, sample: int = 100_000, rotated: bool = False) -> dict[str, DataFrame]:
    """centroids, codebook, postings and metadata of a table of documents.

    Copies are indexed once. Models are trained on at most `sample` chunks (those
    with the least hashes); all chunks are assigned and encoded. rotated: vectors are turned by a random rotation first, which
    is kept in the index (a row of it for each dimension) for the queries.
    """
    unique = X.deduplicate(docs, key, text)
    clean = docs.join(unique.select(F.col("doc_id").alias(key)), key, "left_semi")  # the texts with their line ends, for the clauses
    chunks = embedder.embed(X.chunk(clean, key, text, size=size, overlap=overlap), "text", "embedding")
    chunks = chunks.withColumn("vector_id", F.xxhash64("chunk_id"))
    index = {}
    if rotated:
        width = chunks.select(F.size("embedding")).first()[0]
        turn = I.random_rotation(width)
        index["rotation"] = docs.sparkSession.createDataFrame([(i, row.tolist()) for i, row in enumerate(turn)], "dim int, vec array<double>")
        chunks = chunks.drop("embedding").join(I.rotate(chunks, "chunk_id", "embedding", turn), "chunk_id")
    chunks = cut(chunks)
    I.same_width(chunks, "embedding", parts)
    train = chunks.orderBy(F.xxhash64("chunk_id", F.lit(1))).limit(sample).select("embedding")
    cen, book = I.train_centroids(train, "embedding", centroids), I.train_codebook(train, "embedding", parts, codes)
    placed = I.assign(chunks, "chunk_id", "embedding", cen).select("chunk_id", "centroid_id")
    postings = chunks.select("chunk_id", "vector_id").join(placed, "chunk_id").join(I.encode(chunks, "chunk_id", "embedding", book), "chunk_id")
    metadata = chunks.drop("embedding").join(placed, "chunk_id")
    return index | {"centroids": cen, "codebook": book, "postings": postings.select("centroid_id", "chunk_id", "vector_id", "pq_code"), "metadata": metadata}


def retrieve(index: dict[str, DataFrame], queries: DataFrame, embedder: Embedder, k: int = 10, nprobe: int = 8, top_r: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, dist_q, text): the nearest chunks of every query, by probing the index; top_r cuts the lists as the reference does."""
    q = embedder.embed(queries.withColumn("_text", T.search_text(F.col("query"))), "_text", "embedding").select("query_id", "embedding")
    if "rotation" in index:
        q = I.rotate(q, "query_id", "embedding", I.matrix(index["rotation"], "dim", "vec")[1])
    parts = index["codebook"].agg(F.max("m")).first()[0] + 1
    if top_r is None:
        near = R.nearest_probed(q, index["postings"], index["centroids"], index["codebook"], k, nprobe, parts)
    else:
        found = R.candidates(q, index["postings"], index["centroids"], nprobe, top_r, parts)
        near = R.nearest(R.with_distance(found, q, index["codebook"]), k)
    return near.join(index["metadata"].select("chunk_id", "text"), "chunk_id").select("query_id", "rank", "chunk_id", "dist_q", "text")


def answer_and_judge(items: DataFrame) -> DataFrame:
    """items (query, ground_truth, b1_contexts, b2_contexts, mmr_contexts) with an answer from each list, its coverage and unique ratio, and the winner."""
    generator, judge = ExtractiveGenerator(), OverlapJudge()
    names = ("b1", "b2", "mmr")
    for n in names:
        items = items.withColumn(f"answer_{n}", generator.answer(F.col("query"), F.coalesce(f"{n}_contexts", F.array().cast("array<string>"))))
    for n in names:
        items = items.withColumn(f"{n}_coverage", T.answer_coverage(F.col("ground_truth"), F.col(f"answer_{n}"))).withColumn(f"{n}_unique_ratio", T.unique_ratio(F.col(f"answer_{n}")))
    return items.withColumn("winner", judge.winner(F.col("ground_truth"), dict(zip("ABC", (F.col(f"answer_{n}") for n in names)))))
