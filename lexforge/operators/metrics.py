"""Metrics of retrieval results and of generated answers, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions import vectors as V


def list_distances(results: DataFrame, query: str | list[str] = "query_id", vector: str = "embedding", threshold: float = 0.7) -> DataFrame:
    """(query_id, ild, redundancy): mean distance of the pairs of each result list (0 below two rows), and the share of pairs
    whose cosine is above the threshold. Lists hold k rows, so pairs are made within one row's array."""
    query = [query] if isinstance(query, str) else query
    lists = results.groupBy(*query).agg(F.sort_array(F.collect_list(F.struct("rank", vector))).alias("l"))
    n = F.size("l")
    vec = lambda i: F.element_at("l", i)[vector]
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.filter(F.sequence(F.lit(1), n), lambda j: j > i), lambda j: F.struct(V.distance(vec(i), vec(j)).alias("d"), V.cosine(vec(i), vec(j)).alias("c")))))
    rows = lists.select(*query, F.explode_outer(pairs).alias("p"))
    return rows.groupBy(*query).agg(F.coalesce(F.avg("p.d"), F.lit(0.0)).alias("ild"), F.coalesce(F.avg(F.when(F.col("p.c").isNotNull(), (F.col("p.c") > threshold).cast("double"))), F.lit(0.0)).alias("redundancy"))


def breadth(results: DataFrame, nprobe: int, query: str = "query_id") -> DataFrame:
    """(query_id, centroids, centroid_ratio, documents, local, global, local_ratio)."""
    return results.groupBy(query).agg(
        F.count_distinct("centroid_id").alias("centroids"), F.round(F.count_distinct("centroid_id") / F.lit(nprobe), 6).alias("centroid_ratio"), F.count_distinct("doc_id").alias("documents"),
        F.count_if("is_local").alias("local"), F.count_if(~F.col("is_local")).alias("global"), F.round(F.avg(F.col("is_local").cast("double")), 6).alias("local_ratio"),
    )


def quartile_distance(results: DataFrame, query: str = "query_id", value: str = "dist_q") -> DataFrame:
    """(query_id, p25): the first quartile of the finite values, between rows if need be."""
    fine = results.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return fine.groupBy(query).agg(F.percentile(value, 0.25).alias("p25"))


def recall_mrr(rows: DataFrame, key: str, contexts: Column, truth: Column, k: int = 5) -> DataFrame:
    """(key, recall, mrr): whether one of the first k contexts is part of the truth, and 1 / the first one's place."""
    want = T.normalize(truth)
    hits = F.transform(F.slice(contexts, 1, k), lambda c: (T.normalize(c) != "") & F.contains(want, T.normalize(c)))
    first = F.array_position(hits, True)
    return rows.select(key, F.coalesce(first > 0, F.lit(False)).cast("double").alias("recall"), F.when(first > 0, 1.0 / first).otherwise(0.0).alias("mrr"))


_SCORES = ("comprehensiveness", "conciseness", "faithfulness")


def judge_statistics(rows: DataFrame, judged: str, by: list[str]) -> DataFrame:
    """Wins, ties, rates and mean scores per group; `A|B` counts for A, what isn't A, B or C is a tie; scores count where all three are there."""
    raw = F.upper(F.trim(F.coalesce(F.nullif(F.trim(F.col(f"{judged}.winner")), F.lit("")), F.lit("TIE"))))
    winner = F.trim(F.split(raw, r"\|")[0])
    score = {x: F.coalesce(F.try_element_at(F.col(f"{judged}.scores"), F.lit(f"Answer_{x}")), F.try_element_at(F.col(f"{judged}.scores"), F.lit(f"answer_{x.lower()}"))) for x in "ABC"}
    whole = score["A"].isNotNull() & score["B"].isNotNull() & score["C"].isNotNull()
    rows = rows.select(*by, winner.alias("winner"), whole.alias("whole"), *(score[x].alias(x) for x in "ABC"))
    out = [F.count("*").alias("judged")]
    for x, name in (("A", "b1"), ("B", "b2"), ("C", "mmr")):
        out += [F.count_if(F.col("winner") == x).alias(f"wins_{name}"), F.round(F.avg((F.col("winner") == x).cast("double")), 6).alias(f"rate_{name}")]
    out.append(F.count_if(~F.col("winner").isin("A", "B", "C")).alias("ties"))
    for x, name in (("A", "b1"), ("B", "b2"), ("C", "mmr")):
        out += [F.round(F.avg(F.when(F.col("whole"), F.coalesce(F.col(f"{x}.{s}"), F.lit(0.0)))), 6).alias(f"{s}_{name}") for s in _SCORES]
    return rows.groupBy(*by).agg(*out)


def first_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
