"""Parameter grids and their reports."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, lam=(0.3, 0.5, 0.7), tau=(0.3, 0.5, 0.7), gamma=(0.3, 0.5, 0.7), top_k=(5, 10, 20)) -> DataFrame:
    """(sweep_idx, mmr_lambda, tau_dup, gamma, top_k): all combinations, in order. A grid is a handful of literals."""
    rows = [(i, *p) for i, p in enumerate(product(lam, tau, gamma, top_k))]
    return spark.createDataFrame(rows, "sweep_idx int, mmr_lambda double, tau_dup double, gamma double, top_k int")


def rollup_report(rows: DataFrame, levels: list[str], values: list[str]) -> DataFrame:
    """Counts and means of the values for every level and its subtotals; `level` says how many columns are grouped by."""
    means = [F.round(F.avg(F.when(~F.isnan(v), F.col(v))), 10).alias(f"avg_{v.split('.')[-1]}") for v in values]
    depth = sum((1 - F.grouping(c)).cast("int") for c in levels)
    return rows.rollup(*levels).agg(depth.alias("level"), F.count("*").alias("n"), *means)


def cut_by_quota(nearest: DataFrame, points: DataFrame) -> DataFrame:
    """(sweep_idx, query_id, rank, chunk_id, tier): the hybrid result of every grid point from one candidate list.

    nearest: query_id, chunk_id, is_local, own (its place in the local or global list). Candidates don't depend on the
    grid; only places up to the greatest k are joined to the points that share a k, and points are few.
    """
    from pyspark.sql import Window

    from lexforge.functions.vectors import local_quota

    most = points.agg(F.max("top_k")).first()[0]
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in r.asDict().items())) for r in points.select("sweep_idx", "gamma", "top_k").collect()))
    rows = nearest.where(F.col("own") <= most).withColumn("p", F.explode(each)).where(F.col("own") <= F.col("p.top_k"))
    quota = local_quota(F.col("p.gamma"), F.col("p.top_k"))
    tier = F.when(F.col("is_local"), F.when(F.col("own") <= quota, 0).otherwise(2)).otherwise(F.when(F.col("own") <= F.col("p.top_k") - quota, 1).otherwise(3))
    rows = rows.withColumn("tier", tier)
    rank = F.row_number().over(Window.partitionBy("p.sweep_idx", "query_id").orderBy("tier", "own"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("p.top_k")).select(F.col("p.sweep_idx").alias("sweep_idx"), "query_id", "rank", "chunk_id", "tier")
