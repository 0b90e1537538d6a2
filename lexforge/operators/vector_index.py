"""Inverted-file and product-quantisation index: training, assignment, encoding, posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def matrix(table: DataFrame, key: str, vector: str, most: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a table of model parameters (centroids, code words), whose number of rows is checked first."""
    rows = table.select(key, vector).where(f"{key} is not null and {vector} is not null").orderBy(key).limit(most + 1).toArrow()
    if len(rows) > most:
        raise ValueError(f"{len(rows)} rows are too many for a model that is sent to all tasks")
    values = np.array(rows[vector].to_pylist(), np.float64)
    return rows[key].to_numpy(), values.reshape(len(rows), -1)


def code_book(codebook: DataFrame, most: int = 65_536) -> np.ndarray:
    """book[m, code]: at most 256 code words in each part, by the type of a code; of a code that is there twice the least vector."""
    words = codebook.where("code between 0 and 255 and m >= 0").groupBy("m", "code").agg(F.min("vec").alias("vec"))
    rows = words.limit(most + 1).toArrow()
    if len(rows) > most:
        raise ValueError(f"more than {most} code words are no code book")
    m, code, vec = (rows[c].to_pylist() for c in ("m", "code", "vec"))
    book = np.zeros((max(m, default=0) + 1, 256, len(vec[0]) if vec else 1))
    for i, j, v in zip(m, code, vec):
        book[i, j] = v
    return book


def same_width(df: DataFrame, vector: str, parts: int = 1) -> int:
    """The vectors' number of dimensions; it is an error if they differ in it or the parts don't divide it."""
    widths = df.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if widths.a != widths.b:
        raise ValueError(f"vectors of {widths.a} to {widths.b} dimensions")
    if widths.a and widths.a % parts:
        raise ValueError(f"{parts} parts don't divide {widths.a} dimensions")
    return widths.a or 0


def random_rotation(width: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix, to be kept with the index and applied to documents and queries alike."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _values(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def rotate(df: DataFrame, key: str, vector: str, rotation: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rotation)
    kind = df.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_values(b.column(1)) @ shared.value), pa.list_(pa.float64()))], [key, vector])

    return df.select(key, vector).mapInArrow(apply, f"{key} {kind}, {vector} array<double>")


def train_centroids(df: DataFrame, vector: str, count: int, iterations: int = 20, seed: int = 0) -> DataFrame:
    """(centroid_id, vec): k-means of a table of vectors, centroids of length one; as many as vectors if there are fewer."""
    data = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, count), maxIter=iterations, seed=seed).fit(data)
    rows = [(i, [float(x) for x in c / max(np.linalg.norm(c), 1e-10)]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "centroid_id int, vec array<double>")


def train_codebook(df: DataFrame, vector: str, parts: int, codes: int = 256, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(m, code, vec): k-means of each part of the vectors; no padding code words."""
    width = df.select(F.size(vector)).where(F.col(vector).isNotNull()).first()[0]
    if width % parts:
        raise ValueError(f"{parts} parts don't divide {width} dimensions")
    step, rows = width // parts, []
    for m in range(parts):
        data = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.slice(F.col(vector).cast("array<double>"), m * step + 1, step)).alias("features"))
        centres = KMeans(k=codes, maxIter=iterations, seed=seed).fit(data).clusterCenters()
        rows += [(m, i, [float(x) for x in c]) for i, c in enumerate(centres)]
    return df.sparkSession.createDataFrame(rows, "m int, code smallint, vec array<double>")


def nearest_places(v: np.ndarray, names: np.ndarray, centres: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of v, ranks from 0 and places of the `count` nearest centres, by squared distance and name."""
    n = min(count, len(names))
    d = np.round(np.maximum(0.0, (v**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * v @ centres.T), 12)
    row, best = np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n])
    order = np.lexsort((names[best], d[row, best], row))
    row, best = row[order], best[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < n], rank[rank < n], best[rank < n]


def nearest_rows(df: DataFrame, key: str, vector: str, ids: np.ndarray, vecs: np.ndarray, count: int, id_name: str) -> DataFrame:
    """(key, rank, id, d2): the `count` nearest of a model's vectors for every row, by squared distance and id; vectors of length zero are padding."""
    keep = np.linalg.norm(vecs, axis=1) > 0
    shared = df.sparkSession.sparkContext.broadcast((ids[keep], vecs[keep]))
    kind = df.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres = shared.value
        for b in batches:
            if not b.num_rows or not min(count, len(names)):
                continue
            vectors = _values(b.column(1))
            step = max(1, 4_000_000 // len(names))  # rows at a time, so that the distances stay small
            for s in range(0, len(vectors), step):
                v = vectors[s : s + step]
                row, rank, best = nearest_places(v, names, centres, count)
                d2 = ((v[row] - centres[best]) ** 2).sum(1)  # exactly, for the few that are kept
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s + row)), pa.array(rank + 1, pa.int32()), pa.array(names[best].astype(np.int32)), pa.array(d2)], [key, "rank", id_name, "d2"])

    rows = df.select(key, vector).where(F.col(vector).isNotNull())
    return rows.mapInArrow(search, f"{key} {kind}, rank int, {id_name} int, d2 double")


def nearest_of(df: DataFrame, key: str, vector: str, centroids: DataFrame, count: int, block: int = 65_536) -> DataFrame:
    """(key, rank, centroid_id, d2): the `count` nearest centroids of every row. Centroids are sent to all tasks, more than `block` of them in parts, whose nearest are merged."""
    parts = max(1, -(-centroids.count() // block))
    if parts == 1:
        return nearest_rows(df, key, vector, *matrix(centroids, "centroid_id", "vec", block), count, "centroid_id")
    near = None
    for i in range(2 * parts):
        own = centroids.where(F.pmod(F.xxhash64("centroid_id"), F.lit(2 * parts)) == i)
        found = nearest_rows(df, key, vector, *matrix(own, "centroid_id", "vec", block), count, "centroid_id")
        near = found if near is None else near.unionByName(found)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("d2", 12), "centroid_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= count)


def assign(df: DataFrame, key: str, vector: str, centroids: DataFrame) -> DataFrame:
    """(key, centroid_id, d2): the nearest centroid, the least id on ties."""
    return nearest_of(df, key, vector, centroids, 1).drop("rank")


def lloyd_step(df: DataFrame, key: str, vector: str, centroids: DataFrame) -> DataFrame:
    """(centroid_id, dim, mean, n): the means of the vectors at each centroid, one row per dimension; sums are combined before the shuffle."""
    placed = df.join(assign(df, key, vector, centroids).select(key, "centroid_id"), key)
    flat = placed.select("centroid_id", F.posexplode(vector).alias("dim", "x"))
    return flat.groupBy("centroid_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def encode(df: DataFrame, key: str, vector: str, codebook: DataFrame) -> DataFrame:
    """(key, pq_code): the nearest code word of every part, the least code on ties."""
    shared = df.sparkSession.sparkContext.broadcast(code_book(codebook))
    kind = df.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        step = book.shape[2]
        for b in batches:
            if b.num_rows:
                v = _values(b.column(1))
                codes = [np.round((v[:, m * step : (m + 1) * step] ** 2).sum(1)[:, None] + (book[m] ** 2).sum(1) - 2 * v[:, m * step : (m + 1) * step] @ book[m].T, 12).argmin(1) for m in range(len(book))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.stack(codes, 1).astype(np.int16).tolist(), pa.list_(pa.int16()))], [key, "pq_code"])

    return df.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(apply, f"{key} {kind}, pq_code array<smallint>")


def valid_code(code, parts: int = 8):
    return (F.size(code) == parts) & F.coalesce(F.forall(code, lambda c: c.between(0, 255)), F.lit(False))


def decode(df: DataFrame, key: str, code: str, codebook: DataFrame, into: str = "embedding") -> DataFrame:
    """(key, embedding): the code words end to end; rows whose code isn't valid are left out."""
    book = code_book(codebook)
    shared = df.sparkSession.sparkContext.broadcast(book)
    kind = df.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for b in batches:
            if b.num_rows:
                c = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
                v = np.concatenate([book[m][c[:, m]] for m in range(len(book))], 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1]).cast(pa.list_(pa.float64()))], [key, into])

    rows = df.where(valid_code(F.col(code), len(book))).select(key, code)
    return rows.mapInArrow(apply, f"{key} {kind}, {into} array<double>")


def posting_lists(postings: DataFrame, top_r: int | None = None, parts: int = 8) -> DataFrame:
    """Valid postings, each chunk once per centroid, with `place` in its list (by chunk_id as text); the first top_r of each list.

    With row_number, Spark drops what is beyond top_r before the shuffle, which bounds what a hot list sends.
    """
    rows = postings.where(valid_code(F.col("pq_code"), parts)).select("centroid_id", "chunk_id", "vector_id", "pq_code").dropDuplicates(["centroid_id", "chunk_id"])
    if top_r is None:
        return rows
    place = F.row_number().over(Window.partitionBy("centroid_id").orderBy("chunk_id"))
    return rows.withColumn("place", place).where(F.col("place") <= top_r)


def rough_near(q: np.ndarray, v: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of q and v that may be among the k nearest of a row of q and no farther than its bound: all of these, and few others. By squared distances in single precision, with room for their error."""
    with np.errstate(invalid="ignore", over="ignore"):
        ends = [(x**2).sum(1) for x in (q, v)]
        longest = sum(math.sqrt(float(x[np.isfinite(x)].max(initial=0.0))) for x in ends)
        kind = np.float32 if longest < 1e15 else np.float64
        left, right = np.c_[-2 * q, np.ones(len(q))].astype(kind), np.c_[v, ends[1]].astype(kind).T.copy()
        most = ((bound + 1e-6) ** 2 - ends[0]).astype(kind)
    slack, rows, columns = 1e-5 * longest**2 + 1e-12, [], []
    step = max(1, (1 << 21) // max(1, len(v)))
    for s in range(0, len(q) if len(v) else 0, step):
        d = left[s : s + step] @ right  # without the squares of q
        limit = most[s : s + step]
        if k < len(v) and (new := np.flatnonzero(~np.isfinite(limit))).size:
            limit = limit.copy()
            known = d[new] if len(new) < len(limit) else d
            limit[new] = np.partition(np.where(np.isfinite(known), known, np.inf), k - 1, axis=1)[:, k - 1] + slack
        at = np.flatnonzero(d <= (limit + slack)[:, None])
        rows.append(s + at // len(v))
        columns.append(at % len(v))
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def exact_search(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, metric: str = "l2", block: int = 4096) -> DataFrame:
    """(query_id, rank, key, distance): the k nearest rows for every query, never itself; ties by key.

    Queries come in blocks of bounded size, each sent to all tasks; a task keeps
    k rows per query, so that queries x k rows per task are shuffled.
    """
    blocks = max(1, -(-queries.count() // block))
    kind = base.schema[key].dataType.simpleString()
    near = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
        names, values = matrix(part, key, vector, 4 * block)
        shared = base.sparkSession.sparkContext.broadcast((names, values))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            if not len(names):
                return
            best_q, best_d, best_k = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            bound = np.full(len(names), np.inf)
            for b in batches:
                if not b.num_rows:
                    continue
                # Copies of a vector are one point, of which the k + 1 least keys can matter.
                own = b.column(0).to_numpy()
                v, point = np.unique(_values(b.column(1)), axis=0, return_inverse=True)
                order = np.lexsort((own, point.reshape(-1)))
                first, size = np.unique(point.reshape(-1)[order], return_index=True, return_counts=True)[1:]
                if metric == "cosine":
                    with np.errstate(invalid="ignore", divide="ignore"):
                        d = 1 - (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1))
                    d = np.where(np.isfinite(d), d, np.inf)
                    at = min(k, len(v) - 1)
                    # All that may be among the nearest but for the error of these distances; then exactly.
                    i, j = np.nonzero((d <= np.partition(d, at, axis=1)[:, at, None] + 1e-6) & np.isfinite(d))
                else:
                    i, j = rough_near(q, v, k + 1, bound)  # one of them may be the query itself
                if metric == "cosine":
                    d = 1 - (q[i] * v[j]).sum(1) / (np.linalg.norm(q[i], axis=1) * np.linalg.norm(v[j], axis=1))
                else:
                    with np.errstate(invalid="ignore"):
                        d = np.sqrt(((q[i] - v[j]) ** 2).sum(1))
                    i, j, d = (x[np.isfinite(d)] for x in (i, j, d))
                n = np.minimum(size[j], k + 1)
                key_at = np.repeat(first[j] - np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)[: len(n)], n) + np.arange(n.sum())
                near_q, near_d, near_k = np.repeat(i, n), np.round(np.repeat(d, n), 9), own[order][key_at]
                other = near_k != names[near_q]
                best_q, best_d, best_k = np.r_[best_q, near_q[other]], np.r_[best_d, near_d[other]], np.r_[best_k, near_k[other]]
                order = np.lexsort((best_k, best_d, best_q))
                best_q, best_d, best_k = best_q[order], best_d[order], best_k[order]
                nth = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
                bound[best_q[nth == k - 1]] = best_d[nth == k - 1]
                best_q, best_d, best_k = best_q[nth < k], best_d[nth < k], best_k[nth < k]
            yield pa.RecordBatch.from_pydict({"query_id": names[best_q], "other": best_k, "distance": best_d})

        found = base.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(search, f"query_id {kind}, other {kind}, distance double")
        near = found if near is None else near.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "other"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("other").alias(key), "distance")
