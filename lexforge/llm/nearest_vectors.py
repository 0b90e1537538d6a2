"""Problem 1: the k most similar vectors of every vector.

A hash-prefix forest. In each tree every vector has a long hash string (signs
of random projections), and the tree is the sorted array of these strings, cut
over tasks by range. The vectors with the longest common prefix stand around a
vector in the array. Descending gives, per tree, how many vectors share each
length of prefix; these counts, summed over the trees, say to which length all
trees have to ascend together to offer enough candidates. The candidates are
compared exactly, and the trees' nearest are merged.

A task's part of an array comes with a margin of the parts beside it, so that a
cut separates nobody from their neighbours. The cuts, and the margins' ends,
are quantiles of a sample of the strings, a few for each part.

Vectors arrive as codes of a product quantiser: equal codes are equal vectors,
which are hashed once and come back as copies at distance 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import cut

#: Bits of a hash string, and of the code's own hash that follows it in the sort key, so that equal strings can be cut apart too.
_BITS, _REST = 48, 14
#: Quantiles of the sample for each part; the margin is as many of them on either side of a cut.
_SAMPLED, _MARGIN = 200, 4


def decode(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The vectors of packed codes: book[m, code] end to end, m = 0, 1, ..."""
    parts = [book[m][((codes >> np.int64(8 * m)) & 255).astype(np.int64)] for m in range(len(book))]
    return np.concatenate(parts, axis=1)


def _common_prefix(keys: np.ndarray) -> np.ndarray:
    """Bits in common of each hash string and the next in the sorted array."""
    labels = keys >> np.int64(_REST)
    differ = (labels[1:] ^ labels[:-1]).astype(np.float64)
    return np.where(differ == 0, _BITS, _BITS - 1 - np.floor(np.log2(np.maximum(differ, 1)))).astype(np.int64)


def _runs(prefix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the first and one past the last of those that share `length` bits with it."""
    edge = np.flatnonzero(np.r_[True, prefix < length, True])
    size = np.diff(edge)
    return np.repeat(edge[:-1], size), np.repeat(edge[1:], size)


class PrefixForest:
    """trees, candidates: more of either means better recall; reach: most candidates on either side in one tree
    (those with the longest common prefix stand next); block: entries of one task's part of a sorted array.
    With reach and candidates as great as the collection, every vector is compared with every other: the exact result."""

    #: Prefix lengths at which the trees ascend together, five counts to a packed number.
    LENGTHS = (45, 42, 39, 36, 33, 30, 27, 24, 21, 18, 15, 12, 9, 6, 3)
    _WIDTH = 12

    def __init__(self, points: DataFrame, book: np.ndarray, k: int, trees: int = 6, candidates: int = 400, reach: int = 112, block: int = 120_000, seed: int = 42):
        self.points, self.k, self.trees, self.candidates, self.reach = points, k, trees, candidates, reach
        self.count = points.count()
        self.parts = max(1, -(-self.count // block))
        self.spark = points.sparkSession
        rng = np.random.default_rng(seed)
        width = book.shape[0] * book.shape[2]
        # Projections of the codebook's mean stand for those of the data's, so that nothing has to be fitted.
        planes = rng.standard_normal((trees * _BITS, width)).astype(np.float32)
        offset = planes @ book.mean(axis=1).reshape(-1)
        # Squared distance of two code words of a part: those of two vectors are sums of eight of them.
        apart = np.stack([((b[:, None, :] - b[None]) ** 2).sum(2) for b in book.astype(np.float64)]).reshape(len(book), -1)
        self.shared = self.spark.sparkContext.broadcast((book, planes, offset, apart))

    def _labels(self) -> DataFrame:
        """(code, keys): the sort key of every point in each tree."""
        shared, trees = self.shared, self.trees

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, planes, offset, _ = shared.value
            weights = np.int64(1) << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
            for batch in batches:
                codes = batch.column(0).to_numpy()
                signs = (decode(codes, book) @ planes.T > offset).reshape(len(codes), trees, _BITS)
                rest = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _REST)).astype(np.int64)
                keys = (signs.astype(np.int64) @ weights << np.int64(_REST)) | rest[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, trees, dtype=np.int32)), pa.array(keys.reshape(-1)))], ["code", "keys"])

        return cut(self.points.select("code").mapInArrow(hashed, "code bigint, keys array<bigint>"))

    def _cuts(self, labels: DataFrame) -> list[np.ndarray]:
        """Of each tree, quantiles of a sample of its keys, _SAMPLED for each part: 8 bytes each, in proportion to the tasks."""
        wanted = self.parts * _SAMPLED
        share = min(1.0, 1.5 * wanted / max(1, self.count))
        rows = labels.where(F.abs(F.hash("code")) < int(share * (2**31 - 1))).select("keys").limit(4 * wanted).toArrow()
        keys = rows["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.trees)
        out = []
        for t in range(self.trees):
            own = np.sort(keys[:, t])
            out.append(own[np.linspace(0, len(own) - 1, wanted + 1).astype(np.int64)[1:-1]] if self.parts > 1 and len(own) else np.empty(0, np.int64))
        return out

    def _dealt(self, rows: DataFrame, cuts, also: str = "") -> DataFrame:
        """(part, inner, tree key, code ...): every key in its part, and in the next one if it is in that one's margin (inner is false there)."""
        trees, parts = self.trees, self.parts
        wide = bool(also)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            quantiles = cuts.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = batch.column(0).to_numpy()
                keys = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, trees)
                for t in range(trees):
                    own = keys[:, t]
                    place = np.searchsorted(quantiles[t], own, side="right")  # in which of the sample's steps
                    part, step = place // _SAMPLED, place % _SAMPLED
                    part = np.minimum(part, parts - 1)
                    before = np.flatnonzero((step < _MARGIN) & (part > 0))
                    after = np.flatnonzero((step >= _SAMPLED - _MARGIN) & (part < parts - 1))
                    at = np.concatenate([np.arange(len(own)), before, after])
                    to = np.concatenate([part, part[before] - 1, part[after] + 1])
                    inner = np.arange(len(at)) < len(own)
                    columns = [pa.array((to * trees + t).astype(np.int32)), pa.array(inner), pa.array(own[at]), pa.array(codes[at])]
                    if wide:
                        columns.append(batch.column(2).take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays(columns, ["part", "inner", "key", "code", *([also] if wide else [])])

        dealt = rows.mapInArrow(deal, "part int, inner boolean, key bigint, code bigint" + (f", {also} int" if wide else ""))
        return dealt.repartitionById(self.parts * trees, F.col("part"))

    def neighbours(self) -> DataFrame:
        """(code, near): the k nearest other codes of every code, as an array of (distance squared, code), nearest first."""
        lengths, k, reach, shared, wanted, width = self.LENGTHS, self.k, self.reach, self.shared, self.candidates, self._WIDTH
        most = (1 << width) // (2 * self.trees) - 1

        def array(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
            """One part in the order of its keys, entry after entry of one tree."""
            rows = [b for b in batches if b.num_rows]
            if rows:
                table = pa.Table.from_batches(rows)
                part, key, code = (table[c].to_numpy() for c in ("part", "key", "code"))
                order = np.lexsort((code, key, part))
                edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
                for s, e in zip(edge[:-1], edge[1:]):
                    yield table, order[s:e]

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, order in array(batches):
                code, inner = table["code"].to_numpy()[order], table["inner"].to_numpy()[order]
                prefix = _common_prefix(table["key"].to_numpy()[order])
                packed = np.zeros((3, len(code)), np.int64)
                for i, length in enumerate(lengths):
                    s, e = _runs(prefix, length)
                    packed[i // 5] |= np.minimum(np.minimum(e - s - 1, 2 * reach), most) << np.int64(width * (i % 5))
                yield pa.RecordBatch.from_arrays([pa.array(code[inner]), *(pa.array(p[inner]) for p in packed)], ["code", "n0", "n1", "n2"])

        def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            apart = shared.value[3]
            for table, order in array(batches):
                code, length = table["code"].to_numpy()[order], table["length"].to_numpy()[order]
                prefix = _common_prefix(table["key"].to_numpy()[order])
                n = len(code)
                start, end = np.zeros(n, np.int64), np.full(n, n, np.int64)
                for v in np.unique(length):
                    if v:
                        own = length == v
                        s, e = _runs(prefix, v)
                        start[own], end[own] = s[own], e[own]
                here = np.arange(n)
                start, end = np.maximum(start, here - reach), np.minimum(end, here + reach + 1)
                words = np.stack([(code >> np.int64(8 * m)) & 255 for m in range(len(apart))], 1).astype(np.uint16)
                mine = np.flatnonzero(table["inner"].to_numpy()[order])
                mine = mine[np.argsort((end - start)[mine], kind="stable")]  # rows of like length together
                f = 0
                while f < len(mine):
                    step = max(1, 300_000 // int((end - start)[mine[min(f + 4096, len(mine)) - 1]]))
                    own = mine[f : f + min(step, 4096)]
                    f += len(own)
                    most_wide = int((end - start)[own].max())
                    at = start[own][:, None] + np.arange(most_wide)
                    bad = (at >= end[own][:, None]) | (at == own[:, None])
                    at = np.minimum(at, n - 1)
                    distance = np.zeros(at.shape)
                    for m in range(len(apart)):
                        pair = words[:, m][at].astype(np.int32)
                        pair += words[own, m].astype(np.int32)[:, None] << 8
                        distance += apart[m][pair]
                    distance[bad] = np.inf
                    best = np.argpartition(distance, k - 1, axis=1)[:, :k] if most_wide > k else np.broadcast_to(np.arange(most_wide), at.shape)
                    row = np.repeat(np.arange(len(own)), best.shape[1])
                    column = best.reshape(-1)
                    d = distance[row, column]
                    ok = d < np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(code[own[row[ok]]]), pa.array(d[ok]), pa.array(code[at[row, column][ok]])], ["code", "distance", "other"])

        labels = self._labels()
        cuts = self.spark.sparkContext.broadcast(self._cuts(labels))
        counts = self._dealt(labels, cuts).mapInArrow(descend, "code bigint, n0 bigint, n1 bigint, n2 bigint")
        counts = counts.groupBy("code").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(3)))
        # The longest prefix at which all trees together have enough; none (0) takes the whole reach.
        count = [F.shiftright(F.col(f"n{i // 5}"), width * (i % 5)).bitwiseAND(F.lit((1 << width) - 1)) for i in range(len(lengths))]
        length = F.coalesce(*(F.when(c >= min(wanted, most * self.trees), F.lit(v)) for c, v in zip(count, lengths)), F.lit(0))
        again = labels.join(counts.select("code", length.alias("length")), "code").select("code", "keys", "length")
        found = self._dealt(again, cuts, "length").mapInArrow(ascend, "code bigint, distance double, other bigint")
        return found.groupBy("code").agg(F.slice(F.sort_array(F.collect_set(F.struct("distance", "other"))), 1, k).alias("near"))


def book_array(codebook: DataFrame) -> np.ndarray:
    """The codebook (m, code, vec) as an array; 256 codes for each m at most, so its size is bounded."""
    table = codebook.select("m", "code", "vec").where("code between 0 and 255 and m between 0 and 7").toArrow()
    m, code, vec = (table[c].to_pylist() for c in ("m", "code", "vec"))
    book = np.zeros((8, 256, len(vec[0])), np.float32)
    for i, j, v in zip(m, code, vec):
        book[i, j] = v
    return book


def nearest_vectors(postings: DataFrame, codebook: DataFrame, k: int = 5, **forest) -> DataFrame:
    """(vector_id, rank, other_id, distance): the k nearest other vectors of every vector, rank from 1.

    postings: vector_id, pq_code; further columns are ignored. A vector_id counts once (its least valid code, should
    there be several). Rows without an id, and codes that are null, of another length than eight, with a null or a
    value out of 0..255 take no part. Vectors with one code are copies: at distance 0 from each other, and ranked by
    id like all ties. With fewer than k other vectors, there are as many rows as others.
    """
    code = F.col("pq_code")
    valid = (F.size(code) == 8) & F.coalesce(F.forall(code, lambda c: c.between(0, 255)), F.lit(False))
    packed = F.lit(0).cast("long")
    for i in range(8):
        packed = packed.bitwiseOR(F.shiftleft(code[i].cast("long"), 8 * i))
    ids = postings.where(F.col("vector_id").isNotNull() & valid).select(F.col("vector_id").cast("long").alias("vector_id"), packed.alias("code"))
    members = cut(ids.groupBy("vector_id").agg(F.min("code").alias("code")))
    points = members.select("code").distinct()
    near = PrefixForest(points, book_array(codebook), k, **forest).neighbours()
    # Of a code's copies only the k + 1 with the least ids can be among another's k nearest.
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("vector_id"))).where(F.col("place") <= k + 1)
    copies = first.groupBy("code").agg(F.sort_array(F.collect_list("vector_id")).alias("ids"))
    own = points.select("code", F.lit(0.0).alias("distance"), F.col("code").alias("other"))
    others = near.select("code", F.inline("near")).select("code", "distance", "other")
    offered = own.unionByName(others).join(copies.withColumnRenamed("code", "other"), "other")
    lists = offered.groupBy("code").agg(F.collect_list(F.struct("distance", "ids")).alias("offers"))
    flat = F.flatten(F.transform("offers", lambda o: F.transform(o["ids"], lambda i: F.struct(o["distance"].alias("distance"), i.alias("id")))))
    lists = lists.select("code", F.slice(F.sort_array(flat), 1, k + 1).alias("best"))
    joined = members.join(lists, "code")
    kept = F.slice(F.filter("best", lambda b: b["id"] != F.col("vector_id")), 1, k)
    return joined.select("vector_id", F.posexplode(kept).alias("rank", "b")).select("vector_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("other_id"), F.sqrt("b.distance").alias("distance"))
