"""Retrieval: probing, candidates, nearest chunks, quotas for local and global ones, and the order-dependent re-ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lexforge.functions import vectors as V
from lexforge.operators import vector_index as I


def coarse_probe(queries: DataFrame, centroids: DataFrame, nprobe: int = 8) -> DataFrame:
    """(query_id, rank, centroid_id, d2): the nprobe nearest centroids of every query."""
    return I.nearest_of(queries, "query_id", "embedding", centroids, nprobe)


def candidates(queries: DataFrame, postings: DataFrame, centroids: DataFrame, nprobe: int = 8, top_r: int | None = None, parts: int = 8) -> DataFrame:
    """(query_id, pos, chunk_id, vector_id, centroid_id, pq_code): what the probed lists offer, each chunk once, in the order of
    (rank of the list, chunk_id).

    Lists are whole. With top_r, as the reference has it, each is cut to its first top_r chunk ids before the join, an order that has
    nothing to do with distance. For the nearest of whole lists, nearest_probed moves far fewer rows.
    """
    probes = coarse_probe(queries, centroids, nprobe)
    # By query from here on: what follows groups, numbers and joins within a query, and needs no other shuffle.
    offered = probes.join(I.posting_lists(postings, top_r, parts), "centroid_id").repartition("query_id")
    first = offered.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "centroid_id", "vector_id", "pq_code")).alias("c")).select("query_id", "chunk_id", "c.*")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")) - 1
    return first.select("query_id", pos.alias("pos"), "chunk_id", "vector_id", "centroid_id", "pq_code")


def nearest_probed(queries: DataFrame, postings: DataFrame, centroids: DataFrame, codebook: DataFrame, k: int, nprobe: int = 8, parts: int = 8, block: int = 4096) -> DataFrame:
    """(query_id, rank, chunk_id, centroid_id, dist_q): the k nearest chunks of the whole probed lists, never the query's own vector;
    ties in the order of candidates().

    postings may have doc_id and queries target: chunks of the target are then left out. Postings are dealt by chunk_id, so that no
    list is one task's fate and all postings of a chunk meet; a task keeps k rows per query. Queries come in blocks of bounded size.
    """
    blocks = max(1, -(-queries.count() // block))
    book = I.code_book(codebook)
    kind = queries.schema["query_id"].dataType.simpleString()
    apart = "target" in queries.columns
    docs = postings.select("chunk_id", "doc_id").dropDuplicates(["chunk_id"]) if apart else None
    lists = I.posting_lists(postings, None, parts).join(docs, "chunk_id") if apart else I.posting_lists(postings, None, parts)
    lists = lists.repartition("chunk_id").sortWithinPartitions("chunk_id", "centroid_id")
    near = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = part.select("query_id", "embedding", *["target"] * apart).toArrow()
        names = rows["query_id"].to_numpy()
        probes = coarse_probe(part, centroids, nprobe).select("query_id", "rank", "centroid_id").toArrow()
        at = np.argsort(names, kind="stable")
        probed = at[np.searchsorted(names[at], probes["query_id"].to_numpy())] if len(names) else np.empty(0, np.int64)
        vectors = np.array(rows["embedding"].to_pylist(), np.float64).reshape(len(rows), len(book), -1)
        targets = np.array(rows["target"].to_pylist()) if apart else None
        shared = queries.sparkSession.sparkContext.broadcast((names, vectors, targets, book, probed, probes["rank"].to_numpy(), probes["centroid_id"].to_numpy()))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors, targets, book, probed, ranks, at_list = shared.value
            if not len(names):
                return
            # Squared distance of each query's parts to each code word: copies of a code are equally far, to the last bit.
            table = np.stack([((vectors[:, m, None, :] - book[m]) ** 2).sum(2) for m in range(len(book))], 1)
            order = np.argsort(at_list, kind="stable")
            probed, ranks, at_list = probed[order], ranks[order], at_list[order]
            best: dict[str, np.ndarray] = {"q": np.empty(0, np.int64), "d": np.empty(0), "rank": np.empty(0, np.int64), "chunk": np.empty(0, "U1"), "list": np.empty(0, np.int64)}
            bound = np.full(len(names), np.inf)

            def offer(t: pa.Table) -> None:
                nonlocal best
                chunk, place, own = np.array(t["chunk_id"].to_pylist()), t["centroid_id"].to_numpy(), t["vector_id"].to_numpy()
                codes = t["pq_code"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(t), -1)
                doc = np.array(t["doc_id"].to_pylist()) if targets is not None else None
                again = np.r_[False, chunk[1:] == chunk[:-1]]
                several = again | np.r_[again[1:], False]  # rows of a chunk that is in more than one list
                # Of the nearest so many may be the query itself or of its target.
                left_out = sum(np.unique(x[x == x], return_counts=True)[1].max(initial=0) for x in (own, doc) if x is not None)
                found = []

                def far(q: np.ndarray, row: np.ndarray) -> np.ndarray:
                    d = np.round(np.sqrt(sum(table[q, m, codes[row, m]] for m in range(len(book)))), 9)
                    d[np.broadcast_to(names[q] == own[row], d.shape)] = np.inf
                    if doc is not None:
                        d[np.broadcast_to(targets[q] == doc[row], d.shape)] = np.inf
                    return d

                pairs = []
                for c in np.unique(place):
                    s, e = np.searchsorted(at_list, [c, c + 1])
                    if s == e:
                        continue
                    rows = np.flatnonzero(place == c)
                    q, rank = probed[s:e], ranks[s:e]
                    if (x := rows[several[rows]]).size:
                        pairs.append((np.repeat(q, len(x)), np.repeat(rank, len(x)), np.tile(x, len(q))))
                    rows = rows[~several[rows]]
                    if len(rows):
                        v = np.concatenate([book[m][codes[rows, m]] for m in range(len(book))], 1)
                        i, j = I.rough_near(vectors[q].reshape(len(q), -1), v, k + left_out, bound[q])
                        d = far(q[i], rows[j])
                        ok = np.isfinite(d) & (d <= bound[q[i]])
                        i, j, d = i[ok], j[ok], d[ok]
                        o = np.lexsort((j, d, i))  # rows are in order of chunk_id
                        o = o[np.arange(len(o)) - np.searchsorted(i[o], i[o]) < k]
                        found.append((q[i[o]], d[o], rank[i[o]], rows[j[o]]))
                if pairs:
                    q, rank, row = (np.concatenate(x) for x in zip(*pairs))
                    name = np.unique(chunk, return_inverse=True)[1][row]
                    o = np.lexsort((own[row], rank, name, q))  # of a chunk's lists the first that is probed
                    o = o[np.r_[True, (q[o][1:] != q[o][:-1]) | (name[o][1:] != name[o][:-1])]]
                    d = far(q[o], row[o])
                    ok = np.isfinite(d)
                    found.append((q[o][ok], d[ok], rank[o][ok], row[o][ok]))
                if not found:
                    return
                q, d, rank, row = (np.concatenate(x) for x in zip(*found))
                fresh = {"q": q, "d": d, "rank": rank, "chunk": chunk[row], "list": place[row]}
                best = {n: np.concatenate([best[n], fresh[n]]) for n in best}
                o = np.lexsort((best["chunk"], best["rank"], best["d"], best["q"]))
                sorted_q = best["q"][o]
                nth = np.arange(len(o)) - np.searchsorted(sorted_q, sorted_q)
                last = nth == k - 1
                bound[sorted_q[last]] = best["d"][o][last]
                best = {n: x[o[nth < k]] for n, x in best.items()}

            rest = None
            for b in batches:
                t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
                if not len(t):
                    continue
                # The last chunk may go on in the next batch.
                chunks = t["chunk_id"].to_pylist()
                end = len(chunks)
                while end and chunks[end - 1] == chunks[-1]:
                    end -= 1
                if end:
                    offer(t.slice(0, end))
                rest = t.slice(end)
            if rest is not None and len(rest):
                offer(rest)
            yield pa.RecordBatch.from_pydict({"query_id": names[best["q"]], "place": best["rank"].astype(np.int32), "chunk_id": best["chunk"].astype(object), "centroid_id": best["list"].astype(np.int32), "dist_q": best["d"]}, pa.schema([("query_id", pa.from_numpy_dtype(names.dtype)), ("place", pa.int32()), ("chunk_id", pa.string()), ("centroid_id", pa.int32()), ("dist_q", pa.float64())]))

        found = lists.mapInArrow(search, f"query_id {kind}, place int, chunk_id string, centroid_id int, dist_q double")
        near = found if near is None else near.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist_q", "place", "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "centroid_id", "dist_q")


def with_distance(found: DataFrame, queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """The candidates with dist_q, the distance of their decoded vector to the query's."""
    shared = found.sparkSession.sparkContext.broadcast(I.code_book(codebook))
    names = found.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                q = I._values(t["embedding"].combine_chunks())
                c = t["pq_code"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(q), -1)
                v = np.concatenate([book[m][c[:, m]] for m in range(len(book))], 1)
                d = np.sqrt(((q - v) ** 2).sum(1))
                yield from t.select(names).append_column("dist_q", pa.array(d)).to_batches()

    rows = found.join(queries.select("query_id", "embedding"), "query_id").select(*names, "embedding")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return rows.mapInArrow(measure, f"{schema}, dist_q double")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, dist_q): the k nearest candidates; ties keep their order."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("dist_q", 9), "pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "dist_q")


def hybrid_merge(ranked: DataFrame, k: int, share: float = 0.7) -> DataFrame:
    """(query_id, rank, chunk_id, is_local, tier): k rows out of two ranked lists.

    ranked: query_id, chunk_id, is_local, dist_q, pos. First the local ones up to their quota, then the global ones up
    to theirs, then what is left of the local and of the global ones. All by windows; no list is walked.
    """
    order = Window.partitionBy("query_id", "is_local").orderBy(F.round("dist_q", 9), "pos")
    quota = V.local_quota(share, k)
    # No more than k of either list can be in the result.
    rows = ranked.withColumn("own", F.row_number().over(order)).where(F.col("own") <= k)
    tier = F.when(F.col("is_local"), F.when(F.col("own") <= quota, 0).otherwise(2)).otherwise(F.when(F.col("own") <= k - quota, 1).otherwise(3))
    rows = rows.withColumn("tier", tier)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "own"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "is_local", "tier")


# --- Re-ranking: a fold over the candidates in their order -------------------------------------------------------


@dataclass
class Entry:
    chunk_id: str
    vector: np.ndarray
    heading: str
    local: bool
    doc_id: str
    centroid_id: int
    score: float = 0.0
    min_dist: float = math.inf
    row: int = -1


class Offers:
    """Candidates in their order, side by side: vectors as one array, so that an Entry is made only of those that are taken."""

    def __init__(self, chunk_id, vectors: np.ndarray, heading, local, doc_id, centroid_id):
        self.chunk_id, self.vectors, self.heading, self.local, self.doc_id, self.centroid_id = chunk_id, vectors, heading, local, doc_id, centroid_id

    @classmethod
    def of(cls, entries: list[Entry]) -> Offers:
        return cls(*([getattr(e, n) for e in entries] if n != "vector" else np.array([e.vector for e in entries], np.float64).reshape(len(entries), -1 if entries else 1) for n in ("chunk_id", "vector", "heading", "local", "doc_id", "centroid_id")))

    def __len__(self) -> int:
        return len(self.chunk_id)

    def entry(self, i: int, score: float, min_dist: float) -> Entry:
        return Entry(self.chunk_id[i], self.vectors[i], self.heading[i], bool(self.local[i]), self.doc_id[i], int(self.centroid_id[i]), score, min_dist)

    def rough(self) -> np.ndarray:
        """The vectors in single precision."""
        return self.vectors.astype(np.float32)

    def squares(self) -> np.ndarray:
        rough = self.rough()
        return np.einsum("ij,ij->i", rough, rough)

    def squares_to(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Rough squared distances to a point, and by how much they may be off."""
        return rough_squares(self.rough(), self.squares(), point)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows]

    def without(self, known: set) -> Offers:
        return self.rows(np.array([i for i, c in enumerate(self.chunk_id) if c not in known], np.int64))

    def rows(self, at) -> Offers:
        pick = lambda xs: [xs[i] for i in at]
        return Offers(pick(self.chunk_id), self.vectors[at], pick(self.heading), pick(self.local), pick(self.doc_id), pick(self.centroid_id))


def mmr_fold(
    query: np.ndarray, offered: list[Entry] | Offers, k: int, lam: float, tau: float, buffer: list[Entry] | None = None, anchors: list[Entry] | None = None, penalty: float = 1.5
) -> tuple[list[Entry], int]:
    """The buffer after the candidates, best first, and how many were skipped as near-duplicates.

    A candidate nearer than tau to the buffer or an anchor is skipped (distances under one heading are divided by
    penalty); others get -lam x distance to the query + (1 - lam) x distance to what is held, for good, and the first
    lowest of a full buffer gives way to a higher score. What was skipped fills the places left, nearest first; a
    chunk that is held already isn't taken again.
    """
    held, anchors = list(buffer or []), list(anchors or [])
    offered = offered if isinstance(offered, Offers) else Offers.of(offered)
    if k <= 0:
        return [], 0
    if lam == 1 and tau <= 0:
        return _by_distance(query, offered, k, held, anchors, max(penalty, 1e-9)), 0
    skipped: list[np.ndarray] = [np.empty(0, np.int64)]
    if len(offered):
        names = {"": 0}
        code = offered.heading if isinstance(offered.heading, np.ndarray) else np.array([names.setdefault(h, len(names)) for h in offered.heading])
        # Anchors, then the buffer: vectors, headings and scores side by side, changed in place.
        rough, squares = offered.rough(), offered.squares()
        fixed, room = len(anchors), len(anchors) + max(k, len(held))
        around, headings, scores = np.empty((room, rough.shape[1])), np.zeros(room, np.int64), np.empty(room)
        for i, e in enumerate(anchors + held):
            around[i], headings[i], scores[i] = e.vector, names.setdefault(e.heading, len(names)) if isinstance(e.heading, str) else e.heading, e.score
        penalty = max(penalty, 1e-9)
        # Rough squared distances, off by no more than `slack`, tell most candidates' fate; the others are measured exactly.
        dq, slack = offered.squares_to(query)
        slack = max([slack] + [rough_slack(squares, float(np.linalg.norm(e.vector))) for e in anchors + held])
        slack = max(slack, rough_slack(squares, math.sqrt(float(squares[np.isfinite(squares)].max(initial=0.0)))))
        away = lam * np.sqrt(np.maximum(0, np.where(np.isfinite(dq), dq - slack if lam >= 0 else dq + slack, np.nan)))

        def apart(rows: slice, place: int) -> np.ndarray:
            return eased(rough_distances(rough[rows], squares[rows], around[place]), rows, place)

        def eased(d: np.ndarray, rows: slice, place: int) -> np.ndarray:
            if headings[place] > 0:
                d[code[rows] == headings[place]] /= penalty**2
            return d

        def exactly(i: int, n: int) -> tuple[float, float, float]:
            v = offered.exact(np.array([i]))[0]
            d = float(np.sqrt(((v - query) ** 2).sum()))
            d = d if math.isfinite(d) else 0.0
            ds = np.sqrt(((v - around[:n]) ** 2).sum(1))
            ds[(headings[:n] == code[i]) & (code[i] > 0)] /= penalty
            near = float(ds.min()) if n else math.inf
            score = -lam * d + (1 - lam) * near if near < math.inf or lam != 1 else math.nan
            return d, near, score if math.isfinite(score) else -lam * d

        wide = slack / min(1.0, penalty**2)
        start, size = 0, 128
        # The buffer changes seldom, and ever more so: candidates are measured against it in growing blocks, up to the next that changes it.
        while start < len(offered):
            stop = min(start + size, len(offered))
            ds = np.empty((room, stop - start), np.float32)
            n = fixed + len(held)
            if n:
                points = around[:n].astype(np.float32)
                ds[:n] = squares[start:stop] - 2 * (points @ rough[start:stop].T) + (points**2).sum(1)[:, None]
                for place in np.flatnonzero(headings[:n] > 0):
                    eased(ds[place], slice(start, stop), place)
            i = start
            while i < stop:
                n, full = fixed + len(held), len(held) >= k
                at = fixed + int(scores[fixed:n].argmin()) if full else n  # the first of the lowest
                near = ds[:n, i - start :].min(0) if n else np.full(stop - i, np.inf, np.float32)
                close = near + wide < tau * tau if tau > 0 else np.zeros(stop - i, bool)
                maybe = ~close
                if full:
                    best = -away[i:stop] + (1 - lam) * np.sqrt(np.maximum(0, near + wide if lam <= 1 else near - wide)) if lam != 1 else -away[i:stop]
                    low = best <= scores[at]
                    maybe &= ~(low & (near - wide > tau * tau) if tau > 0 else low)
                done = stop - i
                for t in np.flatnonzero(maybe).tolist():
                    _, nearest, score = exactly(i + t, n)
                    if nearest < tau:
                        close[t] = True
                    elif not full or score > scores[at]:
                        entry = offered.entry(i + t, score, nearest)
                        held[at - fixed : at - fixed + 1] = [entry]
                        around[at], headings[at], scores[at] = entry.vector, code[i + t], score
                        done = t + 1
                        ds[at, i + done - start :] = apart(slice(i + done, stop), at)
                        break
                skipped.append(i + np.flatnonzero(close[:done]))
                i += done
            start, size = stop, min(2 * size, 8192)
    passed = np.concatenate(skipped)
    if len(held) < k and len(passed):
        dq = np.sqrt(((offered.exact(passed) - query) ** 2).sum(1))
        dq = np.where(np.isfinite(dq), dq, 0.0)
        for j in np.argsort(dq, kind="stable"):
            if len(held) >= k:
                break
            if all(offered.chunk_id[passed[j]] != h.chunk_id for h in held):
                held.append(offered.entry(int(passed[j]), -lam * float(dq[j]), 0.0))
    return sorted(held, key=lambda e: -e.score), len(passed)


def _by_distance(query: np.ndarray, offered: Offers, k: int, held: list[Entry], anchors: list[Entry], penalty: float) -> list[Entry]:
    """mmr_fold by distance alone: what is held has no say in the scores. Only what may be among the k nearest so far is measured."""
    away, slack = offered.squares_to(query)
    away = np.where(np.isfinite(away), away, -np.inf)
    scores = [e.score for e in held]
    places: list[Entry | int] = list(held)  # rows of those that are taken
    before: dict[int, list[Entry | int]] = {}  # what was held when a row was taken
    vectors: dict[int, np.ndarray] = {}
    start, size = 0, 256
    while start < len(offered):
        stop = min(start + size, len(offered))
        low = min(scores) if len(places) >= k else -math.inf
        rows = start + np.flatnonzero(away[start:stop] - slack <= low**2) if low <= 0 else np.empty(0, np.int64)
        v = offered.exact(rows)
        d = np.sqrt(((v - query) ** 2).sum(1))
        for i, (row, far) in enumerate(zip(rows.tolist(), np.where(np.isfinite(d), d, 0.0).tolist())):
            score = 0.0 - far if anchors or places else -far
            if len(places) < k:
                at = len(places)
            elif score <= (low := min(scores)):
                continue
            else:
                at = scores.index(low)  # the first of the lowest
            before[row], vectors[row] = places.copy(), v[i]
            places[at : at + 1], scores[at : at + 1] = [row], [score]
        start, size = stop, min(2 * size, 8192)
    taken = {row: offered.entry(row, score, math.inf) for row, score in zip(places, scores) if isinstance(row, int)}
    for row, e in taken.items():
        around = [(o.vector, o.heading) for o in anchors] + [(vectors[o], offered.heading[o]) if isinstance(o, int) else (o.vector, o.heading) for o in before[row]]
        if around:
            ds = np.sqrt(((vectors[row] - np.array([x for x, _ in around])) ** 2).sum(1))
            ds[[bool(e.heading) and bool(h == e.heading) for _, h in around]] /= penalty
            e.min_dist = float(ds.min())
    return sorted((taken[p] if isinstance(p, int) else p for p in places), key=lambda e: -e.score)


def rough_slack(squares: np.ndarray, length: float) -> float:
    return 1e-5 * (math.sqrt(float(squares[np.isfinite(squares)].max(initial=0.0))) + length) ** 2


def rough_squares(rough: np.ndarray, squares: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of single-precision vectors to a point, and by how much they may be off; squares: the vectors' squared lengths."""
    return rough_distances(rough, squares, point), rough_slack(squares, float(np.linalg.norm(point)))


def rough_distances(rough: np.ndarray, squares: np.ndarray, point: np.ndarray) -> np.ndarray:
    p = np.asarray(point, np.float32)
    return squares - 2 * (rough @ p) + p @ p


def is_covered(held: list[Entry], skipped: int, k: int, nprobe: int) -> bool:
    """Enough chunks, of enough documents and lists, and not too many near-duplicates."""
    return len(held) >= k and len({e.doc_id for e in held}) >= min(2, k) and len({e.centroid_id for e in held}) >= min(2, nprobe, k) and skipped <= max(2, int(1.5 * k))


@dataclass(frozen=True)
class Fold:
    """What a re-ranking is run with. mode: b2 ranks by distance alone in every round, proposed by lam and tau from the second on. share: of the places that are local."""

    mode: str = "proposed"
    k: int = 10
    lam: float = 0.5
    tau: float = 0.5
    share: float = 0.7
    nprobe: int = 8
    anchor_lam: float = 1.0
    anchor_tau: float = 0.0

    def run(self, rounds: list[tuple[np.ndarray, Offers]]) -> tuple[list[Entry], int, int, list[float]]:
        """Result, rounds used, near-duplicates skipped, and of all rounds' results the distances to what was held before, of one query's rounds in their order."""
        held: list[Entry] = []
        anchors: list[Entry] = []
        apart: list[float] = []
        skipped = used = 0
        hybrid = any(np.any(offers.local) for _, offers in rounds)
        quota = round(max(0.0, min(1.0, self.share)) * self.k)
        pure = self.mode == "b2"
        first, later = ((1.0, 0.0), (1.0, 0.0)) if pure else ((self.anchor_lam, self.anchor_tau), (self.lam, self.tau))
        for query, offers in rounds:
            used += 1
            lam, tau = first if used == 1 else later
            if used == 1 and hybrid:
                held, n = mmr_fold(query, offers.rows(np.flatnonzero(offers.local)), quota, lam, tau)
                anchors = list(held)
            elif used == 1 or not anchors:
                held, n = mmr_fold(query, offers, self.k, lam, tau, held)
            else:
                known = {a.chunk_id for a in anchors}
                rest, n = mmr_fold(query, offers.without(known), self.k, lam, tau, [e for e in held if e.chunk_id not in known], anchors)
                held = (anchors + rest)[: self.k]
            skipped += n
            apart += [e.min_dist for e in (held if used == 1 or not anchors else held[len(anchors) :])]
            if is_covered(held, skipped, self.k, self.nprobe * used):
                break
        return held[: self.k], used, skipped, apart


def rounds_of(found: pa.Table, asked: pa.Table, book: np.ndarray) -> list[tuple[np.ndarray, Offers]]:
    """One query's candidates as rounds: the codes of each are decoded once."""
    found = found.sort_by([("round", "ascending"), ("pos", "ascending")])
    codes = found["pq_code"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(found), -1)
    vectors = np.concatenate([book[m][codes[:, m]] for m in range(len(book))], 1)
    rows = [found[c].to_pylist() for c in ("chunk_id", "section_heading", "is_local", "doc_id", "centroid_id")]
    every = Offers(rows[0], vectors, [h or "" for h in rows[1]], rows[2], rows[3], rows[4])
    number = found["round"].to_numpy()
    queries = dict(zip(asked["round"].to_pylist(), asked["embedding"].to_pylist()))
    return [(np.asarray(queries[r], np.float64), every.rows(np.flatnonzero(number == r))) for r in sorted(queries) if (number == r).any()]


def list_spread(vectors: np.ndarray, threshold: float = 0.7) -> tuple[float, float]:
    """Mean distance of the pairs of a list, and the share of pairs whose cosine is above the threshold; pairs with a vector of no length have none."""
    i, j = np.triu_indices(len(vectors), 1)
    if not len(i):
        return 0.0, 0.0
    d = np.sqrt(((vectors[i] - vectors[j]) ** 2).sum(1))
    length = np.linalg.norm(vectors, axis=1)
    both = length[i] * length[j]
    known = (both > 0) & np.isfinite(both)
    cosine = (vectors[i] * vectors[j]).sum(1)[known] / both[known]
    d = d[np.isfinite(d)]
    return (float(d.mean()) if len(d) else 0.0), (float((cosine > threshold).mean()) if known.any() else 0.0)


_CANDIDATE = ("query_id", "round", "pos", "chunk_id", "doc_id", "is_local", "centroid_id", "section_heading", "pq_code")


def rerank_all(found: DataFrame, queries: DataFrame, codebook: DataFrame, folds: list[Fold]) -> DataFrame:
    """(fold, query_id, rank, chunk_id, centroid_id, doc_id, score, min_dist, is_local, rounds, skipped, p25, ild, redundancy): the re-ranked chunks of
    every query for each of several settings, numbered by their place in the list.

    found: query_id, round, pos, chunk_id, doc_id, is_local, centroid_id, section_heading, pq_code; queries: query_id,
    round, embedding. Candidates don't depend on the settings: they are brought together and decoded once. Rounds are
    taken in order until the result is covered. p25: first quartile of the finite distances to what was held before, over the results of all rounds. ild, redundancy: see list_spread.
    One query's candidates are one group, bounded by the probed lists and the rounds; queries run in parallel.
    """
    shared = found.sparkSession.sparkContext.broadcast((I.code_book(codebook), [vars(f) for f in folds]))
    kind = found.schema["query_id"].dataType.simpleString()
    names = {n: found.schema[n].dataType.simpleString() for n in ("doc_id", "centroid_id")}
    schema = f"fold int, query_id {kind}, rank int, chunk_id string, centroid_id {names['centroid_id']}, doc_id {names['doc_id']}, score double, min_dist double, is_local boolean, rounds int, skipped int, p25 double, ild double, redundancy double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        book, settings = shared.value
        out: dict[str, list] = {part.split(" ")[0]: [] for part in schema.split(", ")}
        rounds = rounds_of(left, right, book) if len(left) and len(right) else []
        for number, setting in enumerate(settings if rounds else []):
            held, used, skipped, apart = Fold(**setting).run(rounds)
            apart = [d for d in apart if math.isfinite(d)]
            quartile = float(np.percentile(apart, 25)) if apart else None
            ild, redundancy = list_spread(np.array([e.vector for e in held])) if held else (0.0, 0.0)
            name = left["query_id"][0].as_py()
            for rank, e in enumerate(held, 1):
                for column, value in zip(out, (number, name, rank, e.chunk_id, e.centroid_id, e.doc_id, e.score, e.min_dist, e.local, used, skipped, quartile, ild, redundancy)):
                    out[column].append(value)
        return pa.table({n: pa.array(v, types[n]) for n, v in out.items()})

    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    # Few bytes are much work here, so that the number of tasks is stated and not left to their size.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates, asked = found.select(*_CANDIDATE).repartition(tasks, "query_id"), queries.select("query_id", "round", "embedding").repartition(tasks, "query_id")
    return candidates.groupBy("query_id").cogroup(asked.groupBy("query_id")).applyInArrow(run, schema)


def rerank(found: DataFrame, queries: DataFrame, codebook: DataFrame, k: int = 10, lam: float = 0.5, tau: float = 0.5, share: float = 0.7, nprobe: int = 8, mode: str = "proposed", anchor_lam: float = 1.0, anchor_tau: float = 0.0) -> DataFrame:
    """(query_id, rank, chunk_id, score, min_dist, is_local, rounds, skipped): the re-ranked chunks of every query; see rerank_all."""
    out = rerank_all(found, queries, codebook, [Fold(mode, k, lam, tau, share, nprobe, anchor_lam, anchor_tau)])
    return out.select("query_id", "rank", "chunk_id", "score", "min_dist", "is_local", "rounds", "skipped")
