"""Many settings of the re-ranking fold over many queries, side by side: a step takes the next candidate of each query into all of its settings, so that its cost is shared by all."""

from __future__ import annotations

import numpy as np

from lexforge.operators import retrieval as R

#: As in retrieval.mmr_fold.
PENALTY = 1.5


def fits(fold: R.Fold) -> bool:
    """Whether fold_all can run a setting: its first round goes by distance alone and leaves places for the second."""
    lam, tau = _later(fold)
    return (fold.mode == "b2" or (fold.anchor_lam == 1 and fold.anchor_tau <= 0)) and _quota(fold) < fold.k and lam <= 1 and tau == tau


def _later(fold: R.Fold) -> tuple[float, float]:
    return (1.0, 0.0) if fold.mode == "b2" else (fold.lam, fold.tau)


def _quota(fold: R.Fold) -> int:
    return round(max(0.0, min(1.0, fold.share)) * fold.k)


def by_distance(away: np.ndarray, k: int) -> np.ndarray:
    """The fold by distance alone over rows in their order: a full list's first farthest gives way to what is nearer. Nearest first."""
    order = np.argsort(away, kind="stable")
    if k <= 0 or (np.diff(away[order[: k + 1]]) > 0).all():
        return order[: max(0, k)]
    held: list[int] = []
    far: list[float] = []
    for i, d in enumerate(away.tolist()):
        if len(held) < k:
            held.append(i)
            far.append(d)
        elif d < (most := max(far)):
            at = far.index(most)
            held[at], far[at] = i, d
    return np.array(held)[np.argsort(far, kind="stable")]


def grain(book: np.ndarray) -> float:
    """What distances of vectors made of a code book's words are rounded by: added and taken off again, it leaves 36 binary digits of the squares, so that what is equally far stays so."""
    return 2.0 ** (int(np.frexp((book**2).sum(2).max(1).sum())[1]) + 16)


def distances(a: np.ndarray, b: np.ndarray, grain: float, sa: np.ndarray | None = None, sb: np.ndarray | None = None) -> np.ndarray:
    """Of each row of a to each of b. sa, sb: the rows' squared lengths."""
    sa, sb = squares(a) if sa is None else sa, squares(b) if sb is None else sb
    d = a @ (-2 * b.T)
    d += sa[:, None]
    d += sb
    d += grain
    d -= grain
    return np.sqrt(d, out=d)


def squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def _eased(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances under one heading are less; heading 0 is none."""
    return np.divide(d, PENALTY, out=d, where=np.where(a > 0, a, -1)[:, None] == b)


class _Query:
    """What a query's second round offers: distances to its vector, and to the nearest anchor that each (quota, k) takes from the first round."""

    def __init__(self, rounds, groups: list[tuple[int, int]], grain: float):
        (first, offered), (second, self.offers) = rounds
        local = np.flatnonzero(offered.local)
        vectors = offered.exact(local)
        away = np.sqrt(((vectors - first) ** 2).sum(1))
        places = {q: by_distance(away, q).astype(np.int64) for q in {q for q, _ in groups}}
        mine = np.unique(np.concatenate(list(places.values())))
        self.vectors, self.heading = self.offers.vectors, self.offers.heading
        self.squares = squares(self.vectors)
        self.away = np.sqrt(((self.vectors - second) ** 2).sum(1))
        chunks, names = self.offers.chunk_id, offered.chunk_id[local[mine]]
        order = np.argsort(chunks)
        at = order[np.minimum(np.searchsorted(chunks, names, sorter=order), len(chunks) - 1)]
        to = _eased(distances(vectors[mine], self.vectors, grain, None, self.squares), offered.heading[local[mine]], self.heading)
        self.anchors, self.near = [], np.full((len(groups), len(chunks)), _FAR)
        for i, (quota, _) in enumerate(groups):
            x = np.searchsorted(mine, places[quota])
            self.anchors.append(offered.at[local[places[quota]]])
            if len(x):
                to[x].min(0, out=self.near[i])
                self.near[i, at[x][chunks[at[x]] == names[x]]] = -np.inf  # an anchor itself isn't offered again


#: The distance to the nearest of none.
_FAR = 1e300


def fold_all(queries: list[list[tuple[np.ndarray, object]]], folds: list[R.Fold], block: int = 64) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each query the lists of rows that Fold.run gives, in its order, and which of them each setting has.

    queries: two rounds each, of candidates (probed.Coded) with local ones in both; folds: see fits. Settings that differ in tau alone are one
    until a candidate is taken that a greater tau would have passed over.
    """
    groups = sorted({(_quota(f), f.k) for f in folds})
    group = np.array([groups.index((_quota(f), f.k)) for f in folds])
    lam, tau = (np.array([_later(f)[i] for f in folds], np.float64) for i in (0, 1))
    size, many, each = np.array([f.k for f in folds]), len(queries), len(folds)
    room, all_rows = int(size.max()), many * each
    rounded = grain(queries[0][0][1].lists.book)
    asked = [_Query(q, groups, rounded) for q in queries]
    none = max(len(q.away) for q in asked)  # no candidate
    # A row for every place of a list, a column for every query and setting.
    held = np.full((room, all_rows), none, np.int64)
    scores = np.where(np.arange(room)[:, None] < np.tile(size, many), -np.inf, np.inf)
    lowest = scores.min(0)
    lams, rests, taus = np.tile(lam, many), np.tile(1 - lam, many), np.tile(tau, many)
    of_query = np.repeat(np.arange(many), each)
    of_group = (np.arange(many)[:, None] * len(groups) + group).reshape(-1)
    bare = any(not len(a) for q in asked for a in q.anchors)
    # Those that follow a column, by tau, and the greatest of their taus; what follows another rests.
    chains: dict[tuple, list[int]] = {}
    for s in np.argsort(tau, kind="stable").tolist():
        chains.setdefault((group[s], lam[s]), []).append(s)
    followers = {i * each + c[0]: [i * each + s for s in c[1:]] for c in chains.values() for i in range(many)}
    leader, wakes = np.arange(all_rows), np.full(all_rows, -np.inf)
    for c, f in followers.items():
        if f:
            leader[f], lowest[f], wakes[c] = c, np.inf, taus[f[-1]]

    def part(c: int, nearest: float) -> None:
        """Followers that would pass over what column c takes go on their own, the others of them after the first."""
        stay, go = [f for f in followers[c] if not nearest < taus[f]], [f for f in followers[c] if nearest < taus[f]]
        held[:, go[0]], scores[:, go[0]], places[:, go[0]], lowest[go[0]] = held[:, c], scores[:, c], places[:, c], lowest[c]
        leader[go] = go[0]
        for one, rest in ((c, stay), (go[0], go[1:])):
            followers[one], wakes[one] = rest, taus[rest[-1]] if rest else -np.inf

    with np.errstate(invalid="ignore"):
        for start in range(0, none, block):
            steps = min(block, none - start)
            columns, mark = [], np.zeros(none + 1, bool)
            for i in range(many):
                mark[:] = False
                mark[held[:, i * each : (i + 1) * each]] = True
                columns.append(np.flatnonzero(mark[:none]))
            wide = max(len(c) for c in columns) + steps + 1
            far = np.empty((steps, many, wide))
            far[:, :, -1] = _FAR
            near, away = np.full((steps, many, len(groups)), -np.inf), np.zeros((steps, many))
            places = np.empty_like(held)  # of what is held among the columns
            begin = np.array([i * wide + len(c) for i, c in enumerate(columns)])
            for i, (q, c) in enumerate(zip(asked, columns)):
                t = slice(start, min(start + steps, len(q.away)))
                n = t.stop - start
                if n <= 0:
                    continue
                both = np.concatenate([c, np.arange(start, t.stop)])
                far[:n, i, : len(both)] = _eased(distances(q.vectors[t], q.vectors[both], rounded, q.squares[t], q.squares[both]), q.heading[t], q.heading[both])
                near[:n, i], away[:n, i] = q.near[:, t].T, q.away[t]
                place = np.full(none + 1, i * wide + wide - 1)
                place[c] = i * wide + np.arange(len(c))
                places[:, i * each : (i + 1) * each] = place[held[:, i * each : (i + 1) * each]]
            best = near[:, :, group]
            out_of_reach = best < tau
            best *= 1 - lam
            best -= lam * away[:, :, None]
            best[out_of_reach] = -np.inf
            far, best, near = far.reshape(steps, -1), best.reshape(steps, -1), near.reshape(steps, -1)
            for step in range(steps):
                x = np.flatnonzero(best[step] > lowest)
                if not len(x):
                    continue
                nearest = np.minimum(far[step].take(places.take(x, 1)).min(0), near[step].take(of_group[x]))
                straight = lams[x] * away[step].take(of_query[x])
                score = rests[x] * nearest - straight
                if bare:
                    score = np.where(nearest < _FAR, score, -straight)
                ok = np.flatnonzero((score > lowest[x]) & ~(nearest < taus[x]))
                if not len(ok):
                    continue
                e, score = x[ok], score[ok]
                for j in np.flatnonzero(nearest[ok] < wakes[e]).tolist():
                    part(int(e[j]), float(nearest[ok[j]]))
                own = scores.take(e, 1)
                at = own.argmin(0)  # the first of the lowest; an empty place before
                own[at, np.arange(len(e))] = score
                scores[at, e], held[at, e], places[at, e] = score, start + step, begin[of_query[e]] + step
                lowest[e] = own.min(0)
    scores[np.isinf(scores)] = -np.inf
    order = np.argsort(-scores, axis=0, kind="stable")
    held, scores = np.take_along_axis(held, order, 0), np.take_along_axis(scores, order, 0)
    full = np.isfinite(scores).sum(0)
    out = []
    for i, q in enumerate(asked):
        found: dict[int, np.ndarray] = {}
        for s in np.unique(leader[i * each : (i + 1) * each] - i * each).tolist():
            row, g = i * each + s, group[s]
            rows = held[: full[row], row]
            if full[row] < size[s]:
                # A list that never was full has passed over near-duplicates alone; these fill the places left, nearest first.
                more = np.flatnonzero(q.near[g] > -np.inf)
                more = np.setdiff1d(more, rows, assume_unique=True)
                more = more[np.argsort(q.away[more], kind="stable")][: size[s] - full[row]]
                rows = np.concatenate([rows, more])[np.argsort(-np.concatenate([scores[: full[row], row], -lam[s] * q.away[more]]), kind="stable")]
            found[s] = np.concatenate([q.anchors[g], q.offers.at[rows]])[: size[s]]
        out.append((list(found.values()), np.searchsorted(list(found), leader[i * each : (i + 1) * each] - i * each)))
    return out
