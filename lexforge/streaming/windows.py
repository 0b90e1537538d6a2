"""Windows over event time, for tables and for streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexforge.operators.retrieval import Entry, mmr_fold


def tumbling(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, group, n, total): events per window and group; on a stream, rows later than `late` are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), F.col(group)).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), group, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): runs of events with no longer gap."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def streaming_mmr(candidates: DataFrame, k: int = 10, lam: float = 0.5, tau: float = 0.5) -> DataFrame:
    """(query_id, rank, chunk_id, score): the re-ranking fold over a stream of candidates.

    candidates: query_id bigint, pos bigint, chunk_id, section_heading, query array<double>, embedding array<double>.
    The buffer of a query is its state, at most k entries; each batch brings the query's new list.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Entry] = []
        if state.exists:
            ids, heads, scores, dists, vecs = state.get
            held = [Entry(c, np.array(v), h, False, "", 0, s, d) for c, h, s, d, v in zip(ids, heads, scores, dists, vecs)]
        rows = pd.concat(list(batches)).sort_values("pos")
        offered = [Entry(r.chunk_id, np.asarray(r.embedding, float), r.section_heading or "", False, "", 0) for r in rows.itertuples()]
        held, _ = mmr_fold(np.asarray(rows["query"].iloc[0], float), offered, k, lam, tau, held)
        state.update(([e.chunk_id for e in held], [e.heading for e in held], [e.score for e in held], [min(e.min_dist, 1e300) for e in held], [e.vector.tolist() for e in held]))
        yield pd.DataFrame({"query_id": [key[0]] * len(held), "rank": range(1, len(held) + 1), "chunk_id": [e.chunk_id for e in held], "score": [e.score for e in held]})

    return candidates.groupBy("query_id").applyInPandasWithState(
        fold, "query_id bigint, rank int, chunk_id string, score double", "ids array<string>, heads array<string>, scores array<double>, dists array<double>, vecs array<array<double>>", "append", GroupStateTimeout.NoTimeout
    )
