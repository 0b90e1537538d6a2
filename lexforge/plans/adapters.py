"""Interfaces to encoders, generators and judges, with stand-ins that need no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, into: str) -> DataFrame: ...


class Generator(Protocol):
    def answer(self, query: Column, contexts: Column) -> Column: ...


class HashEmbedder:
    """Signed hashes of a text's words, summed, of length one; equal on all machines."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, df: DataFrame, text: str, into: str) -> DataFrame:
        width = self.width

        @F.pandas_udf("array<double>")
        def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, tuple[int, float]] = {}
            for texts in batches:
                out = []
                for t in texts:
                    v = np.zeros(width)
                    for w in (t or "").lower().split():
                        if w not in known:
                            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                            known[w] = (h % width, 1.0 if h >> 63 else -1.0)
                        at, sign = known[w]
                        v[at] += sign
                    n = np.linalg.norm(v)
                    out.append((v / n if n > 1e-9 else v).tolist())
                yield pd.Series(out)

        return df.withColumn(into, vector(text))


class ExtractiveGenerator:
    """Answers with the sentence of the contexts that has most of the question's words."""

    def answer(self, query: Column, contexts: Column) -> Column:
        asked = F.array_distinct(T.words(query))
        sentences = F.flatten(F.transform(contexts, lambda c: F.split(T.untag_context(c), r"(?<=[.!?])\s+")))
        scored = F.transform(sentences, lambda s: F.struct(F.size(F.array_intersect(asked, F.array_distinct(T.words(s)))).alias("n"), s.alias("s")))
        return F.coalesce(F.array_max(scored)["s"], F.lit(""))


class OverlapJudge:
    """The answer that covers most of the truth wins; TIE where several do."""

    def winner(self, truth: Column, answers: dict[str, Column]) -> Column:
        cover = {k: T.answer_coverage(truth, a) for k, a in answers.items()}
        best = F.greatest(*cover.values())
        hits = sum((c == best).cast("int") for c in cover.values())
        return F.when(hits > 1, "TIE").otherwise(F.coalesce(*(F.when(c == best, k) for k, c in cover.items())))
