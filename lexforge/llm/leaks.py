"""Problem 7: documents that hold passages of evaluation texts.

Passages are compared by windows as long as the shortest one that counts, given
by their word shingles, which weigh more the fewer items have them. Documents
are read once, however many items there are: a filter of fixed size with all
shingles of the items leaves those windows that can be similar enough to any.
What is left is made distinct and meets the items' windows by joins.

For equal passages, every window gets a SimHash over its weighted shingles. To
find all fingerprints within a radius of r bits, a fingerprint is cut into
r + 1 blocks, one of which must be equal; the windows this leaves are compared.
For similar passages, two windows are compared if they share one of those rare
shingles without which they can't be similar enough. The exact weighted
similarity of shingles decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import ALNUM_GAP, INVISIBLE, cut, mix64, word_hashes

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return word_hashes(pc.replace_substring_regex(texts, INVISIBLE, ""), ALNUM_GAP)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, over the ends of texts too."""
    total = max(0, len(words) - n + 1)
    out = mix64(words[:total])
    for i in range(1, n):
        out = mix64(out * _STEP + words[i : i + total])
    return out


def fingerprints(windows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash of each window, given by its shingles and their weights; in integers, so that equal windows have equal fingerprints wherever they are."""
    bits = np.unpackbits(windows.reshape(-1).view(np.uint8).reshape(-1, 8), axis=1).reshape(*windows.shape, 64)
    signed = (bits.astype(np.int32) * 2 - 1) * weights[:, :, None].astype(np.int32)
    return np.packbits(signed.sum(1) > 0, axis=1).view(np.uint64).reshape(-1)


def hamming_blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """The radius + 1 blocks of each fingerprint: two fingerprints within the radius have one of them in common."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges[:-1], edges[1:])]


def needed_shingles(windows: np.ndarray, weights: np.ndarray, similarity: float) -> np.ndarray:
    """Which shingles of each window, rarest first, are needed: the others together weigh too little for the similarity."""
    order = np.lexsort((windows, -weights), axis=1)
    rest = np.cumsum(np.take_along_axis(weights, order, 1)[:, ::-1], 1)[:, ::-1]
    out = np.zeros(windows.shape, bool)
    np.put_along_axis(out, order, rest >= similarity * weights.sum(1, keepdims=True) - 1e-6, 1)
    return out


def window_similarity(mine: np.ndarray, weights: np.ndarray, theirs: np.ndarray, their_weights: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of windows, given by their shingles and weights."""
    equal = mine[:, :, None] == theirs[:, None, :]
    # The k-th occurrence of a shingle is matched with the k-th: count those before it in its own window.
    nth = [np.tril(x[:, :, None] == x[:, None, :], -1).sum(2) for x in (mine, theirs)]
    both = (equal & (nth[0][:, :, None] == nth[1][:, None, :])).any(2)
    shared = (both * weights).sum(1)
    return shared / np.maximum(1, weights.sum(1) + their_weights.sum(1) - shared)


class Filter:
    """Which shingles the items have: two bits for each in an array of fixed size, so that a few others pass too and none is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles), bool)
        for shift in (np.uint64(0), np.uint64(32)):
            at = (shingles >> shift) & self.mask
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out

    @staticmethod
    def of(shingles: DataFrame, count: int, most_bits: int = 1 << 30) -> np.ndarray:
        """The array for a table of distinct shingles: 16 bits for each, no more than most_bits in all (128 MB); it is filled by Spark, eight bytes to a row."""
        size = 1 << int(np.clip(np.ceil(np.log2(max(1, 16 * count))), 12, np.log2(most_bits)))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).to_numpy().view(np.uint64)
                at = np.concatenate([own & np.uint64(size - 1), (own >> np.uint64(32)) & np.uint64(size - 1)])
                yield pa.RecordBatch.from_pydict({"place": (at >> np.uint64(6)).astype(np.int32), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

        rows = shingles.mapInArrow(places, "place int, bit bigint").groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
        words = np.zeros(size // 64, np.int64)
        words[rows["place"].to_numpy()] = rows["bit"].to_numpy()
        return words.view(np.uint8)


_WINDOW = "at int, sequence bigint, shingles array<bigint>"


def _lists(windows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, windows.size + 1, windows.shape[1], dtype=np.int32)), pa.array(windows.reshape(-1).view(np.int64)))


def _windows(rows: DataFrame, name: str, window: int, shingle: int, known=None, needed: int = 0) -> DataFrame:
    """(name, at, sequence, shingles): the windows of every text, those of which at least `needed` shingles are in the filter."""
    per = window - shingle + 1

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = Filter(known.value) if known is not None else None
        for batch in batches:
            words, lengths = _words(batch.column(1))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            for s in range(0, max(0, len(words) - window + 1), 1 << 18):
                part = words[s : s + (1 << 18) + window - 1]
                shingles = _runs(part, shingle)
                at = np.arange(len(part) - window + 1)
                ok = owner[s + at] == owner[s + at + window - 1]
                if keep is not None:
                    count = np.r_[0, np.cumsum(keep.has(shingles))]
                    ok &= count[at + per] - count[at] >= needed
                at = at[ok]
                if len(at):
                    own = owner[s + at]
                    words_of = part[at[:, None] + np.arange(window)]
                    sequence = words_of[:, 0].copy()
                    for i in range(1, window):
                        sequence = mix64(sequence * _STEP + words_of[:, i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array((s + at - first[own]).astype(np.int32)), pa.array(sequence.view(np.int64)), _lists(shingles[at[:, None] + np.arange(per)])], [name, "at", "sequence", "shingles"])

    return rows.mapInArrow(cut_up, f"{name} {rows.schema[name].dataType.simpleString()}, {_WINDOW}")


def _weighed(windows: DataFrame, weights: DataFrame, other: int) -> DataFrame:
    """(sequence, shingles, weights): distinct windows with the weight of each shingle, which is `other` for those that no item has."""
    once = windows.groupBy("sequence").agg(F.any_value("shingles").alias("shingles"))
    each = once.select("sequence", F.posexplode("shingles").alias("i", "shingle")).join(weights, "shingle", "left")
    lists = each.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("i", "shingle", F.coalesce("weight", F.lit(other)).alias("weight")))).alias("l"))
    return lists.select("sequence", F.transform("l", lambda x: x["shingle"]).alias("shingles"), F.transform("l", lambda x: x["weight"]).alias("weights"))


def _arrays(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (first, first + 1)]
    n = batch.num_rows
    return np.ascontiguousarray(flat[0]).view(np.uint64).reshape(n, -1), flat[1].reshape(n, -1).astype(np.int64)


def leaked_items(
    documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str,
    window: int = 13, shingle: int = 3, radius: int = 2, similarity: float = 0.8, exact: bool = False, broadcast_rows: int = 500_000,
) -> DataFrame:
    """(doc, item, windows, similarity): each document and item with similar windows, how many windows of the document
    and the greatest similarity.

    Words are runs of letters and digits in lower case; characters that don't
    show are dropped first. window: words of a passage; similarity: of the
    weighted shingles of two windows; radius: of the fingerprints, for exact. exact: only windows with the same words in the
    same order; without it, all windows with the similarity are found. Texts shorter than a window, null and empty texts have no
    windows; rows without a key take no part; rows that repeat a key are
    reported once (their windows together); further columns are ignored. broadcast_rows: up to as many rows of the items' side
    of a join are sent to all tasks; more are shuffled.
    """
    docs = documents.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    tests = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    context = documents.sparkSession.sparkContext
    per = window - shingle + 1
    theirs = cut(_windows(tests, "item", window, shingle))
    # Rarity among all items: a shingle of few of them weighs more; one of no item weighs most.
    total = max(1, tests.select("item").distinct().count())
    rarity = theirs.select("item", F.explode("shingles").alias("shingle")).distinct().groupBy("shingle").agg(F.count("*").alias("n"))
    weights = cut(rarity.select("shingle", F.rint(8 * F.log1p(F.lit(total) / F.col("n"))).cast("int").alias("weight")))
    known = weights.count()
    other = int(round(8 * float(np.log1p(total))))
    shared = context.broadcast(Filter.of(weights.select("shingle"), known))
    # A shingle that no item has weighs at least as much as any, so that too many of them rule the similarity out.
    needed = per if exact else int(np.ceil(similarity * per - 1e-9))
    mine = cut(_windows(docs, "doc", window, shingle, shared, needed))
    few = (lambda d: F.broadcast(d)) if known <= broadcast_rows else (lambda d: d)
    ours, own_items = (_weighed(d, few(weights), other) for d in (mine, theirs))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            windows, weight = _arrays(b, 1)
            if exact:
                blocks = hamming_blocks(fingerprints(windows, weight), radius)
                row = np.tile(np.arange(len(windows)), len(blocks))
                part, key = np.repeat(np.arange(len(blocks)), len(windows)), np.concatenate(blocks)
            else:
                row, place = np.nonzero(needed_shingles(windows, weight, similarity))
                part, key = np.zeros(len(row), np.int64), windows[row, place]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key.view(np.int64)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], ["part", "key", "sequence", "shingles", "weights"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 20_000):
                part = b.slice(s, 20_000)
                (x, wx), (y, wy) = _arrays(part, 2), _arrays(part, 4)
                ok = np.ones(len(x), bool)
                if exact:
                    ok &= np.bitwise_count(fingerprints(x, wx) ^ fingerprints(y, wy)) <= radius
                like = np.zeros(len(x))
                like[ok] = window_similarity(x[ok], wx[ok], y[ok], wy[ok])
                ok &= like >= (1.0 if exact else similarity)
                if exact:
                    ok &= part.column(0).to_numpy() == part.column(1).to_numpy()
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(like[ok])], ["own", "other", "similarity"])

    keyed = "part int, key bigint, sequence bigint, shingles array<bigint>, weights array<int>"
    left, right = (d.mapInArrow(keys, keyed) for d in (ours, own_items))
    right = right.select("part", "key", F.col("sequence").alias("other"), F.col("shingles").alias("other_shingles"), F.col("weights").alias("other_weights"))
    met = left.withColumnRenamed("sequence", "own").join(few(right), ["part", "key"]).groupBy("own", "other").agg(*(F.any_value(c).alias(c) for c in ("shingles", "weights", "other_shingles", "other_weights")))
    similar = met.select("own", "other", "shingles", "weights", "other_shingles", "other_weights").mapInArrow(verify, "own bigint, other bigint, similarity double")
    # From distinct windows back to items and documents: an item once for each window of a document, whatever the number of its own that are alike.
    by_item = similar.join(theirs.select(F.col("sequence").alias("other"), "item").distinct(), "other").groupBy("own", "item").agg(F.max("similarity").alias("similarity"))
    found = mine.select("doc", "at", F.col("sequence").alias("own")).join(by_item, "own")
    return found.groupBy("doc", "item").agg(F.count_distinct("at").alias("windows"), F.max("similarity").alias("similarity"))
