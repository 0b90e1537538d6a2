"""Problem 4: how often every word or word n-gram occurs, and in how many records.

A distributed suffix array. Records are spread over tasks whole; a task takes
them in blocks, sorts the block's suffixes (by prefix doubling, four words deep
or as deep as the longest n-gram asked for), and reads all counts off the common-prefix
intervals: an interval's length is the number of occurrences, and that minus
the suffixes which follow one of their own record in the interval is the
number of records. As no record lies in two blocks, both counts add up over
blocks, so only one row per distinct n-gram and block is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import one_row_per_key, split_words

_OUT = pa.schema([("ngram", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])


def suffix_array(words: np.ndarray, record: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all records in the order of their first `depth` words at least, and how many words each has in common with the one before.

    words: codes from 1, all records one after another; record: each word's record, with which its suffixes end.
    Suffixes with the same words are in the order of their records.
    """
    size = len(words)
    # Rank of every suffix by its first `known` words, doubled until deep enough or until no two are alike.
    rank, known = words.astype(np.int64), 1
    while known < depth and rank.max() < size:
        after = np.zeros(size, np.int64)
        same = record[:-known] == record[known:] if size > known else np.empty(0, bool)
        after[: len(same)][same] = rank[known:][same]
        _, rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
        rank, known = rank.astype(np.int64) + 1, known * 2
    order = np.argsort(rank, kind="stable")
    # Common prefix of neighbours in the array, no longer than depth.
    prefix = np.zeros(size, np.int64)
    alive = np.arange(1, size)
    for k in range(depth):
        left, right = order[alive - 1], order[alive]
        a, b = np.minimum(left + k, size - 1), np.minimum(right + k, size - 1)
        alive = alive[(left + k < size) & (right + k < size) & (words[a] == words[b]) & (record[a] == record[left]) & (record[b] == record[right])]
        if not len(alive):
            break
        prefix[alive] = k + 1
    return order, prefix


def suffix_intervals(words: np.ndarray, record: np.ndarray, max_n: int, depth: int = 4) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n: the first word's position, occurrences and records of every distinct n-gram, off one suffix array.

    Where neighbours have fewer than n words in common, an interval ends: it is one n-gram, and its length the number of occurrences.
    A suffix whose n-gram also begins with the one before of the same record in the interval repeats that record.
    """
    size = len(words)
    if not size:
        return
    order, prefix = suffix_array(words, record, max(max_n, depth))
    own_record = record[order]
    records = int(record.max()) + 1
    for n in range(1, max_n + 1):
        long = (order + n <= size) & (record[np.minimum(order + n - 1, size - 1)] == own_record)
        if not long.any():
            return
        new = prefix < n
        interval = np.cumsum(new) - 1
        # Within an interval, occurrences of one record are brought side by side; all but the first repeat it.
        pairs = np.sort(interval[long] * records + own_record[long])
        repeated = np.concatenate([[False], pairs[1:] == pairs[:-1]])
        owner = pairs // records
        count = int(interval[-1]) + 1
        occurrences = np.bincount(owner, minlength=count)
        repeats = np.bincount(owner[repeated], minlength=count)
        there = occurrences > 0
        yield n, order[new][there], occurrences[there], (occurrences - repeats)[there]


def _block(texts: list[pa.Array], min_n: int, max_n: int) -> Iterator[pa.RecordBatch]:
    codes, lengths, dictionary = split_words(pa.concat_arrays(texts))
    record = np.repeat(np.arange(len(lengths)), lengths)
    for n, first, occurrences, records in suffix_intervals(codes + 1, record, max_n):
        if n < min_n:
            continue
        parts = [dictionary.take(pa.array(codes[first + i])) for i in range(n)]
        ngram = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        yield pa.RecordBatch.from_arrays([ngram, pa.array(np.full(len(first), n), pa.int32()), pa.array(occurrences), pa.array(records)], schema=_OUT)


def ngram_frequencies(df: DataFrame, key: str, text: str, max_n: int = 3, min_n: int = 1, block_mb: int = 16) -> DataFrame:
    """(ngram, n, occurrences, records) of every n-gram of min_n to max_n words, over all records.

    Words are the longest runs of letters, digits and underscores, in lower
    case. A record is a distinct key; rows that repeat a key count once, rows
    whose key is null are records of their own. Null, empty or wordless texts
    are records without words; an empty table gives no rows. An n-gram never
    crosses the end of its record. block_mb: text per suffix array, which
    bounds a task's memory (a longer record makes a block of its own).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += batch.nbytes
            if size >= block_mb << 20:
                yield from _block(held, min_n, max_n)
                held, size = [], 0
        if held:
            yield from _block(held, min_n, max_n)

    records = one_row_per_key(df.select(F.col(key), F.col(text).cast("string").alias("_text")), key, "_text")
    counted = records.select("value").mapInArrow(count, "ngram string, n int, occurrences bigint, records bigint")
    return counted.groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def record_count(df: DataFrame, key: str) -> int:
    """Distinct keys; rows without one count each."""
    row = df.agg(F.count_distinct(key).alias("keyed"), F.count(F.when(F.col(key).isNull(), 1)).alias("loose")).first()
    return row.keyed + row.loose


def mark_ngrams(df: DataFrame, key: str, text: str, max_n: int = 1, rare_max: int = 2, common_share: tuple[int, int] = (1, 3), min_n: int = 1) -> DataFrame:
    """(ngram, n, occurrences, records, mark): every n-gram of min_n to max_n words; mark is rare for those in at most rare_max records,
    common for those in more than the given share (a fraction) of all records, else null. What is both is rare."""
    total = record_count(df, key)
    part, whole = common_share
    mark = F.when(F.col("records") <= rare_max, "rare").when(F.col("records") * whole > F.lit(total) * part, "common")
    return ngram_frequencies(df, key, text, max_n, min_n).withColumn("mark", mark)


def mark_words(df: DataFrame, key: str, text: str, rare_max: int = 2, common_share: tuple[int, int] = (1, 3)) -> DataFrame:
    """(word, occurrences, records, mark): mark_ngrams of single words."""
    return mark_ngrams(df, key, text, 1, rare_max, common_share).select(F.col("ngram").alias("word"), "occurrences", "records", "mark")
