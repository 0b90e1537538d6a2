"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates two words: anything but letters, digits and underscores.
WORD_GAP = r"[^\p{L}\p{N}_]+"
#: The same for words made of letters and digits only.
ALNUM_GAP = r"[^\p{L}\p{N}]+"
#: Characters that take no room on a page: zero-width ones, soft hyphens, marks of direction.
_INVISIBLE_RANGES = (  # fixed values: first and last code point
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
)
INVISIBLE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _INVISIBLE_RANGES) + "]"

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def lower(texts: pa.Array) -> pa.Array:
    """Lower case as Python has it; Arrow's kernel differs for two letters, whose texts take the slower way."""
    special = pc.match_substring_regex(texts, "[Σİ]")
    if pc.any(special).as_py():
        return pa.array([t if t is None else t.lower() for t in texts.to_pylist()], texts.type)
    return pc.utf8_lower(texts)


def split_words(texts: pa.Array, gap: str = WORD_GAP) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text in lower case.

    Returns the code of every word in order, the number of words of each text
    and the dictionary of the codes. Null texts have no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    clean = pc.utf8_trim(pc.replace_substring_regex(lower(texts), gap, " "), " ")
    parts = pc.split_pattern(clean, " ")
    lengths = np.diff(parts.offsets.to_numpy())
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # a text without words is split into one empty string
        keep = codes != empty
        owner = np.repeat(np.arange(len(texts)), lengths)
        codes, lengths = codes[keep], np.bincount(owner[keep], minlength=len(texts))
    return codes, lengths, coded.dictionary


def word_hashes(texts: pa.Array, gap: str = WORD_GAP) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in order, and the number of words of each text."""
    codes, lengths, words = split_words(texts, gap)
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    return (table[codes] if len(codes) else np.empty(0, np.uint64)), lengths


def run_hashes(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of n words within one text: hashes, the text's index and the run's first word in it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    total = len(hashes) - n + 1
    out = mix64(hashes[:total])
    for i in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + total])
    inside = owner[:total] == owner[n - 1 :]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    own = owner[:total][inside]
    return out[inside], own, np.flatnonzero(inside) - starts[own]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where the session runs in one process, as in tests, a folder of this machine will do; on a cluster it wouldn't, so that one has to be named there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "lexforge-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a result that is used more than once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def one_row_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): rows that repeat a key count once (the greatest value, should they differ); rows without a key stay."""
    keyed = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(value).alias("value"))
    loose = df.where(F.col(key).isNull()).select(F.lit(None).cast(keyed.schema["key"].dataType).alias("key"), F.col(value).alias("value"))
    return keyed.unionByName(loose)


def tasks_for(df: DataFrame, least: int = 1) -> int:
    """As many tasks as the session's shuffles have."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
