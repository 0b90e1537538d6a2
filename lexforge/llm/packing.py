"""Problem 6: containers of fixed capacity filled with whole texts.

First-fit decreasing, with the open containers' free space in a tournament
tree: each inner node holds the greatest free space below it, so the first
container with room is found by one walk down. Items are dealt to randomised
groups of bounded size which are packed independently; what a group leaves
unused is at most its last containers, a share that shrinks with its size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import cut, one_row_per_key

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, chunk: int = 64) -> DataFrame:
    """(key, tokens): size of every text in tokens of a public tokenizer, given by its file (tokenizers or sentencepiece).

    Rows that repeat a key count once; null and empty texts have size 0; rows without a key are left out.
    """

    df.sparkSession.sparkContext.addFile(tokenizer)  # the driver's file goes to every executor
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        path = SparkFiles.get(name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            sizes = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            sizes = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        for batch in batches:
            out: list[int] = []
            for s in range(0, batch.num_rows, chunk):
                out += sizes([t or "" for t in batch.column(1).slice(s, chunk).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["key", "tokens"])

    rows = one_row_per_key(df.select(F.col(key), F.col(text).cast("string").alias("_text")).where(F.col(key).isNotNull()), key, "_text")
    return rows.mapInArrow(count, f"key {rows.schema['key'].dataType.simpleString()}, tokens bigint")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; sizes in descending order, none above the capacity."""
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [capacity] * (2 * width)
    out = []
    for size in sizes:
        node = 1
        while node < width:  # to the first container with room
            node *= 2
            if tree[node] < size:
                node += 1
        out.append(node - width)
        tree[node] -= size
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def pack(sizes: DataFrame, limits: DataFrame, group_containers: int = 2000, group_items: int = 20_000, seed: int = 11, limits_at_once: int = 500) -> DataFrame:
    """(limit_id, key, piece, tokens, container): the container of every piece of every item, for each limit.

    sizes: key, tokens (see token_counts); limits: limit_id, capacity_tokens. An item up to the capacity is one piece
    (0); a greater one is cut into pieces of the whole capacity and a rest. A container's name is "group-number"
    within its limit. Items of size 0 are placed too. Limits that are null or below 1 are skipped; no items or no limits give no
    rows. group_containers and group_items bound what one task packs at a time.
    """
    sizes = cut(sizes)
    rows = limits.select("limit_id", "capacity_tokens").where("limit_id is not null and capacity_tokens >= 1").distinct()
    several = -(-rows.count() // limits_at_once)
    if several > 1:  # limits go into the plan, so that many of them are taken in turn
        turn = F.pmod(F.xxhash64("limit_id", "capacity_tokens"), F.lit(2 * several))
        parts = [pack(sizes, limits.where(turn == i), group_containers, group_items, seed, 4 * limits_at_once) for i in range(2 * several)]
        return reduce(DataFrame.unionByName, parts)
    rows = rows.collect()
    total, items = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    kind = sizes.schema["key"].dataType.simpleString()
    schema = f"limit_id {limits.schema['limit_id'].dataType.simpleString()}, key {kind}, piece int, tokens bigint, container string"
    each = [F.struct(F.lit(r.limit_id).alias("limit_id"), F.lit(int(r.capacity_tokens)).cast("bigint").alias("capacity"), F.lit(max(1, -(-total // (r.capacity_tokens * group_containers)), -(-items // group_items))).cast("bigint").alias("groups")) for r in rows]
    if not each:
        return sizes.sparkSession.createDataFrame([], schema)
    split = sizes.select("key", "tokens", F.explode(F.array(*each)).alias("l")).select("key", "tokens", "l.*")
    pieces = split.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("tokens") / F.col("capacity")) - 1)).cast("int"))))
    pieces = pieces.withColumn("tokens", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("key", "piece", F.lit(seed)), "groups"))

    def fill(table: pa.Table) -> pa.Table:
        size = table["tokens"].to_numpy()
        order = np.lexsort((table["piece"].to_numpy(), np.array([str(k) for k in table["key"].to_pylist()]), -size))
        table = table.take(pa.array(order))
        group = table["group"][0].as_py()
        bins = first_fit_decreasing(size[order].tolist(), table["capacity"][0].as_py())
        return table.select(["limit_id", "key", "piece", "tokens"]).append_column("container", pa.array([f"{group}-{b}" for b in bins]))

    return pieces.select("limit_id", "group", "capacity", "key", "piece", "tokens").groupBy("limit_id", "group").applyInArrow(fill, schema)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, containers, pieces, tokens, filled): how full the containers of each limit are."""
    used = packed.groupBy("limit_id", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    report = used.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    limits = limits.select("limit_id", "capacity_tokens").distinct()
    return report.join(limits, "limit_id").select("limit_id", "containers", "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
