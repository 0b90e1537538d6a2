"""Writers of index folders, preprocessed corpora, result tables, run records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.evaluation import SWEEP_COLUMNS
from lexforge.sources.readers import MANIFEST


def write_index(tables: dict[str, DataFrame], folder: str, rows_per_file: int = 1_000_000) -> None:
    """Postings are written by centroid, a folder each, so that a probe reads its lists alone; rows within a file are in the lists' order.

    A list is dealt to several tasks by its chunks, so that a hot one isn't one task's; its files are in order of themselves.
    """
    for name, df in tables.items():
        if name == "postings":
            dealt = df.repartition("centroid_id", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("centroid_id", "chunk_id")
            dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("centroid_id").parquet(f"{folder}/{name}.parquet")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_preprocessed(corpus: DataFrame, queries: DataFrame, categories: DataFrame, aspects: DataFrame, folder: str) -> None:
    """The four outputs of preprocessing: corpus (doc_id, text), queries, category map and query map."""
    for name, df in (("corpus", corpus.select("doc_id", "text")), ("queries", queries), ("category_map", categories), ("query_map", aspects)):
        df.write.mode("overwrite").json(f"{folder}/{name}.json")


def write_df_stats(words: DataFrame, total_docs: int, folder: str) -> None:
    """(word, df, total_docs): document frequencies with the number of documents they were counted over."""
    words.select("word", "df", F.lit(total_docs).cast("bigint").alias("total_docs")).write.mode("overwrite").parquet(f"{folder}/df_stats.parquet")


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def append_csv(df: DataFrame, path: str, first: list[str]) -> None:
    """Append rows in the columns that the table at the path has; a new table has `first` first and the others sorted."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        columns = spark.read.csv(path, header=True).columns
    else:
        columns = [c for c in first if c in df.columns] + sorted(c for c in df.columns if c not in first)
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("append").csv(path, header=True)


def write_sweep(metrics: DataFrame, records: DataFrame, folder: str, run_id: str, domain: str, queries: int) -> None:
    """A sweep's outputs: the metrics as CSV in their fixed columns, the retrieval records as JSON lines, a folder of records for
    each grid point, and the manifest that names them all. metrics: see evaluation.sweep; records: sweep_idx and what was retrieved."""
    spark = metrics.sparkSession
    paths = {"csv_path": f"{folder}/sweep_{run_id}.csv", "jsonl_path": f"{folder}/retrieval_{run_id}.jsonl", "combos_subdir": "combos"}
    named = metrics.withColumn("combo_artifact", F.concat(F.lit("combos/sweep_idx="), F.col("sweep_idx").cast("string")))
    named.orderBy("sweep_idx").select(*SWEEP_COLUMNS).coalesce(1).write.mode("overwrite").csv(paths["csv_path"], header=True)  # a row for each grid point
    lines = records.withColumn("run_id", F.lit(run_id)).withColumn("domain", F.lit(domain))
    lines.write.mode("overwrite").json(paths["jsonl_path"])
    lines.write.mode("overwrite").partitionBy("sweep_idx").json(f"{folder}/combos")
    row = (run_id, folder, domain, paths["csv_path"], paths["jsonl_path"], paths["combos_subdir"], queries, metrics.count())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/run_manifest.json")


def write_model_summary(rows: DataFrame, folder: str, label: str) -> None:
    """One configuration's rows under a name made of its label, and their means for every grid point beside them."""
    from lexforge.plans.evaluation import point_report

    values = [f.name for f in rows.schema.fields if f.dataType.typeName() == "double"]
    rows.write.mode("overwrite").csv(f"{folder}/{label}.csv", header=True)
    point_report(rows, values).coalesce(1).write.mode("overwrite").json(f"{folder}/{label}_summary.json")


def report(df: DataFrame, title: str, rows: int = 20) -> None:
    """A table's first rows on the console."""
    print(f"== {title}")
    df.show(rows, truncate=60)
