"""Readers of contracts, corpora, evaluation items, run records and index folders."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.functions import text as T

CONTRACTS = "data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<question: string, is_impossible: boolean, answers: array<struct<text: string>>>>>>>>"
INDEX_TABLES = ("centroids", "codebook", "postings", "metadata")


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """(article_idx, title, paragraphs) of a nested contracts file; it is an error if the file is missing or has no data."""
    rows = spark.read.schema(CONTRACTS).option("multiLine", True).json(path)
    out = rows.select(F.posexplode("data").alias("article_idx", "a")).select("article_idx", "a.title", "a.paragraphs")
    if out.isEmpty():
        raise ValueError(f"no contracts in {path}")
    return out


def contract_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(title, text): one file per title."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select("value", "_metadata.file_name")
    return files.select(F.regexp_replace(F.url_decode("file_name"), r"\.txt$", "").alias("title"), F.col("value").alias("text"))


def corpus(articles: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, article_idx, title, text) of the articles that have a text, numbered in their order, and the (article_idx, title) of those skipped.

    Keys are sorted in parts, and a part's numbers begin after those of the parts before it: no task sees all keys.
    """
    cleaned = texts.select("title", T.minimal_clean(F.col("text")).alias("text")).where(T.strip(F.col("text")) != "")
    named = articles.where(T.strip(F.coalesce("title", F.lit(""))) != "").select("article_idx", "title")
    found = named.join(cleaned.select("title").distinct(), "title", "left_semi").repartitionByRange("article_idx").withColumn("part", F.spark_partition_id())
    found = cut(found)  # which part a key is in must not change between the two uses
    sizes = found.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("article_idx")) - 1
    kept = found.join(F.broadcast(sizes.select("part", "before")), "part").select("article_idx", "title", (F.col("before") + place).cast("bigint").alias("doc_id"))
    return kept.join(cleaned, "title").select("doc_id", "article_idx", "title", "text"), articles.select("article_idx", "title").join(kept.select("article_idx"), "article_idx", "left_anti")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; in one process, where none is named, one of this machine."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "lexforge-checkpoints"))
    return df.checkpoint()


def contract_queries(articles: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, category, query_aspects, aspects, query_concat, ref_doc_id, answers) of every question that has an answer."""
    qas = articles.select("article_idx", F.explode("paragraphs").alias("p")).select("article_idx", F.explode("p.qas").alias("q")).select("article_idx", "q.*")
    answers = F.filter(F.transform("answers", lambda a: T.clean_answer(a["text"])), lambda a: a != "")
    rows = qas.where(~F.coalesce("is_impossible", F.lit(False)) & (T.strip(F.coalesce("question", F.lit(""))) != "")).withColumn("answers", answers).where(F.size("answers") > 0)
    rows = rows.join(docs.select("article_idx", F.col("doc_id").alias("ref_doc_id")), "article_idx").withColumn("query", T.strip(F.col("question")))
    rows = rows.withColumn("query_aspects", T.aspects(F.col("query")))
    return rows.select(
        "query", T.category(F.col("query")).alias("category"), "query_aspects", F.map_from_arrays(F.array(*(F.lit(n) for n, _ in T.ASPECTS)), "query_aspects").alias("aspects"),
        F.array_join(F.concat(F.array("query"), "query_aspects"), " ").alias("query_concat"), "ref_doc_id", F.array_join("answers", " [SEP] ").alias("answers"),
    )


def category_map(spark: SparkSession, queries: DataFrame, path: str | None = None) -> DataFrame:
    """(category, description): the map stored at the path if there is one, else the first description of every category of the queries (category, query), which is then stored there."""
    if path and _exists(spark, path):
        return spark.read.schema("category string, description string").json(path)
    rows = queries.where((F.col("category") != "Unknown") & (T.strip(F.coalesce("query", F.lit(""))) != ""))
    first = rows.groupBy("category").agg(F.min("query").alias("description") if "ord" not in queries.columns else F.min_by("query", "ord").alias("description"))
    if path:
        first.write.mode("overwrite").json(path)
        return spark.read.schema("category string, description string").json(path)
    return first


def processed(spark: SparkSession, folder: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and (query, ref_doc_id, answers, query_concat, query_aspects) as write_preprocessed stored them; with `most`, the
    first contexts alone. Queries that refer to no context that is there are left out."""
    docs = spark.read.schema("doc_id bigint, text string").json(f"{folder}/corpus.json")
    docs = docs.where(F.col("doc_id") < most) if most else docs
    queries = spark.read.schema("query string, ref_doc_id bigint, answers string, query_concat string, query_aspects array<string>, category string").json(f"{folder}/queries.json")
    known = queries.join(docs.select(F.col("doc_id").alias("ref_doc_id")), "ref_doc_id", "left_semi")
    return docs, known.select("query", "ref_doc_id", "answers", "query_concat", "query_aspects")


def dataset(spark: SparkSession, path: str, kind: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row_id, context) and (query, ref_row_id) of a local dataset: any of the names under which contexts and questions come; a list is joined,
    of a struct its text is taken. A row's id is its own if it has one (id, row_id, idx), else a hash of its content, so that it is the same in every run."""
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.json(path)

    def text(c: str):
        kind = rows.schema[c].dataType
        if kind.typeName() == "array":
            return F.array_join(F.col(c), " ")
        if kind.typeName() == "struct":
            names = [f.name for f in kind.fields]
            own = next((n for n in ("text", "contexts", "context") if n in names), None)
            if own is None:
                return F.lit(None).cast("string")
            return F.array_join(F.col(f"{c}.{own}"), " ") if kind[own].dataType.typeName() == "array" else F.col(f"{c}.{own}").cast("string")
        return F.col(c).cast("string")

    def pick(*options: str):
        found = [F.nullif(text(c), F.lit("")) for c in options if c in rows.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    named = rows.select(pick("id", "row_id", "idx").alias("own"), pick("context", "contexts", "text", "passage", "document", "abstract", "dict").alias("context"), pick("question", "query", "input").alias("query")).where("context is not null")
    named = named.withColumn("row_id", F.coalesce("own", F.md5(F.concat_ws("\x01", "context", "query"))))
    contexts = named.groupBy("row_id").agg(F.min("context").alias("context"))
    contexts = contexts.orderBy("row_id").limit(most) if most else contexts
    queries = named.where("query is not null").select("query", F.col("row_id").alias("ref_row_id")).distinct()
    return contexts, queries.join(contexts.select(F.col("row_id").alias("ref_row_id")), "ref_row_id", "left_semi").select("query", "ref_row_id")


_STRINGS = "array<string>"
_ITEM = (
    "query string, question string, input string, ground_truth string, answer string, reference string, b1_contexts array<string>, l2_contexts array<string>, contexts array<string>, "
    "b2_contexts array<string>, multi_contexts array<string>, mmr_contexts array<string>, ours_contexts array<string>"
)


def _context_text(c):
    """A context that is a text, or an object with one under any of four names."""
    fields = F.from_json(c, "text string, content string, chunk string, context string")
    own = F.coalesce(*(F.nullif(fields[n], F.lit("")) for n in ("text", "content", "chunk", "context")))
    return F.when(F.ltrim(c).startswith("{"), F.coalesce(own, c)).otherwise(F.coalesce(c, F.lit("")))


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """(query, ground_truth, b1_contexts, b2_contexts, mmr_contexts): a list of items, an object that holds one under any of five names, or one item."""
    item = f"struct<{', '.join(x.replace(' ', ': ', 1) for x in _ITEM.split(', '))}>"
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", ", ".join(f"{k} array<{item}>" for k in ("items", "data", "queries", "eval_data", "results")))
    lists = F.coalesce(F.from_json("value", f"array<{item}>"), *(wrapped[k] for k in ("items", "data", "queries", "eval_data", "results")), F.array(F.from_json("value", item)))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.coalesce(*(wrapped[k] for k in ("items", "data", "queries", "eval_data", "results")), lists))
    rows = whole.select(F.explode(listed).alias("i")).select("i.*")
    text = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs), F.lit(""))
    plain = lambda c: F.filter(F.transform(c, _context_text), lambda x: x != "")
    many = lambda *cs: F.coalesce(*(F.when(F.size(c) > 0, plain(F.col(c))) for c in cs), F.array().cast(_STRINGS))
    return rows.select(text("query", "question", "input").alias("query"), text("ground_truth", "answer", "reference").alias("ground_truth"), many("b1_contexts", "l2_contexts", "contexts").alias("b1_contexts"), many("b2_contexts", "multi_contexts").alias("b2_contexts"), many("mmr_contexts", "ours_contexts").alias("mmr_contexts"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: str, malformed: str = "fail") -> DataFrame:
    """Records of a JSON-lines file with run_id, taken from a name like retrieval_<run>.jsonl, else from the first record that has one; blank lines are skipped.

    malformed: "fail" ends the read at a line that is no record; "keep" gives such lines as rows of nulls with the line in `malformed`. None is ever lost.
    """
    names = StructType.fromDDL(schema).names
    lines = spark.read.text(path).select("value", "_metadata.file_name").where(F.trim("value") != "")
    wide = schema if "run_id" in names else f"{schema}, run_id string"
    own = StructType.fromDDL(wide).names
    full = StructType.fromDDL(wide).add("malformed", "string")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    rows = lines.select(parsed.alias("r"), "file_name").select("r.*", "file_name")
    if malformed == "fail":
        rows = rows.withColumn("malformed", F.when(F.col("malformed").isNotNull(), F.raise_error(F.concat(F.lit("no record: "), F.col("malformed")))))
    named = F.nullif(F.regexp_extract(F.col("file_name"), r"(?i)retrieval_(.+)\.jsonl$", 1), F.lit(""))
    out = rows.withColumn("run_id", F.coalesce(named, F.nullif(F.col("run_id"), F.lit("")), F.lit("unknown")))
    return out.select(*own, "malformed") if malformed == "keep" else out.where(F.col("malformed").isNull()).select(*own)


MANIFEST = "run_id string, artifact_root string, domain string, csv_path string, jsonl_path string, combos_subdir string, num_queries int, total_combinations int"


def manifest(spark: SparkSession, path: str) -> dict:
    """A run's manifest, one record; it is an error if there is none."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).first().asDict()


def run_records(spark: SparkSession, manifest_path: str | None = None, records_path: str | None = None) -> tuple[str, str, str]:
    """(folder, path of the records, run_id) of a run, from its records' path, or from its manifest: what that leaves out is told by the names."""
    if records_path is None and manifest_path is None:
        raise ValueError("a manifest or a path of records is needed")
    if records_path is None:
        m = manifest(spark, manifest_path)
        folder = m["artifact_root"] or os.path.dirname(manifest_path)
        records_path = m["jsonl_path"] or f"{folder}/retrieval_{m['run_id'] or ''}.jsonl"
        run = m["run_id"] or ""
    else:
        folder, run = os.path.dirname(records_path), ""
    if not _exists(spark, records_path):
        raise FileNotFoundError(records_path)
    found = re.match(r"retrieval_(.+)\.jsonl$", os.path.basename(records_path.rstrip("/")), re.I)
    run = run or (found.group(1) if found else "")
    if not run:
        first = spark.read.schema("run_id string").json(records_path).where("run_id is not null").select("run_id").first()
        run = first.run_id if first else "unknown"
    return folder, records_path, run


def index_bundle(spark: SparkSession, folder: str, tables: tuple[str, ...] = INDEX_TABLES, optional: tuple[str, ...] = ("rotation", "config", "df_stats")) -> dict[str, DataFrame]:
    """The tables of an index folder: all of the first are needed, the others come if they are there."""
    missing = [t for t in tables if not _exists(spark, f"{folder}/{t}.parquet")]
    if missing:
        raise FileNotFoundError(os.path.join(folder, f"{missing[0]}.parquet"))
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in (*tables, *(o for o in optional if _exists(spark, f"{folder}/{o}.parquet")))}


def index_config(tables: dict[str, DataFrame]) -> dict:
    """embedding_dim, num_centroids, num_subspaces of an index: as its configuration has them, else read off its tables."""
    stored = tables["config"].first().asDict() if "config" in tables else {}
    book = tables["codebook"].agg((F.max("m") + 1).alias("parts"), F.max(F.size("vec")).alias("width")).first()
    own = {"embedding_dim": book.parts * book.width, "num_centroids": tables["centroids"].count(), "num_subspaces": book.parts}
    return {**own, **{k: v for k, v in stored.items() if v is not None}}
