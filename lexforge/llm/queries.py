"""Queries of the training-data problems over the tables of a folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import answer_defects, frequencies, leaks, look_alikes, near_duplicates, nearest_vectors, packing, residue


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors.nearest_vectors(_table(spark, folder, "postings"), _table(spark, folder, "codebook"), k=5)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    near = p1_neighbours(spark, folder)
    return near.select(F.least("vector_id", "other_id").alias("vector_id_a"), F.greatest("vector_id", "other_id").alias("vector_id_b")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    answers = {"answer_b1": "generation.answer_b1", "answer_mmr": "generation.answer_mmr", "ground_truth": "ground_truth"}
    found = answer_defects.find_defects(_table(spark, folder, "llm_detail"), "detail_id", "query", answers)
    return answer_defects.chief_defect(found).withColumnRenamed("key", "detail_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    corpus = look_alikes.look_alikes(_table(spark, folder, "cuad_corpus"), "doc_id", "text")
    categories = look_alikes.look_alikes(_table(spark, folder, "cuad_category_map"), "row_id", "description")
    return corpus.select(F.lit("cuad_corpus.text").alias("field"), "id_a", "id_b").unionByName(categories.select(F.lit("cuad_category_map.description").alias("field"), "id_a", "id_b"))


def p3_canonical_texts(spark: SparkSession, folder: str) -> DataFrame:
    corpus = look_alikes.canonicalize(_table(spark, folder, "cuad_corpus").select("doc_id", "text").distinct(), "text", "form")
    return corpus.select("doc_id", F.md5("text").alias("text_md5"), F.md5("form").alias("form_md5"), (F.col("text") != F.col("form")).alias("changed"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    classes = look_alikes.look_alike_classes(_table(spark, folder, "cuad_corpus"), "doc_id", "text")
    return classes.select(F.col("key").alias("doc_id"), "spellings", "links")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = frequencies.mark_words(_table(spark, folder, "metadata_sram"), "chunk_id", "text")
    return marked.where(F.col("mark").isNotNull()).select("word", "mark")


def p4_word_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies.mark_words(_table(spark, folder, "metadata_sram"), "chunk_id", "text")


def p4_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies.mark_ngrams(_table(spark, folder, "metadata_sram"), "chunk_id", "text", max_n=3)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    half = Fraction(1, 2)
    chunks = near_duplicates.similar_keys(_table(spark, folder, "metadata_sram"), "chunk_id", "text", 3, half)
    contexts = near_duplicates.similar_elements(_table(spark, folder, "retrieval_results"), "retrieval_id", "mmr_contexts", 3, half)
    a, b = (F.concat_ws(":", F.col("key").cast("string"), F.col(i).cast("string")) for i in "ij")
    contexts = contexts.select(F.lit("mmr_contexts").alias("field"), F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b"))
    return chunks.select(F.lit("metadata_sram.text").alias("field"), "key_a", "key_b").unionByName(contexts)


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(_table(spark, folder, "metadata_sram"), "chunk_id", "text")
    return groups.withColumnRenamed("key", "chunk_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = packing.token_counts(_table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, _table(spark, folder, "pack_limits")).withColumnRenamed("key", "doc_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, folder), _table(spark, folder, "pack_limits"))


def _leaks(spark: SparkSession, folder: str, **how) -> DataFrame:
    return leaks.leaked_items(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "eval_items"), "item_id", "text", **how)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, exact=True).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_similar_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = _leaks(spark, folder)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows", F.round("similarity", 6).alias("similarity"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(_table(spark, folder, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p3_found, p3_canonical_texts, p3_classes, p4_found, p4_word_frequencies, p4_ngrams, p5_found, p5_groups, p6_containers, p6_fill, p7_found, p7_similar_passages, p8_found)}


_P4_WORDS = r"""
WITH r AS (SELECT chunk_id, max(text) AS text FROM metadata_sram GROUP BY chunk_id),
w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM r),
f AS (SELECT word, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM w GROUP BY word),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 3 > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM f)
"""


_P5_FOUND = r"""
WITH t AS (SELECT 'metadata_sram.text' AS field, '' AS block, chunk_id AS k, max(text) AS text FROM metadata_sram GROUP BY chunk_id
  UNION ALL
  SELECT DISTINCT 'mmr_contexts', CAST(retrieval_id AS VARCHAR), retrieval_id || ':' || (i - 1), mmr_contexts[i]
  FROM retrieval_results, unnest(range(1, len(mmr_contexts) + 1)) AS u(i)),
w AS (SELECT field, block, k, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM t),
g AS (SELECT DISTINCT field, block, k, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w),
n AS (SELECT field, k, count(*) AS n FROM g GROUP BY field, k),
p AS (SELECT a.field, a.k AS key_a, b.k AS key_b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.field = b.field AND a.block = b.block AND a.k < b.k GROUP BY ALL)
SELECT p.field, key_a, key_b FROM p JOIN n na ON na.field = p.field AND na.k = key_a JOIN n nb ON nb.field = p.field AND nb.k = key_b WHERE 2 * o >= na.n + nb.n - o"""


_P7_FOUND = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
w AS (SELECT side, id, regexp_extract_all(lower(regexp_replace(text, '[\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') AS ws FROM t),
g AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(ws) - 11, 1)), lambda i: array_to_string(ws[i:i + 12], ' '))) AS s FROM w)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.s = i.s WHERE d.side = 'd' AND i.side = 'i'"""


# What looks alike, written down for SQL on its own: letters of other scripts over Latin ones, kinds of space, and what doesn't show.
_OTHER = "аеорсухіјѕһԁԛԝӏѵѡАВЕКМНОРСТХЅІЈҮԚԜӀѴονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿօՕոսցհՏՍɑɡᴏᴄᴠᴡᴢꜱ"
_LATIN = "aeopcyxijshdqwlvwABEKMHOPCTXSIJYQWIVovpcjABEZHIKMNOPTYXCJoOnughSUagocvwzs"
_BLANKS = "\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\t"
_UNSEEN = "\\x{AD}\\x{34F}\\x{61C}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}"


def _form_sql() -> str:
    """The consistent form of `text`: full-width signs by their distance from the plain ones, ligatures, letters, spaces, accents last."""
    wide = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
    plain = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    form = f"regexp_replace(regexp_replace(text, '[{_UNSEEN}]', '', 'g'), '[{_BLANKS}]', ' ', 'g')"
    form = f"translate({form}, '{wide}', '{plain}')"
    for a, b in zip("ﬀﬁﬂﬃﬄﬅﬆ", ("ff", "fi", "fl", "ffi", "ffl", "st", "st")):
        form = f"replace({form}, '{a}', '{b}')"
    return f"nfc_normalize(translate(translate({form}, '{_OTHER}', '{_LATIN}'), 'µ', 'μ'))"


def _p3_sql() -> str:
    return f"""
WITH t AS (SELECT DISTINCT 'cuad_corpus.text' AS field, doc_id AS id, text FROM cuad_corpus WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT 'cuad_category_map.description', row_id, description FROM cuad_category_map WHERE description IS NOT NULL),
f AS (SELECT field, id, text, {_form_sql()} AS form FROM t)
SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form AND a.id < b.id AND a.text <> b.text
WHERE trim(a.form, ' ' || chr(10)) <> ''"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _p3_sql(),
        "p3_canonical_texts": f"SELECT doc_id, md5(text) AS text_md5, md5(form) AS form_md5, text <> form AS changed FROM (SELECT DISTINCT doc_id, text, {_form_sql()} AS form FROM cuad_corpus)",
        "p3_classes": f"""WITH m AS (SELECT DISTINCT doc_id, text, {_form_sql()} AS form FROM cuad_corpus WHERE text IS NOT NULL),
k AS (SELECT * FROM m WHERE trim(form, ' ' || chr(10)) <> '') SELECT doc_id, (SELECT count(DISTINCT text) FROM k b WHERE b.form = k.form) AS spellings,
(SELECT count(*) FROM k b WHERE b.form = k.form AND b.text <> k.text) AS links FROM k""",
        "p4_found": _P4_WORDS + "SELECT word, mark FROM m WHERE mark IS NOT NULL",
        "p4_word_frequencies": _P4_WORDS + "SELECT word, occurrences, records, mark FROM m",
        "p5_found": _P5_FOUND,
        "p7_found": _P7_FOUND,
        "p4_ngrams": r"""
WITH r AS (SELECT chunk_id, max(text) AS text FROM metadata_sram GROUP BY chunk_id),
w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM r),
g AS (SELECT chunk_id, n, unnest(list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS ngram
      FROM w, (VALUES (1), (2), (3)) AS v(n))
SELECT ngram, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT chunk_id) AS records,
CASE WHEN count(DISTINCT chunk_id) <= 2 THEN 'rare' WHEN count(DISTINCT chunk_id) * 3 > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM g GROUP BY ngram, n""",
    }
