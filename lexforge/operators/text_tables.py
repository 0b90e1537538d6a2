"""Operators on tables of texts: deduplication, frequencies, word counts by group, chunks and their neighbours."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T

#: Formal words of contracts that say nothing about a subject (fixed values): compound adverbs by rule, helping verbs, names of parts.
LEGAL_STOPWORDS = [a + b for a in ("here", "there", "where") for b in ("after", "at", "by", "for", "from", "in", "inafter", "of", "on", "to", "under", "upon", "with")]
LEGAL_STOPWORDS += ["can", "could", "may", "might", "must", "ought", "shall", "should", "will", "would"]
LEGAL_STOPWORDS += ["agreement", "annex", "appendix", "article", "clause", "contract", "exhibit", "paragraph", "recital", "schedule", "section", "subsection"]
LEGAL_STOPWORDS += ["aforesaid", "foregoing", "notwithstanding", "parties", "party", "provided", "pursuant", "said", "thereof", "undersigned", "whereas", "witness"]
#: Common English function words (fixed values).
STOPWORDS = (
    "a an the and or but if of to in on at by for with from as is are was were be been being it its this that these those not no nor so than then there their they them he she his her you "
    "your we our us i my me do does did have has had who whom which what when where why how all any each few more most other some such only own same too very s t just into over under again "
    "once about between through during before after above below up down out off both because until while"
).split()
#: Tokens that tokenizers add (fixed values).
SPECIAL = ["cls", "sep", "pad", "unk", "mask", "[cls]", "[sep]", "[pad]", "[unk]", "<pad>"]


def deduplicate(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, copies): texts that are equal after cleaning, once, with the least key and how many rows have it; blank ones are dropped.

    Rows meet by a hash of 128 bits; a hot text is counted before the shuffle.
    """
    cleaned = docs.select(F.col(key).alias("_k"), T.clean_text(F.col(text)).alias("text")).where("text <> ''")
    return cleaned.groupBy(F.md5("text").alias("_h")).agg(F.min("_k").alias("doc_id"), F.any_value("text").alias("text"), F.count("*").alias("copies")).select("doc_id", "text", "copies")


def duplicate_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, doc_id): every row with the document that stands for it (for mapping references to rows). Texts stay where they are: hashes meet."""
    hashed = docs.select(F.col(key).alias("row_id"), T.clean_text(F.col(text)).alias("_t")).where("_t <> ''").select("row_id", F.md5("_t").alias("h"))
    first = hashed.groupBy("h").agg(F.min("row_id").alias("doc_id"))
    return hashed.join(first, "h").select("row_id", "doc_id")


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(word, df): in how many rows each word occurs."""
    return docs.select(F.explode(F.array_distinct(T.words(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def group_word_counts(docs: DataFrame, group: str, text: str, stop: DataFrame | None = None, most: int = 200) -> DataFrame:
    """(group, word, n, rank): the most frequent words of each group, without stop words, special tokens and single characters.

    Counts are taken before the ranking, so that a hot group costs no more than its words.
    """
    found = docs.select(F.col(group).alias("group"), F.explode(F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_'\-]+)"), F.lit(1)), lambda w: F.trim(w))).alias("word"))
    counted = found.where((F.length("word") >= 2) & ~F.col("word").isin(*SPECIAL)).groupBy("group", "word").agg(F.count("*").alias("n"))
    if stop is not None:
        counted = counted.join(stop.select("word").distinct(), "word", "left_anti")
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select("group", "word", "n", "rank")


def requested_groups(counts: DataFrame, docs: DataFrame, group: str, wanted: list[int]) -> tuple[DataFrame, list[int], list[int]]:
    """The word counts of the groups asked for, which of these are out of the range of the groups there are, and which have no words."""
    most = docs.agg(F.max(group)).first()[0]
    outside = sorted(w for w in set(wanted) if w < 0 or most is None or w > most)
    asked = docs.sparkSession.createDataFrame([(int(w),) for w in sorted(set(wanted))], "group int")
    kept = counts.join(F.broadcast(asked), "group", "left_semi")
    empty = asked.join(counts.select("group").distinct(), "group", "left_anti").orderBy("group")
    return kept, outside, [r.group for r in empty.collect() if r.group not in outside]


def chunk_report(chunks: DataFrame, text: str = "text", short: int = 50) -> DataFrame:
    """(chunks, short_chunks, least, greatest): how many chunks there are, how many have fewer than `short` characters, and the extreme lengths."""
    size = F.length(T.strip(F.col(text)))
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(size < short).alias("short_chunks"), F.min(size).alias("least"), F.max(size).alias("greatest"))


def stop_words(spark, more: list[str] | None = None) -> DataFrame:
    """All lists as one table, each word once."""
    return spark.createDataFrame([(w,) for w in sorted({*STOPWORDS, *LEGAL_STOPWORDS, *(more or [])})], "word string")


# --- Chunks -----------------------------------------------------------------------------------------------------

_CLAUSE = r"(?<!\n)(?=\n\n)|(?=\nArticle\b)|(?=\nS(?:ECTION|ection)\b)|(?=\n\d{1,3}\.\d{1,3}(?:\.\d+)?\s)"


def clauses(c):
    """A text's clauses: cut before empty lines, articles, sections and numbered paragraphs."""
    lines = T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"))
    return F.filter(F.transform(F.split(lines, _CLAUSE), T.strip), lambda x: x != "")


class _Places:
    """All places of some marks in a text, found by one search; which is the last one in a range is then a look-up."""

    def __init__(self, text: str, *marks: str):
        self.at = {m: [f.start() for f in re.finditer(f"(?={m})", text)] for m in marks}

    def last(self, mark: str, low: int, high: int) -> int | None:
        """The last place from low on and before high."""
        i = bisect_left(self.at[mark], high)
        return self.at[mark][i - 1] if i and self.at[mark][i - 1] >= low else None


def split_oversized(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most `size` characters: each ends after the last sentence in its second half, else line, else word; the next begins `overlap` earlier."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    places = _Places(text, r"\. ", r"\n", " ")
    half = max(1, size // 2)
    back = min(overlap, half - 1) if overlap > 0 else 0

    def spans() -> Iterator[tuple[int, int]]:
        start = 0
        while len(text) - start > size:
            full = start + size
            ends = ((places.last(r"\. ", start + half, full - 1), 2), (places.last(r"\n", start + half, full), 1), (places.last(" ", start + 1, full), 1))
            stop = next((p + width for p, width in ends if p is not None), full)
            yield start, stop
            start = max(stop - back, start + 1) if stop - back > start else stop
        yield start, len(text)

    return [p for a, b in spans() if (p := text[a:b].strip())]


def split_sliding(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` characters that end at the last mark in their final third, each beginning `overlap` before the end of the one before."""
    places = _Places(text, r"[\n ;:?!]")  # after a full stop or a comma with a blank, the blank is the later mark

    def spans() -> Iterator[tuple[int, int]]:
        start, stop = 0, 0
        while stop < len(text):
            stop = min(len(text), start + size)
            mark = places.last(r"[\n ;:?!]", start + max(1, int(size * 0.7)), stop)
            if mark is not None and mark > start + 10:
                stop = mark + 1
            yield start, stop
            start = stop - overlap if stop - overlap > start else start + max(1, int(size * 0.25))

    return [p for a, b in spans() if (p := text[a:b].strip())]


def join_overlapping(pieces: list[str], most: int = 2000) -> str:
    """Pieces as one text: the longest common end and start of neighbours stands once; without one, a space is between. Blank pieces are left out."""
    out = ""
    for piece in pieces:
        if not out.strip() or not piece.strip():
            out = piece if not out.strip() else out
            continue
        tail, key = out[-most:], piece[:12]
        shared, at = 0, tail.find(key)
        while at >= 0 and not shared:  # long overlaps hold the piece's beginning whole, the leftmost is the longest
            shared = len(tail) - at if piece.startswith(tail[at:]) else 0
            at = tail.find(key, at + 1)
        shared = shared or next((n for n in range(min(len(key), len(tail)), 0, -1) if tail.endswith(piece[:n])), 0)
        out += piece[shared:] if shared else f" {piece}"
    return out


def _splitter(how, size: int, overlap: int):
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: how(t, size, overlap) if t is not None else [])

    return split


def chunk(docs: DataFrame, key: str, text: str, by: str = "clause", size: int = 1500, overlap: int = 300) -> DataFrame:
    """(chunk_id, doc_id, chunk_idx, section_heading, text): the chunks of every document.

    by: "clause" cuts at clauses and, where these are too long, at sentences
    (only such clauses leave the JVM); "sliding" takes overlapping windows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    if by == "clause":
        back = max(max(100, min(200, size // 10)), min(200, overlap // 2))
        parts = rows.select("doc_id", F.posexplode(clauses(F.col("text"))).alias("major", "text"))
        short = parts.where(F.length("text") <= size).withColumn("minor", F.lit(0))
        long = parts.where(F.length("text") > size).select("doc_id", "major", F.posexplode(_splitter(split_oversized, size, back)("text")).alias("minor", "text"))
        parts = short.unionByName(long)
    else:
        parts = rows.select("doc_id", F.lit(0).alias("major"), F.posexplode(_splitter(split_sliding, size, overlap)("text")).alias("minor", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("major", "minor")) - 1
    parts = parts.withColumn("chunk_idx", place).where(T.strip(F.col("text")) != "")
    return parts.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")).alias("chunk_id"), "doc_id", "chunk_idx", T.heading(F.col("text")).alias("section_heading"), "text")


def stitch(chunks: DataFrame, picked: DataFrame | None, radius: int = 1, trim: bool = False, along: str | None = None) -> DataFrame:
    """(chunk_id, stitched): picked chunks with up to `radius` neighbours on either side in their document, up to a gap, overlaps merged.

    along: a column of `picked`, then with one row for each chunk, that comes with the result; without `picked` one of `chunks`, not null for those picked.

    One range frame over each document's chunks; no chunk is paired with all others of its document.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_idx").rangeBetween(-radius, radius)
    # Marked before the texts are brought together, so that rows with their neighbours' texts aren't shuffled.
    if picked is None:
        picked = chunks
        marked = chunks.select("chunk_id", "doc_id", "chunk_idx", "text", F.col(along).isNotNull().alias("picked"), along)
    else:
        marks = picked.select("chunk_id", F.lit(True).alias("picked")).distinct() if along is None else picked.select("chunk_id", F.lit(True).alias("picked"), along)
        marked = chunks.select("chunk_id", "doc_id", "chunk_idx", "text").join(marks, "chunk_id", "left")
    near = marked.withColumn("near", F.array_sort(F.collect_list(F.struct("chunk_idx", "text")).over(w))).where("picked")
    own = F.col("chunk_idx")
    has = lambda i: F.exists("near", lambda n: n["chunk_idx"] == i)
    linked = F.filter("near", lambda n: F.forall(F.sequence(F.least(n["chunk_idx"], own), F.greatest(n["chunk_idx"], own)), has))
    edge = T.trim_edges if trim else (lambda c: c)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([join_overlapping([p for p in pieces or [] if p is not None]) for pieces in b.column(1).to_pylist()], pa.string()), *b.columns[2:]], ["chunk_id", "stitched", *more])

    more = [] if along is None else [along]
    schema = "".join(f", {c} {picked.schema[c].dataType.simpleString()}" for c in more)
    return near.select("chunk_id", F.transform(linked, lambda n: edge(n["text"])).alias("pieces"), *more).mapInArrow(merge, f"chunk_id string, stitched string{schema}")
