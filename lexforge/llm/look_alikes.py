"""Problem 3: one consistent form for texts that look alike.

A text is stable where it holds only characters that no rule changes. The
unstable ones are known from Unicode's properties (the quick check of the
composed form, combining classes, kinds of decomposition, general category),
so that one scan finds the unstable segments: each is a run of such characters
with the character before it, to which a mark may belong. Only these segments
are normalised; they are spliced back between the untouched stable parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import INVISIBLE, cut

#: Letters with the shape of a Latin letter (fixed values), script by script.
_LOOKALIKES = (
    # Cyrillic
    ("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u04bb\u0501\u051b\u051d\u04cf\u0475\u0461", "aeopcyxijshdqwlvw"),
    ("\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u0405\u0406\u0408\u04ae\u051a\u051c\u04c0\u0474", "ABEKMHOPCTXSIJYQWIV"),
    # Greek
    ("\u03bf\u03bd\u03c1\u03f2\u03f3", "ovpcj"),
    ("\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7\u03f9\u037f", "ABEZHIKMNOPTYXCJ"),
    # Coptic
    ("\u2c80\u2c82\u2c88\u2c8e\u2c92\u2c94\u2c98\u2c9a\u2c9e\u2ca2\u2ca4\u2ca6\u2ca8\u2cac\u2c9f\u2ca3\u2ca5", "ABEHIKMNOPCTYXopc"),
    # Armenian
    ("\u0585\u0555\u0578\u057d\u0581\u0570\u054f\u054d", "oOnughSU"),
    # Cherokee
    ("\u13aa\u13f4\u13df\u13ac\u13bb\u13ab\u13e6\u13de\u13b7\u13e2\u13d2\u13da\u13a2\u13d9\u13b3\u13c3\u13a0\u13a1\u13a9\u13c0\u13d4", "ABCEHJKLMPRSTVWZDRYGW"),
    # Lisu
    ("\ua4d0\ua4d1\ua4d3\ua4d4\ua4d6\ua4d7\ua4d9\ua4da\ua4dc\ua4dd\ua4df\ua4e0\ua4e1\ua4e2\ua4e3\ua4e6\ua4e7\ua4ea\ua4eb\ua4ec\ua4ee\ua4f0\ua4f2\ua4f3\ua4f4", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Latin letters of phonetics: script a and g, and small capitals that are the small letters
    ("\u0251\u0261\u1d0f\u1d04\u1d20\u1d21\u1d22\ua731", "agocvwzs"),
)

#: Kinds of compatibility decomposition that leave a character's look as it is.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _rules() -> tuple[dict[str, str], str]:
    """What each character becomes, and the class of all unstable characters."""
    letters = {a: b for there, latin in _LOOKALIKES for a, b in zip(there, latin)}
    invisible = re.compile(INVISIBLE)
    becomes: dict[str, str] = {}
    unstable: list[int] = []
    for point in range(0x10000):  # what lies beyond is rare and taken as unstable throughout
        c = chr(point)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        tag = unicodedata.decomposition(c).split(" ")[0]
        if invisible.match(c):
            becomes[c] = ""
        elif kind == "Zs" and c != " " or c == "\t":
            becomes[c] = " "
        elif c in "\r\x0b\x0c\x85  ":
            becomes[c] = "\n"
        elif tag in _SAME_LOOK or tag == "<compat>" and "ROMAN NUMERAL" in unicodedata.name(c, "") or tag == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") or c == "µ"):
            becomes[c] = unicodedata.normalize("NFKC", c)
        elif c in letters:
            becomes[c] = letters[c]
        moves = unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or 0x1161 <= point <= 0x11FF
        if c in becomes or moves or any(x in letters for x in unicodedata.normalize("NFD", c)):
            unstable.append(point)
    spans, start = [], None
    for a, b in zip([None, *unstable], [*unstable, None]):
        if start is None or a + 1 != b:
            if start is not None:
                spans.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = b
    return becomes, "".join(spans) + "\U00010000-\U0010ffff"


_BECOMES, _UNSTABLE = _rules()


def canonical_form(table: dict[int, str] | None = None, unstable: str = _UNSTABLE):
    """A function from text to its consistent form, for use inside a task."""
    becomes = str.maketrans(_BECOMES) if table is None else table
    segment = re.compile(f"[{unstable}]+")
    styled = re.compile("[\U0001d400-\U0001d7ff]+")  # letters and digits of mathematics: the same ones in a style
    narrow = bytes(c for c in range(256) if not segment.match(chr(c)))
    normal = unicodedata.normalize

    def form(text: str) -> str:
        try:  # most texts need no more than this
            if not text.encode("latin-1").translate(None, narrow):
                return text
        except UnicodeEncodeError:
            pass
        text = text.replace("\r\n", "\n")
        out, done = [], 0
        for found in segment.finditer(text):
            start = max(found.start() - 1, done)  # with the character to which a mark may belong
            out.append(text[done:start])
            part = text[start : found.end()]
            part = styled.sub(lambda m: normal("NFKC", m.group()), part) if found.group() > "\uffff" or styled.search(part) else part
            # Decomposed first, so that a letter is seen apart from its accents; then the rules; then composed again.
            out.append(normal("NFC", normal("NFD", part.translate(becomes)).translate(becomes)))
            done = found.end()
        return "".join((*out, text[done:]))

    return form


def canonicalize(df: DataFrame, text: str, into: str) -> DataFrame:
    """The table with one more column (or that column replaced): the consistent form of a text column.

    Null stays null and empty stays empty. Letter case, accents, digits,
    punctuation and the number of spaces are kept. As letters of other scripts
    that look Latin become Latin in every text, the form is for comparing
    rather than for reading.
    """
    names = df.columns
    if names.count(text) != 1:
        raise ValueError(f"one column {text} is needed")
    table, unstable = str.maketrans(_BECOMES), _UNSTABLE

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to = canonical_form(table, unstable)
        for texts in batches:
            yield texts.map(to, na_action="ignore")

    return df.withColumn(into, form(F.col(text)))


def _members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, spelling): hashes of every key's consistent form and of its text as it is; blank ones left out."""
    table, unstable = str.maketrans(_BECOMES), _UNSTABLE

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = canonical_form(table, unstable)
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            at, form, spelling = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                c = to(t)
                if c.strip():
                    at.append(i)
                    form.append(digest(c.encode()))
                    spelling.append(digest(t.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(form, pa.binary()), pa.array(spelling, pa.binary())], ["key", "form", "spelling"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    return cut(rows.mapInArrow(hashes, f"key {rows.schema['key'].dataType.simpleString()}, form binary, spelling binary").distinct())


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, spellings, links): every key with the class of texts that look like its own (a hash of their form), how many
    spellings the class has, and how many keys have another spelling than this one.

    One row per key and text, whatever the number of copies; null and blank texts and rows without a key take no part.
    """
    members = _members(df, key, text)
    spelled = members.groupBy("form", "spelling").agg(F.count("*").alias("own"))
    forms = spelled.groupBy("form").agg(F.count("*").alias("spellings"), F.sum("own").alias("all"))
    sizes = spelled.join(forms, "form").select("form", "spelling", "spellings", (F.col("all") - F.col("own")).alias("links"))
    return members.join(sizes, ["form", "spelling"]).select("key", F.lower(F.hex("form")).alias("form"), "spellings", "links")


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b): pairs of keys, id_a < id_b, whose texts look the same and are not the same sequence of characters.

    Null and blank texts (nothing but spaces and characters that don't show)
    and rows without a key take no part; rows that repeat a key and its text
    count once; copies of one text are no pair with each other. Texts travel as
    hashes: only the forms with several spellings are paired, spelling by
    spelling, and each spelling's keys are joined to the pairs last. The pairs of a large class are many: look_alike_classes has
    one row per key instead.
    """
    members = _members(df, key, text)
    spellings = members.select("form", "spelling").distinct()
    several = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    spellings = spellings.join(several, "form")
    a, b = (spellings.select("form", F.col("spelling").alias(c)) for c in ("left", "right"))
    pairs = a.join(b, "form").where("left < right").select("left", "right")
    a, b = (members.select(F.col("spelling").alias(c), F.col("key").alias(f"{c}_key")) for c in ("left", "right"))
    keys = pairs.join(a, "left").join(b, "right").where("left_key <> right_key")
    return keys.select(F.least("left_key", "right_key").alias("id_a"), F.greatest("left_key", "right_key").alias("id_b")).distinct()
