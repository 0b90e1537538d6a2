"""Scalar text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, unlike Java's own \s.
_SPACE = r"(?U)\s+"

#: The four aspects of a question (fixed values): name, label and task.
ASPECTS = (
    ("scope_subject", "[Scope/Subject] Identify clauses that define scope, subject matter, covered parties/assets/timeframe for '"),
    ("obligation_right", "[Obligation/Right] Identify core rights, duties, permissions, or restrictions imposed on parties regarding '"),
    ("exclusion_limitation", "[Exclusion/Limitation] Identify carve-outs, exceptions, caps, disclaimers, or liability limits related to '"),
    ("procedure_condition", "[Procedure/Condition] Identify triggers, prerequisites, notice requirements, timelines, and execution procedures for '"),
)

#: The question put to a generator (fixed value).
PROMPT = (
    "You are an expert legal assistant. Read the following contract excerpts carefully.\n\n[Contract Excerpts]\n{context}\n\n[Instruction]\n"
    "Based strictly on the excerpts above, extract the exact clauses or provide a direct answer to the following question. Do not add outside information.\n\nQuestion: {query}\nAnswer:"
)


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def remove_page_markers(c: Column) -> Column:
    """`Page -3-`, `Page 3 of 9` and `[Page 3]`, with the white space around them, become one space."""
    for pattern in (r"(?i)\s*Page\s+-\s*\d+\s*-\s*", r"\s*(?:Page|PAGE)\s+\d+\s+(?:of|OF)\s+\d+\s*", r"(?i)\s*\[\s*Page\s+\d+\s*\]\s*"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t]{2,}", " ")


def minimal_clean(c: Column) -> Column:
    """One kind of line end, no page markers, no runs of blanks, at most one empty line; null becomes empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(collapse_blanks(remove_page_markers(c)), "\n{3,}", "\n\n")


def clean_answer(c: Column) -> Column:
    return strip(minimal_clean(c))


def clean_text(c: Column) -> Column:
    """Control characters and runs of white space become one space; trimmed last."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def normalize(c: Column) -> Column:
    """For comparing: lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, " ")))


def category(description: Column) -> Column:
    """What the description is `related to`, in quotes; without it the whole description; Unknown if blank."""
    d = strip(F.coalesce(description, F.lit("")))
    found = strip(F.regexp_extract(d, r'(?i)related to\s+"([^"]+)"', 1))
    return F.when(d == "", "Unknown").when(found != "", found).otherwise(d)


def details(description: Column) -> Column:
    """What follows `Details:`, empty without it."""
    return strip(F.regexp_extract(description, r"(?s)Details:(.*)\z", 1))


def aspects(description: Column) -> Column:
    """The four aspect questions of a description, in the order of ASPECTS."""
    d = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), _SPACE, " "))
    more = details(d)
    hint = F.when(more != "", F.concat(F.lit(" Focus: "), more)).otherwise("")
    return F.array(*(F.concat(F.lit(task), category(d), F.lit("'."), hint) for _, task in ASPECTS))


def keyword(query: Column) -> Column:
    """The first quoted part, null if there is none or it is blank."""
    return F.nullif(strip(F.regexp_extract(query, '"([^"]*)"', 1)), F.lit(""))


def search_text(query: Column) -> Column:
    """Keyword and details for the encoder, without the standing phrase; the query itself if both are blank."""
    d = F.when(query.rlike(r"(?is)Details:"), strip(F.regexp_extract(query, r"(?is)Details:\s*(.*)\z", 1))).otherwise(strip(query))
    d = strip(F.regexp_replace(d, r'(?is)^Highlight the parts \(if any\) of this contract related to ".*?" that should be reviewed by a lawyer\.\s*Details:\s*', ""))
    k = keyword(query)
    text = F.when(k.isNotNull(), F.concat(k, F.lit(". "), d)).otherwise(d)
    return F.when(strip(text) == "", query).otherwise(text)


def heading(c: Column) -> Column:
    """The heading in the first two lines that aren't blank: Article, Section, or a number like 4.2, in this order; else empty."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != ""), 1, 2)
    text = F.array_join(lines, "\n")
    after = r"(?:\s*[:.\-]\s*|\s+).*"
    found = [F.regexp_extract(text, rf"(?im)^({start}{after})$", 1) for start in (r"Article\s+[A-Za-z0-9.\-()]+", r"Section\s+[A-Za-z0-9.\-()]+", r"\d{1,3}(?:\.\d{1,3}){1,3}")]
    return F.coalesce(*(F.nullif(strip(f), F.lit("")) for f in found), F.lit(""))


def trim_edges(c: Column) -> Column:
    """Without what stands before the first blank and after the last one, where a piece was cut in a word."""
    return strip(F.regexp_replace(F.regexp_replace(c, "^[^ ]* ", ""), r" [^ ]*\z", ""))


def merge_overlap(left: Column, right: Column, most: int = 2000) -> Column:
    """Two pieces as one, with the longest common end and start once; else with a space between."""
    longest = F.least(F.length(left), F.length(right), F.lit(most))
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda n: (n <= longest) & (F.right(left, n) == F.left(right, n)))
    size = F.coalesce(F.array_max(sizes), F.lit(0))
    joined = F.when(size > 0, F.concat(left, F.substr(right, size + 1))).otherwise(F.concat(left, F.lit(" "), right))
    return F.when(F.coalesce(strip(left), F.lit("")) == "", right).when(F.coalesce(strip(right), F.lit("")) == "", left).otherwise(joined)


def pieces(truth: Column) -> Column:
    """The parts between [SEP], without blank ones; the stripped text itself if all are blank."""
    t = F.coalesce(truth, F.lit(""))
    parts = F.filter(F.transform(F.split(t, r"\[SEP\]"), strip), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.when(t.contains("[SEP]"), F.lit("")).otherwise(strip(t)))).otherwise(parts)


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def unique_ratio(c: Column) -> Column:
    w = words(c)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / F.size(w))


def word_recall(truth: Column, text: Column) -> Column:
    """Share of the truth's words, repeated ones too, that the text has."""
    t, have = words(truth), F.array_distinct(words(text))
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda w: F.array_contains(have, w))) / F.size(t))


def covered(truth: Column, text: Column) -> Column:
    """1 if the text covers a part of the truth: all of at most three words, or 85 of 100 of more; else 0."""
    t = F.transform(pieces(truth), words)
    hit = lambda p, have: F.size(F.filter(p, lambda w: F.array_contains(have, w))) / F.greatest(F.size(p), F.lit(1))
    found = lambda have: F.exists(t, lambda p: (F.size(p) > 0) & F.when(F.size(p) <= 3, hit(p, have) >= 1).otherwise(hit(p, have) >= 0.85)).cast("int")
    # The text's words as a variable: written out within the filter, they would be sought again for every word of the truth.
    return F.transform(F.array(F.array_distinct(words(text))), found)[0]


def answer_coverage(truth: Column, answer: Column) -> Column:
    """The greatest word recall of a part of the truth."""
    have = F.array_distinct(words(answer))
    part = lambda p: F.when(F.size(p) == 0, 0.0).otherwise(F.size(F.filter(p, lambda w: F.array_contains(have, w))) / F.size(p))
    return F.array_max(F.transform(F.transform(pieces(truth), words), part))


def token_estimate(texts: Column) -> Column:
    """About how many tokens the texts have: a quarter of their characters, at least one each; blank ones none."""
    return F.aggregate(F.filter(texts, lambda t: strip(t) != ""), F.lit(0), lambda n, t: n + F.greatest(F.lit(1), F.floor(F.length(t) / 4).cast("int")))


def tag_context(doc_id: Column, target: Column, section: Column, text: Column) -> Column:
    """A context with a line that names its source."""
    source = F.when(strip(doc_id.cast("string")) == strip(target.cast("string")), "TARGET CONTRACT").otherwise(F.concat(F.lit("REFERENCE CONTRACT "), doc_id.cast("string")))
    return F.concat(F.lit("--- [Source: "), source, F.lit(" | Section: "), F.coalesce(section, F.lit("")), F.lit("] ---\n"), text)


def untag_context(c: Column) -> Column:
    return F.regexp_replace(c, r"^--- \[Source: .*\] ---\n", "")


def generation_prompt(query: Column, contexts: Column) -> Column:
    block = F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, F.array_join(contexts, "\n\n")).otherwise("(No context)")
    head, rest = PROMPT.split("{context}")
    middle, tail = rest.split("{query}")
    return F.concat(F.lit(head), block, F.lit(middle), F.coalesce(query, F.lit("")), F.lit(tail))


def safe_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def file_label(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w.\-]+", "_")


#: What a judge is asked (fixed value); a template of one's own may have the same places.
JUDGE_PROMPT = (
    "You compare three answers to a question about a contract.\n\nQuestion: {query}\n\nAnswer A: {a}\n\nAnswer B: {b}\n\nAnswer C: {c}\n\n"
    "Score each answer from 1 to 5 for comprehensiveness, conciseness and faithfulness, and name the best one, or TIE.\nReply with JSON only: "
    '{"winner": "A|B|C|TIE", "reason": "...", "scores": {"Answer_A": {"comprehensiveness": 0, "conciseness": 0, "faithfulness": 0}, "Answer_B": {...}, "Answer_C": {...}}}'
)


def judge_prompt(query: Column, a: Column, b: Column, c: Column, template: str = JUDGE_PROMPT) -> Column:
    """The template with the question and the three answers in their places, each as it is; null counts as empty."""
    out, rest = [], template
    for place, value in (("{query}", query), ("{a}", a), ("{b}", b), ("{c}", c)):
        head, rest = rest.split(place, 1)
        out += [F.lit(head), F.coalesce(value, F.lit(""))]
    return F.concat(*out, F.lit(rest))


_SCORE = "struct<comprehensiveness: double, conciseness: double, faithfulness: double>"


def judge_json(raw: Column) -> Column:
    """A judge's answer as a struct: the fenced block, else what stands in the outermost braces; null fields if malformed."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.from_json(F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit(""))), f"winner string, reason string, scores map<string, {_SCORE}>")


def judge_record(raw: Column, provider: Column | None = None) -> Column:
    """A judge's answer as a record that is never missing: what can't be read is a tie, with the reason and the answer as it came."""
    parsed = judge_json(raw)
    good = F.coalesce(parsed["winner"], F.lit("")) != ""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_SCORE}>"))
    return F.struct(
        F.when(good, parsed["winner"]).otherwise("TIE").alias("winner"), F.when(good, parsed["reason"]).when(raw.isNull(), "no answer from the judge").otherwise("not the JSON that was asked for").alias("reason"),
        F.when(good, F.coalesce(parsed["scores"], empty)).otherwise(empty).alias("scores"), (~good).alias("parse_error"), raw.alias("raw_response"), (F.lit(None).cast("string") if provider is None else provider).alias("provider"),
    )


def model_name(override: Column, *configured: Column, default: str = "") -> Column:
    """The first name that isn't blank: the override, then those of a configuration, then the default."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in (override, *configured)), F.lit(default))
