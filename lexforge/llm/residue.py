"""Problem 8: template residue, filler, error pages and script notices in place of content.

Character n-gram models of filler, of error messages, of notices that scripts
are needed and of the furniture of web pages stand against one of natural
prose. A residue model is mixed with prose: an n-gram that it doesn't know
tells against it by a fixed amount, however strange the text is, and so text is
residue only where a model recognises it, never because it is unlike the
table's other texts. The logarithms of the likelihood ratios are averaged over
sliding windows; windows above a threshold localise residue, and the part of a
document they cover decides.

Prose, and what the table's own filler looks like, are counted over all
documents, in tables of fixed size. Unfilled slots are spans between
delimiters, judged by the ratio of a model of slots to one of ordinary spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import seeds
from lexforge.llm.common import INVISIBLE

KINDS = ("filler", "error_page", "script_notice")
_MODELS = (*KINDS, "furniture")

# --- Characters ------------------------------------------------------------------------------------------------

_DROP, _BOUND, _SPACE = 0xFFFFFFFF, 1, 32


def _symbols() -> np.ndarray:
    """What each character counts as: letters without case and accents, one kind of digit, one kind of space; none for those that don't show."""
    hidden = re.compile(INVISIBLE)
    table = np.arange(0x10000, dtype=np.uint32)
    for point in range(1, 0x10000):
        c = chr(point)
        if hidden.match(c) or unicodedata.combining(c):
            table[point] = _DROP
        elif c.isspace():
            table[point] = _SPACE
        elif c.isdigit():
            table[point] = ord("0")
        elif c.isalpha():
            table[point] = ord(unicodedata.normalize("NFKD", c)[0].lower()[0])
        elif c in "’‘`´":
            table[point] = ord("'")
        elif c in "“”„«»":
            table[point] = ord('"')
        elif c in "–—‐‑":
            table[point] = ord("-")
    table[0] = _BOUND
    return table


_TABLE = _symbols()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, each between two spaces and a bound, and the text of each symbol.

    Signs of scripts that write words in one or two characters count three times each, so that an n-gram holds as much of them as of others.
    """
    points = np.frombuffer(("\0".join(t.replace("\0", " ") for t in texts)).encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(points < 0x10000, _TABLE[np.minimum(points, 0xFFFF)], points)
    owner = np.cumsum(codes == _BOUND, dtype=np.int64)
    keep = codes != _DROP
    codes, owner = codes[keep], owner[keep]
    blank = (codes == _SPACE) | (codes == _BOUND)
    keep = ~(blank & np.r_[True, blank[:-1]] & (codes == _SPACE))
    codes, owner = codes[keep], owner[keep]
    dense = ((codes >= 0x2E80) & (codes < 0xA000)) | ((codes >= 0xAC00) & (codes < 0xD7B0))
    times = np.where(codes == _BOUND, 4, np.where(dense, 3, 1))
    nth = np.arange(times.sum()) - np.repeat(np.r_[0, np.cumsum(times)[:-1]].astype(np.int64), times)
    codes, owner = np.repeat(codes, times), np.repeat(owner, times)
    edge = codes == _BOUND
    codes = np.where(edge, _SPACE, codes + (nth.astype(np.uint32) << 20) * (~edge & (nth > 0)))
    owner = owner - (edge & (nth < 2))  # two spaces end the text before, two begin the next
    return np.r_[_SPACE, _SPACE, codes, _SPACE, _SPACE].astype(np.uint64), np.r_[0, 0, owner, len(texts) - 1, len(texts) - 1]


def _grams(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each symbol; across the ends of texts too."""
    total = max(0, len(codes) - order + 1)
    out = codes[:total].copy()
    for i in range(1, order):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[i : i + total]
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _count(texts: list[str], order: int, bits: int) -> np.ndarray:
    """n-grams of a list of texts by bucket, those that come often counted less."""
    codes, owner = encode(texts)
    grams = _grams(codes, order, bits)
    inside = owner[: len(grams)] == owner[len(owner) - len(grams) :]
    return np.bincount(grams[inside], minlength=1 << bits).astype(np.float64)


# --- Slots -----------------------------------------------------------------------------------------------------

#: Names of what forms ask for (fixed values).
_FIELDS = (
    "recipient, sender, full name, street, house number, postcode, town, state, phone, fax, mobile, email, user name, order number, invoice no, reference, due date, birth date, day, month, year, salary, job title, "
    "manager, website, total, subtotal, discount, delivery date, bank, iban, account holder, contact person, borrower, lender, guarantor, employer, employee, contractor, landlord, tenant, buyer, seller, "
    "purchase price, deposit, interest rate, rent, property, vehicle, start date, end date, notice period, jurisdiction, court, witness, signature, title, client, customer, supplier, description, quantity, unit price, currency, "
    "department, branch, region, country, project, version, subject, text, value, field, party a, party b, registration number, tax id"
).split(", ")
_ASK = ("insert {}", "insert {} here", "enter {}", "enter {} here", "fill in {}", "add {}", "type {} here", "your {}", "put {} here", "specify {}", "{} here", "{} to be confirmed", "{} to be inserted", "{} to be completed", "{} to be agreed", "{} tbd", "{} - tba", "complete {}", "choose {}", "select {}", "please insert {}", "state {}")
_OPEN_CLOSE = ("{{ }}", "{{{ }}}", "${ }", "#{ }", "{% %}", "<% %>", "<%= %>", "<? ?>", "<< >>", "[[ ]]", "[% %]", "@@ @@", "@ @", "~~ ~~", ":: ::", "## ##", "%% %%", "$$ $$", "|* *|", "*| |*", "** **", "|| ||", "=[ ]=", "«", "« »", "‹ ›", "__ __", "___ ___", "XX_ _XX", "ZZ_ _ZZ", "% %", "# #", "$ $", "< >", "{ }", "[ ]", "[_ _]", "[___ ___]", "[* *]", "(( ))")
#: Spans that are no slots (fixed values): notes, quotations, marks of editing, tags, addresses, formulas.
_ORDINARY = """[1] [12] [sic] [...] [see note 3] [emphasis added] [reserved] [intentionally left blank] [signature page follows] [remainder of page left blank] [omitted] [he] [the committee] [sections 4 to 6] [footnote omitted] [laughter] [a] [iv] [citation needed] [translated from German]
[exhibit b] [schedule 2] [annex c] [page 4] [confidential treatment requested] [original on file] [as amended] [seal] [stamp] [illegible] [unchanged] [deleted] [2019] [2021-2024] [x] [yes] [no] [and others] [name of the ship in italics]
<b> <i> <em> <br> <p> <div class="a"> <span> <a href="x"> </p> </div> <john@mail.org> <http://www.site.org> <ann.lee@firm.com> <1%> <5> < 10 > <= x <x, y> {1, 2, 3} {a, b} {x: 1} {"id": 7} { return x; } {see below} {note} #1 and #2 # heading # 5% of 10% 3% and 4% net of 2% to 6%
(to be agreed between the parties in writing) (to be determined by the arbitrator) (as defined above) (the "Company") (hereinafter the buyer) (see clause 5) $5 and $10 $100 to $200 ** note ** *important* __init__ __name__ __main__ __file__ __dict__ __getattr__ __setitem__ __class__ __call__ __new__ __len__ __iter__ [start] [, stop] [expression] [options] [-v] [file ...] <type> <module> <lambda> <stdin> [source code] ____________ ___ :: std :: « il a dit » « oui » «не понимаю» "so" ** a ** || or || || and || @ home and @ work [today] [all parties] [sections renumbered] [end of document] [no entry]
"""

_PAIRS = (
    r"\{\{\{?[^{}]{1,200}\}?\}\}", r"[$#]\{[^{}]{1,200}\}", r"\{%[^%]{1,200}%\}", r"<%=?[^%]{1,200}%>", r"<\?[^?<>]{1,200}\?>", r"<<[^<>]{1,200}>>", r"\[\[[^\[\]]{1,200}\]\]", r"\[%[^%]{1,200}%\]", r"\{[^{}':=\x22\n]{1,80}\}",
    r"@@?[^@\n]{1,80}?@@?", r"~~[^~\n]{1,80}~~", r"(?<![:\w])::[^:\n]{1,80}::(?![:\w])", r"##[^#\n]{1,80}##", r"%%[^%\n]{1,80}%%", r"\$\$[^$\n]{1,80}\$\$", r"\|\*[^|\n]{1,80}\*\|", r"\*\|[^|\n]{1,80}\|\*", r"\|\|[^|\n]{1,80}\|\|", r"«[^«»]{1,200}»", r"‹[^‹›]{1,200}›",
    r"<[^<>]{1,200}>", r"\[[^\[\]]{1,300}\]", r"\([^()]{0,200}(?i:\btbd|\btba|\bto be \w{1,14})\)", r"%[A-Za-z][A-Za-z_ -]{0,58}[A-Za-z]%", r"#[A-Za-z][A-Za-z_ -]{0,58}[A-Za-z]#", r"\$[A-Za-z][A-Za-z_-]{0,58}[A-Za-z]\$", r"(?<!\w)(?:XX|ZZ|YY)_\w{1,60}_(?:XX|YY|ZZ)(?!\w)", r"(?<!\w)_{2,3}[A-Za-z][\w -]{0,58}[A-Za-z]_{2,3}(?!\w)",
)
_SPAN = re.compile("|".join(_PAIRS))
_HINT = re.compile(r"[\[{<«‹@%#~|$]|::|XX_|YY_|ZZ_|__|(?i:tbd|tba|to be)")
_NOT_SHOWN = re.compile(INVISIBLE)
_TAG = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|br|hr|div|span|a|b|i|u|em|strong|ul|ol|li|table|t[rdh]|tbody|thead|noscript|script|style|img|meta|link|center|font|sup|sub|pre|code|form|input|nav|footer|header|main|section|!doctype)\b[^<>]*>", re.I)


def _slot_seeds() -> list[str]:
    """Slots of every kind: names of fields in the ways in which programs and people write them, between delimiters."""
    out = []
    # Words of all kinds in places that only slots have, so that it is the place which tells.
    words = sorted(set(re.findall(r"[^\W\d_]{4,}", seeds.GENERAL)))
    for a, b in zip(words, words[7:] + words[:7]):
        a, b = a.lower(), b.lower()
        for body in (f"{a}_{b}", f"{a.title()}{b.title()}", f"{a}{b.title()}", f"{a}_{b}".upper()):
            out += [x.format(body) for x in ("<{}>", "«{}»", "[{}]", "{{{}}}", "${{{}}}", "{{{{ {} }}}}", "__{}__", "%{}%")]
        out += [x.format(f"{a} {b}") for x in ("<<{}>>", "{{{{{}}}}}", "{{{{ {} }}}}", "${{{}}}", "{{% {} %}}", "<%= {} %>", "@@{}@@", "[___{}___]", "~~{}~~")]
        for ask in _ASK:
            out.append(f"[{ask.format(a)}]")
    for field in _FIELDS:
        words = field.split(" ")
        forms = {field, field.title(), field.upper(), "_".join(words), "_".join(words).upper(), "".join(w.title() for w in words), words[0] + "".join(w.title() for w in words[1:]), "-".join(words)}
        for form in sorted(forms):
            for pair in _OPEN_CLOSE:
                left, right = (pair.split(" ") + [pair])[:2]
                out += [f"{left}{form}{right}", f"{left} {form} {right}"]
        for ask in _ASK:
            said = ask.format(field)
            for form in (said, said.capitalize(), said.upper()):
                out += [f"[{form}]", f"<{form}>", f"[___{form}___]", f"{{{form}}}"]
            if said.endswith(("tbd", "tba", "confirmed", "inserted", "completed")):
                out += [f"({said})"] * 4
    out += [x for mark in ("●", "•", "...", "…", "____", "xx", "tbd", "tba", "_", "__", "?", "??", "date", "name", "amount", "n") for x in (f"[{mark}]", f"[ {mark} ]")] * 6 + [f"{{{i}}}" for i in range(10)] * 8
    return out


class _Slots:
    """Ratio of two trigram models of spans, each mixed with the other's total, so that the unknown decides nothing."""

    BITS = 18

    def __init__(self) -> None:
        words = sorted(set(re.findall(r"[^\W\d_]{3,}", seeds.GENERAL)))
        quoted = [q.format(w) for w in words for q in ("«{}»", "[{}]", "<{}>", "{{{}}}", "[the {}]", "« {} »", "__{}__", "[a {} of this]", "[{} 3]")]
        plain = _SPAN.findall(_ORDINARY) * 20 + [t for t in _ORDINARY.split("\n") if t] * 2 + quoted
        slot, other = (self._counts(x) ** 0.6 for x in (_slot_seeds(), plain))
        slot, other = slot / slot.sum(), other / other.sum()
        both = (slot + other) / 2 + 1e-6
        self.ratio = (np.log((0.8 * slot + 0.2 * both) / (0.8 * other + 0.2 * both)) * 16).round().clip(-127, 127).astype(np.int8)

    def _marks(self, span: str) -> np.ndarray:
        # Upper case tells: a letter's case is kept as a sign of its own before runs of capitals.
        shown = re.sub(r"[A-Z]{2,}", lambda m: "\x02" + m.group(), re.sub(r"(?<=[a-z])(?=[A-Z])", "\x03", re.sub(r"_{4,}", "___", re.sub(r"\s+", " ", span))))
        return np.frombuffer((" " + shown.lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)

    def _counts(self, spans: list[str]) -> np.ndarray:
        out = np.zeros(1 << self.BITS)
        for s in spans:
            np.add.at(out, _grams(self._marks(s), 3, self.BITS), 1)
        return out

    def score(self, span: str) -> float:
        """Of the span's beginning and end: what stands between them may be as long as it likes."""
        marks = self._marks(span)
        if len(marks) > 26:
            marks = np.r_[marks[:15], marks[-11:]]
        return float(self.ratio[_grams(marks, 3, self.BITS)].sum()) / 16

    def found(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in _SPAN.finditer(text) if not _TAG.fullmatch(m.group()) and self.score(m.group()) > (-2 if len(m.group()) > 8 else 0)]


# --- Model -----------------------------------------------------------------------------------------------------


class ResidueModel:
    """window, threshold: symbols of a window, and their mean log likelihood ratio to prose from which it is residue;
    peak: the same for the strongest window of a message; passage, filler: the same for filler, which may stand beside content and so needs more evidence;
    learn: the same for texts that consist of filler, from which the table's own kind of it, known in part so far, is learned;
    share: of the content (all but web furniture) that messages must cover to stand in its place;
    unknown: weight of prose in a residue model, whose logarithm an unknown n-gram scores; mass: of a residue model's n-grams at most, however many languages it has; cap: most that one n-gram can score."""

    ORDER, BITS, SCALE = 5, 21, 32.0

    def __init__(self, window: int = 24, threshold: float = 0.6, passage: int = 56, filler: float = 1.1, learn: float = 0.25, peak: float = 0.8, share: float = 0.45, unknown: float = 0.2, cap: float = 3.0, general: float = 0.25, mass: float = 30_000):
        self.window, self.threshold, self.passage, self.filler, self.learn, self.peak, self.share = window, threshold, passage, filler, learn, peak, share
        self.unknown, self.cap, self.general, self.mass = unknown, cap, general, mass
        texts = {
            "filler": seeds.lines(seeds.FILLER) + seeds.mash(), "error_page": seeds.lines(seeds.ERROR) + seeds.http_messages() * 4,
            "script_notice": seeds.lines(seeds.SCRIPT), "furniture": seeds.lines(seeds.FURNITURE),
        }
        self.counts = {k: np.log1p(_count(t, self.ORDER, self.BITS)) for k, t in texts.items()}
        self.background = _count(seeds.GENERAL.strip().split("\n"), self.ORDER, self.BITS)
        self.slots = _Slots()
        self.tables()

    def tables(self, prose: np.ndarray | None = None, filler: np.ndarray | None = None) -> ResidueModel:
        """Scores of all n-grams from the seeds' counts and, if given, those of a table's prose and of its own filler."""
        base = self.background / self.background.sum()
        if prose is not None and prose.sum() > 0:
            base = self.general * base + (1 - self.general) * prose / prose.sum()
        base = base + 2e-7
        self.score = np.empty((1 << self.BITS, len(_MODELS)), np.int8)
        for i, k in enumerate(_MODELS):
            own = self.counts[k] / min(self.counts[k].sum(), self.mass)
            if k == "filler" and filler is not None and filler.sum() > 0:
                own = np.maximum(own, np.log1p(filler) / np.log1p(filler).sum())
            unknown = self.unknown * (1.5 if k == "filler" else 1)  # filler has many words of its own
            s = np.log((1 - unknown) * own / base + unknown)
            self.score[:, i] = (np.minimum(s, self.cap) * self.SCALE).round().clip(-127, 127)
        return self

    def parameters(self) -> tuple:
        return {k: v for k, v in vars(self).items() if k not in ("counts", "background", "slots")}, self.slots.ratio

    @classmethod
    def of(cls, parameters: tuple) -> ResidueModel:
        own, slots = object.__new__(cls), object.__new__(_Slots)
        vars(own).update(parameters[0])
        slots.ratio = parameters[1]
        own.slots = slots
        return own

    def judge(self, texts: list[str]) -> list[dict]:
        """Of each text: its kinds, and the number of symbols that filler and messages cover."""
        slots, shown = [], []
        for t in texts:
            t = _NOT_SHOWN.sub("", t) if not t.isascii() else t
            found = self.slots.found(t) if _HINT.search(t) else []
            slots.append(found)
            for a, b in reversed(found):  # what is a slot is no other kind
                t = t[:a] + t[b:]
            shown.append(_TAG.sub(" ", t) if "<" in t else t)
        out: list[dict] = [{"kinds": ["placeholder"] if s else [], "filler": 0, "message": 0, "size": 0} for s in slots]
        codes, owner = encode(shown)
        self.judge_grams(_grams(codes, self.ORDER, self.BITS), owner, slots, out)
        return out

    def judge_grams(self, grams: np.ndarray, owner: np.ndarray, slots: list[list[tuple[int, int]]], out: list[dict]) -> None:
        """The same from the texts' n-grams, into what is known of each text."""
        if not len(grams):
            return
        start = np.searchsorted(owner, np.arange(len(out) + 1))
        total = np.zeros((len(grams) + 1, len(_MODELS)), np.int32)
        np.cumsum(self.score[grams], axis=0, dtype=np.int32, out=total[1:])
        # A closer look is due where messages' windows may cover enough of what isn't furniture, where a passage is filler, and at short texts.
        w, count = min(self.window, len(grams)), len(out)
        high = (total[w:, 1:] - total[:-w, 1:]) > self.threshold * self.SCALE * w
        place = owner[: len(high)]
        message = w * np.bincount(place[high[:, 0] | high[:, 1]], minlength=count)
        furniture = w * np.bincount(place[high[:, 2]], minlength=count)
        size = np.diff(start) - self.ORDER + 1
        look = (message > 0) & (message >= self.share * (size - furniture)) | (size < self.passage)
        w = min(self.passage, len(grams))
        passage = (total[w:, 0] - total[:-w, 0]) > self.filler * self.SCALE * w
        look |= np.bincount(owner[: len(passage)][passage], minlength=count) > 0
        for d in np.flatnonzero(look):
            n = start[d + 1] - start[d] - self.ORDER + 1
            if n > 0:
                self._judge_one(total[start[d] : start[d] + n + 1], slots[d], out[d])

    def _judge_one(self, total: np.ndarray, slots: list[tuple[int, int]], out: dict) -> None:
        n = len(total) - 1
        size = min(self.window, n)
        score = (total[size:] - total[:-size]) / (size * self.SCALE)
        best = score.argmax(1)
        marks = {}
        for i, k in enumerate(_MODELS):
            hit = np.flatnonzero((best == i) & (score[:, i] > self.threshold))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + size, -1)
            marks[k] = np.cumsum(edge[:-1]) > 0
        residue = np.logical_or.reduce([marks[k] for k in KINDS])
        content = max(1.0, n + sum(b - a for a, b in slots) - float((marks["furniture"] & ~residue).sum()))
        message = marks["error_page"] | marks["script_notice"]
        if score[:, 1:3].max() <= self.peak:
            message[:] = False
        out["message"], out["size"] = int(message.sum()), n
        if message.any() and message.sum() >= (0.7 if slots else self.share) * content:  # a template's remains are short, so they need more
            least = max(12.0, 0.4 * message.sum())
            for k, other in (("error_page", "script_notice"), ("script_notice", "error_page")):
                if (marks[k] & ~marks[other]).sum() >= least:
                    out["kinds"].append(k)
        size = min(self.passage, n)
        hit = np.flatnonzero((total[size:, 0] - total[:-size, 0]) > self.filler * self.SCALE * size)
        if len(hit) and (n >= self.passage or not slots):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + size, -1)
            covered = np.cumsum(edge[:-1]) > 0
            out["filler"] = int((covered & ~message).sum()) if out["kinds"] else int(covered.sum())
            if out["filler"] >= min(self.passage, n):
                out["kinds"].append("filler")


def _slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about `most` characters (a longer text is a run of its own), with the place of each run's first."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def fit(df: DataFrame, text: str, **model) -> ResidueModel:
    """Models for a table: prose is counted over all of its texts that the seeds alone find no residue in, filler over
    those that consist of it. Counts are added up by bucket, so that the driver gets two arrays of fixed size."""
    own = ResidueModel(**model)
    shared = df.sparkSession.sparkContext.broadcast(own.parameters())
    order, bits = own.ORDER, own.BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ResidueModel.of(shared.value)
        model.filler = model.learn
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0).to_pylist()):
                codes, owner = encode(texts)
                grams = _grams(codes, order, bits)
                judged: list[dict] = [{"kinds": [], "filler": 0} for _ in texts]
                model.judge_grams(grams, owner, [[]] * len(texts), judged)
                inside = owner[: len(grams)] == owner[len(owner) - len(grams) :]
                own = np.array([0 if not j["kinds"] else 1 if j["filler"] > 0.5 * j["size"] else 2 for j in judged])[owner[: len(grams)]]
                for kind in (0, 1):
                    at = grams[inside & (own == kind)]
                    if kind == 0:
                        total[0] += np.bincount(at, minlength=1 << bits)
                    else:
                        np.add.at(total[1], at, 1)
        for kind in (0, 1):
            at = np.flatnonzero(total[kind])
            for s in range(0, len(at), 200_000):
                part = at[s : s + 200_000]
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(part), kind), pa.int32()), "bucket": pa.array(part, pa.int32()), "n": pa.array(total[kind][part])})

    counted = df.select(F.col(text).alias("text")).where(F.length(F.trim("text")) > 0).mapInArrow(count, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros((2, 1 << bits))
    found[counted["kind"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return own.tables(found[0], found[1])


def find_residue(df: DataFrame, key: str, text: str, model: ResidueModel | None = None, **how) -> DataFrame:
    """(key, kind): every row whose text has residue, one row per kind: placeholder, filler, error_page, script_notice.

    Null, empty and blank texts have none; rows without a key take no part;
    rows that repeat a key give each kind once; further columns are ignored.
    """
    model = model or fit(df, text, **how)
    shared = df.sparkSession.sparkContext.broadcast(model.parameters())  # plain arrays of fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ResidueModel.of(shared.value)
        for batch in batches:
            at, kind = [], []
            for first, texts in _slices(batch.column(1).to_pylist()):
                for i, found in enumerate(own.judge(texts)):
                    at += [first + i] * len(found["kinds"])
                    kind += found["kinds"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(kind, pa.string())], ["key", "kind"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(judge, f"key {rows.schema['key'].dataType.simpleString()}, kind string").distinct()
