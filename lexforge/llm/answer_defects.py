"""Problem 2: prompt and response pairs with a defective response.

A multi-label linear classifier (empty, truncated, refusal, copy, language) on
hashed n-grams and on features of the pair. It is trained on responses that are
made defective on purpose: a bounded sample of the table's own pairs is cut
off, replaced by the question, by a refusal or by nothing, or swapped with a
response in another language. Rows of the sample that the first round already
finds defective don't count as sound in the second. Each label's threshold is
calibrated on held-out synthetic pairs.

Which language a text is in is told by its character trigrams: a few sentences
in each of many languages are known beforehand, the rest comes from the sample.
What counts is how much worse the answer fits the query's language than any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import seeds
from lexforge.llm.common import INVISIBLE

LABELS = ("empty", "refusal", "copy", "language", "truncated")

_HIDDEN = re.compile(INVISIBLE)
_WORD = re.compile(r"[^\W_]+")
_LABEL = re.compile(r"^\W*(?:answer|response|output|antwort|réponse|respuesta|a|question|q|frage|pregunta|you asked)\s*:\s*", re.I)
_PERSON = re.compile(r"\b(?:i (?:am|can|must|do|won|would|have|apolog|prefer|don)|i['’]|my|me|ich|je ne|puedo)\b", re.I)
_SOURCE = re.compile(r"(?:\s*(?:\[\d{1,3}\]|\((?:see|siehe|voir|véase) [^()]{1,40}\)))+\W*$", re.I)
_CLOSING = " \t\r\n\xa0*_`\"'”’»)]"
_ABBREVIATED = re.compile(r"(?:^|\s)(?:art|arts|sec|no|nos|para|cf|cl|approx|incl|e\.g|i\.e|viz|vs|abs|nr|bzw|z\.b|inkl|vgl|p\.ex|cf|núm|pág)\.$", re.I)
_SCRIPTS = ((0x370, 0x400), (0x400, 0x530), (0x530, 0x590), (0x590, 0x600), (0x600, 0x780), (0x900, 0xE00), (0xE00, 0xE80), (0x10A0, 0x1100), (0x3040, 0xA000), (0xAC00, 0xD7B0))
_HASHED = 1 << 13
_ENDINGS = 1 << 11
_DENSE = 31


def _plain(text: str | None) -> str:
    return _HIDDEN.sub("", text or "").replace("’", "'").replace("\xa0", " ")


_EDGES = np.array([0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x250, *(x for span in _SCRIPTS for x in span)])


def _scripts(text: str) -> np.ndarray:
    """Letters of each script; 0 is Latin. Signs between the scripts' blocks count for none."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    place = np.searchsorted(_EDGES, points, side="right")
    own = np.where(place % 2 == 1, np.maximum(place // 2 - 2, 0), len(_SCRIPTS) + 1)
    return np.bincount(own, minlength=len(_SCRIPTS) + 2)[:-1]


def _foreign(query: str, answer: str) -> float:
    """Share of the answer's letters in scripts that less than a twentieth of the query's letters have."""
    if query.isascii() and answer.isascii():
        return 0.0
    asked, given = _scripts(query), _scripts(answer)
    if not asked.sum() or not given.sum():
        return 0.0
    return float(given[20 * asked < asked.sum()].sum() / given.sum())


class Languages:
    """Character trigrams of each language: log probabilities by bucket, a row per bucket."""

    BITS = 14

    def __init__(self, table: np.ndarray | None = None):
        if table is None:
            self.counts = np.stack([self._counts(t) for t in seeds.LANGUAGES.values()], 1)
            self._fit()
        else:
            self.table = table

    def _fit(self) -> None:
        size = 1 << self.BITS
        all_of = self.counts.sum(1, keepdims=True)
        base = (all_of + 0.5) / (all_of.sum() + 0.5 * size)  # an n-gram unknown to a language is as likely as among all
        own = np.sqrt(self.counts)  # a text that repeats itself counts less
        total = own.sum(0)
        self.table = np.log(0.9 * own / total + 0.1 * base).astype(np.float32)

    def _grams(self, text: str) -> np.ndarray:
        # A name tells nothing about the language: words with a capital inside a text, and with digits, are left out.
        words = [w.lower() for i, w in enumerate(_WORD.findall(text)) if not any(map(str.isdigit, w)) and (i == 0 or w.islower() or w.isupper() or not w[0].isupper())]
        points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        if len(points) < 3:
            return np.empty(0, np.int64)
        h = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + points[2:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _counts(self, text: str) -> np.ndarray:
        return np.bincount(self._grams(text), minlength=1 << self.BITS).astype(np.float64)

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """Mean log probability of the text's trigrams in each language, and their number."""
        grams = self._grams(text)
        return (self.table[grams].mean(0) if len(grams) else np.zeros(self.table.shape[1], np.float32)), len(grams)

    def learn(self, texts: list[str]) -> None:
        """Add the counts of texts whose language is beyond doubt."""
        more = np.zeros_like(self.counts)
        for t in texts:
            s, n = self.score(t)
            order = np.argsort(s)
            if n >= 40 and s[order[-1]] - s[order[-2]] > 0.15:
                more[:, order[-1]] += self._counts(t)
        self.counts = self.counts + more
        self._fit()


def _margin(lang: Languages, asked: tuple[np.ndarray, int], given: tuple[np.ndarray, int]) -> float:
    """How much better the answer fits another language than those that the query may be in."""
    (q, nq), (a, na) = asked, given
    if nq < 3 or na < 3:
        return 0.0
    p = np.exp((q - q.max()) * min(nq, 60))
    return float(a.max() - (a * p).sum() / p.sum())


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def _features(query: str, asked: tuple[np.ndarray, int], answer: str | None, lang: Languages, known: dict[str, int]) -> tuple[np.ndarray, list[int], np.ndarray]:
    q, a = query, _plain(answer)
    shown = a.strip()
    bare = _LABEL.sub("", shown.replace("[SEP]", " ")).strip()
    qw, aw = [w.lower() for w in _WORD.findall(q)], [w.lower() for w in _WORD.findall(bare)]
    qs, as_ = set(qw), set(aw)
    tail = _SOURCE.sub("", shown).rstrip(_CLOSING)
    end = tail[-1:] if tail else ""
    raw_end = shown[-1:] if shown else ""
    broken = bool(_ABBREVIATED.search(tail)) and len(aw) > 4
    stopped = end in ".!?。！？؟।" and end != "" and not broken
    last_line = shown.rsplit("\n", 1)[-1].strip() if shown else ""
    inside, beyond = len(as_ - qs) / max(1, len(as_)), len(qs - as_) / max(1, len(qs))
    foreign = _foreign(q, bare)
    n = max(len(aw), len(bare) // 3 if foreign > 0.5 and any(c > "\u2e80" for c in bare) else 0)  # some scripts don't part words
    margin = _margin(lang, asked, lang.score(bare)) if n else 0.0
    margin += foreign  # the trigrams of other scripts are known to no language
    dense = np.array(
        [
            1.0, n == 0, n == 1, 2 <= n <= 4, n >= 8, min(n, 40) / 40, len(bare) <= 3,
            stopped, not stopped and n >= 5, not stopped and n >= 12, raw_end in ",;:(-–", shown.endswith("…") or shown.endswith("...") and n > 0,
            (shown.count('"') % 2 or shown.count("“") != shown.count("”") or shown.count("(") != shown.count(")") or shown.count("[") != shown.count("]")) and n > 2,
            shown.count("**") % 2 and n > 2, bool(re.fullmatch(r"\W*\d{1,2}[.)]?\W*", last_line)) and n > 3, bool(re.search(r"(?:^|\s)\w{1,3}$", tail)) and not stopped and n >= 5,
            inside <= 0.15 and n >= 3, inside <= 0.15 and beyond <= 0.4 and n >= 3, inside >= 0.3, beyond <= 0.1, max(0.0, 1 - inside) * max(0.0, 1 - beyond),
            min(1.5, 2 * margin), margin > 0.2 and n >= 4, margin > 0.45 and n >= 3, bool(_PERSON.search(bare)), n <= 30, inside <= 0.05 and beyond <= 0.35 and 3 <= n <= 2.2 * len(qw),
            foreign, foreign > 0.5, broken, margin > 0.3 and n >= 8,
        ],
        np.float32,
    )
    shown = bare if bare else ""  # what a label or a mark leaves
    ending = shown[-8:].lower()
    ends = [f"e{ending[i:]}" for i in range(max(0, len(ending) - 4), len(ending))] + ([f"l{aw[-1]}"] if n else [])
    if len(shown) <= 24:
        ends += [f"s{shown.lower()}", *(f"c{shown.lower()[i : i + 3]}" for i in range(max(1, len(shown) - 2)))]
    # n-grams of the whole answer, each once: a refusal counts as much wherever it stands.
    h = _word_hashes(aw if n > 1 or not bare or bare.isascii() else list(bare[:400]), known)
    step = np.uint64(0x9E3779B97F4A7C15)
    two = h[:-1] * step + h[1:]
    whole = np.concatenate([h, two, two[:-1] * step + h[2:]])
    whole = np.unique((whole ^ (whole >> np.uint64(31))) * step >> np.uint64(51))
    return dense, [xxhash.xxh32_intdigest(g) % _ENDINGS for g in ends], whole.astype(np.int64)


def _rows(pairs: list[tuple[str, str | None]], lang: Languages) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    known: dict[str, int] = {}
    asked: dict[str, tuple[str, tuple[np.ndarray, int]]] = {}
    for q, a in pairs:
        if q not in asked:
            asked[q] = (_plain(q), lang.score(_plain(q)))
        yield _features(*asked[q], a, lang, known)


def _matrix(pairs: list[tuple[str, str | None]], lang: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of pairs: those of the pair and of the ending as a matrix, and of each answer's n-grams the buckets that it has, one after another, with where each answer's begin."""
    near, grams = np.zeros((len(pairs), _DENSE + _ENDINGS), np.float32), []
    for i, (dense, ends, whole) in enumerate(_rows(pairs, lang)):
        near[i, :_DENSE] = 2 * dense
        if ends:
            np.add.at(near[i], np.array(ends) + _DENSE, 0.5)
        grams.append(whole)
    return near, np.concatenate([np.empty(0, np.int64), *grams]), np.r_[0, np.cumsum([len(g) for g in grams])].astype(np.int64)


def _taken(x: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some rows of such features; the n-grams with the row of each."""
    near, grams, start = x
    size = start[rows + 1] - start[rows]
    at = np.repeat(start[rows] - np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), size) + np.arange(size.sum())
    return near[rows], grams[at], np.repeat(np.arange(len(rows)), size)


class DefectModel:
    """seed: of the synthetic pairs; epochs: passes over them in a fit."""

    def __init__(self, seed: int = 7, epochs: int = 16):
        self.seed, self.epochs = seed, epochs
        self.lang = Languages()

    # Synthetic pairs --------------------------------------------------------------------------------------

    def _cut(self, rng: np.random.Generator, a: str) -> str | None:
        for _ in range(6):
            at = int(len(a) * rng.uniform(0.15, 0.97))
            t = a[:at] if rng.random() < 0.5 else a[:at].rsplit(" ", 1)[0]
            t = t.rstrip()
            if len(_WORD.findall(t)) >= 3 and t.rstrip(_CLOSING)[-1:] not in ".!?;" and len(t) < len(a.rstrip()) - 3:
                return t + str(rng.choice(["", "", "", "", " …", "...", ",", " (", ":", "\n", "\xa0", " -", " Art.", " cf."]))
        return None

    def _copy(self, rng: np.random.Generator, q: str) -> str:
        words = q.split(" ")
        if len(words) > 6 and rng.random() < 0.25:
            for _ in range(int(rng.integers(1, 3))):
                words.pop(int(rng.integers(len(words))))
        t = " ".join(words)
        how = rng.integers(0, 12)
        return [t, t, t.upper(), t.lower().rstrip("?."), t + "\n", f'"{t}"', f"Question: {t}", f"Q: {t}", f"{t} {t}", t.replace(" ", "  ").rstrip("?"), f"**{t}**", f"Frage: {t}"][how]

    def _synthetic(self, sound: list[tuple[str, str]]) -> tuple[list[tuple[str, str | None]], np.ndarray]:
        rng = np.random.default_rng(self.seed)
        names = list(seeds.LANGUAGES)
        refusals, nothings, declining = seeds.lines(seeds.REFUSAL), seeds.nothings(), seeds.lines(seeds.DECLINING)
        brief = {k: list(seeds.readings(v)) for k, v in seeds.BRIEF.items()}
        answered, asked = ([s[0].argmax() if (s := self.lang.score(t))[1] > 5 else -1 for t in side] for side in ([a for _, a in sound], [q for q, _ in sound]))
        pool = {v: [a for (_, a), x in zip(sound, answered) if x == v and len(a) > 30] for v in set(answered) if v >= 0}
        # Sentences of the languages that are known beforehand stand for answers in a language that the table has not.
        for i, name in enumerate(names):
            pool.setdefault(i, [])
            pool[i] = pool[i] + [s.strip() + "." for s in seeds.LANGUAGES[name].split(".")[:2]] * (1 if pool[i] else 3)
        usual = Counter(v for v in asked if v >= 0).most_common(1)
        usual = usual[0][0] if usual else 0
        by_language: dict[int, list[str]] = {}
        for t in refusals:
            by_language.setdefault(int(self.lang.score(t)[0].argmax()), []).append(t)
        pairs: list[tuple[str, str | None]] = []
        labels: list[tuple[int, ...]] = []

        def add(q, a, *label):
            pairs.append((q, a))
            labels.append(label)

        pick = lambda xs: xs[int(rng.integers(len(xs)))]
        case = lambda t: t.capitalize() if rng.random() < 0.8 else t.upper() if rng.random() < 0.5 else t
        for i, (q, a) in enumerate(sound):
            add(q, a, -1)
            words = len(_WORD.findall(a))
            if words >= 8 and (t := self._cut(rng, a)):
                add(q, t, 4)
            if words >= 16 and rng.random() < 0.1:
                lines = re.split(r"(?<=[.!?])\s+", a.strip())
                listed = "\n".join(f"{j + 1}. {x}" for j, x in enumerate(lines))
                add(q, listed, -1)
                add(q, f"{listed}\n{len(lines) + 1}.", 4)
            if rng.random() < 0.5:
                add(q, self._copy(rng, q), 2)
            if rng.random() < 0.15:
                add(q, f"{q} {a}", -1)
            if rng.random() < 0.6:
                own = by_language.get(asked[i], refusals) if rng.random() < 0.75 else refusals
                t = case(pick(own)).replace(" i ", " I ").replace(" i'", " I'")
                t = pick(["", "", "", "Thank you for the question. ", "Thank you. "]) + t + pick([".", ".", ".", ""])
                t = f"{t} {case(pick(own))}." if rng.random() < 0.15 else t
                if rng.random() < 0.2:
                    t += pick([" Perhaps someone else can.", " Maybe an expert could help.", " You may want to ask somebody who knows the case.", " Is there anything else?", " Thank you for understanding.", " Vielleicht kann jemand anders helfen.", " Merci de votre compréhension.", " Gracias por su comprensión."])
                if rng.random() < 0.3:  # after the question or after content, however long
                    t = f"{pick([q, a, ' '.join(pick(sound)[1] for _ in range(3))])} {t}"
                add(q, t.replace("'", "’") if rng.random() < 0.2 else t, 1)
            if rng.random() < 0.15:
                add(q, " ".join([a, pick(sound)[1], pick(sound)[1]]), -1)
            if rng.random() < 0.6:
                add(q, None if rng.random() < 0.05 else pick(nothings), 0)
            if rng.random() < 0.5:
                v = pick([x for x in pool if x != asked[i] and pool[x]])
                t = pick(pool[v])
                add(q, t, 3)
                if rng.random() < 0.15 and (t := self._cut(rng, t)):
                    add(q, t, 3, 4)
            if words >= 6 and rng.random() < 0.05:  # another script: the letters' places in it are enough
                base = pick([0x430, 0x3B1, 0x5D0, 0x627, 0x4E00, 0xAC00])
                add(q, re.sub("[a-z]", lambda m: chr(base + (ord(m.group()) - 97) % 24), a.lower()), 3)
            for _ in range(1 + 2 * (asked[i] != usual) if rng.random() < (0.3 if asked[i] == usual else 0.8) else 0):
                add(q, case(pick(brief.get(names[asked[i]], brief["en"]))), -1)
            if rng.random() < 0.1:
                t = case(pick(declining))
                add(q, t if rng.random() < 0.4 else f"{t} {a}", -1, -2)
            if words >= 8 and rng.random() < 0.08 and a.rstrip().endswith("."):
                add(q, pick([f"**{a}**", f'"{a}"', f"{a} [2]", f"{a} (See Section 4.2.)", f"{a}\n", a.upper()]), -1)
        for t in rng.permutation(refusals)[: len(sound) // 2]:  # the wordings themselves, whatever is asked and however much is said before
            before = " ".join(pick(sound)[1] for _ in range(int(rng.integers(1, 5)))) + " " if rng.random() < 0.5 else ""
            add(pick(sound)[0], before + case(str(t)) + pick([".", ""]), 1)
        y = np.zeros((len(pairs), len(LABELS)), np.float32)
        for i, own in enumerate(labels):
            y[i, [v for v in own if v >= 0]] = 1
            if 1 in own or -2 in own:  # seeds come in any language, so they say nothing about that
                y[i, 3] = np.nan
        return pairs, y

    # Fit --------------------------------------------------------------------------------------------------

    def _train(self, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, own_rows: np.ndarray) -> np.ndarray:
        """Logistic regression of every label, by gradient descent in small parts with a small L2 penalty."""
        rng = np.random.default_rng(self.seed)
        near, whole = slice(0, _DENSE + _ENDINGS), slice(_DENSE + _ENDINGS, None)
        refusal = LABELS.index("refusal")
        w = np.zeros((_DENSE + _ENDINGS + _HASHED, y.shape[1]), np.float32)
        own = np.ones((_DENSE + _ENDINGS, y.shape[1]), np.float32)
        own[_DENSE:, [LABELS.index("copy"), LABELS.index("language"), refusal]] = 0  # these are about the pair, or the wording
        pair = [0, 2, 3, 4, 5, 21, 22, 23, 27, 28, 30]  # a language is told by the pair, not by how the answer ends
        own[[i for i in range(_DENSE) if i not in pair], LABELS.index("language")] = 0
        own[np.ix_([21, 22, 23, 27, 28, 30], [i for i, label in enumerate(LABELS) if label != "language"])] = 0
        weight = np.where(y > 0, 0.5 * len(y) / np.maximum(1, (y == 1).sum(0)), 0.5 * len(y) / np.maximum(1, (y == 0).sum(0))) ** 0.5
        weight[np.isnan(y)], y = 0, np.nan_to_num(y)
        # The n-grams of the whole answer tell refusals alone: two parts, each with its own moments.
        parts = [(w[near], np.zeros_like(own), np.zeros_like(own)), (w[whole, refusal : refusal + 1], *(np.zeros((_HASHED, 1), np.float32) for _ in range(2)))]
        step = 0
        for epoch in range(self.epochs):
            order = rng.permutation(own_rows)
            rate = 0.05 * (1 - epoch / self.epochs)
            for s in range(0, len(order), 256):
                rows = order[s : s + 256]
                a, grams, row = _taken(x, rows)
                z = a @ w[near]
                z[:, refusal] += 0.3 * np.bincount(row, w[whole, refusal][grams], len(rows))
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
                step += 1
                for (v, first, second), g in zip(parts, ((a.T @ e + 2e-5 * w[near]) * own, 0.3 * np.bincount(grams, e[row, refusal], _HASHED)[:, None] + 2e-5 * w[whole, refusal : refusal + 1])):
                    first *= 0.9
                    first += 0.1 * g
                    second *= 0.99
                    second += 0.01 * g * g
                    v -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        return w

    def fit(self, sample: list[tuple[str, str]]) -> DefectModel:
        """sample: pairs as they are, sound or not."""
        self.lang.learn([t for pair in sample for t in pair if t])
        sound = [(q, a) for q, a in sample if a and a.strip() and q]
        self.thresholds = np.full(len(LABELS), 0.5)
        for last in (False, True):
            # Refusals among the sample mustn't pass for sound ones while these are still unknown: at first, answers that speak of themselves wait.
            use = sound if last else [pair for pair in sound if not _PERSON.search(_plain(pair[1]))]
            pairs, y = self._synthetic(use) if use else ([], np.zeros((0, len(LABELS)), np.float32))
            x = _matrix(pairs, self.lang)
            held = np.arange(len(y)) % 5 == 0
            self.w = self._train(x, y, np.flatnonzero(~held))
            p = self._probabilities(x, np.flatnonzero(held))
            self.held_out = {}
            for i, label in enumerate(LABELS):
                grid = np.linspace(0.2, 0.9, 29)
                known = ~np.isnan(y[held][:, i])
                hits = p[known, i, None] > grid
                true = y[held][known, i, None] > 0
                f1 = 2 * (hits & true).sum(0) / np.maximum(1, hits.sum(0) + true.sum())
                good = grid[f1 >= f1.max() - 0.005]  # of thresholds that are as good, the most central one
                self.thresholds[i], self.held_out[label] = good[np.abs(good - 0.5).argmin()], float(f1.max())
            if not last:
                sound = [pair for pair, p in zip(sound, self._probabilities(_matrix(sound, self.lang), np.arange(len(sound))).max(1)) if p < 0.15]
        return self

    def _probabilities(self, x: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        near, grams, row = _taken(x, rows)
        z = (near @ self.w[: _DENSE + _ENDINGS]).astype(np.float64)
        for i in range(z.shape[1]):
            z[:, i] += 0.3 * np.bincount(row, self.w[_DENSE + _ENDINGS :, i][grams], len(rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def certainties(self, pairs: list[tuple[str, str | None]]) -> np.ndarray:
        """Of each pair and label, how far the probability is above the label's threshold: 0 at it, 1 at certainty, negative below."""
        own, ends_w, whole_w = 2 * self.w[:_DENSE], 0.5 * self.w[_DENSE : _DENSE + _ENDINGS], 0.3 * self.w[_DENSE + _ENDINGS :]
        z = np.zeros((len(pairs), len(LABELS)))
        for i, (dense, ends, whole) in enumerate(_rows(pairs, self.lang)):  # few features of each are not zero
            z[i] = dense @ own + whole_w[whole].sum(0)
            if ends:
                z[i] += ends_w[ends].sum(0)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return (p - self.thresholds) / (1 - self.thresholds)

    def predict(self, pairs: list[tuple[str, str | None]]) -> list[str | None]:
        """The most certain defect of each pair, or None."""
        over = self.certainties(pairs)
        over[:, 1] += over[:, 1] > 0.5  # a clear refusal is one in any language
        return [LABELS[o.argmax()] if o.max() > 0 else None for o in over]


def fit_on_sample(df: DataFrame, key: str, query: str, answers: dict[str, str], rows: int = 700, **model) -> DefectModel:
    """Fit on at most `rows` rows of the table (those with the least hashes of their keys)."""
    columns = [F.expr(path).alias(f"a{i}") for i, path in enumerate(answers.values())]
    sample = df.select(F.xxhash64(key).alias("h"), F.col(query).alias("q"), *columns).where("q is not null").orderBy("h", "q").limit(rows).toArrow()
    texts = [(q, a) for i in range(len(answers)) for q, a in zip(sample["q"].to_pylist(), sample[f"a{i}"].to_pylist())]
    return DefectModel(**model).fit(list(dict.fromkeys(texts)))


def find_defects(df: DataFrame, key: str, query: str, answers: dict[str, str], model: DefectModel | None = None, **fit) -> DataFrame:
    """(key, answer_field, defect, certainty): every defect that is over its threshold, so that an answer may have several.

    answers: name in the result to column (or path into a struct). A null or
    empty query leaves what can be seen in the answer alone; rows without a key
    take no part; rows that repeat a key give each defect once, with the
    greatest certainty; further columns are ignored.
    """
    model = model or fit_on_sample(df, key, query, answers, **fit)
    shared = df.sparkSession.sparkContext.broadcast((model.w, model.thresholds, model.lang.table))  # of fixed size
    fields = list(answers)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = object.__new__(DefectModel)
        own.w, own.thresholds, table = shared.value
        own.lang = Languages(table)
        for batch in batches:
            queries = batch.column(1).to_pylist()
            for i, field in enumerate(fields):
                over = own.certainties([(q or "", a) for q, a in zip(queries, batch.column(2 + i).to_pylist())])
                at, label = np.nonzero(over > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([field] * len(at), pa.string()), pa.array([LABELS[j] for j in label], pa.string()), pa.array(over[at, label], pa.float64())], ["key", "answer_field", "defect", "certainty"]
                )

    rows = df.select(F.col(key).alias("key"), F.col(query).alias("query"), *(F.expr(path).alias(f"a{i}") for i, path in enumerate(answers.values()))).where(F.col("key").isNotNull())
    found = rows.mapInArrow(judge, f"key {rows.schema['key'].dataType.simpleString()}, answer_field string, defect string, certainty double")
    return found.groupBy("key", "answer_field", "defect").agg(F.max("certainty").alias("certainty"))


def chief_defect(found: DataFrame) -> DataFrame:
    """(key, answer_field, defect): the most certain defect of each answer, a clear refusal before others, as it is one in any language;
    the first by name of those equally certain."""
    weight = F.when((F.col("defect") == "refusal") & (F.col("certainty") > 0.5), -1 - F.col("certainty")).otherwise(-F.col("certainty"))
    return found.groupBy("key", "answer_field").agg(F.min_by("defect", F.struct(weight, "defect")).alias("defect"))
