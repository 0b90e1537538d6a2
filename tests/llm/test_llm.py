"""Brute force, round trips and edge cases of the training-data operators."""

import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lexforge.llm import answer_defects, frequencies, leaks, look_alikes, near_duplicates, nearest_vectors, packing, residue
from lexforge.llm.common import split_words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Problem 4


def test_frequencies_against_counting(spark):
    rng = random.Random(1)
    texts = [(f"k{i}", sentence(rng, rng.randint(0, 12)), 1, 2) for i in range(60)]
    rows = texts + texts[:5] + [("n1", None, 1, 2), ("n2", "", 1, 2), (None, "Alone word", 1, 2), (None, "alone again", 1, 2), ("long", "word " * 20_000, 1, 2)]
    df = spark.createDataFrame(rows, "chunk string, text string, value int, key int")  # columns that clash with inner names
    got = {(r.ngram, r.n): (r.occurrences, r.records) for r in frequencies.ngram_frequencies(df, "chunk", "text", 3).collect()}
    occ, rec = Counter(), Counter()
    for t in [t for _, t, *_ in texts] + ["alone word", "alone again", "word " * 20_000]:
        w = t.split()
        grams = [(" ".join(w[i : i + n]), n) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        occ.update(grams)
        rec.update(set(grams))
    assert got == {g: (occ[g], rec[g]) for g in occ}


def test_marks_and_empty_table(spark):
    df = spark.createDataFrame([(i, "the " + ("rareword" if i < 2 else "usual") + (" some" if i < 3 else "")) for i in range(9)], "id int, text string")
    marks = {r.word: r.mark for r in frequencies.mark_words(df, "id", "text").collect()}
    assert marks == {"the": "common", "rareword": "rare", "usual": "common", "some": None}
    assert frequencies.mark_words(df.limit(0), "id", "text").count() == 0


def test_words_keep_all_scripts_and_lower_like_python():
    import pyarrow as pa

    codes, lengths, words = split_words(pa.array(["Ünï_1 ΛΌΓΟΣ!", None, "", "--", "契約書 x"]))
    assert [words[int(c)].as_py() for c in codes] == ["ünï_1", "λόγος", "契約書", "x"] and lengths.tolist() == [2, 0, 0, 0, 2]


# Problem 5


def shingles(t, n):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(4, 5)])
def test_similar_pairs_against_brute_force(spark, threshold):
    rng = random.Random(2)
    texts = {}
    for i in range(120):
        if texts and rng.random() < 0.5:
            w = rng.choice(list(texts.values())).split() or ["x"]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts[f"d{i:03}"] = " ".join(w)
        else:
            texts[f"d{i:03}"] = sentence(rng, rng.randint(0, 40))
    rows = list(texts.items()) + list(texts.items())[:7] + [("null", None), ("empty", ""), (None, "alpha beta gamma")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id string, body string, class int, text string")
    got = {(r.key_a, r.key_b) for r in near_duplicates.similar_keys(df, "id", "body", 3, threshold).collect()}
    want = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = shingles(texts[a], 3), shingles(texts[b], 3)
        if x and y and len(x & y) * threshold.denominator >= len(x | y) * threshold.numerator:
            want.add((a, b))
    assert got == want
    assert near_duplicates.similar_keys(df.limit(0), "id", "body", 3, threshold).count() == 0


def test_hot_ngram_lists_are_split_without_loss(spark):
    rng = random.Random(3)
    base = [sentence(rng, 30) for _ in range(3)]
    texts = {i: base[i % 3] + f" end{i}" for i in range(90)}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    plain = near_duplicates.VerticalJoin(df, "id", "text", 3, 0.8).pairs().select("a", "b")
    split = near_duplicates.VerticalJoin(df, "id", "text", 3, 0.8, hot=8, postings=100).pairs().select("a", "b")
    want = {tuple(r) for r in plain.collect()}
    shuffled = near_duplicates.VerticalJoin(df, "id", "text", 3, 0.8).pairs(broadcast_rows=0).select("a", "b")
    assert {tuple(r) for r in shuffled.collect()} == want
    assert len(want) == 3 * 30 * 29 // 2 and {tuple(r) for r in split.collect()} == want


def test_groups_against_union_find(spark):
    rng = random.Random(10)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, x) for x in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    base = sentence(rng, 30)
    df = spark.createDataFrame([("a", base), ("b", base), ("c", base + " end"), ("d", "other text altogether of six words"), ("e", None), ("e2", ""), (None, base)], "id string, t string")
    rows = {r.key: r for r in near_duplicates.near_duplicate_groups(df, "id", "t").collect()}
    assert rows["a"].group_id == rows["b"].group_id == rows["c"].group_id != rows["d"].group_id and rows["a"].links == rows["c"].links == 1 and rows["d"].links == 0
    assert rows["e"].group_id is None and set(rows) == {"a", "b", "c", "d", "e", "e2"}


def test_similar_elements(spark):
    df = spark.createDataFrame([(1, ["a b c d", "a b c d", "x y z"]), (2, None), (3, []), (4, ["a b c d", None, "A, b c D e"]), (1, ["a b c d", "a b c d", "x y z"])], "id bigint, l array<string>")
    got = sorted(tuple(r) for r in near_duplicates.similar_elements(df, "id", "l", 3, Fraction(1, 2)).collect())
    assert got == [(1, 0, 1), (4, 0, 2)]


# Problem 3


def test_canonical_form():
    form = look_alikes.canonical_form()
    assert form("plain text stays") == "plain text stays"
    assert form("Po﻿int ｈａｐ oﬃce a\xa0b") == "Point hap office a b"
    assert form("é") == form("е́") == "\xe9" != form("e")
    assert form("ΑВОο") == "ABOo" and form("x²") == "x²"
    assert form(form("한 e‍́")) == form("한 \xe9")


def test_look_alikes_against_brute_force(spark):
    texts = [(1, "hope", 0), (2, "hоpe", 0), (3, "hope", 0), (4, "Hope", 0), (5, "ho​pe", 0), (6, None, 0), (7, " ​", 0), (8, "", 0), (9, "h\xf6pe", 0), (10, "höpe", 0), (2, "hоpe", 0), (None, "hope", 0)]
    df = spark.createDataFrame(texts, "id bigint, text string, form int")
    got = {tuple(r) for r in look_alikes.look_alikes(df, "id", "text").collect()}
    assert got == {(1, 2), (1, 5), (2, 3), (2, 5), (3, 5), (9, 10)}
    assert look_alikes.look_alikes(df.limit(0), "id", "text").count() == 0
    out = {r.id: r.t for r in look_alikes.canonicalize(df, "text", "t").where("id is not null").collect()}
    assert out[5] == "hope" and out[6] is None and out[8] == ""


# Problem 1


def vectors(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    book = rng.standard_normal((8, 256, 8)).astype(np.float32)
    centres = rng.integers(0, 256, (max(1, n // 12), 8))
    codes = centres[rng.integers(0, len(centres), n)].copy()
    for row in codes:
        row[rng.integers(8)] = rng.integers(256)
    posts = spark.createDataFrame([(0, i, [int(c) for c in row], "x") for i, row in enumerate(codes)], "centroid_id int, vector_id bigint, pq_code array<smallint>, code string")
    table = spark.createDataFrame([(m, c, book[m, c].tolist()) for m in range(8) for c in range(256)], "m int, code smallint, vec array<float>")
    return posts, table, codes, np.concatenate([book[m][codes[:, m]] for m in range(8)], 1).astype(np.float64)


def test_nearest_vectors_recall(spark):
    posts, book, codes, v = vectors(spark, 3000)
    found = nearest_vectors.nearest_vectors(posts, book, 5, block=4000).collect()
    got = {(r.vector_id, r.other_id) for r in found}
    d = ((v[:, None, :] - v[None]) ** 2).sum(2) if len(v) < 500 else np.stack([((v - x) ** 2).sum(1) for x in v])
    np.fill_diagonal(d, np.inf)
    limit = np.sort(d, 1)[:, 4]
    assert len(found) == 5 * len(v)
    assert np.mean([d[a, b] <= limit[a] + 1e-6 for a, b in got]) >= 0.9  # any of several at the fifth distance will do


def test_cuts_separate_nobody(spark):
    posts, book, codes, v = vectors(spark, 4000, 3)
    d = np.stack([((v - x) ** 2).sum(1) for x in v])
    np.fill_diagonal(d, np.inf)
    limit = np.sort(d, 1)[:, 4]
    right = lambda **how: np.mean([d[r.vector_id, r.other_id] <= limit[r.vector_id] + 1e-6 for r in nearest_vectors.nearest_vectors(posts, book, 5, **how).collect()])
    assert right(block=500) >= right() - 0.005  # eight parts of every tree lose nothing against one
    assert right(reach=4000, candidates=10**6, trees=1) == 1.0  # all with all


def test_nearest_vectors_edges(spark):
    posts, book, codes, v = vectors(spark, 4)
    row = [int(c) for c in codes[0]]
    more = spark.createDataFrame([(1, 0, row, "y"), (1, 100, row, "y"), (1, 101, row, "y"), (1, 7, None, "y"), (1, 8, row[:5], "y"), (1, 9, [300] * 8, "y"), (1, 10, [None] * 8, "y"), (1, None, row, "y")], posts.schema)
    out = nearest_vectors.nearest_vectors(posts.unionByName(more), book, 5).collect()
    near = {}
    for r in sorted(out, key=lambda r: (r.vector_id, r.rank)):
        near.setdefault(r.vector_id, []).append((r.other_id, round(r.distance, 4)))
    assert set(near) == {0, 1, 2, 3, 100, 101} and all(len(x) == 5 for x in near.values())
    assert near[0][:2] == [(100, 0.0), (101, 0.0)] and near[100][:2] == [(0, 0.0), (101, 0.0)]
    assert nearest_vectors.nearest_vectors(posts.limit(0), book, 5).count() == 0


def test_many_copies_of_one_vector(spark):
    posts, book, codes, v = vectors(spark, 30)
    row = [int(c) for c in codes[0]]
    hot = spark.createDataFrame([(1, 1000 + i, row, "y") for i in range(400)], posts.schema)
    out = nearest_vectors.nearest_vectors(posts.unionByName(hot), book, 5)
    assert out.count() == 430 * 5 and out.where("vector_id = other_id").count() == 0


# Problem 7


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))) for i in range(20)}
    docs = {}
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            passage = rng.choice(list(items.values())).split()
            n = rng.randint(8, 20)
            s = rng.randrange(len(passage))
            w[10:10] = passage[s : s + n]
        docs[i] = (rng.choice([" ", "\n", ", "])).join(w).replace("w1", rng.choice(["W1", "w​1", "w\xad1"]))
    d = spark.createDataFrame([(*r, 0) for r in docs.items()] + [(900, None, 0), (901, "", 0), (None, "w1 w2", 0), (0, docs[0], 0)], "doc_id bigint, text string, item int")
    t = spark.createDataFrame(list(items.items()) + [(500, None), (501, "short one")], "item_id bigint, text string")
    clean = lambda x: x.lower().replace("​", "").replace("\xad", "").replace(",", " ").split()
    runs = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    want = {(a, b) for a, x in docs.items() for b, y in items.items() if runs(clean(x)) & runs(clean(y))}
    for rows in (500_000, 0):  # with the items' side sent to all tasks, and shuffled
        found = leaks.leaked_items(d, "doc_id", "text", t, "item_id", "text", exact=True, broadcast_rows=rows)
        assert {(r.doc, r.item) for r in found.collect()} == want
    similar = leaks.leaked_items(d, "doc_id", "text", t, "item_id", "text")
    assert want <= {(r.doc, r.item) for r in similar.collect()}
    assert leaks.leaked_items(d.limit(0), "doc_id", "text", t, "item_id", "text").count() == 0
    assert leaks.leaked_items(d, "doc_id", "text", t.limit(0), "item_id", "text").count() == 0


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 60).astype(np.uint64)
    others = np.concatenate([prints ^ (np.uint64(1) << a.astype(np.uint64)) ^ (np.uint64(1) << b.astype(np.uint64)) for a, b in rng.integers(0, 64, (4, 2, 60))] + [rng.integers(0, 2**63, 500).astype(np.uint64)])
    mine, theirs = leaks.hamming_blocks(prints, 2), leaks.hamming_blocks(others, 2)
    got = {(i, j) for x, y in zip(mine, theirs) for i, j in zip(*(v.tolist() for v in np.nonzero(x[:, None] == y[None]))) if bin(int(prints[i] ^ others[j])).count("1") <= 2}
    assert got == {(i, j) for i, p in enumerate(prints) for j, q in enumerate(others) if bin(int(p) ^ int(q)).count("1") <= 2} and len(got) >= 240


def test_changed_windows_against_brute_force(spark):
    rng = random.Random(18)
    texts = {i: [f"t{rng.randrange(90)}" for _ in range(rng.randint(13, 60))] for i in range(25)}
    docs = {}
    for i in range(120):
        w = rng.choice(list(texts.values()))
        s = rng.randrange(max(1, len(w) - 13))
        w = w[s : s + rng.randint(13, 20)]
        w[rng.choice([0, len(w) - 1, 6, 1])] = "new"
        docs[i] = ["z"] * rng.randint(0, 3) + w + ["y"] * rng.randint(0, 3)
    shingles = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    having = Counter(s for w in texts.values() for s in set(shingles(w)))
    weigh = lambda s: int(np.rint(8 * np.log1p(len(texts) / having[s]))) if s in having else int(round(8 * np.log1p(len(texts))))

    def like(x, y):
        a, b = Counter(shingles(x)), Counter(shingles(y))
        total = sum(weigh(s) * n for s, n in (a | b).items())
        return sum(weigh(s) * n for s, n in (a & b).items()) / total

    windows = lambda w: [w[i : i + 13] for i in range(len(w) - 12)]
    best = {(d, i): max((like(x, y) for x in windows(dw) for y in windows(iw)), default=0) for d, dw in docs.items() for i, iw in texts.items()}
    want = {p: s for p, s in best.items() if s >= 0.8}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "id int, t string")
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "id int, t string")
    for rows in (500_000, 0):
        got = {(r.doc, r.item): r.similarity for r in leaks.leaked_items(d, "id", "t", t, "id", "t", broadcast_rows=rows).collect()}
        assert len(want) > 20 and set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


# Problem 8


def test_residue(spark):
    rng = random.Random(6)
    nouns, verbs = "supplier carrier agent licensee invoice schedule pallet ledger notice term".split(), "shall keep may deliver must return is entitled to inspect agrees to renew".split()
    natural = [" ".join(f"The {rng.choice(nouns)} {rng.choice(['shall keep', 'may deliver', 'must return', 'agrees to renew'])} the {rng.choice(nouns)} within {rng.randint(2, 90)} days after notice." for _ in range(rng.randint(1, 6))) for _ in range(300)]
    cases = {
        1000: ("The fee of {{amount}} falls due on [INSERT DATE].", {"placeholder"}), 1001: ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.", {"filler"}),
        1002: ("404 Not Found\nThe requested document could not be located on this server.", {"error_page"}), 1003: ("Please enable JavaScript to view this page.", {"script_notice"}),
        1004: (None, set()), 1005: ("", set()), 1006: (" ​ ", set()), 1007: (natural[0] + " By: ____________ Date: ________", set()), 1008: (natural[1] * 400, set()),
    }
    rows = [(i, t, "x") for i, t in enumerate(natural)] + [(k, t, "x") for k, (t, _) in cases.items()] + [(None, "404 Not Found", "x"), (1002, cases[1002][0], "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, kind string")
    got = {}
    for r in residue.find_residue(df, "id", "text").collect():
        got.setdefault(r.key, set()).add(r.kind)
    assert {k: got.get(k, set()) for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert sum(k < 1000 for k in got) <= 3
    assert residue.find_residue(df.limit(0), "id", "text").count() == 0


# Problem 2


def test_answer_defects(spark):
    rng = random.Random(7)
    nouns = "supplier carrier agent licensee invoice schedule pallet ledger notice term".split()
    say = lambda: f"The {rng.choice(nouns)} shall keep the {rng.choice(nouns)} of the {rng.choice(nouns)} within {rng.randint(2, 90)} days after notice."
    sag = lambda: f"Der Lieferant verwahrt die Unterlagen auf eigene Kosten und ohne Verzögerung bis zum {rng.randint(1, 30)}. Tag nach der Mitteilung."
    rows = []
    for i in range(300):
        german = i % 5 == 0
        q = f"Was regelt der Vertrag zum Thema {rng.choice(nouns)} und wer ist daran gebunden?" if german else f"What does the agreement say about the {rng.choice(nouns)} and the {rng.choice(nouns)}?"
        a = (sag if german else say)()
        rows.append((i, q, (a + " " + (sag if german else say)(), a)))
    q = "What does the agreement say about the ledger and the notice?"
    cases = {
        1000: (None, "empty"), 1001: ("N/A", "empty"), 1002: (q, "copy"), 1003: ("I'm sorry, but I can't help with that request.", "refusal"), 1004: (sag() + " " + sag(), "language"),
        1005: (say() + " The agent shall keep the invoice of the", "truncated"), 1006: ("Twelve months", None), 1007: (say() + " " + say(), None),
    }
    rows += [(k, q, (a, say())) for k, (a, _) in cases.items()] + [(1002, q, (q, rows[0][2][1])), (None, q, (None, None))]
    df = spark.createDataFrame(rows, "id bigint, query string, g struct<a: string, b: string>")
    found = answer_defects.find_defects(df, "id", "query", {"a": "g.a"}).collect()
    got = {r.key: r.defect for r in found}
    assert {k: got.get(k) for k in cases} == {k: d for k, (_, d) in cases.items()}
    assert sum(k < 1000 for k in got) <= 6 and len(found) == len(got)
    assert answer_defects.find_defects(df.limit(0), "id", "query", {"a": "g.a"}).count() == 0


def test_late_refusals_and_other_scripts():
    rng = random.Random(17)
    nouns = "supplier carrier agent licensee invoice schedule pallet ledger notice term".split()
    say = lambda n: " ".join(f"The {rng.choice(nouns)} shall keep the {rng.choice(nouns)} of the {rng.choice(nouns)} within {rng.randint(2, 90)} days after notice." for _ in range(n))
    ask = lambda: f"What does the agreement say about the {rng.choice(nouns)} and the {rng.choice(nouns)}?"
    model = answer_defects.DefectModel().fit([(ask(), say(rng.randint(1, 5))) for _ in range(300)])
    refused = [(ask(), f"{say(n)} I'm sorry, but I can't help with that request.") for n in (3, 4, 5) for _ in range(5)]
    cyrillic = [(ask(), "Поставщик обязан хранить все документы за свой счет до истечения срока.")] * 2
    sound = [(ask(), say(n)) for n in (1, 3, 5) for _ in range(20)]
    assert model.predict(refused).count("refusal") >= 14
    assert model.predict(cyrillic) == ["language"] * 2
    assert sum(d is not None for d in model.predict(sound)) <= 1


# Problem 6


def test_first_fit_decreasing_against_plain_search():
    rng = random.Random(8)
    for _ in range(50):
        cap = rng.randint(1, 60)
        sizes = sorted((rng.randint(0, cap) for _ in range(rng.randint(0, 80))), reverse=True)
        free, want = [], []
        for s in sizes:
            at = next((i for i, f in enumerate(free) if f >= s), len(free))
            free += [cap] * (at == len(free))
            free[at] -= s
            want.append(at)
        assert packing.first_fit_decreasing(sizes, cap) == want


def test_pack(spark):
    rng = random.Random(9)
    sizes = {i: rng.choice([0, rng.randint(1, 90), rng.randint(1, 400)]) for i in range(500)}
    df = spark.createDataFrame(list(sizes.items()), "key bigint, tokens bigint")
    limits = spark.createDataFrame([(1, "a", 50), (2, "b", 120), (2, "b", 120), (3, "c", None), (None, "d", 5)], "limit_id int, label string, capacity_tokens int")
    rows = packing.pack(df, limits, group_containers=60).collect()
    for limit, cap in ((1, 50), (2, 120)):
        own = [r for r in rows if r.limit_id == limit]
        total, fill = Counter(), Counter()
        for r in own:
            total[r.key] += r.tokens
            fill[r.container] += r.tokens
        assert {k: total[k] for k in sizes} == sizes and set(total) == set(sizes) and max(fill.values()) <= cap
        assert all(r.tokens == cap for r in own if r.piece < sizes[r.key] // cap) and all(r.piece == 0 for r in own if sizes[r.key] <= cap)
        assert sum(fill.values()) / (cap * len(fill)) > 0.9
    assert {r.limit_id for r in rows} == {1, 2}
    assert packing.pack(df.limit(0), limits).count() == 0 and packing.pack(df, limits.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (1, "hello world", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (4, "<|endoftext|>", 0)], "id bigint, text string, tokens int")
    got = {r.key: r.tokens for r in packing.token_counts(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and None not in got
