"""Problem 5: records that share most of their content.

A vertically partitioned similarity join. All word n-grams have one global
order, rare ones first (from a sketch of their frequencies, which only has to
be the same everywhere: the order decides the cost, never the result). The
order is cut into fragments. A record's prefix, the n-grams of which a similar
record must have at least one, is split at the cuts, and each fragment joins
its own segments and counts the partial overlaps of its pairs. The sums per
pair give the candidates, whose whole texts are then compared.

Records with the same text are one class throughout: a class is joined once,
and its copies come back as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import cut, mix64, run_hashes, word_hashes

_BITS = 256
_ORDER_SHIFT = np.uint64(56)


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], owner[keep]


def _distinct_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of names of 16 bytes, in their order: the first row of each, and which of them every row has."""
    halves = np.frombuffer(b"".join(ids.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((np.arange(len(halves)), halves[:, 1], halves[:, 0]))
    new = np.r_[True, (halves[order][1:] != halves[order][:-1]).any(1)] if len(order) else np.empty(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _first_rows(ids: pa.Array) -> np.ndarray:
    return np.sort(_distinct_ids(ids)[0])


def _scoped_grams(batch: pa.RecordBatch, words: int, take: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a batch's texts (class, text, scope), those of a scope apart from those of any other, and the text of each."""
    texts, scope = batch.column(1), batch.column(2).to_numpy()
    if take is not None:
        texts, scope = texts.take(pa.array(take)), scope[take]
    grams, owner, _ = run_hashes(*word_hashes(texts), words)
    if scope.any():
        grams = mix64(grams ^ mix64(scope.view(np.uint64)[owner]))
    return grams, owner


def _ordered(grams: np.ndarray, owner: np.ndarray, count: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each record in the global order: order keys, owners, position in the record, n-grams of each record."""
    bucket = grams >> np.uint64(64 - int(len(level)).bit_length() + 1)
    keys, owner = _distinct((level[bucket.astype(np.int64)].astype(np.uint64) << _ORDER_SHIFT) | (grams >> np.uint64(8)), owner)
    sizes = np.bincount(owner, minlength=count)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return keys, owner, np.arange(len(keys)) - starts[owner], sizes


def _signatures(keys: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """A parity bitmap per record: two records differ in at least as many n-grams as their bitmaps do in bits."""
    bit = (mix64(keys) >> np.uint64(56)).astype(np.int64)
    parity = np.bincount(owner * _BITS + bit, minlength=count * _BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(count, _BITS), axis=1)


class _Pairs:
    """Pairs of records that share an n-gram, counted; those that can't be similar are left out early."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, t: Fraction):
        self.sizes, self.bits, self.p, self.q = sizes.astype(np.int32), bits.view(np.uint64), t.numerator, t.denominator
        self.found: list[np.ndarray] = []
        self.held, self.counted = 0, (np.empty(0, np.int64), np.empty(0, np.int64))

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.sizes)
        self.found.append(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b))
        self.held += len(a)
        if self.held > 4_000_000:
            self._merge()

    def _merge(self) -> None:
        keys, counts = self.counted
        new, n = np.unique(np.concatenate(self.found) if self.found else np.empty(0, np.int64), return_counts=True)
        every, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at[: len(keys)], counts)
        np.add.at(total, at[len(keys) :], n)
        self.counted, self.found, self.held = (every, total), [], 0

    def _possible(self, differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a + b
        need = (self.p * both + self.p + self.q - 1) // (self.p + self.q)
        return differ <= both - 2 * need

    def lags(self, key: np.ndarray, record: np.ndarray) -> None:
        """Short lists: each entry with those after it that have the same key."""
        last = np.r_[np.flatnonzero(key[1:] != key[:-1]), len(key) - 1]
        left = np.repeat(last, np.diff(np.r_[-1, last])) - np.arange(len(key))
        active, lag = np.flatnonzero(left >= 1), 1
        while len(active):
            for part in np.array_split(active, len(active) // 500_000 + 1):
                a, b = record[part], record[part + lag]
                differ = np.zeros(len(part), np.int32)
                for w in range(self.bits.shape[1]):
                    differ += np.bitwise_count(self.bits[a, w] ^ self.bits[b, w])
                ok = self._possible(differ, self.sizes[a], self.sizes[b])
                self._add(a[ok], b[ok])
            lag += 1
            active = active[left[active] >= lag]

    def block(self, rows: np.ndarray, columns: np.ndarray | None = None) -> None:
        """A long list with itself, or with another."""
        step = 256
        own = columns is None
        columns = rows if own else columns
        right, right_size = np.ascontiguousarray(self.bits[columns].T), self.sizes[columns]
        for s in range(0, len(rows), step):
            a = rows[s : s + step]
            for c in range(s if own else 0, len(columns), 8192):
                e = min(c + 8192, len(columns))
                differ = np.zeros((len(a), e - c), np.uint16)
                for w in range(self.bits.shape[1]):
                    differ += np.bitwise_count(self.bits[a, w][:, None] ^ right[w, None, c:e])
                i, j = np.nonzero(self._possible(differ, self.sizes[a][:, None], right_size[None, c:e]))
                if own:
                    keep = i + s < j + c
                    i, j = i[keep], j[keep]
                self._add(a[i], columns[j + c])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._merge()
        keys, counts = self.counted
        return keys // len(self.sizes), keys % len(self.sizes), counts


def _level(count):
    return np.minimum(255, np.log2(np.asarray(count) + 1) * 6).astype(np.uint8)


def _prefix(n, t: Fraction):
    """How many n-grams, the first ones in the order, hold one of any similar record."""
    return n - -(-t.numerator * n // t.denominator) + 1


class VerticalJoin:
    """Similarity join of the distinct texts of a table.

    df: key and text columns by name; similarity is Jaccard on distinct runs of
    `words` words (lower case; letters, digits, underscores). Null and wordless
    texts, and texts shorter than one run, are similar to nothing; rows without
    a key take no part; further columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str, text: str, words: int = 5, threshold: float | Fraction = Fraction(4, 5), within: str | None = None, sketch_bits: int | None = None, postings: int = 2_400_000, hot: int = 16_384):
        self.spark, self.words, self.hot = df.sparkSession, words, hot
        self.t = Fraction(threshold).limit_denominator(10_000)
        if not 0 < self.t <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        self.sketch_bits, self.postings = sketch_bits, postings
        self.scoped = within is not None
        scope = F.lit(0).cast("bigint") if within is None else F.xxhash64(within)
        rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), scope.alias("scope")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
        # 128 bits, so that different texts have different classes in a collection of any size; without a scope it is the text's own.
        name = F.md5("text") if within is None else F.md5(F.concat(F.col("scope").cast("string"), F.lit(":"), F.col("text")))
        self.rows = rows.withColumn("class", F.unhex(name))

    def members(self) -> DataFrame:
        """(key, class): rows that repeat a key and its text count once."""
        return self.rows.select("key", "class").distinct()

    def _levels(self) -> None:
        """The sketch: for each bucket of n-grams, how frequent they are (a logarithm in a byte).

        There is a bucket for about every four n-grams of the table, so that most of those that occur once are known to; but no more than 2^26: one byte each is broadcast.
        Counts stay with Spark; the driver gets levels, the sums by level, and the buckets that are hot.
        """
        words = self.words
        chars = self.rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] if self.scoped or self.sketch_bits is None else 0
        if self.scoped:  # a list is no longer than one row's array: there is nothing to tell apart
            self.sketch_bits, self.level, self.by_level = 16, np.full(1 << 16, _level(2), np.uint8), np.zeros(256)
            self.by_level[_level(2)] = chars / 6
            self.heavy, self.heavy_blocks = np.empty(0, np.int64), np.empty(0, np.int64)
            return
        if self.sketch_bits is None:
            self.sketch_bits = int(min(26, max(16, np.ceil(np.log2(max(1, chars / 24))))))
        bits = self.sketch_bits
        size, shift = 1 << bits, np.uint64(64 - bits)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for batch in batches:
                grams, owner = _scoped_grams(batch, words, _first_rows(batch.column(0)))
                grams, _ = _distinct(grams, owner)
                np.add.at(total, (grams >> shift).astype(np.int64), 1)
            at = np.flatnonzero(total)
            for s in range(0, len(at), 100_000):
                part = at[s : s + 100_000]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(part, pa.int32()), "n": pa.array(total[part], pa.int64())})

        counted = cut(self.rows.select("class", "text", "scope").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")))
        level = F.least(F.lit(255), F.floor(F.log2(F.col("n") + 1) * 6)).cast("short")
        by_level = counted.groupBy(level.alias("level")).agg(F.sum("n").alias("n")).toArrow()
        self.by_level = np.zeros(256)
        self.by_level[by_level["level"].to_numpy()] = by_level["n"].to_numpy()
        # Where buckets are full of ordinary n-grams, what is above the average tells the hot ones.
        self.hot = int(max(self.hot, 4 * self.by_level.sum() / size))
        rows = counted.where("n > 1").select("bucket", level.alias("level")).toArrow()
        self.level = np.full(size, _level(1), np.uint8)
        self.level[rows["bucket"].to_numpy()] = rows["level"].to_numpy()
        heavy = counted.where(F.col("n") > self.hot).orderBy("bucket").toArrow()
        self.heavy, self.heavy_blocks = heavy["bucket"].to_numpy().astype(np.int64), -(-heavy["n"].to_numpy() // self.hot)

    def _cuts(self) -> np.ndarray:
        """Cuts of the global order so that neither rows nor work between any two exceed a task's: only the first part of the order can be in prefixes."""
        total = self.by_level.sum() * float(1 - self.t) * 1.1
        mass = np.diff(np.r_[0, np.minimum(np.cumsum(self.by_level), total)])
        work = mass * (48 + 2 ** (np.arange(256) / 6))
        if not work.sum():
            return np.empty(0, np.uint64)
        tasks = max(1, round(total / self.postings))
        load = np.cumsum(mass / self.postings + work * (tasks / work.sum()))
        count = max(1, round(load[-1] / 2)) if tasks == 1 else max(1, round(load[-1]))
        at = np.interp(np.arange(1, count) / count * load[-1], np.r_[0, load], np.arange(257))
        return (at * float(1 << 56)).astype(np.uint64)

    def candidates(self) -> DataFrame:
        """(a, b, shared, a_size, b_size): pairs of classes whose prefixes share enough; a superset of the similar ones."""
        words, t = self.words, self.t
        self._levels()
        cuts = self._cuts()
        shared = self.spark.sparkContext.broadcast((self.level, cuts, self.heavy, self.heavy_blocks))
        fragments = len(cuts) + 1
        hot_tasks = fragments if len(self.heavy) else 0
        shift, alone = 64 - self.sketch_bits, np.uint64(_level(1))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level, cuts, heavy, blocks = shared.value
            crowded = np.zeros(len(level), bool)
            crowded[heavy] = True
            for batch in batches:
                first = _first_rows(batch.column(0))
                if not len(first):
                    continue
                ids = batch.column(0).take(pa.array(first))
                own = np.frombuffer(b"".join(ids.to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
                grams, owner = _scoped_grams(batch, words, first)
                keys, owner, position, sizes = _ordered(grams, owner, len(ids), level)
                bits = _signatures(keys, owner, len(ids))
                use = (position < _prefix(sizes, t)[owner]) & (keys >> _ORDER_SHIFT > alone)  # what only one record has joins nothing
                keys, owner = keys[use], owner[use]
                bucket = ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(shift - 8)).astype(np.int64)
                busy = crowded[bucket]
                k, o = keys[~busy], owner[~busy]
                fragment = np.searchsorted(cuts, k, side="right")
                segment = o * fragments + fragment  # ascending, as keys are in order within a record
                starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(k) else np.empty(0, np.int64)
                yield _segments(fragment[starts], ids, sizes, bits, o[starts], k, starts, np.zeros(len(starts)))
                if busy.any():  # a long list is cut into blocks, each pair of blocks is a list of its own
                    k, o = keys[busy], owner[busy]
                    g = blocks[np.searchsorted(heavy, bucket[busy])]
                    mine = (mix64(own[o] ^ k) % g.astype(np.uint64)).astype(np.int64)
                    at = np.repeat(np.arange(len(k)), g)
                    other = np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(g)[:-1]], g)
                    low, high = np.minimum(mine[at], other), np.maximum(mine[at], other)
                    name = mix64(k[at] + (low * g[at] + high + 1).astype(np.uint64))
                    role = np.where(low == high, 0, np.where(mine[at] == low, 1, 2))
                    yield _segments(fragments + (name % np.uint64(hot_tasks)).astype(np.int64), ids, sizes, bits, o[at], name, np.arange(len(at)), role)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if b.num_rows]
            if not rows:
                return
            table = pa.Table.from_batches(rows).combine_chunks()
            names = table["class"].combine_chunks()
            first, record = _distinct_ids(names)
            ids = names.take(pa.array(first))
            sizes = table["size"].to_numpy()[first]
            width = _BITS // 8
            bits = np.frombuffer(b"".join(table["bits"].take(pa.array(first)).to_pylist()), np.uint8).reshape(-1, width)
            grams = table["grams"].combine_chunks()
            lengths = np.diff(grams.offsets.to_numpy())
            key = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            record, role = np.repeat(record, lengths), np.repeat(table["role"].to_numpy(), lengths)
            order = np.lexsort((record, key))
            key, record, role = key[order], record[order], role[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (record[1:] != record[:-1])]  # the same class from several tasks
            key, record, role = key[once], record[once], role[once]
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            length = np.diff(edge)
            pairs = _Pairs(sizes, bits, t)
            plain = np.logical_and.reduceat(role == 0, edge[:-1])
            short = np.repeat((length > 1) & (length <= 48) & plain, length)
            pairs.lags(key[short], record[short]) if short.any() else None
            for s, e, p in zip(edge[:-1], edge[1:], plain):
                if not p:
                    pairs.block(record[s:e][role[s:e] == 1], record[s:e][role[s:e] == 2])
                elif e - s > 48:
                    pairs.block(record[s:e])
            a, b, n = pairs.result()
            for s in range(0, len(a), 100_000):
                i, j = a[s : s + 100_000], b[s : s + 100_000]
                yield pa.RecordBatch.from_pydict({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "shared": pa.array(n[s : s + 100_000]), "a_size": pa.array(sizes[i], pa.int32()), "b_size": pa.array(sizes[j], pa.int32())})

        segments = self.rows.select("class", "text", "scope").mapInArrow(split, "fragment int, class binary, size int, bits binary, grams array<bigint>, role int")
        partial = segments.repartitionById(fragments + hot_tasks, F.col("fragment")).mapInArrow(join, "a binary, b binary, shared bigint, a_size int, b_size int")
        summed = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("a_size").alias("a_size"), F.max("b_size").alias("b_size"))
        p, q = t.numerator, t.denominator
        need = F.ceil((F.col("a_size") + F.col("b_size")) * F.lit(p) / F.lit(p + q) - F.lit(1e-9))
        rest = F.greatest(*(F.ceil(F.col(c) * F.lit(p) / F.lit(q) - F.lit(1e-9)) - 1 for c in ("a_size", "b_size")))
        return summed.where(F.col("shared") >= need - rest)

    def pairs(self, broadcast_rows: int = 200_000) -> DataFrame:
        """(a, b, shared, either): pairs of different classes at or above the threshold, a < b, compared on their whole texts."""
        words, p, q = self.words, self.t.numerator, self.t.denominator
        candidates = cut(self.candidates().select("a", "b"))
        wanted = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        few = wanted.count() <= broadcast_rows
        texts = self.rows.select("class", "text").join(F.broadcast(wanted) if few else wanted, "class", "left_semi")
        texts = texts.groupBy("class").agg(F.max("text").alias("text"))
        both = candidates.join(texts.select(F.col("class").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("right")), "b")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                sides = []
                for column in (2, 3):
                    grams, owner, _ = run_hashes(*word_hashes(batch.column(column)), words)
                    sides.append(_distinct(grams, owner))
                count = [np.bincount(owner, minlength=n) for _, owner in sides]
                grams, owner = (np.concatenate(x) for x in zip(*sides))
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                twice = (grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])
                shared = np.bincount(owner[1:][twice], minlength=n)
                either = count[0] + count[1] - shared
                ok = np.flatnonzero((shared * q >= either * p) & (shared > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(shared[ok], pa.int64()), pa.array(either[ok], pa.int64())], ["a", "b", "shared", "either"])

        return both.select("a", "b", "left", "right").mapInArrow(verify, "a binary, b binary, shared bigint, either bigint")

    def copies(self) -> DataFrame:
        """(class, size): the classes with several keys whose text has at least one run of words."""
        words = self.words
        many = self.members().groupBy("class").agg(F.count("*").alias("size")).where("size > 1")
        gap = r"(?U)[^\p{L}\p{N}_]+"
        long = F.size(F.filter(F.split(F.col("text"), gap), lambda w: w != "")) >= words
        texts = self.rows.join(many, "class").groupBy("class").agg(F.max("text").alias("text"), F.max("size").alias("size"))
        return texts.where(long).select("class", "size")


def _segments(fragment, ids, sizes, bits, record, keys, starts, role) -> pa.RecordBatch:
    offsets = np.r_[starts, len(keys)].astype(np.int32)
    grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
    record = record.astype(np.int64)
    raw = pa.array([b.tobytes() for b in bits], pa.binary()).take(pa.array(record))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(fragment), pa.int32()), ids.take(pa.array(record)), pa.array(sizes[record], pa.int32()), raw, grams, pa.array(np.asarray(role), pa.int32())],
        ["fragment", "class", "size", "bits", "grams", "role"],
    )


def similar_keys(df: DataFrame, key: str, text: str, words: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """(key_a, key_b): all pairs of keys whose texts are similar, copies of one text among them; key_a < key_b.

    The number of rows is quadratic in the size of a group of copies; near_duplicate_groups has one row per key instead.
    """
    return _key_pairs(VerticalJoin(df, key, text, words, threshold))


def _key_pairs(join: VerticalJoin) -> DataFrame:
    members = cut(join.members())
    a, b = (members.select(F.col("class").alias(c), F.col("key").alias(f"key_{c}")) for c in "ab")
    different = join.pairs().select("a", "b").join(a, "a").join(b, "b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    several = members.join(join.copies().select("class"), "class")
    left, right = (several.select("class", F.col("key").alias(f"key_{c}")) for c in "ab")
    same = left.join(right, "class").where("key_a < key_b").select("key_a", "key_b")
    return different.where("key_a < key_b").unionByName(same).distinct()


def similar_elements(df: DataFrame, key: str, texts: str, words: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """(key, i, j): positions i < j (from 0) of similar texts within one row's array.

    The same join with the row as part of every n-gram and class: a list holds one row's texts only. Rows that repeat a key give
    their pairs once; null and wordless elements are similar to nothing.
    """
    each = df.where(F.col(key).isNotNull() & (F.size(texts) > 1)).select(F.col(key).alias("key"), F.posexplode(texts).alias("at", "text"))
    each = each.select(F.struct("key", "at").alias("element"), F.col("key").cast("string").alias("row"), "text")
    join = VerticalJoin(each, "element", "text", words, threshold, within="row")
    pairs = _key_pairs(join)
    a, b = F.col("key_a"), F.col("key_b")
    return pairs.where(a["key"] == b["key"]).select(a["key"].alias("key"), F.least(a["at"], b["at"]).alias("i"), F.greatest(a["at"], b["at"]).alias("j")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an undirected graph (a, b) is connected with.

    Alternating stars: every node's larger neighbours, then its smaller ones, are linked to its least neighbour,
    until nothing changes; a few rounds for any graph that isn't a very long chain. A round is two aggregations and two joins, and
    is checkpointed, so that lineage stays short and no node's neighbours are ever gathered in one place.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    while True:  # ends for any graph: every round but the last makes some node's link smaller
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")), "u", "left_anti")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))


def near_duplicate_groups(df: DataFrame, key: str, text: str, words: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """(key, class, links, group_id): every key once, with the class of its text, to how many other texts that is similar,
    and the group of texts connected by similarity; a group's name is its least class.

    Keys without a text have a null class and group, rows without a key are left out. A key with several texts has a row for each.
    """
    join = VerticalJoin(df, key, text, words, threshold)
    pairs = cut(join.pairs().select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    groups = components(pairs).select(F.col("node").alias("class"), F.col("root").alias("group_id"))
    every = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.unhex(F.md5(F.col(text))).alias("class")).distinct()
    out = every.join(links, "class", "left").join(groups, "class", "left")
    return out.select("key", F.lower(F.hex("class")).alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.lower(F.hex(F.coalesce("group_id", "class"))).alias("group_id"))
