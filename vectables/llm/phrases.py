"""Phrase collocation mining by a multikey three-way quicksort of suffix pointers.

Four passes over the texts, each combined within its tasks before it is shuffled:

1. words are counted; the frequent ones become a bitmap of bounded size;
2. pairs of frequent words are counted, and the frequent pairs become a second bitmap;
3. runs of three words and more, all of whose pairs pass the second bitmap, are counted in hashed buckets, a byte or few each; the
   buckets that reach the least count become a third bitmap;
4. a suffix begins at each word and goes on for ``longest`` words, as long as every pair in it passes the second bitmap and each of
   its prefixes the third. A bitmap passes what it holds and a few others, so no phrase that is frequent enough is lost by it.

A suffix ends with its longest frequent prefix, so a task of the fourth pass makes about one row for each frequent phrase at most,
however often their words go on in other ways, besides the pairs that a bitmap passes by mistake (up to one or two in a hundred).
Passes 3 and 4 run in one task for each core: the rows are then bounded by cores x frequent phrases, and those by the input (each
occurs ``least`` times), where more tasks would name the same phrases again.

The suffixes are routed over the cluster by their leading words: the partitions are ranges of suffixes in word order, cut by
Spark from a sample of the keys, so a word that begins a third of all suffixes spans as many partitions as its suffixes fill. Each
partition is sorted by pointers: a range of pointers is split into smaller, equal and greater at one word, the equal part goes on at
the next word and its size is the count of the phrase, and a part whose total is below the least count is abandoned.
Only a phrase that heads the first or the last suffix of a partition can go on in another; for those each partition gives its part of
the count, whatever it is, and the parts are added up.

A phrase's cuts meet the counts of their parts by key. Scores are whole numbers of 38 digits, so nothing is rounded.

Defined cases: null texts are empty; a null language is ``UNKNOWN``; words are lower-cased A-Z and never cross a break; phrases
of different languages never meet; repeated rows count as often as they occur; an empty table gives an empty
result; other columns are not read. A word's identity is a 64-bit hash of it and its language.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectables.llm.store import Workspace
from vectables.llm.text import Texts, as_long, hash_ranges, mix, slices
from vectables.session import parallelism, ship

UNKNOWN = "und"
LONGEST = 5
MAX_BITS = 27           # a bitmap has at most 2**MAX_BITS bits (16 MB)
HELD = 600_000          # distinct rows that a counting task holds before it passes them on
ROUTED = 1_000_000      # suffixes that a sorting task is meant for
BLOCK = 4096            # buckets that travel in one row
SALTS = 64

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True


def _lang_salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Pieces:
    """Words of a batch of (text, lang): key, byte range, number of the language and of the piece each stands in."""

    def __init__(self, batch: pa.RecordBatch):
        texts = Texts(batch.column(0))
        langs = batch.column(1).fill_null(UNKNOWN).dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        data, offsets = texts.data, texts.offsets
        n = len(data)
        word = ~(_GAP | _BREAK)[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.data = data
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        text = np.searchsorted(offsets, self.start, side="right") - 1
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)
        self.piece = (breaks[self.start] if n else np.zeros(0, np.int64)) + text
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int32)
        salts = np.array([_lang_salt(x) for x in self.names], dtype=np.uint64)
        key = mix(hash_ranges(data, self.start, self.end, True) ^ salts[self.lang]) if len(text) else np.zeros(0, np.uint64)
        self.key = np.maximum(key, np.uint64(1))        # 0 stands for no word

    def words(self, at: np.ndarray) -> pa.Array:
        """The words numbered ``at``, in lower case."""
        width = self.end[at] - self.start[at]
        bounds = np.concatenate([[0], np.cumsum(width)])
        flat = np.arange(bounds[-1]) + np.repeat(self.start[at] - bounds[:-1], width)
        data = self.data[flat]
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def pair_keys(key: np.ndarray) -> np.ndarray:
    """A hash of each word and the one after it."""
    return mix(key[:-1] + mix(key[1:] + np.uint64(0x9E3779B97F4A7C15)))


class Bitmap:
    """A set of keys of bounded size: it passes every key it was made from, and a few others."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def bits_for(n: int) -> int:
        return min(MAX_BITS, max(10, math.ceil(math.log2(16 * max(n, 1)))))

    @staticmethod
    def places(key: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(key >> np.uint64(shift)) & np.uint64((1 << bits) - 1) for shift in (0, 64 - MAX_BITS)]

    def passes(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), dtype=bool)
        for at in self.places(key, self.bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def of(keys: DataFrame, n: int) -> Bitmap:
        """The bitmap of a column ``key`` of ``n`` longs; at most 2**(MAX_BITS - 6) longs reach the driver."""
        bits = Bitmap.bits_for(n)
        at = F.explode(F.array(*[F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in (0, 64 - MAX_BITS)]))
        found = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow()
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
        return Bitmap(bits, words)

    @staticmethod
    def of_buckets(blocks: DataFrame, bits: int) -> Bitmap:
        """The bitmap of buckets (block, bits of its buckets); at most 2**(MAX_BITS - 3) bytes reach the driver."""
        found = blocks.toArrow()
        mask = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for block, part in zip(found["block"].to_pylist(), found["buckets"].to_pylist()):
            mask[block * BLOCK // 8: block * BLOCK // 8 + len(part)] = np.frombuffer(part, dtype=np.uint8)
        return Bitmap(bits, mask.view("<u8"))


class _Counts:
    """Counts of keys, or of rows of keys, merged as they come; passes on what it holds when that is too much."""

    def __init__(self, columns: int):
        self.columns, self.parts, self.n = columns, [], 0

    def add(self, rows: np.ndarray, ident: np.ndarray) -> None:
        """``rows`` (columns x n); equal ``ident`` means equal rows."""
        _, at, n = np.unique(ident, return_index=True, return_counts=True)
        self.parts.append((ident[at], rows[:, at], n))
        self.n += len(at)

    def merge(self) -> None:
        ident, rows, n = (np.concatenate([p[i] for p in self.parts], axis=-1) for i in range(3))
        _, at, which = np.unique(ident, return_index=True, return_inverse=True)
        self.parts = [(ident[at], rows[:, at], np.bincount(which, n, len(at)).astype(np.int64))]
        self.n = len(at)

    def full(self) -> bool:
        """Whether what is held, once merged, is still much; rows of many texts that are the same few stay."""
        if self.n <= HELD:
            return False
        self.merge()
        return self.n > HELD // 2

    def take(self, step: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            self.merge()
            _, rows, n = self.parts[0]
            for lo in range(0, len(n), step):
                yield rows[:, lo: lo + step], n[lo: lo + step].astype(np.int64)
        self.parts, self.n = [], 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (key, lang null, n) of each word and (0, lang, n) of all words of a language."""
    held, totals = _Counts(1), {}

    def rows(key: np.ndarray, lang: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), lang, pa.array(n)], names=["key", "lang", "n"])

    def out() -> Iterator[pa.RecordBatch]:
        for key, n in held.take():
            yield rows(as_long(key[0]), pa.nulls(len(n), pa.string()), n)

    for whole in batches:
        for batch in slices(whole, "text"):
            p = Pieces(batch)
            for name, n in zip(p.names, np.bincount(p.lang, minlength=len(p.names)).tolist()):
                totals[name] = totals.get(name, 0) + n
            held.add(p.key[None, :], p.key)
            if held.full():
                yield from out()
    yield from out()
    yield rows(np.zeros(len(totals), np.int64), pa.array(list(totals), pa.string()), np.array(list(totals.values()), np.int64))


def _count_pairs(words):
    """(text, lang) -> (key, null, null, n) of each pair of frequent words and (key, lang, word, 0) of each frequent word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held, known = words.value, _Counts(1), np.zeros(0, np.uint64)

        def rows(key: np.ndarray, lang: pa.Array, word: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), lang, word, pa.array(n)], names=["key", "lang", "word", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            for key, n in held.take():
                none = pa.nulls(len(n), pa.string())
                yield rows(as_long(key[0]), none, none, n)

        for whole in batches:
            for batch in slices(whole, "text"):
                p = Pieces(batch)
                ok = frequent.passes(p.key)
                distinct, at = np.unique(p.key[ok], return_index=True)
                at = np.flatnonzero(ok)[at][~np.isin(distinct, known, assume_unique=True)]
                if len(at):
                    known = np.union1d(known, p.key[at])
                    yield rows(as_long(p.key[at]), pa.array(p.names, pa.string()).take(pa.array(p.lang[at])), p.words(at), np.zeros(len(at), np.int64))
                pair = pair_keys(p.key)[ok[:-1] & ok[1:] & (p.piece[:-1] == p.piece[1:])]
                held.add(pair[None, :], pair)
                if held.full():
                    yield from out()
                if len(known) > HELD:           # words named again later count nothing
                    known = np.zeros(0, np.uint64)
        yield from out()
    return run


def suffix_columns(longest: int) -> list[str]:
    return [f"k{i}" for i in range(1, longest + 1)]


def paired_suffixes(p: Pieces, pairs: Bitmap, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (longest x n) of the suffixes of two words and more, filled up with 0, as far as every pair in them passes; and a
    hash of each of their prefixes."""
    goes_on = np.append((p.piece[:-1] == p.piece[1:]) & pairs.passes(pair_keys(p.key)), False) if len(p.key) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(goes_on)
    rows = np.zeros((longest, len(at)), dtype=np.uint64)
    ident = np.zeros((longest, len(at)), dtype=np.uint64)
    rows[0], ident[0] = p.key[at], mix(p.key[at])
    alive = np.ones(len(at), dtype=bool)
    for j in range(1, longest):
        alive = alive & goes_on[np.minimum(at + j - 1, len(goes_on) - 1)]
        rows[j, alive] = p.key[at[alive] + j]
        ident[j] = mix(ident[j - 1] * np.uint64(3) + rows[j])
    return rows, ident


def _count_runs(pairs, bits: int, least: int, longest: int):
    """(text, lang) -> (block, buckets): how often the runs of three words and more fall into each bucket, ``least`` at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.min_scalar_type(least))
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, ident = paired_suffixes(Pieces(batch), pairs.value, longest)
                at, n = np.unique(np.concatenate(Bitmap.places(ident[2:][rows[2:] != 0], bits)), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, least)
        counts = counts.reshape(-1, min(BLOCK, len(counts)))
        used = np.flatnonzero(counts.any(axis=1))
        for lo in range(0, len(used), 256):
            part = used[lo: lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[i].tobytes() for i in part], pa.binary())], names=["block", "buckets"])
    return run


def _full_buckets(least: int):
    """(block, buckets) of counts -> (block, buckets) of bits: the buckets whose counts add up to ``least`` and more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_buffer(), dtype=np.min_scalar_type(least))
                sums[block] = np.minimum(sums.get(block, 0) + more.astype(np.int64), least).astype(more.dtype)
        full = {block: np.packbits(n >= least, bitorder="little").tobytes() for block, n in sums.items() if n.max() >= least}
        yield pa.RecordBatch.from_arrays([pa.array(list(full), pa.int64()), pa.array(list(full.values()), pa.binary())], names=["block", "buckets"])
    return run


def _suffixes(pairs, runs, longest: int):
    """(text, lang) -> (k1 .. k<longest>, n): the suffixes of two words and more, as far as they may be frequent, filled up with 0."""
    names = suffix_columns(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(longest)

        def out() -> Iterator[pa.RecordBatch]:
            for keys, n in held.take():
                yield pa.RecordBatch.from_arrays([*(pa.array(as_long(k)) for k in keys), pa.array(n)], names=[*names, "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                rows, ident = paired_suffixes(Pieces(batch), pairs.value, longest)
                if not rows.size:
                    continue
                for j in range(2, longest):
                    ends = rows[j] == 0
                    ends[~ends] = ~runs.value.passes(ident[j, ~ends])
                    rows[j:, ends] = 0
                held.add(rows, ident[(rows != 0).sum(axis=0) - 1, np.arange(rows.shape[1])])
                if held.full():
                    yield from out()
        yield from out()
    return run


def frequent_prefixes(keys: np.ndarray, weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to the columns of ``keys`` (depth x n), 0 for the end of a suffix:
    (pointer, length, total weight) of every prefix of two words and more whose weight is at least ``least``."""
    depth, n = keys.shape
    order = np.arange(n)
    found: list[tuple[int, int, int]] = []
    todo = [(0, n, 0)] if n and int(weight.sum()) >= least else []
    while todo:
        lo, hi, d = todo.pop()
        at = order[lo:hi]
        word = keys[d][at]
        pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
        under, same = word < pivot, word == pivot
        parts = at[under], at[same], at[~(under | same)]
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), hi - len(parts[2])
        for x, y, part in ((lo, a, parts[0]), (b, hi, parts[2])):
            if y > x and int(weight[part].sum()) >= least:
                todo.append((x, y, d))
        total = int(weight[parts[1]].sum())
        if pivot != 0 and total >= least:
            if d:
                found.append((int(parts[1][0]), d + 1, total))
            if d + 1 < depth:
                todo.append((a, b, d + 1))
    return found


def _end(keys: np.ndarray, largest: bool) -> int:
    """The pointer to the first or last suffix in order."""
    at = np.arange(keys.shape[1])
    for column in keys:
        part = column[at]
        at = at[part == (part.max() if largest else part.min())]
    return int(at[0])


def _sorted_counts(least: int, longest: int):
    """Suffixes of one range -> (k1 .. k<longest>, n): counts of its phrases; those of its two ends are parts of counts."""
    names = suffix_columns(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        keys = np.stack([np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(longest)])
        weight = np.concatenate([b.column(longest).to_numpy() for b in got])
        ends = {}
        for end in {_end(keys, False), _end(keys, True)}:
            for d in range(2, longest + 1):
                if keys[d - 1, end] != 0:
                    ends.setdefault(tuple(keys[:d, end].tolist()), end)
        rows = [(p, weight[(keys[: len(p)] == np.array(p)[:, None]).all(axis=0)].sum()) for p in ends]
        rows += [(p, n) for at, d, n in frequent_prefixes(keys, weight, least) if (p := tuple(keys[:d, at].tolist())) not in ends]
        table = np.zeros((longest, len(rows)), dtype=np.int64)
        for i, (p, _) in enumerate(rows):
            table[: len(p), i] = p
        counts = pa.array(np.array([n for _, n in rows], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*(pa.array(t) for t in table), counts], names=[*names, "n"])
    return run


def phrase_counts(docs: DataFrame, text: str, lang: str, least: int, longest: int, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) of all words; (key, lang, word, a) of the words, and (keys, a) of the phrases of 2 to ``longest`` words, that
    occur ``least`` times and more."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = space.save(rows.mapInArrow(_count_words, "key long, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= least) | F.col("lang").isNotNull()), "words")
    totals, frequent = counted.where("lang is not null").select("lang", "n"), counted.where("lang is null").select("key", F.col("n").alias("a"))
    words = ship(spark, Bitmap.of(frequent, frequent.count()))
    paired = space.save(rows.mapInArrow(_count_pairs(words), "key long, lang string, word string, n long").groupBy("key", "lang", "word").agg(
        F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNotNull()), "pairs")
    named = paired.where("word is not null").join(frequent, "key").select("key", "lang", "word", "a")
    often = paired.where("word is null")
    size = often.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("suffixes")).first()
    pairs = ship(spark, Bitmap.of(often, size["pairs"]))
    names, partitions, few = suffix_columns(longest), int(spark.conf.get("spark.sql.shuffle.partitions")), rows.coalesce(parallelism(spark))
    bits, blocks = Bitmap.bits_for(size["suffixes"] // least), "block long, buckets binary"
    full = few.mapInArrow(_count_runs(pairs, bits, least, longest), blocks).repartition(partitions, "block").mapInArrow(_full_buckets(least), blocks)
    runs = ship(spark, Bitmap.of_buckets(full, bits))
    suffixes = space.save(few.mapInArrow(_suffixes(pairs, runs, longest), ", ".join(f"{k} long" for k in [*names, "n"])), "suffixes")
    routed = suffixes.repartitionByRange(max(partitions, math.ceil(suffixes.count() / ROUTED)), *names)
    parts = routed.mapInArrow(_sorted_counts(least, longest), routed.schema)
    phrases = parts.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least).select(
        F.filter(F.array(*names), lambda k: k != 0).alias("keys"), "a")
    return totals, space.save(named, "named"), space.save(phrases, "phrases")


def collocations(docs: DataFrame, text: str, lang: str, least: int = 100, longest: int = LONGEST, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by the score of their weakest cut.

    score = floor(1000 * a * n / (l * r)), a, l and r the counts of the phrase, of its part before the cut and of the rest, n the words
    of the language. A phrase goes if it lies inside a longer one that has at least ``share`` hundredths of its count.
    """
    totals, named, phrases = phrase_counts(docs, text, lang, least, longest, Workspace(docs.sparkSession, "phrases"))
    counts = phrases.union(named.select(F.array("key").alias("keys"), "a"))
    size = F.size("keys")
    within = phrases.where(size > 2).select(
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
            F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("keys", i, m))))).alias("keys"), "a").groupBy("keys").agg(F.max("a").alias("longer"))
    free = phrases.join(within, "keys", "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).select("keys", "a")
    cuts = free.select("keys", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("keys", F.lit(1), F.col("k")).alias("left"), F.slice("keys", F.col("k") + 1, size).alias("right"), F.col("keys")[0].alias("key"))
    parts = cuts.join(counts.select(F.col("keys").alias("left"), F.col("a").alias("l")), "left").join(
        counts.select(F.col("keys").alias("right"), F.col("a").alias("r")), "right").join(named.select("key", "lang"), "key").join(totals, "lang")
    whole = "decimal(19,0)"
    scored = parts.withColumn("score", F.expr(
        f"(cast(1000 * a as {whole}) * cast(n as {whole})) div (cast(l as {whole}) * cast(r as {whole}))")).groupBy("keys").agg(
        F.min(F.struct("score", "k", "l", "r", "n", "lang", "a")).alias("cut")).select("keys", "cut.*")
    order = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):             # ties at the cut stay until the phrases are spelt
        near = near.withColumn("at", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= top)
    spelt = near.select("keys", F.posexplode("keys").alias("i", "key")).join(named.select("key", "word"), "key").groupBy("keys").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = near.join(spelt, "keys").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
