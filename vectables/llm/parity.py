"""N-gram Jaccard join by parity sketches.

A text's set is its distinct k-word shingles. Two sets of sizes a <= b with Jaccard of at least
num/den differ in at most (a + b) * (den - num) / (den + num) shingles. Sizes are cut into bands; a band's
sketch has more blocks than that largest difference, and every shingle flips bits of one
block: in the wide sketch all bits of a 64-bit hash (its XOR identifies a block), in the narrow one
a single bit, so that the Hamming distance of two narrow sketches never exceeds the difference of the sets. Differing
shingles touch at most one block each, so two sets that link agree in all blocks but those (pigeonhole). A set joins the
blocks of its own band, and those of the band below where a partner can be there. Nothing is sampled: no link can be
missed. Of the blocks in one order, fullest first, a set joins one more than its largest difference to a partner: the first
block in which two linking sets agree is preceded in either by differing blocks alone, so it is among those. Blocks of
one shingle or none, which texts have in common by chance, are the last.

Sets that are equal form one class. Classes that share a block are paired with one pivot class each: first within
a task, which ships every block once however many of its texts have it, then between tasks, by hashed
buckets of blocks, keeping only one pivot per block in memory. Of these pairs, those whose bitmaps (sketches of a bit
a block) are no farther apart than a link allows are verified on the texts, and the links found
join classes to components. What is left, pairs in one cluster of block-sharing classes but in different
components, is compared by the Hamming distance of narrow sketches, a size band at a time and in blocks of at most
``SIDE`` x ``SIDE`` classes; the pairs that are near enough are verified on the texts as well.

Defined cases: null text is empty; an empty text has no set, links with nothing and is its own
component; a row with a null id has a null component and links with nothing; repeated rows are judged one by
one and share a component; set elements are 52-bit hashes of lower-cased words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vectables.llm.components import connected_components
from vectables.llm.store import Workspace, rows_of
from vectables.llm.text import SLICE_BYTES, Texts, Words, as_long, lean, mix, shingle_sets, slices

BAND = 0.68         # ratio of the edges of a size band
SPARE = 0.3         # blocks of a sketch beyond those that must be joined, as a share of them
FLUSH = 2_000_000   # block rows that a task holds before it pairs and ships them
BUCKET = 4_000_000  # shingles of all texts for each bucket of blocks
SIDE = 4_096        # classes on either side of a block of comparisons


class Bands:
    """Size bands of a threshold num/den: the largest difference of a linking pair whose smaller set is in the
    band, and the number of blocks of the band's sketch."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 31:
            edges.append(max(edges[-1] + 1, int(edges[-1] / BAND)))
        self.edges = np.array(edges)
        top = self.edges[1:] - 1
        self.apart = (top + top * den // num) * (den - num) // (den + num)
        empty = np.exp(-self.edges[:-1] / (self.apart + 1))            # share of blocks that hold no shingle
        self.blocks = self.apart + 1 + np.ceil(np.maximum(SPARE, 2 * empty) * (self.apart + 1) * (self.apart > 0)).astype(np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def joined(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set number, band) of every band that a set joins, by set number."""
        own = self.of(sizes)
        some = np.flatnonzero(sizes > 0)
        least = -(-sizes * self.num // self.den)
        below = some[(own[some] > 0) & (least[some] < self.edges[own[some]])]
        at, band = np.concatenate([some, below]), np.concatenate([own[some], own[below] - 1])
        order = np.argsort(at, kind="stable")
        return at[order], band[order]

    def differ(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The largest difference of a set of each size to a partner that it links with in each band."""
        other = np.where(self.of(sizes) == band, sizes * self.den // self.num, self.edges[band + 1] - 1)
        return (sizes + other) * (self.den - self.num) // (self.den + self.num)


def sketch(sets: np.ndarray, bounds: np.ndarray, at: np.ndarray, band: np.ndarray, bands: Bands, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of set ``at[i]`` in band ``band[i]``, flat; how many shingles each has; the bounds of each sketch."""
    sizes = np.diff(bounds)[at]
    blocks = bands.blocks[band]
    edges = np.concatenate([[0], np.cumsum(blocks)])
    member = np.repeat(np.arange(len(at)), sizes)
    place = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[at], sizes)
    x = mix(sets[place])
    block = edges[member] + (((x >> np.uint64(32)) * blocks[member].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    out = np.zeros(edges[-1], dtype=np.uint64)
    np.bitwise_xor.at(out, block, mix(x) if wide else np.uint64(1) << (x & np.uint64(63)))
    return out, np.bincount(block, minlength=edges[-1]), edges


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(1)), dtype=np.uint64)])
    return as_long(mix((sums[bounds[1:]] - sums[bounds[:-1]]) + np.diff(bounds).astype(np.uint64)))


def bitmaps(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A parity bitmap of each set: a shingle flips one bit. It has two bits a shingle or more, a power of two."""
    sizes = np.diff(bounds)
    width = 1 << np.ceil(np.log2(np.maximum(sizes / 32, 1))).astype(np.int64)          # in words of 64 bits
    edges = np.concatenate([[0], np.cumsum(width)])
    x = mix(sets ^ np.uint64(0xB5297A4D3F84D5B5))
    word = np.repeat(edges[:-1], sizes) + ((x >> np.uint64(6)).astype(np.int64) & np.repeat(width - 1, sizes))
    out = np.zeros(edges[-1], dtype=np.uint64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (x & np.uint64(63)))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(out)])


def bits_apart(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Differing bits of each pair of bitmaps, the wider one folded to the other: never more than the sets' difference."""
    size = [pc.binary_length(x).to_numpy().astype(np.int64) // 8 for x in (left, right)]
    kind, group = np.unique(np.stack(size, axis=1), axis=0, return_inverse=True)
    out = np.zeros(len(left), dtype=np.int64)
    for g, widths in enumerate(kind.tolist()):
        at = np.flatnonzero(group.ravel() == g)
        folded = []
        for column, w in zip((left, right), widths):
            words = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype=np.uint64)
            folded.append(np.bitwise_xor.reduce(words.reshape(len(at), w // min(widths), min(widths)), axis=1))
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
    return out


def _sizes(k: int):
    """(id, text) -> (id, number of shingles, fingerprint, bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                sets, bounds = shingle_sets(Words(Texts(batch.column(1))), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(fingerprints(sets, bounds)), bitmaps(sets, bounds)],
                    names=["id", "n_shingles", "fp", "bits"])

    return run


_BLOCKS = "bucket int, part long, keys array<long>, fps array<long>, left array<long>, right array<long>"
_KEY_BITS = 32          # of a block's hash that are compared, besides those that choose its bucket


def _pivots(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first row of every key (keys, fps), and the distinct pairs (fp, first fp) of all others."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    pivot = fps[first][np.cumsum(first) - 1]
    other = ~first & (fps != pivot)
    pairs = np.unique(np.stack([fps[other], pivot[other]], axis=1), axis=0)
    return keys[first], fps[first], pairs[:, 0], pairs[:, 1]


def joins(keys: np.ndarray, shingles: np.ndarray, member: np.ndarray, edges: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Blocks that each sketch joins: one more than the largest difference, the fullest, by their keys where equally full."""
    order = np.lexsort((keys, -shingles, member))
    return order[np.arange(len(order)) - edges[:-1][member] <= differ[member]]


def _blocks(k: int, bands: Bands, buckets: int):
    """Texts -> rows per bucket of blocks: the blocks' keys and one class of the task that has each, as parallel
    lists; and the pairs of classes that met in a block within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def shipped() -> pa.RecordBatch:
            nonlocal part
            keys, fps, left, right = _pivots(*(np.concatenate(c) for c in zip(*held)))
            cuts = np.searchsorted(keys >> np.uint64(_KEY_BITS), np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            listed = pa.array(np.append(cuts[used], cuts[-1]), pa.int32())
            none = np.zeros(len(used) + 1, np.int32)
            none[1 + part % len(used):] = len(left)         # the task's own pairs ride with one of its rows
            low = keys & np.uint64((1 << _KEY_BITS) - 1)
            lists = [pa.ListArray.from_arrays(listed, pa.array(as_long(low))), pa.ListArray.from_arrays(listed, pa.array(fps)),
                     pa.ListArray.from_arrays(pa.array(none), pa.array(left)), pa.ListArray.from_arrays(pa.array(none), pa.array(right))]
            out = pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), part)), *lists], names=["bucket", "part", "keys", "fps", "left", "right"])
            part += 1
            return out

        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                sets, bounds = shingle_sets(Words(Texts(batch.column(0))), k)
                at, band = bands.joined(np.diff(bounds))
                blocks, shingles, edges = sketch(sets, bounds, at, band, bands, wide=True)
                count = np.diff(edges)
                member = np.repeat(np.arange(len(at)), count)
                which = (band.astype(np.uint64) << np.uint64(40))[member] + (np.arange(len(blocks)) - edges[:-1][member]).astype(np.uint64)
                keys = mix(blocks ^ mix(which))
                use = joins(keys, shingles, member, edges, bands.differ(np.diff(bounds)[at], band))
                keys = ((keys >> np.uint64(_KEY_BITS)) * np.uint64(buckets) & ~np.uint64((1 << _KEY_BITS) - 1)) | (keys & np.uint64((1 << _KEY_BITS) - 1))
                if len(use):
                    held.append((keys[use], fingerprints(sets, bounds)[at][member[use]]))
                    rows += len(held[-1][0])
                if rows > FLUSH:
                    yield shipped()
                    held, rows = [], 0
        if rows:
            yield shipped()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> pairs (fa, fb) of classes that share a block, one pivot per block."""
    bucket, held, rows, kept = None, [], 0, 0

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["fa", "fb"])

    for batch in batches:
        lists = [(c.flatten().to_numpy(), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])) for c in batch.columns[2:]]
        yield pairs(lists[2][0], lists[3][0])
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b != bucket or rows > kept + FLUSH:
                if held:
                    keys, fps, left, right = _pivots(*(np.concatenate(c) for c in zip(*held)))
                    yield pairs(left, right)
                    held, rows = [(keys, fps)], len(keys)
                    kept = rows
                if b != bucket:
                    bucket, held, rows, kept = b, [], 0, 0
            held.append(tuple(v[at[i]: at[i + 1]] for v, at in lists[:2]))
            rows += len(held[-1][0])
    if held:
        yield pairs(*_pivots(*(np.concatenate(c) for c in zip(*held)))[2:])


def _near(num: int, den: int):
    """Pairs of classes with sizes and bitmaps -> the pairs, and whether they can link as far as these tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            able = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
            at = np.flatnonzero(able)
            left, right = (batch.column(i).take(pa.array(at)) for i in (6, 7))
            able[at] = bits_apart(left, right) <= ((na + nb) * (den - num) // (den + num))[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(able)], names=["a", "b", "fa", "fb", "able"])

    return run


def _links(k: int, num: int, den: int):
    """Rows (a, b, fa, fb, text_a, text_b) -> (a, b) of those whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in slices(whole, "text_a", SLICE_BYTES // 2):
                for batch in slices(half, "text_b", SLICE_BYTES // 2):
                    left, lb = shingle_sets(Words(Texts(batch.column(4))), k)
                    right, rb = shingle_sets(Words(Texts(batch.column(5))), k)
                    na, nb = np.diff(lb), np.diff(rb)
                    row = np.arange(batch.num_rows, dtype=np.uint64) << np.uint64(52)
                    both = np.intersect1d(np.repeat(row, na) | left, np.repeat(row, nb) | right, assume_unique=True)
                    common = np.bincount((both >> np.uint64(52)).astype(np.int64), minlength=batch.num_rows)
                    ok = (den * common >= num * (na + nb - common)) & (na > 0)
                    ok &= fingerprints(left, lb) == batch.column(2).to_numpy()
                    ok &= fingerprints(right, rb) == batch.column(3).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def _narrow(k: int, bands: Bands):
    """(id, cluster, fp, component, n, text) -> a row per band the set joins, with its narrow sketch there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                sets, bounds = shingle_sets(Words(Texts(batch.column(5))), k)
                right = fingerprints(sets, bounds) == batch.column(2).to_numpy()
                at, band = bands.joined(np.diff(bounds))
                at, band = at[right[at]], band[right[at]]
                blocks, _, edges = sketch(sets, bounds, at, band, bands, wide=False)
                row = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).take(row), pa.array(band.astype(np.int32)), batch.column(0).take(row), batch.column(3).take(row),
                    batch.column(4).take(row), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(as_long(blocks))),
                ], names=["cluster", "band", "id", "component", "n", "blocks"])

    return run


def _candidates(bands: Bands):
    """One group (cluster, band, i, j): pairs between its sides i and j, the smaller set in the band, of different
    components and with narrow sketches no farther apart than a link allows."""
    num, den = bands.num, bands.den

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, band, i, j = key
        frame = frame.sort_values(["n", "id"], ignore_index=True)
        ids, n, sub = frame["id"].to_numpy(), frame["n"].to_numpy(), frame["sub"].to_numpy()
        component = frame["component"].to_numpy()
        rows = np.stack([np.asarray(s, dtype=np.int64) for s in frame["blocks"]]).view(np.uint64)
        out = []
        for a in range(int(np.searchsorted(bands.of(n), band, side="right"))):
            b = np.arange(a + 1, int(np.searchsorted(n, n[a] * den // num, side="right")))
            b = b[(component[b] != component[a]) & ((sub[b] != sub[a]) if i != j else True)]
            apart = np.bitwise_count(rows[b] ^ rows[a]).sum(axis=1, dtype=np.int64)
            near = b[apart <= (n[a] + n[b]) * (den - num) // (den + num)]
            out.append(np.stack([np.full(len(near), ids[a]), ids[near]], axis=1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def jaccard_components(docs: DataFrame, id_col: str, text_col: str, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``(id, n_shingles, component)`` for each row: links where den * common >= num * union."""
    spark = docs.sparkSession
    space, bands = Workspace(spark, "parity"), Bands(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = space.save(texts.mapInArrow(lean(_sizes(k)), "id long, n_shingles long, fp long, bits binary"), "rows")
    filled = rows.where("id is not null and n_shingles > 0")
    classes = space.save(filled.groupBy("fp").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.first("bits").alias("bits")), "classes")

    total = rows.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    buckets = max(64, -(-int(total) // BUCKET))
    dealt = texts.where("id is not null").select("text").mapInArrow(lean(_blocks(k, bands, buckets)), _BLOCKS)
    met = dealt.repartition("bucket").sortWithinPartitions("bucket", "part").select("bucket", "part", "keys", "fps", "left", "right")
    pairs = space.save(met.mapInArrow(lean(_meet), "fa long, fb long").distinct(), "pairs")
    a, b = (classes.select(F.col("fp").alias(f"f{s}"), F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    star = pairs.join(a, "fa").join(b, "fb").select("a", "b", "fa", "fb", "na", "nb", "bits_a", "bits_b")
    star = space.save(star.mapInArrow(lean(_near(num, den)), "a long, b long, fa long, fb long, able boolean"), "star")
    space.drop("pairs")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs (a, b, fa, fb), by their texts."""
        pairs = space.save(pairs, f"{name}-pairs")
        ends = space.save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-ends")
        some = rows_of(texts, ends, "id")
        text_a, text_b = (some.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        both = pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "fa", "fb", "text_a", "text_b")
        links = space.save(both.mapInArrow(lean(_links(k, num, den)), "a long, b long").distinct(), name)
        space.drop(f"{name}-pairs")
        space.drop(f"{name}-ends")
        return links

    links = verified(star.where("able").select("a", "b", "fa", "fb"), "links")
    found = space.save(connected_components(links, space, "linked"), "found")

    # classes that share buckets but are not yet in one component
    near = space.save(connected_components(star, space, "near"), "near")
    member = near.select("id", F.col("component").alias("cluster")).join(found, "id", "left").select(
        "id", "cluster", F.coalesce("component", "id").alias("component"))
    paired = star.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("o")).distinct().join(near, "id")
    paired = paired.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("pairs"))
    size = member.groupBy("cluster").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = size.join(paired, "cluster").where("lo <> hi and pairs < m * (m - 1) / 2").select("cluster")
    rest = space.save(member.join(open_, "cluster").join(classes, "id").select("id", "cluster", "fp", "component", "n"), "rest")
    narrow = space.save(rest.join(rows_of(texts, rest.select("id"), "id"), "id").select("id", "cluster", "fp", "component", "n", "text").mapInArrow(
        lean(_narrow(k, bands)), "cluster long, band int, id long, component long, n long, blocks array<long>"), "narrow")
    group = narrow.groupBy("cluster", "band").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    group = group.where("lo <> hi").select("cluster", "band", F.ceil(F.col("m") / SIDE).alias("sides"))
    sub = narrow.join(group, ["cluster", "band"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("sides")))
    spread = sub.withColumn("other", F.explode(F.expr("sequence(0, sides - 1)"))).select(
        "cluster", "band", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "id", "component", "n", "sub", "blocks")
    near = spread.groupBy("cluster", "band", "i", "j").applyInPandas(_candidates(bands), "a long, b long").distinct()
    with_fps = near.join(classes.select(F.col("id").alias("a"), F.col("fp").alias("fa")), "a").join(
        classes.select(F.col("id").alias("b"), F.col("fp").alias("fb")), "b")
    more = verified(with_fps.select("a", "b", "fa", "fb"), "more")
    joined = space.save(connected_components(links.union(more), space, "joined"), "joined")
    for name in ("star", "links", "found", "near", "rest", "narrow", "more"):
        space.drop(name)

    by_class = classes.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    return rows.join(by_class, "fp", "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
