"""Mixing sources to target weights with blocks, multinomial shards and index permutations.

Words of a source, its documents in a fixed order, form one stream that is cut into blocks of
``BLOCK`` words. The mix is a sequence of slots in output shards: every shard draws its number of
slots per source from a multinomial, a running sum over shards turns the draws into slot numbers of the
source, a seeded permutation of the block numbers (one per source and pass) turns a slot number into a
block, and slots meet blocks by (source, block). What the shards drew beyond a source's
slots is cut from the last ones and what they left is a make-up draw of the last shard, so every source
gets its exact number of slots; the last slot of a source may take the front part of its block.

Offsets in a source's stream come from totals of hashed chunks, so no source is ordered in one task.

Defined cases: a null text has size 0, a document of size 0 is in the result and takes nothing; a
null source is a source of its own, after all others; repeated rows and null ids are documents like any
other; a source without words has target 0, and without any words all targets are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vectables.llm.store import Workspace

BLOCK = 64              # words in a block
CHUNK_ROWS = 20_000     # documents for each chunk number; a source's documents of one chunk are ordered in one task
SHARD_SLOTS = 1 << 16   # slots of an output shard
MOST_TASKS = 10_000     # tasks that number slots
MOST = 3                # a source's target is at most this many times its size
WEIGHTS = (5.0, 2.0, 1.0)

_WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = MOST) -> list[float]:
    """Each source's words in the mix: shares of ``share`` x all words by weight, at most ``most`` times
    a source's size; what is above goes to the others by weight until none is above."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        scale = sum(weights[i] for i in open_)
        full = [i for i in open_ if total * weights[i] / scale >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = total * weights[i] / scale
            break
        for i in full:
            out[i] = float(most * sizes[i])
            total -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(index: np.ndarray, n: int, seed: int | list[int]) -> np.ndarray:
    """A seeded permutation of 0..n-1 at ``index``: a four-round Feistel network over the next even
    number of bits, walked until the value is below n."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 4, dtype=np.uint64)

    def turn(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for key in keys:
            f = (b + key) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(33)) & low)
        return (a << np.uint64(half)) | b

    out = turn(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = turn(out[far])
    return out.astype(np.int64)


def source_key(source: Column) -> Column:
    """A key that is never null: ``n`` for the null source, else ``s`` and the name."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def plan(docs: DataFrame, source_col: str, size_col: str, share: float = 1.0,
         weights: tuple[float, ...] = WEIGHTS) -> pd.DataFrame:
    """One row per source, by code point and null last: src, size, target, blocks, passes, rest.

    ``docs`` documents; ``passes`` whole passes over the source's blocks, then ``rest`` words of one more.
    """
    rows = docs.groupBy(source_key(F.col(source_col)).alias("src")).agg(
        F.sum(size_col).alias("size"), F.count("*").alias("docs")).collect()
    rows = sorted((r["src"] == "n", r["src"], int(r["size"] or 0), r["docs"]) for r in rows)
    sizes = [r[2] for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share)
    words = [min(round(t), MOST * n) for t, n in zip(goal, sizes)]
    return pd.DataFrame({
        "src": [r[1] for r in rows], "size": sizes, "docs": [r[3] for r in rows], "target": goal, "blocks": [-(-n // BLOCK) for n in sizes],
        "passes": [w // n if n else 0 for w, n in zip(words, sizes)],
        "rest": [w % n if n else 0 for w, n in zip(words, sizes)],
    })


def _draw(slots: list[int], seed: int):
    """Multinomial number of slots per source for each shard."""
    total = sum(slots)
    p = np.asarray(slots, dtype=np.float64) / max(total, 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["shard"]:
                n = min(SHARD_SLOTS, total - SHARD_SLOTS * int(shard))
                drawn = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(n, p)
                yield pd.DataFrame({"shard": shard, "k": np.arange(len(p)), "drawn": drawn})

    return run


def _number(keys: list[str], blocks: list[int], rests: list[int], slots: list[int], seed: int):
    """Rows (shard, source, first slot, slots) -> one row per slot with its pass and block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, k, first, n in frame[["shard", "k", "first", "n"]].itertuples(index=False):
                for lo in range(int(first), int(first + n), SHARD_SLOTS):
                    j = np.arange(lo, min(lo + SHARD_SLOTS, int(first + n)), dtype=np.int64)
                    turn, at = j // blocks[k], j % blocks[k]
                    for t in np.unique(turn):
                        own = turn == t
                        at[own] = permuted(at[own], blocks[k], [seed, int(k), int(t)])
                    front = rests[k] % BLOCK or BLOCK
                    yield pd.DataFrame({"shard": shard, "src": keys[k], "slot": j, "turn": turn, "block": at,
                                        "take": np.where(j == slots[k] - 1, front, BLOCK)})

    return run


def shard_slots(spark: SparkSession, sources: pd.DataFrame, seed: int = 7) -> DataFrame:
    """The mix: ``(shard, src, slot, turn, block, take)``, at most ``take`` words from the block's front."""
    slots = [int(p * b + -(-r // BLOCK)) for p, b, r in zip(sources["passes"], sources["blocks"], sources["rest"])]
    shards = -(-sum(slots) // SHARD_SLOTS)
    drawn = spark.range(shards).select(F.col("id").alias("shard")).mapInPandas(
        _draw(slots, seed), "shard long, k int, drawn long")
    limit = F.element_at(F.array(*[F.lit(n).cast("long") for n in slots] or [F.lit(0).cast("long")]), F.col("k") + 1)
    upto = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = drawn.withColumn("upto", F.sum("drawn").over(upto)).select(
        "shard", "k", F.least(F.col("upto") - F.col("drawn"), limit).alias("first"),
        F.when(F.col("shard") == shards - 1, limit).otherwise(F.least("upto", limit)).alias("end"))
    # a shard of a source is a unit of work: given as a number of partitions, so they are not put together for their few bytes
    ranges = ranges.select("shard", "k", "first", (F.col("end") - F.col("first")).alias("n")).where("n > 0").repartition(
        max(1, min(shards, MOST_TASKS)), "shard", "k")
    return ranges.mapInPandas(
        _number(sources["src"].tolist(), sources["blocks"].astype(int).tolist(), sources["rest"].astype(int).tolist(), slots, seed),
        "shard long, src string, slot long, turn long, block long, take long")


def _placed(docs: DataFrame, chunks: int) -> DataFrame:
    """Adds ``first``, the number of the document's first word in its source's stream.

    ``docs(src, mark, size)``; order: by hashed chunk, then by mark. Rows with equal marks are alike.
    """
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("mark"), F.lit(chunks)))
    total = docs.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select("src", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_first"))
    inside = Window.partitionBy("src", "chunk").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    local = docs.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(start, ["src", "chunk"]).withColumn("first", F.col("chunk_first") + F.col("local"))


def mix(docs: DataFrame, id_col: str, source_col: str, text_col: str, share: float = 1.0,
        weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """One row per document: ``(id, src, mark, size, source_size, target, taken, ranges)``.

    ``ranges`` lists what the mix takes: (turn, lo, hi) for words lo..hi-1 of the document, a turn
    being one pass over the source. ``mark`` identifies the row up to equal (id, text).
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    sized = space.save(docs.select(
        F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("src"), n_words(F.col(text_col)).alias("size"),
        F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.xxhash64(text_col).alias("t")).alias("mark"),
    ), "sized")
    sources = plan(sized.withColumn("source", F.when(F.col("src") != "n", F.expr("substring(src, 2)"))), "source", "size", share, weights)
    table = spark.createDataFrame(
        list(sources[["src", "size", "target"]].itertuples(index=False, name=None)), "src string, source_size long, target double")
    placed = _placed(sized.where("size > 0"), max(1, -(-int(sources["docs"].sum()) // CHUNK_ROWS)))

    first, size = F.col("first"), F.col("size")
    pieces = placed.select("id", "src", "mark", "first", "size", F.explode(F.sequence(
        F.floor(first / BLOCK), F.floor((first + size - 1) / BLOCK))).alias("block"))
    lo = F.greatest(F.lit(0), first - F.col("block") * BLOCK)                     # the piece within its block
    hi = F.least(F.lit(BLOCK).cast("long"), first + size - F.col("block") * BLOCK)
    pieces = pieces.withColumn("lo", lo).withColumn("hi", hi)
    slots = shard_slots(spark, sources, seed).select("src", "block", "turn", "take").hint("merge")  # its rows are many more than the plan can know
    met = pieces.join(slots, ["src", "block"], "left").withColumn("end", F.when(F.col("take").isNotNull(), F.least("hi", "take")))
    at = F.col("block") * BLOCK - F.col("first")
    got = F.when(F.col("end") > F.col("lo"), F.struct("turn", (at + F.col("lo")).alias("lo"), (at + F.col("end")).alias("hi")))
    taken = met.groupBy("src", "first", "id", "mark", "size").agg(F.sort_array(F.collect_list(got)).alias("ranges"))
    none = F.array().cast("array<struct<turn:bigint,lo:bigint,hi:bigint>>")
    rows = taken.select("id", "src", "mark", "size", "ranges").union(
        sized.where("size = 0").select("id", "src", "mark", "size", none))
    total = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["hi"] - r["lo"])
    return rows.join(table, "src").select("id", "src", "mark", "size", "source_size", "target", total.alias("taken"), "ranges")
