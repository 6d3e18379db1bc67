"""Language-model scoring with a hashed, class-factored maximum-entropy model.

    P(word | history) = P(class of word | history) * P(word | class)

The class probability is a softmax over ``CLASSES`` classes whose weights are rows of a hashed table: one for the
word before, one each for the words two and three before (skips), and one for the pair of words before
(n-gram). Histories see a word's ending (last three bytes), which stays informative for rare words. P(word | class)
is the smoothed unigram within the class, where every class has one more event for words it has not seen. So
the model is a proper distribution over the same events as the base unigram.

Counting: every task counts its words, Spark sums them; the same pass sums which endings follow which, a table of
bounded size from which the endings are clustered into classes. Training: ``ROUNDS`` rounds, each over all
training texts; every task runs sparse gradient steps from the shared weights over its texts, and the weights
of a row become the mean of the tasks' weights, by how often each saw the row. Scoring: one pass over all texts; counts of
the ``HEAD`` most frequent words travel to the tasks (a bounded table), all others meet their counts in a join.

Defined cases: words are lower-cased A-Z; a null or empty text is its end token alone; a null id is trained on; rows that
repeat count and are scored one by one; with no training rows all scores are those of unseen words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vectables.llm.store import Workspace
from vectables.llm.text import Texts, Words, as_long, mix, slices

CLASSES = 32            # class 0 is the end of a text
ENDINGS = 4_096         # buckets of word endings; 0 is the end of a text
CONTEXTS = 256          # buckets of endings that a following ending is clustered by
ROWS = 1 << 14          # rows of the weight table, the last one is the bias
ROUNDS = 2
BATCH = 8_192           # tokens of one gradient step
RATE = 0.3
HEAD = 1 << 18          # most words whose counts travel to every task
ALPHA = 0.1

END = np.uint64(0x51ED270B4A1D3C6F)     # the end token's hash
_MEMORY = 1_500_000                     # distinct words beyond which a counting task passes on what it holds
_WAITING = 500_000                      # words of its batches that it holds before it merges them
_SENT = 100_000                         # most rows of a batch that it passes on


class Tokens:
    """All tokens of a batch, each text's words and then its end: hash, ending bucket, text number."""

    def __init__(self, column: pa.Array):
        texts = Texts(column)
        words = Words(texts)
        n = len(texts)
        data, end, width = texts.data, words.end, words.end - words.start
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        code = np.zeros(len(end), dtype=np.uint64)
        for j in range(3):
            has = width > j
            code[has] |= lower[data[end[has] - 1 - j]] << np.uint64(8 * j)
        ending = (mix(code + np.uint64(1)) % np.uint64(ENDINGS - 1)).astype(np.int64) + 1
        self.bounds = words.bounds + np.arange(n + 1)
        at = np.arange(len(end)) + words.text
        self.hash = np.full(self.bounds[-1], END, dtype=np.uint64)
        self.ending = np.zeros(self.bounds[-1], dtype=np.int64)
        self.hash[at], self.ending[at] = words.hash, ending
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(n), self.count)
        self.place = np.arange(len(self.hash)) - self.bounds[self.text]

    def before(self, j: int) -> np.ndarray:
        """Ending of the token j places before each token; 0 before the start of its text."""
        out = np.zeros_like(self.ending)
        out[j:] = self.ending[:-j]
        out[self.place < j] = 0
        return out


def features(tokens: Tokens) -> np.ndarray:
    """Weight rows of every token's history: previous ending, two skips, and the pair before it."""
    a, b, c = (tokens.before(j).astype(np.uint64) for j in (1, 2, 3))
    pair = a * np.uint64(ENDINGS) + b
    codes = [x + (np.uint64(kind) << np.uint64(40)) for kind, x in enumerate((a, b, c, pair), 1)]
    return np.stack([(mix(x) % np.uint64(ROWS - 1)).astype(np.int32) for x in codes])


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One list (word, ending, n) of lists that are each sorted by word: sorted, a word once, its n summed."""
    word = np.concatenate([h[0] for h in held])
    order = np.argsort(word, kind="stable")                     # merges runs that are sorted
    word = word[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    word, ending = word[first], np.concatenate([h[1] for h in held])[order[first]]
    return word, ending, np.add.reduceat(np.concatenate([h[2] for h in held])[order], first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (kind 0, word hash, ending, n) and (kind 1, ending x context, 0, n), summed over the task."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []      # each sorted by word
    waiting = 0
    follows = np.zeros(ENDINGS * CONTEXTS, dtype=np.int64)

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(a), _SENT):
            part = slice(lo, lo + _SENT)
            size = len(a[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, kind, np.int32)), pa.array(a[part]), pa.array(b[part].astype(np.int32)), pa.array(n[part])], names=["kind", "a", "b", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            t = Tokens(batch.column(0))
            distinct, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((distinct, t.ending[first].astype(np.int16), n))
            waiting += len(distinct)
            for j in (1, 2):
                context = (mix(t.before(j).astype(np.uint64)) % np.uint64(CONTEXTS)).astype(np.int64)
                follows += np.bincount(t.ending * CONTEXTS + context, minlength=len(follows))
            if waiting > _WAITING:
                held, waiting = [_merged(held)], 0
                if len(held[0][0]) > _MEMORY:
                    word, ending, n = held.pop()
                    yield from rows(0, as_long(word), ending, n)
    if held:
        word, ending, n = _merged(held)
        yield from rows(0, as_long(word), ending, n)
    at = np.flatnonzero(follows)
    yield from rows(1, at, np.zeros(len(at), dtype=np.int16), follows[at])


def cluster(follows: np.ndarray, classes: int = CLASSES, turns: int = 15) -> np.ndarray:
    """Class of every ending from what it follows: k-means of the square roots of its context shares, weighted
    by frequency, started from spread-out frequent endings. Ending 0 is class 0."""
    n = follows.sum(axis=1).astype(np.float64)
    n[0] = 0
    out = np.zeros(len(follows), dtype=np.int64)
    own = np.flatnonzero(n)
    if not len(own):
        return out
    x = np.sqrt(follows[own] / n[own, None])
    center = [x[np.argmax(n[own])]]
    apart = np.full(len(own), np.inf)
    for _ in range(min(classes - 1, len(own)) - 1):
        apart = np.minimum(apart, 2 - 2 * x @ center[-1])
        center.append(x[np.argmax(np.maximum(apart, 0) * n[own])])
    center = np.array(center)
    for _ in range(turns):
        best = np.argmax(2 * x @ center.T - (center ** 2).sum(axis=1), axis=1)
        for c in range(len(center)):
            mine = best == c
            if mine.any():
                center[c] = np.average(x[mine], axis=0, weights=n[own][mine])
    out[own] = best + 1
    return out


def _log_shares(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log class probabilities of histories given by their weight rows, shape (tokens, classes)."""
    z = _scores(weights, rows)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the weights of histories, the largest of each 0: logarithms of class shares but for a constant."""
    z = weights.take(rows[0], axis=0)
    z += weights[ROWS - 1]
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z


def _step(weights: np.ndarray, squares: np.ndarray, own: np.ndarray, slope: np.ndarray) -> None:
    """One adaptive step of the rows ``own``."""
    seen = squares.take(own, axis=0)
    seen += slope * slope
    squares[own] = seen
    weights[own] -= RATE * slope / np.sqrt(seen)


def _train(weights: np.ndarray, class_of: np.ndarray):
    """One task's gradient steps: texts -> (row, n, weights) of every row it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.copy()
        squares = np.full(w.shape, 1.0, dtype=np.float32)
        seen = np.zeros(ROWS)
        for whole in batches:
            for batch in slices(whole, "text"):
                t = Tokens(batch.column(0))
                rows, target = features(t), class_of[t.ending]
                for lo in range(0, len(target), BATCH):
                    part, goal = rows[:, lo: lo + BATCH], target[lo: lo + BATCH]
                    error = _scores(w, part)
                    np.exp(error, out=error)
                    error /= error.sum(axis=1, keepdims=True)
                    error[np.arange(len(goal)), goal] -= 1.0
                    for r in part.astype(np.uint16):            # ROWS fit, and 16 bits are sorted by radix
                        order = np.argsort(r, kind="stable")
                        sorted_ = r[order]
                        start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                        own = sorted_[start]
                        _step(w, squares, own, np.add.reduceat(error.take(order, axis=0), start, axis=0))
                        seen[own] += np.diff(np.append(start, len(r)))
                    _step(w, squares, np.array([ROWS - 1]), error.sum(axis=0, keepdims=True))
                    seen[ROWS - 1] += len(goal)
        own = np.flatnonzero(seen)
        if len(own):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * w.shape[1], pa.int32()), pa.array(w[own].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(seen[own]), lists], names=["row", "n", "w"])

    return run


_SCORED = ("uid long, id long, held_out boolean, n_tokens long, head_known long, head_score double, gain double, rest array<long>")


def _score(weights: np.ndarray, class_of: np.ndarray, class_log: np.ndarray, head: np.ndarray, head_log: np.ndarray):
    """(id, held_out, text) -> what the task can say of it, and the hashes of words outside the head table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                t = Tokens(batch.column(2))
                rows, target, n = features(t), class_of[t.ending], batch.num_rows
                gain = np.empty(len(target))
                for lo in range(0, len(target), BATCH):
                    goal = target[lo: lo + BATCH]
                    gain[lo: lo + BATCH] = _log_shares(weights, rows[:, lo: lo + BATCH])[np.arange(len(goal)), goal]
                gain -= class_log[target]
                at = np.minimum(np.searchsorted(head, t.hash), max(len(head) - 1, 0))
                known = head[at] == t.hash if len(head) else np.zeros(len(target), dtype=bool)
                base = np.bincount(t.text[known], head_log[at[known]], n) if len(head) else np.zeros(n)
                rest = np.bincount(t.text[~known], minlength=n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid + np.arange(n)), batch.column(0), batch.column(1), pa.array(t.count.astype(np.int64)),
                    pa.array(t.count - rest, pa.int64()), pa.array(base.astype(np.float64)), pa.array(np.bincount(t.text, gain, n) / np.log(10)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32()), pa.array(as_long(t.hash[~known]))),
                ], names=["uid", "id", "held_out", "n_tokens", "head_known", "head_score", "gain", "rest"])
                uid += n

    return run


def score(docs: DataFrame, id_col: str, text_col: str, held_out: str, rounds: int = ROUNDS) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row; the model learns
    from the rows whose ``held_out`` column is false or null. Scores are base-10 logarithms."""
    spark = docs.sparkSession
    space = Workspace(spark, "maxent")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learn = rows.where("not held_out").select("text")
    # a task's rows hardly repeat, so they are dealt before they are summed: no table of them stands beside the worker
    counted = learn.mapInArrow(_count, "kind int, a long, b int, n long").repartition("kind", "a", "b")
    counted = space.save(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "counts")
    words = counted.where("kind = 0").select(F.col("a").alias("word"), F.col("b").alias("ending"), "n")
    by_ending = words.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()   # at most ENDINGS rows
    cells = counted.where("kind = 1").select("a", "n").toArrow()                                           # at most ENDINGS x CONTEXTS
    follows = np.zeros(ENDINGS * CONTEXTS)
    follows[cells["a"].to_numpy()] = cells["n"].to_numpy()
    class_of = cluster(follows.reshape(ENDINGS, CONTEXTS))

    n_ending, types_ending = by_ending["n"].to_numpy(), by_ending["types"].to_numpy()
    total, types = int(n_ending.sum()), int(types_ending.sum())
    scale = total + ALPHA * (types + 1)
    mass = np.full(CLASSES, ALPHA)                              # the event of an unseen word of the class
    np.add.at(mass, class_of[by_ending["ending"].to_numpy()], n_ending + ALPHA * types_ending)
    class_log = np.log(mass / scale)

    weights = np.zeros((ROWS, CLASSES), dtype=np.float32)
    weights[ROWS - 1] = class_log - np.log(np.exp(class_log).sum())
    for _ in range(rounds):
        mean = learn.mapInArrow(_train(weights, class_of), "row int, n double, w array<float>").groupBy("row").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("w")[i] * F.col("n")) for i in range(CLASSES)]).alias("w")).toArrow()
        if len(mean):                                           # at most ROWS rows
            sums = mean["w"].combine_chunks().flatten().to_numpy().reshape(-1, CLASSES)
            weights[mean["row"].to_numpy()] = sums / mean["n"].to_numpy()[:, None]

    # the count from which words are in the head, found on a histogram of counts (at most 64 x 32 levels)
    level = F.floor(F.log2("n") * 32)
    levels = sorted(map(tuple, words.groupBy(level.alias("level")).agg(F.count("*").alias("types")).collect()), reverse=True)
    inside = [x for x, size in zip(levels, np.cumsum([n for _, n in levels])) if size <= HEAD]
    least = inside[-1][0] if inside else levels[0][0] + 1 if levels else 0
    top = words.where(level >= least).select("word", "n").toArrow()
    head = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(head)
    head, n_head = head[order], top["n"].to_numpy()[order]
    scored = space.save(rows.mapInArrow(
        _score(weights, class_of, class_log, head, np.log10((n_head + ALPHA) / scale)), _SCORED), "scored")

    rare = scored.select("uid", F.explode("rest").alias("word")).join(words.select("word", "n"), "word", "left")
    seen = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("uid").agg(F.sum((seen > 0).cast("long")).alias("rest_known"), F.sum(F.log10((seen + F.lit(ALPHA)) / F.lit(scale))).alias("rest_score"))
    out = scored.drop("rest").join(rare, "uid", "left")
    base = F.col("head_score") + F.coalesce("rest_score", F.lit(0.0))
    return out.select("id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
