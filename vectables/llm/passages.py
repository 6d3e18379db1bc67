"""Substring deduplication by collinear chaining.

Seeds are the minimisers of k-word runs: of every ``WINDOW`` runs in a row the one with the smallest hash, so
two texts that share ``k + WINDOW - 1`` words in a row share a seed; and of the other runs one in ``SAMPLE`` by its own hash, which
an edit beside it doesn't change. Each occurrence of a seed is paired
with its first one (``star``: one pivot per seed, one shuffle, large groups split). The matches of one pair of
documents are chained: a chain ascends in both texts, every match gains k, every word skipped on either side costs
``GAP``; with a cost linear in the skipped words the best predecessor is a prefix maximum, kept in a Fenwick
tree over the positions in the second text. A chain is then aligned on the texts: words between its matches by a longest
common subsequence, its ends by extension along the diagonal, and the parts of it that are long and
similar enough are the fuzzy passages. What is searched is linear in the text; nothing is sampled or capped.

A seed meets its first place only, so the matches of a passage whose parts have earlier places in different documents
scatter. Exact repeats do not depend on that: each run of ``min_words`` words that occurs twice meets its own first place.
Any such run holds a minimiser at one of its first ``WINDOW`` words and the run of ``min_words - WINDOW + 1`` words from there,
whose hash the seed carries along; so the seeds that occur again tell which places can hold one, and only around those whose longer
runs repeat too, at a place that no passage found so far covers, are the whole runs hashed.
Neighbouring runs that meet neighbouring places are one passage. Fuzzy passages that hold no exact run of that length
need two seeds that first occur in one document.

Defined cases: words are lower-cased A-Z; null and empty texts have no passage; a null id takes no part; rows
with one id and one text are one document; a passage that a text itself repeats is found too; where a text runs in a
period shorter than a seed's window, from ``min_words`` words after its first place on. A result
row's source is always an earlier place (smaller id, then smaller position), so cutting all results keeps one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectables.llm.star import star_edges
from vectables.llm.store import Workspace, free_name, rows_of
from vectables.llm.text import SLICE_BYTES, Texts, Words, as_long, kmers, lean, run_hashes, slices

K = 5                   # words in a seed
WINDOW = 12             # of so many seeds in a row, one is kept
SAMPLE = 6              # of all other seeds, one in so many is kept whatever stands around it
GAP = 0.05              # what a skipped word costs a chain
SPAN = 10               # words from a chain's first to its last that tell it from a phrase
PAD = 128               # words of either text around a chain that an alignment may reach
SHIFT = 4               # words that an extension may leave out at once
DROP = 6                # an extension ends when its score is this much below its best
MIN_WORDS = 50
MIN_SHARE = 0.8


def minimisers(hashes: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash in every ``window`` hashes in a row of one text."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1:])
    chosen = np.zeros(len(hashes), dtype=bool)
    for lo in range(0, len(at), 1 << 18):
        part = at[lo: lo + (1 << 18)]
        chosen[part + views[part].argmin(axis=1)] = True
    return np.flatnonzero(chosen)


def _seeds(k: int, length: int):
    """Places of seeds, keyed by their k words: the minimisers, with a hash of the ``length`` words from there (0 if
    there are fewer), and of all other places those whose own hash is divisible by ``SAMPLE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                words = Words(Texts(batch.column(1)))
                hashes, at = kmers(words, k)
                text = words.text[at]
                least = np.zeros(len(hashes), dtype=bool)
                least[minimisers(hashes, text)] = True
                own = np.flatnonzero(least | (hashes % np.uint64(SAMPLE) == 0))
                runs = np.zeros(len(own), dtype=np.uint64)
                full = least[own] & (at[own] + length <= words.bounds[text[own] + 1])
                runs[full] = np.maximum(run_hashes(words.hash, at[own[full]], length), np.uint64(1))
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(hashes[own])), batch.column(0).take(pa.array(text[own])),
                         pa.array(at[own] - words.bounds[text[own]]), pa.array(as_long(runs))], names=["key", "doc", "pos", "run"])

    return run


def chains(x: np.ndarray, y: np.ndarray, k: int = K, gap: float = GAP) -> list[list[int]]:
    """Best collinear chains of the matches (x, y), each match in one chain at most, best first."""
    order = np.lexsort((-y, x))
    xs, ys = x[order].tolist(), y[order].tolist()
    places = {v: i + 1 for i, v in enumerate(sorted(set(ys)))}
    size = len(places)
    tree = [(-1e18, -1)] * (size + 1)       # prefix maxima of score + gap * (x + y)
    score, parent = [0.0] * len(xs), [-1] * len(xs)
    waiting: list[tuple[int, tuple[float, int]]] = []
    last = None
    for i, (a, b) in enumerate(zip(xs, ys)):
        if a != last:                       # matches at one x do not follow each other
            for place, value in waiting:
                while place <= size:
                    if tree[place] < value:
                        tree[place] = value
                    place += place & -place
            waiting, last = [], a
        best, place = (-1e18, -1), places[b] - 1
        while place > 0:
            if tree[place] > best:
                best = tree[place]
            place &= place - 1
        gain = best[0] - gap * (a + b)
        score[i], parent[i] = (k + gain, best[1]) if gain > 0 else (k, -1)
        waiting.append((places[b], (score[i] + gap * (a + b), i)))
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(int(order[i]))
            i = parent[i]
        if chain:
            out.append(chain[::-1])
    return out


_CHAIN = "doc long, to_doc long, xs array<int>, ys array<int>"


def _chain(k: int, least: int):
    """Sorted matches (doc, to_doc, pos, to_pos) -> chains of at least ``least`` matches and ``SPAN`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chained(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            d, t, x, y = cols
            cuts = np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1
            edges = np.concatenate([[0], cuts, [len(d)]])
            docs, tos, xs, ys = [], [], [], []
            for i in np.flatnonzero(np.diff(edges) >= least).tolist():
                a, b = int(edges[i]), int(edges[i + 1])
                for chain in chains(x[a:b], y[a:b], k):
                    if len(chain) >= least and x[a + chain[-1]] - x[a + chain[0]] >= SPAN - k:
                        at = a + np.array(chain)
                        docs.append(d[a])
                        tos.append(t[a])
                        xs.append(x[at])
                        ys.append(y[at])
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(tos, pa.int64()), pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32()))],
                    names=["doc", "to_doc", "xs", "ys"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            d, t = cols[:2]
            whole = int(np.flatnonzero((d != d[-1]) | (t != t[-1]))[-1]) + 1 if (d[0], t[0]) != (d[-1], t[-1]) else 0
            if whole:
                yield from chained([c[:whole] for c in cols])
            rest = [c[whole:] for c in cols]
        if rest is not None:
            yield from chained(rest)

    return run


def _distinct(column: pa.Array) -> tuple[np.ndarray, Words]:
    """The words of the distinct texts of a column, and which of them each row has: the rows of one text follow each other."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), Words(Texts(coded.dictionary))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the source's text by the hashes of its words around the chain, from word ``first``."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES // 2):
            of, words = _distinct(batch.column(batch.schema.get_field_index("text")))
            ys = batch.column(batch.schema.get_field_index("ys"))
            flat, at = ys.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ys.value_lengths().to_numpy())])
            lo = np.maximum(flat[at[:-1]] - PAD, 0)
            hi = np.minimum(flat[at[1:] - 1] + K + PAD, words.count[of])
            n = np.maximum(hi - lo, 0)
            take = np.repeat(words.bounds[of] + lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(as_long(words.hash[take])))
            names = ["doc", "to_doc", "xs", "ys"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(lo.astype(np.int32)), out], names=[*names, "first", "source"])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for word in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == word)))
    return int(row[-1])


def _diagonal(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, words that match) of the best extension along the diagonal."""
    n = min(len(a), len(b))
    if not n or a[0] != b[0] and n < 2:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    over = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > DROP)
    total = total[: over[0]] if len(over) else total
    best = int(total.argmax()) if len(total) else 0
    return (best + 1, int(same[: best + 1].sum())) if len(total) and total[best] > 0 else (0, 0)


_SHIFTS = sorted(((i, j) for i in range(SHIFT + 1) for j in range(SHIFT + 1) if i or j), key=lambda s: (max(s), sum(s)))


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, words of b, words that match) of an extension along diagonals: where one ends, the next begins at the
    nearest two words in common, up to ``SHIFT`` words on."""
    x = y = same = 0
    left, right = a.tolist(), b.tolist()
    while True:
        n, equal = _diagonal(a[x:], b[y:])
        x, y, same = x + n, y + n, same + equal
        for i, j in _SHIFTS:
            if left[x + i: x + i + 2] == right[y + j: y + j + 2] and x + i + 2 <= len(left) and y + j + 2 <= len(right):
                x, y = x + i, y + j
                break
        else:
            return x, y, same


def _equal_runs(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The matches of a chain as (x, y, words), those in one that follow each other on a diagonal with equal words between."""
    joins = np.zeros(len(xs), dtype=bool)
    for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(xs - ys)) + 1).tolist(), len(xs)]):
        u, v = int(xs[lo]), int(ys[lo])
        n = int(xs[hi - 1]) + k - u
        other = np.concatenate([[0], np.cumsum(a[u: u + n] != b[v: v + n])])
        joins[lo + 1: hi] = other[xs[lo + 1: hi] - u] == other[xs[lo: hi - 1] - u]
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(xs)) - 1
    return list(zip(xs[first].tolist(), ys[first].tolist(), (xs[last] + k - xs[first]).tolist()))


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int, min_words: int, min_share: float) -> list[tuple[int, int, int, int, int]]:
    """Passages along a chain of k-word matches: (x from, x to, y from, y to, words that match).

    The chain is cut into stretches (its ends' extensions, its matches, what lies between them); of these,
    runs with at least ``min_share`` of their words in common are taken until none is long enough.
    """
    back_x, back_y, left_same = _reach(a[: xs[0]][::-1], b[: ys[0]][::-1])
    x, y = int(xs[0]) - back_x, int(ys[0]) - back_y
    part = [(x, y, left_same)]              # where each stretch starts, and its words in common
    x, y = int(xs[0]), int(ys[0])
    for u, v, n in _equal_runs(a, b, xs, ys, k):
        if u > x or v > y:
            if u < x or v < y:              # overlapping matches on two diagonals: the later one is left out
                continue
            part.append((x, y, common_words(a[x:u], b[y:v])))
            x, y = u, v
        grow = min(n, u + n - x, v + n - y) if (u + n - x) == (v + n - y) else 0
        if grow <= 0:
            continue
        part.append((u + n - grow, v + n - grow, grow))
        x, y = u + n, v + n
    on_x, on_y, right_same = _reach(a[x:], b[y:])
    part.append((x, y, right_same))
    part.append((x + on_x, y + on_y, 0))
    px, py, same = (np.array(c) for c in zip(*part))
    size = np.maximum(np.diff(px), np.diff(py))
    matched, words, far = (np.concatenate([[0], np.cumsum(c)]) for c in (same[:-1], size, np.diff(py)))
    out, todo = [], [(0, len(size))]
    while todo:
        lo, hi = todo.pop()
        if hi <= lo or px[hi] - px[lo] < min_words:
            continue
        # the run that gains most over a lower share reaches over weak stretches; if all of it is too weak, the share is raised
        for share in (min_share - 0.2, min_share - 0.1, min_share):
            sums = (matched - share * words)[lo: hi + 1]
            low = np.minimum.accumulate(sums)
            end = int((sums[1:] - low[:-1]).argmax()) + 1
            s = lo + int(sums[:end].argmin())
            e = lo + end
            if matched[e] - matched[s] >= min_share * (words[e] - words[s]) - 1e-9:
                break
        else:
            continue
        if px[e] - px[s] >= min_words and far[e] - far[s] >= min_words * min_share:
            out.append((int(px[s]), int(px[e]), int(py[s]), int(py[e]), int(matched[e] - matched[s])))
        if e > s:
            todo += [(lo, s), (e, hi)]
    return out


_FOUND = "doc long, text_hash long, start long, end long, to_doc long, to_start long, to_end long, same long"


def _aligned(k: int, min_words: int, min_share: float):
    names = ["doc", "text_hash", "start", "end", "to_doc", "to_start", "to_end", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                of, words = _distinct(col["text"])
                lists = {}
                for n in ("xs", "ys", "source"):
                    lists[n] = col[n].flatten().to_numpy(), np.concatenate([[0], np.cumsum(col[n].value_lengths().to_numpy())])
                docs, tos, marks, first = (col[n].to_numpy() for n in ("doc", "to_doc", "text_hash", "first"))
                out = []
                for i in range(batch.num_rows):
                    xs, ys, b = (v[at[i]: at[i + 1]] for v, at in (lists["xs"], lists["ys"], lists["source"]))
                    lo = max(int(xs[0]) - PAD, 0)
                    hi = min(int(xs[-1]) + k + PAD, int(words.count[of[i]]))
                    base = words.bounds[of[i]]
                    a, b = words.hash[base + lo: base + hi], b.view(np.uint64)
                    u, v = xs - lo, ys - first[i]
                    ok = (u + k <= len(a)) & (v + k <= len(b))
                    if not ok.all() or any((a[u + j] != b[v + j]).any() for j in range(k)):
                        continue            # another text under this id
                    for x0, x1, y0, y1, same in align(a, b, u, v, k, min_words, min_share):
                        x0, x1, y0, y1 = x0 + lo, x1 + lo, y0 + int(first[i]), y1 + int(first[i])
                        out.append((docs[i], marks[i], x0, x1, tos[i], y0, y1, same))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def _runs(length: int):
    """(id, text, mark, places) -> every run of ``length`` words that begins up to ``WINDOW - 1`` words before a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):       # up to a row a word goes out
                words = Words(Texts(batch.column(1)))
                places = batch.column(3)
                text = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
                at = words.bounds[text] + places.flatten().to_numpy()
                begins = np.zeros(len(words.hash) + 1, dtype=bool)
                for back in range(WINDOW):
                    own = at - back
                    begins[own[(own >= words.bounds[text]) & (own + length <= words.bounds[text + 1])]] = True
                at = np.flatnonzero(begins)
                if len(at):
                    text = words.text[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(run_hashes(words.hash, at, length))), batch.column(0).take(pa.array(text)),
                         pa.array(at - words.bounds[text]), batch.column(2).take(pa.array(text))], names=["key", "doc", "pos", "mark"])

    return run


def exact_passages(texts: DataFrame, seeds: DataFrame, known: DataFrame, min_words: int, space: Workspace) -> DataFrame:
    """Repeats of runs of ``min_words`` words in ``texts(id, text)`` that have an earlier place, as rows of ``_FOUND``: of all but those
    whose later places all lie in ``known(doc, low, high)``. ``seeds(key, doc, pos)`` are the places of seeds that occur again, keyed by
    the ``min_words - WINDOW + 1`` words from there."""
    pairs = star_edges(seeds.select("key", "doc", "pos", F.col("key").alias("run")), ["doc", "pos", "run"], space, "long-stars").where(
        "doc <> to_doc or pos <> to_pos")
    # all runs around a place lie inside a passage that is known already
    inside = (pairs["doc"] == known["doc"]) & (F.col("low") <= F.col("pos") - (WINDOW - 1)) & (F.col("pos") + min_words <= F.col("high"))
    open_keys = space.save(pairs.join(known, inside, "left_anti").select("run").distinct(), "open")
    rest = rows_of(pairs, open_keys, "run")
    places = space.save(rest.select(F.col("doc").alias("id"), "pos").union(rest.select("to_doc", "to_pos")).groupBy("id").agg(
        F.collect_set("pos").alias("places")), "places")
    space.drop("long-stars")
    held = rows_of(texts, places.select("id"), "id").join(places, "id").select(
        "id", "text", F.xxhash64("text").alias("mark"), "places")
    runs = held.mapInArrow(lean(_runs(min_words)), "key long, doc long, pos long, mark long")
    same = star_edges(runs, ["doc", "pos", "mark"], space, "run-stars").where(
        f"doc <> to_doc or pos - to_pos >= {min_words}").withColumn("ahead", F.col("pos") - F.col("to_pos"))
    line = ["doc", "mark", "to_doc", "ahead"]
    rank = F.dense_rank().over(Window.partitionBy(*line).orderBy("pos"))
    end = F.max("pos") + min_words
    found = same.withColumn("line", F.col("pos") - rank).groupBy(*line, "line").agg(F.min("pos").alias("start"), end.alias("end"))
    return space.save(found.select(
        "doc", F.col("mark").alias("text_hash"), "start", "end", "to_doc", (F.col("start") - F.col("ahead")).alias("to_start"),
        (F.col("end") - F.col("ahead")).alias("to_end"), (F.col("end") - F.col("start")).alias("same")), "exact")


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc, text_hash, start, end, to_doc, to_start, to_end, same)``: words start..end-1 of a document repeat
    those of an earlier place; ``same`` of them match. ``min_words`` is at least K + WINDOW - 1.
    """
    if min_words < K + WINDOW - 1:
        raise ValueError(f"min_words must be at least {K + WINDOW - 1}")
    space = Workspace(docs.sparkSession, "passages")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        "id is not null and text is not null")
    seeds = texts.mapInArrow(lean(_seeds(K, min_words - WINDOW + 1)), "key long, doc long, pos long, run long")
    matches = star_edges(seeds, ["doc", "pos", "run"], space).where("doc <> to_doc or pos <> to_pos")
    found = space.save(
        matches.where(f"doc <> to_doc or pos - to_pos >= {min_words}").select("doc", "to_doc", "pos", "to_pos").repartition("doc", "to_doc").sortWithinPartitions(
            "doc", "to_doc", "pos", "to_pos").mapInArrow(lean(_chain(K, 2)), _CHAIN), "chains")
    again = matches.select(F.col("run").alias("key"), "doc", "pos").union(matches.select("to_run", "to_doc", "to_pos")).where("key <> 0")
    long_seeds = space.save(again.distinct(), "long-seeds")
    space.drop("stars")
    ends = space.save(found.select(F.col("doc").alias("id")).union(found.select("to_doc")).distinct(), "ends")
    chained = rows_of(texts, ends, "id")
    sources = found.join(chained.withColumnRenamed("id", "to_doc"), "to_doc").select("doc", "to_doc", "xs", "ys", "text").mapInArrow(
        lean(_windows), _CHAIN + ", first int, source array<long>")
    both = sources.join(chained.withColumnRenamed("id", "doc"), "doc").select(
        "doc", "to_doc", "xs", "ys", "first", "source", "text", F.xxhash64("text").alias("text_hash"))
    fuzzy = space.save(both.mapInArrow(lean(_aligned(K, min_words, min_share)), _FOUND).distinct(), "passages")
    several = space.save(texts.select("id", F.xxhash64("text").alias("mark")).groupBy("id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where(
        "a <> b").select("id"), "several")     # ids of several texts: what is known of one says nothing of the other
    known = rows_of(fuzzy.withColumnRenamed("doc", "id"), several, "id", others=True).select(
        F.col("id").alias("doc"), F.col("start").alias("low"), F.col("end").alias("high"))
    exact = exact_passages(texts, long_seeds, known, min_words, space)
    wider = fuzzy.select("doc", "text_hash", F.col("start").alias("low"), F.col("end").alias("high"))
    inside = (exact["doc"] == wider["doc"]) & (exact["text_hash"] == wider["text_hash"]) & (F.col("low") <= F.col("start")) & (F.col("end") <= F.col("high"))
    return fuzzy.union(exact.join(wider, inside, "left_anti"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row columns..., text, ranges) -> the same columns with the ranges' words cut out of the text."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES // 2):
            names = batch.schema.names
            text, ranges = batch.column(names.index("text")), batch.column(names.index("ranges")).to_pylist()
            words = Words(Texts(text))
            raw = words.texts.data.tobytes()
            out = []
            for i, cuts in enumerate(ranges):
                base, at, end = words.bounds[i], int(words.texts.offsets[i]), int(words.texts.offsets[i + 1])
                parts = []
                for lo, hi in _merged(cuts or []):
                    parts.append(raw[at: int(words.start[base + lo])])
                    at = int(words.start[base + hi]) if hi < words.count[i] else end
                parts.append(raw[at:end])
                out.append(b"".join(parts).decode())
            cols = [pa.array(out, pa.string()) if n == "text" else batch.column(j) for j, n in enumerate(names) if n != "ranges"]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in names if n != "ranges"])


def _merged(cuts: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((c["start"], c["end"]) for c in cuts):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut_repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the later places of repeated passages; a document that holds nothing else goes.

    Documents without such a passage, null ids and null texts stay as they are. All columns are kept.
    """
    space = Workspace(docs.sparkSession, "cut-repeats")
    key, cuts = (free_name(docs.columns, n) for n in ("passage_key", "passage_cuts"))
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))))
    found = repeated_passages(docs, id_col, text_col, min_words, min_share)
    ranges = space.save(found.groupBy(F.xxhash64("doc", "text_hash").alias(key)).agg(
        F.collect_set(F.struct("start", "end")).alias(cuts)), "ranges")
    ids = ranges.select(key)
    hit = rows_of(keyed, ids, key).join(ranges, key).select(
        F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(cuts).alias("ranges"))
    cut = hit.mapInArrow(lean(_without), f"row {hit.schema['row'].dataType.simpleString()}, text string").where(
        F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    rebuilt = cut.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
    return rows_of(keyed, ids, key, others=True).select(*docs.columns).union(rebuilt)
