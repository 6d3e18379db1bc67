import random

import numpy as np

from tests.llm.conftest import words
from tests.llm.reference import words_of
from vectables.llm import passages
from vectables.llm.star import star_edges
from vectables.llm.store import Workspace


def found(docs, **kw):
    return [r.asDict() for r in passages.repeated_passages(docs, "doc_id", "text", **kw).collect()]


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc"], set()).update(range(r["start"], r["end"]))
    return out


def test_all_exact_repeats_are_found_and_rows_are_true(hard_docs, hard_rows):
    rows = found(hard_docs)
    by_id = {i: words_of(t) for i, t, *_ in hard_rows if i is not None}
    for r in rows:
        assert (r["to_doc"], r["to_start"]) < (r["doc"], r["start"])
        assert 50 <= r["end"] - r["start"] and r["end"] <= len(by_id[r["doc"]]) and r["to_end"] <= len(by_id[r["to_doc"]])
        assert r["same"] >= 0.8 * max(r["end"] - r["start"], r["to_end"] - r["to_start"])
    cover, first = covered(rows), {}
    for i in sorted(by_id):
        w = by_id[i]
        for a in range(len(w) - 50):
            key = tuple(w[a: a + 51])
            if first.setdefault(key, i) != i:
                assert set(range(a, a + 51)) <= cover[i]
    # documents without a repeat have no row
    assert not set(cover) & set(range(6, 30)) and not set(cover) & set(range(100, 112))


def test_fuzzy_passage(spark):
    rng = random.Random(8)
    shared = words(rng, 120).split()
    edited = list(shared)
    edited[30] = "changed"
    del edited[60:62]
    edited.insert(90, "added")
    rows = [(1, f"{words(rng, 50)} {' '.join(shared)} {words(rng, 60)}"), (2, f"{words(rng, 20)} {' '.join(edited)} {words(rng, 30)}"), (3, words(rng, 300))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(got) == 1 and (got[0]["doc"], got[0]["to_doc"]) == (2, 1)
    assert abs(got[0]["start"] - 20) <= 1 and abs(got[0]["end"] - 139) <= 1 and got[0]["same"] >= 117
    assert abs(got[0]["to_start"] - 50) <= 1 and abs(got[0]["to_end"] - 170) <= 1


def test_chains_against_all_pairs():
    """The best chain's score equals that of the quadratic recurrence."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 30))
        x, y = rng.integers(0, 60, n), rng.integers(0, 60, n)
        order = sorted(range(n), key=lambda i: (x[i], y[i]))
        best = {}
        for i in order:
            best[i] = 5.0 + max([0.0, *(best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i])])
        chain = passages.chains(x, y, gap=0.1)[0]
        score = 5.0 * len(chain) - 0.1 * sum((x[b] - x[a]) + (y[b] - y[a]) for a, b in zip(chain, chain[1:]))
        assert abs(score - max(best.values())) < 1e-9
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:]))
        assert sorted(i for c in passages.chains(x, y, gap=0.1) for i in c) == list(range(n))


def test_common_words():
    a = np.array([1, 2, 3, 4, 5], dtype=np.uint64)
    assert passages.common_words(a, a) == 5
    assert passages.common_words(a, np.array([2, 9, 4, 5, 1], dtype=np.uint64)) == 3
    assert passages.common_words(a, a[:0]) == 0


def test_cut_keeps_one_copy_and_leaves_others_alone(hard_docs, hard_rows):
    out = passages.cut_repeats(hard_docs, "doc_id", "text")
    assert out.columns == hard_docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    text = {i: t for i, t, *_ in hard_rows}
    assert got[1] == [text[1]] and not any(300 + i in got for i in range(4)) and not any(400 + i in got for i in range(2))
    for i in [*range(6, 30), *range(100, 112), 600, 601, 602, 603, 604, 608, 500]:
        assert got[i] == [text[i]]
    for i in range(501, 505):       # shared passage gone, the rest as it was
        w = text[i].split()
        assert got[i][0].split() == w[:40] + w[110:]
    assert len(got[None]) == 2


def test_empty_table(no_docs):
    assert found(no_docs) == []
    assert passages.cut_repeats(no_docs, "doc_id", "text").collect() == []


def test_star_pairs_every_row_of_a_hot_key_with_its_first(spark):
    """Keys that span several range partitions keep one pivot."""
    rows = [(key, doc, 10 * key) for key in range(5) for doc in range(400 if key < 3 else 2)]
    table = spark.createDataFrame(rows, "key long, doc long, pos long").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [tuple(r) for r in star_edges(table, ["doc", "pos"], Workspace(spark, "star-test")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sorted(edges) == sorted((doc, pos, 0, pos) for _, doc, pos in rows if doc)


def test_repeat_is_found_where_its_seeds_span_tasks(spark):
    rng = random.Random(21)
    shared = words(rng, 60)
    rows = [(i, f"{words(rng, 8)} {shared} {words(rng, 8)}") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cover = covered(found(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert all(set(range(8, 68)) <= cover.get(i, set()) for i in range(1, 300))


def test_repeat_is_found_where_its_parts_have_other_earlier_places(spark):
    """Every run of 50 words with an earlier place is covered, though its seeds first occur in many documents."""
    rng = random.Random(31)
    shared = words(rng, 80).split()
    # every piece of 16 words, and all but the last words of each run, occur earlier, in another document each
    rows = [(i, f"{words(rng, 40)} {' '.join(shared[a: a + 16])} {words(rng, 40)}") for i, a in enumerate(range(0, 65, 4))]
    rows += [(50 + i, f"{words(rng, 40)} {' '.join(shared[a: a + 45])} {words(rng, 40)}") for i, a in enumerate(range(0, 36, 5))]
    rows += [(100, f"{words(rng, 20)} {' '.join(shared)} {words(rng, 30)}"), (101, f"{words(rng, 33)} {' '.join(shared)} {words(rng, 12)}")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(range(33, 113)) <= covered(got).get(101, set())
    text = {i: words_of(t) for i, t in rows}
    for r in got:
        assert r["same"] < r["end"] - r["start"] or text[r["doc"]][r["start"]: r["end"]] == text[r["to_doc"]][r["to_start"]: r["to_end"]]


def test_copies_of_a_text_of_short_period_are_found(spark):
    rng = random.Random(41)
    line = words(rng, 7)
    rows = [(1, " ".join([line] * 60)), (2, f"{words(rng, 30)} {' '.join([line] * 50)} {words(rng, 30)}"), (3, words(rng, 200))]
    cover = covered(found(spark.createDataFrame(rows, "doc_id long, text string")))
    assert set(range(30, 380)) <= cover.get(2, set()) and 3 not in cover
    assert not cover.get(1, set()) & set(range(50))       # its first place stays


def _edited(rng, n, share):
    """A passage and a copy of it in which single words are replaced, left out or added until ``share`` is left."""
    fresh = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [fresh() for _ in range(n)]
    copy: list[str] = list(base)
    for at in rng.sample(range(n), round(n * (1 - share))):
        copy[at] = rng.choice([fresh(), "", f"{copy[at]} {fresh()}"])
    return base, " ".join(copy).split(), [fresh() for _ in range(230)]


def test_recall_of_fuzzy_passages_near_the_limit(spark):
    """Of passages with scattered edits, at least nine in ten are found over four fifths of their length."""
    rng = random.Random(7)
    rows, planted = [], {}
    for share in (0.82, 0.85, 0.9):
        for n in (60, 100):
            for _ in range(100):
                base, copy, rest = _edited(rng, n, share)
                at = len(rows)
                rows.append((at, " ".join(rest[:60] + base + rest[60:120])))
                rows.append((at + 1, " ".join(rest[120:160] + copy + rest[160:])))
                planted[at + 1] = (share, n, range(40, 40 + len(copy)))
    cover = {}
    for r in found(spark.createDataFrame(rows, "doc_id long, text string")):
        assert r["to_doc"] == r["doc"] - 1 and r["same"] >= 0.8 * max(r["end"] - r["start"], r["to_end"] - r["to_start"]) - 1e-9
        cover.setdefault(r["doc"], set()).update(range(r["start"], r["end"]))
    for share in (0.82, 0.85, 0.9):
        for n in (60, 100):
            ours = {d: p for d, (s, m, p) in planted.items() if (s, m) == (share, n)}
            hits = sum(len(cover.get(d, set()) & set(p)) >= 0.8 * len(p) for d, p in ours.items())
            assert hits >= 90, (share, n, hits)


def test_extension_over_left_out_words():
    a, b = np.arange(40, dtype=np.uint64), np.concatenate([np.arange(10), np.arange(12, 30), [99], np.arange(30, 40)]).astype(np.uint64)
    assert passages._reach(a, b) == (40, 39, 38)
    assert passages._reach(a, a + np.uint64(100)) == (0, 0, 0) and passages._reach(a[:0], a) == (0, 0, 0)
