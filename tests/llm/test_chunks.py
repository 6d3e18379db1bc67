import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vectables.llm import chunks


def expected(rows):
    """Brute force: (id, keep_id, size, sha, kept) with multiplicity; ``kept`` on one of the rows that repeat the id that stays."""
    texts = [(i, t or "") for i, t, *_ in rows]
    size = Counter(t for _, t in texts)
    last = {}
    for i, t in texts:
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    out, done = Counter(), set()
    for i, t in texts:
        kept = (-1 if i is None else i) == last[t] and t not in done
        if kept:
            done.add(t)
        out[(i, None if last[t] < 0 else last[t], size[t], kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def got(df):
    return Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_equals_brute_force(hard_docs, hard_rows):
    assert got(chunks.exact_duplicates(hard_docs, "doc_id", "text")) == expected(hard_rows)


def test_colliding_identifiers_are_widened(hard_docs, hard_rows, monkeypatch):
    widths = []

    def weak(chunk, width):
        widths.append(width)
        return [F.length(chunk).cast("long") if seed < 3 else F.xxhash64(F.lit(seed), chunk) for seed in range(width)]

    monkeypatch.setattr(chunks, "hashes", weak)
    assert got(chunks.exact_duplicates(hard_docs, "doc_id", "text")) == expected(hard_rows)
    assert max(widths) == 4


def test_empty_table_and_normal_form(no_docs, hard_docs, hard_rows):
    assert chunks.exact_duplicates(no_docs, "doc_id", "text").count() == 0
    folded = [(i, None if t is None else t.upper(), *rest) for i, t, *rest in hard_rows]
    have = chunks.exact_duplicates(hard_docs, "doc_id", "text", F.upper)
    assert got(have) == expected(folded)


def test_chunks_rebuild_the_text_and_meet_again_after_an_insertion(spark):
    import random

    rng = random.Random(3)
    base = " ".join("".join(rng.choice("aeimnrstuy") for _ in range(rng.randint(1, 9))) for _ in range(6000))
    rows = [(0, base), (1, "one more word " + base[:9000] + " and some more " + base[9000:]), (2, "x" * 30_000), (3, "é\n" * 5000), (4, "")]
    made = {r.id: r.c for r in spark.createDataFrame(rows, "id long, text string").select("id", chunks.chunks(F.col("text")).alias("c")).collect()}
    assert all("".join(made[i]) == t for i, t in rows)
    assert all(len(c) <= chunks.MOST for cs in made.values() for c in cs)
    assert len(set(made[0]) & set(made[1])) > 0.8 * len(made[0])


def test_hot_group_is_salted(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 40)).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = chunks.exact_duplicates(rows, "doc_id", "text")
    hot = found.where("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (1334, 3999, 1334, 1)


@pytest.mark.parametrize("repeat", [1, 400])
def test_a_row_that_repeats_everything(spark, repeat):
    df = spark.createDataFrame([(5, "a b c")] * repeat, "doc_id long, text string")
    rows = chunks.exact_duplicates(df, "doc_id", "text").collect()
    assert len(rows) == repeat and sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {repeat}
