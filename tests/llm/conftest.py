import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, part int, fp string, row string, rows string, n string, label string, ranges string, text_key string, mix_ranges string, passage_cuts string"


def words(rng: random.Random, n: int, lang: str = "a") -> str:
    syllables = {"a": "th er on an re he in ed nd ha at en es of or".split(), "b": "eau ou ai ent le re qu ux oi ais".split()}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Documents with nulls in every column, empty, blank, short and long texts, copies, near copies, shared
    passages and repeated rows: (doc_id, text, lang, source)."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 300)) for _ in range(30)]
    rows = [(i, t, "a", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, words(rng, 120, "b"), "b", f"s{i % 3}") for i in range(12)]
    near = base[0].split()
    for i in range(8):                      # near copies, some of them at the limit
        edited = list(near)
        for _ in range(1 + i // 2):
            edited[rng.randrange(len(edited))] = f"edit{rng.randrange(99)}"
        rows.append((200 + i, " ".join(edited), "a", "s0"))
    rows += [(300 + i, base[1], "a", None) for i in range(4)]                       # exact copies
    rows += [(400 + i, base[2].upper(), "a", "s1") for i in range(2)]               # the same words in capitals
    shared = words(rng, 70)
    rows += [(500 + i, f"{words(rng, 40)} {shared} {words(rng, 35)}", "a", "s2") for i in range(5)]
    rows += [(600, "", "a", "s0"), (601, None, "a", "s0"), (602, " \t\n ", None, None), (603, "one", "a", "s1"), (604, "one two", "b", "s1"),
             (605, "One  TWO", "a", "s1"), (606, "one two three", "a", None), (607, "12 34 !!", None, "s2"), (608, words(rng, 6000), "a", "s0")]
    rows += [(None, base[3], None, None), (None, None, None, None), (609, base[4], None, "é"), (700, base[5], "a", "s0"), (700, base[5], "a", "s0")]
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    full = [(i, t, g, s, None if t is None else len(t), 7, "k", 1, "f", "r", "q", "n", "l", "g", "x", "m", "p") for i, t, g, s in hard_rows]
    return spark.createDataFrame(full, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
