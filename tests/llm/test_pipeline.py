import random

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.reference import jaccard, shingle_set, words_of
from vectables.llm import mixing, stages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_rejects_texts_without_letters_only(hard_docs, hard_rows):
    out = stages.keep_known_languages(hard_docs)
    assert out.columns == hard_docs.columns
    gone = [i for i, t, *_ in hard_rows if not any(c.isalpha() for c in (t or ""))]
    want = sorted(str((i, t)) for i, t, *_ in hard_rows if any(c.isalpha() for c in (t or "")))
    got = sorted(str((r["doc_id"], r["text"])) for r in out.collect())
    assert got == want and len(gone) == 5


def test_one_of_each_group_stays(hard_docs, hard_rows):
    out = stages.keep_one_of_each_group(hard_docs)
    assert out.columns == hard_docs.columns
    kept = [shingle_set(r["text"], 5) for r in out.collect()]
    assert all(jaccard(a, b) * 100 < 80 for i, a in enumerate(kept) for b in kept[:i] if a and b)
    some = [shingle_set(t, 5) for _, t, *_ in hard_rows if words_of(t)]
    clean = sum(all(jaccard(a, b) * 100 < 80 for j, b in enumerate(some) if j != i) for i, a in enumerate(some))
    assert sum(bool(s) for s in kept) >= clean
    for s in some:          # whatever went is near something that stayed, or near something near it
        assert any(jaccard(s, t) * 100 >= 60 for t in kept if t)
    assert sum(not s for s in kept) == sum(not words_of(t) for _, t, *_ in hard_rows)


def test_mix_makes_copies_and_cuts(hard_docs, hard_rows):
    out = stages.mix_sources(hard_docs)
    assert out.columns == hard_docs.columns
    rows = out.collect()
    sizes = {}
    for _, t, _, s in hard_rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    order = sorted(s for s in sizes if s is not None) + [None]
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])))
    for s in order:
        assert abs(sum(len(words_of(r["text"])) for r in rows if r["source"] == s) - want[s]) <= mixing.BLOCK
    texts = {}
    for i, t, *_ in hard_rows:
        texts.setdefault(i, []).append(t)
    for r in rows:
        assert all(line in " ".join(filter(None, texts[r["doc_id"]])) for line in [r["text"].split("\n")[0]]) and r["n_chars"] == len(r["text"])


def test_all_stages_on_hard_rows_and_on_none(spark, hard_docs, no_docs, tmp_path):
    for name, docs in (("hard", hard_docs.select(*COLUMNS)), ("none", no_docs.select(*COLUMNS))):
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, "").write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == COLUMNS
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
        assert (docs.count() == 0) == (name == "none")


def test_run_removes_planted_copies_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    clean = [(i, words(rng, rng.randint(80, 200), "ab"[i % 2]), "ab"[i % 2], "s") for i in range(40)]
    copies = [(100 + i, clean[i][1], "a", "s") for i in range(0, 10, 2)]
    rows = [(i, t, g, s, len(t)) for i, t, g, s in clean + copies]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert {i for i, *_ in clean[1::2]} <= ids
    for i in range(0, 10, 2):
        assert len({i, 100 + i} & ids) == 1
