"""Operators as pipeline stages: documents in, documents (or, at the end, sequences) out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectables.llm import langid, mixing, packing, parity, passages
from vectables.llm.store import Workspace, free_name, rows_of
from vectables.llm.text import SLICE_BYTES, Texts, Words, lean, slices


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of all columns, and its name. Equal rows have equal keys and are treated alike."""
    key = free_name(docs.columns, "row_key")
    return docs.withColumn(key, F.xxhash64(*docs.columns)), key


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """Drops documents whose language is not accepted; all columns stay as they are.

    The model is fitted on a sample of the stage's own input. Rows are decided one by one; documents without any letter
    are rejected, whatever their ``lang`` says.
    """
    space = Workspace(docs.sparkSession, "keep-languages")
    keyed, key = _keyed(docs)
    found = langid.identify(langid.document_items(keyed, key, "source", "lang", "text"), langid.fit(docs, "text", "lang"), space)
    rejected = space.save(found.where("not accepted").select(F.col("id").alias(key)).distinct(), "rejected")
    return rows_of(keyed, rejected, key, others=True).select(*docs.columns)


def keep_one_of_each_group(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """One document of each group of near copies stays (of ``k``-word shingles, Jaccard of num/den or more).

    It is the one with the smallest key; of equal rows one stays. Documents without words are left alone.
    """
    space = Workspace(docs.sparkSession, "one-of-each")
    keyed, key = _keyed(docs)
    found = parity.jaccard_components(keyed, key, "text", k, num, den)
    found = space.save(found.where("n_shingles > 0").groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("n")), "found")
    gone = space.save(found.where("id <> component").select(F.col("id").alias(key)), "gone")
    equal = space.save(found.where("id = component and n > 1").select(F.col("id").alias(key)), "equal")
    rest = rows_of(keyed, gone, key, others=True)
    one = rows_of(rest, equal, key).dropDuplicates([key])
    return rows_of(rest, equal, key, others=True).union(one).select(*docs.columns)


def cut_repeated_passages(docs: DataFrame) -> DataFrame:
    """Cuts passages that repeat an earlier place; ``n_chars`` follows the text."""
    out = passages.cut_repeats(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, ranges) -> (row, text), a row for each pass over a source that takes any of the text.

    A pass that takes all words gives the text as it is, another the words that it takes, cut out of the text
    and joined by line breaks.
    """
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES // 2):
            words = Words(Texts(batch.column(1)), lower=False)
            raw = words.texts.data.tobytes()
            rows, out = [], []
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                base, n = words.bounds[i], int(words.count[i])
                turns: dict[int, list[tuple[int, int]]] = {}
                for r in ranges or []:
                    turns.setdefault(r["turn"], []).append((r["lo"], r["hi"]))
                for parts in turns.values():
                    joined: list[tuple[int, int]] = []
                    for lo, hi in sorted(parts):
                        if joined and lo <= joined[-1][1]:
                            joined[-1] = (joined[-1][0], max(hi, joined[-1][1]))
                        else:
                            joined.append((lo, hi))
                    if joined == [(0, n)]:
                        text = raw[int(words.texts.offsets[i]): int(words.texts.offsets[i + 1])]
                    else:
                        text = b"\n".join(raw[int(words.start[base + lo]): int(words.end[base + hi - 1])] for lo, hi in joined)
                    rows.append(i)
                    out.append(text.decode())
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(out, pa.string())], names=["row", "text"])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = mixing.WEIGHTS) -> DataFrame:
    """The mix as documents: each pass over a source is a copy of what it takes of a document.

    A document that the mix takes twice is in the result twice, one that it leaves out is not.
    """
    keyed, key = _keyed(docs)
    parts = free_name(docs.columns, "mix_ranges")
    mixed = mixing.mix(keyed, key, "source", "text", weights=weights).where("taken > 0").select(F.col("id").alias(key), F.col("ranges").alias(parts))
    taken = keyed.dropDuplicates([key]).join(mixed.hint("merge"), key).select(
        F.struct(*docs.columns).alias("row"), F.col("text"), F.col(parts).alias("ranges"))
    made = taken.mapInArrow(lean(_copies), f"row {taken.schema['row'].dataType.simpleString()}, text string")
    texts = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*(texts[c].alias(c) if c in texts else F.col("row")[c].alias(c) for c in docs.columns))


def pack_sequences(docs: DataFrame) -> DataFrame:
    """Token sequences of the documents: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    return packing.pack(packing.pieces(docs, "doc_id", "text")).withColumnRenamed("id", "doc_id")
