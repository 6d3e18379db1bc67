"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of what independent sources say of it: hashed letter trigrams of the
whole text (naive Bayes), the language that the markup declares, the suffix of the address, and a prior of
the host. One more hypothesis, ``und``, is that the text is in none of them: its trigrams are uniform. The
reliability of declarations and suffixes, and the host priors, are grouped aggregations of the text's posteriors
over all rows: a host's counts are smoothed by its domain's, those by all rows' (``SMOOTH`` rows'
worth each), and a row's own share is taken out of its host's counts.

The trigram model is fitted on a bounded sample of labelled rows: the ``SAMPLE`` texts per language with the smallest hashes.
The text's weight is capped at ``WEIGHT`` trigrams, since neighbouring trigrams are not independent.

Defined cases: null and empty texts have no trigrams, so only the other evidence speaks, and they are not
accepted; a null declaration, suffix or host says nothing; null ids are kept; repeated rows are judged alike; no rows
give no result; with no labelled rows every row is ``und`` and not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vectables.llm.store import Workspace
from vectables.llm.text import SLICE_BYTES, Texts, lean, slices

HEAVY = 4_096           # hosts with more than this share of all rows are broadcast: at most as many
BUCKETS = 1 << 16
SAMPLE = 2_000          # labelled rows per language that the trigram model is fitted on
WEIGHT = 200            # trigrams that a text counts as, at most
SMOOTH = 10.0           # rows' worth of the parent's distribution in a host's or domain's counts
LEAST = 0.5             # posterior from which a language is accepted
UNKNOWN = 0.01          # prior of ``und``

_FOLD = np.full(256, 0x20, dtype=np.uint8)      # A-Z to a-z, bytes beyond ASCII as they are, all else blank
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams around a letter byte, in order, and the bounds of each text's part."""
    data, n = _FOLD[texts.data], len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    before, after = np.roll(data, 1), np.roll(data, -1)
    starts = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    before[starts], after[starts - 1] = 0x20, 0x20
    at = np.flatnonzero(data != 0x20)
    code = (before[at].astype(np.uint64) << np.uint64(16)) | (data[at].astype(np.uint64) << np.uint64(8)) | after[at]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64), np.searchsorted(at, texts.offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, bucket, count), summed over the task."""
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES // 2):
            bucket, bounds = trigrams(Texts(batch.column(1)))
            labels = batch.column(0).to_pylist()
            for label in set(labels):
                part = [bucket[bounds[i]: bounds[i + 1]] for i, x in enumerate(labels) if x == label]
                sums[label] = sums.get(label, 0) + np.bincount(np.concatenate(part), minlength=BUCKETS)
    for label, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["label", "bucket", "n"])


class Model:
    """Log probabilities of trigram buckets by language; the last row is ``und``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        known = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else np.zeros((0, BUCKETS))
        self.log = np.vstack([known, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float32)


def fit(labelled: DataFrame, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """The trigram model of a bounded sample: the ``sample`` texts per label with the smallest hashes.

    The hash that cuts a label's sample is found on hashes alone, so no text outside the samples is shuffled; equal
    texts of one label count once.
    """
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).dropna()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("hash"))
    cuts = rows.select("label", "hash").distinct().withColumn("rank", rank).where(f"rank <= {sample}").groupBy("label").agg(F.max("hash").alias("cut"))
    cut = rows.sparkSession.createDataFrame([tuple(r) for r in cuts.collect()], "label string, cut long")     # one row per language
    drawn = rows.join(F.broadcast(cut), "label").where("hash <= cut").dropDuplicates(["label", "hash"]).select("label", "text")
    counted = drawn.mapInArrow(lean(_count), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels = counted["label"].to_numpy(zero_copy_only=False) if len(counted) else np.zeros(0, dtype=object)
    languages = sorted(set(labels))
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        counts[np.searchsorted(languages, labels.astype(str)), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return Model(languages, counts)


def _score(model: Model, passed: int):
    """(..., text) -> (..., trigrams, log likelihood per hypothesis, weighted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                bucket, bounds = trigrams(Texts(batch.column(passed)))
                n = np.diff(bounds)
                weight = np.minimum(1.0, WEIGHT / np.maximum(n, 1))
                sums = np.empty((len(n), len(model.log)))
                for i, row in enumerate(model.log):
                    total = np.concatenate([[0.0], np.cumsum(row[bucket], dtype=np.float64)])
                    sums[:, i] = (total[bounds[1:]] - total[bounds[:-1]]) * weight
                logs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(model.log), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(n.astype(np.int64)), logs],
                                                 names=[*batch.schema.names[:passed], "trigrams", "logs"])

    return run


def _softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.when(a.isNull(), out).otherwise(F.zip_with(out, a, lambda x, y: x + y))
    return out


def identify(items: DataFrame, model: Model, space: Workspace) -> DataFrame:
    """``items(..., host, domain, declared, suffix, text)`` -> the leading columns with the decision.

    Adds ``text_lang`` (by text alone), ``lang``, ``posterior`` and ``accepted``.
    """
    names = [*model.languages, "und"]
    size = len(names)
    lead = items.columns[:-1]
    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes[:-1])
    scored = space.save(items.mapInArrow(lean(_score(model, len(lead))), f"{schema}, trigrams long, logs array<double>"), "scored")
    prior = [(1 - UNKNOWN) / max(size - 1, 1)] * (size - 1) + [UNKNOWN if size > 1 else 1.0]
    log_prior = F.array(*[F.lit(float(np.log(p))) for p in prior])
    scored = scored.withColumn("own", _softmax(_add(F.col("logs"), log_prior)))

    def sums(*by: str) -> DataFrame:
        """Summed text posteriors of the rows with text, by group, and the number of all its ``rows``."""
        some = scored
        for c in by:
            some = some.where(F.col(c).isNotNull())
        posterior = F.when(F.col("trigrams") > 0, F.col("own"))
        grouped = some.groupBy(*by).agg(F.array(*[F.coalesce(F.sum(posterior[i]), F.lit(0.0)) for i in range(size)]).alias("n"),
                                        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("trigrams") > 0).alias("texts"))
        return grouped.where("texts > 0").drop("texts") if by else grouped

    whole = sums().first()
    every, rows = whole["n"] if size > 1 else [1.0], whole["rows"]
    total = sum(every)
    overall = [(n + SMOOTH * p) / (total + SMOOTH) for n, p in zip(every, prior)]
    base = F.array(*[F.lit(float(p)) for p in overall])

    def smoothed(counts: Column, parent: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda x, p: (x + F.lit(SMOOTH) * p) / (n + F.lit(SMOOTH)))

    domains = sums("domain").select("domain", smoothed(F.col("n"), base).alias("domain_prior"))
    hosts = sums("domain", "host").join(domains, "domain").select("domain", "host", F.struct("n", "domain_prior").alias("at"), "rows")
    hosts = space.save(hosts, "hosts")
    # at most HEAVY hosts hold more than that share of the rows: they travel, and no other can weigh on one task
    heavy = hosts.where(F.col("rows") * HEAVY > rows).select("domain", "host", F.col("at").alias("heavy"))
    light = hosts.where(F.col("rows") * HEAVY <= rows).select("domain", "host", F.lit(0).cast("long").alias("apart"), F.col("at").alias("light"))
    done = F.col("heavy").isNotNull() | F.col("host").isNull() | F.col("domain").isNull()

    def with_host(table: DataFrame) -> DataFrame:
        """``table`` with ``host_n`` and ``domain_prior``; rows that no light host can match are dealt evenly."""
        met = table.join(F.broadcast(heavy), ["domain", "host"], "left").withColumn(
            "apart", F.when(done, F.monotonically_increasing_id() + 1).otherwise(0)).join(light, ["domain", "host", "apart"], "left")
        found = F.coalesce("heavy", "light")
        return met.withColumns({"host_n": found["n"], "domain_prior": found["domain_prior"]}).drop("heavy", "light", "apart")

    def evidence(col: str) -> DataFrame:
        """log P(value | language) by the text posteriors, smoothed by the value's share of all rows."""
        table = sums(col)
        row = F.col("n")
        share = F.aggregate(row, F.lit(0.0), lambda a, x: a + x) / F.lit(max(total, 1.0))
        return table.select(col, F.zip_with(row, F.array(*[F.lit(float(n)) for n in every]), lambda x, n: F.log(
            (x + F.lit(SMOOTH) * share) / (n + F.lit(SMOOTH)))).alias(f"{col}_log"))

    out = with_host(scored).join(evidence("declared"), "declared", "left").join(evidence("suffix"), "suffix", "left")
    with_text = F.col("trigrams") > 0
    others = F.zip_with("host_n", "own", lambda n, p: F.greatest(F.lit(0.0), n - F.when(with_text, p).otherwise(0.0)))
    host_prior = F.coalesce(smoothed(others, F.col("domain_prior")), base)
    fused = _softmax(_add(F.col("logs"), F.transform(host_prior, lambda p: F.log(p)), F.col("declared_log"), F.col("suffix_log")))
    label = F.array(*[F.lit(x) for x in names])
    best = out.withColumn("fused", fused).withColumn("posterior", F.array_max("fused"))
    return best.select(
        *lead, label[F.array_position("own", F.array_max("own")).cast("int") - 1].alias("text_lang"),
        label[F.array_position("fused", F.col("posterior")).cast("int") - 1].alias("found"), "posterior", "trigrams",
    ).withColumn("accepted", (F.col("found") != "und") & (F.col("posterior") >= LEAST) & (F.col("trigrams") > 0)).withColumnRenamed("found", "lang")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and character references."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w{1,12};", " ")


def page_items(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Items of web pages: host and its domain, language of the ``html`` tag, address suffix, visible text."""
    host = F.lower(F.nullif(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#:]*)", 1), F.lit("")))
    declared = F.nullif(F.lower(F.regexp_extract(F.col(html_col), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("id"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), declared.alias("declared"), F.substring_index(host, ".", -1).alias("suffix"),
        visible_text(F.col(html_col)).alias("text"))


def document_items(docs: DataFrame, id_col: str, source_col: str, lang_col: str, text_col: str) -> DataFrame:
    """Items of plain documents: the source stands for the host, the ``lang`` column declares; no address."""
    source = F.col(source_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), source.alias("host"), F.when(source.isNotNull(), F.lit("documents")).alias("domain"),
                       F.col(lang_col).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"),
                       F.col(text_col).cast("string").alias("text"))
