"""Probe-log and run-log analytics (OP-56..OP-66).

The source tool keeps a little state per uri (or per drill and uri) and updates it row by row.
Here that state is rebuilt from running counts computed by :func:`running_sums`, which never
puts a whole key into one task, and from partial aggregations keyed by "island" numbers:

* ``g`` = number of ok rows up to and including a row. Failures sharing ``g`` form one failure
  run; its recovery is the ok row whose own ordinal among oks is ``g + 1`` (an equi-join).
* for the debounce, slices of time are summarised and the summaries folded per key.

FIXED VALUES: histogram range 1 .. 3,600,000 ms with 2 significant digits (sub-buckets of 128
below a shift of ``floor(log2 v) - 7``); probe timeout 50 ms; summary quantiles 0.5, 0.95, 0.99;
summary text ``[min: {min}ms, p50: {p50}ms, p95: {p95}ms, p99: {p99}ms, max: {max}ms]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectables.operators.checks import one_row_join
from vectables.operators.scan import running_sums, time_chunk

HIST_MAX_MS = 3_600_000
QUANTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
GREEN_POLLS = 3


# ------------------------------------------------------------------ OP-56 probe outcome

def classify_probe(latency_ms: Column, client_ok: Column, timeout_ms: int = 50) -> Column:
    """ok / error / timeout; the timeout wins over whatever the client returned (S19)."""
    return F.when(latency_ms > F.lit(timeout_ms), "timeout").when(~client_ok, "error").otherwise("ok")


# ------------------------------------------------------------------ OP-58 histogram buckets

def _shift(v: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))).cast("int") - F.lit(7))


def _pow2(sh: Column) -> Column:
    return F.pow(F.lit(2.0), sh).cast("bigint")  # exact for shifts < 53


def bucket_hi(v: Column) -> Column:
    """Top of the 2-significant-digit log-linear bucket holding ``v`` (exact below 256):
    ``((v >> sh) + 1) * (1 << sh) - 1``."""
    p = _pow2(_shift(v))
    return ((F.floor(v / p) + 1) * p - 1).cast("bigint")


def bucket_lo(v: Column) -> Column:
    """Bottom of the bucket: ``(v >> sh) << sh``."""
    p = _pow2(_shift(v))
    return (F.floor(v / p) * p).cast("bigint")


def latency_histogram(probes: DataFrame, key: str = "uri") -> DataFrame:
    """``(uri, bucket_hi, n)`` for latencies in range; values above the range are the rows of :func:`rejects` (S20)."""
    ok = probes.where(F.col("latency_ms") <= HIST_MAX_MS)
    return ok.groupBy(key, bucket_hi(F.col("latency_ms")).alias("bucket_hi")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def rejects(probes: DataFrame) -> DataFrame:
    """Probes that the histogram cannot record: slower than its range."""
    return probes.where(F.col("latency_ms") > HIST_MAX_MS)


# ------------------------------------------------------------------ OP-59 summary

def summary_text(cols: dict[str, Column]) -> Column:
    return F.format_string("[min: %dms, p50: %dms, p95: %dms, p99: %dms, max: %dms]",
                           cols["min_ms"], cols["p50_ms"], cols["p95_ms"], cols["p99_ms"], cols["max_ms"])


def latency_summary(probes: DataFrame, key: str = "uri") -> DataFrame:
    """min, p50, p95, p99, max per key from the bucket histogram, nearest rank (``ceil(q n)``, at
    least 1) on bucket tops; min is the bottom of its bucket, max the top of its bucket.

    The histogram has at most ~2,000 rows per key, so the cumulative window over it is tiny."""
    hist = latency_histogram(probes, key)
    w = Window.partitionBy(key).orderBy("bucket_hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    aggs = [F.first("total").alias("total")]
    for name, q in QUANTILES:
        rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q)))
        aggs.append(F.min(F.when(F.col("cum") >= rank, F.col("bucket_hi"))).alias(f"{name}_ms"))
    per_key = cum.groupBy(key).agg(*aggs)
    ends = probes.where(F.col("latency_ms") <= HIST_MAX_MS).groupBy(key).agg(
        F.min("latency_ms").alias("__min"), F.max("latency_ms").alias("__max"))
    out = per_key.join(ends, on=key, how="inner").select(
        key, F.col("total").cast("bigint").alias("total"),
        bucket_lo(F.col("__min")).alias("min_ms"),
        *[F.col(f"{n}_ms").cast("bigint").alias(f"{n}_ms") for n, _ in QUANTILES],
        bucket_hi(F.col("__max")).alias("max_ms"),
    )
    return out.withColumn("text", summary_text({c: F.col(c) for c in
                                                ("min_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")}))


# ------------------------------------------------------------------ OP-57 / OP-60 failure runs

def islands(df: DataFrame, keys: Sequence[str], is_ok: Column, extra: dict[str, Column] | None = None,
            order=("ts", "event_id"), chunk: Column | None = None) -> DataFrame:
    """Add ``is_ok`` and ``g`` = oks so far (inclusive); the ordinal of an ok row among oks equals
    its ``g``. ``extra`` running sums are computed in the same pass; ``chunk`` is counted where the caller names none."""
    df = df.withColumn("is_ok", is_ok)
    values = {"g": F.col("is_ok").cast("bigint"), "__ord": F.lit(1), **(extra or {})}
    return running_sums(df, keys, order, values, time_chunk(df, keys) if chunk is None else chunk)


def runs_from_islands(isl: DataFrame, keys: Sequence[str], carry: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """One partial aggregation: a failure row belongs to run ``g``; the ok row that ends run ``r``
    is the one with ``g = r + 1`` (oks have distinct ``g``), so keying ok rows by ``g - 1`` puts the
    recovery into its run's group. No join, and the island frame is read once.

    ``weight`` (optional column) lets one row stand for several failures: the streaming form
    carries a key's open failure run into the next micro-batch as a single weighted row."""
    keys = list(keys)
    n_fail = (F.sum(F.when(~F.col("is_ok"), F.col(weight)).otherwise(0)) if weight
              else F.count_if(~F.col("is_ok"))).cast("bigint")
    # a bigint ordinal (not a (ts, event_id) struct) orders min_by / max_by, so the aggregation
    # buffer stays fixed-width and Spark can hash-aggregate
    order = F.col("__ord") if "__ord" in isl.columns else F.struct("ts", "event_id")
    fail_order = F.when(~F.col("is_ok"), order)
    ok_order = F.when(F.col("is_ok"), order)
    grouped = isl.withColumn("run", F.when(F.col("is_ok"), F.col("g") - 1).otherwise(F.col("g"))).groupBy(*keys, "run")
    runs = grouped.agg(
        F.min_by("event_id", fail_order).alias("first_event_id"),
        F.max_by("event_id", fail_order).alias("last_event_id"),
        n_fail.alias("failures"),
        F.max_by("event_id", ok_order).alias("recovered_event_id"),
        *[F.min_by(c, fail_order).alias(c) for c in carry],
        *[F.max_by(c, ok_order).alias(f"rec_{c}") for c in carry],
    )
    return runs.where(F.col("failures") > 0)


def failure_runs(rows: DataFrame, keys: Sequence[str], is_ok: Column, carry: Sequence[str] = ()) -> DataFrame:
    """One row per failure run: ``(keys, run, first_event_id, last_event_id, failures, recovered_event_id)``.

    ``carry`` columns are taken from the first failure of the run, and as ``rec_<name>`` from the
    recovering row."""
    return runs_from_islands(islands(rows, keys, is_ok), keys, carry)


def transitions_from_runs(runs: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Both transitions of every run from one pass over the runs (an explode of two structs)."""
    keys = list(keys)
    failed = F.struct(F.col("first_event_id").alias("event_id"), F.lit("failed").alias("kind"),
                      F.lit(None).cast("bigint").alias("failures"), *[F.col(c).alias(c) for c in carry])
    recovered = F.when(F.col("recovered_event_id").isNotNull(), F.struct(
        F.col("recovered_event_id").alias("event_id"), F.lit("recovered").alias("kind"), F.col("failures"),
        *[F.col(f"rec_{c}").alias(c) for c in carry]))
    return (runs.select(*keys, F.explode(F.array(failed, recovered)).alias("__t"))
            .where(F.col("__t").isNotNull()).select(*keys, "__t.*"))


def transitions_from_islands(isl: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    return transitions_from_runs(runs_from_islands(isl, keys, carry), keys, carry)


def transitions(rows: DataFrame, keys: Sequence[str], is_ok: Column, carry: Sequence[str] = ()) -> DataFrame:
    """State changes (S18, OP-60): ``failed`` at the first failure of each run, ``recovered`` at the
    ok row that ends it, with the run length. Output ``(keys, event_id, kind, failures, carry...)``."""
    return transitions_from_islands(islands(rows, keys, is_ok), keys, carry)


# ------------------------------------------------------------------ OP-61 round report

def round_report(runs: DataFrame, n_uris: int) -> DataFrame:
    """Per (drill, round): success when every configured uri succeeded, failed when none did, partial
    otherwise (S14); seconds = sum of truncated seconds (S15); error texts sorted by uri.

    ``message`` is the line of the class: the seconds of a success, the failures of a partial round, and for a
    failed one every uri with its error and the seconds it took. A round has at most ``n_uris`` runs, so its lists are short."""
    reported = F.col("outcome") != "cancelled"
    ok = F.col("outcome") == "ok"
    err = F.when(F.col("error").isNotNull(), F.struct("uri", "error", F.floor("duration_s").cast("bigint").alias("s")))
    g = runs.groupBy("drill", "round").agg(
        F.count_if(ok).cast("bigint").alias("successes"),
        F.count_if(reported).cast("bigint").alias("reports"),
        F.sum(F.when(reported, F.floor("duration_s"))).cast("bigint").alias("seconds"),
        F.sort_array(F.collect_list(err)).alias("__errs"),
    )
    cls = F.when(F.col("successes") == 0, "failed").when(F.col("successes") == n_uris, "success").otherwise("partial")
    text = F.concat_ws(", ", F.transform("__errs", lambda e: F.concat(e["uri"], F.lit(" ("), e["error"], F.lit(")"))))
    timed = F.concat_ws(", ", F.transform("__errs", lambda e: F.concat(
        e["uri"], F.lit(" ("), e["error"], F.lit(", "), e["s"].cast("string"), F.lit(" s)"))))
    seconds = F.coalesce("seconds", F.lit(0))
    message = (F.when(cls == "success", F.concat(F.lit("finished in "), seconds.cast("string"), F.lit(" seconds")))
               .when(cls == "partial", F.concat(F.lit("partially failed: "), text)).otherwise(F.concat(F.lit("failed: "), timed)))
    return g.select("drill", "round", "successes", "reports", seconds.alias("seconds"),
                    cls.alias("class"), text.alias("errors"), message.alias("message"))


# ------------------------------------------------------------------ OP-62 name selection

def select_names(names: DataFrame, include: Sequence[str] = (), ignore: Sequence[str] = (), col: str = "name") -> DataFrame:
    """Include list beats ignore list; unknown names drop silently (S16). Use :func:`require_rows`
    for the 'empty selection is an error' rule."""
    spark = names.sparkSession
    if include:
        wanted = spark.createDataFrame([(n,) for n in include], f"{col} string")
        return names.join(wanted, on=col, how="left_semi")
    if ignore:
        unwanted = spark.createDataFrame([(n,) for n in ignore], f"{col} string")
        return names.join(unwanted, on=col, how="left_anti")
    return names


def require_rows(df: DataFrame, message: str = "No drills to run") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


# ------------------------------------------------------------------ OP-63 / OP-66 debounce

def poll_summaries(statuses: DataFrame, key: str, polls: int) -> DataFrame:
    """One row per (key, time slice): polls ``n``, greens before the first non-green ``lead``, polls since the last
    non-green ``tail`` (itself included; null where there is none), the first of the slice's own polls that is ready
    ``hit``, and the first ``polls`` polls as ``head``. Two neighbouring slices fold into one of the same form."""
    w = Window.partitionBy(key, "__chunk").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.row_number().over(w).cast("bigint")
    rows = (statuses.select(key, "ts", "event_id", "status", time_chunk(statuses, [key]).alias("__chunk")).withColumn("at", at)
            .withColumn("reset", F.max(F.when(~F.coalesce(F.col("status") == "green", F.lit(False)), F.col("at"))).over(w)))
    poll = F.struct("at", "event_id", "ts")
    ready = F.col("at") - F.col("reset") + 1 == polls
    return rows.groupBy(key, "__chunk").agg(
        F.max("at").alias("n"), F.min("ts").alias("first_ts"),
        F.coalesce(F.min("reset") - 1, F.max("at")).alias("lead"), (F.max("at") - F.max("reset") + 1).alias("tail"),
        F.min(F.when(ready, poll)).alias("hit"),
        F.sort_array(F.collect_list(F.when(F.col("at") <= polls, poll))).alias("head"))


def green_debounce(statuses: DataFrame, key: str = "collection", polls: int = GREEN_POLLS) -> DataFrame:
    """First poll at which a key is ready: ``polls`` greens in a row from the start, but only
    ``polls - 1`` more after a non-green (which counts as 1, S10; a null status is a non-green). Output per key:
    ``(key, ready_event_id, ready_poll, waited_s)``, nulls when never ready.

    Slices of time are summarised where they are sorted and folded per key: polls in a row that end a slice are
    carried into the next one, whose head says at which poll they are enough."""
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folded = poll_summaries(statuses, key, polls).withColumn("until", F.sum("n").over(to_here)) \
        .withColumn("offset", F.col("until") - F.col("n"))
    # polls in a row at the start of the slice: those since the last non-green of any earlier one
    folded = folded.withColumn("carried", F.col("offset") - F.coalesce(F.max(F.col("until") - F.col("tail")).over(before), F.lit(0)))
    missing = F.lit(polls) - F.col("carried")
    led = F.when((missing >= 1) & (missing <= F.col("lead")), F.get("head", (missing - 1).cast("int")))
    hit = F.coalesce(led, F.col("hit"))      # the head's poll comes before any that follows a non-green
    first = F.struct((F.col("offset") + hit["at"]).alias("poll"), hit["event_id"].alias("event_id"), hit["ts"].alias("ts"))
    out = folded.groupBy(key).agg(F.min("first_ts").alias("__first_ts"), F.min(F.when(hit.isNotNull(), first)).alias("__ready"))
    waited = F.expr("timestampdiff(MICROSECOND, __first_ts, __ready.ts)") / F.lit(1e6)
    return out.select(key, F.col("__ready.event_id").alias("ready_event_id"), F.col("__ready.poll").cast("bigint").alias("ready_poll"),
                      waited.alias("waited_s"))


# ------------------------------------------------------------------ OP-64 stop at first failure

def until_first_fatal(runs: DataFrame) -> DataFrame:
    """Keep runs up to and including the end of the first round that failed completely (no run of it succeeded).

    Rounds are one partial aggregation of fixed width; the cut is one scalar (a round's last timestamp), which reaches
    the runs as a scalar subquery."""
    rounds = runs.groupBy("drill", "round").agg(F.count_if(F.col("outcome") == "ok").alias("successes"),
                                                F.max(F.struct("ts", "event_id")).alias("end"))
    fatal = rounds.where(F.col("successes") == 0).agg(F.min("end").alias("cut"))
    kept = one_row_join(runs, fatal).where(F.col("cut").isNull() | (F.struct("ts", "event_id") <= F.col("cut")))
    return kept.drop("cut")


# ------------------------------------------------------------------ OP-65 taxonomy

def error_taxonomy(runs: DataFrame) -> DataFrame:
    return runs.groupBy("outcome").agg(F.count(F.lit(1)).cast("bigint").alias("n")).withColumn(
        "reported", F.col("outcome") != "cancelled")
