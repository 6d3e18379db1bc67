"""Data-quality checks (OP-38, OP-39, OP-47..OP-55).

A check never raises inside Spark: it returns rows. Summary checks return one row
``(check, collection, expected, actual, ok)``; diff operators return one row per offending key.
Every check is a partial aggregation or an equi-join on id, so it scales with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectables import BATCH_SIZE
from vectables.operators.scan import block_chunk, chunked_lag, running_sums, time_chunk

# hash buckets of ids that set comparisons tell apart: bounds what travels when two sets are equal
BUCKETS = 1 << 12
CHECK_COLUMNS = ("check", "collection", "expected", "actual", "ok")


def one_row_join(*frames: DataFrame) -> DataFrame:
    """The rows of ``frames[0]`` with the columns of the other, one-row frames (global aggregates)
    attached as scalar subqueries: no join, so no cartesian product appears in the plan."""
    out = frames[0]
    cols = [F.col(c) for c in out.columns]
    for f in frames[1:]:
        cols += [f.select(c).scalar().alias(c) for c in f.columns]
    return out.select(*cols)


def check_row(agg: DataFrame, check: str, collection: str, expected: Column, actual: Column, ok: Column) -> DataFrame:
    return agg.select(
        F.lit(check).alias("check"), F.lit(collection).alias("collection"),
        expected.cast("bigint").alias("expected"), actual.cast("bigint").alias("actual"), ok.alias("ok"),
    )


def check_count(table: DataFrame, expected: int, check: str = "count", collection: str = "points") -> DataFrame:
    """OP-47: number of points equals ``expected`` (0 = "is empty"); a missing count reads as 0 (S7)."""
    agg = table.agg(F.coalesce(F.count(F.lit(1)), F.lit(0)).alias("n"))
    return check_row(agg, check, collection, F.lit(expected), F.col("n"), F.col("n") == F.lit(expected))


def differing_buckets(expected: DataFrame, returned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket)`` of the hash buckets of ``id`` whose rows differ between two frames. Each bucket is a row count and
    four sums over the parts of a 128-bit hash, plus for a row of ``expected`` and minus for one of ``returned``: they
    do not depend on order, are made map-side, and at most ``buckets`` rows a task are shuffled. Rows
    without an id (bucket -1) always differ. Two different buckets look equal with a chance of 2^-128."""
    signed = _with_bucket(expected, buckets).withColumn("sign", F.lit(1)).unionByName(
        _with_bucket(returned, buckets).withColumn("sign", F.lit(-1)))
    halves = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), F.col("id"))
        halves += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]     # no sum overflows below 2^31 rows a bucket
    sums = signed.groupBy("bucket").agg(F.sum("sign").alias("n"), *[F.sum(F.col("sign") * h).alias(f"h{i}") for i, h in enumerate(halves)])
    same = (F.col("n") == 0) & (F.col("h0") == 0) & (F.col("h1") == 0) & (F.col("h2") == 0) & (F.col("h3") == 0)
    return sums.where(~same | (F.col("bucket") < 0)).select("bucket")


def _with_bucket(ids: DataFrame, buckets: int) -> DataFrame:
    return ids.select("id", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets))).cast("long").alias("bucket"))


def id_set_diff(expected: DataFrame, returned: DataFrame, keyed: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """OP-38: per id, how often it was expected and returned, and what is wrong with it.

    Both sides are aggregated before the full outer join, so duplicates show as counts and no
    id's rows are ever multiplied. Output ``(id, n_expected, n_returned, kind)`` for ids that
    are missing, duplicated or extra.

    ``keyed`` says that ``id`` is the key of ``expected`` (no id twice). Then equal buckets hold no difference, and
    only ids of :func:`differing_buckets` are shuffled and joined: none where the sets are equal."""
    if keyed:
        wanted = F.broadcast(differing_buckets(expected, returned, buckets))     # at most ``buckets`` + 1 rows
        expected, returned = (_with_bucket(x, buckets).join(wanted, "bucket", "left_semi") for x in (expected, returned))
    e = expected.groupBy("id").agg(F.count(F.lit(1)).cast("bigint").alias("n_expected"))
    r = returned.groupBy("id").agg(F.count(F.lit(1)).cast("bigint").alias("n_returned"))
    j = e.join(r, on="id", how="full_outer").select(
        "id", F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_returned", F.lit(0)).alias("n_returned"))
    kind = (
        F.when(F.col("n_returned") == 0, "missing")
        .when(F.col("n_expected") == 0, "extra")
        .when(F.col("n_returned") > 1, "duplicate")
    )
    return j.withColumn("kind", kind).where(F.col("kind").isNotNull())


def check_id_set(expected: DataFrame, returned: DataFrame, collection: str = "points", keyed: bool = False) -> DataFrame:
    """OP-48: retrieve is complete: right length, no missing, no duplicate, no extra id (S11, on all rows).
    ``keyed`` as in :func:`id_set_diff`."""
    diff = id_set_diff(expected, returned, keyed)
    n_exp = expected.agg(F.count(F.lit(1)).alias("expected"))
    n_ret = returned.agg(F.count(F.lit(1)).alias("returned"))
    kinds = diff.agg(
        F.count_if(F.col("kind") == "missing").alias("missing"),
        F.count_if(F.col("kind") == "duplicate").alias("duplicate"),
        F.count_if(F.col("kind") == "extra").alias("extra"),
    )
    out = one_row_join(n_exp, n_ret, kinds)
    return out.select(
        F.lit(collection).alias("collection"),
        *[F.col(c).cast("bigint").alias(c) for c in ("expected", "returned", "missing", "duplicate", "extra")],
        ((F.col("expected") == F.col("returned")) & (F.col("missing") == 0) & (F.col("duplicate") == 0)
         & (F.col("extra") == 0)).alias("ok"),
    )


def vector_diff(before: DataFrame, after: DataFrame, vector: str = "vec") -> DataFrame:
    """OP-39: ``(id, changed)`` for ids in both versions; null-safe array equality."""
    b = before.select("id", F.col(vector).alias("__before"))
    a = after.select("id", F.col(vector).alias("__after"))
    return b.join(a, on="id", how="inner").select("id", (~F.col("__before").eqNullSafe(F.col("__after"))).alias("changed"))


def check_vectors_changed(before: DataFrame, after: DataFrame, collection: str = "points") -> DataFrame:
    """OP-51: every point present in both versions has a new vector."""
    agg = vector_diff(before, after).agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))
    return check_row(agg, "vectors_changed", collection, F.col("n"), F.col("changed"), F.col("n") == F.col("changed"))


def check_vectors_present(table: DataFrame, vector: str = "vec", collection: str = "points") -> DataFrame:
    """OP-49: no point lacks the vector."""
    agg = table.agg(F.count_if(F.col(vector).isNull()).alias("missing"))
    return check_row(agg, "vectors_present", collection, F.lit(0), F.col("missing"), F.col("missing") == 0)


def check_points_exist(table: DataFrame, samples: DataFrame, collection: str = "points") -> DataFrame:
    """OP-50: every sampled id exists (anti join of the samples against the table)."""
    wanted = samples.select("id").distinct()
    missing = wanted.join(table.select("id"), on="id", how="left_anti").agg(F.count(F.lit(1)).alias("missing"))
    total = wanted.agg(F.count(F.lit(1)).alias("sampled"))
    out = one_row_join(total, missing)
    return check_row(out, "points_exist", collection, F.col("sampled"), F.col("sampled") - F.col("missing"),
                     F.col("missing") == 0)


def check_search_hits(queries: DataFrame, hits: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """OP-52: per query, a reason code: ``no_hits``, ``empty_payload`` (top hit without keyword),
    ``bad_id`` (top hit id null, negative or not below the number of ``points``), else ``ok``.
    The point count joins in as a one-row frame, so the check stays one lazy plan."""
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("bigint").alias("hits"), F.min_by("id", "rank").alias("top_id"),
                                       F.min_by("a", "rank").alias("top_a"))     # the search is read once
    j = queries.select("query_id").join(per, on="query_id", how="left")
    bad_id = F.col("top_id").isNull() | (F.col("top_id") < 0)
    if points is not None:
        j = one_row_join(j, points.agg(F.count(F.lit(1)).alias("__n")))
        bad_id = bad_id | (F.col("top_id") >= F.col("__n"))
    reason = (
        F.when(F.col("hits").isNull(), "no_hits")
        .when(F.col("top_a").isNull(), "empty_payload")
        .when(bad_id, "bad_id")
        .otherwise("ok")
    )
    return j.select("query_id", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), reason.alias("reason"))


def write_ledger(acks: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """OP-19: per write batch ``floor(id / size)``: rows, acknowledged with status 2, failed, ok."""
    return (
        acks.groupBy(F.floor(F.col("id") / size).cast("bigint").alias("batch_id"))
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("expected"),
            F.count_if(F.col("status") == 2).cast("bigint").alias("acked"),
            F.count_if(F.col("status") != 2).cast("bigint").alias("failed"),
        )
        .withColumn("ok", F.col("failed") == 0)
    )


def audit_lifecycle(attempts: DataFrame) -> DataFrame:
    """OP-55: per (collection, op): attempts, successes, accepted failures (a create whose message
    names the collection as already existing, S13; a failed delete is never accepted), other failures; ``ok`` when no other failure. Successes are
    reported, not required (S12)."""
    accepted = _refused_as_existing()
    return attempts.groupBy("collection", "op").agg(
        F.count(F.lit(1)).cast("bigint").alias("attempts"),
        F.count_if(F.col("message").isNull()).cast("bigint").alias("succeeded"),
        F.count_if(F.col("message").isNotNull() & accepted).cast("bigint").alias("accepted_failures"),
        F.count_if(F.col("message").isNotNull() & ~accepted).cast("bigint").alias("violations"),
    ).withColumn("ok", F.col("violations") == 0)


def _refused_as_existing() -> Column:
    return (F.col("op") == "create") & F.col("message").contains(
        F.concat(F.lit("Collection `"), F.col("collection"), F.lit("` already exists!")))


def replay_names(attempts: DataFrame) -> DataFrame:
    """What a log of attempts ``(event_id, ts, collection, op, message)`` says of each name, in order of ``(ts, event_id)``; only
    attempts without a message took effect. Per collection: ``creates`` and ``deletes`` that did, ``created_twice``
    (while the name existed), ``deleted_twice`` (while it did not), ``refused_wrongly`` (a create refused as existing while the
    name did not exist) and ``exists`` (after the last one). A null op takes no effect.

    Attempts are numbered by the successes up to them in chunks of time, so no collection is one task's; a success and the
    attempts that follow it are then one partial aggregate."""
    took = F.col("message").isNull() & F.col("op").isin("create", "delete")
    numbered = running_sums(attempts, ["collection"], ["ts", "event_id"], {"g": F.coalesce(took, F.lit(False)).cast("bigint")},
                            time_chunk(attempts, ["collection"]))
    states = numbered.groupBy("collection", "g").agg(F.max(F.when(took, F.col("op"))).alias("op"),
                                                     F.count_if(F.col("message").isNotNull() & _refused_as_existing()).alias("refused"))
    states = chunked_lag(states, ["collection"], ["g"], F.col("op"), "prev", block_chunk("g"))
    made, gone = F.col("op") == "create", F.col("op") == "delete"
    existed = F.coalesce(F.col("prev") == "create", F.lit(False))
    return states.groupBy("collection").agg(
        F.count_if(made).cast("bigint").alias("creates"), F.count_if(gone).cast("bigint").alias("deletes"),
        F.count_if(made & existed).cast("bigint").alias("created_twice"), F.count_if(gone & ~existed).cast("bigint").alias("deleted_twice"),
        F.sum(F.when(F.coalesce(made, F.lit(False)), 0).otherwise(F.col("refused"))).cast("bigint").alias("refused_wrongly"),
        F.coalesce(F.max_by("op", "g") == "create", F.lit(False)).alias("exists"))
