"""URL verdicts by a sort-merge range join of rules and addresses.

A host is written from its last label to its first, every label closed by a dot (``blog.example.org``
is ``org.example.blog.``), so a rule's host subtree is one interval of keys. Addresses are dealt out
by sampled splitters of (key, path, id): a host, or one address, with a third of all rows is spread
over as many parts as its share asks for. A rule goes to every part that its interval meets; there are
at most (rules + parts x nesting depth) such copies, because intervals nest. Each part is sorted
and swept once with a stack of the rules' hosts that are open at the current key.

Defined cases: a null url or one without ``://`` has an empty host and path and gets the default
verdict; a null id is kept; repeated rows are judged one by one; rules with a null host, path or verdict
are ignored; of rules that fit, the longest host + path wins, then the longer host, then ``block``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RULES = "host string, path string, verdict string"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPLITTERS_PER_PART = 64      # sampled keys for each part, so the sample is parts x this

_OUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()),
])


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def host_key(host):
    """``a.b.c`` -> ``c.b.a.``; the empty host is the empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def split_url(url):
    """(host, path): from the first ``://`` to ``/ ? #`` with A-Z lower-cased, then up to ``? #``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, whole, 1), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


class _Open:
    """Rules of one host whose interval is open: their paths sorted, each with the nearest path
    that is a prefix of it, so the longest fitting one is found by bisection and parent links."""

    def __init__(self, key: str):
        self.key, self.rules = key, {}

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.rules or verdict == "block":
            self.rules[path] = (rule, verdict)
        self.paths = None

    def close(self) -> None:
        self.paths, self.up, stack = sorted(self.rules), [], []
        for i, p in enumerate(self.paths):
            while stack and not p.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.up.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        if self.paths is None:
            self.close()
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.up[i]
        return self.rules[self.paths[i]] if i >= 0 else None


def _sweep(default: str):
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                        ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        part = None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out: list[tuple] = []
            for p, key, is_url, id_, host, path, verdict in zip(
                    cols["part"], cols["key"], cols["is_url"], cols["id"], cols["host"], cols["path"], cols["verdict"]):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key))
                    stack[-1].add(path, host + path, verdict)
                    continue
                best = None
                for entry in stack:
                    found = entry.longest(path)
                    if found and (best is None or len(found[0]) >= len(best[0])):
                        best = found
                out.append((id_, host, path, *(best or (None, default))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


_DEALT = "part int, key string, is_url boolean, id long, host string, path string, verdict string"
_LEAST = -(1 << 63)


def _deal(cuts: list[tuple[str, str, int]]):
    """Parts of the rows: an address is in one, a rule in every part from its first key to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["is_url"]:
                    first = last = bisect_right(cuts, (r["key"], r["path"], _LEAST if r["id"] is None else r["id"]))
                else:
                    first = bisect_right(cuts, (r["key"], "", _LEAST))
                    # the interval of a prefix ends where its closing dot is raised by one, to "/"
                    after = (r["key"][:-1] + "/",) if r["key"] else (chr(0x10FFFF),)
                    last = bisect_right(cuts, (*after, "", _LEAST))
                out += [(p, *r.values()) for p in range(first, last + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *batch.schema.types])],
                                                 names=["part", *batch.schema.names])

    return run


def judge(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str = "allow",
          parts: int | None = None) -> DataFrame:
    """``urls`` and ``rules(host, path, verdict)`` -> ``(id, host, path, rule, verdict)``, a row per url.

    A rule fits its host and all subdomains when the url's path starts with the rule's. ``parts`` is
    the number of parts to sweep (the session's shuffle partitions unless given).
    """
    parts = parts or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col(url_col))
    named = urls.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    named = named.withColumn("key", host_key(F.col("host")))

    # splitters: quantiles of the parts x SPLITTERS_PER_PART rows with the smallest seeded hashes
    drawn = named.select("key", "path", F.coalesce("id", F.lit(_LEAST)).alias("n")).orderBy(
        F.xxhash64("key", "path", "n"), "key", "path", "n").limit(parts * SPLITTERS_PER_PART).collect()
    keys = sorted(map(tuple, drawn))
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []

    known = rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path", "verdict").dropna().distinct()
    known = known.select(host_key(F.col("host")).alias("key"), F.lit(False).alias("is_url"),
                         F.lit(None).cast("long").alias("id"), "host", "path", "verdict")
    both = named.select("key", F.lit(True).alias("is_url"), "id", "host", "path",
                        F.lit(None).cast("string").alias("verdict")).union(known)
    dealt = both.mapInArrow(_deal(cuts), _DEALT).repartition(parts, "part")
    return dealt.sortWithinPartitions("part", "key", "is_url", "path").mapInArrow(_sweep(default), _OUT)
