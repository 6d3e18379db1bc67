"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so: after a white-space character whose neighbours have code points of
given residues, ``LEAST`` characters after the last cut at the earliest, ``MOST`` at the latest. Equal passages so fall into
equal chunks wherever they stand. A chunk's identifier is a tuple of 64-bit hashes; it is verified: the distinct chunks
meet by identifier and content, once, combined before they are shuffled, and if one identifier names two contents, all
identifiers get one hash more, until each names one. A text's recipe is the ordered list of its identifiers, so two texts are
equal exactly when their recipes are. From there on only recipes move: their groups are counted per salt, then over
salts, and the result goes back to as many (recipe, salt) keys as there are, so a group of a third of all rows is dealt
over ``SALTS`` keys in every shuffle.

Defined cases: a null text is the empty text, whose recipe is empty; of rows with equal texts the one with the largest id
stays, null ids last, and of rows that also repeat that id one stays; every row gets a result row; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vectables.llm.store import Workspace

LEAST, MOST = 256, 8_192    # characters of a chunk
BEFORE, AFTER = 5, 1        # residues modulo 8 of the code points around the white space of a cut
SALTS = 64


def _class(residue: int) -> str:
    return "[" + "".join(f"\\x{c:02X}" for c in range(0x21, 0x7F) if c % 8 == residue) + "]"


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """One chunk from where the last ended: up to the first cut, or to the end of the text, or ``most`` characters."""
    return f"(?s).{{{least},{most}}}?(?:(?<={_class(BEFORE)}\\s)(?={_class(AFTER)})|\\z)|.{{1,{most}}}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern()), F.lit(0))


def hashes(chunk: Column, width: int) -> list[Column]:
    """``width`` independent 64-bit hashes."""
    return [F.xxhash64(F.lit(seed), chunk) for seed in range(width)]


def verified_width(texts: DataFrame, width: int = 2) -> int:
    """The least number of hashes, from ``width`` on, by which every identifier of a chunk of ``texts(text)`` names one content."""
    pieces = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    while True:
        names = [f"h{i}" for i in range(width)]
        distinct = pieces.select(*[h.alias(n) for h, n in zip(hashes(F.col("chunk"), width), names)], "chunk").distinct()
        if distinct.groupBy(*names).count().where("count > 1").isEmpty():
            return width
        width += 1


def exact_duplicates(docs: DataFrame, id: str, text: str, normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` -> (id, keep_id, group_size, kept, text_sha256), one row per row; ``normal`` is applied to the texts first."""
    given = F.col(text) if normal is None else normal(F.col(text))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(given, F.lit("")).alias("text"))
    width = verified_width(rows.select("text"))
    recipe = F.flatten(F.transform(chunks(F.col("text")), lambda c: F.array(*hashes(c, width))))
    # a row's number is fixed once it is written; it tells rows apart that repeat one id
    made = Workspace(docs.sparkSession, "chunks").save(
        rows.select("id", F.monotonically_increasing_id().alias("row"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                    recipe.alias("recipe")), "recipes").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    salted = made.groupBy("recipe", "salt").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("n"))
    groups = salted.groupBy("recipe").agg(
        F.max("last").alias("last"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")).select(
        "recipe", F.explode("salts").alias("salt"), "last", "group_size")
    return made.join(groups, ["recipe", "salt"]).select(
        "id", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")
