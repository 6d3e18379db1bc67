"""The registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectables.llm import chunks, langid, maxent, mixing, packing, parity, passages, phrases, pstable, urlrules, vptree, warc, whitening
from vectables.llm.store import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


_URL_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (page_id)
"""


@query("op4_url_rules", _URL_SQL)
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL filters: every page's url against the rules (operator 4)."""
    pages = _table(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.rule_table(spark, RULES), "page_id", "url").withColumnRenamed("id", "page_id")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing all documents to source weights (operator 9)."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
found AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
links AS (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""


@query("op7_jaccard_join", _JACCARD_SQL)
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: 3-word shingles, Jaccard of at least 0.9 (operator 7)."""
    return parity.jaccard_components(_table(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


_USABLE_SQL = """usable AS (
  SELECT *, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0)"""


@query("op6_vp_search", f"""
WITH {_USABLE_SQL},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op6_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every 50th vector among all vectors (operator 6); factor 1 is exact."""
    return vptree.search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


@query("op10_near_vectors", f"""
WITH RECURSIVE {_USABLE_SQL},
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
joined AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM joined
""")
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors under one label, cosine of at least 0.98 (operator 10)."""
    return pstable.near_duplicates(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences of at most 2048 (operator 2)."""
    cut = packing.pieces(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(cut).withColumnRenamed("id", "doc_id")


@query("op5_repeated_passages")
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup: fuzzy passages of 50 words or more that repeat an earlier place (operator 5)."""
    found = passages.repeated_passages(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
                        F.col("to_doc").alias("source_doc_id"), F.col("to_start").alias("source_start"),
                        F.col("to_end").alias("source_end"), F.col("same").alias("same_words"))


@query("op3_warc_captures", """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (
  SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (j // 4) + 1, 5))::INTEGER >> (15 - 5 * (j % 4))::INTEGER) & 31) + 1, 1) FOR j IN range(32)], '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS f FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM firsts
""")
def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC round trip of all pages with revisits, assembled into captures (operator 3)."""
    made = warc.captures(_table(spark, sf_dir, "pages"), "page_id", "url", "html", with_payload=False)
    return made.select(F.col("metadata.id").alias("page_id"), "response.payload_bytes", "response.payload_digest",
                       F.col("response.type").alias("record_type"), "response.refers_to")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents and pages by fused evidence (operator 8); a row has a doc_id or a page_id."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = langid.fit(docs, "text", "lang")
    of_docs = langid.document_items(docs, "doc_id", "source", "lang", "text").select(F.lit("documents").alias("of"), "*")
    of_pages = langid.page_items(pages, "page_id", "url", "html").select(F.lit("pages").alias("of"), "*")
    found = langid.identify(of_docs.union(of_pages), model, Workspace(spark, "langid"))
    return found.select(
        F.when(F.col("of") == "documents", F.col("id")).alias("doc_id"), F.when(F.col("of") == "pages", F.col("id")).alias("page_id"),
        "declared", "suffix", "text_lang", "lang", "posterior", "accepted")


@query("op1_maxent_scores")
def op1_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the maximum-entropy model, learnt from nine tenths of them (operator 1)."""
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held)
    return maxent.score(docs, "doc_id", "text", "held").withColumnRenamed("id", "doc_id")


@query("op12_chunk_recipes", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents by chunk recipes (operator 12)."""
    return chunks.exact_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("op11_collocations", """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
runs AS (SELECT lang, w, unnest(flatten([[{'i': i, 'm': m} FOR m IN range(1, least(5, len(w) - i + 1) + 1)] FOR i IN range(1, len(w) + 1)])) AS r FROM words),
counts AS (SELECT lang, w[r.i: r.i + r.m - 1] AS p, count(*) AS a FROM runs GROUP BY 1, 2 HAVING count(*) >= 100),
candidates AS (SELECT * FROM counts WHERE len(p) > 1),
inner_runs AS (
  SELECT lang, a, p, unnest(flatten([[{'i': i, 'm': m} FOR m IN range(2, len(p)) IF i + m - 1 <= len(p)] FOR i IN range(1, len(p) + 1)])) AS r FROM candidates),
longer AS (SELECT lang, p[r.i: r.i + r.m - 1] AS p, max(a) AS b FROM inner_runs GROUP BY 1, 2),
free AS (SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, p) WHERE b IS NULL OR 100 * b < 100 * a),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM free),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1: c.k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]
  JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
    array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM weakest)
SELECT * FROM ranked WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 5 words whose weakest cut scores highest, in each language of all documents (operator 11)."""
    return phrases.collocations(_table(spark, sf_dir, "documents"), "text", "lang")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first eight whitened components (operator 13)."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")
