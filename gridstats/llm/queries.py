"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstats.llm import (
    centroids,
    licenses,
    minhash,
    mixing,
    packing,
    pages,
    planes,
    quality,
    spelling,
    tokens,
    topk,
    toxicity,
    vectors,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of an installed vocabulary file; the folder may be named by the environment."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.prefix_counts(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    )
    over = (F.col("n_tokens") > 4096).alias("over_limit")
    return counts.select("doc_id", "n_bytes", "n_tokens", over)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scored(docs, toxicity.fit(docs, labels))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = planes.new_folder(spark)
    manifest = planes.write_shards(docs, vocabulary("word_bpe_49k.json"), folder, end_id=1)
    return planes.checksums(planes.read_shards(manifest))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.scored(docs, quality.fit(docs, labels), limit=0.3)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), shortest=5, least=3)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    return centroids.clustered(vecs, k=8, rounds=10, dim=64, scale=1024, seed=3)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_near_vectors": op4_near_vectors,
    "op5_toxicity": op5_toxicity,
    "op6_top_k": op6_top_k,
    "op7_licenses": op7_licenses,
    "op8_main_text": op8_main_text,
    "op9_minhash": op9_minhash,
    "op10_token_planes": op10_token_planes,
    "op11_quality": op11_quality,
    "op12_spelling": op12_spelling,
    "op13_centroids": op13_centroids,
}
# What SQL can express, for DuckDB. The usable vectors, and groups by reachability along links.
_VECTORS = """usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_GROUPS = """reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)"""
ORACLE: dict[str, str] = {
    "op4_near_vectors": f"""WITH RECURSIVE {_VECTORS},
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id
  WHERE list_sum(list_transform(x.e, lambda v: v * v)) > 0 AND list_sum(list_transform(y.e, lambda v: v * v)) > 0
    AND list_cosine_similarity(x.e, y.e) >= 0.95),
{_GROUPS},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(root, vec_id)) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN roots r ON r.a = vec_id""",
    "op6_top_k": f"""WITH {_VECTORS},
units AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS u FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.u, c.u) AS BIGINT) AS score
  FROM units q JOIN units c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5""",
    "op9_minhash": f"""WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: words[i:i + 4])) AS s
  FROM split WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
{_GROUPS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.a = d.doc_id""",
}


def _lloyd(rounds: int, k: int) -> str:
    """The rounds of op13 one after the other: a table of assignments ``a`` and of centroids ``c`` each."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, best % {k} AS num, best // {k} AS d FROM (
  SELECT vec_id, any_value(x) AS x, min({k} * CAST(list_sum(list_transform(x, lambda v, i: (v - c[i]) * (v - c[i])))
    AS HUGEINT) + num) AS best FROM kept, c{r} GROUP BY vec_id))""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.num, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
  SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT num, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY num, i) GROUP BY num) m USING (num))""")
    return ",\n".join(parts)


ORACLE["op13_centroids"] = f"""WITH {_VECTORS},
kept AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda v: CAST(floor(1024 * v) AS BIGINT)) AS x FROM usable WHERE len(e) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS num, x AS c FROM kept
  ORDER BY sha256('3:' || vec_id) LIMIT 8),
{_lloyd(10, 8)}
SELECT vec_id, CAST(num AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a10 JOIN c10 USING (num)"""

# The words of op12 lose letters by crc32, a byte after the other; near words share one with a letter deleted, or one
# is the other with a letter deleted (at each place: a letter replaced leaves the same word and place).
ORACLE["op12_spelling"] = """WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
met AS (SELECT doc_id, run, count(*) AS m FROM runs GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, m, list_transform(range(1, strlen(x) + 1), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i - 1, 2) AS BIGINT)) AS b
  FROM (SELECT *, doc_id || ':' || run AS x FROM met)),
marked AS (
  SELECT run, m, xor(4294967295, list_reduce(b, lambda a, v: xor(a // 256, tab[xor(a % 256, v) + 1]), 4294967295)) AS h
  FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, m FROM marked),
vocabulary AS MATERIALIZED (
  SELECT word, CAST(sum(m) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
holes AS MATERIALIZED (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN vocabulary b ON a.rest = b.word),
stats AS (SELECT word, count(*) AS n_near, min({'m': -near_n, 'near': near}) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (
  SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.near END AS form,
    CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM vocabulary v LEFT JOIN stats s ON s.word = v.word),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, root, n, n_near, form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL"""
