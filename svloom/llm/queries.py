"""The queries of the thirteen operators, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cross_tokenizer, embedding_dup, hard_negatives, language, language_model, mixing, near_dup, packing, repeats, sharding, token_count, topk, toxicity
from .common import table


def shard_names(n: int = sharding.SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, ["doc_id"], shard_names()).select("doc_id", "slot", "shard")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op3_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_model.score_texts(docs, language.fold(docs["doc_id"], 5) != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100).drop("group")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.trained(docs, fold_n=4, held=2)
    found = language.identify(docs, model)
    return found.select("doc_id", (language.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), fold_n=5, held=0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (language.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), positives=5, negatives=3, every=50)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.cross_tokenizer_alignment(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), 200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_token_counts, op3_embedding_near_dup, op4_packing, op5_exact_top_k, op6_mixing, op7_language_model, op8_minhash_near_dup, op9_language_id, op10_toxicity, op11_hard_negatives, op12_cross_tokenizer, op13_suffix_dedup)
}

#: A row's 60-bit hash in DuckDB.
HASH_SQL = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)"


def sharding_sql() -> str:
    table_text = ",".join(map(str, sharding.lookup_table(shard_names())))
    return f"""
WITH t AS (SELECT string_split('{table_text}', ',') AS slots),
d AS (SELECT doc_id, {HASH_SQL} % {sharding.TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, format('shard-{{:04d}}', CAST(slots[slot + 1] AS INTEGER)) AS shard FROM d, t"""


MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, source, {HASH_SQL} AS h,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS most,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS no FROM w),
l AS (SELECT a.*, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(b.most) FROM o b WHERE b.no < a.no), 0))
             / (SELECT sum(b.weight) FROM o b WHERE b.no >= a.no) AS level FROM o a),
f AS (SELECT level FROM l WHERE level * weight < most ORDER BY no LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT level FROM f) * weight), most) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
b AS (SELECT *, target - times * source_size AS budget FROM e),
g AS (SELECT source, h, sum(size) AS at, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, b.source_size, b.target,
       d.size * (b.times + CASE WHEN g.upto <= b.budget OR (g.upto - g.at <= b.budget AND 2 * (b.budget - (g.upto - g.at)) >= g.at) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h"""


#: Vectors that take part: no null or non-finite component, none empty.
FINE_SQL = "e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

LINKS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINE_SQL} AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.low, v.vec_id) AS component_id, coalesce(c.low, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a"""

TOP_K_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS q FROM v WHERE vec_id IS NOT NULL AND {FINE_SQL}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5"""


HARD_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS q FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINE_SQL}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""


#: Sets of shingles by document, classes of equal sets, links between classes, what they reach.
NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
c AS (SELECT g, min(doc_id) AS low FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT low, len(g) AS n, unnest(g) AS t FROM c),
l AS (SELECT a.low AS a, b.low AS b FROM x a JOIN x b ON a.t = b.t AND a.low < b.low AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
      GROUP BY a.low, b.low, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT low AS a, low AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.low, s.doc_id) AS component_id, coalesce(m.low, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m ON c.low = m.a"""

#: Starts of 200-byte strings that start twice, runs of the bytes they cover, what lies between the runs.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM d),
k AS MATERIALIZED (SELECT doc_id, i, md5(b[i + 1 : i + 200]) AS k FROM p),
h AS (SELECT doc_id, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM h),
j AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS low, max(i) + 200 AS high FROM j GROUP BY doc_id, run),
t AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
o AS (SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS upto FROM (SELECT doc_id, low, high FROM r UNION ALL SELECT doc_id, n, n FROM d)),
u AS (SELECT o.doc_id, string_agg(hex(d.b[o.upto + 1 : o.low]), '' ORDER BY o.low) AS kept FROM o JOIN d ON o.doc_id = d.doc_id WHERE o.low > o.upto GROUP BY o.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(coalesce(u.kept, ''))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN u ON d.doc_id = u.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding_sql(), "op3_embedding_near_dup": LINKS_SQL, "op5_exact_top_k": TOP_K_SQL, "op6_mixing": MIXING_SQL, "op8_minhash_near_dup": NEAR_SQL, "op11_hard_negatives": HARD_SQL, "op13_suffix_dedup": REPEATS_SQL}
