"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import (
    bpe, interaction, language, minhash, mixing, passages, quality, sharding, suffixes, topk, vectors, warc, whitening,
)
from tessella.llm.common import shared_dir, stored, table

SHARDS = 40


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(found, found.where("vec_id % 50 = 0"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of 40 shards and of one more are versions of a stored table."""
    now, more = sharding.grown(spark, SHARDS, f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}")
    return sharding.shard(table(spark, sf_dir, "documents"), now, more)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), length=2)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written to the shared folder and read back; a wrong digest, length or reference fails the query."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(warc.marked(table(spark, sf_dir, "pages")), folder)
    found = warc.resolved(stored(warc.read(manifest), "warc-records"))
    number = lambda c: F.substring(c, len(warc.PREFIX) + 1, 32).try_cast("long")
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "record_id", "problem")))
    return found.select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffixes, op2_mixing, op3_topk, op4_language, op5_vectors, op6_quality, op7_bpe, op8_passages, op9_sharding,
        op10_minhash, op11_warc, op12_interaction, op13_whitening,
    )
}

_MIXING = """
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 8))::BIGINT % 2147483648 % 64 AS salt
  FROM documents
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 32 ELSE (floor(log2(size)) + 1)::BIGINT * 32 + (size >> greatest(floor(log2(size))::INT - 4, 0)) END AS cls FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS ceiling,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), r AS (
  SELECT *, coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), f AS (
  SELECT *, ceiling / w <= (budget - before) / rest AS is_full FROM r
), t AS (
  SELECT source, source_size, ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT % 1048576 / 1048576.0::DOUBLE AS u,
         CASE WHEN is_full THEN ceiling ELSE (budget - sum(CASE WHEN is_full THEN ceiling ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM f
), p AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY c.source ORDER BY c.cls, c.salt, c.doc_id, c.size) AS place
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(u + place * rate) - floor(u + (place - 1) * rate)) * size)::BIGINT AS taken FROM p
"""

_SUFFIXES = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), s AS (
  SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(generate_series(1, n - 399)) AS i FROM d WHERE n >= 400)
), r AS (
  SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i > lag(i, 1, -999) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM r)
), c AS (
  SELECT doc_id, min(i) AS x, max(i) + 399 AS y FROM g GROUP BY doc_id, run
), k AS (
  SELECT doc_id, x, y, lag(y, 1, 0) OVER (PARTITION BY doc_id ORDER BY x) + 1 AS kept_from FROM c
), parts AS (
  SELECT k.doc_id, kept_from, hex(b[kept_from:x - 1]) AS part FROM k JOIN d USING (doc_id) WHERE kept_from < x
  UNION ALL SELECT doc_id, z.y + 1, hex(b[z.y + 1:n]) FROM d JOIN (SELECT doc_id, max(y) AS y FROM c GROUP BY doc_id) z USING (doc_id) WHERE z.y < n
), t AS (
  SELECT doc_id, string_agg(part, '' ORDER BY kept_from) AS kept FROM parts GROUP BY doc_id
), m AS (
  SELECT doc_id, sum(y - x + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM c GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept, ''))) END AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (
  SELECT s.doc_id, sh, n FROM s JOIN n USING (doc_id)
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.sh = y.sh AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), g AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s
) WHERE rank <= 5
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), g AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id)::BIGINT AS n_links, g.component_id, e.vec_id = g.component_id AS kept
FROM embeddings e JOIN g USING (vec_id)
"""

_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

_INTERACTION = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), x AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > first_id, false) AS e FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL
), k(f, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM k p, k q, k r, k s, k u WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31
), z AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, z GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

ORACLES: dict[str, str] = {"op11_warc": _WARC, "op12_interaction": _INTERACTION, "op1_suffixes": _SUFFIXES, "op2_mixing": _MIXING, "op3_topk": _TOPK, "op5_vectors": _VECTORS, "op10_minhash": _MINHASH}
