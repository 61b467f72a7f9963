"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.llm import ann, chat, codes, exactdup, langid, lloyd, mixing, neardup, packing, quality, secrets, topk, toxicity
from oddsloom.llm.common import in_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold("doc_id", 5, 0)
    weights = quality.fit_quality(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    return quality.score_quality(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def pack_config() -> packing.PackConfig:
    """The public byte-level vocabulary, in both of its forms."""
    import public_tokenizers

    return packing.PackConfig(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), pack_config())


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold("doc_id", 4, 2)
    model = langid.fit_filters(docs.where(~held_out))
    return langid.predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs, dictionary=secrets.fit_dictionary(docs))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, sizes = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return mixing.taken_words(plan, sizes)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(conflict).alias("text")) for i, r in enumerate(("user", "assistant"))])),
    )
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=["label"])
    return codes.with_group_error(coded.rows, "label").select("vec_id", "code", "error", F.col("group_error").alias("label_error"), F.lit(coded.digest()).alias("codebooks_sha256"))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_products(vectors, vectors.where("vec_id % 50 = 0"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.with_inertia(lloyd.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
w AS (
  SELECT *, length(role) + length(text) + CASE WHEN regexp_matches(role || chr(10) || text, '~|</?s>|\[/?INST\]')
    THEN length(regexp_replace(role || chr(10) || text, '[^~]', '', 'g'))
      + len(regexp_extract_all(role || chr(10) || text, '</?s>|\[/?INST\]')) ELSE 0 END + length('<s>[INST]  [/INST]</s>') AS written
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(written) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql(rounds: int = 4) -> str:
    """The rounds one after another, each part compared with all entries."""
    parts = [
        f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS p FROM kept, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, x.part, any_value(p) AS p, min(CAST(list_dot_product(p, p) - 2 * list_dot_product(p, c) + list_dot_product(c, c) AS BIGINT) * 256 + entry) AS best
  FROM x JOIN b{r} b ON x.part = b.part GROUP BY vec_id, x.part)""")
        if r < rounds:
            parts.append(f"""u{r} AS MATERIALIZED (
  SELECT part, entry, list(v ORDER BY i) AS c FROM (
    SELECT part, best % 256 AS entry, i, floor(sum(p[i]) / count(*)) AS v FROM a{r}, range(1, 1 + (SELECT max(len(p)) FROM x)) t(i) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN u{r} u ON b.part = u.part AND b.entry = u.entry)""")
    parts.append(f"""coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book""")
    return ",\n".join(parts)


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op13_sql(rounds: int = 5) -> str:
    """The rounds one after another, every vector compared with all centroids."""
    parts = [
        f"""WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q AS c FROM (SELECT sha256('2:' || vec_id) AS h, q FROM x ORDER BY h LIMIT 40))"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, min(CAST(list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c) AS BIGINT) * 64 + cluster) AS best
  FROM x, c{r} GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""u{r} AS MATERIALIZED (
  SELECT cluster, list(v ORDER BY i) AS c FROM (SELECT best % 64 AS cluster, i, floor(sum(q[i]) / count(*)) AS v FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(u.c, o.c) AS c FROM c{r} o LEFT JOIN u{r} u ON o.cluster = u.cluster)""")
    parts.append(f"""d AS (SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, best // 64 AS distance FROM a{rounds})
SELECT d.vec_id, d.cluster, d.distance, CAST(sum(distance) OVER (PARTITION BY d.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.c, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256
FROM d JOIN c{rounds} c ON d.cluster = c.cluster""")
    return ",\n".join(parts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_nearest": op3_nearest,
        "op4_near_dedup": op4_near_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_language_id": op6_language_id,
        "op7_secret_scan": op7_secret_scan,
        "op8_source_mixing": op8_source_mixing,
        "op9_chat_format": op9_chat_format,
        "op10_toxicity": op10_toxicity,
        "op11_vector_codes": op11_vector_codes,
        "op12_top_products": op12_top_products,
        "op13_centroid_clusters": op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op9_chat_format": OP9_SQL, "op11_vector_codes": _op11_sql(), "op12_top_products": OP12_SQL, "op13_centroid_clusters": _op13_sql()}
