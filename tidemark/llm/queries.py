"""Queries of the training-data operators: each applies one operator to its whole table.

Production parameters stand here; each query derives its columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard_join, language_id, lattice_dedup, lm_scoring, mixing, permutation_ann, pii, quality, sentence_pieces, token_counts


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentence_pieces.read_model(tokenizer_path("piece_bpe_32k.model"))
    found = sentence_pieces.encode(table(spark, sf_dir, "documents"), model, k=2, check=2)
    return found.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "log_prob", "inclusion", "round_trip", F.hex(F.xxhash64("ids")).alias("ids_hash"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), common.fold_of("doc_id", 3)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=fold != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", fold.eqNullSafe(1).alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(tokenizer_path("word_bpe_49k.json")).read_text()
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary, limit=2048)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85, den=100)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), common.fold_of("doc_id", 5)
    found = language_id.predict(docs, *language_id.fit(docs, learn=fold != 0))
    return found.select("doc_id", fold.eqNullSafe(0).alias("held_out"), "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = common.fold_of("doc_id", 5)
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), learn=fold != 1)
    return scored.select("doc_id", fold.eqNullSafe(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    with common.scratch(spark):
        found = permutation_ann.Index(vectors, k=5).search(vectors.where("vec_id % 50 = 0"))
        return common.materialise(found, outer=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

#: All pairs by brute force, and what links reach by recursion: right at any size, fit for small ones.
OP5_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, LEAST(a, MIN(b)) AS component_id FROM r GROUP BY a), n AS (SELECT a, COUNT(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, COALESCE(component_id, vec_id) AS component_id, COALESCE(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
OP7_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, ANY_VALUE(a.n) AS n, ANY_VALUE(b.n) AS m, COUNT(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (n + m - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, LEAST(a, MIN(b)) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, COALESCE(component_id, doc_id) AS component_id FROM g LEFT JOIN c ON c.a = doc_id"""
ORACLE_SQL: dict[str, str] = {"op5_near_dedup": OP5_SQL, "op7_jaccard_join": OP7_SQL}
