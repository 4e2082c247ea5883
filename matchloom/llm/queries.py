"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, language, neardup, packing, pii, quality, secrets, substring, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_paths() -> tuple[str, str]:
    """Where the public vocabulary files are; MATCHLOOM_TOKENIZERS names another folder."""
    import public_tokenizers

    folder = os.environ.get("MATCHLOOM_TOKENIZERS")
    where = (lambda n: os.path.join(folder, n)) if folder else (lambda n: str(public_tokenizers.path(n)))
    return where(packing.TOKENIZER), where(packing.RANKS)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~language.held_out("doc_id", 3, 1))
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.fit_quality(docs, labels))
    return scored.select("doc_id", language.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language_id(docs.where(~language.held_out("doc_id", 5, 0)))
    got = language.predict_language(docs.select("doc_id", "text"), model)
    return got.select("doc_id", language.held_out("doc_id", 5, 0).alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_paths())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_html, op3_decontaminate, op4_substring, op5_quality, op6_language, op7_packing, op8_pii, op9_neardup, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s QUALIFY rank <= 5
        """,
        "op4_substring": r"""
            WITH d AS (
                SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
            ), win AS (
                SELECT doc_id, p, md5(array_to_string(w[p : p + 12], ' ')) AS h
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)
            ), src AS (
                SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
            ), gone AS (
                SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN src USING (h) WHERE doc_id > lo
            ), words AS (
                SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
            ), kept AS (
                SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
            )
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
            FROM d LEFT JOIN kept k USING (doc_id)
        """,
        "op9_neardup": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
            ), sh AS (
                SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
            ), n AS (
                SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
            ), pairs AS (
                SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
            ), links AS (
                SELECT a, b, c = x.n AND c = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
            ), reach AS (
                SELECT doc_id, doc_id AS root FROM documents UNION SELECT a, root FROM reach JOIN links ON b = doc_id
            )
            SELECT r.doc_id, min(r.root) AS class_id, least(r.doc_id, any_value(c.copy_id)) AS copy_id, coalesce(any_value(c.n), 0) AS n_links
            FROM reach r LEFT JOIN (SELECT a, min(b) FILTER (WHERE same) AS copy_id, count(*) AS n FROM links GROUP BY a) c ON c.a = r.doc_id GROUP BY r.doc_id
        """,
    }
