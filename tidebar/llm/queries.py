"""The operators' queries over the tables in a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import chat, fingerprints, language_id, mixing, packing, pii, secrets, simhash, suffix_dedup, topk_search


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(_read(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": _documents(suffix_dedup.suffix_dedup),
    "op2_document_fingerprints": _documents(fingerprints.edited_fingerprints),
    "op3_exact_topk_search": lambda spark, sf_dir: topk_search.topk_search(_read(spark, sf_dir, "embeddings")),
    "op4_pii": _documents(pii.report),
    "op5_secret_scans": _documents(secrets.report),
    "op6_best_fit_packing": _documents(packing.pack),
    "op7_mixing": _documents(mixing.mix),
    "op8_language_id": _documents(language_id.identify),
    "op9_chat_formatting": op9_chat_formatting,
    "op10_simhash_near_dedup": _documents(simhash.near_duplicates),
}

ORACLES: dict[str, str] = {
    "op3_exact_topk_search": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id
        ), w AS (SELECT vec_id, list_transform(e, lambda x: floor(1024 * x)) AS e FROM v),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM w q JOIN w c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
    """,
    "op9_chat_formatting": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                   string_agg(md5(coalesce(role, '') || chr(31) || coalesce(text, '')), ',') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
            FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
        ), full_logs AS (SELECT conv_id, n_turns, prefix FROM t WHERE k = n_turns),
        kept AS (
            SELECT n_turns, min(conv_id) AS conv_id FROM full_logs
            WHERE prefix NOT IN (SELECT prefix FROM t WHERE k < n_turns) GROUP BY n_turns, prefix
        ), r AS (
            SELECT t.conv_id, t.n_turns,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS body
            FROM t JOIN kept ON t.conv_id = kept.conv_id GROUP BY t.conv_id, t.n_turns
        )
        SELECT conv_id, n_turns, length(body) AS n_chars, sha256(body) AS text_sha256 FROM r
    """,
}
