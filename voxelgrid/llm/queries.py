"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op10_exact_topk"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Windows of three lines that are not blank; every occurrence but the first covers its lines.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs}
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM lines WHERE trim(line) <> ''
), windows AS (
  SELECT doc_id, r, trim(line) AS a, lead(trim(line)) OVER d AS b, lead(trim(line), 2) OVER d AS c FROM solid WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, r FROM (SELECT doc_id, r, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, r) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, r + k AS r FROM later, (VALUES (0), (1), (2)) o(k)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.r IS NULL) AS text, count(g.r) AS n
  FROM lines l LEFT JOIN solid s ON l.doc_id = s.doc_id AND l.i = s.i LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.r = g.r GROUP BY l.doc_id
)
"""
ORACLE_SQL["op4_line_dedup"] = LINE_DEDUP_SQL.format(docs="documents") + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_overlaps

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import remove_repeated_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs, removed_col="n_removed")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_files

    docs = _table(spark, sf_dir, "documents")
    folder = token_files.token_folder(docs)
    shards = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return token_files.read_tokens(shards, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.fit(docs, use=~F.coalesce(held_out, F.lit(False)))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents")).drop("node")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score_documents

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    rows = score_documents(docs, train="train").withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import reply_order

    return reply_order(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, scale=64)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_jaccard_join,
        op2_bpe_encoding,
        op3_benchmark_decontamination,
        op4_line_dedup,
        op5_token_files,
        op6_language_id,
        op7_substring_dedup,
        op8_lm_scoring,
        op9_chat_formatting,
        op10_exact_topk,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
