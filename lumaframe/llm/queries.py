"""The subpackage's queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm import filter_audit, licenses, personal_data, resampling
from lumaframe.llm.ann import nearest
from lumaframe.llm.html_text import extract_text
from lumaframe.llm.line_dedup import dedup_lines
from lumaframe.llm.mixing import mix_sources
from lumaframe.llm.near_dedup import near_duplicates
from lumaframe.llm.packing import pack_documents
from lumaframe.llm.quality_rules import fit_rules, judge_quality
from lumaframe.llm.quotes import link_quotes
from lumaframe.llm.token_counts import token_counts

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = judge_quality(docs.select("doc_id", "text"), fit_rules(docs, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_corpus(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10000, percent=10, least=20, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_near_dedup, op2_line_dedup, op3_quality_rules, op4_token_counts, op5_license_scan, op6_nearest_vectors, op7_chat_format, op8_packing, op9_mixing, op10_html_text, op11_filter_audit, op12_personal_data, op13_resampling]
    return {f.__name__: f for f in made}


_LINES = """
    WITH flat AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
    solid AS (SELECT doc_id, k, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM flat WHERE NOT regexp_full_match(s, '[\\x20\\x09-\\x0D]*')),
    win AS (SELECT a.doc_id, a.k AS k0, b.k AS k1, c.k AS k2, {'a': a.s, 'b': b.s, 'c': c.s} AS w
            FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN solid c ON a.doc_id = c.doc_id AND c.n = a.n + 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, k0) AS r FROM win),
    gone AS (SELECT doc_id, k0 AS k FROM ranked WHERE r > 1 UNION SELECT doc_id, k1 FROM ranked WHERE r > 1 UNION SELECT doc_id, k2 FROM ranked WHERE r > 1),
    kept AS (SELECT flat.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed, coalesce(string_agg(s, chr(10) ORDER BY flat.k) FILTER (WHERE gone.k IS NULL), '') AS t
             FROM flat LEFT JOIN gone ON flat.doc_id = gone.doc_id AND flat.k = gone.k GROUP BY 1)
    SELECT d.doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, md5(t) AS text_md5 FROM documents d LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _LINES, "op5_license_scan": licenses.oracle(), "op11_filter_audit": filter_audit.oracle(), "op13_resampling": resampling.oracle()}
