"""The queries of this subpackage: thin, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.links(_table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(bpe.codec(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ogg

    return ogg.digests(ogg.from_media(ogg.to_media(_table(spark, sf_dir, "documents"))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_counts

    return piece_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import records

    manifest = records.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return records.read(spark, manifest).select("doc_id", "start", F.expr("CAST(length(ids) / 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rnn_lm

    return rnn_lm.score(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.digests(chat.format_conversations(chat.with_control(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP10_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
    SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS body,
        replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;') AS head
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(8 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": OP10_SQL}
