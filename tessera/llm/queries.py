"""The queries of this package with production parameters, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bit_packing, erasure, hard_negatives, line_dedup, multi_index, near_duplicates, packing, partial_matching, private_data, quality_rules, sentence_pieces, sql, toxic_spans, virtual_slots


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_packing.token_files(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), 50_257)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    text = F.coalesce("text", F.lit(""))
    return clean.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op5_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_matching.scored(_table(spark, sf_dir, "documents"), remainder(10) == 0)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.found(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", private_data.spans_text("spans").alias("spans"))


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxic_spans.fit(docs, _table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxic_spans.scored(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.erasure(*[_table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines")])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.sharded(_table(spark, sf_dir, "documents"), 16)


def queries():
    return {
        "op1_multi_index": op1_multi_index,
        "op2_packing": op2_packing,
        "op3_token_files": op3_token_files,
        "op4_line_dedup": op4_line_dedup,
        "op5_partial_matching": op5_partial_matching,
        "op6_private_data": op6_private_data,
        "op7_toxic_spans": op7_toxic_spans,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_quality_rules": op9_quality_rules,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_erasure": op11_erasure,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_virtual_slots": op13_virtual_slots,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
