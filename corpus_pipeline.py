"""The corpus pipeline: toxic documents go, repeated lines go, near duplicates go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir), with docs the Parquet that the stage before wrote, and decides on all of it. All
but the last return the columns of documents (n_chars is that of the new text). Nothing else removes rows: a document
whose lines all repeat earlier ones stays with an empty text. Rows are told apart by themselves, whether ids are null or repeat.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, near_duplicates, packing, private_data, toxic_spans
from tessera.llm.queries import remainder
from tessera.llm.shared import stored


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic_spans.without_toxic(docs, toxic_spans.fit(docs, labels, remainder(4) != 2))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_dedup.deduplicated(docs, least=1))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.without_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(private_data.redacted_documents(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("PII", private), ("best-fit packing", sequences)]
#: The field, the tokenizer and the plan have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
