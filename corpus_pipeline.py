"""The corpus pipeline: toxic documents go, then exact and near copies, secrets are masked, and the rest is packed into sequences of token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; the last one a row per sequence, with the ids of the masked texts and the places of the documents in it.

Null texts count as empty: they are clean, copies of each other and of empty ones, in no near group, without secrets, and an end id in a sequence. Of equal texts the row of the largest
doc_id stays, of a near group that of the smallest, and of rows alike in doc_id and text one; null doc_ids never win against others. Texts of any length are read whole; those longer than a
sequence go on in further ones. Further columns come along up to packing, whatever their names, and an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkquarry.llm import exact_dedup, minhash, packing, secrets, toxicity
from inkquarry.llm.common import staged

#: The model, near duplicates and spans have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, words=5, threshold=(80, 100))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("MinHash near-dedup", drop_near_copies), ("secret scans", mask_secrets), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
