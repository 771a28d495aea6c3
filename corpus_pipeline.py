"""A training corpus from ``documents``: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder of ``spark.checkpoint.dir`` and gives it, read again, to the next stage. All
stages but the last return the columns of documents:

1. ``quality``: documents that the rules reject go; lines that fail are removed from the others.
2. ``near_duplicates``: of documents linked by shingles, directly or through others, the one with
   the smallest id stays.
3. ``secrets``: found spans become ``[SECRET]``.
4. ``mix``: each document as many times as the mix of the sources takes it.
5. ``pack``: the pieces of the packed token sequences.

Rows are handled as the operators' docstrings say; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellscope.llm import jaccard, mixing, packing, quality, secrets
from cellscope.session import scratch_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality", clean), ("near_duplicates", deduplicate), ("secrets", redact), ("mix", mix), ("pack", pack)]

#: Component search and packing have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
