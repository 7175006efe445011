"""Five stages over ``documents``, each one operator, each written as Parquet and read again by the next.

Defined results are those of the operators (see their modules): null and letterless texts have no language and go in
the first stage as rejected; later stages take a null text as empty. A very long text is handled alone. Rows with a
null ``doc_id`` stay, once for each text that no row with an id has; of repeated rows one stays. An empty table passes
through. All stages but the last keep every column, whatever its name, ``lang`` and ``n_chars`` brought up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chiasma.llm import language, mixing, near_dup, packing, pii
from chiasma.llm._store import fresh_folder
from chiasma.llm.queries import tokenizer_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and those without letters; a missing language is filled by the predicted one."""
    from pyspark.sql import functions as F

    kept = language.identify(docs, prefix="_stage_").filter("not _stage_rejected")
    return kept.withColumn("lang", F.coalesce("lang", "_stage_lang_pred")).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the smallest id."""
    return near_dup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 ids with their places in the sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
