"""The corpus pipeline: five operators over documents, each stage written and read again as the next one's input.

A stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.

* language_id drops null texts and texts without a letter. Prototypes are learned from the documents that the stage gets (those
  that aren't held out), and the prediction replaces a null lang; a lang that is given stays. Without prototypes a null lang stays null.
* near_dedup keeps one document of each component at five words and a similarity of 0.8.
* decontamination drops documents that hold ten consecutive words of a benchmark item.
* pii replaces personal data by surrogates.
* bpe adds the ids' digest and count.

Defined cases, by stage: a null or empty text, and one without a letter, goes in language_id; rows that share a doc_id or have none are told apart
by their texts, so only copies and near copies of a text go; of equal candidates near_dedup keeps the smallest doc_id; repeated rows are copies;
texts of any length count whole; columns that documents have besides are kept by all stages, whatever their names (the last replaces those
that are called as its own); empty tables pass through all stages. ``run`` leaves nothing in the shared folder but the checkpoint of its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm import bpe, decontam, langid, neardup, pii
from galena.llm.common import Scratch, checkpoint


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, prototypes, lettered_only=True)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred") if prototypes else F.col("lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs, pii.session_key(spark)).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_surrogates),
    ("bpe", bpe_tokens),
]

#: Cosines of random vectors and keyed surrogates have no SQL form; the tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        before = None
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = scratch.write(docs)
                if before is not None:
                    scratch.remove(before)
                before = docs
        return checkpoint(docs)
