"""From documents to padded training batches, in five stages.

Each stage works on what the one before kept, written as Parquet in between:
quality rules drop documents, line dedup deletes repeated runs of lines, SimHash
keeps one document of each near-duplicate group, decontamination drops documents
with benchmark passages, and packing gives each document its batch.

Defined results: a stage takes nulls, ties, repeated rows, empty and very long texts as
its operator states; all but the last keep every column of the documents, whatever its
name; documents that line dedup emptied are near copies of each other, so one of them
stays; an empty table goes through.  Language, URL and HTML filters work on other
inputs and decide before documents are a table, and token files take the documents that
remain (``tokenfiles.write_tokens``), so none of them is a stage here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coppice.llm import decontam, linededup, packing, quality, simhash
from coppice.llm.storage import discard, stored, working_tables
from coppice.llm.tokencount import MODEL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(docs, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has no XXH64 and no byte-pair merging; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with working_tables(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name)
        discard(spark, old + made[:-1])  # all but the stage's own table, which was made last
        old = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
