"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Rows that the quality classifier rejects go; of each group of near-duplicates one document stays;
documents with a benchmark item go; the rest is put in the order of the Pfair mix of its sources,
which the files keep; the last stage writes token ids in that order and reads them back.
The pipeline fits a classifier and tokenises, which SQL cannot express: tests compare it with a
brute-force version instead.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontamination import decontaminated
from tessera.llm.ngram_join import one_of_each_group
from tessera.llm.quality import good_documents
from tessera.llm.source_mixing import in_mixed_order
from tessera.llm.token_counts import tokenizer_text
from tessera.llm.token_output import TOKENIZER, read_ids, write_token_files
from tessera.session import materialize, scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns that order it: place in its files, or doc_id if it is not read from files."""
    try:
        meta = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_no"))
    except AnalysisException:
        return docs, ["doc_id"]
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    return meta.withColumn("part", part), ["part", "file", "row_no"]


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, order = in_file_order(docs)
    path = scratch_path(spark, "pipeline-tokens")
    write_token_files(docs, tokenizer_text(TOKENIZER), path, order)
    return read_ids(spark, path, with_ids=False).select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents and return the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
