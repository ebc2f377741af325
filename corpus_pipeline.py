"""A corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's documents.

Defined results: null and empty texts are documents like any other; at most one
without words stays, as they are near-duplicates. Repeated rows (equal id and text)
are one document after the third stage. Of equal scores, ids and runs the stages'
own modules say what stays. Columns beside those of documents are kept by all stages
but the last, whatever their names. Empty tables, of documents, labels or benchmark
items, give empty results or nothing to reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velora.llm import decontaminate, line_dedup, near_texts, quality, sentencepiece_fst
from velora.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go, and documents of which nothing is left."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_texts.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two or more benchmark items go; a single item's passage is cut out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and the text decoded from the ids."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_fst.round_trip(docs, path).select("doc_id", "n_tokens", "ids", "ids_crc32", "text")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: No stage but the last two could be stated in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
