"""The corpus pipeline: documents through five stages, each written and reread.

Every stage works on all that its predecessor kept, and all but the last
return the columns of `documents`. Rejected documents, exact copies and near
copies go; secrets are replaced in place; what is left is packed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.llm.common import stored
from lotwise.llm.exact_dedup import drop_copies
from lotwise.llm.near_dedup import drop_near_copies
from lotwise.llm.packing import pack
from lotwise.llm.quality import drop_rejected
from lotwise.llm.secret_scan import redacted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str
                  ) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest doc_id."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest doc_id."""
    return drop_near_copies(docs, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str
                 ) -> DataFrame:
    """All documents, secrets replaced and n_chars adjusted."""
    return redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str
                  ) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage),
          ("exact dedup", exact_stage),
          ("MinHash near-dedup", near_stage),
          ("secret scans", secret_stage),
          ("packing", packing_stage)]

#: The classifier, the sketches and the tokenizer have no SQL form; the tests
#: hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
