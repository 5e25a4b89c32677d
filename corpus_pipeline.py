"""The corpus pipeline: from documents to packed training sequences, one durable table a stage.

Quality classifier and quality rules drop rejected documents, of each group of near duplicates one
stays, repeated passages are cut out, and what is left is packed into sequences of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtable.llm import common, compression_quality, ngram_join, packing, paragraphs, quality_rules

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality classifier", compression_quality.keep_stage),
    ("quality rules", quality_rules.keep_stage),
    ("n-gram Jaccard join", ngram_join.keep_one_stage),
    ("substring dedup", paragraphs.remove_stage),
    ("best-fit packing", packing.pack_stage),
]

#: SQL can express neither the trained stages nor the sketches; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; each earlier stage is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.spool(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
