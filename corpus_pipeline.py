"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes documents with NULLs in any column, empty and very long texts, repeated rows and columns of its own
names. A NULL, empty or blank text fails the quality rules and goes in the first stage; NULL ids and languages stay; of repeated rows
one is left by the near-dedup stage; further columns are kept up to packing. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latewing.llm import line_dedup, near_copies, packing, quality_model, quality_rules, simhash
from latewing.llm.common import table
from latewing.session import staged


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, learned from the labels of those it is given."""
    return quality_model.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share."""
    return line_dedup.drop_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: first of texts whose five-word shingles are similar to 0.8 or more, then of op3's four bits."""
    return simhash.one_of_each(staged(near_copies.one_of_each(docs), "shingle-near-dedup"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack(packing.cut_pieces(docs))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("line dedup", lines),
    ("simhash near-dedup", near_dedup),
    ("best-fit packing", pack),
]

#: Two of the stages learn or tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
