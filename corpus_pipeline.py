"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

1. quality rules: documents that the current policy rejects go;
2. n-gram Jaccard join: of each group of near duplicates one document stays, that of least doc_id;
3. personal data: all spans are masked in the text;
4. mixing: sources are taken up to their target shares, a row for each pass, sorted along the curriculum;
5. packing: pieces of token sequences.

All but the last stage return the columns of ``documents``.  Each stage works on every row that it gets; nulls, empty
texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardstream.llm.common import Scratch, table
from wardstream.llm.mixing import mixed_documents
from wardstream.llm.ngram_join import one_of_each
from wardstream.llm.packing import pack
from wardstream.llm.pii import masked_documents
from wardstream.llm.quality import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked_documents(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Personal data by a model and ids by a tokenizer have no SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
