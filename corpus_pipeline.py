"""A corpus pipeline over documents: quality rules, line dedup, n-gram Jaccard join, source mix, packing.

Each stage reads all rows that its predecessor kept. All but the last return the columns of documents, whatever they are called; copies of a
document in the mix are rows of their own.

Defined cases: rows with a null or empty text fail the quality rules and go; a null id or source passes through like any other value; an
empty documents or labels table gives an empty result, or one without learned rules; repeated rows are judged each, and line dedup and the Jaccard join
take equal rows of one id for one document, of which one stays; ties are settled by id and text hash. A document that loses its last
line goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from keystrata.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduped(docs, exact=line_dedup.EXACT)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, words=5, threshold="0.8")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: The learned rules, the schedule and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
