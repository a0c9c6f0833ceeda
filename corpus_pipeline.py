"""The corpus pipeline: stages that each apply one operator of
``tillpoint.llm`` to whole documents, in order.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return the columns of ``docs``.  Null and
empty texts, repeated rows and empty tables pass through as the operators
define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.catalog import vocabulary
from tillpoint.llm.common import table
from tillpoint.llm.line_dedup import without_repeated_lines
from tillpoint.llm.mixing import mix
from tillpoint.llm.near_dedup import one_of_each_group
from tillpoint.llm.packing import pack_documents
from tillpoint.llm.quality import featurised, fit, passing

#: Words of a shingle in the near-dedup stage.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier, learned on the labelled
    documents of the input, does not reject."""
    return passing(docs, fit(featurised(docs).checkpoint(), table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand elsewhere before; every
    document stays, with what remains of its text."""
    return without_repeated_lines(docs, edges=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs, SHINGLE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row for each time.  (None
    is an empty array; a filter on the copies would carry their whole formula,
    many times over, into the join that finds the numbers of a source.)"""
    mixed = mix(docs, keep=tuple(docs.columns))
    return mixed.select("kept", F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("time")).select("kept.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix and their places in sequences."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("packing", packing)]

#: The first stage learns a model and the last one tokenizes: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
