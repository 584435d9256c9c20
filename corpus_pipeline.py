"""The corpus pipeline: language ID, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs. All but
the last return the columns of docs, whatever these are beside doc_id, text, lang and source.

Defined cases. Null, empty and letterless texts go in the first stage. Null doc_ids, languages and sources stay as they are; rows that repeat a
document are its copies, of which the second stage keeps one. Texts of any length are taken whole. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh, stored
from quern.llm.language import UNKNOWN, identify, remainder, train
from quern.llm.mixing import mix
from quern.llm.neardup_text import without_near_duplicates
from quern.llm.packing import pack

def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: texts without a letter go, whatever the score of the others; lang becomes the language found."""
    own = fresh(docs, "lang_found"), fresh(docs, "lang_score")
    found = identify(docs, train(docs, remainder(F.col("doc_id")) != 0), columns=own)
    kept = found.where(F.col(own[0]) != UNKNOWN)
    return kept.withColumn("lang", F.col(own[0])).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates stays."""
    return without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as its source's target asks."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of sequences, with their ids."""
    return pack(docs, with_ids=True)


STAGES = [("language ID", identified), ("near-duplicates", deduplicated), ("mixing", mixed), ("packing", packed)]
#: No stage but the first two has rows that SQL can express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
