"""From raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of ``documents``.
Null or empty texts, repeated rows and extra columns pass as the operators define; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import packing, simhash, substrings, surrogates, toxicity
from gaugework.llm.common import shared_folder, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", simhash.stage),
    ("repeated_passages", substrings.stage),
    ("surrogates", surrogates.stage),
    ("packing", packing.stage),
]

#: Learned weights, keyed surrogates and token ids have no SQL; tests check the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is kept between them lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
