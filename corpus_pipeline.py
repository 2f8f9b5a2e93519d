"""A corpus pipeline of five stages; each writes Parquet that the next one reads.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.op5_language_id import known_language
from graphloom.llm.op6_byte_bpe import encode_stage
from graphloom.llm.op8_mixing import mix
from graphloom.llm.op9_pii import without_pii
from graphloom.llm.op10_simhash import keep_one
from graphloom.scratch import Scratch

STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", keep_one),
    ("pii", without_pii),
    ("mixing", mix),
    ("byte_bpe", encode_stage),
]

#: Fingerprints, prototypes and rates aren't SQL; tests/llm compares the stages' rows with plain Python, given the mixing operator's rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
