"""A training-corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Every stage works on all that its predecessor kept. The
near-duplicate stage takes candidates from op5's index and from its wide form, see trailmark/llm/shingle_links.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import bpe_automaton, decontamination, language_id, line_dedup, shingle_links
from trailmark.llm.common import dropped, table, temporary, written

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", shingle_links.stage),
    ("decontamination", decontamination.stage),
    ("bpe_encoding", bpe_automaton.stage),
]

#: A trained network and a tokenizer can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with temporary(spark) as keep:  # what a stage wrote on its way goes once its result is written
            before, docs = docs, keep(written(spark, stage(spark, docs, sf_dir), name))
        if k:
            dropped(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
