"""A corpus pipeline of five stages, each one operator over all rows that the stage before kept.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark item go, secrets
are masked in the texts, and what remains is encoded. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from methyra.llm import op1_toxicity, op2_decontaminate, op5_minhash, op7_bpe, op9_secrets
from methyra.llm.common import scratch, spread, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op1_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = op1_toxicity.score(spread(docs.select(*COLUMNS), "doc_id", "text"), model, tuple(COLUMNS))
    return scored.where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_minhash.one_of_each(docs.select(*COLUMNS), 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_secrets.masked(docs.select(*COLUMNS), f"{scratch(spark)}/ledger")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dealt = spread(docs.select(*COLUMNS), "doc_id", "text")
    return op7_bpe.encoded_intact(dealt, op7_bpe.default_vocabulary(), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: Support vector machines, ledgers and merges by rank are not SQL; the tests hold near duplicates, decontamination, secrets and
#: encoding against brute force, and toxicity against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
