"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding, each stage written and read again.

Every stage but the last returns the columns of its input, whatever they are called, and reads doc_id, text, lang and source alone.
An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import decontamination, language_id, mixing, near_dedup, sharding
from limnos.llm.common import discard, materialize, table, unused
from limnos.llm.queries import held_out

N_SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the network puts in a language it learned, by prediction and score. `lang` stays as it was.

    Null, empty and letterless texts go; where no row is labelled, every text with a letter stays. Very long texts are judged whole,
    repeated rows alike.
    """
    return language_id.in_learned_language(docs, language_id.train(docs.where(~held_out()), reject=True))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id: five-word shingles, similarity 0.8 or more.

    Rows without id or words stay. A row goes by its id and text together; rows that repeat the kept one in both stay with it.
    """
    return near_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and wordless texts hold none; an empty benchmark leaves all."""
    leak = unused(docs, "_leak")["_leak"]
    out = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), out=leak)
    return out.where(F.size(F.col(f"{leak}.spans")) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document, sources weighted by temperature to the budget of all tokens. A null source is one of its own; wordless documents are drawn in whole passes."""
    return mixing.mix(docs, plain=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn rows with size, text_crc32, law, shard and slot (which replace columns of those names). Repeated draws get slots of their own; null text has size 1."""
    return sharding.shard_documents(docs, n_shards=N_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained model decides the first stage: SQL can't express it. Tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
