"""A corpus made ready for training, in five stages.

Each stage takes all its predecessor kept and hands on the columns of ``documents``; the
last one adds the shard. Every stage's rows are written as Parquet and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablekin.llm import decontamination, mixing, placement, simhash, toxicity
from tablekin.llm.common import table
from tablekin.session import settle

#: How often mixing may use the tokens of a source, on average.
REPEATS = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and some of the smaller sources' twice: no budget is set, so
    mixing takes each source whole and repeats it as its weight asks."""
    planned = mixing.plan(docs, mixing.Target(repeats=REPEATS))
    # Under a name of its own, so that no column of the documents gets lost.
    return mixing.realise(mixing.copies(docs, planned, name="__copies"), "__copies")


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the slot and the shard of their doc_id."""
    return placement.place(docs, "doc_id", placement.names(placement.SHARDS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The trained classifier of the first stage cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
