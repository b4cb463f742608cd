"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Toxic documents go, then those without an identified language, then all near-duplicates but one
of a group, then bytes that repeat an earlier long string; what is left is packed. Columns that
documents has besides those used here are carried along to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import jaccard, langid, packing, suffixes, toxicity
from lintel.llm.batches import fresh, shrunk, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those scored 0.5 or more; learnt from all labels."""
    model = toxicity.Toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return model.score(docs, extra=tuple(docs.columns), name=score).filter(F.col(score) < 0.5).drop(score)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in no learnt language: no letter, or like none more than letters are by chance."""
    if docs.filter("lang is not null").isEmpty():
        return docs  # nothing to learn from, so nothing to reject by
    names = fresh(docs, "lang_pred"), fresh(docs, "score"), fresh(docs, "known")
    return langid.identified(docs, docs, extra=tuple(docs.columns), names=names).filter(F.col(names[2])).select(docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near-duplicates, also among rows that share an id; rows without an id stay."""
    key = fresh(docs, "own_row")
    rows, _ = suffixes.placed(docs, key)
    kept = jaccard.joined(rows.filter(F.col(key).isNotNull()), key=key).filter(F.col(key) == F.col("component_id")).select(key)
    return rows.join(kept, key, "left_semi").select(docs.columns).union(rows.filter(F.col(key).isNull()).select(docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their texts less long strings that occur earlier; n_chars follows."""
    return suffixes.shortened(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


def alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, begun with heaps that hold no room that other stages asked for."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrunk(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", alone(drop_toxic)),
    ("language_id", alone(keep_identified)),
    ("jaccard_join", alone(keep_representatives)),
    ("suffix_dedup", alone(drop_repeats)),
    ("packing", alone(pack)),
]

#: No stage's decisions can be stated in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
