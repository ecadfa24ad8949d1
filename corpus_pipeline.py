"""A training corpus from documents in five stages, each one operator of attestary.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestary.llm.common import table, written
from attestary.llm.decontamination import without_benchmark
from attestary.llm.packing import pack
from attestary.llm.simhash import deduplicated
from attestary.llm.suffix_dedup import without_repeats
from attestary.llm.toxicity import without_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go.

    Null and empty texts have no words and follow the labels' share; null ids and repeated rows are judged by their text; without labels of
    both kinds all stay; an empty table stays empty; columns of any name are kept."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), categories=4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the least id, equal ids in order of a hash of id and text.

    Null and empty texts are one group; a row without an id stands only for a group that has no other; of equal rows one stays; an
    empty table stays empty; columns of any name are kept."""
    return deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a 200-byte string that starts elsewhere too are cut out of the text; a text that loses all goes.

    Null and empty texts stay as they are; null ids count like any other; of repeated rows all lose what is 200 bytes or longer; an empty
    table stays empty; columns of any name are kept."""
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers and names, go.

    Each row is judged by its own text, whatever its id; null and empty texts stay; without items all stay; an empty table stays empty;
    columns of any name are kept."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes training sequences of 2048 ids.

    Null and empty texts are one id, the end; null ids stay null; repeated rows are packed each; an empty table gives no piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: SQL can't express classifiers, suffix arrays or tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
