"""From raw documents to packed training sequences, in stages that each read what the stage before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aphora.llm import language, leaks, near, packing, repeats
from aphora.llm.queries import tokenizer_path
from aphora.llm.tables import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Language ID, near-duplicate classes and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; only those that op9 calls unknown, without letters, go."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    judged = language.identify(docs.select(*COLUMNS), model, carry=COLUMNS)
    return judged.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that with the smallest id; repeated rows of it become one."""
    return near.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of long passages that stand anywhere else."""
    return repeats.without_repeats(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return leaks.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("language ID", identify),
    ("near duplicates", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
