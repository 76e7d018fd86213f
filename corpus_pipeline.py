"""The corpus pipeline: documents through five stages of tabloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read back as the
next stage's docs. All but the last return the columns of documents, and any others that docs has, whatever their names.
For all stages: an empty table gives an empty table; repeated rows of an id are kept or dropped together; rows with a null
id are dropped by no stage, as nothing names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, near_dup, packing, pii, toxicity
from tabloom.llm.common import cut, table

#: Keyed permutations of private values; a deployment sets its own.
KEY = "pipeline-key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic (score >= 0.5) by a model learned from labels outside held_out.

    Null and empty texts are scored like any other; without labels of both classes nothing goes.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Word shingles as everywhere: five words and a similarity of 0.8 (op3's contract has 0.85). Null and empty texts are in
    no group and stay.
    """
    return near_dup.keep_one(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of benchmark, in any case or with other slot values.

    Null and empty texts hold nothing; an empty benchmark drops nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values of text replaced by pseudonyms; all rows stay; n_chars, if there, is counted anew.

    A null text stays null.
    """
    out = pii.pseudonymise(docs, KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document (another schema than documents). A null text is the end id alone.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", hide_private),
    ("packing", pack),
]

#: Trees, MinHash components and token ids have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
