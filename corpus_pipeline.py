"""A corpus pipeline: toxicity, SimHash near-dedup, substring dedup, benchmark decontamination, byte-level BPE.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of documents, whatever other
columns there are and however they are named. The first four filter or rewrite rows, the last encodes what is left. An
empty table gives no rows in any stage; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.alike import drop_near_duplicates
from gneiss.llm.bpe import encode_decode
from gneiss.llm.common import table, written
from gneiss.llm.decontaminate import drop_contaminated
from gneiss.llm.substring import cut_repeats
from gneiss.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the severity model, fitted on labels, does not reject.

    Null and empty texts stay, repeated rows are judged alike, without labels all rows stay.
    """
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose SimHash fingerprints are linked (3 bits or fewer, in any number of steps, as in op3) the first; of
    these, rows that are not alike (5-word shingles, Jaccard >= 0.8, counted exactly) to an earlier one that stays.

    The order is that of doc_id, null ones last; of rows equal in all that counts one stays, and so one of all blank texts.
    """
    return drop_near_duplicates(docs, prints=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words under repeated windows.

    Null, empty and short texts stay as they are; rows that repeat each other lose what they share, but stay.
    """
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which under a twentieth of the words lie in benchmark windows.

    Null and empty texts stay; an empty benchmark leaves all rows.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, well_formed and ids of every row; null texts count as empty."""
    return encode_decode(docs, ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The classifier of the first stage is trained, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
