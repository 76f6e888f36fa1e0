"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of `documents`. `run` writes every stage's rows to the shared folder and reads them again for the next.

In every stage: all columns of the input pass through whatever their names, but for the last, which returns token pieces; a null text is
an empty one, and stays null where it is kept; texts of any length are worked on whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import materialize, table
from quillspark.llm.decontam import without_contaminated
from quillspark.llm.linededup import without_shared_lines
from quillspark.llm.neardup import one_of_near_copies
from quillspark.llm.packing import pack_documents
from quillspark.llm.quality import keep_good
from quillspark.llm.queries import tokenizer_file
from quillspark.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: by the base rules (fewer than 20 words among them, so null and empty texts), or as outliers of their group.

    Rows are judged one by one, repeated ones alike; a null language or source is a group of its own."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the largest doc_id that holds them.

    Rows that repeat a doc_id count as one document; no row goes, however little is left of it; n_chars follows the text."""
    return without_shared_lines(docs, min_length=40, min_docs=5)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id, then the smallest text hash.

    Copies are texts whose SimHash fingerprints (four-word shingles, by op5) differ in at most 4 of 64 bits, and texts whose five-word
    shingles are alike by 0.8 or more, which fingerprints that near seldom reach; links of both kinds join in one group.

    Rows that repeat a text are copies of one another, as are null and empty texts; a null doc_id stays only where it has no copy with one."""
    ship(spark)
    return one_of_near_copies(docs, width=5, similarity=0.8, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go: those of which a twentieth of the words or more lie in 13-word windows of an item.

    Rows that repeat a doc_id are judged row by row; null and empty texts, and an empty benchmark, match nothing."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), size=13)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their training sequence and place; a null or empty text is its end id alone, repeated rows are packed each."""
    ship(spark)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the robust estimates, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
