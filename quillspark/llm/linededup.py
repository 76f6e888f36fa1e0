r"""Operator 3: drop lines that many documents share, with DataFrame functions only.

Lines are exploded, normalised (white space of `[\x20\x09-\x0D]` off both ends, A-Z lowered) and hashed to 128 bits; a
key of `min_length` code points or more in `min_docs` documents or more loses its lines everywhere but in the largest
doc_id that holds it. Only hashes and positions are shuffled for counting. The count is of distinct (key, document)
pairs, so a key that a third of all documents hold is spread over documents first and then added up map-side; the join
back is an equi-join that adaptive execution can split or turn into a broadcast by measured size. The texts are
shuffled once, to meet the positions that they lose.

Defined results: a null or empty text is one empty line (a null text stays null in the output text); a row's identity is
(doc_id, hash of its text), so rows that repeat a doc_id count as one document and are each cut by the same rule; a
null doc_id holds lines but never counts as a document; an empty table gives an empty result; all columns of the input,
whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, ascii_lower, materialize


def line_key(line: Column) -> Column:
    key = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(ascii_lower(key))


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """`row` (the input's columns), kept_text, n_lines, n_dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.xxhash64(text).alias("version"), F.split(text, "\n", -1).alias("lines"))
    place = base.select("doc", "version", F.posexplode("lines").alias("pos", "line")).select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
    place = place.filter(F.length("key") >= min_length).select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    shared = place.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper")).filter(F.col("n_docs") >= min_docs).drop("n_docs")
    shared = materialize(shared, "shared")  # by itself, so that the join below has its own exchange and its hot keys can be split
    lost = place.join(shared, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc", "version").agg(F.collect_set("pos").alias("lost")).select(F.col("doc").alias("lost_doc"), F.col("version").alias("lost_version"), "lost")
    joined = base.join(lost, F.col("doc").eqNullSafe(F.col("lost_doc")) & (F.col("version") == F.col("lost_version")), "left")
    n_lines = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("lost"))
    whole = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(whole).alias("kept_text"),
        n_lines.cast("bigint").alias("n_lines"),
        F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lost")).cast("bigint").alias("n_dropped"),
    )


def without_shared_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of `docs` with the text that is left; n_chars, if there, follows it."""
    found = dedup_lines(docs, min_length, min_docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return found.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
