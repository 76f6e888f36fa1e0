"""Metrics of retrieval and of answers, as aggregates over one row a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import chunk_number, has_digit

RANK_KS = (1, 3, 5)


def mean(x: Column) -> Column:
    """To four decimals, 0 for nothing."""
    return F.coalesce(F.round(F.avg(x), 4), F.lit(0.0))


def is_negative() -> Column:
    return F.size(F.coalesce("relevant", F.array().cast("array<string>"))) == 0


def ranks(ranked_videos: DataFrame, golden: DataFrame) -> DataFrame:
    """golden with `rank`: the place of the first relevant video (query_id, video_id, video_rank)."""
    hit = ranked_videos.join(golden.select(F.col("id").alias("query_id"), "relevant"), "query_id").filter(F.array_contains("relevant", F.col("video_id")))
    first = hit.groupBy("query_id").agg(F.min("video_rank").alias("rank"))
    return golden.join(first, golden.id == first.query_id, "left").drop("query_id")


def context_scores(passages: DataFrame, golden: DataFrame) -> DataFrame:
    """id, ctx_precision and edge: shares of passages from relevant videos, and of those that begin with a video's first chunk."""
    rows = passages.join(golden.select(F.col("id").alias("query_id"), "relevant"), "query_id")
    good = F.array_contains("relevant", F.col("video_id")).cast("double")
    edge = (chunk_number(F.get("chunk_ids", F.lit(0))) == 0).cast("double")
    return rows.groupBy(F.col("query_id").alias("id")).agg(F.avg(good).alias("ctx_precision"), F.avg(edge).alias("edge"))


def _tenth(scores: DataFrame) -> DataFrame:
    """One row: of `score`, to four decimals, the value a tenth of the way up by rank; null for nothing.

    Rounding keeps the order, so equal rounded scores are counted first, and only their counts (10,001 at most for scores of
    0 to 1) are put in order.
    """
    counted = scores.groupBy(F.round("score", 4).alias("score")).count()
    placed = counted.withColumns({"upto": F.sum("count").over(Window.orderBy("score")), "whole": F.sum("count").over(Window.partitionBy())})
    return placed.filter(F.col("upto") > F.floor(F.col("whole") / 10)).agg(F.min("score").alias("tenth"))


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """One row from (relevant, rank, ctx_precision, edge, prod_score); `rank` is null for what wasn't found."""
    positive = ~is_negative()
    score = F.when(positive & F.col("rank").isNotNull(), F.col("prod_score"))
    negative = F.when(is_negative(), F.col("prod_score"))
    both = (F.count(score) > 0) & (F.count(negative) > 0)
    out = rows.agg(
        F.count_if(positive).alias("n"),
        mean(F.when(positive, F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr"),
        *(mean(F.when(positive, F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"hit_{k}") for k in RANK_KS),
        mean(F.when(positive, F.col("ctx_precision"))).alias("ctx_precision"),
        mean(F.when(positive, F.col("edge"))).alias("edge_rate"),
        F.when(both, F.round(F.min(score), 4)).alias("pos_score_min"),
        both.alias("both"),
        F.when(both, F.round(F.max(negative), 4)).alias("neg_score_max"),
        F.when(both, mean(negative)).alias("neg_score_mean"),
    )
    tenth = _tenth(rows.select(score.alias("score")).filter("score is not null"))
    joined = out.withColumn("one", F.lit(1)).join(tenth.withColumn("one", F.lit(1)), "one").drop("one")
    return joined.withColumn("both", F.when(F.col("both"), F.col("tenth"))).withColumnRenamed("both", "pos_score_p10").drop("tenth")


def by_kind(rows: DataFrame) -> DataFrame:
    """n, hit_1 and hit_3 of positives by kind."""
    hit = lambda k: mean(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}")
    return rows.filter(~is_negative()).groupBy("kind").agg(F.count("*").alias("n"), hit(1), hit(3))


def missed(rows: DataFrame) -> DataFrame:
    """Positives that weren't found."""
    return rows.filter(~is_negative() & F.col("rank").isNull())


def answer_summary(rows: DataFrame) -> DataFrame:
    """One row from (relevant, expect_found, found, source, steps, ingredients, error); errors count in n alone."""
    ok = F.col("error").isNull()
    told = ok & F.col("found") & ~is_negative()
    amounts = F.size(F.filter("ingredients", has_digit)) / F.size("ingredients")
    return rows.agg(
        F.count("*").alias("n"),
        mean(F.when(ok, (F.col("found") == F.col("expect_found")).cast("double"))).alias("found_acc"),
        mean(F.when(told, F.coalesce(F.array_contains("relevant", F.col("source.video_id")), F.lit(False)).cast("double"))).alias("attribution"),
        mean(F.when(told, F.size("steps"))).alias("avg_steps"),
        mean(F.when(told, F.size("ingredients"))).alias("avg_ingredients"),
        mean(F.when(told & (F.size("ingredients") > 0), amounts)).alias("with_amounts"),
    )


def found_mismatches(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull() & (F.col("found") != F.col("expect_found")))


def p10(scores: DataFrame, by: str, score: str) -> DataFrame:
    """Of each group the value a tenth of the way up, by rank; for groups too large to gather."""
    w, whole = Window.partitionBy(by).orderBy(score), Window.partitionBy(by)
    rows = scores.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(whole)})
    return rows.filter(F.col("i") == F.floor(F.col("n") / 10) + 1).select(by, F.col(score).alias("p10"))
