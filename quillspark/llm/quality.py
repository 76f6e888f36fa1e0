r"""Operator 4: quality rules by robust multivariate outliers, with DataFrame functions only.

Each text gives a vector of transformed statistics: log of words, mean word length, and square roots of the shares of
symbols, of words in repeated 8-word windows, and of repeated lines. For each language and source a minimum covariance
determinant estimate is made by concentration steps: from three starts, the nearest share H of the group gives mean and
covariance, which give new distances, and so on until no group's determinant falls any more; the start with the smallest
determinant wins. The share is exact up to 10,000 rows a group, and beyond that to one row in 10,000. Texts whose squared
Mahalanobis distance is over the chi-squared bound are rejected.

Every step aggregates with map-side combine over all documents (sums, cross products, mergeable quantile sketches); the
estimates of groups are written and joined back, so a source with a third of all rows is never in one task. A floor on
each variance keeps statistics that are nearly always zero from rejecting a text for its first symbol.

Groups of under `min_group` rows are pooled by language, and then over all. Defined results: null or empty texts have no
words and fail the base rules; a null language or source is a group of its own; repeated rows are judged alike; a pool
of under ten rows rejects nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, materialize, text_version

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Standard deviations below which no group's statistic is taken to vary.
#: Those of shares lie well under 1 / sqrt(CUTOFF) of what base rules leave, so that each can reject a text by itself:
#: from about a sixth of its words in repeated windows, or one duplicate line in 16 words, where a group has neither.
FLOORS = (0.5, 0.35, 0.05, 0.08, 0.05)
P = len(FLOORS)
#: Share of a group that an estimate rests on, and the factor that makes its covariance consistent for normal data:
#: H / P(chi2 with 7 degrees <= 6.626), 6.626 being the H quantile of chi2 with 5 degrees.
H, CONSISTENT = 0.75, 1.41
#: The 0.9999 quantile of chi2 with 5 degrees of freedom.
CUTOFF = 25.745
X = [f"x{i}" for i in range(P)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; kept in the shared folder with a row number `rid`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = docs.select("doc_id", "lang", "source", text_version(F.col("text")).alias("version"), text.alias("text"), F.split(trimmed, _SPACE, -1).alias("w"))
    rows = rows.select("doc_id", "lang", "source", "version", "text", F.when(F.get("w", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("w")).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n = F.size("w")
    windows = F.when(n >= 9, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("w", i, F.lit(8)))))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        "version",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    rows = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "lang",
        "source",
        "version",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).alias("windows"),
    )
    rows = materialize(rows, "counts")
    # Only texts with a repeated window are taken apart.
    places = rows.filter("windows is not null").select("rid", F.posexplode("windows").alias("pos", "h"))
    again = places.groupBy("rid", "h").agg(F.collect_list("pos").alias("at")).filter(F.size("at") > 1).select("rid", F.explode("at").alias("pos"))
    joined = F.array_sort(F.collect_list("pos"))
    per_text = again.groupBy("rid").agg(joined.alias("at"))
    gaps = F.zip_with(F.slice("at", F.lit(2), F.size("at") - 1), F.slice("at", F.lit(1), F.size("at") - 1), lambda b, a: F.least(F.lit(8), b - a))
    covered = per_text.select(F.col("rid").alias("rid2"), (F.aggregate(gaps, F.lit(0), lambda s, g: s + g) + 8).cast("bigint").alias("n_repeat_words"))
    out = rows.drop("windows").join(covered, F.col("rid") == F.col("rid2"), "left").drop("rid2")
    return out.withColumn("n_repeat_words", F.coalesce("n_repeat_words", F.lit(0).cast("bigint")))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log1p("n_words"), F.col("word_chars") / words, F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_dup_lines") / words)]


def _distance(frame: DataFrame) -> DataFrame:
    """Add `d2`, the squared Mahalanobis distance of X from the group's mean under its precision matrix."""
    off = [F.col(x) - F.col(m) for x, m in zip(X, MEAN, strict=True)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i + 1):
            total = total + (2.0 if i != j else 1.0) * F.get("precision", F.lit(P * i + j)) * off[i] * off[j]
    return frame.withColumn("d2", total)


def _invert(cov: Column) -> Column:
    """Inverse and log determinant of a positive definite matrix (row-major array), by one elimination a pivot."""

    def pivot(got: Column, k: Column) -> Column:
        m = got["m"]
        p = F.greatest(F.get(m, k * P + k), F.lit(1e-12))

        def cell(ix: Column) -> Column:
            i, j = F.floor(ix / P).cast("int"), (ix % P).cast("int")
            above, left, own = F.get(m, k * P + j), F.get(m, i * P + k), F.get(m, ix)
            return F.when((i == k) & (j == k), 1.0 / p).when(i == k, above / p).when(j == k, -left / p).otherwise(own - left * above / p)

        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(P * P - 1)), cell).alias("m"), (got["logdet"] + F.log(p)).alias("logdet"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), F.struct(cov.alias("m"), F.lit(0.0).alias("logdet")), pivot)


MEAN = [f"m{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _estimates(frame: DataFrame, *keys: str) -> DataFrame:
    """Mean, precision matrix and log determinant (with floors on the variances) of each group's rows."""
    sums = frame.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(x).alias(m) for x, m in zip(X, MEAN, strict=True)), *(F.avg(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS))
    cov = lambda i, j: (F.col(f"s{max(i, j)}{min(i, j)}") - F.col(MEAN[i]) * F.col(MEAN[j])) * CONSISTENT + (FLOORS[i] ** 2 if i == j else 0.0)
    solved = sums.select(*keys, "n", *MEAN, _invert(F.array(*(cov(i, j) for i in range(P) for j in range(P)))).alias("solved"))
    return materialize(solved.select(*keys, "n", *MEAN, F.col("solved.m").alias("precision"), "solved.logdet"), "estimates")


#: Groups up to this number are sent to every task (under 10 MB); more are joined by shuffling.
FEW_GROUPS = 20_000


def _near(frame: DataFrame, d2: str, few: bool, *keys: str) -> DataFrame:
    """The share H of each group with the smallest distances."""
    bound = frame.groupBy(*keys).agg(F.percentile_approx(d2, F.lit(H), F.lit(10_000)).alias("bound"))
    return frame.join(F.broadcast(bound) if few else bound, list(keys)).filter(F.col(d2) <= F.col("bound")).drop("bound")


def robust_estimates(vectors: DataFrame, few: bool, tolerance: float = 1e-4, most_steps: int = 50) -> DataFrame:
    """`key`, n, mean and precision of each group, by concentration from three starts until no log determinant falls by
    more than `tolerance`. `few`: the groups are counted to be few enough to be sent to every task. `most_steps` only ends
    what rounding might keep in motion: a step never raises a determinant, and there are finitely many subsets."""
    small = F.broadcast if few else (lambda table: table)
    mids = vectors.groupBy("key").agg(*(F.percentile_approx(x, F.lit(0.5), F.lit(10_000)).alias(m) for x, m in zip(X, MEAN, strict=True)))
    mids = materialize(mids, "medians")
    spread = vectors.join(small(mids), "key").groupBy("key").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(m)), F.lit(0.5), F.lit(10_000)).alias(f"a{i}") for i, (x, m) in enumerate(zip(X, MEAN, strict=True))))
    starts = materialize(mids.join(spread, "key"), "starts")
    # Statistics scaled by their median deviation, summed or the largest alone, or scaled by the floor.
    scaled = [((F.col(x) - F.col(m)) / F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + f * f)) ** 2 for i, (x, m, f) in enumerate(zip(X, MEAN, FLOORS, strict=True))]
    floored = [((F.col(x) - F.col(m)) / f) ** 2 for x, m, f in zip(X, MEAN, FLOORS, strict=True)]
    distances = (sum(scaled, F.lit(0.0)), sum(floored, F.lit(0.0)), F.greatest(*scaled))
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), d.alias("d2")) for k, d in enumerate(distances)))).alias("s")
    placed = vectors.join(small(starts), "key").select("key", *X, every).select("key", *X, "s.*")
    estimates = _estimates(_near(placed, "d2", few, "key", "start"), "key", "start")
    for _ in range(most_steps):
        placed = _distance(vectors.join(small(estimates), "key")).select("key", "start", *X, "d2")
        before, estimates = estimates.select("key", "start", F.col("logdet").alias("before")), _estimates(_near(placed, "d2", few, "key", "start"), "key", "start")
        fall = before.join(estimates, ["key", "start"]).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        if fall is None or fall <= tolerance:
            break
    best = estimates.groupBy("key").agg(F.min_by(F.struct("n", *MEAN, "precision"), F.struct("logdet", "start")).alias("e"))
    return materialize(best.select("key", "e.*"), "best")


def quality_verdicts(docs: DataFrame, min_group: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, d2 (squared distance) and kept."""
    counted = materialize(base_statistics(docs).withColumns(dict(zip(X, _vector(), strict=True))), "vectors")
    lang, source = (F.when(F.col(c).isNull(), "?").otherwise(F.concat(F.lit("="), F.col(c).cast("string"))) for c in ("lang", "source"))
    counted = counted.withColumns({"k2": F.concat_ws("\x01", lang, source), "k1": lang})
    many2 = materialize(counted.groupBy("k2", "k1").count().withColumnRenamed("count", "n2"), "groups")
    many1 = many2.groupBy("k1").agg(F.sum(F.when(F.col("n2") < min_group, F.col("n2"))).alias("n1"))
    named = many2.join(many1, "k1").select("k2", F.when(F.col("n2") >= min_group, F.col("k2")).when(F.col("n1") >= min_group, F.col("k1")).otherwise("*").alias("key"))
    named = materialize(named, "keys")
    few = named.count() <= FEW_GROUPS
    keyed = counted.join(F.broadcast(named) if few else named, "k2").drop("k1", "k2")
    estimates = robust_estimates(keyed.select("key", *X), few)
    judged = _distance(keyed.join(F.broadcast(estimates) if few else estimates, "key", "left"))
    kept = ~base_failed() & (F.col("n").isNull() | (F.col("n") < 10 * H) | (F.col("d2") <= CUTOFF))
    return judged.select("doc_id", "lang", "source", "version", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "d2", kept.alias("kept"))


def keep_good(docs: DataFrame, min_group: int = 50) -> DataFrame:
    """The rows of `docs` that are kept."""
    names = ("doc_id", "lang", "source", "version")
    kept = quality_verdicts(docs, min_group).filter("kept").select(*(F.col(c).alias(f"kept_{c}") for c in names))
    rows = docs.select(F.struct("*").alias("row"), text_version(F.col("text")).alias("version"))
    same = F.col("version") == F.col("kept_version")
    for c in names[:3]:
        same = same & F.col(f"row.{c}").eqNullSafe(F.col(f"kept_{c}"))
    return rows.join(kept, same, "left_semi").select("row.*")
