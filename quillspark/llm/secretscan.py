r"""Operator 9: secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Three patterns give the base spans. Positions come from one pass each: the pieces between matches (split) and the
matches themselves (extract all) alternate, so running lengths give every start and end in code points, in runs of RUN
matches and then over runs: nearly linear in the length of a text, whatever it holds.

Long mixed tokens are candidates, within base spans and beside them. The hash of every candidate is counted over the whole
corpus by distinct owner (source) and repository (text, so that copies of one count once): a value that several owners
hold is a copied example; one that a single owner holds, in few of its repositories (a share of them, or a small number),
looks live and is added as a span of kind `owned` (over a base span, or of its own). Only hashes are shuffled, distinct
triples first, so a value that a third of all documents hold is spread and then added up map-side.

Defined results: null or empty texts have no spans; a null owner counts as one owner; rows that repeat a text count as
one repository and each get their spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run starts where no character of its class stands before; so only runs that are long enough are looked at twice.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
OWNED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


#: Matches whose positions are summed up at a time: arrays are appended to within such a run and once a run, never match by match.
RUN = 64


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of all matches whose `group` has `least` code points or more."""
    pattern = F.lit(pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, pattern, F.lit(group)) if group else found
    parts = F.arrays_zip(between.alias("gap"), found.alias("hit"), value.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(got: Column, part: Column) -> Column:
        start = got["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        good = F.coalesce(F.length(part["value"]), F.lit(0)) >= least
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(good, F.concat(got["out"], F.array(span))).otherwise(got["out"]).alias("out"))

    def moved(one: Column, by: Column) -> Column:
        return F.transform(one["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))

    def joined(runs: Column) -> Column:
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        begins = F.aggregate(runs, begun, lambda got, one: F.struct((got["at"] + one["at"]).alias("at"), F.concat(got["all"], F.array(got["at"])).alias("all")), lambda got: got["all"])
        return F.flatten(F.zip_with(runs, begins, moved))

    def cut(whole: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(whole), F.lit(RUN))
        return F.transform(firsts, lambda first: F.aggregate(F.slice(whole, first, F.lit(RUN)), empty, step))

    # A lambda's argument is held, where an expression in its body would be worked out again for each element.
    held = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.when(F.regexp_like(text, pattern), held(held(parts, cut), joined)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source, base (spans of the base patterns) and more (candidates of the method), kept without texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, 2, 6), _spans(text, ACCESS, 1, 0, 20), _spans(text, HEX, 2, 0, 24))
    return materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", F.xxhash64(text).alias("version"), base.alias("base"), _spans(text, OWNED, 3, 0, 20).alias("more")), "spans")


def ownership(candidates: DataFrame) -> DataFrame:
    """From (h1, h2, owner, repository) each hash's distinct owners, its repositories, and an owner (the only one, if one)."""
    triples = candidates.groupBy("h1", "h2", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = triples.groupBy("h1", "h2", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("h1", "h2").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.min("owner").alias("owner"))


def secret_spans(docs: DataFrame, max_owners: int = 1, max_repositories: int = 3, max_share: float = 0.01, min_distinct: int = 8) -> DataFrame:
    """doc_id, base and spans (base and added), each an ordered array of (start, kind, end).

    A value is live-looking in at most `max_owners` owners and `max_repositories` texts, or `max_share` of its owner's texts."""
    found = scan(docs)
    candidates = found.select("rid", F.col("source").alias("owner"), F.col("version").alias("repository"), F.explode("more").alias("span"))
    varied = F.size(F.array_distinct(F.split(F.col("span.value"), ""))) >= min_distinct
    mixed = F.regexp_like(F.col("span.value"), F.lit("[0-9]")) & F.regexp_like(F.col("span.value"), F.lit("[A-Za-z]"))
    candidates = candidates.filter(varied & mixed).select("rid", "owner", "repository", "span.start", "span.end", F.xxhash64("span.value").alias("h1"), F.xxhash64(F.lit(7), F.col("span.value")).alias("h2"))
    texts = found.groupBy("source", "version").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("n_texts"))
    owned = ownership(candidates).filter(F.col("n_owners") <= max_owners)
    rare = owned.join(texts, F.col("owner").eqNullSafe(F.col("source"))).filter((F.col("n_repositories") <= max_repositories) | (F.col("n_repositories") <= max_share * F.col("n_texts"))).select("h1", "h2")
    added = candidates.join(rare, ["h1", "h2"]).groupBy("rid").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added")).select(F.col("rid").alias("rid2"), "added")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    joined = found.join(added, F.col("rid") == F.col("rid2"), "left")
    return joined.select("doc_id", F.array_sort(plain).alias("base"), F.array_sort(F.when(F.col("added").isNull(), plain).otherwise(F.concat(plain, "added"))).alias("spans"))


def spans_text(spans: str) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
