"""Text functions: Column in, Column out, no Python workers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import LINE_MARKS, LINE_SPACING, PUNCTUATION_SUFFIXES, RUSSIAN, Lexicon, one_of

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "quillspark")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs between white space; none for blank text."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def capitalized(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def clean_line(text: Column, lexicon: Lexicon = RUSSIAN) -> Column:
    """Brackets, speaker marks, interjections, fillers and repeated words go; spacing and leading marks are put right."""
    out = F.replace(text, F.lit("\n"), F.lit(" "))
    spoken = [(one_of(lexicon.interjections, bounded=True), " "), (one_of(sorted(lexicon.fillers, key=len, reverse=True), bounded=True), " ")]
    for pattern, to in [*LINE_MARKS, *spoken, *LINE_SPACING]:
        out = F.regexp_replace(out, pattern, to)
    return out


def ends_sentence(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?U)[.!?…]\s*$"))


def resegmented(text: Column) -> Column:
    """Single spaces between words, and a capital first."""
    return capitalized(F.array_join(words(text), " "))


def tidy_sentence(text: Column) -> Column:
    """No space before marks, single spaces, a capital first."""
    out = F.regexp_replace(text, r"(?U)\s+([,.!?…:;])", "$1")
    return capitalized(F.regexp_replace(strip(out), r"(?U)\s{2,}", " "))


def timecode(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from an hour on; fractions are cut off."""
    s = seconds.cast("bigint")
    h = F.floor(s / 3600)
    m, r = F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h != 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def deep_link(video_id: Column, seconds: Column, base: str = "https://youtu.be/") -> Column:
    return F.concat(F.lit(base), video_id, F.lit("?t="), seconds.cast("bigint").cast("string"))


SENTENCE_BREAK = r"(?U)(?<=[.!?…])\s+(?=[«\"—A-ZА-ЯЁ])"


def sentence_cues(text: Column, start: Column, end: Column, pattern: str = SENTENCE_BREAK) -> Column:
    """A segment cut at sentence ends, as array<struct<text,start,duration>>; time is spread by length."""
    parts = F.filter(F.transform(F.split(text, pattern, -1), strip), lambda p: p != "")
    span = F.greatest(end - start, F.lit(0.0))
    total = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    cut = F.aggregate(
        parts,
        F.struct(start.cast("double").alias("at"), F.array().cast("array<struct<text:string,start:double,duration:double>>").alias("out")),
        lambda got, p: F.struct((got["at"] + span * F.length(p) / total).alias("at"), F.concat(got["out"], F.array(F.struct(p.alias("text"), got["at"].alias("start"), (span * F.length(p) / total).alias("duration")))).alias("out")),
        lambda got: got["out"],
    )
    one = F.array(F.struct(text.alias("text"), start.cast("double").alias("start"), span.cast("double").alias("duration")))
    return F.when(F.size(parts) < 2, one).otherwise(cut)


def decode_label(token: Column, label: Column) -> Column:
    """A word with the case and mark that a punctuation model's label names."""
    out = token
    for case, change in (("LOWER", lambda t: t), ("UPPER", capitalized), ("UPPER_TOTAL", F.upper)):  # the last that fits wins
        known = F.create_map(*(F.lit(x) for pair in PUNCTUATION_SUFFIXES.items() for x in pair))
        suffix = F.coalesce(F.try_element_at(known, F.substr(label, F.lit(len(case) + 2))), F.lit(""))
        out = F.when(F.startswith(label, F.lit(case + "_")), F.concat(change(token), suffix)).otherwise(out)
    return out


def norm_word(word: Column) -> Column:
    """Letters, digits, `_` and `-` only, in lower case."""
    return F.lower(F.regexp_replace(word, r"(?U)[^\w-]", ""))


def truncated(text: Column, limit: int) -> Column:
    """At most `limit` words, with ` …` after a cut; shorter texts stay as they are."""
    return F.when(F.size(words(text)) <= limit, text).otherwise(F.concat(F.array_join(F.slice(words(text), 1, limit), " "), F.lit(" …")))


def stitched(a: Column, b: Column, limit: int = 120) -> Column:
    """`a` and `b` joined without the longest run of at most `limit` words that ends the one and begins the other."""
    wa, wb = words(a), words(b)
    la, lb = F.transform(wa, F.lower), F.transform(wb, F.lower)
    most = F.least(F.lit(limit), F.size(wa), F.size(wb))
    fits = F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: F.slice(la, -n, n) == F.slice(lb, F.lit(1), n))
    n = F.when(most >= 1, F.get(fits, F.lit(0)))
    return F.when(n.isNotNull(), F.array_join(F.concat(wa, F.slice(wb, n + 1, F.greatest(F.size(wb) - n, F.lit(0)))), " ")).otherwise(F.concat(a, F.lit(" "), b))


def token_count(text: Column, chars_per_token: float = 2.5) -> Column:
    """At least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(chars_per_token)).cast("int"))


def marker_scores(text: Column, lexicon: Lexicon = RUSSIAN) -> tuple[Column, Column]:
    """How often ingredient marks and step marks occur."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    ingredients = count("(?iuU)" + lexicon.units) + count(one_of(lexicon.ingredient_phrases))
    steps = count(one_of(lexicon.step_verbs)) + count(one_of(lexicon.sequence_markers, bounded=True))
    return ingredients, steps


def starts_step(text: Column, lexicon: Lexicon = RUSSIAN) -> Column:
    return F.regexp_like(strip(text), F.lit(one_of(lexicon.sequence_markers, bounded=True).replace(r"\b(?:", r"^(?:", 1)))


def chunk_number(chunk_id: Column) -> Column:
    """The number after the last `::`, or -1."""
    tail = F.regexp_extract(chunk_id, r"(?s)::([^:]*(?::[^:]+)*)$", 1)
    return F.when(F.contains(chunk_id, F.lit("::")), F.coalesce(tail.try_cast("int"), F.lit(-1))).otherwise(F.lit(-1))


def has_digit(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?U)\d"))


def name_uuid(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    digit = F.substr(F.lit("89ab"), (F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), digit, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def passage_text(title: Column, text: Column) -> Column:
    """What is embedded: the title, if any, over the text."""
    name = strip(F.coalesce(title, F.lit("")))
    return F.when(name != "", F.concat(name, F.lit("\n\n"), text)).otherwise(text)
