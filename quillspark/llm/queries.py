"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import leave, scratch_path, table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; QUILL_TOKENIZERS names another folder."""
    if folder := os.environ.get("QUILL_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)


def op2_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.encoding import vocabulary_size
    from quillspark.llm.tokenbin import read_tokens, write_tokens

    path, file = scratch_path(spark, "tokens"), tokenizer_file("byte_bpe_50k.json")
    parts = write_tokens(table(spark, sf_dir, "documents"), path, file, vocabulary=vocabulary_size(file), end_id=2)
    leave(spark, path)
    return read_tokens(spark, parts)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.linededup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"), min_length=40, min_docs=5)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.keeper AS lost
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import quality_verdicts

    found = quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.chatfmt import digest_conversations, format_conversations

    said = "\\### Assistant: </turn> ok"
    names = ["conv_id", "turn", "role", "text"]
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digest_conversations(format_conversations(table(spark, sf_dir, "conversations").select(*names).unionByName(more)))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.hpylm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.urlrep import url_verdicts

    # A page's outcome is the label of its number: bad if the quality is 0.
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).cast("int").alias("bad"))
    found = url_verdicts(table(spark, sf_dir, "pages"), labels)
    return found.select("page_id", "host", "path", "rule", "verdict", F.col("n").alias("n_labelled"), F.round("rate", 6).alias("bad_rate"), F.round("tail", 5).alias("bad_tail"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.secretscan import secret_spans, spans_text

    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.decontam import contamination, is_contaminated

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13)
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.prefixtrie import ordered_turns, prefix_trie, rebuilt

    return prefix_trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations")), group=5, most=9))


def op12_page_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pagetext import extract, fit_shapes

    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_shapes(pages, fit_pages=2000)).select("page_id", "url", "text", "n_chars")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.vectorcode import codebooks_digest, encode, with_label_error

    coded, books = encode(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return with_label_error(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(r, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS er,
         replace(replace(replace(t, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || er || ': ' || et || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_STRENGTH = """(SELECT CASE WHEN coalesce(room, 0) = 0 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE / least(0.99, greatest(0.001, (seen - chance) / room)) - 1.0 END FROM (
  SELECT sum(n * (bad / n::DOUBLE - m) * (bad / n::DOUBLE - m)) AS seen, sum(m * (1 - m)) AS chance, sum((n - 1) * m * (1 - m)) AS room FROM {0} WHERE n > 0))"""
_ALPHABETS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP8_SQL = rf"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_ALPHABETS}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
parsed AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS site FROM urls),
known AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels GROUP BY doc_id),
counted AS (
  SELECT site, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(site, '.') AS parts, regexp_matches(site, '^([0-9.]+|\[.*\])$') AS address,
         regexp_matches(site, '[^.]\.(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z][a-z]$') AS long
  FROM parsed LEFT JOIN known USING (page_id) GROUP BY site),
hosts AS (
  SELECT site, n, bad, CASE WHEN address THEN site WHEN long THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
         CASE WHEN address THEN '[]' WHEN long THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM counted),
overall AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS r FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT r FROM overall) AS m FROM hosts GROUP BY suffix),
shrunk1 AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM suffixes, (SELECT {_STRENGTH.format('suffixes')} AS k)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts JOIN shrunk1 USING (suffix) GROUP BY domain, suffix),
shrunk2 AS (SELECT domain, suffix, (bad + k * m) / (n + k) AS m FROM domains, (SELECT {_STRENGTH.format('domains')} AS k)),
placed AS (SELECT site, n, bad, m FROM hosts JOIN shrunk2 USING (domain, suffix)),
posterior AS (
  SELECT site, n, bad + k * m AS a, n - bad + k * (1 - m) AS b, ln(2 * r / (1 - r)) AS t
  FROM placed, (SELECT {_STRENGTH.format('placed')} AS k), overall),
ranged AS (
  SELECT *, least(t, greatest(-ln(a + b + 1) - 20, ln(a / b) - 40 / a - 9 / sqrt(a * b / (a + b)))) AS lo,
         greatest(t, least(ln(a + b + 1) + 20, ln(a / b) + 40 / b + 9 / sqrt(a * b / (a + b)))) AS hi,
         a * ln(a / b) - (a + b) * (greatest(ln(a / b), 0) + ln(1 + exp(-abs(ln(a / b))))) AS peak FROM posterior),
points AS (
  SELECT site, i, side, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * (CASE WHEN side = 0 THEN t - lo ELSE hi - t END) / 600 AS w,
         CASE WHEN side = 0 THEN lo + i * (t - lo) / 200 ELSE t + i * (hi - t) / 200 END AS u FROM ranged, range(0, 201) g(i), range(0, 2) s(side)),
masses AS (
  SELECT site, any_value(n) AS n, any_value(a / (a + b)) AS rate,
         sum(CASE WHEN side = 0 THEN (w + CASE WHEN i = 0 THEN 1 / a ELSE 0 END) * f ELSE 0 END) AS below,
         sum(CASE WHEN side = 1 THEN (w + CASE WHEN i = 200 THEN 1 / b ELSE 0 END) * f ELSE 0 END) AS above
  FROM (SELECT *, exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - peak) AS f FROM points JOIN ranged USING (site)) GROUP BY site),
judged AS (SELECT site, n, rate, above / (above + below) AS tail FROM masses),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN tail > 0.95 THEN 'block' ELSE 'allow' END AS verdict,
       n AS n_labelled, round(rate, 6) AS bad_rate, round(tail, 5) AS bad_tail
FROM ruled JOIN judged USING (site)
"""

_WORD_LIST = rf"regexp_extract_all(translate(coalesce(text, ''), {_ALPHABETS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents), b AS (SELECT item_id, {_WORD_LIST} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.size, p.i, v.item_id FROM places p JOIN item_windows v ON v.size = p.size AND v.win = p.win),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: CRC-32 of a decimal number, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte:
  list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, byte)), 4294967295::BIGINT), 4294967295)"""
OP11_SQL = f"""
WITH said AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(turn ORDER BY pos) AS turns, {_CRC32.format('conv_id')} % 9 AS h FROM said GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, len(turns) AS whole, d, turns[1:d] AS prefix FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(prefix[d].t) END AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole = d), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, d),
kin AS (
  SELECT n.prefix, p.conv_id AS parent_conv_id, count(k.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1] LEFT JOIN nodes k ON k.d = n.d + 1 AND k.prefix[1:n.d] = n.prefix
  GROUP BY n.prefix, p.conv_id),
above AS (
  SELECT a.d, a.prefix[1:a.d] AS prefix, (k.n_children = 0)::INT AS leaf, (n.n_convs - 1) * n.bytes AS saved
  FROM (SELECT prefix, unnest(range(0, d + 1)) AS d FROM nodes) a JOIN nodes n USING (prefix) JOIN kin k USING (prefix)),
sums AS (SELECT prefix, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY prefix)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes JOIN kin USING (prefix) JOIN sums USING (prefix)
"""


#: Main texts of pages that have an article element with headings and paragraphs, as the tables' pages do.
OP12_SQL = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
pieces AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS parts
  FROM articles)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text, CAST(length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10))) AS BIGINT) AS n_chars FROM pieces
"""


def _op13_sql() -> str:
    """The rounds written out; all distances instead of the cells."""
    ints = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
    steps = [
        f"kept AS (SELECT vec_id, label, {ints} AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "pieces AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(0, 4) r(p))",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256)",
        "book0 AS MATERIALIZED (SELECT p, e, x AS c FROM pieces JOIN firsts USING (vec_id))",
    ]
    for i in range(5):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"near{i} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': CAST({distance} AS BIGINT), 'e': e}}) AS best FROM pieces JOIN book{i} USING (p) GROUP BY vec_id, p)")
        if i < 4:
            steps.append(f"flat{i} AS (SELECT p, best.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM near{i})")
            steps.append(f"mean{i} AS (SELECT p, e, j, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS m FROM flat{i} GROUP BY p, e, j)")
            steps.append(f"moved{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM mean{i} GROUP BY p, e)")
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN moved{i} m ON b.p = m.p AND b.e = m.e)")
    steps.append("codes AS (SELECT vec_id, string_agg(lower(format('{:02x}', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near4 GROUP BY vec_id)")
    digest = "sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, e) FROM book4))"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM codes JOIN kept USING (vec_id)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_bits": op2_token_bits,
    "op3_line_dedup": op3_line_dedup,
    "op4_robust_outliers": op4_robust_outliers,
    "op5_simhash_ball": op5_simhash_ball,
    "op6_chat_template": op6_chat_template,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_host_reputation": op8_host_reputation,
    "op9_secret_ownership": op9_secret_ownership,
    "op10_positional_index": op10_positional_index,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_page_cut": op12_page_cut,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op6_chat_template": OP6_SQL, "op8_host_reputation": OP8_SQL, "op10_positional_index": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_page_cut": OP12_SQL, "op13_vector_codes": _op13_sql()}
