"""The registered queries of this package and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontamination, language_id, license_scan, line_dedup, merkle, mixing, ngram_quality, prefix_trie, runs, simhash, substring_dedup, token_output, url_filter
from cadenza.llm.text import table
from cadenza.plans.materialize import cut, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


URL_RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


@query
def op1_fingerprints(spark, folder):
    return merkle.fingerprint_edits(table(spark, folder, "documents"))


@query
def op2_url_filter(spark, folder):
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


@query
def op3_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op4_decontamination(spark, folder):
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), near=0.8)
    return found.drop("text_hash")


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query
def op5_token_output(spark, folder):
    path = scratch_path(spark, "token-files")
    token_output.write_token_files(table(spark, folder, "documents"), path, TOKENIZER, end_id=2)
    return token_output.read_token_files(spark, path)


@query
def op6_language_id(spark, folder):
    return language_id.identify(table(spark, folder, "documents"))


@query
def op7_quality(spark, folder):
    return ngram_quality.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_license_scan(spark, folder):
    return license_scan.licenses(table(spark, folder, "documents")).drop("text_hash")


@query
def op9_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query
def op10_line_dedup(spark, folder):
    found = line_dedup.repeated_lines(table(spark, folder, "documents"))
    return found.drop("text_hash").withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


@query
def op11_substring_dedup(spark, folder):
    return substring_dedup.repeated_words(table(spark, folder, "documents")).drop("spans")


@query
def op12_runs(spark, folder):
    found = runs.periodic_runs(runs.with_periodic_tails(table(spark, folder, "documents")))
    best, listed = runs.strongest(F.col("runs")), F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op13_prefix_trie(spark, folder):
    turns = cut(prefix_trie.ordered_turns(table(spark, folder, "conversations")), "ordered-turns")
    convs, rebuilt = prefix_trie.with_shared_openings(turns)
    return prefix_trie.prefix_trie(rebuilt, convs)


def _terms(terms) -> str:
    return "list_aggregate([" + ", ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int" for t in terms) + "], 'sum')::int"


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE["op2_url_filter"] = f"""
WITH rest AS (
    SELECT page_id, coalesce(translate(url, {UPPER_LOWER}), '') AS low,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER_LOWER}) AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM rest),
found AS (
    SELECT *, {_terms(url_filter.STRICT)} AS strict_terms, {_terms(url_filter.SOFT)} AS soft_terms,
           CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
    FROM parts)
SELECT page_id, host, path, rule, strict_terms, soft_terms,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN strict_terms > 0 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN strict_terms > 0 THEN 1.0::double ELSE least(1.0::double, soft_terms / 2) END AS score
FROM found
"""

WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

ORACLE["op4_decontamination"] = f"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(translate(text, {UPPER_LOWER}), ''), {WORDS}) AS w
    FROM documents),
item AS (
    SELECT item_id::varchar AS item_id, regexp_extract_all(coalesce(translate(text, {UPPER_LOWER}), ''), {WORDS}) AS w
    FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM win),
place AS (
    SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS phrase
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, lengths WHERE len(w) >= k)),
met AS (SELECT r, s, k, item_id FROM place JOIN win USING (k, phrase)),
hit AS (
    SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS pos FROM met) GROUP BY r),
named AS (
    SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM met GROUP BY r),
passage AS (
    SELECT row_number() OVER () AS b, item_id, list_distinct(w[s : s + 12]) AS terms
    FROM (SELECT DISTINCT item_id, w, unnest(list_append(range(1, len(w) - 12, 13), len(w) - 12)) AS s FROM item WHERE len(w) >= 13)),
part AS (SELECT b, item_id, ceil(round(0.8 * len(terms), 6)) AS need, unnest(terms) AS term FROM passage),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM doc),
of_both AS (SELECT r, b, need, item_id, term, pos FROM word JOIN part USING (term)),
enough AS (SELECT r, b FROM of_both GROUP BY r, b, need HAVING count(DISTINCT term) >= need),
stretch AS (
    SELECT r, item_id, need, count(DISTINCT term) OVER (PARTITION BY r, b ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
    FROM of_both SEMI JOIN enough USING (r, b)),
close AS (
    SELECT r, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
    FROM stretch WHERE n >= need GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(named.ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0)::bigint AS n_near, sha256(coalesce(close.ids, '')) AS near_sha256
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN close USING (r)
"""

# the CRC-32 of a text, bit by bit
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""

ORACLE["op13_prefix_trie"] = f"""
WITH turn AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
    SELECT c, c - c % 20 AS base, {CRC32.format("c::varchar")} % 4 AS h, count(*) AS n FROM turn GROUP BY c),
opening AS (SELECT conv.*, least(conv.h, coalesce(b.n, 0)) AS taken FROM conv LEFT JOIN (SELECT c, n FROM conv) b ON b.c = conv.base),
rebuilt AS (
    SELECT o.c, i, role, text FROM opening o JOIN turn t ON t.c = o.base WHERE i < taken
    UNION ALL
    SELECT o.c, i - h + taken, role, text FROM opening o JOIN turn t USING (c) WHERE i >= h),
listed AS (
    SELECT c, i + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
           list(sha256(sha256(role) || text)) OVER (PARTITION BY c ORDER BY i) AS turns
    FROM rebuilt),
prefix AS (
    SELECT c, depth, words, sha256(array_to_string(turns, ',')) AS node,
           CASE WHEN depth = 1 THEN '' ELSE sha256(array_to_string(turns[:-2], ',')) END AS above
    FROM listed
    UNION ALL SELECT c, 0, 0, '', NULL FROM conv),
ended AS (SELECT c, max_by(node, depth) AS node FROM prefix GROUP BY c),
ends AS (SELECT node, sha256(string_agg(c::varchar, ',' ORDER BY c)) AS ends_sha256 FROM ended GROUP BY node),
node AS (
    SELECT node, any_value(above) AS above, any_value(depth) AS depth, any_value(words) AS words, min(c) AS c, count(*) AS n FROM prefix GROUP BY node),
child AS (SELECT above AS node, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY above),
whole AS (
    SELECT p.node, sum((d.n - 1) * d.words) AS saved, sum((k.n IS NULL)::int) AS leaves
    FROM node d JOIN prefix p ON p.c = d.c AND p.depth <= d.depth LEFT JOIN child k ON k.node = d.node GROUP BY p.node)
SELECT d.c AS conv_id, d.depth::bigint AS depth, a.c AS parent_conv_id, d.n::bigint AS n_convs, coalesce(k.n, 0)::bigint AS n_children,
       leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM node d JOIN whole USING (node) LEFT JOIN node a ON a.node = d.above LEFT JOIN child k ON k.node = d.node LEFT JOIN ends e ON e.node = d.node
"""

ORACLE["op11_substring_dedup"] = """
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
place AS (
    SELECT r, doc_id, s, sha256(array_to_string(w[s : s + 12], ' ')) AS phrase FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM doc)),
first AS (SELECT phrase, min(doc_id) AS doc_id FROM place GROUP BY phrase),
gone AS (
    SELECT r, list(DISTINCT i) AS gone FROM (
        SELECT r, unnest(range(s, s + 13)) AS i FROM place JOIN first USING (phrase) WHERE place.doc_id > first.doc_id) GROUP BY r),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM (
        SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc) d
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS i FROM gone) g WHERE g.r = d.r AND g.i = d.i) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
