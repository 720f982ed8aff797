"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontam, html_tree, jaccard, language_id, language_model, licences, mixing, multi_index, simhash, substrings, urls, vector_codes, whitening,
)
from .common import UPPER, table

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contaminated_words(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard.similar_components(table(spark, sf, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_tree(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    found = html_tree.extract(pages, html_tree.learn(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    found = language_id.identify_held_out(table(spark, sf, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op8_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    found = language_model.score(table(spark, sf, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op10_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licences.scan(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        "n_sentences",
        F.array_join("known", ",").alias("known"),
        F.array_join("licences", ",").alias("licences"),
        F.array_join("leftover", ",").alias("leftover"),
    )


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf, "embeddings"))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_tree": op6_html_tree,
    "op7_language_id": op7_language_id,
    "op8_multi_index": op8_multi_index,
    "op9_lm_score": op9_lm_score,
    "op10_licence_scan": op10_licence_scan,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_vector_codes": op13_vector_codes,
}

_U = "(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(source, '-') || '|' || size || '|' || copy), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"

SQL = {
    "op1_pareto_mix": f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), copied AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM copied GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    2.0::DOUBLE * source_size AS cap FROM sources
), filling AS (SELECT *, cap / weight AS full_at FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filling
), final AS (SELECT max(level) AS level FROM levels WHERE level < full_at),
plan AS (
  SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target FROM levels l, final f
), rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM plan),
drawn AS (
  SELECT c.doc_id, c.source, c.copy, c.size, r.source_size, r.target, floor(r.rate) AS certain, r.rate - floor(r.rate) AS p,
    r.target - floor(r.rate) * r.source_size AS need, {_U.replace('source,', 'c.source,')} AS u
  FROM copied c JOIN rated r ON c.source IS NOT DISTINCT FROM r.source
), ranked AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM drawn),
fill AS (
  SELECT 0 AS round, doc_id, source, copy, size, rank, CAST(need AS DOUBLE) AS gap, false AS chosen FROM ranked WHERE p > 0 AND size > 0
  UNION ALL
  SELECT round + 1, doc_id, source, copy, size, rank, gap - coalesce(sum(size) FILTER (fits AND upto <= gap) OVER (PARTITION BY source), 0), chosen OR (fits AND upto <= gap)
  FROM (SELECT *, sum(size) FILTER (fits) OVER (PARTITION BY source ORDER BY rank, doc_id, copy ROWS UNBOUNDED PRECEDING) AS upto, bool_or(fits) OVER () AS more
    FROM (SELECT *, NOT chosen AND size <= gap AS fits FROM fill)) WHERE more
), filled AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
fits AS (SELECT *, row_number() OVER (PARTITION BY source, chosen ORDER BY abs(gap - size), rank, doc_id, copy) AS place FROM filled)
SELECT r.doc_id, r.size, r.source_size, r.target,
  CAST(CASE WHEN r.size = 0 THEN 0 ELSE r.size * (certain + CASE WHEN chosen OR (place = 1 AND abs(gap - f.size) < gap) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM ranked r LEFT JOIN fits f ON r.doc_id IS NOT DISTINCT FROM f.doc_id AND r.source IS NOT DISTINCT FROM f.source AND r.copy = f.copy AND r.size = f.size""",
    "op2_decontaminate": """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, words[s:s + least(13, len(words)) - 1] AS w
  FROM items, unnest(range(1, greatest(len(words) - 13 + 1, 1) + 1)) t(s) WHERE len(words) > 0
), lengths AS (SELECT DISTINCT len(w) AS n FROM windows),
spots AS (SELECT doc_id, s, n, words[s:s + n - 1] AS w FROM docs, lengths, unnest(range(1, len(words) - n + 2)) t(s) WHERE len(words) >= n),
hits AS (SELECT doc_id, s, n, item_id FROM spots JOIN windows USING (w)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) t(p) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_jaccard_join": """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[s:s + 4] END AS g
  FROM docs, unnest(range(1, greatest(len(words) - 4, 1) + 1)) t(s) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT i, j FROM common JOIN sizes x ON x.doc_id = i JOIN sizes y ON y.doc_id = j WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), both_ways AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reach AS (SELECT i, j FROM both_ways UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON r.j = b.i),
least AS (SELECT i, min(j) AS j FROM reach GROUP BY i)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(j, d.doc_id), d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON i = d.doc_id""",
    "op5_substring_dedup": """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, s, sha256(array_to_string(words[s:s + 12], ' ')) AS w FROM docs, unnest(range(1, len(words) - 11)) t(s) WHERE len(words) >= 13
), least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, p FROM windows JOIN least USING (w), unnest(range(s, s + 13)) t(p) WHERE first < doc_id),
spots AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM spots ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN counted USING (doc_id)""",
    # crc32 from its rule: a table of 256 steps, then one step a digit (ids are ASCII). Grams of two tokens, smoothed by 100 virtual ones.
    "op9_lm_score": f"""
WITH steps AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS step
), texts AS MATERIALIZED (
  SELECT row_number() OVER () AS i, doc_id,
    xor(list_reduce([4294967295] || [CAST(ord(c) AS BIGINT) FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '') IF c <> ''],
      lambda a, b: xor(a // 256, step[xor(a % 256, b) + 1])), 4294967295) % 5 = 1 AS held_out,
    ['s'] || ['w' || w FOR w IN coalesce(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+'), [])] || ['e'] AS tokens
  FROM documents, steps
), pairs AS MATERIALIZED (
  SELECT i, held_out, unnest(tokens[:-2]) AS h, unnest(tokens[2:]) AS w FROM texts
), ones AS (SELECT w, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY w),
befores AS (SELECT h, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY h),
twos AS (SELECT h, w, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY h, w),
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM ones),
chances AS (
  SELECT i, o.c IS NOT NULL AS known, (coalesce(o.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p,
    coalesce(t.c, 0) AS seen, coalesce(b.c, 0) AS before
  FROM pairs CROSS JOIN total LEFT JOIN ones o ON o.w = pairs.w LEFT JOIN befores b ON b.h = pairs.h LEFT JOIN twos t ON t.h = pairs.h AND t.w = pairs.w
), sums AS (
  SELECT i, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, round(fsum(log10(p)), 6) AS base_score,
    round(fsum(log10((seen + 100.0::DOUBLE * p) / (before + 100.0::DOUBLE))), 6) AS score
  FROM chances GROUP BY i
)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, base_score, score FROM texts JOIN sums USING (i) CROSS JOIN total""",
}

_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    """The sentence table and one step per rule, spelled out."""
    known = ", ".join(f"({_QUOTED(text)}, {_QUOTED(name)})" for name, text in licences.SENTENCES)
    steps, last = [], "r0"
    for i, (licence, ids) in enumerate(licences.RULES, 1):
        text, gone = "".join(f" {x} " for x in ids), "".join(f" {'#' * len(x)} " for x in ids)
        steps.append(
            f"""r{i} AS (SELECT doc_id, known, CASE WHEN instr(rest, '{text}') > 0 THEN list_append(matched, {{'spot': instr(rest, '{text}'), 'licence': '{licence}'}}) ELSE matched END AS matched,
  replace(rest, '{text}', '{gone}') AS rest FROM {last})"""
        )
        last = f"r{i}"
    return f"""
WITH known(text, name) AS (VALUES {known}),
cut AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.!?;:]+([\\x20\\x09-\\x0D]|$)', chr(10), 'g'), '[\\x0A-\\x0D]+') AS pieces FROM documents),
pieces AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS spot FROM cut),
named AS (SELECT p.doc_id, p.spot, k.name FROM pieces p JOIN known k ON k.text =
  trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))),
r0 AS (SELECT doc_id, string_agg(name, ',' ORDER BY spot) AS known, CAST([] AS STRUCT(spot BIGINT, licence VARCHAR)[]) AS matched,
  ' ' || string_agg(name || ' ', ' ' ORDER BY spot) AS rest FROM named GROUP BY doc_id),
{", ".join(steps)},
firsts AS (SELECT doc_id, m.licence, min(m.spot) AS spot FROM (SELECT doc_id, unnest(matched) AS m FROM {last}) GROUP BY ALL),
found AS (SELECT doc_id, string_agg(licence, ',' ORDER BY spot, licence) AS licences FROM firsts GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM pieces WHERE regexp_matches(piece, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]') GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(known, '') AS known, coalesce(licences, '') AS licences,
  coalesce(array_to_string(list_filter(string_split(rest, ' '), lambda t: t <> '' AND NOT starts_with(t, '#')), ','), '') AS leftover
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN {last} USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _url_sql() -> str:
    """The rules longest first, and the two walks as one recursive table of rounds."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = lambda r: f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = "CASE " + " ".join(f"{fits(r)} THEN '{r[1]}{r[2]}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"{fits(r)} THEN '{r[0]}'" for r in ordered) + " END"
    link = urls.LINK.replace("\\\\", "\\").replace("'", "''")
    return f"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM parts),
seeds AS (SELECT host, CAST(count(*) FILTER (by_rule = 'allow') AS DOUBLE) AS trusted, CAST(count(*) FILTER (by_rule = 'block') AS DOUBLE) AS blocked FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS dst FROM parts WHERE contains(html, '//')),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM links) WHERE src <> '' AND src <> dst GROUP BY 1, 2),
directed AS (SELECT 0 AS walk, src AS a, dst AS b, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges),
arcs AS MATERIALIZED (SELECT walk, a, b, n / sum(n) OVER (PARTITION BY walk, a) AS share FROM directed),
hosts AS (SELECT host FROM seeds UNION SELECT src FROM edges UNION SELECT dst FROM edges),
weights AS (SELECT walk, host, coalesce(CASE walk WHEN 0 THEN trusted ELSE blocked END, 0) AS w FROM hosts LEFT JOIN seeds USING (host), range(2) t(walk)),
restart AS MATERIALIZED (SELECT walk, host, CASE WHEN sum(w) OVER (PARTITION BY walk) > 0 THEN w / sum(w) OVER (PARTITION BY walk) ELSE 0 END AS restart FROM weights),
walks AS (
  SELECT 0 AS round, walk, host, restart AS score FROM restart
  UNION ALL
  SELECT round, walk, host, 0.85 * moved + restart * (sum(restart) OVER (PARTITION BY walk) - 0.85 * sum(moved) OVER (PARTITION BY walk)) FROM (
    SELECT max(m.round) + 1 AS round, r.walk, r.host, any_value(r.restart) AS restart, coalesce(sum(m.score * arcs.share) FILTER (arcs.b = r.host), 0) AS moved
    FROM walks m JOIN restart r ON r.walk = m.walk LEFT JOIN arcs ON arcs.walk = m.walk AND arcs.a = m.host AND arcs.b = r.host
    WHERE m.round < 60 AND EXISTS (SELECT 1 FROM arcs) GROUP BY r.walk, r.host)
), last AS (SELECT host, sum(score) FILTER (walk = 0) AS trust, sum(score) FILTER (walk = 1) AS distrust FROM walks WHERE round = (SELECT max(round) FROM walks) GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN last USING (host)"""


SQL |= {"op3_url_filter": _url_sql(), "op10_licence_scan": _licence_sql()}
