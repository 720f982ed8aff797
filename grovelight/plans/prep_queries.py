"""Registered queries for sources, resumable runs and row preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import prep
from ..sources import files, runs
from ..sources.scratch import Scratch
from .relations import CORPUS_CTE, HIER_CTE, corpus, hierarchy, table


def _corpus_csv(s, d):
    path = f"{Scratch(s).root}/corpus"
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    files.write_corpus_csv(docs, path)
    return files.read_corpus_csv(s, path, "doc_id long, text string, lang string")


def _jsonl(s, d):
    path = f"{Scratch(s).root}/events"
    events = table(s, d, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line)
    events.select(broken.alias("value")).write.text(path)
    return files.read_jsonl(s, path, "event_id long, event_type string, value double")


def _vectors(s, d):
    vectors = files.read_vectors(s, f"{d}/embeddings.parquet")
    return vectors.select("id", F.posexplode("vec").alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x")
    )


_SCORE_COLUMNS = "l_returnflag string, l_linestatus string, n long, mean_qty double"


def _score_files(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_qty")
    )


def _write_scores(s, d):
    path = f"{Scratch(s).root}/scores"
    files.write_scores(_score_files(s, d), path, keys=["l_returnflag", "l_linestatus"])
    return s.read.schema(_SCORE_COLUMNS).option("header", True).csv(path)


def _tagged(s, d):
    root = Scratch(s).root
    scores = _score_files(s, d)
    scores.write.partitionBy("l_returnflag").option("header", True).csv(f"{root}/tagged")
    schema = "l_linestatus string, n long, mean_qty double"
    return files.read_tagged(s, f"{root}/tagged/*", schema, r"l_returnflag=([^/]+)/")


def _appended(s, d):
    path = f"{Scratch(s).root}/results"
    orders = table(s, d, "orders").select(F.col("o_orderpriority").alias("method"), "o_orderkey", "o_totalprice")
    runs.append_results(orders.where("o_orderstatus = 'F'"), path)
    runs.append_results(orders.where("o_orderstatus <> 'F'"), path)
    return s.read.parquet(path).select(F.col("method").cast("string").alias("method"), "o_orderkey", "o_totalprice")


def _pending(s, d):
    plan = table(s, d, "customer").select(F.col("c_custkey").alias("custkey"))
    done = table(s, d, "orders").select(F.col("o_custkey").alias("custkey"))
    return runs.pending(plan, done, ["custkey"], 10)


def _replaced(s, d):
    orders = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    new = orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("refreshed"))
    return runs.replace_rows(orders, new, ["o_custkey"])


def _union(s, d):
    docs = corpus(s, d)
    return prep.union_splits(docs.where("category_0 = 'en'"), docs.where("category_0 <> 'en'")).select(
        "id", "category_0", "category_1"
    )


def _no_copies(s, d):
    return prep.drop_all_duplicates(corpus(s, d), "topic").select("id", "category_0", "category_1")


def _canonical(s, d):
    return prep.to_canonical(
        table(s, d, "documents"),
        {"text": "topic", "lang": "category_0", "source": "category_1", "n_chars": "category_2"},
    ).select(F.md5("topic").alias("topic_md5"), "category_0", "category_1", "category_2")


def _not_null(s, d):
    joined = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id", "left")
    return prep.drop_null_rows(joined, ["quality"]).select("doc_id", "source")


def _blank(s, d):
    stretched = table(s, d, "documents").select("doc_id", F.regexp_replace("text", "[A-Za-z]", " ").alias("text"))
    return prep.drop_blank(stretched, "text").select("doc_id")


def _ascii(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.ascii_clean(F.col("text"))).alias("clean_md5"))


def _split_category(s, d):
    urls = table(s, d, "pages").select("page_id", F.regexp_replace("url", "^http://", "").alias("categories"))
    return prep.split_categories(urls, "categories").select("page_id", "category_0", "category_1")


def _two_labels(s, d):
    words = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("labels"))
    return prep.first_two_labels(words, "labels").select("p_partkey", "category_0", "category_1")


def _sample(s, d):
    return prep.sample_n(corpus(s, d).select("id", "category_0"), 100, 67)


def _full_depth(s, d):
    h = hierarchy(s, d).withColumn("topic", F.when(F.col("id") % 5 == 0, F.col("category_2")).otherwise(F.lit("t")))
    h = h.withColumn("category_2", F.when(F.col("id") % 3 > 0, F.col("category_2")))
    return prep.full_depth_rows(h, 3).select("id", "category_2")


def _permuted(s, d):
    return prep.seeded_permutation(corpus(s, d).select("id", "category_0"), 67)


def _encoded(s, d):
    h = hierarchy(s, d).withColumn("deep", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("category_1")))
    return prep.encode_labels(h, "deep", "category_0", 12).select("id", "label", "label_idx", "colour_idx")


def _dense(s, d):
    return prep.dense_ids(table(s, d, "labels").select(F.col("doc_id").alias("id")))


def _statistics(s, d):
    return prep.corpus_statistics(hierarchy(s, d), 3)


def _tokens(s, d):
    stats = prep.token_statistics(corpus(s, d), "topic", ["category_0"])
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


def _terms(s, d):
    return table(s, d, "documents").select(
        "doc_id", F.md5(tx.remove_terms(F.col("text"), ["the", "and"])).alias("text_md5")
    )


def _flatten(s, d):
    nested = table(s, d, "events").select(
        "event_id",
        F.concat(
            F.lit('{"'), "event_type", F.lit('":{"u'), F.col("user_id").cast("string"), F.lit('":'), "props",
            F.lit(',"solo":{}}}'),
        ).alias("json"),
    )
    deep = F.when(F.col("event_id") % 3 == 0, r'$1":{"d":{"e":{}}}}').otherwise(r'$1":{}}')
    nested = nested.withColumn("json", F.regexp_replace("json", F.lit(r'": (\d+)\}'), deep))
    flat = prep.path_columns(prep.flatten_hierarchy(nested, "json", ["event_id"]))
    return flat.select("event_id", "topic", *[f"category_{i}" for i in range(5)])


def _noise(s, d):
    return prep.add_noise_rows(corpus(s, d), 0.25, 10, 67).select(
        F.col("id").isNull().alias("is_noise"), F.md5("topic").alias("topic_md5"), "category_0"
    )


def _replies(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang")
    kind = F.col("doc_id") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit('["'), "source", F.lit('", "'), "lang", F.lit('"]')))
        .when(kind == 1, F.concat(F.lit('Here: ["'), "lang", F.lit('"] done')))
        .when(kind == 2, F.concat(F.lit("Sure\n1. "), "source", F.lit("\n2. "), "lang"))
        .otherwise(F.concat(F.lit("* "), "source", F.lit("\nnone")))
    )
    return docs.select("doc_id", F.array_join(tx.parse_topic_reply(reply), "|").alias("topics"))


def _synonyms(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang")
    kind = F.col("doc_id") % 3
    reply = (
        F.when(kind == 0, F.concat(F.lit('["'), "source", F.lit('"]')))
        .when(kind == 1, F.concat(F.lit('Here ["'), "lang", F.lit('", "x"] ok')))
        .otherwise(F.concat(F.lit('“'), "source", F.lit('” and " '), "lang", F.lit(' " or "z"')))
    )
    return docs.select("doc_id", F.array_join(tx.parse_synonym_reply(reply, 2), "|").alias("synonyms"))


def _plan(s, d):
    return prep.run_plan(table(s, d, "events").select(F.col("event_type").alias("embedding_model")).distinct())


def _levels_for(s, d):
    h = hierarchy(s, d).withColumn("category_1", F.when(F.col("id") % 10 > 0, F.col("category_1")))
    return prep.levels_for(h, 3).select("category", F.col("level_idx").cast("long").alias("level_idx"), "n_clusters")


def _closest(s, d):
    h = hierarchy(s, d)
    wanted = table(s, d, "part").select(F.col("p_size").cast("long").alias("k")).distinct()
    return prep.closest_level(wanted, prep.levels_for(h, 3)).select(
        "k", "closest", F.col("level_idx").cast("long").alias("level_idx")
    )


QUERIES = {
    "S1_read_corpus_csv": lambda s, d: _corpus_csv(s, d).select("doc_id", F.md5("text").alias("text_md5"), "lang"),
    "S2_read_jsonl": _jsonl,
    "S3_read_vectors": _vectors,
    "S4_write_scores": _write_scores,
    "S5_read_tagged": _tagged,
    "S6_pending": _pending,
    "S7_append_results": _appended,
    "S8_replace_rows": _replaced,
    "P1_union_splits": _union,
    "P2_drop_all_duplicates": _no_copies,
    "P3_to_canonical": _canonical,
    "P4_drop_null_rows": _not_null,
    "P5_drop_blank": _blank,
    "P6_ascii_clean": _ascii,
    "P7_split_first_category": _split_category,
    "P8_first_two_labels": _two_labels,
    "P9_sample_n": _sample,
    "P10_full_depth_rows": _full_depth,
    "P11_seeded_permutation": _permuted,
    "P12_encode_labels": _encoded,
    "P13_dense_ids": _dense,
    "P14_corpus_statistics": _statistics,
    "P15_token_statistics": _tokens,
    "P16_remove_terms": _terms,
    "P17_flatten_hierarchy": _flatten,
    "P18_add_noise_rows": _noise,
    "P19_parse_topic_reply": _replies,
    "P19_parse_synonym_reply": _synonyms,
    "P20_run_plan": _plan,
    "P21_levels_for": _levels_for,
    "P22_closest_level": _closest,
}

_SPACE = tx.ASCII_SPACE
_USPACE = tx.UNICODE_SPACE
_GRID_ROWS = ", ".join(
    f"('{m}', '{__import__('json').dumps(p, sort_keys=True)}')" for m, g in prep.PARAMETER_GRIDS.items() for p in g
)

SQL = {
    "S1_read_corpus_csv": "SELECT doc_id, md5(text) AS text_md5, lang FROM documents",
    "S2_read_jsonl": "SELECT event_id, event_type, value FROM events WHERE event_id % 7 <> 0",
    "S3_read_vectors": """SELECT id, CAST(pos AS BIGINT) AS pos, round(CAST(embedding[pos + 1] AS DOUBLE), 9) AS x
FROM (SELECT vec_id AS id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings)""",
    "S4_write_scores": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty
FROM lineitem GROUP BY 1, 2""",
    "S5_read_tagged": """SELECT l_returnflag AS dataset, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty
FROM lineitem GROUP BY 1, 2""",
    "S6_pending": """SELECT c_custkey AS custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 10)""",
    "S7_append_results": "SELECT o_orderpriority AS method, o_orderkey, o_totalprice FROM orders",
    "S8_replace_rows": """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_custkey, o_orderkey, 'refreshed' FROM orders WHERE o_orderstatus = 'P'""",
    "P1_union_splits": f"WITH {CORPUS_CTE} SELECT id, category_0, category_1 FROM corpus WHERE category_0 IS NOT NULL",
    "P2_drop_all_duplicates": f"""WITH {CORPUS_CTE} SELECT id, category_0, category_1 FROM corpus
QUALIFY count(*) OVER (PARTITION BY topic) = 1""",
    "P3_to_canonical": """SELECT md5(text) AS topic_md5, lang AS category_0, source AS category_1,
  CAST(n_chars AS VARCHAR) AS category_2 FROM documents""",
    "P4_drop_null_rows": "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND source IS NOT NULL",
    "P5_drop_blank": f"""SELECT doc_id FROM (SELECT doc_id, regexp_replace(text, '[A-Za-z]', ' ', 'g') AS text FROM documents)
WHERE regexp_matches(text, '[^{_USPACE}]')""",
    "P6_ascii_clean": f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7f]+', ' ', 'g'),
  '[{_SPACE}]+', ' ', 'g'))) AS clean_md5 FROM documents""",
    "P7_split_first_category": """SELECT page_id, split_part(tok, '.', 1) AS category_0,
  substr(tok, instr(tok, '.') + 1) AS category_1
FROM (SELECT page_id, split_part(replace(url, 'http://', ''), ' ', 1) AS tok FROM pages) WHERE instr(tok, '.') > 0""",
    "P8_first_two_labels": """SELECT p_partkey, w[1] AS category_0, w[2] AS category_1
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) WHERE len(w) >= 2""",
    "P9_sample_n": f"""WITH {CORPUS_CTE} SELECT id, category_0 FROM corpus
ORDER BY md5(concat_ws(':', CAST(id AS VARCHAR), '67')), id LIMIT 100""",
    "P10_full_depth_rows": f"""WITH {HIER_CTE} SELECT id, category_2 FROM hier
WHERE id % 3 > 0 AND (CASE WHEN id % 5 = 0 THEN category_2 ELSE 't' END) <> category_2""",
    "P11_seeded_permutation": f"""WITH {CORPUS_CTE} SELECT id, category_0,
  row_number() OVER (ORDER BY md5(concat_ws(':', CAST(id AS VARCHAR), '67')), id) - 1 AS new_id FROM corpus""",
    "P12_encode_labels": f"""WITH {HIER_CTE} SELECT id, label, label_idx, label_idx % 12 AS colour_idx FROM (
  SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_idx FROM (
    SELECT id, CASE WHEN id % 4 = 0 THEN category_0 ELSE category_1 END AS label FROM hier))""",
    "P13_dense_ids": "SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS leaf FROM labels",
    "P14_corpus_statistics": f"""WITH {HIER_CTE} SELECT 'rows' AS measure, count(*) AS value FROM hier
UNION ALL SELECT 'category_0', count(DISTINCT category_0) FROM hier
UNION ALL SELECT 'category_1', count(DISTINCT category_1) FROM hier
UNION ALL SELECT 'category_2', count(DISTINCT category_2) FROM hier""",
    "P15_token_statistics": f"""WITH {CORPUS_CTE}, t AS (
  SELECT category_0, CAST(len(regexp_extract_all(topic, '[^{_SPACE}]+')) AS BIGINT) AS n FROM corpus)
SELECT category_0, CAST(sum(n) AS BIGINT) AS total_tokens, round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens
FROM t GROUP BY 1""",
    "P16_remove_terms": "SELECT doc_id, md5(regexp_replace(text, '[Tt]he|[Aa]nd', '', 'g')) AS text_md5 FROM documents",
    "P17_flatten_hierarchy": """WITH e AS (SELECT event_id, event_type AS a, 'u' || CAST(user_id AS VARCHAR) AS b,
  'k' || regexp_extract(props, '(\\d+)', 1) AS c FROM events)
SELECT event_id, a AS topic, a AS category_0, NULL AS category_1, NULL AS category_2, NULL AS category_3, NULL AS category_4 FROM e
UNION ALL SELECT event_id, b, a, b, NULL, NULL, NULL FROM e
UNION ALL SELECT event_id, 'solo', a, 'solo', NULL, NULL, NULL FROM e
UNION ALL SELECT event_id, c, a, b, c, NULL, NULL FROM e
UNION ALL SELECT event_id, 'd', a, b, c, 'd', NULL FROM e WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'e', a, b, c, 'd', 'e' FROM e WHERE event_id % 3 = 0""",
    "P18_add_noise_rows": f"""WITH {CORPUS_CTE}, topics AS (SELECT topic, row_number() OVER (ORDER BY md5(topic)) - 1 AS pos FROM (SELECT DISTINCT topic FROM corpus WHERE topic IS NOT NULL)),
sizes AS (SELECT count(*) AS n, (SELECT count(*) FROM topics) AS m FROM corpus),
noise AS (SELECT unnest(range(CAST(floor(0.25 * n) AS BIGINT))) AS noise, m FROM sizes),
gaps AS (SELECT noise, m, i, CASE WHEN i = 0 THEN CAST('0x' || substr(md5(noise || ':start:67'), 1, 15) AS BIGINT) % m
  ELSE 1 + CAST('0x' || substr(md5(noise || ':gap' || i || ':67'), 1, 15) AS BIGINT) % greatest(m // 10, 1) END AS step FROM noise, range(10) t(i)),
picks AS (SELECT noise, i, CAST(sum(step) OVER (PARTITION BY noise ORDER BY i) AS BIGINT) % m AS pos FROM gaps),
made AS (SELECT noise, string_agg(topic, ', ' ORDER BY i) AS topic FROM picks JOIN topics USING (pos) GROUP BY noise)
SELECT false AS is_noise, md5(topic) AS topic_md5, category_0 FROM corpus UNION ALL SELECT true, md5(topic), NULL FROM made""",
    "P19_parse_topic_reply": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '|' || lang WHEN 1 THEN lang
  WHEN 2 THEN source || '|' || lang ELSE source END AS topics FROM documents""",
    "P19_parse_synonym_reply": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang || '|x'
  ELSE source || '|' || lang END AS synonyms FROM documents""",
    "P20_run_plan": f"""SELECT embedding_model, m AS reduction_method, p AS reduction_params,
  substr(md5(p), 1, 8) AS params_key, cluster_method
FROM (SELECT DISTINCT event_type AS embedding_model FROM events), (VALUES {_GRID_ROWS}) g(m, p),
  (VALUES ('Agglomerative'), ('HDBSCAN')) c(cluster_method)""",
    "P21_levels_for": f"""WITH {HIER_CTE} SELECT 'category_0' AS category, CAST(0 AS BIGINT) AS level_idx, count(DISTINCT category_0) AS n_clusters FROM hier
UNION ALL SELECT 'category_1', 1, count(DISTINCT CASE WHEN id % 10 > 0 THEN category_1 END) + 1 FROM hier
UNION ALL SELECT 'category_2', 2, count(DISTINCT category_2) FROM hier""",
    "P22_closest_level": f"""WITH {HIER_CTE}, l AS (SELECT 0 AS level_idx, count(DISTINCT category_0) AS n FROM hier
  UNION ALL SELECT 1, count(DISTINCT category_1) FROM hier UNION ALL SELECT 2, count(DISTINCT category_2) FROM hier)
SELECT k, n AS closest, CAST(level_idx AS BIGINT) AS level_idx FROM (
  SELECT k, n, level_idx, row_number() OVER (PARTITION BY k ORDER BY abs(k - n), n, level_idx) AS r
  FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS k FROM part), l) WHERE r = 1""",
}
