"""Registered queries for vectors, neighbour graphs and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import l2_normalize
from ..functions.text import ASCII_SPACE
from ..operators import pivots as pv, reductions as rd, tiles as t
from ..operators.descent import knn_graph_descent
from ..operators.describe import describe_clusters
from .relations import CORPUS_CTE, POINTS_CTE, corpus, flat_points, points


def _normalized(s, d):
    raw = points(s, d).select("id", F.transform("vec", lambda x: x * F.col("id")).alias("vec"))
    return raw.select("id", F.posexplode(l2_normalize(F.col("vec"))).alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
    )


def _pairs(s, d):
    return t.all_pairs(points(s, d)).select("i", "j", F.round("d", 6).alias("d"))


def _knn(s, d, include_self):
    near = pv.knn_graph(points(s, d), 10, include_self)
    return near.select("i", "j", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


def _coordinates(df):
    return df.select("id", *[F.round(F.col("vec")[a], 6).alias(f"x{a}") for a in (0, 1)])


def _potential(s, d):
    data = points(s, d)
    return _coordinates(rd.diffusion_potential(data, rd.alpha_decay_operator(data, 5, 40), t="auto"))


def _layout(s, d):
    data = points(s, d)
    return _coordinates(rd.graph_layout(rd.fuzzy_knn_graph(data, 10), rd.pca(data, 2)))


def _table(s, d):
    stacked = rd.reductions_table(points(s, d), {"First": flat_points(s, d)})
    return stacked.select("method", "id", F.size("vec").cast("long").alias("dims"), F.round(F.col("vec")[1], 6).alias("second"))


def _described(s, d):
    df = describe_clusters(corpus(s, d).select(F.col("category_1").alias("cluster"), F.col("topic").alias("text")), 5)
    return df.select("cluster", F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 6).alias("weight"))


QUERIES = {
    "V1_embed_text": lambda s, d: rd.embed_text(corpus(s, d), "topic", 64).select("id", F.round(F.col("vec")[0], 6).alias("x0"), F.size("vec").alias("dims")),
    "V2_l2_normalize": _normalized,
    "V3_pairwise_distance": _pairs,
    "V4_knn_graph": lambda s, d: _knn(s, d, False),
    "V4_knn_graph_self": lambda s, d: _knn(s, d, True),
    "V5_knn_graph_approx": lambda s, d: rd.knn_graph_approx(points(s, d), 10),
    "V5_knn_graph_descent": lambda s, d: knn_graph_descent(points(s, d), 10),
    "V6_pca": lambda s, d: _coordinates(rd.pca(points(s, d), 2)),
    "V7_fuzzy_knn_graph": lambda s, d: rd.fuzzy_knn_graph(points(s, d), 10).withColumn("w", F.round("w", 6)),
    "V8_perplexity_affinities": lambda s, d: rd.perplexity_affinities(points(s, d), 30).withColumn("p", F.round("p", 9)),
    "V9_alpha_decay_operator": lambda s, d: rd.alpha_decay_operator(points(s, d), 5, 10).select("i", "j", F.round("w", 6).alias("w")),
    "V10_diffusion_potential": _potential,
    "V11_mine_triplets": lambda s, d: rd.mine_triplets(points(s, d)).withColumn("weight", F.round("weight", 6)),
    "V12_mine_pairs": lambda s, d: rd.mine_pairs(points(s, d)),
    "V13_graph_layout": _layout,
    "V14_reductions_table": _table,
    "T22_describe_clusters": _described,
}

_NEAR = f"""{POINTS_CTE}, pairs AS (SELECT a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS d FROM points a, points b)"""


def _nearest(k: int) -> str:
    return f"""near AS (SELECT i, j, d, r FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pairs WHERE i <> j) WHERE r <= {k})"""


def _bisected(gaps: str, too_big: str) -> str:
    """The scale of each row, by the same halvings: ``near`` -> ``scales(i, s)``."""
    return f"""rows AS (SELECT i, list({gaps} ORDER BY d, j) AS g FROM (SELECT i, j, d, min(d) OVER (PARTITION BY i) AS lo FROM near) GROUP BY 1),
halved AS (SELECT i, g, 0.0::DOUBLE AS a, 'inf'::DOUBLE AS b, 1.0::DOUBLE AS s, 0 AS turn FROM rows
  UNION ALL SELECT i, g, a, b, CASE WHEN isinf(b) THEN a * 2 ELSE (a + b) / 2 END, turn FROM (
    SELECT i, g, CASE WHEN big THEN a ELSE s END AS a, CASE WHEN big THEN s ELSE b END AS b, turn + 1 AS turn FROM (
      SELECT *, {too_big} AS big FROM halved WHERE turn < {rd.HALVINGS}))),
scales AS (SELECT i, s FROM halved WHERE turn = {rd.HALVINGS})"""


_SIGMA = """sigma AS (SELECT i, greatest(avg(d), 1e-10) AS s FROM near WHERE r BETWEEN 4 AND 6 GROUP BY 1)"""
_PLACES = "places AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM points), n AS (SELECT count(*) AS n FROM points)"


def _drawn(name: str, anchors: str, keys: str, count: int, tag: str) -> str:
    """``count`` positions per anchor row by the keyed permutation: ``name(anchor columns, nth, pos)``."""
    hashed = lambda x: f"CAST(concat('0x', substr(md5({x}), 1, 15)) AS BIGINT)"
    mirror = f"((({hashed("key || ':' || turn")} - pos) % n + n) % n)"
    return f"""{name}_t AS (SELECT a.*, md5(concat_ws(':', {keys}, '{tag}')) AS key, nth, nth AS pos, 0 AS turn FROM ({anchors}) a, range({count}) x(nth), n WHERE nth < n
  UNION ALL SELECT * EXCLUDE (mirror) REPLACE (CASE WHEN {hashed("key || ':' || turn || ':' || greatest(pos, mirror)")} % 2 = 1 THEN mirror ELSE pos END AS pos, turn + 1 AS turn)
    FROM (SELECT t.*, {mirror} AS mirror FROM {name}_t t, n WHERE turn < {rd.TURNS})),
{name} AS (SELECT * EXCLUDE (turn, key) FROM {name}_t WHERE turn = {rd.TURNS})"""


def _far(name: str, by: str, near: str, count: int) -> str:
    return f"""{name}_far AS (SELECT * FROM (SELECT d.*, p.id AS far, row_number() OVER (PARTITION BY {by} ORDER BY nth) AS r FROM {name} d JOIN places p USING (pos)
  WHERE p.id <> i AND NOT EXISTS (FROM {near} x WHERE x.i = d.i AND x.j = p.id)) WHERE r <= {count})"""


SQL = {
    "V7_fuzzy_knn_graph": f"""WITH RECURSIVE {_NEAR}, {_nearest(10)}, {_bisected("greatest(d - lo, 0.0)", "list_sum(list_transform(g, lambda x: exp(-x / s))) > log2(10)")},
e AS (SELECT i, j, exp(-greatest(d - min(d) OVER (PARTITION BY i), 0.0) / s) AS w FROM near JOIN scales USING (i)),
u AS (SELECT i, j, max(a) AS a, max(b) AS b FROM (SELECT i, j, w AS a, 0.0 AS b FROM e UNION ALL SELECT j, i, 0.0, w FROM e) GROUP BY 1, 2)
SELECT i, j, round(a + b - a * b, 6) AS w FROM u""",
    "V8_perplexity_affinities": f"""WITH RECURSIVE {_NEAR}, {_nearest(90)}, {_bisected("d * d - lo * lo",
        "(ln(list_sum(list_transform(g, lambda x: exp(-x / s)))) + list_sum(list_transform(g, lambda x: x / s * exp(-x / s))) / list_sum(list_transform(g, lambda x: exp(-x / s)))) > ln(30)")},
e AS (SELECT i, j, exp((pow(min(d) OVER (PARTITION BY i), 2) - d * d) / s) AS w FROM near JOIN scales USING (i)),
c AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM e),
u AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM c UNION ALL SELECT j, i, w FROM c) GROUP BY 1, 2)
SELECT i, j, round(w / (2 * (SELECT count(*) FROM points)), 9) AS p FROM u""",
    "V11_mine_triplets": f"""WITH RECURSIVE {_NEAR}, {_nearest(12)}, {_SIGMA}, {_PLACES},
{_drawn("mined", "SELECT i, j, d FROM near", "i, j", 17, "far:67")}, {_far("mined", "i, j", "near", 4)},
{_drawn("loose", "SELECT id AS i FROM points", "i", 19, "far:68")}, {_far("loose", "i", "near", 6)},
halves AS (SELECT i, far, p.d, (row_number() OVER (PARTITION BY l.i ORDER BY far) - 1) // 2 AS t FROM loose_far l JOIN pairs p USING (i) WHERE p.j = far),
paired AS (SELECT i, min({{'d': d, 'far': far}}) AS a, max({{'d': d, 'far': far}}) AS b FROM halves GROUP BY i, t HAVING count(*) = 2),
triplets AS (SELECT i, j, d, far FROM mined_far UNION ALL SELECT i, a.far, a.d, b.far FROM paired),
gaps AS (SELECT t.i, t.j, far, p.d * p.d / (si.s * sf.s) - t.d * t.d / (si.s * sj.s) AS gap FROM triplets t JOIN pairs p ON p.i = t.i AND p.j = far
  JOIN sigma si ON si.i = t.i JOIN sigma sj ON sj.i = t.j JOIN sigma sf ON sf.i = far)
SELECT i AS anchor, j AS near, far, round(ln(1 + gap - min(gap) OVER ()), 6) AS weight FROM gaps""",
    "V12_mine_pairs": f"""WITH RECURSIVE {_NEAR}, {_nearest(60)}, {_SIGMA}, {_PLACES},
scaled AS (SELECT near.i, near.j, row_number() OVER (PARTITION BY near.i ORDER BY d * d / (a.s * b.s), near.j) AS r FROM near JOIN sigma a ON a.i = near.i JOIN sigma b ON b.i = near.j),
close AS (SELECT i, j FROM scaled WHERE r <= 10),
{_drawn("mid", "SELECT id AS i FROM points", "i", 31, "mid:67")},
tries AS (SELECT m.i, p.id AS j, (row_number() OVER (PARTITION BY m.i ORDER BY nth) - 1) // 6 AS turn FROM mid m JOIN places p USING (pos) WHERE p.id <> m.i),
second AS (SELECT t.i, t.j, row_number() OVER (PARTITION BY t.i, turn ORDER BY d, t.j) AS r FROM tries t JOIN pairs p USING (i, j) WHERE turn < 5),
{_drawn("far", "SELECT id AS i FROM points", "i", 31, "far:67")}, {_far("far", "i", "close", 20)}
SELECT i, j, 'near' AS kind FROM close UNION ALL SELECT i, j, 'mid' FROM second WHERE r = 2 UNION ALL SELECT i, far, 'far' FROM far_far""",
    "V2_l2_normalize": """WITH x AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) * vec_id AS x FROM embeddings),
n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1)
SELECT id, CAST(pos AS BIGINT) AS pos, round(x / (CASE WHEN n > 0 THEN n ELSE 1 END), 6) AS x FROM x JOIN n USING (id)""",
    "V3_pairwise_distance": f"WITH {_NEAR} SELECT i, j, round(d, 6) AS d FROM pairs WHERE i < j",
    "V4_knn_graph": f"""WITH {_NEAR} SELECT i, j, round(d, 6) AS d, rank FROM (
  SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pairs WHERE i <> j) WHERE rank <= 10""",
    "V4_knn_graph_self": f"""WITH {_NEAR} SELECT i, j, round(d, 6) AS d, rank FROM (
  SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pairs) WHERE rank <= 10""",
    "V9_alpha_decay_operator": f"""WITH {_NEAR},
near AS (SELECT i, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pairs WHERE i <> j) WHERE r <= 5),
eps AS (SELECT i, max(d) AS eps FROM near GROUP BY 1),
e AS (SELECT i, j, exp(-pow(d / eps, 10)) AS w FROM pairs JOIN eps USING (i) WHERE i <> j),
k AS (SELECT i, j, sum(w) / 2 AS w FROM (SELECT i, j, w FROM e UNION ALL SELECT j, i, w FROM e) GROUP BY 1, 2 HAVING sum(w) > 0
  UNION ALL SELECT id, id, 1.0 FROM points)
SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM k""",
    "T22_describe_clusters": f"""WITH {CORPUS_CTE}, w AS (SELECT category_1 AS cluster, unnest(regexp_extract_all(lower(topic), '[^{ASCII_SPACE}]+')) AS term FROM corpus),
c AS (SELECT cluster, term, count(*) AS tf FROM w GROUP BY 1, 2),
o AS (SELECT term, sum(tf) AS all_tf FROM c GROUP BY 1), z AS (SELECT cluster, sum(tf) AS terms FROM c GROUP BY 1),
x AS (SELECT cluster, term, round(tf / terms * ln(1 + (SELECT avg(terms) FROM z) / all_tf), 9) AS weight FROM c JOIN o USING (term) JOIN z USING (cluster))
SELECT cluster, rank, term, round(weight, 6) AS weight FROM (
  SELECT cluster, term, weight, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank FROM x) WHERE rank <= 5""",
    "V14_reductions_table": """SELECT 'Raw' AS method, vec_id AS id, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[2] AS DOUBLE), 6) AS second FROM embeddings
UNION ALL SELECT 'First', vec_id, 2, round(CAST(embedding[2] AS DOUBLE), 6) FROM embeddings""",
}
