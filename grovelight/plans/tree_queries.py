"""Registered queries for trees, cluster trees and tree scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as c, graph as g, pivots as pv, tree_scores as ts, trees as tr
from ..sources.scratch import Scratch
from .benchmark import score_levels, score_tree
from .evaluation import CLUSTERERS, evaluate
from .relations import HIER_CTE, POINTS_CTE, hierarchy, point_labels, points, table


def _truth(s, d):
    return tr.ground_truth_tree(hierarchy(s, d), 3)


def _places(s, d):
    return tr.ground_truth_tree(hierarchy(s, d), 2)


def _markets(s, d):
    h = hierarchy(s, d).select("id", F.col("category_2").alias("category_0"), F.col("category_0").alias("category_1"))
    return tr.ground_truth_tree(h, 2)


def _market_labels(s, d):
    return hierarchy(s, d).select("id", F.col("category_2").alias("label"))


def _comb(s, d):
    """Customers merged one after the other: the deepest tree there is. Node ``n + i`` joins customer ``i + 1``."""
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("leaf"))
    n = customers.agg(F.count(F.lit(1)))
    rows = customers.where("leaf > 0").withColumn("n", n.scalar())
    return rows.select(
        (F.col("n") + F.col("leaf") - 1).alias("node"),
        F.when(F.col("leaf") == 1, F.lit(0)).otherwise(F.col("n") + F.col("leaf") - 2).cast("long").alias("left"),
        F.col("leaf").alias("right"), F.col("leaf").cast("double").alias("height"), (F.col("leaf") + 1).alias("size"),
    )


def _levels(s, ks):
    return s.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k"))


def _cluster_sizes(cut):
    return cut.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).select("k", "size", "first")


def _lcas(s, d):
    index = tr.index_tree(_truth(s, d))
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("i"))
    n = customers.agg(F.count(F.lit(1)))
    pairs = customers.withColumn("j", F.pmod(F.col("i") * 7 + 1, n.scalar())).where("i <> j")
    return tr.lca(index, pairs).join(index.nodes.select(F.col("node").alias("anc"), "size"), "anc").select("i", "j", "anc", "size")


def _children(s, d):
    return tr.children_lists(_truth(s, d))


def _summary(s, d):
    df = tr.tree_summary(_truth(s, d))
    return df.select(F.col("depth").cast("long").alias("depth"), "nodes", F.round("mean_children", 6).alias("mean_children"), "min_children", "max_children")


def _operator(s, d):
    return c.diffusion_operator(points(s, d), k=10, alpha=3).select("i", "j", F.round("w", 6).alias("w"))


def _step(s, d):
    data = points(s, d)
    moved = c.diffusion_step(c.diffusion_operator(data, k=10, alpha=3), data, 1)
    return moved.select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _log(s, d):
    data = points(s, d)
    ids = data.select("id", F.col("id").alias("cluster"), F.lit(1).cast("long").alias("size"))
    top = data.agg(F.max("id")).first()[0]
    log = c.merge_log(c.merge_close(data, 1.15), ids, top + 1)
    return log.select("a", "b", "new_id", F.round("d", 6).alias("d"), "size")


def _components(s, d):
    return c.single_linkage_components(points(s, d), 1.1)


def _graph_parts(s, d):
    data = points(s, d)
    return g.connected_components(data.select(F.col("id").alias("node")), pv.knn_graph(data, 2).select("i", "j"))


def _membership(s, d):
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("long").alias("cluster"))
    nations = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("item"), F.col("n_regionkey").cast("long").alias("cluster"))
    return c.membership_table([customers, nations])


def _merges(df):
    return df.select("node", "left", "right", F.round("height", 6).alias("height"), "size")


def _nary_scores(s, d):
    """The tree of market segments and regions, scored against regions and nations."""
    labels = hierarchy(s, d).select("id", "category_0", "category_1")
    scored = score_tree(_markets(s, d), labels, 2, "given", "None", "Markets")
    return scored.select("level_idx", F.col("level").cast("long").alias("level"), *[F.round(m, 6).alias(m) for m in ("fm", "rand", "ari")], "tree_difference")


def _evaluation(s, d):
    folder = f"{Scratch(s).root}/evaluation"
    return evaluate(points(s, d), point_labels(s, d), 2, folder, "given", clusterers={n: CLUSTERERS[n] for n in ("HDBSCAN", "KMeansTree")})


QUERIES = {
    "T1_ground_truth_tree": lambda s, d: _truth(s, d).select("node", "parent", "size", "is_leaf"),
    "T2_ward_tree": lambda s, d: _merges(c.ward_tree(points(s, d))),
    "T3_single_linkage_tree": lambda s, d: _merges(c.single_linkage_tree(points(s, d))),
    "T4_single_linkage_components": _components,
    "T5_diffusion_operator": _operator,
    "T6_diffusion_step": _step,
    "T7_merge_close": lambda s, d: c.merge_close(points(s, d), 1.15).select("j", "i", F.round("d", 6).alias("d")),
    "T8_merge_log": _log,
    "T9_diffusion_condensation": lambda s, d: _merges(c.diffusion_condensation(points(s, d))),
    "T10_tree_from_merges": lambda s, d: tr.tree_from_merges(_comb(s, d)),
    "T11_cut_by_height": lambda s, d: _cluster_sizes(tr.cut_by_height(_comb(s, d), _levels(s, (2, 10)))),
    "T12_cut_by_size": lambda s, d: _cluster_sizes(tr.cut_by_size(tr.tree_from_merges(_comb(s, d)), _levels(s, (2, 10)))),
    "T13_tree_intervals": lambda s, d: tr.tree_intervals(_truth(s, d)).where("NOT is_leaf").select("node", "lo", "hi"),
    "T14_leaves_under": lambda s, d: tr.leaves_under(_truth(s, d)),
    "T15_ancestors": lambda s, d: tr.ancestors(_truth(s, d)).select("node", "anc", F.col("steps").cast("long").alias("steps")),
    "T16_lca": lambda s, d: _lcas(s, d),
    "T17_children_lists": _children,
    "T18_tree_summary": _summary,
    "T19_hierarchical_kmeans": lambda s, d: c.hierarchical_kmeans(points(s, d), [40, 10, 2]),
    "T20_membership_table": _membership,
    "T21_membership_to_tree": lambda s, d: tr.membership_to_tree(
        _membership(s, d).withColumn("level_3", F.lit(0).cast("long")), ["level_1", "level_2", "level_3"]
    ),
    "T23_clade_difference": lambda s, d: tr.clade_difference(_truth(s, d), _markets(s, d)),
    "T24_connected_components": _graph_parts,
    "H1_sample_class_pairs": lambda s, d: ts.sample_class_pairs(_market_labels(s, d), 1000, 67),
    "H2_dendrogram_purity_sampled": lambda s, d: ts.dendrogram_purity_sampled(_places(s, d), _market_labels(s, d)).withColumn(
        "dendrogram_purity", F.round("dendrogram_purity", 6)
    ),
    "H3_dendrogram_purity": lambda s, d: ts.dendrogram_purity(_places(s, d), _market_labels(s, d)).select(
        F.round("dendrogram_purity", 6).alias("dendrogram_purity")
    ),
    "H4_lca_f1_sampled": lambda s, d: ts.lca_f1_sampled(_places(s, d), _markets(s, d), _market_labels(s, d)).withColumn("lca_f1", F.round("lca_f1", 6)),
    "H5_lca_f1": lambda s, d: ts.lca_f1(_places(s, d), _markets(s, d), _market_labels(s, d)).select(F.round("lca_f1", 6).alias("lca_f1")),
    "F9_score_tree": _nary_scores,
    "F9_evaluation_run": _evaluation,
    "F9_score_levels": lambda s, d: score_levels(c.single_linkage_tree(points(s, d)), point_labels(s, d), 2, "given", "Raw", "HDBSCAN"),
}

_TREE = f"""{HIER_CTE}, n AS (SELECT count(*) AS n FROM hier),
prefixes AS (
  SELECT 3 AS lvl, category_0 AS a, category_1 AS b, category_2 AS c, count(*) AS size FROM hier GROUP BY ALL
  UNION ALL SELECT 2, category_0, category_1, NULL, count(*) FROM hier GROUP BY ALL HAVING count(DISTINCT category_2) > 1
  UNION ALL SELECT 1, category_0, NULL, NULL, count(*) FROM hier GROUP BY ALL HAVING count(DISTINCT category_1) > 1
  UNION ALL SELECT 0, NULL, NULL, NULL, count(*) FROM hier HAVING count(DISTINCT category_0) > 1),
inner_nodes AS (SELECT *, n + row_number() OVER (ORDER BY lvl DESC, a, b, c) - 1 AS node FROM prefixes, n),
tree AS (
  SELECT x.node, (SELECT arg_max(y.node, y.lvl) FROM inner_nodes y WHERE y.lvl < x.lvl AND (y.lvl < 1 OR y.a = x.a) AND (y.lvl < 2 OR y.b = x.b)) AS parent,
    x.size, false AS is_leaf FROM inner_nodes x
  UNION ALL SELECT h.id, x.node, 1, true FROM hier h JOIN inner_nodes x ON x.lvl = 3 AND x.a = h.category_0 AND x.b = h.category_1 AND x.c = h.category_2),
up AS (SELECT node, node AS anc, 0 AS steps FROM tree
  UNION ALL SELECT up.node, tree.parent, steps + 1 FROM up JOIN tree ON tree.node = up.anc WHERE tree.parent IS NOT NULL)"""

_NEAR = f"{POINTS_CTE}, pairs AS (SELECT a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS d FROM points a, points b WHERE a.id <> b.id)"
_OPERATOR = f"""{_NEAR},
near AS (SELECT i, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pairs) WHERE r <= 9 AND d > 0),
e AS (SELECT i, j, max(d) AS d FROM (SELECT i, j, d FROM near UNION ALL SELECT j, i, d FROM near) GROUP BY 1, 2),
k AS (SELECT i, j, exp(-pow(d / max(d) OVER (PARTITION BY i), 3)) AS w FROM e),
op AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM k)"""
_CLOSE = f"""{_NEAR}, low_pairs AS (SELECT i AS j, j AS i, d FROM pairs WHERE j < i AND d < 1.15),
close AS (SELECT j, i, d FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY d, i) AS r FROM low_pairs) WHERE r = 1)"""
_LABEL_COUNTS = f"""{HIER_CTE}, nat AS (SELECT category_0 AS r, category_1 AS n, category_2 AS c, CAST(count(*) AS DOUBLE) AS m FROM hier GROUP BY ALL),
reg AS (SELECT r, c, sum(m) AS m, sum(m * (m - 1) / 2) AS inside FROM nat GROUP BY ALL),
al AS (SELECT c, sum(m) AS m, sum(m * (m - 1) / 2) AS inside FROM reg GROUP BY ALL),
nn AS (SELECT r, n, sum(m) AS s FROM nat GROUP BY ALL), rr AS (SELECT r, sum(m) AS s FROM reg GROUP BY ALL), tt AS (SELECT sum(m) AS s FROM al)"""

_DRAWN = f"""{HIER_CTE}, l AS (SELECT id, category_2 AS label, row_number() OVER (PARTITION BY category_2 ORDER BY id) - 1 AS pos FROM hier WHERE category_2 IS NOT NULL),
s AS (SELECT label, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS w FROM l GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT label, n, CAST(sum(w) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) - w AS BIGINT) AS start, CAST(sum(w) OVER () AS BIGINT) AS total FROM s),
draws AS (SELECT pair, CAST('0x' || substr(md5(pair || ':class:67'), 1, 15) AS BIGINT) AS rc, CAST('0x' || substr(md5(pair || ':a:67'), 1, 15) AS BIGINT) AS ra,
  CAST('0x' || substr(md5(pair || ':b:67'), 1, 15) AS BIGINT) AS rb FROM range(1000) t(pair)),
chosen AS (SELECT pair, label, ra % n AS a, rb % (n - 1) AS b0 FROM draws, c
  QUALIFY start <= floor(total * (rc / 1152921504606846976.0::DOUBLE)) AND row_number() OVER (PARTITION BY pair, start <= floor(total * (rc / 1152921504606846976.0::DOUBLE)) ORDER BY start DESC) = 1),
drawn AS (SELECT pair, label, x.id AS i, y.id AS j FROM chosen JOIN l x USING (label) JOIN l y USING (label) WHERE x.pos = a AND y.pos = b0 + CASE WHEN b0 >= a THEN 1 ELSE 0 END)"""
_MET = f"""{_DRAWN}, met AS (
  SELECT x.category_0 = y.category_0 AND x.category_1 = y.category_1 AS same_n, x.category_0 = y.category_0 AS same_r,
    CAST((SELECT count(*) FROM hier h WHERE h.category_0 = x.category_0 AND h.category_1 = x.category_1 AND h.category_2 = label) AS DOUBLE) AS rnc,
    CAST((SELECT count(*) FROM hier h WHERE h.category_0 = x.category_0 AND h.category_1 = x.category_1) AS DOUBLE) AS rn,
    CAST((SELECT count(*) FROM hier h WHERE h.category_0 = x.category_0 AND h.category_2 = label) AS DOUBLE) AS rc,
    CAST((SELECT count(*) FROM hier h WHERE h.category_0 = x.category_0) AS DOUBLE) AS r,
    CAST((SELECT count(*) FROM hier h WHERE h.category_2 = label) AS DOUBLE) AS c, CAST((SELECT count(*) FROM hier) AS DOUBLE) AS t
  FROM drawn JOIN hier x ON x.id = i JOIN hier y ON y.id = j)"""


def _component_sql(edges: str) -> str:
    return f"""WITH RECURSIVE {_NEAR}, near AS ({edges}),
both_ways AS (SELECT i, j FROM near UNION SELECT j, i FROM near),
reach AS (SELECT id AS node, id AS other FROM points UNION SELECT reach.node, b.j FROM reach JOIN both_ways b ON b.i = reach.other)
SELECT node, min(other) AS comp FROM reach GROUP BY 1"""


SQL = {
    "T1_ground_truth_tree": f"WITH RECURSIVE {_TREE} SELECT node, parent, size, is_leaf FROM tree",
    "T4_single_linkage_components": _component_sql("SELECT i, j FROM pairs WHERE d <= 1.1"),
    "T5_diffusion_operator": f"WITH {_OPERATOR} SELECT i, j, round(w, 6) AS w FROM op",
    "T6_diffusion_step": f"""WITH {_OPERATOR}, x AS (SELECT id, unnest(range(len(vec))) AS pos, unnest(vec) AS x FROM points)
SELECT i AS id, pos, round(sum(w * x), 6) AS x FROM op JOIN x ON x.id = op.j GROUP BY 1, 2""",
    "T7_merge_close": f"WITH {_CLOSE} SELECT j, i, round(d, 6) AS d FROM close",
    "T8_merge_log": f"""WITH RECURSIVE {_CLOSE}, named AS (
  SELECT j, i, d, (SELECT max(id) FROM points) + row_number() OVER (ORDER BY j DESC) AS new_id FROM close),
lagged AS (SELECT *, lag(new_id) OVER (PARTITION BY i ORDER BY j DESC) AS prev FROM named),
last AS (SELECT i AS row, max(new_id) AS last_id FROM named GROUP BY 1),
links AS (SELECT new_id, coalesce(last_id, j) AS a, coalesce(prev, i) AS b, d FROM lagged LEFT JOIN last ON last.row = lagged.j),
below AS (SELECT new_id, a AS node FROM links UNION ALL SELECT new_id, b FROM links
  UNION ALL SELECT below.new_id, unnest([l.a, l.b]) FROM below JOIN links l ON l.new_id = below.node),
sizes AS (SELECT new_id, count(*) FILTER (node <= (SELECT max(id) FROM points)) AS size FROM below GROUP BY 1)
SELECT a, b, new_id, round(d, 6) AS d, size FROM links JOIN sizes USING (new_id)""",
    "T10_tree_from_merges": """WITH n AS (SELECT count(*) AS n FROM customer)
SELECT c_custkey AS node, n + greatest(c_custkey, 1) - 1 AS parent, CAST(1 AS BIGINT) AS size, true AS is_leaf FROM customer, n
UNION ALL SELECT n + c_custkey - 1, CASE WHEN c_custkey < n - 1 THEN n + c_custkey END, c_custkey + 1, false FROM customer, n WHERE c_custkey > 0""",
    "T11_cut_by_height": """WITH n AS (SELECT count(*) AS n FROM customer), k AS (SELECT unnest([2, 10])::BIGINT AS k)
SELECT k, CAST(1 AS BIGINT) AS size, c_custkey AS first FROM customer, n, k WHERE c_custkey > n - k UNION ALL SELECT k, n - k + 1, 0 FROM n, k""",
    "T12_cut_by_size": """WITH n AS (SELECT count(*) AS n FROM customer), k AS (SELECT unnest([2, 10])::BIGINT AS k)
SELECT k, CAST(1 AS BIGINT) AS size, c_custkey AS first FROM customer, n, k WHERE c_custkey > n - k UNION ALL SELECT k, n - k + 1, 0 FROM n, k""",
    "T14_leaves_under": f"WITH RECURSIVE {_TREE} SELECT anc AS node, up.node AS leaf FROM up JOIN tree ON tree.node = up.node WHERE tree.is_leaf",
    "T15_ancestors": f"WITH RECURSIVE {_TREE} SELECT node, anc, CAST(steps AS BIGINT) AS steps FROM up",
    "T16_lca": f"""WITH RECURSIVE {_TREE}, p AS (SELECT id AS i, (id * 7 + 1) % n AS j FROM hier, n WHERE id <> (id * 7 + 1) % n)
SELECT i, j, anc, size FROM (SELECT p.i, p.j, a.anc, tree.size, row_number() OVER (PARTITION BY p.i, p.j ORDER BY a.steps) AS r
  FROM p JOIN up a ON a.node = p.i JOIN up b ON b.node = p.j AND b.anc = a.anc JOIN tree ON tree.node = a.anc) WHERE r = 1""",
    "T17_children_lists": f"""WITH RECURSIVE {_TREE} SELECT t.node, k.position, k.child FROM tree t LEFT JOIN (
  SELECT parent, node AS child, row_number() OVER (PARTITION BY parent ORDER BY node) - 1 AS position FROM tree WHERE parent IS NOT NULL) k ON k.parent = t.node""",
    "T18_tree_summary": f"""WITH RECURSIVE {_TREE}, d AS (SELECT node, CAST(max(steps) AS BIGINT) AS depth FROM up GROUP BY 1),
k AS (SELECT parent AS node, count(*) AS kids FROM tree WHERE parent IS NOT NULL GROUP BY 1)
SELECT depth, count(*) AS nodes, round(avg(kids), 6) AS mean_children, min(kids) AS min_children, max(kids) AS max_children FROM d JOIN k USING (node) GROUP BY 1""",
    "T20_membership_table": """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS level_1, CAST(n_regionkey AS BIGINT) AS level_2
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "T21_membership_to_tree": """WITH m AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT max(id) + 1 AS oa, max(id) + 1 + max(a) + 1 AS ob, max(id) + 1 + max(a) + 1 + max(b) + 1 AS oc FROM m)
SELECT id AS node, a + oa AS parent, true AS is_leaf, CAST(1 AS BIGINT) AS size FROM m, o
UNION ALL SELECT a + oa, b + ob, false, count(*) FROM m, o GROUP BY 1, 2
UNION ALL SELECT b + ob, oc, false, count(*) FROM m, o GROUP BY 1, 2
UNION ALL SELECT oc, NULL, false, count(*) FROM m, o GROUP BY 1""",
    "H1_sample_class_pairs": f"WITH {_DRAWN} SELECT pair, label, i, j FROM drawn",
    "H2_dendrogram_purity_sampled": f"""WITH {_MET} SELECT round(avg(CASE WHEN same_n THEN rnc / rn WHEN same_r THEN rc / r ELSE c / t END), 6) AS dendrogram_purity, count(*) AS pairs FROM met""",
    "H4_lca_f1_sampled": f"""WITH {_MET} SELECT round(avg(CASE WHEN same_n THEN 2 * rnc / (rn + rc) WHEN same_r THEN 2 * rc / (r + rc) ELSE 2 * c / (t + c) END), 6) AS lca_f1, count(*) AS pairs FROM met""",
    "T13_tree_intervals": f"""WITH RECURSIVE {_TREE}, before AS (
  SELECT node, coalesce(sum(size) OVER (PARTITION BY parent ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM tree WHERE parent IS NOT NULL)
SELECT t.node, CAST(coalesce(sum(earlier), 0) AS BIGINT) AS lo, CAST(coalesce(sum(earlier), 0) + any_value(t.size) - 1 AS BIGINT) AS hi
FROM tree t JOIN up ON up.node = t.node LEFT JOIN before b ON b.node = up.anc WHERE NOT t.is_leaf GROUP BY t.node""",
    "T23_clade_difference": f"""WITH RECURSIVE {_TREE},
a AS (SELECT DISTINCT leaves FROM (SELECT anc, string_agg(CAST(up.node AS VARCHAR), ',' ORDER BY up.node) AS leaves
  FROM up JOIN tree ON tree.node = up.node WHERE tree.is_leaf AND steps > 0 GROUP BY anc)),
b AS (SELECT DISTINCT leaves FROM (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS leaves FROM hier GROUP BY GROUPING SETS ((category_2), (category_2, category_0), ()))),
x AS (SELECT count(*) AS only_a FROM a WHERE leaves NOT IN (SELECT leaves FROM b)), y AS (SELECT count(*) AS only_b FROM b WHERE leaves NOT IN (SELECT leaves FROM a))
SELECT only_a, only_b, only_a + only_b AS difference FROM x, y""",
    "F9_score_tree": f"""WITH {HIER_CTE},
paired AS (SELECT 0 AS level_idx, category_0 AS target, category_2 AS pred FROM hier UNION ALL SELECT 1, category_1, category_2 || ':' || category_0 FROM hier),
cells AS (SELECT level_idx, sum(m * (m - 1) / 2) AS t FROM (SELECT level_idx, target, pred, CAST(count(*) AS DOUBLE) AS m FROM paired GROUP BY ALL) GROUP BY 1),
targets AS (SELECT level_idx, count(*) AS level, sum(m * (m - 1) / 2) AS p, sum(m) AS n FROM (SELECT level_idx, target, CAST(count(*) AS DOUBLE) AS m FROM paired GROUP BY ALL) GROUP BY 1),
preds AS (SELECT level_idx, sum(m * (m - 1) / 2) AS q FROM (SELECT level_idx, pred, CAST(count(*) AS DOUBLE) AS m FROM paired GROUP BY ALL) GROUP BY 1),
all_of AS (SELECT *, n * (n - 1) / 2 AS pairs FROM cells JOIN targets USING (level_idx) JOIN preds USING (level_idx)),
a AS (SELECT DISTINCT leaves FROM (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS leaves FROM hier GROUP BY GROUPING SETS ((category_2), (category_2, category_0), ()))),
b AS (SELECT DISTINCT leaves FROM (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS leaves FROM hier GROUP BY GROUPING SETS ((category_0), (category_0, category_1), ())))
SELECT CAST(level_idx AS INTEGER) AS level_idx, level, round(t / sqrt(p * q), 6) AS fm, round((pairs + 2 * t - p - q) / pairs, 6) AS rand,
  round((t - p * q / pairs) / ((p + q) / 2 - p * q / pairs), 6) AS ari,
  (SELECT count(*) FROM a WHERE leaves NOT IN (SELECT leaves FROM b)) + (SELECT count(*) FROM b WHERE leaves NOT IN (SELECT leaves FROM a)) AS tree_difference
FROM all_of""",
    "T24_connected_components": _component_sql("SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pairs) WHERE r <= 2"),
    "H3_dendrogram_purity": f"""WITH {_LABEL_COUNTS}
SELECT round(sum(t) / (SELECT sum(m * (m - 1) / 2) FROM al), 6) AS dendrogram_purity FROM (
  SELECT m * (m - 1) / 2 * m / s AS t FROM nat JOIN nn USING (r, n)
  UNION ALL SELECT (m * (m - 1) / 2 - inside) * m / s FROM reg JOIN rr USING (r)
  UNION ALL SELECT (m * (m - 1) / 2 - inside) * m / s FROM al, tt)""",
    "H5_lca_f1": f"""WITH {_LABEL_COUNTS}
SELECT round(sum(t) / (SELECT sum(m * (m - 1) / 2) FROM al), 6) AS lca_f1 FROM (
  SELECT nat.m * (nat.m - 1) / 2 * 2 * nat.m / (nn.s + reg.m) AS t FROM nat JOIN nn USING (r, n) JOIN reg USING (r, c)
  UNION ALL SELECT (reg.m * (reg.m - 1) / 2 - inside) * 2 * reg.m / (rr.s + reg.m) FROM reg JOIN rr USING (r)
  UNION ALL SELECT (al.m * (al.m - 1) / 2 - inside) * 2 * al.m / (tt.s + al.m) FROM al, tt)""",
}
