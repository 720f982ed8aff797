"""Registered queries for the flat scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flat_scores as fs
from .relations import FLAT_CTE, flat_labels, table


def _rounded(df, *keep, digits=6):
    kept = set(keep)
    return df.select(*[F.col(c) if c in kept else F.round(c, digits).alias(c) for c in df.columns])


def _labels_by_k(spark, sf):
    part = table(spark, sf, "part")
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in (2, 3, 4, 5)]))
    a = part.select(ks.alias("k"), F.col("p_partkey").alias("id"), "p_size").select(
        "k", "id", (F.col("p_size") % F.col("k")).cast("string").alias("cluster")
    )
    ks_b = F.explode(F.array(*[F.lit(k).cast("long") for k in (3, 4, 5, 6)]))
    b = part.select(ks_b.alias("k"), F.col("p_partkey").alias("id"), "p_type").select(
        "k", "id", (F.length("p_type") % F.col("k")).cast("string").alias("cluster")
    )
    return a, b


def _partial_labels(spark, sf):
    docs = table(spark, sf, "documents")
    marks = table(spark, sf, "labels")
    target = docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("target")
    )
    pred = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("pred"))
    return target, pred


QUERIES = {
    "P23_aligned_labels": lambda s, d: fs.aligned_labels(*_partial_labels(s, d)).select("id", "target", "pred"),
    "F1_contingency": lambda s, d: fs.contingency(flat_labels(s, d)),
    "F2_fm_index": lambda s, d: _rounded(fs.fm_index(flat_labels(s, d))),
    "F3_fm_moments": lambda s, d: _rounded(fs.fm_moments(flat_labels(s, d)), digits=9),
    "F4_fm_significance": lambda s, d: _rounded(fs.fm_significance(flat_labels(s, d)), "significant"),
    "F5_bk_curve": lambda s, d: _rounded(fs.bk_curve(*_labels_by_k(s, d)), "k", digits=8),
    "F6_rand_index": lambda s, d: _rounded(fs.rand_index(flat_labels(s, d))),
    "F7_adjusted_rand": lambda s, d: _rounded(fs.adjusted_rand(flat_labels(s, d))),
    "F8_adjusted_mutual_info": lambda s, d: _rounded(fs.adjusted_mutual_info(flat_labels(s, d))),
}

_SUMS = f"""WITH {FLAT_CTE},
cells AS (SELECT target, pred, CAST(count(*) AS DOUBLE) AS c FROM flat GROUP BY 1, 2),
ma AS (SELECT target, sum(c) AS c FROM cells GROUP BY 1),
mb AS (SELECT pred, sum(c) AS c FROM cells GROUP BY 1),
s AS (SELECT (SELECT sum(c) FROM cells) AS n, (SELECT sum(c*c) FROM cells) AS sij,
  (SELECT sum(c*c) FROM ma) AS sa, (SELECT sum(c*c) FROM mb) AS sb,
  (SELECT sum(c*(c-1)*(c-2)) FROM ma) AS pc, (SELECT sum(c*(c-1)*(c-2)) FROM mb) AS qc),
f AS (SELECT n, sij - n AS t, sa - n AS p, sb - n AS q, pc, qc, sij, sa, sb FROM s)
"""
_FM = "t / sqrt(p * q)"
_E = "sqrt(p * q) / (n * (n - 1))"
_V = """(2.0 / (n * (n - 1)) + 4 * pc * qc / (n * (n - 1) * (n - 2) * p * q)
  + (p - 2 - 4 * pc / p) * (q - 2 - 4 * qc / q) / (n * (n - 1) * (n - 2) * (n - 3))
  - p * q / (n * n * (n - 1) * (n - 1)))"""

SQL = {
    "P23_aligned_labels": """SELECT d.doc_id AS id, CAST(l.quality AS BIGINT) AS target, d.source AS pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL""",
    "F1_contingency": f"WITH {FLAT_CTE} SELECT target, pred, count(*) AS n_ij FROM flat GROUP BY 1, 2",
    "F2_fm_index": _SUMS + f"SELECT round({_FM}, 6) AS fm FROM f",
    "F3_fm_moments": _SUMS + f"SELECT round({_FM}, 9) AS fm, round({_E}, 9) AS e_fm, round({_V}, 9) AS v_fm FROM f",
    "F4_fm_significance": _SUMS + f"""SELECT round({_FM}, 6) AS fm, round({_E} + 1.645 * sqrt{_V}, 6) AS threshold,
  {_FM} > {_E} + 1.645 * sqrt{_V} AS significant FROM f""",
    "F5_bk_curve": f"""WITH l AS (
  SELECT k, CAST(p_size % k AS VARCHAR) AS target, CAST(length(p_type) % k AS VARCHAR) AS pred
  FROM part CROSS JOIN (SELECT unnest([3, 4, 5])::BIGINT AS k)),
cells AS (SELECT k, target, pred, CAST(count(*) AS DOUBLE) AS c FROM l GROUP BY 1, 2, 3),
ma AS (SELECT k, target, sum(c) AS c FROM cells GROUP BY 1, 2),
mb AS (SELECT k, pred, sum(c) AS c FROM cells GROUP BY 1, 2),
x AS (SELECT k, sum(c) AS n, sum(c*c) AS sij FROM cells GROUP BY 1),
y AS (SELECT k, sum(c*c) AS sa, sum(c*(c-1)*(c-2)) AS pc FROM ma GROUP BY 1),
z AS (SELECT k, sum(c*c) AS sb, sum(c*(c-1)*(c-2)) AS qc FROM mb GROUP BY 1),
f AS (SELECT k, n, sij - n AS t, sa - n AS p, sb - n AS q, pc, qc FROM x JOIN y USING (k) JOIN z USING (k))
SELECT k, round({_FM}, 8) AS fm, round({_E}, 8) AS e_fm, round({_V}, 8) AS v_fm FROM f""",
    "F6_rand_index": _SUMS + "SELECT round(1 - (sa + sb - 2 * sij) / (n * (n - 1)), 6) AS rand FROM f",
    "F7_adjusted_rand": _SUMS + """SELECT round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari
FROM (SELECT *, n * (n - 1) - tp - fn - fp AS tn FROM (SELECT n, sij - n AS tp, sa - sij AS fn, sb - sij AS fp FROM f))""",
    "F8_adjusted_mutual_info": f"""WITH {FLAT_CTE},
cells AS (SELECT target, pred, CAST(count(*) AS DOUBLE) AS c FROM flat GROUP BY 1, 2),
ma AS (SELECT target, sum(c) AS a FROM cells GROUP BY 1),
mb AS (SELECT pred, sum(c) AS b FROM cells GROUP BY 1),
tot AS (SELECT sum(c) AS n FROM cells),
mi AS (SELECT sum(c / n * ln(n * c / (a * b))) AS mi FROM cells JOIN ma USING (target) JOIN mb USING (pred), tot),
h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM ma, tot) AS hu, (SELECT -sum(b / n * ln(b / n)) FROM mb, tot) AS hv),
ab AS (SELECT a, b, n, unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS m
  FROM ma, mb, tot),
emi AS (SELECT sum(m / n * ln(n * m / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1)
  - lgamma(n + 1) - lgamma(m + 1) - lgamma(a - m + 1) - lgamma(b - m + 1) - lgamma(n - a - b + m + 1))) AS emi FROM ab)
SELECT round(mi, 6) AS mi, round(emi, 6) AS emi, round((mi - emi) / ((hu + hv) / 2 - emi), 6) AS ami FROM mi, h, emi""",
}
