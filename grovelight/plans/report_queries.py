"""Registered queries for the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordering import value_ranks
from ..operators import report as rp
from .relations import SCORES_CTE, scores, table

_METRICS = ["ari", "ami", "fm", "dendrogram_purity"]
_PER_METHOD = ["reduction_method", "cluster_method"]


def _round(df, columns=_METRICS, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _avg_rank(s, d):
    items = table(s, d, "lineitem").select(F.round("l_extendedprice", 2).alias("price"))
    return value_ranks(items, "price").select("price", F.col("n").cast("long").alias("n"), "rank")


def _ranked(s, d):
    means = rp.mean_by(scores(s, d), _PER_METHOD, ["ari", "ami", "fm"])
    means = _round(means, ["ari", "ami", "fm"], 3)
    return rp.rank_methods(means).select("label", "rank_ari", "rank_ami", "rank_fm")


def _sides(s, d):
    df = rp.mean_by(scores(s, d), ["embedding_model", *_PER_METHOD], ["ari", "fm"])
    a = df.where("embedding_model = 'A'").drop("embedding_model")
    b = df.where("embedding_model = 'R'").drop("embedding_model")
    return _round(rp.side_by_side(a, b, _PER_METHOD, ("_a", "_r")), ["ari_a", "fm_a", "ari_r", "fm_r"])


def _two_groups(s, d):
    df = scores(s, d)
    out = rp.summary_two_groups(
        df.where("level <= 1995"), df.where("level >= 1995 AND cluster_method <> '7'"), "cluster_method",
        ["ari", "fm"], ("first", "second"),
    )
    return _round(out, ["first_ari", "first_fm", "second_ari", "second_fm"])


def _placeholders(s, d):
    marked = table(s, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "___").otherwise(F.col("value").cast("string")).alias("value")
    )
    return rp.placeholder_to_null(marked, ["value"])


def _config(s, d):
    part = table(s, d, "part")
    odd = F.col("p_partkey") % 2 == 0
    name = tx.config_name(
        F.when(F.col("p_size") % 2 == 0, "Energy_Ecosystems_and_Humans").otherwise("Offshore_energy_impacts_on_fisheries"),
        F.when(odd, 3).otherwise(5),
        F.when(odd, 5).otherwise(3),
        F.element_at(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5)), (F.col("p_partkey") % 3 + 1).cast("int")),
    )
    return part.select("p_partkey", name.alias("name"), tx.config_label(name).alias("label"))


def _stacked(s, d):
    df = scores(s, d)
    tables = {
        "A": df.where("embedding_model = 'A'"),
        "N": df.where("embedding_model = 'N'").drop("dendrogram_purity"),
        "R": df.where("embedding_model = 'R'"),
    }
    return rp.stack_results(tables, drop=["embedding_model", "not_there"])


def _compared(s, d):
    df = scores(s, d)
    return _round(
        rp.compare_pipelines({"F": df.where("reduction_method = 'F'"), "O": df.where("reduction_method = 'O'")}, _METRICS)
    )


QUERIES = {
    "M10_avg_rank": _avg_rank,
    "R1_median_by": lambda s, d: _round(rp.median_by(scores(s, d), _PER_METHOD, _METRICS)),
    "R2_mean_by": lambda s, d: _round(rp.mean_by(scores(s, d), _PER_METHOD, _METRICS)),
    "R3_two_stage_median": lambda s, d: _round(
        rp.two_stage_median(scores(s, d), ["embedding_model", *_PER_METHOD], _PER_METHOD, _METRICS)
    ),
    "R4_rank_methods": _ranked,
    "R5_top_k": lambda s, d: rp.top_k(
        scores(s, d), k=8, ties=["embedding_model", *_PER_METHOD, "level"]
    ),
    "R6_sort_scores": lambda s, d: rp.sort_scores(scores(s, d), then=["embedding_model", *_PER_METHOD, "level"]),
    "R7_pivot_wide": lambda s, d: rp.pivot_wide(
        scores(s, d), ["cluster_method"], "embedding_model", ["A", "N", "R"], ["ari", "fm"]
    ),
    "R8_mean_pm_std": lambda s, d: rp.mean_pm_std(scores(s, d), _PER_METHOD, ["ari", "fm"]),
    "R9_side_by_side": _sides,
    "R10_summary_two_groups": _two_groups,
    "R11_placeholder_to_null": _placeholders,
    "R12_config_label": _config,
    "R13_filter_methods": lambda s, d: rp.filter_level(
        rp.filter_methods(scores(s, d), ["1", "3", "5"], "cluster_method"), 1996
    ),
    "R14_stack_results": _stacked,
    "R15_compare_pipelines": _compared,
    "R16_mean_by_one_factor": lambda s, d: _round(
        rp.mean_by_one_factor(scores(s, d), ["cluster_method", "embedding_model", "reduction_method"], _METRICS)
    ),
}


def _sql(body: str) -> str:
    return f"WITH {SCORES_CTE} {body}"


def _each(fn: str, columns=_METRICS, digits=5) -> str:
    return ", ".join(f"round({fn}({c}), {digits}) AS {c}" for c in columns)


SQL = {
    "M10_avg_rank": """SELECT price, n, sum(n) OVER (ORDER BY price) - n + (n + 1) / 2.0::DOUBLE AS rank
FROM (SELECT round(l_extendedprice, 2) AS price, count(*) AS n FROM lineitem GROUP BY 1)""",
    "R1_median_by": _sql(f"SELECT reduction_method, cluster_method, {_each('median')} FROM scores GROUP BY 1, 2"),
    "R2_mean_by": _sql(f"SELECT reduction_method, cluster_method, {_each('avg')} FROM scores GROUP BY 1, 2"),
    "R3_two_stage_median": _sql(
        f"""SELECT reduction_method, cluster_method, {_each('median')} FROM (
  SELECT embedding_model, reduction_method, cluster_method, {", ".join(f"median({c}) AS {c}" for c in _METRICS)}
  FROM scores GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    ),
    "R4_rank_methods": _sql(
        """, m AS (SELECT reduction_method || ' + ' || cluster_method AS label, """
        + _each("avg", ["ari", "ami", "fm"], 3)
        + """ FROM scores GROUP BY 1)
SELECT label, """
        + ", ".join(
            f"rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS rank_{c}"
            for c in ["ari", "ami", "fm"]
        )
        + " FROM m"
    ).replace(") , m", "), m"),
    "R5_top_k": _sql("""SELECT * FROM scores ORDER BY dendrogram_purity DESC NULLS LAST, embedding_model, reduction_method,
  cluster_method, level LIMIT 8"""),
    "R6_sort_scores": _sql("SELECT * FROM scores ORDER BY ari DESC, ami DESC"),
    "R7_pivot_wide": _sql(
        "SELECT cluster_method, "
        + ", ".join(
            f"round(avg({m}) FILTER (embedding_model = '{v}'), 4) AS \"{v}_{m}\"" for v in "ANR" for m in ("ari", "fm")
        )
        + " FROM scores GROUP BY 1"
    ),
    "R8_mean_pm_std": _sql(
        "SELECT reduction_method, cluster_method, "
        + ", ".join(f"printf('%.4f ± %.4f', avg({m}), stddev_samp({m})) AS {m}" for m in ("ari", "fm"))
        + " FROM scores GROUP BY 1, 2"
    ),
    "R9_side_by_side": _sql(
        """SELECT a.reduction_method, a.cluster_method, round(a.ari, 5) AS ari_a, round(a.fm, 5) AS fm_a,
  round(r.ari, 5) AS ari_r, round(r.fm, 5) AS fm_r FROM
  (SELECT reduction_method, cluster_method, avg(ari) AS ari, avg(fm) AS fm FROM scores WHERE embedding_model = 'A' GROUP BY 1, 2) a
  JOIN (SELECT reduction_method, cluster_method, avg(ari) AS ari, avg(fm) AS fm FROM scores WHERE embedding_model = 'R' GROUP BY 1, 2) r
  USING (reduction_method, cluster_method)"""
    ),
    "R10_summary_two_groups": _sql(
        """SELECT cluster_method, round(a.ari, 5) AS first_ari, round(a.fm, 5) AS first_fm,
  round(b.ari, 5) AS second_ari, round(b.fm, 5) AS second_fm FROM
  (SELECT cluster_method, avg(ari) AS ari, avg(fm) AS fm FROM scores WHERE level <= 1995 GROUP BY 1) a FULL JOIN
  (SELECT cluster_method, avg(ari) AS ari, avg(fm) AS fm FROM scores WHERE level >= 1995 AND cluster_method <> '7' GROUP BY 1) b
  USING (cluster_method)"""
    ),
    "R11_placeholder_to_null": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events",
    "R12_config_label": """SELECT p_partkey,
  (CASE WHEN p_size % 2 = 0 THEN 'Energy_Ecosystems_and_Humans' ELSE 'Offshore_energy_impacts_on_fisheries' END)
  || '_hierarchy_t1.0_' || (CASE WHEN p_partkey % 2 = 0 THEN 'maxsub3_depth5' ELSE 'maxsub5_depth3' END) || '_synonyms0_'
  || (CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'noise0.25_' ELSE 'noise0.5_' END) || 'random' AS name,
  (CASE WHEN p_size % 2 = 0 THEN 'EEH_' ELSE 'OEF_' END) || (CASE WHEN p_partkey % 2 = 0 THEN '3s_d5' ELSE '5s_d3' END)
  || (CASE p_partkey % 3 WHEN 0 THEN '_clean' WHEN 1 THEN '_n25' ELSE '_n50' END) AS label FROM part""",
    "R13_filter_methods": _sql("SELECT * FROM scores WHERE cluster_method IN ('1', '3', '5') AND level = 1996"),
    "R14_stack_results": _sql(
        """SELECT reduction_method, cluster_method, level, ari, ami, fm,
  CASE WHEN embedding_model = 'N' THEN NULL ELSE dendrogram_purity END AS dendrogram_purity, embedding_model AS dataset
FROM scores WHERE embedding_model IN ('A', 'N', 'R')"""
    ),
    "R15_compare_pipelines": _sql(
        f"SELECT {_each('avg')}, reduction_method AS family FROM scores WHERE reduction_method IN ('F', 'O') GROUP BY reduction_method"
    ),
    "R16_mean_by_one_factor": _sql(
        " UNION ALL ".join(
            f"SELECT '{f}' AS factor, {f} AS value, {_each('avg')} FROM scores GROUP BY {f}"
            for f in ("cluster_method", "embedding_model", "reduction_method")
        )
    ),
}
