"""The whole evaluation: reductions, clusterers on each, scores of each tree, resumable after a crash."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ..operators import clustering as c, reductions as rd, trees as tr
from ..session import ship_package
from ..sources.runs import Ledger
from ..sources.scratch import Scratch
from .benchmark import score_levels, score_tree

Step = Callable[[DataFrame], DataFrame]
ABREAST = 4  # methods whose jobs run side by side: most jobs of a tree are too small to keep all cores busy


def kmeans_tree(points: DataFrame, counts: tuple[int, ...] = (32, 8)) -> DataFrame:
    """Hierarchical k-means as a tree whose nodes have any number of children."""
    members = c.hierarchical_kmeans(points, counts)
    return tr.membership_to_tree(members, [col for col in members.columns if col != "id"])


REDUCTIONS: dict[str, Step] = {"Raw": lambda points: points, "PCA": lambda points: rd.pca(points, 8)}
CLUSTERERS: dict[str, Step] = {
    "Agglomerative": c.ward_tree,
    "HDBSCAN": c.single_linkage_tree,
    "DiffusionCondensation": c.diffusion_condensation,
    "KMeansTree": kmeans_tree,
}


def evaluate(
    points: DataFrame, labels: DataFrame, depth: int, folder: str, model: str,
    reductions: Mapping[str, Step] = REDUCTIONS, clusterers: Mapping[str, Step] = CLUSTERERS,
) -> DataFrame | None:
    """Score rows of every clusterer on every reduction, kept in ``folder``: ``None`` for an empty plan.

    A clusterer returns a merge table or a tree. Each (model, reduction, clusterer) is committed as soon as it is scored, so a run that is
    started again skips what is there, does the rest, and no method is there twice. A reduction is made only if a method
    on it is missing. Methods run side by side; one that fails does not keep the others from being committed.
    """
    spark = points.sparkSession
    ledger = Ledger(spark, folder)
    done = ledger.parts()
    ship_package(spark)  # once, before the methods use it side by side

    def run(reduced: DataFrame, reduction: str, name: str, key: str) -> None:
        found = clusterers[name](reduced)
        score = score_levels if "height" in found.columns else score_tree
        ledger.commit(key, score(found, labels, depth, model, reduction, name))

    with ThreadPoolExecutor(ABREAST) as pool:
        runs = []
        for reduction, reduce in reductions.items():
            missing = {name: f"{model}\t{reduction}\t{name}" for name in clusterers}
            missing = {name: key for name, key in missing.items() if key not in done}
            if not missing:
                continue
            reduced = Scratch(spark).cut(reduce(points), "reduced")
            runs += [pool.submit(inheritable_thread_target(spark)(run), reduced, reduction, name, key) for name, key in missing.items()]
    for each in runs:
        each.result()  # raises what a method raised; the others have been committed
    return ledger.results()
