"""Spanning forests and components of graphs given as edge tables.

Each round every component picks its lightest outgoing edge; components that picked each other's
edges hook together and pointers are doubled until every component knows its root. The number of
components at least halves per round.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import Scratch

@dataclass
class Forest:
    """``edges``: chosen edges ``(lo, hi, w, round)``; ``members``: ``(node, comp)`` at the end;
    ``rounds``: ``(round, node, comp, lo, hi, w)``, the component of every node when a round starts
    and the edge that component chose in it."""

    edges: DataFrame
    members: DataFrame
    rounds: DataFrame | None


def roots(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """``(comp, parent)`` with self-loops at roots -> ``(comp, root)`` by pointer doubling."""
    state = scratch.cut(parents.select("comp", F.col("parent").alias("root")), "jump", keep=2)
    while True:
        twice = _jump(state, state)
        four = _jump(twice, twice)
        new = scratch.cut(
            four.join(state.select("comp", F.col("root").alias("was")), "comp").select("comp", "root", (F.col("root") != F.col("was")).alias("moved")),
            "jump", keep=2,
        )
        if new.where("moved").isEmpty():
            return new.select("comp", "root")
        state = new.select("comp", "root")


def _jump(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("comp").alias("root"), F.col("root").alias("next")), "root").select(
        "comp", F.col("next").alias("root")
    )


def forest(
    nodes: DataFrame, lightest: Callable[[DataFrame], DataFrame], scratch: Scratch, keep_rounds: bool = False
) -> Forest:
    """Minimum spanning forest.

    ``lightest(members)`` gets ``(node, comp)`` and returns each component's lightest outgoing edge as
    ``(comp, other, w, lo, hi)`` where ``other`` is the component at the far end.
    """
    members = scratch.cut(nodes.select("node", F.col("node").alias("comp")), "members", keep=2)
    for number in itertools.count():
        chosen = scratch.cut(lightest(members).withColumn("round", F.lit(number)), "chosen")
        if chosen.isEmpty():
            break
        if keep_rounds:
            scratch.cut(members.join(chosen.select("comp", "lo", "hi", "w"), "comp", "left").withColumn("round", F.lit(number)), "rounds")
        back = chosen.select(F.col("comp").alias("other"), F.col("other").alias("comp_back"))
        hooked = chosen.join(back, "other").select(
            "comp",
            F.when((F.col("comp_back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp"))
            .otherwise(F.col("other"))
            .alias("parent"),
        )
        root = roots(scratch, hooked)
        members = scratch.cut(
            members.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")),
            "members", keep=2,
        )
    if keep_rounds:
        scratch.cut(
            members.select("comp", "node", F.lit(None).cast(nodes.schema["node"].dataType).alias("lo"),
                           F.lit(None).cast(nodes.schema["node"].dataType).alias("hi"),
                           F.lit(None).cast("double").alias("w"), F.lit(number).alias("round")),
            "rounds",
        )
    edges = scratch.all_of("chosen").groupBy("lo", "hi").agg(F.min("w").alias("w"), F.min("round").alias("round"))
    return Forest(edges, members, scratch.all_of("rounds") if keep_rounds else None)


def lightest_of(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The ``lightest`` of an explicit undirected edge table ``(i, j, w)``."""
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "w").unionByName(
        edges.select(F.col("j").alias("a"), F.col("i").alias("b"), "w")
    )

    def pick(members: DataFrame) -> DataFrame:
        here = members.select(F.col("node").alias("a"), "comp")
        there = members.select(F.col("node").alias("b"), F.col("comp").alias("other"))
        crossing = both.join(here, "a").join(there, "b").where("comp <> other")
        best = F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "other")).alias("e")
        return crossing.groupBy("comp").agg(best).select("comp", "e.other", "e.w", "e.lo", "e.hi")

    return pick


def spanning_forest(nodes: DataFrame, edges: DataFrame, keep_rounds: bool = False) -> Forest:
    scratch = Scratch(nodes.sparkSession)
    return forest(nodes, lightest_of(scratch.cut(edges.select("i", "j", F.col("w").cast("double").alias("w")), "edges")), scratch, keep_rounds)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, comp)`` where ``comp`` is the smallest node of the component."""
    found = spanning_forest(nodes, edges.select("i", "j", F.lit(1.0).alias("w"))).members
    label = found.groupBy("comp").agg(F.min("node").alias("label"))
    return found.join(label, "comp").select("node", F.col("label").alias("comp"))
