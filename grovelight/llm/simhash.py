"""SimHash near-duplicates: exact pairs of fingerprints through vantage-point trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from .common import scratch
from .lookup import lookup

SEED = 42
SLICE = 1 << 15  # shingles counted at a time
CELLS = 1 << 22  # distances held at a time
LEAF = 64
MOST_SHARDS = 1 << 14


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """A bit is 1 where more than half of the shingles' hashes have it. No words: 0."""
    words = (text or b"").lower().split()  # both are ASCII only on bytes
    n = max(len(words) - size + 1, 1) if words else 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        stop = min(at + SLICE, n)
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(at, stop)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text, as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


@dataclass
class Node:
    """A ball around ``point``: what lies within ``radius`` is inside. A leaf has ``rows`` instead."""

    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: "Node | None" = None
    outside: "Node | None" = None
    rows: np.ndarray | None = None
    number: int = -1


def grow(prints: np.ndarray, leaf: int, rows: np.ndarray | None = None) -> Node:
    """A vantage-point tree over distinct fingerprints, its leaves numbered from left to right.

    Of eight fingerprints, the one whose distances to the others vary most becomes the vantage point; its ball ends
    where the halves are most even. Rows that no vantage point can part, which distinct fingerprints never are, stay one leaf.
    """
    root = Node()
    work = [(root, np.arange(len(prints)) if rows is None else rows)]
    order = 0
    while work:
        node, part = work.pop()
        if len(part) > leaf:
            tries = part[np.linspace(0, len(part) - 1, 8).astype(int)]
            probe = prints[part[:: max(1, len(part) // 256)]]
            spread = [distance(probe, prints[t]).astype(float).var() for t in tries]
            node.point = prints[tries[int(np.argmax(spread))]]
            far = distance(prints[part], node.point)
            within = np.cumsum(np.bincount(far, minlength=65))
            usable = np.where((within > 0) & (within < len(part)), np.abs(2 * within - len(part)), 1 << 62)
            node.radius = int(usable.argmin())
            if usable.min() < 1 << 62:
                node.inside, node.outside = Node(), Node()
                work += [(node.outside, part[far > node.radius]), (node.inside, part[far <= node.radius])]
                continue
        node.rows, node.number = part, order
        order += 1
    return root


def leaves(root: Node) -> list[Node]:
    out, work = [], [root]
    while work:
        node = work.pop()
        if node.inside is None:
            out.append(node)
        else:
            work += [node.outside, node.inside]
    return out


def reach(root: Node, prints: np.ndarray, radius: int):
    """Pairs (leaf, positions in ``prints`` whose ball of ``radius`` meets the leaf's region), from left to right.

    By the triangle inequality a ball lies wholly outside another if the distance of the centres exceeds the sum of the radii.
    """
    work = [(root, np.arange(len(prints)))]
    while work:
        node, asked = work.pop()
        if not len(asked):
            continue
        if node.inside is None:
            yield node, asked
            continue
        far = distance(prints[asked], node.point)
        work += [(node.outside, asked[far + radius > node.radius]), (node.inside, asked[far - radius <= node.radius])]


class Sets:
    """Disjoint sets of positions; a set is named after its smallest one."""

    def __init__(self, n: int):
        self.name = np.arange(n)

    def of(self, at: np.ndarray) -> np.ndarray:
        out = self.name[at]
        while True:
            up = self.name[out]
            if (up == out).all():
                self.name[at] = out
                return out
            out = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the sets of matching positions; each round hangs the larger names below the smaller ones."""
        while len(a):
            a, b = self.of(a), self.of(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.name, np.maximum(a, b), np.minimum(a, b))


def linked(prints: np.ndarray, members: int, radius: int) -> np.ndarray:
    """For every position the smallest one of its set, where positions below ``members`` are searched by all.

    Positions of a leaf's own set are not compared with it again, so a crowd of near copies costs little more than its links.
    """
    sets = Sets(len(prints))
    for leaf, asked in reach(grow(prints[:members], LEAF), prints, radius):
        rows = leaf.rows
        step = max(1, CELLS // max(len(rows), 1))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            own = sets.of(rows)
            if (own == own[0]).all():
                some = some[sets.of(some) != own[0]]
            a, b = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[rows][None, :]) <= radius)
            sets.join(some[a], rows[b])
    return sets.of(np.arange(len(prints)))


def near_links(distinct: DataFrame, radius: int, shard_rows: int, sample: int) -> DataFrame:
    """(i, j): links that connect the same fingerprints as all pairs within ``radius`` bits do, at most one less than there are rows in each shard.

    ``distinct`` has one row per ``fp``. A tree over at most ``sample`` of them, chosen by hash, cuts the space into shards. A fingerprint is a
    member of the shard it lies in, and it visits each later shard that its ball reaches over the boundary. Shards search their members by
    a tree of their own; many visitors are dealt to several tasks, each with all members.
    """
    place = scratch(distinct.sparkSession)
    n = distinct.count()
    shards = min(MOST_SHARDS, -(-n // shard_rows))
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30))
    drawn = distinct.where(share < int(min(1.0, 1.2 * sample / max(n, 1)) * (1 << 30))).orderBy(share, "fp").limit(sample)
    known = np.array([r["fp"] for r in drawn.collect()], np.int64).view(np.uint64)
    tree = grow(known, -(-len(known) // max(shards, 1)) if len(known) else 1)
    for leaf in leaves(tree):
        leaf.rows = leaf.rows[:0]  # tasks need the balls only

    def route(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            home = np.full(len(prints), -1, np.int32)
            for leaf, asked in reach(tree, prints.view(np.uint64), 0):  # radius 0 leads to one leaf
                home[asked] = leaf.number
            out = []
            for leaf, asked in reach(tree, prints.view(np.uint64), radius):
                asked = asked[home[asked] <= leaf.number]
                out.append((np.full(len(asked), leaf.number, np.int32), prints[asked], home[asked] == leaf.number))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int32), prints[:0], np.empty(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "fp", "member"])

    routed = place.cut(distinct.select("fp").mapInArrow(route, "shard int, fp long, member boolean"), "routed")
    most = 16 * shard_rows
    crowds = routed.groupBy("shard").agg(F.ceil(F.count_if(~F.col("member")) / most).cast("int").alias("blocks")).where("blocks > 1").collect()
    blocks = F.lit(1)
    if crowds:  # one row a shard at most
        sizes = F.create_map(*[F.lit(v) for r in crowds for v in (r["shard"], r["blocks"])])
        blocks = F.coalesce(F.try_element_at(sizes, F.col("shard")), F.lit(1))
    dealt = routed.withColumn("block", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), blocks).cast("int")))))

    def search(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy()
        prints = table.column("fp").to_numpy()
        prints = np.concatenate([np.sort(prints[member]), np.sort(prints[~member])])
        first = linked(prints.view(np.uint64), int(member.sum()), radius)
        tied = np.flatnonzero(first != np.arange(len(prints)))
        return pa.table({"i": prints[first[tied]], "j": prints[tied]})

    return dealt.groupBy("shard", "block").applyInArrow(search, "i long, j long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, shard_rows: int = 1 << 14, sample: int = 1 << 17) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Whole texts are lower-cased (A-Z) and cut into words at ASCII white space; the hashes of all ``size``-word shingles, repeats included,
    vote on 64 bits. Fingerprints that differ in at most ``radius`` bits are linked, exactly (see ``near_links``), and ``component_id`` is the smallest
    doc_id that links lead to. Copies share a fingerprint and are compared as one.

    A text of fewer words is one shingle; null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows and
    ids are returned as they come. Rows without an id take part in links but name no component: alone with their like, they have a
    null one. Empty tables give no rows. Further columns are ignored.
    """
    place = scratch(docs.sparkSession)
    marked = place.cut(fingerprints(docs, size), "fingerprints")
    groups = place.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
    links = place.cut(near_links(groups, radius, shard_rows, sample).distinct(), "links")
    tied = links.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    parts = place.cut(connected_components(tied, links), "components")
    named = parts.join(groups.select(F.col("fp").alias("node"), "least"), "node")
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_tied = parts.join(smallest, "comp").select(F.col("node").alias("fp"), F.col("component_id").alias("joined"), F.lit(True).alias("tied"))
    table = groups.join(of_tied, "fp", "left").select("fp", "n", F.when(F.col("tied"), F.col("joined")).otherwise(F.col("least")).alias("component_id"))
    found = lookup(marked, "fp", place.cut(table, "classes"), "n", "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
