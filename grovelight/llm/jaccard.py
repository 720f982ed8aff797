"""N-gram Jaccard join: exact links between similar documents by way of a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.graph import connected_components
from ..sources.scratch import Scratch
from .common import apart, part_count, scratch
from .grams import bucket_runs, chunks, in_bytes, mixed, pack, set_digest, shingle_set, spread, squeezed, unpack, words_in

BUCKET_BYTES = 8 << 20
FLUSH_TOKENS = 1 << 20
TURNS = 8
PART_BYTES = 8 << 20
BLOCK = 256
PAIRS_AT_ONCE = 1 << 22
BROADCAST_ROWS = 200_000
SETS = "node long, n int, prefix int, tokens binary"
_LOW48 = np.uint64(2**48 - 1)


def _document_sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text of a batch."""
    for at, data, offsets in chunks(batch.column(column)):
        words, _, _, firsts = words_in(data, offsets, lower=True)
        for i in range(len(offsets) - 1):
            yield at + i, shingle_set(words[firsts[i] : firsts[i + 1]], k)


def shingle_nodes(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n, node): size and digest of each document's shingle set; documents with equal sets share a node."""

    def run(batches):
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, tokens in _document_sets(batch, "text", k):
                n[row], node[row] = len(tokens), set_digest(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(node)], ["doc_id", "n", "node"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n long, node long")


def _spread_tokens(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """(bucket, data): the shingles of all sets, dealt by their leading bits and packed by batch; equal sets of a batch once."""

    def flushed(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int32)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, tokens, owner = bucket[order], tokens[order] & _LOW48, owner[order]
        node_ids = np.array(nodes, np.int64)
        keys, data = [], []
        for b, lo, hi in bucket_runs(bucket):
            who, counts = in_bytes(owner[lo:hi])
            here = tokens[lo:hi]
            keys.append(b)
            data.append(pack(node_ids[who], sizes[who], counts, here.astype(np.uint32), (here >> np.uint64(32)).astype(np.uint16)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    def run(batches):
        for batch in batches:
            seen, nodes, sets, held = set(), [], [], 0
            for _, tokens in _document_sets(batch, "text", k):
                node = set_digest(tokens) if len(tokens) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(tokens)
                    held += len(tokens)
                if held >= FLUSH_TOKENS:
                    yield flushed(nodes, sets)
                    nodes, sets, held = [], [], 0
            if sets:
                yield flushed(nodes, sets)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, data binary")


def _shared_tokens(bits: int, parts: int):
    """From a bucket's shingles, those of at least two sets, with their frequencies, dealt by set."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        got = [unpack(x.as_py(), np.int64, np.int32, np.uint8, np.uint32, np.uint16) for x in table.column("data")]
        came = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        nodes, sizes, counts, low, high = (np.concatenate(x) for x in zip(*got))
        del got
        tokens = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        # an equal set that came in another row has the same shingles; a set's parts come in one row
        order = np.lexsort((came, nodes))
        begins = np.flatnonzero(np.concatenate(([True], nodes[order][1:] != nodes[order][:-1])))
        keep = np.zeros(len(nodes), bool)
        keep[order] = came[order] == np.repeat(came[order][begins], np.diff(np.append(begins, len(nodes))))
        tokens = tokens[np.repeat(keep, counts)]
        nodes, sizes, counts = nodes[keep], sizes[keep], counts[keep]
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        some, named = [], 0
        for turn in range(TURNS):  # shingles in turns, so that little of the bucket is sorted at a time
            chosen = np.flatnonzero(tokens % np.uint64(TURNS) == turn)
            chosen = chosen[np.argsort(tokens[chosen], kind="stable")]
            t = tokens[chosen]
            starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
            df = np.diff(np.append(starts, len(t)))
            number = np.repeat(named + np.cumsum(df > 1) - 1, df)  # shared shingles are numbered from here on
            named += int((df > 1).sum())
            df = np.repeat(df, df)
            some.append((number[df > 1].astype(np.uint32), owner[chosen[df > 1]], df[df > 1].astype(np.int32)))
        tokens, owner, df = (np.concatenate(x) for x in zip(*some))
        part = ((nodes.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)[owner]
        order = np.lexsort((owner, part))
        tokens, owner, df, part = tokens[order], owner[order], df[order], part[order]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        to = np.append(at[1:], len(part))
        data = []
        for lo, hi in zip(at, to):
            who, n = in_bytes(owner[lo:hi])
            data.append([squeezed(c) for c in (nodes[who], sizes[who], n, tokens[lo:hi], df[lo:hi])])
        return pa.table({"part": pa.array(part[at], pa.int32()), "bucket": pa.array([bucket] * len(at), pa.int32()), "data": pa.array(data, pa.list_(pa.binary()))})

    return run


def _ordered_sets(percent: int):
    """Sets that can have a partner: their shared shingles from rare to frequent, and how many of them the prefix holds."""

    def run(table: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int32, np.uint8, np.uint32, np.int32)
        got = [[spread(c, kind) for c, kind in zip(x.as_py(), kinds)] for x in table.column("data")]
        held = [len(g[3]) for g in got]
        nodes, sizes, counts, tokens, df = (np.concatenate(x) for x in zip(*got))
        del got
        tokens = tokens.astype(np.uint64) | (np.repeat(table.column("bucket").to_numpy().astype(np.uint64), held) << np.uint64(32))
        node, n = np.repeat(nodes, counts), np.repeat(sizes, counts)
        order = np.lexsort((tokens, df, node))
        node, n, tokens = node[order], n[order], tokens[order]
        at = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
        to = np.append(at[1:], len(node))
        size = n[at].astype(np.int64)
        alone = size - (to - at)  # shingles of no other set come first in the order
        prefix = size - -(-percent * size // 100) + 1 - alone
        rows = np.flatnonzero(prefix > 0)
        return pa.table(
            {
                "node": pa.array(node[at][rows], pa.int64()),
                "n": pa.array(size[rows], pa.int32()),
                "prefix": pa.array(prefix[rows], pa.int32()),
                "tokens": pa.array([squeezed(tokens[at[r] : to[r]]) for r in rows], pa.binary()),
            }
        )

    return run


def _open_groups(percent: int):
    """Links between the queries and the members of one block of a group.

    The row of the matrix for this block is the union of its members' shingles. A query is bounded by its overlap with the
    union; only if that reaches ``percent`` of its size is it compared with each member, shingle by shingle.
    """

    def run(table: pa.Table) -> pa.Table:
        role = table.column("query").to_numpy()
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        sets = table.column("tokens")
        members, queries = np.flatnonzero(~role), np.flatnonzero(role)
        out: list[tuple[int, int]] = []
        if len(members) and len(queries):
            held = [spread(sets[int(m)].as_py()) for m in members]
            tokens, owner = np.concatenate(held), np.repeat(np.arange(len(members)), [len(h) for h in held])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            union = tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))]
            for q in queries:
                asked = spread(sets[int(q)].as_py())
                at = np.minimum(np.searchsorted(union, asked), len(union) - 1)
                inside = asked[union[at] == asked]
                if 100 * len(inside) < percent * n[q]:
                    continue
                lo, hi = np.searchsorted(tokens, inside, "left"), np.searchsorted(tokens, inside, "right")
                width = hi - lo
                spots = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
                both = np.bincount(owner[spots], minlength=len(members))
                linked = np.flatnonzero((100 * both >= percent * (n[q] + n[members] - both)) & (node[members] != node[q]))
                out += [(int(node[q]), int(node[members[j]])) for j in linked[:1]]
        return pa.table({"i": pa.array([x[0] for x in out], pa.int64()), "j": pa.array([x[1] for x in out], pa.int64())})

    return run


def _links(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int, place: Scratch) -> DataFrame:
    """(i, j): for each query and block of a group that it asks for, a member it is linked with, if there is one.

    ``members`` is (grp, node), ``queries`` is (grp, node). Large groups are opened in blocks of members and of queries.
    """
    asked = queries.groupBy("grp").agg(F.count("*").alias("n_queries"))
    shape = (
        members.join(asked, "grp")
        .groupBy("grp")
        .agg(F.count("*").alias("n_members"), F.max("n_queries").alias("n_queries"))
        .select("grp", F.ceil(F.col("n_members") / BLOCK).alias("blocks"), F.ceil(F.col("n_queries") / BLOCK).alias("runs"))
    )
    of = lambda col: F.pmod(F.xxhash64("node"), F.col(col))
    to = lambda col: F.explode(F.sequence(F.lit(0).cast("long"), F.col(col) - 1))
    m = members.join(shape, "grp").select("grp", "node", of("blocks").alias("block"), to("runs").alias("run")).withColumn("query", F.lit(False))
    q = queries.join(shape, "grp").select("grp", "node", of("runs").alias("run"), to("blocks").alias("block")).withColumn("query", F.lit(True))
    placed = place.cut(m.unionByName(q), "placed")
    # few places are sent to the sets (under 10 MB); with more, both sides are shuffled
    few = placed.count() <= BROADCAST_ROWS
    held = (F.broadcast(placed) if few else placed).join(sets.select("node", "n", "tokens"), "node")
    return held.select("grp", "block", "run", "query", "node", "n", "tokens").groupBy("grp", "block", "run").applyInArrow(
        _open_groups(percent), "i long, j long"
    )


def _dealt_prefixes(sets: DataFrame, parts: int) -> DataFrame:
    """(part, data): the prefixes, dealt by shingle. A prefix shingle goes with how many shared shingles stand from it on."""

    def run(batches):
        for batch in batches:
            prefix = batch.column("prefix").to_numpy()
            if not len(prefix):
                continue
            whole = [spread(t.as_py()) for t in batch.column("tokens")]
            tokens = np.concatenate([t[:p] for t, p in zip(whole, prefix)])
            rest = np.concatenate([len(t) - np.arange(p) for t, p in zip(whole, prefix)]).astype(np.int32)
            owner = np.repeat(np.arange(len(prefix)), prefix)
            part = (mixed(tokens) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            tokens, rest, owner, part = tokens[order], rest[order], owner[order], part[order]
            fields = [batch.column(c).to_numpy() for c in ("node", "comp", "weight", "n")]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            data = []
            for lo, hi in zip(at, np.append(at[1:], len(part))):
                who, counts = np.unique(owner[lo:hi], return_counts=True)
                data.append(pack(*[f[who] for f in fields], counts.astype(np.int32), tokens[lo:hi], rest[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    return sets.mapInArrow(run, "part int, data binary")


def _asked_groups(percent: int):
    """The token-group matrix of one part of the shingles, and which nodes ask for which larger groups by it.

    A cell holds, over the group's members with this shingle in their prefix, the smallest size and the most shared
    shingles from there on. With r the lesser of that and the node's own, no member reached first by this shingle shares more
    than r with the node, so a cell counts only if 100 * r >= ``percent`` * (both sizes - r). A linked pair passes
    at its first common shingle.
    """

    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), np.int64, np.int64, np.int64, np.int32, np.int32, np.uint64, np.int32) for x in table.column("data")]
        node, comp, weight, size, counts, token, rest = (np.concatenate(x) for x in zip(*got))
        del got
        row = np.repeat(np.arange(len(node)), counts)
        order = np.lexsort((comp[row], weight[row], token))  # within a shingle from small groups to large ones
        token, row, rest = token[order], row[order], rest[order].astype(np.int64)
        c, n = comp[row], size[row].astype(np.int64)
        cell = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (c[1:] != c[:-1])))) if len(token) else np.zeros(0, np.int64)
        most, least = (np.maximum.reduceat(rest, cell), np.minimum.reduceat(n, cell)) if len(cell) else (rest, n)
        of_row = np.repeat(np.arange(len(cell)), np.diff(np.append(cell, len(token))))
        last = np.searchsorted(token[cell], token, "right")  # past the last cell of the row's shingle
        later = last - of_row - 1
        found = np.zeros((0, 2), np.int64)
        bounds = np.concatenate(([0], np.cumsum(later)))
        at = 0
        while at < len(token):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS_AT_ONCE, "right")) - 1)
            width = later[at:to]
            q = np.repeat(np.arange(at, to), width)
            g = np.repeat(of_row[at:to] + 1 - (bounds[at:to] - bounds[at]), width) + np.arange(int(width.sum()))
            r = np.minimum(rest[q], most[g])
            good = 100 * r >= percent * (n[q] + least[g] - r)
            pairs = np.stack((c[cell[g[good]]], node[row[q[good]]]), 1)
            found = np.unique(np.concatenate((found, pairs)), axis=0)
            at = to
        return pa.table({"grp": pa.array(found[:, 0], pa.int64()), "node": pa.array(found[:, 1], pa.int64())})

    return run


def _smallest_hash(sets: DataFrame, seed: int) -> DataFrame:
    """(node, key, own): the smallest digest, under one of several orders, of each set's shared shingles, and its share of others."""

    def run(batches):
        salt = np.uint64((seed * 0x2545F4914F6CDD1D + 1) & (2**64 - 1))
        for batch in batches:
            held = [spread(t.as_py()) for t in batch.column("tokens")]
            keys = [int(mixed(t ^ salt).min().view(np.int64)) for t in held]
            own = [1.0 - len(t) / n.as_py() for t, n in zip(held, batch.column("n"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.int64()), pa.array(own, pa.float64())], ["node", "key", "own"])

    return sets.select("node", "n", "tokens").mapInArrow(run, "node long, key long, own double")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) for nodes with links; others are their own component and are left out."""
    ends = links.select(F.col("i").alias("node")).union(links.select("j")).distinct()
    return connected_components(ends, links)


def similar_components(docs: DataFrame, k: int = 5, percent: int = 75, orders: int = 1) -> DataFrame:
    """Per document: doc_id, n (distinct k-word shingles), component_id.

    Documents link when 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id reachable by links.

    1. Documents with equal sets share a node. 2. Shingles are counted over all nodes; those of one node only can't match,
    and with the rest in order of frequency every linked pair shares a shingle of both prefixes. Nodes whose prefix holds
    no shared shingle are done. 3. Groups: under ``orders`` hash orders, nodes with the same smallest shingle are compared
    with the one that has the least shingles of its own, and linked nodes form a group, so every group is connected. 4. In the matrix
    (prefix shingle, group) each node asks for every larger group that it meets there and that could hold a partner. 5. Asked groups are
    opened in blocks: the union of a block's shingles bounds the overlap, and qualifying members are compared exactly.

    Step 3 only saves work: a pair of nodes in different groups meets in step 4 whenever it can link, so no link between
    components is lost, while pairs within a group need no look. Sets are told apart by 64-bit digests.

    Null or empty texts have no shingles and link with nothing; fewer than k words are one shingle. A null doc_id is no name:
    such rows join components but name none (null if nobody else does). Repeated ids and rows are fine, as are empty tables
    and further columns. Very frequent shingles stand last in the order and hardly ever are in a prefix.
    """
    spark = docs.sparkSession
    place = scratch(spark)
    parts = part_count(docs, PART_BYTES)
    bits = int(part_count(docs, BUCKET_BYTES) - 1).bit_length()
    rows = place.cut(shingle_nodes(docs, k), "nodes")
    buckets = _spread_tokens(docs, k, bits).groupBy("bucket").applyInArrow(_shared_tokens(bits, parts), "part int, bucket int, data array<binary>")
    sets = place.cut(buckets.groupBy("part").applyInArrow(_ordered_sets(percent), SETS), "sets")

    links = None
    own = sets.select("node", F.col("node").alias("comp"))
    for order in range(orders):
        keyed = _smallest_hash(sets, order).join(own, "node")
        leaders = keyed.groupBy("key").agg(F.min(F.struct("own", "node", "comp")).alias("leader"), F.count("*").alias("held")).where("held > 1")
        asks = keyed.join(leaders.select("key", "leader"), "key").where("node <> leader.node and comp <> leader.comp")
        asks = place.cut(asks.select(F.col("leader.node").alias("grp"), "node"), "asks")
        heads = asks.select("grp").distinct().select("grp", F.col("grp").alias("node"))
        place.cut(_links(heads, asks, sets, percent, place), "links")
        links = place.all_of("links")
        own = place.cut(_own(sets, _components(sets, links)), "own")

    sizes = own.groupBy("comp").agg(F.count("*").alias("weight"))
    owned = own.join(sizes, "comp")
    dealt = _dealt_prefixes(sets.join(owned, "node").select("node", "comp", "weight", "n", "prefix", "tokens"), parts)
    asks = dealt.groupBy("part").applyInArrow(_asked_groups(percent), "grp long, node long").distinct()
    asks = place.cut(asks, "asks")
    members = own.select(F.col("comp").alias("grp"), "node").join(asks.select("grp").distinct(), "grp")
    place.cut(_links(members, asks, sets, percent, place), "links")
    found = place.cut(_components(sets, place.all_of("links")), "components")

    named = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = place.cut(named.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "least"), "named")
    label = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = named.join(label, "comp").select(F.col("node").alias("c_node"), "component_id")
    return rows.join(classes, (F.col("n") > 0) & (F.col("node") == F.col("c_node")), "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _own(sets: DataFrame, components: DataFrame) -> DataFrame:
    return sets.select("node").join(components, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that remain when one document of each component stays: the one that names it.

    Rows without an id can't be told apart by name and all stay. Of rows that repeat an id and a text, one stays. Null and empty texts are
    linked with nothing and stay; other columns are kept, whatever they are called; an empty table stays empty.
    """
    return apart(docs, ["doc_id", "text"], lambda d: _heads(d, k, percent))


def _heads(docs: DataFrame, k: int, percent: int) -> DataFrame:
    found = similar_components(docs, k, percent)
    heads = found.where(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_h_id"))
    named = docs.join(heads.distinct(), F.col("doc_id") == F.col("_h_id"), "left_semi")
    # the join has brought the rows of an id together
    once = named.withColumn("_turn", F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))))
    return once.where("_turn = 1").drop("_turn").unionByName(docs.where("doc_id is null"))
