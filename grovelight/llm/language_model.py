"""LM scoring: smoothed n-grams as a weighted backoff automaton, walked once over each text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import part_count, scratch
from .grams import bucket_runs, chunks, ngrams, pack, slices, unpack, words_in

GROUP_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
_LOW48 = np.uint64(2**48 - 1)
# Digests that stand for the start and the end of a text.
START, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): of each text START, its words and END; text i is tokens[bounds[i]:bounds[i+1]]."""
    words, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, data, offsets in chunks(texts):
        digests, _, _, firsts = words_in(data, offsets, lower=True)
        words.append(digests)
        sizes.append(np.diff(firsts))
    words, sizes = np.concatenate(words), np.concatenate(sizes)
    bounds = slices(sizes + 2)
    tokens = np.empty(bounds[-1], np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[bounds[:-1]] = False
    inner[bounds[1:] - 1] = False
    tokens[bounds[:-1]] = START
    tokens[bounds[1:] - 1] = END
    tokens[inner] = words
    return tokens, bounds


def _grams(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For each size up to ``order`` the digest of the gram that ends at each token but START; 0 where it would cross a text."""
    predicted = np.ones(len(tokens), bool)
    predicted[bounds[:-1]] = False
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = []
    for k in range(1, order + 1):
        digests = np.zeros(len(tokens), np.uint64)
        digests[k - 1 :] = ngrams(tokens, k, seed=7)
        digests[place < k - 1] = 0
        out.append(digests[predicted])
    return out


def _asked(tokens: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(distinct digests, for each size the index of each token's gram among them, index of START as a gram)."""
    start = ngrams(np.array([START], np.uint64), 1, seed=7)
    levels = _grams(tokens, bounds, order)
    distinct, index = np.unique(np.concatenate([start, *levels]), return_inverse=True)
    cut = np.split(index[1:], order)
    return distinct, cut, index[0]


def _requests(order: int, bits: int):
    """A group's distinct grams with their counts in its training texts, dealt by their leading bits."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = table.column("grp")[0].as_py()
        tokens, bounds = _tokens(table.column("text").chunk(0))
        train = ~table.column("held_out").to_numpy()
        distinct, levels, start = _asked(tokens, bounds, order)
        of_train = np.repeat(train, np.diff(bounds) - 1)
        counts = np.zeros(len(distinct), np.int64)
        for index in levels:
            counts += np.bincount(index[of_train], minlength=len(distinct))
        counts[start] = int(train.sum())
        counts[distinct == 0] = 0
        known = np.zeros(len(distinct), np.uint8)  # which grams are single tokens
        known[levels[0]] = 1
        keys, data = [], []
        for b, lo, hi in bucket_runs(distinct >> np.uint64(64 - bits)):
            low = distinct[lo:hi] & _LOW48
            c = counts[lo:hi]
            keys.append(b)
            data.append(
                pack(low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16), np.minimum(c, 255).astype(np.uint8), c[c >= 255], np.packbits(known[lo:hi]))
            )
        return pa.table({"bucket": pa.array(keys, pa.int32()), "grp": pa.array([group] * len(keys), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def _wide(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    counts = small.astype(np.int64)
    counts[small == 255] = large
    return counts


def _answers(table: pa.Table) -> pa.Table:
    """Adds up a bucket's counts over all groups and answers each group in the order of its request."""
    bucket = table.column("bucket")[0].as_py()
    groups = table.column("grp").to_numpy()
    got = [unpack(x.as_py(), np.uint32, np.uint16, np.uint8, np.int64, np.uint8) for x in table.column("data")]
    sizes = np.array([len(g[0]) for g in got])
    low, high = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    counts = np.concatenate([_wide(g[2], g[3]) for g in got])
    single = np.concatenate([np.unpackbits(g[4], count=len(g[0])) for g in got]).astype(bool)
    del got
    keys = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    length = np.diff(np.append(first, len(keys)))
    sums = np.add.reduceat(counts[order], first)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(sums, length)
    word = np.logical_or.reduceat(single[order], first)
    data = [pack(*_narrow(c)) for c in np.split(total, np.cumsum(sizes)[:-1])]
    rows = len(groups)
    distinct, mass = int(((sums > 0) & word).sum()), int(sums[word].sum())
    return pa.table(
        {
            "bucket": pa.array([bucket] * rows, pa.int32()),
            "grp": pa.array(groups, pa.int32()),
            "data": pa.array(data, pa.binary()),
            "distinct": pa.array([distinct] + [0] * (rows - 1), pa.int64()),
            "mass": pa.array([mass] + [0] * (rows - 1), pa.int64()),
        }
    )


@dataclass(frozen=True)
class Automaton:
    """States are seen histories of up to ``order - 1`` words, numbered like their grams; ``root`` is the empty one.

    A seen gram is an arc from its history's state, found by (state, word). The root has an arc for every word, of the word's number.
    Each state but the root has a failure arc to the state of the history without its first word.
    """

    arcs: dict[int, int]  # state * (root + 1) + word -> arc, for all states but the root
    weight: list[float]  # log10 probability of an arc's last word in its state
    goes: list[int]  # the state after an arc: the longest seen history
    fails: list[int]  # the state behind the failure arc
    falls: list[float]  # weight of the failure arc
    first: int  # the state before a text's first word
    root: int

    def walk(self, words: list[int]) -> float:
        """log10 probability of one text: a single pass from left to right that carries the state."""
        find, width, root = self.arcs.get, self.root + 1, self.root
        weight, goes, fails, falls = self.weight, self.goes, self.fails, self.falls
        total, state = 0.0, self.first
        for word in words:
            arc = word if state == root else find(state * width + word)
            while arc is None:
                total += falls[state]
                state = fails[state]
                arc = word if state == root else find(state * width + word)
            total += weight[arc]
            state = goes[arc]
        return total


def automaton(counts: np.ndarray, levels: list[np.ndarray], start: int, bounds: np.ndarray, total: float, vocabulary: int, strength: float) -> Automaton:
    """The states and arcs that the texts at hand can meet, from the counts of their grams.

    An arc weighs log10((c(gram) + s * p(shorter)) / (c(history) + s)), a failure arc log10(s / (c(history) + s)); the root gives
    (c + 0.5) / (total + 0.5 * (vocabulary + 1)). So all words together have probability 1 in each state.
    """
    order, root = len(levels), len(counts)
    sizes = np.diff(bounds) - 1
    place = np.arange(sizes.sum()) - np.repeat(slices(sizes)[:-1], sizes)
    p = np.zeros(root + 1)
    goes, fails = np.full(root, root), np.full(root, root)
    arcs: dict[int, int] = {}
    for size in range(1, order + 1):
        inside = np.flatnonzero(place >= size - 2)
        grams, at = np.unique(levels[size - 1][inside], return_index=True)
        at = inside[at]
        seen = counts[grams] > 0
        if size == 1:
            p[grams] = (counts[grams] + 0.5) / (total + 0.5 * (vocabulary + 1))
            goes[grams] = np.where(seen & (order > 1), grams, root)
            continue
        shorter = levels[size - 2][at]
        history = np.where((place[at] == 0) & (size == 2), start, levels[size - 2][at - 1])
        p[grams] = (counts[grams] + strength * p[shorter]) / (counts[history] + strength)
        goes[grams] = grams if size < order else shorter
        fails[grams] = shorter
        keys = history[seen] * (root + 1) + levels[0][at[seen]]
        arcs.update(zip(keys.tolist(), grams[seen].tolist()))
    with np.errstate(divide="ignore"):  # START is no arc
        weight = np.log10(p[:root])
    falls = np.log10(strength / (counts + strength))
    first = start if counts[start] > 0 and order > 1 else root
    return Automaton(arcs, weight.tolist(), goes.tolist(), fails.tolist(), falls.tolist(), int(first), root)


def _scores(order: int, strength: float, train_tokens: int, vocabulary: int):
    schema = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        tokens, bounds = _tokens(texts.column("text").chunk(0))
        _, levels, start = _asked(tokens, bounds, order)
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("data")), key=lambda x: x[0])
        counts = np.concatenate([_wide(*unpack(d.as_py(), np.uint8, np.int64)) for _, d in parts])
        c = counts[levels[0]]
        model = automaton(counts, levels, start, bounds, train_tokens, vocabulary, strength)
        spans = slices(np.diff(bounds) - 1)
        base = np.log10((c + 0.5) / (train_tokens + 0.5 * (vocabulary + 1)))
        n = np.diff(spans)
        return pa.table(
            [
                texts.column("doc_id"),
                texts.column("held_out"),
                pa.array(n, pa.int64()),
                pa.array(np.add.reduceat(c > 0, spans[:-1], dtype=np.int64), pa.int64()),
                pa.array([float(base[a:b].sum()) for a, b in zip(spans[:-1], spans[1:])], pa.float64()),
                pa.array([model.walk(levels[0][a:b].tolist()) for a, b in zip(spans[:-1], spans[1:])], pa.float64()),
            ],
            schema,
        )

    return run


def score(docs: DataFrame, order: int = 2, strength: float = 100.0, out: Column | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows outside the held-out fold: grams of up to ``order`` tokens, smoothed by ``strength`` virtual
    tokens of the next shorter history, down to (c + 0.5) / (N + 0.5 * (V + 1)) for single tokens. ``out`` replaces the fold.

    The model is as large as the corpus and is never in one place. Texts are dealt into groups of bounded size; a group
    asks for each of its distinct grams once, buckets of grams add up the counts over all groups and answer in the order asked,
    and each group then holds the states and arcs that its texts can meet, and every text walks them once. A frequent word or pair is
    asked for once per group, however often it occurs. Only buckets that a group has grams for get a row from it, so there are
    never more rows than grams, at any size.

    Null and empty texts are the end token alone. Repeated rows count and are scored each time; with no training row only unknown
    tokens remain; empty tables and further columns are fine.
    """
    place = scratch(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    groups = part_count(docs, GROUP_BYTES, least=8)
    bits = max(3, int(part_count(docs, BUCKET_BYTES, least=8) - 1).bit_length())
    texts = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.coalesce(held_out(F.col("doc_id")) if out is None else out, F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("grp"),
    )
    asked = texts.groupBy("grp").applyInArrow(_requests(order, bits), "bucket int, grp int, data binary")
    answered = asked.groupBy("bucket").applyInArrow(_answers, "bucket int, grp int, data binary, distinct long, mass long")
    answered = place.cut(answered, "answers")
    sums = answered.agg(F.sum("distinct").alias("v"), F.sum("mass").alias("n")).first()
    vocabulary, tokens = sums.v or 0, sums.n or 0
    return (
        texts.groupBy("grp")
        .cogroup(answered.select("grp", "bucket", "data").groupBy("grp"))
        .applyInArrow(
            _scores(order, strength, tokens, vocabulary),
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
        .withColumn("train_tokens", F.lit(tokens).cast("long"))
    )
