"""Substring dedup: join documents on winnowed anchors, extend to whole windows and keep maximal repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, SPACE, part_count, scratch
from .grams import bucket_runs, chunks, in_bytes, ngrams, pack, slices, unpack, words_in

BUCKET_BYTES = 4 << 20
FLUSH_CHUNKS = 8
TURNS = 8
PART_BYTES = 8 << 20
_LOW48 = np.uint64(2**48 - 1)


def text_version() -> Column:
    """32 bits that tell texts of one id apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def winnowed(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` consecutive digests, the position of its smallest, the last one of equals."""
    n = len(seeds) - width + 1
    best, at = seeds[width - 1 :].copy(), np.arange(width - 1, len(seeds))
    for j in range(width - 2, -1, -1):
        here = seeds[j : j + n]
        better = here < best
        best[better] = here[better]
        at[better] = np.flatnonzero(better) + j
    return at


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of runs given by start and length, run after run."""
    before = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _anchors(docs: DataFrame, length: int, seed: int, bits: int) -> DataFrame:
    """(bucket, data): every window of ``length`` words under its anchor, dealt by the anchor's leading bits.

    All windows of one place that choose the same anchor are one entry: anchor, document, first window, window digests.
    """
    width = length - seed + 1

    def flushed(ids: np.ndarray, versions: np.ndarray, parts: list) -> pa.RecordBatch:
        anchor, row, start, count, windows = (np.concatenate(x) for x in zip(*parts))
        bucket = (anchor >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        windows = windows[_ragged(slices(count)[:-1][order], count[order])] & _LOW48
        bucket, anchor, row, start, count = bucket[order], anchor[order] & _LOW48, row[order], start[order], count[order]
        bounds = slices(count)
        keys, out = [], []
        for b, lo, hi in bucket_runs(bucket):
            who, held = in_bytes(row[lo:hi])
            a, w = anchor[lo:hi], windows[bounds[lo] : bounds[hi]]
            keys.append(b)
            out.append(
                pack(
                    ids[who], versions[who], held,
                    a.astype(np.uint32), (a >> np.uint64(32)).astype(np.uint16), start[lo:hi].astype(np.int32), count[lo:hi].astype(np.uint8),
                    w.astype(np.uint32), (w >> np.uint64(32)).astype(np.uint16),
                )
            )
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out, pa.binary())], ["bucket", "data"])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            versions = batch.column("version").to_numpy().astype(np.int32)
            parts = []
            for at, data, offsets in chunks(batch.column("text")):
                words, _, _, firsts = words_in(data, offsets, lower=False)
                if len(words) < length:
                    continue
                windows = ngrams(words, length)
                seeds = ngrams(words, seed)
                chosen = winnowed(seeds, width)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
                whole = np.flatnonzero(doc[: len(windows)] == doc[length - 1 :])
                if not len(whole):
                    continue
                windows, chosen, doc = windows[whole], chosen[whole], doc[whole]
                start = whole - firsts[doc]
                new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]))))
                parts.append((seeds[chosen[new]], doc[new] + at, start[new], np.diff(np.append(new, len(windows))), windows))
                if len(parts) == FLUSH_CHUNKS:
                    yield flushed(ids, versions, parts)
                    parts = []
            if parts:
                yield flushed(ids, versions, parts)

    return docs.where("doc_id is not null").select("doc_id", "version", "text").mapInArrow(run, "bucket int, data binary")


def _extended(parts: int):
    """From a bucket's anchors, the runs of windows that also start in a document with a smaller id, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int32, np.uint8, np.uint32, np.uint16, np.int32, np.uint8, np.uint32, np.uint16)
        got = [unpack(x.as_py(), *kinds) for x in table.column("data")]
        ids, versions, held, low, high, start, count, wlow, whigh = (np.concatenate(x) for x in zip(*got))
        del got
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), held)
        anchor = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        count, bounds = count.astype(np.int64), slices(count)
        runs = []
        for turn in range(TURNS):  # anchors in turns, so that little of the bucket is spread out at a time
            chosen = np.flatnonzero(anchor % np.uint64(TURNS) == turn)
            # seeds: anchors of two documents at least
            chosen = chosen[np.argsort(anchor[chosen], kind="stable")]
            if not len(chosen):
                continue
            a, d = anchor[chosen], ids[owner[chosen]]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            differ = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            kept = chosen[np.repeat(differ, np.diff(np.append(first, len(a))))]
            if not len(kept):
                continue
            # extension: whole windows around the anchor are compared; the smallest document id of each content keeps it
            entry = np.repeat(np.arange(len(kept)), count[kept])
            at = _ragged(bounds[:-1][kept], count[kept])
            key = (wlow[at].astype(np.uint64) | (whigh[at].astype(np.uint64) << np.uint64(32))) ^ (anchor[kept][entry] << np.uint64(16))
            doc = ids[owner[kept]][entry]
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            new = np.concatenate(([True], k[1:] != k[:-1]))
            repeat = np.zeros(len(k), bool)
            repeat[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
            spots = np.flatnonzero(repeat)
            e = entry[spots]
            inside = spots - slices(count[kept])[:-1][e]
            at = np.flatnonzero(np.concatenate(([True], (np.diff(spots) != 1) | (e[1:] != e[:-1])))) if len(spots) else spots
            runs.append(((start[kept][e] + inside)[at], np.diff(np.append(at, len(spots))), owner[kept][e][at]))
        none = np.zeros(0, np.int64)
        run_start, run_len, run_owner = (np.concatenate(x) for x in zip(*runs)) if runs else (none, none, none)
        part = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)[run_owner]
        order = np.lexsort((run_owner, part))
        run_start, run_len, run_owner, part = run_start[order], run_len[order], run_owner[order], part[order]
        lo = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(lo, np.append(lo[1:], len(part))):
            who, n = np.unique(run_owner[a:b], return_counts=True)
            out.append(pack(ids[who], versions[who], n.astype(np.int32), run_start[a:b].astype(np.int32), run_len[a:b].astype(np.uint8)))
        return pa.table({"part": pa.array(part[lo], pa.int32()), "data": pa.array(out, pa.binary())})

    return run


def _maximal(length: int):
    """Per document, its repeats: overlapping windows merged into maximal spans of words."""

    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), np.int64, np.int32, np.int32, np.int32, np.uint8) for x in table.column("data")]
        ids, versions, held, start, count = (np.concatenate(x) for x in zip(*got))
        doc, version = np.repeat(ids, held), np.repeat(versions, held)
        order = np.lexsort((start, version, doc))
        doc, version, start, end = doc[order], version[order], start[order], (start + count.astype(np.int32) + length - 1)[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]))) if len(doc) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        los, his = [], []
        for lo, hi in zip(at, np.append(at[1:], len(doc))):
            reach = np.maximum.accumulate(end[lo:hi])
            begin = np.flatnonzero(np.concatenate(([True], start[lo + 1 : hi] > reach[:-1])))
            last = np.append(begin[1:] - 1, hi - lo - 1)
            los.append(start[lo:hi][begin])
            his.append(reach[last])
        lists = pa.list_(pa.int32())
        return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "version": pa.array(version[at], pa.int32()), "lo": pa.array(los, lists), "hi": pa.array(his, lists)})

    return run


def repeats(docs: DataFrame, length: int = 13, seed: int = 5) -> DataFrame:
    """(doc_id, version, lo, hi): maximal runs of words that repeat ``length`` words or more of a document with a smaller id.

    ``lo`` and ``hi`` are the runs' first positions and those past their last; ``version`` tells texts of one id apart.
    Every window of ``length`` words chooses as anchor the smallest digest among its runs of ``seed`` words, so equal
    windows choose equal anchors. Anchors of a single document are dropped; around the others, whole windows are compared.
    An anchor's group is worked on in one task, but packed (about 60 bytes an occurrence), and no pairs are made.
    """
    parts = part_count(docs, PART_BYTES)
    bits = int(part_count(docs, BUCKET_BYTES) - 1).bit_length()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_version().alias("version"), F.col("text").cast("string").alias("text"))
    found = _anchors(texts, length, seed, bits).groupBy("bucket").applyInArrow(_extended(parts), "part int, data binary")
    return found.groupBy("part").applyInArrow(_maximal(length), "doc_id long, version int, lo array<int>, hi array<int>")


def without_repeats(docs: DataFrame, length: int = 13, seed: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words left, joined by single spaces).

    A word goes if a window of ``length`` consecutive words that covers it also starts in a document with a smaller id; windows
    are judged on the given texts. Null and empty texts have no words. Rows without an id keep all and remove nothing elsewhere;
    rows of one id don't remove each other's words; repeated rows get equal results. Empty tables and further columns are fine.
    """
    found = _stripped(docs.select("doc_id", "text"), length, seed)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept"))


def _stripped(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """``docs`` with _n_words, _n_removed and _kept."""
    place = scratch(docs.sparkSession)
    found = place.cut(repeats(docs, length, seed), "repeats")
    f = found.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (text_version() == F.col("_version"))
    joined = docs.join(f.hint("shuffle_hash"), same, "left").drop("_id", "_version")
    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE), "")
    worded = joined.withColumn("_words", F.explode(F.array(words)))  # computed once per row
    # what lies between the runs, from the end of one to the start of the next
    ends, starts = F.concat(F.array(F.lit(0)), "_hi"), F.concat("_lo", F.array(F.size("_words")))
    left = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(F.col("_words"), a + 1, b - a)))
    stripped = worded.withColumn("_left", F.explode(F.array(F.when(F.col("_lo").isNull(), F.col("_words")).otherwise(left))))
    return stripped.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_n_words"),
        (F.size("_words") - F.size("_left")).cast("long").alias("_n_removed"),
        F.array_join("_left", " ").alias("_kept"),
    )


def with_kept_text(docs: DataFrame, length: int = 13, seed: int = 5) -> DataFrame:
    """``docs`` with the repeats taken out of ``text``; a text that loses nothing is left as it is. ``n_chars``, if there, follows.

    Null texts stay null; other columns are kept, whatever they are called; an empty table stays empty.
    """

    def work(d: DataFrame) -> DataFrame:
        found = _stripped(d, length, seed)
        text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
        columns = {"text": text} | ({"n_chars": F.length(text).cast(dict(d.dtypes)["n_chars"])} if "n_chars" in d.columns else {})
        return found.select(*[columns.get(c, F.col(c)).alias(c) for c in d.columns])

    return apart(docs, ["doc_id", "text", "n_chars"], work)
