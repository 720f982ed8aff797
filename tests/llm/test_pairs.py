"""Near duplicates, repeated passages and benchmark windows against brute force."""

import brute
import pytest
import rows
from pyspark.sql import functions as F

from grovelight.llm import common, decontam, jaccard, substrings
from grovelight.llm.grams import ngrams, words_in


def test_word_digests_follow_the_words():
    import numpy as np

    texts = ["a b", "", "b  A", "\tna\u00efve x", "x" * 70_000 + " b"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    digests, starts, ends, firsts = words_in(np.frombuffer(b"".join(data), np.uint8), offsets, lower=True)
    assert firsts.tolist() == [0, 2, 2, 4, 6, 8]
    assert digests[0] == digests[3] and digests[1] == digests[2] == digests[7]
    assert len(set(digests.tolist())) == 5
    assert len(ngrams(digests, 9)) == 0


def test_components_match_brute_force(spark):
    data = rows.documents()
    found = jaccard.similar_components(rows.frame(spark, data))
    expected = [(d, n, c) for (d, _), (n, c) in zip(data, brute.components(data))]
    named = [e for e in expected if e[0] is not None]
    got = rows.collected(found, "doc_id", "n", "component_id")
    assert [g for g in got if g[0] is not None and g[0] != 7] == sorted((e for e in named if e[0] != 7), key=repr)
    # rows without an id take part but name nothing
    assert [g[1:] for g in got if g[0] is None] == sorted([(0, None), (len(brute.shingles(dict(data)[9])), 9)], key=repr)


@pytest.mark.parametrize("buckets", [2, 16, 70_000])
def test_any_number_of_buckets(spark, monkeypatch, buckets):
    """The buckets that shingles and anchors are dealt to, few or more than 16 bits can number, change nothing."""
    data = [(d, " ".join(t.split()[:400]) if t else t) for d, t in rows.documents()]
    docs = rows.frame(spark, data)
    for module in (jaccard, substrings):
        monkeypatch.setattr(module, "BUCKET_BYTES", common.counted_bytes(docs) / buckets)
    monkeypatch.setattr(common.part_count, "__defaults__", (2,))
    assert int(common.part_count(docs, jaccard.BUCKET_BYTES) - 1).bit_length() == (buckets - 1).bit_length()
    named = [(d, n, c) for (d, _), (n, c) in zip(data, brute.components(data)) if d not in (None, 7)]
    got = rows.collected(jaccard.similar_components(docs), "doc_id", "n", "component_id")
    assert [g for g in got if g[0] not in (None, 7)] == sorted(named, key=repr)
    found = rows.collected(substrings.without_repeats(docs), "doc_id", "kept")
    monkeypatch.undo()
    assert found == rows.collected(substrings.without_repeats(docs), "doc_id", "kept")


def test_a_group_of_borderline_copies(spark):
    """Copies that differ so much from each other that no single one is linked with all."""
    import random

    base, data = rows.filler(20, 150), []
    for i in range(60):
        rng = random.Random(100 + i)
        words = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6])):
            words[at] = f"x{i}_{at}"
        data.append((i, " ".join(words)))
    data += [(100 + i, " ".join(rows.filler(300 + i, 30) + base[:60])) for i in range(20)]  # a frequent passage
    got = rows.collected(jaccard.similar_components(rows.frame(spark, data)), "doc_id", "n", "component_id")
    assert got == sorted(((d, n, c) for (d, _), (n, c) in zip(data, brute.components(data))), key=repr)


def test_one_of_each_component_stays(spark):
    data = [r for r in rows.documents() if r[0] != 7]
    frame = rows.frame(spark, data)
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    expected = {d for (d, _), (_, c) in zip(data, brute.components(data)) if d is not None and c == d}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(expected)


def test_repeats_match_brute_force(spark):
    data = rows.documents()
    found = substrings.without_repeats(rows.frame(spark, data))
    expected = sorted(((d, *r) for (d, _), r in zip(data, brute.removed(data))), key=repr)
    assert rows.collected(found, "doc_id", "n_words", "n_removed", "kept") == expected


def test_kept_text_replaces_only_what_lost_words(spark):
    frame = rows.frame(spark, rows.documents())
    out = substrings.with_kept_text(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    texts = {r["doc_id"]: r for r in out.where("doc_id in (2, 12, 13)").collect()}
    before = dict(rows.documents())
    assert texts[2]["text"] == before[2] and texts[13]["text"] == before[13]
    assert len(texts[12]["text"].split()) == 80 and texts[12]["n_chars"] == len(texts[12]["text"])


@pytest.mark.parametrize("length, seed", [(6, 2), (13, 13), (5, 4)])
def test_other_window_lengths(spark, length, seed):
    data = rows.documents()[:10]
    found = substrings.without_repeats(rows.frame(spark, data), length, seed)
    assert rows.collected(found, "n_removed", "kept") == sorted(((r[1], r[2]) for r in brute.removed(data, length)), key=repr)


def _hits(data, items, size=13):
    import re

    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(t)) if w]
    windows = {}
    for item, text in items:
        w = cut(text)
        for s in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(item)
    out = []
    for d, t in data:
        w, spots, ids = cut(t), set(), set()
        for win, named in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    spots.update(range(s, s + len(win)))
                    ids |= named
        out.append((d, len(w), len(spots), sorted(str(i) for i in ids if i is not None)))
    return out


def test_benchmark_windows_match_brute_force(spark):
    data = [r for r in rows.documents() if r[0] != 11]
    items = [(1, " ".join(rows.filler(2, 60)[10:40])), (2, "one, two! THREE"), (3, None), (4, ""), (5, "?!"), (6, "other words"), (7, "a"), (7, "a"), (None, "naïve été"), (10, "one two three")]
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, window string")
    found = decontam.contaminated_words(rows.frame(spark, data), bench)
    assert rows.collected(found, "doc_id", "n_words", "n_hit", "items") == sorted(_hits(data, items), key=repr)
    kept = decontam.drop_contaminated(rows.frame(spark, data), bench)
    bad = {d for d, n, h, _ in _hits(data, items) if h and 20 * h >= n}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in data} - bad | ({None} if any(d is None for d, _ in data) else set())


def test_empty_tables(spark):
    nothing = rows.empty(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.similar_components(nothing).count() == 0
    assert substrings.without_repeats(nothing).count() == 0
    assert decontam.contaminated_words(nothing, bench).count() == 0
    some = rows.frame(spark, rows.documents()[:5])
    assert decontam.contaminated_words(some, bench).agg(F.sum("n_hit")).first()[0] == 0
