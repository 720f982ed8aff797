"""Rows that every operator on documents has to stand."""

import random


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version string, token string, node long, salt int, words string, copies int"


def filler(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents():
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, ties, repeated rows and ids."""
    base, passage = filler(1, 120), filler(2, 60)
    texts = {
        1: " ".join(base),
        2: "  " + "\n".join(base).upper() + "\t",
        3: " ".join(base[:60] + ["changed"] + base[61:]),
        4: None,
        5: "",
        6: " \t\r\n ",
        7: "one two three",
        8: "One  two THREE",
        9: " ".join(filler(3, 40) + passage + filler(4, 40)),
        10: " ".join(filler(5, 30) + passage + filler(6, 50)),
        11: " ".join(filler(7, 30_000, 50_000)),
        12: " ".join(filler(8, 40) + base[:13] + filler(9, 40)),
        13: " ".join(filler(10, 40) + base[:12] + filler(11, 40)),
        14: "été naïve " * 9 + "Ärger ÀÉ",
        15: "a " * 200,
        16: "a " * 190,
        17: " ".join(base[:119]),
    }
    rows = list(texts.items())
    rows += [(1, texts[1]), (7, "other words under one id"), (None, texts[9]), (None, None), (-3, " ".join(passage[5:40]))]
    return rows


def frame(spark, rows):
    """The rows with further columns whose names clash with those the operators use inside."""
    full = [(d, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), "v", "t", i, i, "w", 1) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
