"""Fingerprints and their exact links against brute force."""

import random

import numpy as np
import pytest
import rows
import xxhash
from pyspark.sql import functions as F

from grovelight.llm import simhash


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    name = list(range(len(prints)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                name[b] = a
    return [top(i) for i in range(len(prints))]


def expected(data):
    prints = [brute_print(t) for _, t in data]
    parts = brute_components(prints)
    least = {}
    for (d, _), p in zip(data, parts):
        if d is not None:
            least[p] = min(least.get(p, d), d)
    return sorted(((d, f"{f:016x}", least.get(p)) for (d, _), f, p in zip(data, prints, parts)), key=repr)


def near(seed, n):
    base = rows.filler(seed, 90)
    out = []
    for i in range(n):
        rng, words = random.Random(1000 * seed + i), list(base)
        for at in rng.sample(range(90), rng.choice([0, 1, 1, 2, 3])):
            words[at] = f"y{seed}_{i}_{at}"
        out.append((100 * seed + i, " ".join(words)))
    return out


def test_fingerprints_match_sparks_hash(spark):
    shingle = spark.createDataFrame([("ab c",)], "t string").select(F.hex(F.xxhash64("t")).alias("h")).first()["h"]
    assert f"{simhash.fingerprint(b'AB  c'):016X}" == shingle
    long = " ".join(f"t{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(long.encode()) == brute_print(long)


@pytest.mark.parametrize("shard_rows, sample", [(1 << 14, 1 << 17), (8, 1 << 17), (8, 24)])
def test_components_match_brute_force(spark, shard_rows, sample):
    data = rows.documents() + near(31, 60) + near(32, 40) + [(9000 + i, " ".join(rows.filler(9000 + i, 20))) for i in range(80)]
    found = simhash.near_duplicates(rows.frame(spark, data), shard_rows=shard_rows, sample=sample)
    assert rows.collected(found, "doc_id", "fingerprint", "component_id") == expected(data)


def test_links_of_crowds(spark):
    """Chains and balls of fingerprints: every pair within three bits is linked, no other one is."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(60):
            prints.add(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                p ^= 1 << b
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(500)} | {0, (1 << 64) - 1})
    parts = brute_components(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    for shard_rows in (40, 4000):
        name = {p: p for p in signed}

        def top(p):
            while name[p] != p:
                p = name[p]
            return p

        links = simhash.near_links(table, 3, shard_rows, 1 << 10).collect()
        for r in links:
            name[top(r["i"])] = top(r["j"])
        got = {}
        for p, part in zip(signed, parts):
            got.setdefault(top(p), set()).add(part)
        assert all(len(s) == 1 for s in got.values()) and len(got) == len(set(parts))


def test_a_hot_fingerprint_and_nothing(spark):
    data = [(i, "one two three four") for i in range(3000)] + [(5000 + i, None) for i in range(1500)] + [(-9, "other words here")]
    found = simhash.near_duplicates(rows.frame(spark, data)).groupBy("component_id").count().collect()
    assert sorted((r["component_id"], r["count"]) for r in found) == [(-9, 1), (0, 3000), (5000, 1500)]
    assert simhash.near_duplicates(rows.empty(spark)).count() == 0
