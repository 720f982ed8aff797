"""Brute-force versions of the operators, in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACE.findall(text or "")


def held(doc_id, folds, fold=1):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def gram_scores(rows, strength, out, order=2):
    """(n_tokens, n_known, N, base, score) of each row in a model of grams up to ``order``, smoothed by virtual shorter grams."""
    texts = [["<s>", *words(lower(t)), "</s>"] for _, t in rows]
    grams, after = Counter(), Counter()
    for (d, _), t in zip(rows, texts):
        if not out(d):
            for i in range(1, len(t)):
                for k in range(min(order, i + 1)):
                    grams[tuple(t[i - k : i + 1])] += 1
                    after[tuple(t[i - k : i])] += 1
    n, v = after[()], sum(len(g) == 1 for g in grams)
    found = []
    for t in texts:
        base = score = known = 0
        for i in range(1, len(t)):
            c = grams[(t[i],)]
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            known += c > 0
            for k in range(1, min(order, i + 1)):
                p = (grams[tuple(t[i - k : i + 1])] + strength * p) / (after[tuple(t[i - k : i])] + strength)
            score += math.log10(p)
        found.append((len(t) - 1, known, n, base, score))
    return found


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def components(rows, percent=75, k=5):
    """Per row: (set size, smallest id reachable)."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    seen = set()
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                pair = (members[b], members[a])
                if pair not in seen:
                    seen.add(pair)
                    x, y = sets[pair[0]], sets[pair[1]]
                    if 100 * len(x & y) >= percent * len(x | y):
                        parent[root(pair[1])] = root(pair[0])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(len(s), least.get(root(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def removed(rows, length=13):
    """Per row: (n_words, n_removed, words kept joined)."""
    first = {}
    texts = [words(t) for _, t in rows]
    for (d, _), w in zip(rows, texts):
        if d is not None:
            for i in range(len(w) - length + 1):
                g = tuple(w[i : i + length])
                first[g] = min(first.get(g, d), d)
    found = []
    for (d, _), w in zip(rows, texts):
        gone = set()
        if d is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i : i + length])] < d:
                    gone.update(range(i, i + length))
        found.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return found
