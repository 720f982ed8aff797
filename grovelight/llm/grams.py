"""Word and n-gram digests of whole texts with numpy, for use inside tasks.

A word is a run of bytes other than ASCII white space. Its digest is a polynomial in its bytes modulo 2**64, read off one
running sum over the bytes of many texts, then mixed. An n-gram's digest combines the digests of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * CHUNK_BYTES)
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            made.append(np.cumprod(factors, dtype=np.uint64))
        _powers[:] = made
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal in gives equal out, and nothing else does."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_in(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, starts, ends, firsts): of all words of texts that lie one after the other in ``data``.

    Text i is data[offsets[i]:offsets[i+1]] and has the words firsts[i]:firsts[i+1]; starts and ends are byte positions.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True  # a text's first byte starts a word even where the text before ends without a space
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | begins[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _tables(len(data))
    codes = (_LOWER if lower else _SAME)[data].astype(np.uint64) + np.uint64(1)
    codes *= power[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes, out=total[1:])
    digests = mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return digests, s, e, np.searchsorted(s, offsets)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of about a MB of an Arrow string column; null is empty. No text is cut."""
    if len(texts) == 0:
        return
    wide = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    wide = wide.fill_null("")
    _, offset_buffer, data_buffer = wide.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(wide):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, len(wide))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def ngrams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Digests of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (seed * 0x2545F4914F6CDD1D + k) & (2**64 - 1), np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mixed(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct digests of a text's k-word shingles; a shorter text is one shingle, none if it has no words."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(ngrams(words, min(k, len(words)), seed=len(words) if len(words) < k else 0))


def set_digest(tokens: np.ndarray) -> int:
    """A digest of a sorted set, as a signed 64-bit number."""
    power, _ = _tables(len(tokens) + 1)
    total = np.uint64((int((mixed(tokens) * power[1 : len(tokens) + 1]).sum(dtype=np.uint64)) + len(tokens)) & (2**64 - 1))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each led by its length; ``unpack`` needs the same types in the same order."""
    return b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)


def unpack(data: bytes, *types) -> list[np.ndarray]:
    at, out = 0, []
    for kind in types:
        n = int.from_bytes(data[at : at + 8], "little")
        kind = np.dtype(kind)
        out.append(np.frombuffer(data, kind, n, at + 8))
        at += 8 + n * kind.itemsize
    return out


def slices(counts: np.ndarray) -> np.ndarray:
    """Bounds of consecutive runs of these lengths."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def bucket_runs(bucket: np.ndarray) -> zip:
    """(number, first, last + 1) of each bucket that a sorted array of bucket numbers holds; empty ones cost nothing."""
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[at].tolist(), at.tolist(), np.append(at[1:], len(bucket)).tolist())


def in_bytes(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal numbers as (number, length), lengths in one byte: a run of over 255 comes in several parts."""
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    length = np.diff(np.append(new, len(owner)))
    parts = -(-length // 255)
    out = np.full(int(parts.sum()), 255, np.uint8)
    out[np.cumsum(parts) - 1] = length - 255 * (parts - 1)
    return np.repeat(owner[new], parts), out


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed: small numbers and repeated high bytes cost little."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return zstandard.compress(planes, 1)


def spread(data: bytes, kind=np.uint64) -> np.ndarray:
    """What ``squeezed`` has packed."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)
