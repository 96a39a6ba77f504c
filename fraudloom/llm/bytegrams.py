"""Byte n-grams of packed texts: unique codes per pack, buckets by the two nearest context bytes.

A gram of n bytes is an integer whose lowest byte is the predicted byte and whose next bytes are its context,
nearest first. Every text is framed by n - 1 zero bytes in front and one zero byte as its end, so a text of m bytes
has m + 1 grams. All contexts of two or more bytes that end in the same two bytes share a bucket: longer contexts
and their shorter forms meet in one group. Contexts that the caller calls busy are dealt by their third byte as well.
A group holds each gram once for every pack that has it.
"""

from __future__ import annotations

import numpy as np
import zstandard


def codes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes of all texts, and for each the index of its text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = n - 1
    x = np.frombuffer(b"\0" * pad + (b"\0" * n).join(texts) + b"\0", np.uint8)
    m = len(x) - pad
    out = np.zeros(m, np.int64)
    for j in range(n):
        out <<= 8
        out |= x[j:j + m]
    del x
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + n)[:m]
    if len(texts) > 1:  # the zeros between two texts: one end, then context only
        keep = np.ones(m, bool)
        ends = np.cumsum(lengths + n)[:-1] - n
        for j in range(1, n):
            keep[ends + j] = False
        out, owner = out[keep], owner[keep]
    return out, owner


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts, or sums of weights. Sorts ``keys`` in place where there are no weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64 if weights is None else weights.dtype)
    if weights is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    if weights is None:
        return keys[at], np.diff(np.r_[at, len(keys)])
    return keys[at], np.add.reduceat(weights, at)


def by_text(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (gram, text) pairs as arrays (code, text index, count), sorted by code."""
    c, owner = codes(texts, n)
    bits = max(len(texts), 1).bit_length()
    distinct = None
    if 8 * n + bits > 63:  # too wide for one word: number the grams first
        distinct, c = np.unique(c, return_inverse=True)
    c <<= bits
    c |= owner
    del owner
    c, k = tally(c)
    owner = c & ((1 << bits) - 1)
    c >>= bits
    return (c if distinct is None else distinct[c]), owner, k


def bucket_of(code: np.ndarray, buckets: int, busy: np.ndarray | None = None) -> np.ndarray:
    """Bucket of a gram: a mix of its two nearest context bytes, and of the third where ``busy`` (by the two) is true."""
    near = (code >> 8) & 0xFFFF
    mix = near * 40503 >> 4
    if busy is not None:
        mix = np.where(busy[near], mix + (((code >> 24) & 0xFF) + 1) * 2654435761 >> 7, mix)
    return (mix & 0xFFFFF) % buckets


def near_contexts(texts, chunk: int = 1 << 20) -> np.ndarray:
    """How often each two bytes (nearest first from the low end) stand before a byte or the end of a text."""
    out, held, size = np.zeros(65536, np.int64), [], 0

    def add():
        x = np.frombuffer(b"\0".join(held), np.uint8).astype(np.int64)
        return np.bincount(x[:-1] << 8 | x[1:], minlength=65536)

    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size > chunk:
            out += add()
            held, size = [], 0
    return out + add()


def squeeze(values: np.ndarray) -> bytes:
    """An array as byte planes, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def expand(blob: bytes, kind: str = "<i8") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_keys(code: np.ndarray) -> bytes:
    """Sorted codes as differences, compressed."""
    return squeeze(np.diff(code, prepend=0).astype("<i8"))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob))


def merge(parts, least: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of all (codes, counts) and their summed counts, merged as they come.

    What waits never exceeds what is merged, or ``least``, by more than one part.
    """
    code, count, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > max(least, len(code)):
            code, count = tally(*(np.concatenate(x) for x in zip((code, count), *held)))
            held, size = [], 0
    return tally(*(np.concatenate(x) for x in zip((code, count), *held)))


def split(code: np.ndarray, count: np.ndarray, buckets: int, busy: np.ndarray | None = None):
    """(bucket, codes, counts) per bucket that has codes; codes stay sorted."""
    b = bucket_of(code, buckets, busy)
    order = np.argsort(b, kind="stable")
    edge = np.searchsorted(b[order], np.arange(buckets + 1))
    for i in range(buckets):
        at = order[edge[i]:edge[i + 1]]
        if len(at):
            yield i, code[at], count[at]


def join_answers(code: np.ndarray, buckets: int, answers: dict[int, np.ndarray], busy: np.ndarray | None = None) -> np.ndarray:
    """Answers of the buckets put back in the order of ``code``."""
    b = bucket_of(code, buckets, busy)
    out = np.zeros(len(code))
    for i, values in answers.items():
        out[b == i] = values
    return out
