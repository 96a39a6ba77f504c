"""Periodic runs of words: maximal stretches that repeat themselves at least twice, found from maximal pairs.

A run with period q and length L from word s is the pair of places (s, s + q): the words from there on agree for L - q
words and no more, and the words before differ. So the runs are exactly the maximal pairs whose distance is at most the length
they agree for. All maximal pairs come out of the LCP-interval tree of a text's suffix array, walked bottom-up. A node
holds the places of its suffixes in text order, with the class of the word to the left of each; when two children are
merged, a place is compared with the nearest places of the other child, and a pair of different left classes is
maximal. Only the nearest can be a run: of two places further apart within their common length the stretch has a smaller period.
A stretch that is found with several multiples of its period keeps the smallest one.

Texts are independent, so rows are worked on where they are read. Texts of one batch share a suffix array, as words are
numbered per text. A text without any repeated stretch of six words has no run and takes no part in it. Time is in
proportion to n log^2 n for n words, memory to n log n; a single very long text is one task's work.

Defined results: null and empty texts have no words, no runs and the checksum of an empty text. Rows without an id are
not planted with a repetition. Repeated rows each give a row. An empty table gives no rows. Further columns of the
input, whatever their names, take no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

C = F.col
LEAST = 12  # words of a run, at least; also twice the shortest agreement
_CHUNK = 1 << 20  # words that share a suffix array, unless one text has more


class Places:
    """Ascending places in blocks, so that an insertion moves few of them."""

    FULL = 1024

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def neighbours(self, x: int) -> tuple[int, int]:
        """The places before and after ``x``, -1 where there is none."""
        k = self._block(x)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else -1
        after = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return before, after

    def _block(self, x: int) -> int:
        lo, hi = 0, len(self.blocks) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.blocks[mid][-1] < x:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def add(self, x: int) -> None:
        k = self._block(x)
        block = self.blocks[k]
        insort(block, x)
        self.size += 1
        if len(block) > self.FULL:
            self.blocks[k:k + 1] = [block[:self.FULL // 2], block[self.FULL // 2:]]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def suffix_array(symbols: np.ndarray, least: int = LEAST // 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and, for each, how far it agrees with the one before it.

    Agreements of fewer than ``least`` symbols may be given too small. Prefix doubling: suffixes whose rank is settled are left alone.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, width = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1
    while True:
        alone = first & np.concatenate((first[1:], [True]))
        open_ = np.flatnonzero(~alone)  # positions of the order that are tied with a neighbour
        if not len(open_):
            break
        at = order[open_]
        head = rank[at]
        ahead = at + width
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((nxt, head))
        order[open_] = at[by]
        head, nxt = head[by], nxt[by]
        fresh = np.concatenate(([True], (head[1:] != head[:-1]) | (nxt[1:] != nxt[:-1])))
        first[open_] = fresh
        start = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[order[open_]] = start
        levels.append(rank.astype(levels[0].dtype))
        width *= 2
    agree = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        ok = (left < n) & (right < n)
        same = ok & (levels[level][np.minimum(left, n - 1)] == levels[level][np.minimum(right, n - 1)])
        step = same.astype(np.int64) << level
        agree[1:] += step
        left += step
        right += step
    return order, agree


def maximal_pairs(order: list[int], agree: list[int], left: list[int], least: int = LEAST):
    """(place, distance, agreement) of maximal pairs whose distance is at most their agreement, from the LCP-interval tree.

    ``order`` are suffixes that all agree with the one before them for at least ``least`` / 2 symbols (``agree``, whose
    first entry is not read); ``left`` is the class of the symbol before each place of the text.
    """
    found = []

    def merge(a: Places, b: Places, depth: int) -> Places:
        if a.size < b.size:
            a, b = b, a
        near = []
        for x in b:
            before, after = a.neighbours(x)
            if before >= 0 and x - before <= depth and x - before + depth >= least and left[x] != left[before]:
                near.append((before, x - before, depth))
            if after >= 0 and after - x <= depth and after - x + depth >= least and left[x] != left[after]:
                near.append((x, after - x, depth))
        for x in b:
            a.add(x)
        found.extend(near)
        return a

    stack: list[list] = []
    for i, place in enumerate(order):
        node = Places(place)
        depth = agree[i + 1] if i + 1 < len(order) else 0
        while stack and stack[-1][0] > depth:
            d, held = stack.pop()
            node = merge(held, node, d)
        if stack and stack[-1][0] == depth:
            stack[-1][1] = merge(stack[-1][1], node, depth)
        elif i + 1 < len(order):
            stack.append([depth, node])
    return found


def _repeats(symbols: np.ndarray, starts: np.ndarray, span: int = LEAST // 2) -> np.ndarray:
    """Which texts may repeat a stretch of ``span`` words: rolling hashes meet; a chance meeting only costs time."""
    n = len(symbols)
    may = np.zeros(len(starts), bool)
    if n < span + 1:
        return may
    mixed = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n - span + 1, np.uint64)
    for k in range(span):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k:n - span + 1 + k]
    order = np.argsort(h)
    twice = np.flatnonzero(h[order][1:] == h[order][:-1])
    may[np.searchsorted(starts, order[twice], "right") - 1] = True
    return may


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        stop, words = at, 0
        while stop < len(texts) and (stop == at or words + len(texts[stop]) + 1 <= _CHUNK):
            words += len(texts[stop]) + 1
            stop += 1
        _runs_of_chunk(texts[at:stop], out[at:stop])
        at = stop
    return out


def _runs_of_chunk(texts: list[list[bytes]], out: list[list]) -> None:
    numbered, base = [], 0
    for words in texts:  # numbers of one text are not used by another, nor is the mark at its end
        ids: dict[bytes, int] = {}
        numbered.append(np.array([ids.setdefault(w, len(ids)) for w in words] + [len(ids)], np.int64) + base)
        base += len(ids) + 1
    sizes = np.array([len(x) for x in numbered])
    starts = np.cumsum(sizes) - sizes
    picked = np.flatnonzero(_repeats(np.concatenate(numbered), starts))
    if not len(picked):
        return
    symbols = np.concatenate([numbered[k] for k in picked])
    starts = np.cumsum(sizes[picked]) - sizes[picked]
    order, agree = suffix_array(symbols)
    left = np.concatenate(([-1], symbols[:-1]))
    left[starts] = -1
    cut = np.flatnonzero(agree < LEAST // 2)
    bounds = np.append(cut, len(order))
    classes = left.tolist()
    best: list[dict] = [{} for _ in picked]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < 2:
            continue
        pairs = maximal_pairs(order[a:b].tolist(), agree[a:b].tolist(), classes)
        if not pairs:
            continue
        owner = np.searchsorted(starts, [p[0] for p in pairs], "right") - 1
        for (place, distance, depth), k in zip(pairs, owner.tolist()):
            key = (place - int(starts[k]), distance + depth)
            if distance < best[k].get(key, distance + 1):
                best[k][key] = distance
    for k, held in zip(picked.tolist(), best):
        out[k].extend(sorted(((s, length, q) for (s, length), q in held.items()), key=lambda r: (r[0], r[2])))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """``words``, of which one text in ten repeats a part of itself from a word on, both picked by the id."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that lie in a run after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        drop[s + q] += 1
        drop[s + length] -= 1
    gone = np.cumsum(drop)
    return [w for w, d in zip(words, gone.tolist()) if not d]


def _apply(docs: DataFrame, change, columns: list[tuple[str, T.DataType]], rows) -> DataFrame:
    """Map (words, runs) of every row in place; ``change(words, doc_id)`` comes before the search."""
    src = docs.select("doc_id", "text")
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(n, t) for n, t in columns)])

    def apply(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [change(t.split(), i) for t, i in zip(b.column(1).fill_null("").cast(pa.binary()).to_pylist(), ids)]
            found = [rows(w, r) for w, r in zip(texts, runs_of(texts))]
            cols = list(zip(*found)) or [()] * len(columns)
            kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(),
                     "array<struct<start:bigint,length:bigint,period:bigint>>": pa.list_(pa.struct(
                         [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
            arrays = [pa.array(list(c), kinds[t.simpleString()]) for c, (_, t) in zip(cols, columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=schema.names)

    return src.mapInArrow(apply, schema)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, every run (start, length, period) and the text with each run cut to its first period."""
    run = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))

    def rows(words, runs):
        return ([{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(collapse(words, runs)).decode())

    return _apply(docs, lambda words, _: words, [("runs", run), ("collapsed", T.StringType())], rows)


def digests(docs: DataFrame, change=planted) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and checksums of the runs and the collapsed text."""
    def rows(words, runs):
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
                sha256(listed.encode()).hexdigest(), sha256(b" ".join(collapse(words, runs))).hexdigest())

    return _apply(docs, change, [*((n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")),
                                 ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())], rows)
