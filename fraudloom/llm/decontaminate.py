"""Benchmark decontamination: CGK random-walk embedding and bit-sampling LSH over item-sized windows, then exact edits.

Texts are sequences of lower-cased words. Items fall into length classes; a window of a class's length starts at every
word of every document. A window can only hold an item within ``edits`` of its words if nearly all its words occur in
items of the class, so windows without that are passed over at once (nothing is lost: an edit changes one word).
The others are embedded by a random walk that repeats or advances on a hash of (step, word), which turns edits into
few differing coordinates; each table hashes a sample of coordinates, and windows that fall on an item's hash are
candidates. The number of tables is set per class by measuring, on randomly edited copies of its own items with the
most edits allowed, how often one table finds them, until the target recall is met. A class that would need more than
``TABLES`` tables (very long items, in which many edits leave few coordinates alike) is searched exactly instead: of
one piece more than the edits allowed, one piece must stand in the document unchanged. ``recalls`` lists what each class reaches.
Candidates are decided by the exact edit distance of the item to the best stretch of the document around the window.

Documents are scanned in place without a shuffle. Benchmark items are handled in slices of at most ``slice_items``
items, so what is broadcast is bounded and a larger benchmark means more passes.

Defined results: null and empty texts hold nothing, null or wordless items match nothing, items of fewer than
``min_words`` words must match word for word. Equal items match each under its own id, repeated rows of the benchmark
once; an id with several texts matches by each of them. Documents without an id are scanned too, repeated rows each
on its own. Each (document row, item text) gives its best match only: fewest edits, then the first place. Texts of any
length are read whole, in slices of about 8 MB of text. Further columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settle, slices

C = F.col
WORD = re.compile(r"\w+")
STEP = 1.25  # ratio of the lengths within a class
TABLES = 400  # tables of a class; one that needs more is searched exactly
LONG = 64  # words of an item from which its edits are counted a row at a time


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def allowed(m: int, similarity: float, min_words: int) -> int:
    """Most edits of an item of m words."""
    return 0 if m < min_words else int(m * (1 - similarity) + 1e-9)


def best_stretch(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """Least edits between the item and any stretch of the text, with its start and end; the first such end wins."""
    return rows_stretch(item, text) if len(item) > LONG else cells_stretch(item, text)


def rows_stretch(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """The same as ``cells_stretch``, a whole row of cells at a time."""
    words, at = np.array(item), np.arange(len(item) + 1)
    edits, start = at.copy(), np.zeros(len(at), np.int64)
    best = (len(item), 0, 0)
    for j, w in enumerate(text, 1):
        keep, keep_start = edits[:-1] + (words != w), start[:-1]
        extra = edits[1:] + 1
        less = extra < keep
        cell, cell_start = np.r_[0, np.where(less, extra, keep)], np.r_[j, np.where(less, start[1:], keep_start)]
        low = cell - at  # a cell that follows a lower one takes it over, one edit a step
        run = np.minimum.accumulate(low)
        source = np.maximum.accumulate(np.where(low == run, at, 0))
        edits, start = run + at, cell_start[source]
        if edits[-1] < best[0]:
            best = (int(edits[-1]), int(start[-1]), j)
    return best


def cells_stretch(item: list[int], text: list[int]) -> tuple[int, int, int]:
    row = [(i, 0) for i in range(len(item) + 1)]  # edits, start of the stretch
    best = (len(item), 0, 0)
    for j, w in enumerate(text, 1):
        prev, row[0] = row[0], (0, j)
        for i, v in enumerate(item, 1):
            keep = prev if v == w else (prev[0] + 1, prev[1])
            a, b = row[i], row[i - 1]
            prev = a
            cell = keep
            if a[0] + 1 < cell[0]:
                cell = (a[0] + 1, a[1])
            if b[0] + 1 < cell[0]:
                cell = (b[0] + 1, b[1])
            row[i] = cell
        if row[-1][0] < best[0]:
            best = (row[-1][0], row[-1][1], j)
    return best


def walk(seq: np.ndarray, start: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embedding of the stretches that begin at ``start``; words after the end of ``seq`` are -1."""
    at, out = start.copy(), np.empty((len(start), steps), np.int32)
    top = len(seq) - 1
    for j in range(steps):
        sym = np.where(at <= top, seq[np.minimum(at, top)], -1)
        out[:, j] = sym
        h = (sym.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((j + 1) * 0x85EBCA6B + seed * 0xC2B2AE35)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        at += (h >> np.uint64(60) & np.uint64(1)).astype(at.dtype)
    return out


def hashes(embedded: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the picked coordinates of every row."""
    h = np.full(len(embedded), 0x243F6A8885A308D3, np.uint64)
    for c in picks:
        h = (h ^ (embedded[:, c].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class LengthClass:
    """Items of similar length with their tables of sampled coordinates."""

    def __init__(self, size: int, members: list[int], items: list[list[int]], edits: int, bits: int, recall: float, seed: int):
        self.size, self.members, self.edits = size, members, edits
        self.steps = max(bits, int(1.5 * size))
        rng = np.random.default_rng(seed)
        probes, of = [], []
        for i, k in enumerate(members):
            for _ in range(1 if not edits else 8):
                x = list(items[k])
                for _ in range(edits):
                    what, p = rng.integers(3), int(rng.integers(len(x) or 1))
                    other = items[members[int(rng.integers(len(members)))]]
                    w = other[int(rng.integers(len(other)))] if rng.random() < 0.5 else -2
                    if what == 0:
                        x[p:p + 1] = [w]
                    elif what == 1:
                        x.insert(p, w)
                    else:
                        del x[p:p + 1]
                probes.append(x)
                of.append(i)
        self.tables, missed, of = [], np.ones(len(probes), bool), np.array(of)
        laid = [self.lay_out([items[k] for k in members]), self.lay_out(probes)]
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # words: sorted hashes, items, places in them
        while missed.mean() > 1 - recall:
            done, left = len(self.tables), missed.mean()
            if done >= TABLES or done >= 16 and done * np.log(1 - recall) / np.log(min(left, 1 - 1e-9)) > TABLES:
                self.tables = []
                self.cut(items)
                break
            walk_seed = seed * 1000 + len(self.tables) // 8
            if len(self.tables) % 8 == 0:  # eight samples of coordinates share a walk
                own, test = (walk(*x, self.steps, walk_seed) for x in laid)
            picks = np.sort(rng.choice(self.steps, min(bits, self.steps), replace=False))
            h = hashes(own, picks)
            order = np.argsort(h, kind="stable")
            self.tables.append((walk_seed, picks, h[order], np.array(members)[order]))
            missed &= hashes(test, picks) != h[of]
        self.recall = 1.0 if self.pieces else 1 - float(missed.mean())

    def cut(self, items: list[list[int]]) -> None:
        """One piece more than the edits allowed of each item: an edit touches one of them, so one stands unchanged."""
        seeds: dict[int, list[tuple[int, int]]] = {}
        for i in self.members:
            n = len(items[i]) // (self.edits + 1)
            for k in range(self.edits + 1):
                seeds.setdefault(n, []).append((i, k * n))
        for n, found in seeds.items():
            h = hashes(np.array([items[i][a:a + n] for i, a in found], np.int64).reshape(len(found), n), np.arange(n))
            order = np.argsort(h, kind="stable")
            of = np.array(found)[order]
            self.pieces[n] = h[order], of[:, 0], of[:, 1]

    def lay_out(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Sequences end to end with a walk's length of -1 after each, and where they start."""
        gap = [-1] * self.steps
        size = np.array([len(x) + self.steps for x in lists])
        return np.array([w for x in lists for w in (*x, *gap)], np.int32), np.cumsum(size) - size


class Benchmark:
    """Items of one slice: word numbers, classes by length and the words each class holds."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float, min_words: int, bits: int, recall: float, seed: int = 11):
        lists = [(k, words_of(t)) for k, t in rows]
        lists = [(k, x) for k, x in lists if x]
        self.ids = [k for k, _ in lists]
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for _, x in lists for w in x), 1)}
        self.items = [[self.vocab[w] for w in x] for _, x in lists]
        self.limit = [allowed(len(x), similarity, min_words) for x in self.items]
        groups: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            size = 1
            while (nxt := max(size + 1, int(size * STEP))) <= len(x):
                size = nxt
            groups.setdefault(size if self.limit[i] else len(x), []).append(i)
        self.classes = [LengthClass(n, m, self.items, max(self.limit[i] for i in m), bits, recall, seed + n)
                        for n, m in sorted(groups.items())]
        self.has = np.zeros((len(self.classes), len(self.vocab) + 1), bool)
        for c, k in enumerate(self.classes):
            self.has[c, [w for i in k.members for w in self.items[i]]] = True
        self.gap = max([k.size for k in self.classes], default=1)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text index, item index, edits, first word, end word) of each best match."""
        get, parts, sizes = self.vocab.get, [], []
        for t in texts:
            x = [get(w, 0) for w in words_of(t)]
            parts.append(np.array(x, np.int32))
            sizes.append(len(x))
        gap = np.zeros(self.gap, np.int32)
        seq = np.concatenate([y for x in parts for y in (x, gap)] or [gap])
        if not seq.any():
            return []
        first = np.r_[0, np.cumsum(np.array(sizes) + self.gap)]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for c, k in enumerate(self.classes):
            if len(seq) < k.size:
                continue
            if k.pieces:
                self.verify(self.meet(k, seq), seq, first, sizes, found)
                continue
            inside = np.r_[0, np.cumsum(self.has[c][seq], dtype=np.int32)]
            starts = np.flatnonzero(inside[k.size:] - inside[:-k.size] >= k.size - k.edits)
            for at in range(0, len(starts), 50_000):
                self.probe(k, seq, starts[at:at + 50_000], first, sizes, found)
        return [(t, i, *m) for (t, i), m in found.items()]

    def meet(self, k: LengthClass, seq) -> set[tuple[int, int]]:
        """(where the item would begin, item) for every piece of an item that stands in the texts."""
        pairs = set()
        for n, (table, members, places) in k.pieces.items():
            if n and len(seq) >= n:
                h = hashes(np.lib.stride_tricks.sliding_window_view(seq, n), np.arange(n))
                lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
                for s in np.flatnonzero(hi > lo):
                    pairs.update((max(0, int(s - places[j])), int(members[j])) for j in range(lo[s], hi[s]))
        return pairs

    def probe(self, k: LengthClass, seq, starts, first, sizes, found) -> None:
        pairs, embedded, walked = set(), None, None
        for walk_seed, picks, table, members in k.tables:
            if walked != walk_seed:
                embedded, walked = walk(seq, starts, k.steps, walk_seed), walk_seed
            h = hashes(embedded, picks)
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            for s in np.flatnonzero(hi > lo):
                pairs.update((int(starts[s]), int(i)) for i in members[lo[s]:hi[s]])
        self.verify(pairs, seq, first, sizes, found)

    def verify(self, pairs, seq, first, sizes, found) -> None:
        done: dict[int, int] = {}
        for p, i in sorted(pairs):
            if p < done.get(i, -1):
                continue
            text = int(np.searchsorted(first, p, "right") - 1)
            edits, m = self.limit[i], len(self.items[i])
            a = max(int(first[text]), p - edits - 1)
            z = min(int(first[text]) + sizes[text], p + m + edits + 1)
            near = seq[a:z].tolist()
            held = set(near)
            if sum(w in held for w in self.items[i]) < m - edits:  # each edit can change one word of the item only
                continue
            d, s, e = best_stretch(self.items[i], near)
            if d <= edits:
                place = (d, a + s - int(first[text]), a + e - int(first[text]))
                old = found.get((text, i))
                found[(text, i)] = place if old is None else min(old, place)
                done[i] = a + s + 1


def _slices(benchmark: DataFrame, slice_items: int):
    """Distinct items with an id and a text, a bounded slice at a time, in order of (item_id, text)."""
    items = settle(benchmark.select("item_id", "text").filter(C("item_id").isNotNull() & C("text").isNotNull()).distinct(), "benchmark")
    last = None
    while True:
        after = items if last is None else items.filter((C("item_id") > last[0]) | (C("item_id") == last[0]) & (C("text") > last[1]))
        part = [(r["item_id"], r["text"]) for r in after.orderBy("item_id", "text").limit(slice_items).collect()]
        if not part:
            return
        yield part
        last = part[-1]


def recalls(benchmark: DataFrame, *, similarity: float = 0.8, min_words: int = 5, bits: int = 3, recall: float = 0.98,
            slice_items: int = 5000) -> list[tuple[int, int, int, float]]:
    """(words, items, tables, recall on edited copies) of every length class; no tables: searched exactly."""
    return [(k.size, len(k.members), len(k.tables), k.recall) for rows in _slices(benchmark, slice_items)
            for k in Benchmark(rows, similarity, min_words, bits, recall).classes]


def _fitted(docs: DataFrame, benchmark: DataFrame, similarity, min_words, bits, recall, slice_items):
    for rows in _slices(benchmark, slice_items):
        yield docs.sparkSession.sparkContext.broadcast(Benchmark(rows, similarity, min_words, bits, recall))


def matches(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, min_words: int = 5, bits: int = 3,
            recall: float = 0.98, slice_items: int = 5000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document row and item it holds: carried columns, item_id, edits, similarity, start, stop (words)."""
    src = docs.select(*carry, "text")
    n = len(carry)
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carry),
                        "item_id long, edits int, similarity double, start long, stop long"])

    def scan(sent) -> DataFrame:
        def apply(batches):
            b = sent.value
            for batch in batches:
                for t in slices(batch, n):
                    got = b.matches(t.column(n).to_pylist())
                    rows = pa.array([g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(t.column(c).take(rows) for c in range(n)), pa.array([b.ids[g[1]] for g in got], pa.int64()),
                         pa.array([g[2] for g in got], pa.int32()), pa.array([1 - g[2] / len(b.items[g[1]]) for g in got], pa.float64()),
                         pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())],
                        names=[*carry, "item_id", "edits", "similarity", "start", "stop"])

        return src.mapInArrow(apply, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for k, sent in enumerate(_fitted(docs, benchmark, similarity, min_words, bits, recall, slice_items)):
        out = out.unionByName(scan(sent)) if k else scan(sent)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, min_words: int = 5, bits: int = 3,
                    recall: float = 0.98, slice_items: int = 5000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle."""
    at_text, out = docs.columns.index("text"), docs

    def scan(df: DataFrame, sent) -> DataFrame:
        def apply(batches):
            b = sent.value
            for batch in batches:
                for t in slices(batch, at_text):
                    keep = np.ones(t.num_rows, bool)
                    keep[[g[0] for g in b.matches(t.column(at_text).to_pylist())]] = False
                    yield t.filter(pa.array(keep))

        return df.mapInArrow(apply, df.schema)

    for sent in _fitted(docs, benchmark, similarity, min_words, bits, recall, slice_items):
        out = scan(out, sent)
    return out
