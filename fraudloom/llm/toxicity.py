"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy in one task.

A word is the mean of the vectors of its character n-grams, a window of words the mean of its words, and a softmax
over two classes reads the window. Embeddings and softmax are learned together on a bounded sample of labelled rows
(``max_toxic``, ``max_clean``). A document is as toxic as its worst window, so a few words count in a text of any length (a
word repeated at once counts once); a
logistic fit on the sample turns that margin, with the number of windows, into the score.

Scoring reads each text once, in place: the linear head folds into one number per n-gram slot, a fixed table of
2^17 floats that is the only thing sent to the executors.

Defined results: null and empty texts hold no word and get the score of a document without any window, the share of
toxic rows among the empty ones smoothed towards zero. Labels that are null, or of unknown documents, are not used.
Without both classes in the sample all scores are the known share of toxic labels (0 if there are none). Rows without
an id are scored and never learned from. Repeated rows are scored each on its own.
"""

from __future__ import annotations

import pickle
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, remainder, settle

C = F.col
WORD = re.compile(r"\w+")
SLOTS, DIM, WINDOW = 1 << 17, 8, 16
#: Words a worker keeps the margins of.
CACHE = 400_000


def all_grams(words: list[str], block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of any number of words, a block at a time, with small integers."""
    parts = [grams(words[at:at + block]) for at in range(0, len(words), block)]
    size = np.concatenate([np.diff(e) for _, e in parts])
    return np.concatenate([s.astype(np.int32) for s, _ in parts]), np.r_[0, np.cumsum(size)]


def word_means(value: np.ndarray, slots: np.ndarray, edge: np.ndarray, block: int = 50_000) -> np.ndarray:
    """Mean of ``value`` over the slots of each word."""
    n = len(edge) - 1
    return np.concatenate([np.add.reduceat(value[slots[edge[a]:edge[min(a + block, n)]]], edge[a:min(a + block, n)] - edge[a])
                           for a in range(0, n, block)]) / np.diff(edge)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word's character n-grams (3 to 5, with its ends) and of the word itself; edges between words."""
    x = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    own, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    slots = [np.fromiter((zlib.crc32(w.encode()) & (SLOTS - 1) for w in words), np.int64, len(words))]
    owner, h = [np.arange(len(words))], x
    for n in range(2, 6):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1:]
        if n > 2:
            ok = left[:len(h)] >= n
            slots.append(((h[ok] ^ h[ok] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1))
            owner.append(own[:len(h)][ok])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(slots)[order], np.r_[0, np.cumsum(sum(np.bincount(o, minlength=len(words)) for o in owner))]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def no_repeats(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop each entry that equals the one before it in the same text, and count what is left per text."""
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    first = np.cumsum(n) - n
    keep[first[n > 0]] = True
    return flat[keep], np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``WINDOW`` words at every half window, over texts of n words laid end to end: start, end, text."""
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW // 2) // (WINDOW // 2))), 0)
    first = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
    text = np.repeat(np.arange(len(n)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + step * (WINDOW // 2)
    return start, np.minimum(start + WINDOW, first[text] + n[text]), text


def worst(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest window mean per text (-inf without words), and the number of windows."""
    start, end, text = windows(n)
    total = np.r_[0.0, np.cumsum(values)]
    mean = (total[end] - total[start]) / (end - start)
    out = np.full(len(n), -np.inf)
    np.maximum.at(out, text, mean)
    return out, np.bincount(text, minlength=len(n))


class Model:
    """Folded weights: one margin per slot, and the logistic map from margin and window count to a score."""

    def __init__(self, slot: np.ndarray, bias: float, map_: np.ndarray, empty: float):
        self.slot, self.bias, self.map, self.empty = slot.astype(np.float32), bias, map_, empty
        self.cache: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.slot, self.bias, self.map, self.empty)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list(set(chain.from_iterable(lists)).difference(self.cache))
        if new:
            self.cache.update(zip(new, word_means(self.slot.astype(float), *all_grams(new)).tolist()))
        out = np.array(list(map(self.cache.__getitem__, chain.from_iterable(lists))), float)
        m, k = worst(*no_repeats(out, n))
        z = self.map[0] * (np.where(k > 0, m, 0.0) + self.bias) + self.map[1] * np.log(np.maximum(k, 1)) + self.map[2]
        return np.where(k > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.empty)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return b


def train(texts: list[str | None], y: np.ndarray, share: float, *, epochs: int = 8, min_steps: int = 300,
          seed: int = 7) -> Model:
    """Fit on texts with labels y; ``share`` is the known share of toxic rows, which weighs the logistic map.

    A small sample is gone through more often, until there were about ``min_steps`` batches.
    """
    vocab: dict[str, int] = {}
    rows = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int64) for t in texts]
    flat, n = no_repeats(np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(x) for x in rows], np.int64))
    empty = float(np.sum(y[n == 0]) / (np.sum(n == 0) + 10))
    if not len(flat) or len(set(y[n > 0])) < 2:
        return Model(np.zeros(SLOTS), 0.0, np.array([0.0, 0.0, np.log((share + 1e-9) / (1 - share + 1e-9))]), share)
    slots, ptr = all_grams(list(vocab))
    del vocab, rows
    rng = np.random.default_rng(seed)
    emb, head, bias = rng.normal(0, 0.1, (SLOTS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    acc_e, acc_h, acc_b = np.full(SLOTS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    start, end, text = windows(n)
    first = np.searchsorted(text, np.arange(len(n) + 1))
    epochs = max(epochs, -(-min_steps * 256 // int(np.minimum(np.diff(first), 6).sum())))
    for epoch in range(epochs):
        if 4 * epoch < epochs:  # any windows: which are toxic isn't known yet
            pick = np.concatenate([rng.choice(np.arange(a, b), min(b - a, 6), replace=False) for a, b in zip(first, first[1:])])
        else:  # the worst window of every text, and some others of the clean ones
            v = word_means(emb @ (head[:, 1] - head[:, 0]), slots, ptr)
            total = np.r_[0.0, np.cumsum(v[flat])]
            mean = (total[end] - total[start]) / (end - start)
            order = np.lexsort((-mean, text))
            top = order[first[:-1][n > 0]]
            more = np.concatenate([rng.choice(np.arange(a, b), min(b - a, 2), replace=False)
                                   for a, b, t in zip(first, first[1:], y) if t == 0] or [top[:0]])
            pick = np.r_[top, more]
        rng.shuffle(pick)
        for at in range(0, len(pick), 256):
            w = pick[at:at + 256]
            size = end[w] - start[w]
            tokens = flat[np.repeat(start[w] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            own = np.repeat(np.arange(len(w)), size)
            uniq, back = np.unique(tokens, return_inverse=True)
            k = ptr[uniq + 1] - ptr[uniq]
            s = slots[np.repeat(ptr[uniq] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())]
            word = np.add.reduceat(emb[s], np.r_[0, np.cumsum(k)[:-1]]) / k[:, None]
            edge = np.r_[0, np.cumsum(size)[:-1]]
            x = np.add.reduceat(word[back], edge) / size[:, None]
            z = x @ head + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(w)), y[text[w]]] -= 1
            p /= len(w)
            gx, gh, gb = p @ head.T, x.T @ p, p.sum(0)
            gw = np.zeros_like(word)
            share_of = gx[own] / size[own][:, None]
            for d in range(DIM):
                gw[:, d] = np.bincount(back, share_of[:, d], minlength=len(uniq))
            gs = np.repeat(gw / k[:, None], k, axis=0)
            hit, hb = np.unique(s, return_inverse=True)
            g = np.stack([np.bincount(hb, gs[:, d], minlength=len(hit)) for d in range(DIM)], 1)
            acc_e[hit] += (g * g).mean(1)
            emb[hit] -= 0.3 * g / np.sqrt(acc_e[hit])[:, None]
            acc_h += gh * gh
            head -= 0.1 * gh / np.sqrt(acc_h)
            acc_b += gb * gb
            bias -= 0.1 * gb / np.sqrt(acc_b)
    slot = emb @ (head[:, 1] - head[:, 0])
    v = word_means(slot.astype(np.float32).astype(float), slots, ptr)
    m, k = worst(v[flat], n)
    b, ok = float(bias[1] - bias[0]), n > 0
    have = float(y[ok].mean())
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / have, (1 - share) / (1 - have))
    return Model(slot, b, logistic(np.c_[m[ok] + b, np.log(k[ok])], y[ok], weight[ok]), empty)


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 2000, max_clean: int = 4000, modulus: int = 5, rest: int = 0) -> Model:
    """Train on at most ``max_toxic`` and ``max_clean`` labelled rows, taken in hash order outside the held-out fold."""
    known = (labels.filter(C("toxic").isin(0, 1) & F.coalesce(remainder("doc_id", modulus) != rest, F.lit(False)))
             .select(C("doc_id").alias("_id"), C("toxic").alias("_y")).distinct())
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = [known.filter(C("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in ((0, max_clean), (1, max_toxic))]
    ids = F.broadcast(settle(picked[0].unionByName(picked[1]), "toxic-ids"))  # at most max_clean + max_toxic ids
    # an id may have several texts: all of them in one order, the same at every run, up to the bound
    rows = (docs.select("doc_id", "text").join(ids, C("doc_id") == C("_id")).select("text", "_y", "_id").distinct()
            .orderBy(F.xxhash64("_id"), "_id", "_y", F.xxhash64("text"), "text").limit(max_clean + max_toxic))
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0

    def learn(batches):
        held = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["_id"], r["_y"], r["text"] or ""))
        if held:
            model = train([r["text"] for r in held], np.array([r["_y"] for r in held], np.int64), share)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the bounded sample is learned from in one task: the driver gets the folded table of slots and holds no text
    found = settle(rows, "toxic-sample").select("text", "_y", "_id").coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, np.int64), share)


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns and ``toxicity``, for every row; no shuffle."""
    columns = list(dict.fromkeys([*carry, text]))
    src = docs.select(*columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                t = b.slice(at, 1000)
                s = m.scores(t.column(columns.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(t.column(columns.index(c)) for c in carry), pa.array(s, pa.float64())],
                                                 names=[*carry, "toxicity"])

    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carry), "toxicity double"])
    return src.mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, rest: int = 0, **fit_args) -> DataFrame:
    """doc_id, held_out, score and predicted, for every document."""
    out = score(docs, fit(docs, labels, modulus=modulus, rest=rest, **fit_args))
    return out.select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), C("toxicity").alias("score"),
                      (C("toxicity") >= 0.5).cast("int").alias("predicted"))
