"""Language model by context-tree weighting over bytes, each byte split into eight binary decisions.

Every context of 0 to ``depth`` bytes holds a binary tree of up to 255 nodes with Krichevsky-Trofimov estimates; a
node's weighted probability is half its own estimate and half the product of its longer contexts. The counts of the
training documents are fixed before anything is scored, so each next byte has one probability given its context.

A pack of documents asks for its distinct grams and words. Grams meet in buckets by the two nearest context bytes,
which hold whole subtrees of the context tree; the top two levels (at most 65,280 nodes) are summed over the buckets
and passed back. Two-byte contexts before more than 1/512 of all bytes are dealt by their third byte, and their own
nodes (at most 511 times 255) are summed over the buckets too. A bucket merges the sorted grams of its packs as it
reads them. Words meet in buckets by their hash. Nothing else passes through the driver.

Defined results: null texts count as empty. Text is lower-cased in A-Z and its words joined by one space; the model
then codes every byte and one end. Documents without an id are scored and never learned from. With no training text
every bit costs one bit, and the base is taken with counts of zero. Repeated rows are scored each on its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import bytegrams as bg
from .common import held_out, remainder, settle, text_bytes, unpack, write_packs

C = F.col
LN2 = float(np.log(2))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5, by Stirling's series at x + 8."""
    z = x + 8.0
    inv = 1 / z
    shift = np.ones_like(z)
    for j in range(8):
        shift = shift * (x + j)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv / 1260)) - np.log(shift)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - 1.1447298858494002


def leaves(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deepest nodes of sorted grams: (context << 8 | node, zeros, ones), sorted by key."""
    byte, ctx = code & 255, code >> 8 << 8
    keys, zero, one = [], [], []
    for j in range(8):
        bit, k = byte >> (7 - j) & 1, ctx | 1 << j | byte >> (8 - j)  # k ascends as the codes do
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        keys.append(k[at])
        zero.append(np.add.reduceat(np.where(bit == 0, count, 0), at) if len(k) else at)
        one.append(np.add.reduceat(np.where(bit == 1, count, 0), at) if len(k) else at)
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate(zero)[order].astype(float), np.concatenate(one)[order].astype(float)


def weigh(key: np.ndarray, zero: np.ndarray, one: np.ndarray, depth: int, top: int) -> dict[int, dict]:
    """Nodes of depths ``depth`` down to ``top`` of the context tree, with their weighted log probabilities."""
    levels = {depth: {"key": key, "zero": zero, "one": one, "lpw": kt(zero, one), "own": np.ones(len(key))}}
    for d in range(depth - 1, top - 1, -1):
        below = levels[d + 1]
        up, back = np.unique(below["key"] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        z, o, kids = (np.bincount(back, weights=below[x], minlength=len(up)) for x in ("zero", "one", "lpw"))
        below["up"] = back
        levels[d] = {"key": up} | _weighted(z, o, kids)
    return levels


def _weighted(zero, one, kids) -> dict:
    own = kt(zero, one)
    lpw = np.logaddexp(own, kids) - LN2
    return {"zero": zero, "one": one, "lpw": lpw, "own": np.exp(own - LN2 - lpw)}


def descend(level: dict, mass: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a one gathered so far, and the weight that longer contexts still hold."""
    p = (level["one"] + 0.5) / (level["zero"] + level["one"] + 1.0)
    return mass + left * level["own"] * p, left * (1 - level["own"])


def tops(rows, busy_rows) -> tuple[tuple, tuple]:
    """Gathered mass and left weight above the subtrees of a bucket, each as (keys, mass, left).

    The first holds depths 0 and 1 in 65,536 cells of (byte before << 8 | node); the second adds depth 2 for the
    nodes of busy contexts, which come in parts as their third byte deals them.
    """
    zero, one, kids = np.zeros(65536), np.zeros(65536), np.zeros(65536)
    for r in rows:
        zero[r["k"]], one[r["k"]], kids[r["k"]] = r["zero"], r["one"], r["kids"]
    busy_rows = sorted(busy_rows, key=lambda r: r["k"])
    key = np.array([r["k"] for r in busy_rows], np.int64)
    second = _weighted(*(np.array([r[x] for r in busy_rows], float) for x in ("zero", "one", "kids")))
    for cells, x in ((zero, "zero"), (one, "one"), (kids, "lpw")):
        np.add.at(cells, key & 0xFFFF, second[x])
    first = _weighted(zero, one, kids)
    root = _weighted(*(first[x].reshape(256, 256).sum(0) for x in ("zero", "one", "lpw")))
    mass, left = descend(root, np.zeros(256), np.ones(256))
    mass, left = descend(first, np.tile(mass, 256), np.tile(left, 256))
    return (np.arange(65536), mass, left), (key, *descend(second, mass[key & 0xFFFF], left[key & 0xFFFF]))


def gram_logs(code: np.ndarray, levels: dict[int, dict], depth: int, top: int, above: tuple) -> np.ndarray:
    """Log2 probability of the byte of each gram given its context; ``above`` holds what depths under ``top`` gathered."""
    node = levels[top]
    at = np.searchsorted(above[0], node["key"] & ((1 << 8 * top) - 1))
    m, l = above[1][at], above[2][at]
    for d in range(top, depth + 1):
        node = levels[d]
        if d > top:
            m, l = m[node["up"]], l[node["up"]]
        m, l = descend(node, m, l)
    p = np.clip(m + l / 2, 1e-300, 1 - 1e-16)
    byte, ctx, out = code & 255, code >> 8 << 8, np.zeros(len(code))
    for j in range(8):
        i = np.searchsorted(node["key"], ctx | 1 << j | byte >> (8 - j))
        out += np.log2(np.where(byte >> (7 - j) & 1, p[i], 1 - p[i]))
    return out


def _bucket_counts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a bucket and their counts; one pack at a time is unpacked."""
    return bg.merge((bg.unpack_keys(k.as_py()), bg.expand(c.as_py())) for k, c in zip(t.column("keys"), t.column("counts")))


def _words(t: pa.Table):
    asks = [zstandard.decompress(k).split(b" ") for k in t.column("keys").to_pylist()]
    seen: dict[bytes, int] = {}
    for ask, c in zip(asks, t.column("counts").to_pylist()):
        for w, n in zip(ask, bg.expand(c).tolist()):
            if n:
                seen[w] = seen.get(w, 0) + n
    return asks, seen


def score(docs: DataFrame, *, depth: int = 5, modulus: int = 7, rest: int = 2, bucket_bytes: int = 16 << 20,
          busy_share: int = 512) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    buckets = max(12, -(-text_bytes(docs) // bucket_bytes))
    n = depth + 1
    src = docs.select("doc_id", "text", held_out("doc_id", modulus, rest).alias("held_out"),
                      F.coalesce(remainder("doc_id", modulus) != rest, F.lit(False)).alias("_learn"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def token_lists(t: pa.Table) -> list[list[bytes]]:
        return [x.lower().split() for x in t.column("text").fill_null("").cast(pa.binary()).to_pylist()]

    def contexts(batches):
        for b in batches:
            n = bg.near_contexts(b" ".join(x) for x in token_lists(pa.Table.from_batches([b])))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["near", "n"])

    busy = np.zeros(65536, bool)
    if depth > 2:
        near = settle(src.select("text").mapInArrow(contexts, "near int, n long").groupBy("near").agg(F.sum("n").alias("n")), "ctw-near")
        all_bytes = near.agg(F.sum("n")).first()[0] or 0
        busy[[r["near"] for r in near.filter(C("n") > all_bytes / busy_share).collect()]] = True  # fewer than busy_share rows

    def word_buckets(words) -> list[list[bytes]]:
        parts: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in words:
            parts[zlib.crc32(w) % buckets].append(w)
        return parts

    def requests(t: pa.Table):
        lists, learn = token_lists(t), t.column("_learn").to_numpy()
        texts = [b" ".join(x) for x in lists]
        code, owner = bg.codes(texts, n)
        rest_code, rest_count = bg.tally(code[~learn[owner]])
        code, count = bg.tally(code)
        count[np.searchsorted(code, rest_code)] -= rest_count
        for b, k, c in bg.split(code, count, buckets, busy):
            yield "g", b, bg.pack_keys(k), bg.squeeze(c.astype("<i8"))
        words, rest_words = Counter(), Counter()
        for ws, f in zip(lists, learn):
            words.update(ws)
            if not f:
                rest_words.update(ws)
        for b, ws in enumerate(word_buckets(words)):
            if ws:
                c = np.array([words[w] - rest_words[w] if w in rest_words else words[w] for w in ws], "<i8")
                yield "w", b, zstandard.compress(b" ".join(ws), 3), bg.squeeze(c)
        yield "e", 0, b"", bg.squeeze(np.array([int(learn.sum())], "<i8"))

    packs, forget = write_packs(src, requests, "ctw-packs", buckets)
    asked = packs.filter(C("kind").isNotNull()).select("kind", "bucket", "pack", "keys", "counts")

    def subtrees(code, count):
        """(what its parts are called, depth of its highest nodes, which grams, their codes and counts)."""
        mine = busy[(code >> 8) & 0xFFFF]
        for what, top, at in (("g", 2, ~mine), ("b", 3, mine)):
            if at.any():
                yield what, top, at, code[at], count[at]

    def stats(key, t):
        kind, out = key[0].as_py(), []
        if kind == "g":
            for what, top, _, code, count in subtrees(*_bucket_counts(t)):
                nodes = weigh(*leaves(code, count), depth, top)[top]
                k, back = np.unique(nodes["key"] & ((1 << 8 * top) - 1), return_inverse=True)
                cells = [np.bincount(back, weights=nodes[x]) for x in ("zero", "one", "lpw")]
                out += [(what, int(a), *map(float, x)) for a, *x in zip(k, *cells)]
        elif kind == "w":
            seen = _words(t)[1]
            out = [("w", 0, float(sum(seen.values())), float(len(seen)), 0.0)]
        else:
            out = [("e", 0, float(sum(int(bg.expand(c)[0]) for c in t.column("counts").to_pylist())), 0.0, 0.0)]
        names = ("what", "k", "zero", "one", "kids")
        types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table({a: pa.array([r[i] for r in out], ty) for i, (a, ty) in enumerate(zip(names, types))})

    found = (asked.groupBy("kind", "bucket").applyInArrow(stats, "what string, k long, zero double, one double, kids double")
             .groupBy("what", "k").agg(*(F.sum(x).alias(x) for x in ("zero", "one", "kids"))).collect())  # at most 65,282 rows and 255 for each busy context
    above = dict(zip((2, 3), tops(*([r for r in found if r["what"] == x] for x in "gb"))))
    ends = int(sum(r["zero"] for r in found if r["what"] == "e"))
    total = int(sum(r["zero"] for r in found if r["what"] == "w")) + ends
    vocabulary = int(sum(r["one"] for r in found if r["what"] == "w")) + (ends > 0)

    def answer(key, t):
        if key[0].as_py() == "g":
            code, count = _bucket_counts(t)
            logs = np.zeros(len(code))
            for _, top, at, c, n in subtrees(code, count):
                logs[at] = gram_logs(c, weigh(*leaves(c, n), depth, top), depth, top, above[top])
            out = [bg.squeeze(logs[np.searchsorted(code, bg.unpack_keys(a.as_py()))].astype("<f4")) for a in t.column("keys")]
        else:
            asks, seen = _words(t)
            out = [bg.squeeze(np.array([seen.get(w, 0) for w in a], "<i8")) for a in asks]
        return pa.table({"pack": t.column("pack"), "kind": t.column("kind"), "bucket": t.column("bucket"),
                         "logs": pa.array(out, pa.binary())})

    replies = (asked.filter(C("kind") != "e").groupBy("kind", "bucket")
               .applyInArrow(answer, "pack long, kind string, bucket int, logs binary"))

    def finish(lt: pa.Table, rt: pa.Table) -> pa.Table:
        t = unpack(lt.column("blob")[0].as_py())
        lists = token_lists(t)
        texts = [b" ".join(x) for x in lists]
        got = list(zip(*(rt.column(c).to_pylist() for c in ("kind", "bucket", "logs"))))
        code, owner, k = bg.by_text(texts, n)
        first = np.r_[True, code[1:] != code[:-1]]
        lp = bg.join_answers(code[first], buckets, {b: bg.expand(x, "<f4") for a, b, x in got if a == "g"}, busy)
        score2 = np.bincount(owner, weights=k * lp[np.cumsum(first) - 1], minlength=len(texts))
        counts: dict[bytes, int] = {}
        mine = word_buckets(dict.fromkeys(chain.from_iterable(lists)))  # the order of the requests
        for a, b, x in got:
            if a == "w":
                counts.update(zip(mine[b], bg.expand(x).tolist()))
        flat = np.array(list(map(counts.__getitem__, chain.from_iterable(lists))), np.int64)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        doc = np.repeat(np.arange(len(lists)), size)
        unit = float(total) + (vocabulary + 1)
        base = (np.bincount(doc, weights=np.log10(flat + 1.0), minlength=len(lists)) + np.log10(ends + 1.0)
                - (size + 1) * np.log10(unit))
        known = np.bincount(doc, weights=flat > 0, minlength=len(lists)).astype(np.int64) + (ends > 0)
        width = np.array([len(x) + 1 for x in texts])
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(size + 1),
                         "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(lists), total, np.int64)),
                         "base_score": pa.array(base), "score": pa.array(score2 * np.log10(2)),
                         "bits_per_byte": pa.array(-score2 / width)})

    out = settle(
        packs.filter(C("blob").isNotNull()).select("pack", "blob").groupBy("pack").cogroup(replies.groupBy("pack"))
        .applyInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double, bits_per_byte double"), "ctw-scores")
    forget()
    return out
