"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one per shard.

Equal vectors are one class that keeps its ``k + 1`` smallest ids, all that a result can show. Classes are banded by
length, each band holding lengths within a factor of two, so a long vector shares no graph with short ones; a band is
dealt by hash into shards of about ``shard_rows``. In a shard vectors are divided by the longest one, and a coordinate
is added that makes the largest inner product the nearest point; nodes are inserted in batches: a greedy search proposes neighbours, pruning keeps one only if no kept
neighbour is nearer to it by the factor ``alpha``, and links are made both ways and pruned again. Queries go through
every shard in blocks by beam search, are scored in double precision on the original vectors, and the best ``k`` over
all shards stay. Shards, blocks and graphs are bounded, and every row is indexed.

Defined results: vectors that are null, zero or hold null or non-finite parts, those of another length than the most
common one (the shorter, if tied), and rows without an id take no part. Repeated rows count once; ties go to the
smaller id. With fewer than ``k`` candidates all are returned; an empty table gives no rows. Finite vectors of any
length take part; a score beyond the range of doubles is infinite. Further columns, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

C = F.col


def beam(x: np.ndarray, links: np.ndarray, entry: np.ndarray, q: np.ndarray, width: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (-1: none) and squared distances of the ``width`` best nodes found for each query, best first."""
    m, norm = len(q), (x * x).sum(1)
    q2 = (q * q).sum(1)
    ids = np.full((m, width), -1, np.int32)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, len(x)), bool)
    new = np.tile(entry.astype(np.int32), (m, 1))
    rows = np.arange(m)
    while len(rows):
        r = rows[:, None]
        fresh = (new >= 0) & ~seen[r, new]
        seen[np.broadcast_to(r, new.shape)[fresh], new[fresh]] = True
        d = norm[new] - 2 * np.matmul(x[new], q[rows, :, None])[..., 0] + q2[rows, None]
        d[~fresh] = np.inf
        # the same node proposed twice in one step
        order = np.argsort(new, axis=1, kind="stable")
        twice = np.zeros(new.shape, bool)
        s = np.take_along_axis(new, order, 1)
        np.put_along_axis(twice, order, np.c_[np.zeros(len(new), bool), s[:, 1:] == s[:, :-1]], 1)
        d[twice] = np.inf
        all_d = np.concatenate([dist[rows], d], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        all_i = np.concatenate([ids[rows], new], 1)
        all_f = np.concatenate([done[rows], np.zeros(new.shape, bool)], 1)
        dist[rows] = np.take_along_axis(all_d, best, 1)
        got = np.take_along_axis(all_i, best, 1)
        got[np.isinf(dist[rows])] = -1
        ids[rows] = got
        done[rows] = np.take_along_axis(all_f, best, 1) | (got < 0)
        open_ = ~done[rows]
        rows = rows[open_.any(1)]
        if not len(rows):
            break
        todo = np.argsort(done[rows], axis=1, kind="stable")[:, :wide]
        ok = ~np.take_along_axis(done[rows], todo, 1)
        node = np.where(ok, np.take_along_axis(ids[rows], todo, 1), 0)
        flags = done[rows]
        np.put_along_axis(flags, todo, True, 1)
        done[rows] = flags
        new = np.where(ok[:, :, None], links[node], -1).reshape(len(rows), -1)
    return ids, dist


def prune(x: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of the nodes ``at`` from candidates (-1: none)."""
    cand = np.where(cand == at[:, None], -1, cand)
    s = np.sort(cand, 1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
    v = x[s]
    d = ((v - x[at][:, None]) ** 2).sum(2)
    d[s < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")[:, : max(2 * degree, 64)]
    s, d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
    v = x[s]
    sq = (v * v).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, out, rows = ~np.isinf(d), np.full((len(at), degree), -1, np.int32), np.arange(len(at))
    for k in range(degree):
        pick = alive.argmax(1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        out[ok, k] = s[rows, pick][ok]
        alive &= ~(ok[:, None] & (alpha * alpha * between[rows, pick] <= d))
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, *, degree: int = 32, width: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Graph over the points x: neighbour lists (-1: none) and entry nodes from which every node can be reached."""
    n = len(x)
    links = np.full((n, degree), -1, np.int32)
    entry = np.array([int(((x - x.mean(0)) ** 2).sum(1).argmin())])
    if n <= degree + 1:
        for i in range(n):
            links[i, : n - 1] = np.delete(np.arange(n), i)
        return links, entry
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry[0]]]
    size, at = degree + 1, 0
    while at < n:
        new = order[at:at + size]
        if at == 0:
            cand = np.tile(new, (len(new), 1))
        else:
            cand = np.concatenate([beam(x, links, entry, x[new], width)[0], np.tile(new, (len(new), 1))[:, :0]], 1)
        links[new] = prune(x, new, cand, degree, alpha)
        src, dst = np.repeat(new, degree), links[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            at += len(new)
            continue
        near = ((x[src] - x[dst]) ** 2).sum(1)
        o = np.lexsort((near, dst))
        src, dst = src[o], dst[o]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        nodes, count = dst[first], np.diff(np.r_[first, len(dst)])
        wide = min(int(count.max()), 2 * degree)  # of very many back links only the nearest can survive pruning
        rank = np.arange(len(dst)) - np.repeat(first, count)
        extra = np.full((len(nodes), wide), -1, np.int32)
        ok = rank < wide
        extra[np.repeat(np.arange(len(nodes)), count)[ok], rank[ok]] = src[ok]
        links[nodes] = prune(x, nodes, np.concatenate([links[nodes], extra], 1), degree, alpha)
        at += len(new)
        size = min(batch, max(degree + 1, at))
    reached, front = np.zeros(n, bool), entry
    entries = list(entry)
    while True:
        reached[front] = True
        while len(front):
            nxt = np.unique(links[front])
            front = nxt[(nxt >= 0)]
            front = front[~reached[front]]
            reached[front] = True
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return links, np.array(entries)
        entries.append(int(rest[0]))  # an island gets an entry of its own
        front = rest[:1]


def lengths(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths; squares of very large or small parts neither overflow nor vanish."""
    top = np.abs(v).max(1)
    return top * np.sqrt(((v / top[:, None]) ** 2).sum(1))


def lift(v: np.ndarray) -> np.ndarray:
    """Points whose nearest neighbours to (q, 0), q of length one, are the vectors with the largest inner product with q."""
    v = v / lengths(v).max()
    sq = (v * v).sum(1)
    return np.c_[v, np.sqrt(np.maximum(1 - sq, 0))].astype(np.float32)


def band(vector: str) -> Column:
    """Exponent to base two of the length of a vector: lengths of a band are within a factor of two."""
    def exponent(top: Column) -> Column:
        squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))
        return F.floor(F.log2(top) + F.log2(squares) / 2).cast("int")

    # as an element of an array the largest part is found once, not again for every part
    return F.transform(F.array(F.array_max(F.transform(vector, F.abs))), exponent)[0]


def valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, vectors as doubles."""
    v = C(vector).cast("array<double>")
    ok = (C(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
          & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    rows = df.filter(ok).select(C(id_col).cast("long").alias("id"), v.alias("vec"))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (size["n"] if size else 0))


def search(df: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding",
           shard_rows: int = 8192, block_rows: int = 32_768, degree: int = 32, width: int = 96) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    rows = settle(valid(df, id_col, vector), "ann-rows")
    few = F.row_number().over(Window.partitionBy("vec").orderBy("id")) <= k + 1
    classes = settle(rows.distinct().withColumn("_few", few).filter("_few").groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                     .withColumn("band", band("vec")), "ann-classes")
    sizes = classes.groupBy("band").count().orderBy("band").collect()  # as many as doubles have exponents, at most
    firsts, shards = [], 0
    for r in sizes:
        n = -(-r["count"] // shard_rows)
        firsts.append((r["band"], shards, n))
        shards += n
    bands = F.broadcast(df.sparkSession.createDataFrame(firsts, "band int, first int, n int"))

    def index(t: pa.Table) -> pa.Table:
        v = t.column("vec").combine_chunks().values.to_numpy().reshape(t.num_rows, -1)
        links, entry = build(lift(v), degree=degree)
        ids = t.column("ids").combine_chunks()
        return pa.table({"shard": t.column("shard").slice(0, 1), "vecs": pa.array([v.tobytes()], pa.binary()),
                         "links": pa.array([links.tobytes()], pa.binary()), "entry": pa.array([entry.astype("<i8").tobytes()], pa.binary()),
                         "ids": pa.array([ids.values.to_numpy().tobytes()], pa.binary()),
                         "sizes": pa.array([ids.value_lengths().to_numpy().astype("<i4").tobytes()], pa.binary())})

    dealt = classes.join(bands, "band").withColumn("shard", (C("first") + F.pmod(F.xxhash64("vec"), C("n"))).cast("int"))
    graphs = settle(dealt.select("shard", "vec", "ids").groupBy("shard").applyInArrow(index, "shard int, vecs binary, links binary, entry binary, ids binary, sizes binary"), "ann-graphs")
    queries = rows.filter(C("id") % every == 0).distinct()
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))
    sent = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            g = {c: right.column(c)[0].as_py() for c in ("vecs", "links", "entry", "ids", "sizes")}
            q = left.column("vec").combine_chunks().values.to_numpy().reshape(left.num_rows, -1)
            qid = left.column("id").to_numpy()
            v = np.frombuffer(g["vecs"]).reshape(-1, q.shape[1])
            x, links, entry = lift(v), np.frombuffer(g["links"], np.int32).reshape(len(v), -1), np.frombuffer(g["entry"], "<i8")
            ids, sizes = np.frombuffer(g["ids"], "<i8"), np.frombuffer(g["sizes"], "<i4").astype(np.int64)
            edge = np.cumsum(sizes) - sizes
            for at in range(0, len(q), 512):
                part = q[at:at + 512]
                unit = part / lengths(part)[:, None]
                node, _ = beam(x, links, entry, np.c_[unit, np.zeros(len(part))].astype(np.float32), width)
                score = np.where(node >= 0, np.einsum("mkd,md->mk", v[node], part), -np.inf)
                for r in range(len(part)):
                    near = np.argsort(-score[r], kind="stable")
                    near = near[score[r, near] > -np.inf]
                    if len(near) > k + 1:  # keep classes tied with the last that can matter
                        near = near[score[r, near] >= score[r, near[k]]]
                    c = node[r, near]
                    n = sizes[c]
                    where = np.repeat(edge[c] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    vec, s = ids[where], np.repeat(score[r, near], n)
                    ok = vec != qid[at + r]
                    vec, s = vec[ok], s[ok]
                    top = np.lexsort((vec, -s))[:k]
                    out["query_id"].append(np.full(len(top), qid[at + r]))
                    out["vec_id"].append(vec[top])
                    out["score"].append(s[top])
        flat = {c: np.concatenate([np.zeros(0, np.float64 if c == "score" else np.int64), *a]) for c, a in out.items()}
        return pa.table(flat)

    found = (asked.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
             .applyInArrow(find, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(C("rank") <= k).select("query_id", "rank", "vec_id", "score")
