"""Exact k nearest neighbours per window, in bounded tasks.

Equal vectors are merged first and carry their smallest ids, so a group of
copies costs no more than one row. The distinct vectors are indexed by two
levels of pivots, whose number grows with the square root of the rows: a vector
goes to its nearest top pivot and then to the nearest pivot of that one's list,
and each (window, pivot) cell is cut into blocks of about BLOCK rows. The
triangle inequality prunes pairs of top cells first, then pairs of cells below
the surviving ones, then their blocks; no step has a window as its key. The
block pairs that are left are gathered into units of a tile of left blocks and a
part of the right blocks it has to meet, which pass by the tile one after the
other; a unit emits its best rows. The result is then handed to all copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..operators.skew import join_stats
from ..session import settle

C = F.col
BLOCK = 1024
#: left rows that a task holds, right rows that pass by them, and tasks that are made at most
TILE, PART, MOST_TASKS = 8192, 32_768, 4000
#: pivots are picked from a sample this many times as large
SAMPLE = 4


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(window, vec, id, ids, n): one row per distinct vector with its k+1 smallest ids, the first one as id."""
    # the row number is limited to k+1 inside each task before anything is shuffled
    by = Window.partitionBy("window", "vec").orderBy("id")
    small = rows.withColumn("_r", F.row_number().over(by)).where(C("_r") <= k + 1)
    ids = small.groupBy("window", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sizes = rows.groupBy("window", "vec").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(sizes, ["window", "vec"]).withColumn("id", C("ids")[0])


class Pivots:
    """Points; the first ones are the top level, each with the list of pivots nearest to it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.tops = math.ceil(math.sqrt(len(points)))
        of = ((points[:, None, :] - points[None, :self.tops, :]) ** 2).sum(axis=2).argmin(axis=1) if len(points) else []
        self.lists = [np.flatnonzero(of == t) for t in range(self.tops)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Top pivot, pivot and the distances to both. Any choice keeps results exact; near ones keep blocks small."""
        top = _nearest_point(x, self.points[:self.tops])
        cell = np.empty(len(x), dtype="int64")
        for t in np.unique(top):
            here = top == t
            cell[here] = self.lists[t][_nearest_point(x[here], self.points[self.lists[t]])]
        far = [np.sqrt(((x - self.points[at]) ** 2).sum(axis=1)) for at in (top, cell)]
        return top, cell, *far

    def gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[a] - self.points[b]) ** 2).sum(axis=1))


def _nearest_point(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points * points).sum(axis=1) - 2 * (x @ points.T)).argmin(axis=1)


def _pivots(rows: DataFrame, seed: int) -> Pivots:
    """As many vectors as the square root of the largest window, each the farthest from those before it in a sample in hash order."""
    largest = rows.groupBy("window").count().agg(F.max("count")).first()[0] or 0
    wanted = math.ceil(math.sqrt(largest))
    picked = rows.select("vec").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE * wanted).collect()
    x = np.array([r.vec for r in picked], dtype="float64")
    chosen, near = [0], np.full(len(x), np.inf)
    while len(chosen) < min(wanted, len(x)):
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return Pivots(x[chosen] if len(x) else x)


def _assign(rows: DataFrame, sent) -> DataFrame:
    """Adds top, cell and the distances to their pivots."""
    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                top, cell, tdist, pdist = sent.value.assign(np.vstack(pdf["vec"].to_numpy()).astype("float64"))
                pdf = pdf.assign(top=top.astype("int32"), cell=cell.astype("int32"), tdist=tdist, pdist=pdist)
                yield pdf[["id", "window", "vec", "ids", "top", "cell", "tdist", "pdist"]]

    return rows.select("id", "window", "vec", "ids").mapInPandas(
        nearest, "id bigint, window string, vec array<double>, ids array<bigint>, top int, cell int, tdist double, pdist double")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: ids and vectors end to end, radius, size in rows."""
    sizes = rows.groupBy("window", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("subs"))
    cut = rows.join(sizes, ["window", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), C("subs")))
    packed = cut.groupBy("window", "top", "cell", "subs", "sub").agg(
        F.collect_list(F.struct("id", "vec", "ids")).alias("m"), F.max("pdist").alias("radius"), F.max("tdist").alias("tradius"),
        F.count(F.lit(1)).alias("cnt"))
    return packed.select(
        "window", "top", "cell", "subs", "sub", "radius", "tradius", "cnt",
        F.transform("m", lambda x: x["id"]).alias("reps"),
        F.flatten(F.transform("m", lambda x: x["vec"])).alias("data"),
        F.transform("m", lambda x: F.size(x["ids"])).alias("sizes"),
        F.flatten(F.transform("m", lambda x: x["ids"])).alias("ids"))


def _side(blocks: DataFrame, level: str, side: str, radius: str) -> DataFrame:
    """Radius and size of every (window, top) or (window, cell)."""
    keys = ["top"] if level == "top" else ["top", "cell", "subs"]
    table = blocks.groupBy("window", *keys).agg(F.max(radius).alias("radius"), F.sum("cnt").alias("cnt"))
    return table.select("window", *[C(c).alias(f"{side}_{c}") for c in (*keys, "radius", "cnt")])


def _within_reach(pairs: DataFrame, level: str, take: int, sent) -> DataFrame:
    """Pairs of places where the left one may have neighbours; adds gap and reach.

    The nearest places, by the farthest that a row of each can lie, which hold ``take`` vectors together bound how far
    the neighbours of any left row are; a pair whose rows are all farther apart is dropped.
    """
    left, right = f"l_{level}", f"r_{level}"

    def gap(batches):
        for b in batches:
            at = [b.column(b.schema.get_field_index(c)).to_numpy() for c in (left, right)]
            yield b.append_column("gap", pa.array(sent.value.gaps(*at), pa.float64()))

    with_gap = pairs.mapInArrow(gap, T.StructType([*pairs.schema, T.StructField("gap", T.DoubleType())]))
    farthest = C("gap") + C("l_radius") + C("r_radius")
    nearest_first = Window.partitionBy("window", left).orderBy("_far", right).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = with_gap.withColumn("_far", farthest).withColumn("_held", F.sum("r_cnt").over(nearest_first))
    whole = Window.partitionBy("window", left)
    reach = F.min(F.when(C("_held") >= take, C("_far"))).over(whole)
    return (counted.withColumn("reach", reach).where(C("reach").isNull() | (C("gap") - C("l_radius") - C("r_radius") <= C("reach") * (1 + 1e-9)))
            .drop("_far", "_held"))


def block_pairs(left: DataFrame, right: DataFrame, take: int, sent) -> DataFrame:
    """(window, l_cell, l_sub, r_cell, r_sub) of the blocks that have to be compared; the tables of ``_blocks``."""
    tops = _side(left, "top", "l", "tradius").withColumn("r_top", F.explode(F.sequence(F.lit(0), F.lit(sent.value.tops - 1))))
    near_tops = _within_reach(tops.join(_side(right, "top", "r", "tradius"), ["window", "r_top"]), "top", take, sent)
    near_tops = settle(near_tops.select("window", "l_top", "r_top"), "near-tops")
    cells = (near_tops.join(_side(left, "cell", "l", "radius"), ["window", "l_top"])
             .join(_side(right, "cell", "r", "radius"), ["window", "r_top"]))
    near = _within_reach(cells, "cell", take, sent)
    near = (near.select("window", "l_cell", "r_cell", "gap", "reach", F.explode(F.sequence(F.lit(0).cast("long"), C("l_subs") - 1)).alias("l_sub"), "r_subs")
            .select("*", F.explode(F.sequence(F.lit(0).cast("long"), C("r_subs") - 1)).alias("r_sub")))
    radii = [t.select("window", C("cell").alias(f"{s}_cell"), C("sub").alias(f"{s}_sub"), C("radius").alias(f"{s}_r")) for s, t in (("l", left), ("r", right))]
    met = near.join(radii[0], ["window", "l_cell", "l_sub"]).join(radii[1], ["window", "r_cell", "r_sub"])
    met = met.where(C("reach").isNull() | (C("gap") - C("l_r") - C("r_r") <= C("reach") * (1 + 1e-9)))
    return settle(met.select("window", "l_cell", "l_sub", "r_cell", "r_sub"), "near-blocks")


def _best(i: np.ndarray, dist: np.ndarray, by: np.ndarray, take: int) -> np.ndarray:
    """Positions of the ``take`` smallest (dist, by) of each i, in order."""
    order = np.lexsort((by, dist, i))
    s = i[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    return order[rank < take]


def _nearest(a: np.ndarray, b: np.ndarray, take: int, step: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the ``take`` nearest rows of b to each row of a; ties by the row of b.

    A matrix product picks the candidates, with room for its rounding; their distances are then taken from the vectors.
    """
    sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    rough = sa[:, None] + sb - 2 * (a @ b.T)
    at = min(take, len(b)) - 1
    cut = np.partition(rough, at, axis=1)[:, at] + 1e-9 * (sa + sb.max())
    i, j = np.nonzero(~(rough > cut[:, None])) if at < len(b) - 1 else (x.ravel() for x in np.indices(rough.shape))
    dist = np.concatenate([np.sqrt(((b[j[s:s + step]] - a[i[s:s + step]]) ** 2).sum(axis=1)) for s in range(0, len(i), step)])
    best = _best(i, dist, j, take)
    return i[best], j[best], dist[best]


def _units(left: DataFrame, right: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The work, cut into units of a left tile and a part of its right blocks, and the tile of every left block.

    A tile is about TILE rows of blocks below one top pivot, a part about PART rows of the blocks that the tile has to
    meet. A row is a right block of a unit; ``wants`` lists the blocks of the tile that the right one is compared with. A block is sent once to each unit
    it takes part in instead of once to each of its pairs.
    """
    narrow = left.select("window", "top", "cell", "sub", "cnt")
    buckets = narrow.groupBy("window", "top").agg(F.ceil(F.sum("cnt") / TILE).alias("buckets"))
    tiles = narrow.join(buckets, ["window", "top"]).select(
        "window", "top", F.pmod(F.xxhash64("cell", "sub"), C("buckets")).alias("bucket"), C("cell").alias("l_cell"), C("sub").alias("l_sub"))
    tile = ["window", "top", "bucket"]
    met = keep.join(tiles, ["window", "l_cell", "l_sub"]).groupBy(*tile, "r_cell", "r_sub").agg(
        F.collect_list(F.struct("l_cell", "l_sub")).alias("wants"))
    sizes = right.select("window", C("cell").alias("r_cell"), C("sub").alias("r_sub"), "cnt")
    met = settle(met.join(sizes, ["window", "r_cell", "r_sub"]), "met-blocks")
    parts = met.groupBy(*tile).agg(F.ceil(F.sum("cnt") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("r_cell", "r_sub"), C("parts")).alias("part")
    return settle(met.join(parts, tile).select(*tile, part, "r_cell", "r_sub", "wants"), "units"), tiles


def _dealt(left: DataFrame, right: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of all units, each unit in one task, its left blocks first."""
    units, tiles = _units(left, right, keep)
    unit = ["window", "top", "bucket", "part"]
    heads = units.select(*unit).distinct()
    count = heads.count()
    no = F.array().cast("array<bigint>")
    ours = heads.join(tiles, unit[:3]).join(left.select("window", C("cell").alias("l_cell"), C("sub").alias("l_sub"), "reps", "data"), ["window", "l_cell", "l_sub"])
    ours = ours.select(*unit, C("l_cell").alias("cell"), C("l_sub").alias("sub"), "reps", "data", no.alias("sizes"), no.alias("ids"),
                       F.lit(None).cast(units.schema["wants"].dataType).alias("wants"))
    blocks = right.select("window", C("cell").alias("r_cell"), C("sub").alias("r_sub"), "reps", "data", C("sizes").cast("array<bigint>").alias("sizes"), "ids")
    theirs = units.join(blocks, ["window", "r_cell", "r_sub"]).select(
        *unit, C("r_cell").alias("cell"), C("r_sub").alias("sub"), "reps", "data", "sizes", "ids", "wants")
    both = ours.unionByName(theirs).repartition(max(1, min(count, MOST_TASKS)), *unit)
    return both.sortWithinPartitions(*unit, C("wants").isNotNull())


def _compare(take: int):
    """For every left vector of a unit, its ``take`` nearest member ids among the unit's right blocks.

    The left blocks of a unit are held, the right ones pass by; a left block keeps its best rows so far.
    """
    none = (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))

    def emit(window, tile, best):
        for at, (i, nbr, dist) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([window] * len(i), pa.string()), pa.array(tile[at][0][i]), pa.array(nbr), pa.array(dist)],
                                             names=["window", "rep", "nbr", "dist"])

    def run(batches):
        here, tile, best = None, {}, {}
        for batch in batches:
            small = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("window", "top", "bucket", "part", "cell", "sub", "wants")}
            reps_, data_, sizes_, ids_ = (batch.column(batch.schema.get_field_index(c)) for c in ("reps", "data", "sizes", "ids"))
            for r in range(batch.num_rows):
                key = tuple(small[c][r] for c in ("window", "top", "bucket", "part"))
                if key != here:
                    yield from emit(here and here[0], tile, best)
                    here, tile, best = key, {}, {}
                reps = reps_[r].values.to_numpy()
                data = data_[r].values.to_numpy().reshape(len(reps), -1)
                if small["wants"][r] is None:
                    tile[small["cell"][r], small["sub"][r]] = (reps.copy(), data.copy())
                    continue
                ids, sizes = ids_[r].values.to_numpy(), sizes_[r].values.to_numpy()
                order = np.argsort(reps, kind="stable")  # ties by smallest member id
                start, sizes, b = (np.cumsum(sizes) - sizes)[order], sizes[order], data[order]
                for want in small["wants"][r]:
                    at = want["l_cell"], want["l_sub"]
                    a = tile[at][1]
                    i, j, dist = _nearest(a, b, take)
                    had = best.get(at, none)
                    # a row that has its number already needs only what is no farther than its last one
                    if len(had[0]):
                        last, held = np.zeros(len(a)), np.bincount(had[0], minlength=len(a))
                        np.maximum.at(last, had[0], had[2])
                        ok = dist <= np.where(held >= take, last, np.inf)[i]
                        if not ok.any():
                            continue
                        i, j, dist = i[ok], j[ok], dist[ok]
                    n = sizes[j]
                    i, dist = np.repeat(i, n), np.repeat(dist, n)
                    nbr = ids[np.repeat(start[j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    i, nbr, dist = np.r_[had[0], i], np.r_[had[1], nbr], np.r_[had[2], dist]
                    top = _best(i, dist, nbr, take)
                    best[at] = i[top], nbr[top], dist[top]
        yield from emit(here and here[0], tile, best)
    return run


def knn_table(queries: DataFrame, k: int, donors: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(window, id, nbr, dist, rank): the k nearest rows of the same window, ties by id.

    Inputs have id BIGINT, window STRING, vec ARRAY<DOUBLE>. Without ``donors``
    neighbours come from the same table and a row is not its own neighbour.
    """
    skip_self = donors is None
    take = k + 1 if skip_self else k
    left_rows = queries.select("id", "window", "vec")
    # each step is written once: later steps read files instead of repeating it, also after a lost executor
    left_set = settle(_distinct(left_rows, k), "distinct")
    right_set = left_set if skip_self else settle(_distinct(donors.select("id", "window", "vec"), k), "distinct")
    pivots = _pivots(right_set, seed)
    if not len(pivots.points):
        return left_rows.select("window", "id", F.lit(None).cast("bigint").alias("nbr"),
                                F.lit(None).cast("double").alias("dist"), F.lit(1).alias("rank")).where(F.lit(False))
    sent = queries.sparkSession.sparkContext.broadcast(pivots)
    right = settle(_blocks(_assign(right_set, sent)), "blocks")
    left = right if skip_self else settle(_blocks(_assign(left_set, sent)), "blocks")
    keep = block_pairs(left, right, take, sent)
    found = _dealt(left, right, keep).mapInArrow(_compare(take), "window string, rep bigint, nbr bigint, dist double")
    best = Window.partitionBy("window", "rep").orderBy("dist", "nbr")
    top = found.withColumn("_r", F.row_number().over(best)).where(C("_r") <= take)
    lists = settle(top.groupBy("window", "rep").agg(F.array_sort(F.collect_list(F.struct("dist", "nbr"))).alias("nb")), "nearest")
    # hand the list to every copy of the vector
    known = left_set.select("window", "vec", C("id").alias("rep"), "n").join(lists, ["window", "rep"]).drop("rep")
    members = join_stats(left_rows, known, ["window", "vec"], "n", nulls=False)
    own = F.filter("nb", lambda x: x["nbr"] != C("id")) if skip_self else C("nb")
    table = (members.select("window", "id", F.posexplode(F.slice(own, 1, k)).alias("_p", "_x"))
             .select("window", "id", C("_x.nbr").alias("nbr"), C("_x.dist").alias("dist"), (C("_p") + 1).alias("rank")))
    # the table feeds several later joins: written once instead of compared again
    return settle(table, "neighbours")


def impute_knn(df: DataFrame, key: str, target: str, features: list[str], k: int = 5) -> DataFrame:
    """Null targets take the mean target of the k nearest rows that have one (uniform weights, z-scored features)."""
    raw = settle(df.select(C(key).alias("id"), *[C(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], C(target).alias("_t")), "impute")
    at = [f"_f{i}" for i in range(len(features))]
    row = raw.agg(*[a(c).alias(f"{n}{c}") for c in at for n, a in (("m", F.avg), ("s", F.stddev_pop))]).first()  # two numbers a feature
    mean, dev = ([row[f"{n}{c}"] for c in at] for n in "ms")
    # a missing feature counts as the mean, which is 0 after scaling
    z = [F.coalesce(F.nanvl(C(c), F.lit(None).cast("double")) - F.lit(m), F.lit(0.0)) / F.lit(d or 1.0) for c, m, d in zip(at, mean, dev)]
    scaled = raw.select("id", F.lit("all").alias("window"), F.array(*z).alias("vec"), "_t")
    nbrs = knn_table(scaled.where(C("_t").isNull()), k, scaled.where(C("_t").isNotNull()))
    donors = nbrs.groupBy("nbr").agg(F.count(F.lit(1)).alias("_n")).join(
        df.select(C(key).alias("nbr"), C(target).alias("_t")), "nbr")
    fill = join_stats(nbrs, donors, ["nbr"], "_n", nulls=False).groupBy(C("id").alias(key)).agg(F.avg("_t").alias("_fill"))
    return df.join(fill, key, "left").withColumn(target, F.coalesce(C(target), C("_fill"))).drop("_fill")
