"""Neighbour search, detectors and shared-attribute edges against brute force, with hot groups."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.anomaly import detectors, knn
from fraudloom.catalog import anomaly
from fraudloom.functions import email_tokens
from fraudloom.operators import encode, graph, relational as rel, skew

C = F.col


def _vectors(spark, n=260, d=4, seed=2):
    """A third of all rows are copies of one vector."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)).round(3)
    x[: n // 3] = x[0]
    rows = [(i * 7 % 1009, "w1" if i % 4 else "w2", x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, window string, vec array<double>"), rows


def _brute(rows, k, donors=None):
    want = {}
    for i, w, v in rows:
        cand = [(float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), j) for j, w2, u in (donors or rows)
                if w2 == w and (donors or j != i)]
        want[i] = sorted(cand)[:k]
    return want


@pytest.mark.parametrize("block", [16, 1024])
def test_knn_is_exact_with_copies(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    df, rows = _vectors(spark)
    got = {}
    for r in knn.knn_table(df, 5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.dist, r.nbr))
    want = _brute(rows, 5)
    assert {i: [n for _, n in v] for i, v in got.items()} == {i: [n for _, n in v] for i, v in want.items()}
    assert all(np.allclose([a for a, _ in got[i]], [a for a, _ in want[i]]) for i in want)


def test_knn_pruning_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 8)
    rnd = np.random.default_rng(0)
    rows = [(i, "w", (rnd.normal(size=3) * 0.1 + 100 * (i % 12)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, window string, vec array<double>")
    got = {}
    for r in knn.knn_table(df, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.nbr)
    assert got == {i: [n for _, n in v] for i, v in _brute(rows, 3).items()}


def test_few_block_pairs_are_compared_on_clusters(spark):
    rnd = np.random.default_rng(3)
    at = rnd.normal(size=(64, 8)) * 100
    rows = [(i, "w" if i % 8 else "v", (at[i % 64] + rnd.normal(size=8)).tolist()) for i in range(6400)]
    df = spark.createDataFrame(rows, "id bigint, window string, vec array<double>")
    pivots = knn._pivots(df, 42)
    sent = spark.sparkContext.broadcast(pivots)
    blocks = knn.settle(knn._blocks(knn._assign(knn._distinct(df, 5), sent)), "test-blocks")
    size = {(r["window"], r["cell"], r["sub"]): r["cnt"] for r in blocks.select("window", "cell", "sub", "cnt").collect()}
    pairs = knn.block_pairs(blocks, blocks, 6, sent).collect()
    compared = sum(size[p["window"], p["l_cell"], p["l_sub"]] * size[p["window"], p["r_cell"], p["r_sub"]] for p in pairs)
    assert len(pivots.points) > 15 and pivots.tops > 3
    assert compared < 0.15 * sum(v * sum(u for l, u in size.items() if l[0] == k[0]) for k, v in size.items())
    got = {}
    for r in knn.knn_table(df, 5).where("id < 40").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["nbr"])
    assert len(got) == 40 and all(
        got[i] == [n for _, n in sorted((float(np.linalg.norm(np.subtract(rows[i][2], u))), j) for j, w, u in rows if w == rows[i][1] and j != i)[:5]] for i in got)


def test_impute_knn(spark):
    rows = [(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 50.0, 99.0), (4, 0.4, None)]
    df = spark.createDataFrame(rows, "k bigint, x double, t double")
    got = {r.k: r.t for r in knn.impute_knn(df, "k", "t", ["x"], 2).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 99.0, 4: 15.0}


def test_detectors_find_the_outlier(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, "w", rnd.normal(size=3).tolist()) for i in range(300)] + [(999, "w", [9.0, -9.0, 9.0])]
    df = spark.createDataFrame(rows, "id bigint, window string, vec array<double>").persist()
    nbrs = knn.knn_table(df, 10)
    for scores in (detectors.outlier_hbos(df), detectors.outlier_knn(nbrs, 10), detectors.outlier_lof(nbrs, 10),
                   detectors.outlier_pca(df, (3,)), detectors.outlier_iforest(df, trees=32)):
        top = scores.orderBy(C("raw").desc()).first()
        assert top.id == 999, top
        p = detectors.detector_probability(scores).agg(F.min("proba"), F.max("proba"), F.count("*")).first()
        assert tuple(p) == (0.0, 1.0, 301)


def test_pca_matches_numpy(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(120, 5)) @ rnd.normal(size=(5, 5))
    df = spark.createDataFrame([(i, "w", r.tolist()) for i, r in enumerate(x)], "id bigint, window string, vec array<double>")
    got = np.array([r.vec for r in detectors.pca_reduce(df, 2).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    _, vec = np.linalg.eigh(c.T @ c / len(x))
    want = c @ vec[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_iforest_is_repeatable(spark):
    df, _ = _vectors(spark)
    a = {r.id: r.raw for r in detectors.outlier_iforest(df, trees=8).collect()}
    b = {r.id: r.raw for r in detectors.outlier_iforest(df.repartition(13), trees=8, shard_rows=40).collect()}
    assert a == b


@pytest.mark.parametrize("tile", [7, 4096])
def test_edges_keep_every_weight(spark, monkeypatch, tile):
    monkeypatch.setattr(graph, "TILE", tile)
    rnd = random.Random(8)
    rows = [(i, rnd.randint(0, 12), "hot" if rnd.random() < .4 else f"m{rnd.randint(0, 20)}",
             None if rnd.random() < .2 else f"d{rnd.randint(0, 15)}") for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, owner int, mail string, dev string")
    edges = graph.shared_attribute_edges(df, "id", "owner", ["mail", "dev"])
    values = {}
    for e in edges.collect():
        values.setdefault(e.via, []).append(e.id)
    owner = {r[0]: r[1] for r in rows}
    linear = Counter()
    for members in values.values():
        assert len({owner[i] for i in members}) > 1
        for a, b in itertools.permutations(members, 2):
            if owner[a] != owner[b]:
                linear[(a, b)] += 1
    pairs = graph.pair_weights(edges, df.where("id < 60"))
    got = Counter({(p.src, p.dst): p.weight for p in pairs.collect()})
    want = Counter()
    for a, b in itertools.permutations(rows, 2):
        if a[1] != b[1]:
            w = sum(x is not None and x == y for x, y in zip(a[2:], b[2:]))
            if w:
                want[(a[0], b[0])] = w
    assert linear == want
    assert got == Counter({p: w for p, w in want.items() if p[0] < 60})
    once = {(p.src, p.dst): p.weight for p in graph.graph_from_adjacency(pairs).collect()}
    assert once == {p: w for p, w in want.items() if p[0] < p[1] and min(p) < 60}


def test_token_vectors_are_summed_directions(spark):
    import hashlib
    import re

    emails = ["ann.lee@mail.com", "bob-x@mail.com", "x-y-z@mail.org", "x-y@mail.org", None, "", "alone"] + ["hot@mail.com"] * 40
    got = {r["token"]: r["vec"] for r in email_tokens.token_vectors(spark.createDataFrame([(e,) for e in emails], "email string"), "email", window=2).collect()}
    want = {}
    for e in emails:
        t = [x for x in re.split(r"[^\w.#]+", (e or "").lower()) if x]
        for i, x in enumerate(t):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if j != i:
                    signs = np.array([-1.0 if c < "8" else 1.0 for c in hashlib.md5(t[j].encode()).hexdigest()[:16]])
                    want[x] = want.get(x, 0) + signs
    assert set(got) == set(want) and "alone" not in got
    assert all(np.allclose(got[t], v / np.linalg.norm(v)) for t, v in want.items())


@pytest.mark.parametrize("rows", [3, 2048])
def test_busy_cells_are_dealt_without_loss(spark, monkeypatch, rows):
    monkeypatch.setattr(email_tokens, "CELL_ROWS", rows)
    rnd = np.random.default_rng(6)
    x = np.array([1.0, 0, 0, 0]) + rnd.normal(size=(60, 4)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(f"t{i:02d}", v.tolist()) for i, v in enumerate(x)], "token string, vec array<double>")
    got = {(r["a"], r["b"]) for r in email_tokens.similar_tokens(df, 0.99).collect()}
    assert got == {(f"t{i:02d}", f"t{j:02d}") for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= 0.99} and len(got) > 100


def test_copies_by_hash_follow_the_poisson_shares(spark):
    df = spark.range(20_000).select(C("id").alias("k"), (C("id") * 2).alias("v"))
    for rate in (0.2, 1.5):
        out = rel.sample_with_replacement(df, "k", rate)
        counts = Counter(r["k"] for r in out.collect())
        other = Counter(r["k"] for r in rel.sample_with_replacement(df.repartition(7), "k", rate).collect())
        assert counts == other and out.columns == ["k", "v"]
        for n in range(4):
            share = np.exp(-rate) * rate**n / [1, 1, 2, 6][n]
            assert abs(sum(counts[k] == n for k in range(20_000)) / 20_000 - share) < 0.012
    assert rel.sample_with_replacement(df, "k", 0.0).count() == 0


def test_similar_tokens_is_exact(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(80, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(f"t{i:02d}", r.tolist()) for i, r in enumerate(x)], "token string, vec array<double>")
    for cos in (0.3, 0.95):
        got = {(r.a, r.b) for r in email_tokens.similar_tokens(df, cos).collect()}
        want = {(f"t{i:02d}", f"t{j:02d}") for i in range(80) for j in range(i + 1, 80) if x[i] @ x[j] >= cos}
        assert got == want
    assert email_tokens.most_similar(df, "t00", 4).count() == 4


def test_join_stats_with_hot_and_null_keys(spark):
    rows = [(i, None if i % 5 == 0 else ("hot" if i % 3 == 0 else f"k{i}")) for i in range(6000)]
    df = spark.createDataFrame(rows, "id bigint, k string")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = Counter(k for _, k in rows)
    got = skew.join_stats(df, stats, ["k"]).collect()
    assert len(got) == len(rows) and all(r.n == want[r.k] for r in got)


def test_first_and_duplicated(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "z"), (5, "b", "q")]
    df = spark.createDataFrame(rows, "id bigint, e string, d string")
    assert {r.id for r in rel.duplicated_filter(df, "e", "d", "id").collect()} == {1, 2}
    assert {r.id for r in rel.first_occurrence(df, "e", "id").collect()} == {1, 3, 5}


def test_ordered_encoding_with_hot_level(spark):
    rnd = random.Random(6)
    rows = [(i, "hot" if i % 3 else f"l{i % 7}", rnd.randint(0, 40), int(rnd.random() < .3)) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, l string, h int, y int").selectExpr(
        "id", "l", "y", "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts")
    got = {r.id: r.code for r in encode.ordered_target_encode(df, "l", "y", "ts", "id", "code").collect()}
    prior = sum(r[3] for r in rows) / len(rows)
    for level in {r[1] for r in rows}:
        s = n = 0
        for r in sorted((r for r in rows if r[1] == level), key=lambda r: (r[2], r[0])):
            assert got[r[0]] == pytest.approx((s + prior) / (n + 1))
            s, n = s + r[3], n + 1


def test_lscp_takes_neighbours_whose_scores_do_not_vary(spark):
    # copies have equal scores: a correlation is not defined there
    scores = spark.createDataFrame([("w", i, d, 1.0 if i < 4 else float(i * k)) for i in range(6) for k, d in ((1, "a"), (-2, "b"))],
                                   "window string, id long, detector string, raw double")
    nbrs = spark.createDataFrame([("w", i, j, 1.0, j + 1) for i in range(6) for j in range(4)], "window string, id long, nbr long, dist double, rank int")
    out = detectors.outlier_lscp(scores, nbrs, 4, "lscp").collect()
    assert sorted(r["id"] for r in out) == list(range(6))


def test_blocks_are_sent_to_units_and_not_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "w", v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "id long, window string, vec array<double>")
    sent = spark.sparkContext.broadcast(knn._pivots(df, 42))
    blocks = knn.settle(knn._blocks(knn._assign(knn._distinct(df, 5), sent)), "test-blocks")
    pairs = knn.block_pairs(blocks, blocks, 6, sent)
    assert knn._dealt(blocks, blocks, pairs).count() * 3 < pairs.count()


def test_path_lengths_are_those_of_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[5] = np.nan
    nodes = detectors._grow(x[10:], rng, 8, np.arange(3))
    f, cut, left, right, size = (np.asarray(z) for z in zip(*nodes))
    wanted = []
    for row in x:
        at = steps = 0
        while f[at] >= 0:
            at, steps = (left if row[f[at]] < cut[at] else right)[at], steps + 1
        wanted.append(steps + float(detectors._average_path(size[at])))
    got = detectors._path_lengths(x.ravel(), np.arange(len(x)) * 3, f, cut, left, right, size)
    assert got.tolist() == pytest.approx(wanted, abs=1e-12)


@pytest.mark.parametrize("slots", [8, 1])
def test_pairs_are_weighed_where_they_meet(spark, monkeypatch, slots):
    monkeypatch.setattr(graph, "TILE", 16)
    monkeypatch.setattr(graph, "SLOTS", slots)
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(9), f"a{rnd.randrange(4)}", f"b{rnd.randrange(30)}", f"c{rnd.randrange(5)}") for i in range(120)]
    rows += rows[5:25] + [(30, 77, "a1", "b2", "c3"), (40, None, "a1", "b2", "c3"), (None, 3, "a1", "b1", None), (None, 4, "a2", "b1", "c1")]
    df = spark.createDataFrame(rows, "id bigint, owner int, x string, y string, z string")
    listed = df.where("id % 4 = 0").select("id")
    edges = graph.shared_attribute_edges(df, "id", "owner", ["x", "y", "z"])
    want = Counter()
    for a, b in itertools.product(rows, rows):
        if a[0] is not None and a[0] % 4 == 0 and None not in (a[1], b[1]) and a[1] != b[1]:
            want[(a[0], b[0])] += sum(u is not None and u == v for u, v in zip(a[2:], b[2:]))
    want = {p: w for p, w in want.items() if w}
    pairs = graph.pair_weights(edges, listed)
    got = [((p.src, p.dst), p.weight) for p in pairs.collect()]
    assert len(got) == len(want) and dict(got) == want
    undirected = {(a, a, w) if b is None else (min(a, b), max(a, b), w) for (a, b), w in want.items()}
    once = [tuple(p) for p in graph.graph_from_adjacency(pairs).collect()]
    assert len(once) == len(undirected) and set(once) == undirected
    names = {"x": F.col("x"), "y": F.col("y")}
    carried = graph.graph_from_adjacency(graph.pair_weights(edges, listed, graph.vertex_rows(df, "id", names)))
    both = [Counter(tuple(r) for r in graph.edge_attributes(e, df, "id", names).select("src", "dst", "weight", "src_x", "src_y", "dst_x", "dst_y").collect())
            for e in (carried, spark.createDataFrame(list(undirected), "src bigint, dst bigint, weight bigint"))]
    assert both[0] == both[1] and sum(both[0].values()) > len(undirected)


def test_plain_pairs_are_not_shuffled(spark):
    df = spark.range(3000).selectExpr("id", "id % 7 AS owner", "concat('p', id % 3) AS x", "concat('d', id % 50) AS y")
    names = {"x": F.col("x")}
    pairs = graph.pair_weights(graph.shared_attribute_edges(df, "id", "owner", ["x", "y"]), df.where("id % 20 = 0").select("id"), graph.vertex_rows(df, "id", names))
    out = graph.edge_attributes(graph.graph_from_adjacency(pairs), df, "id", names)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.index("Join Inner, ")
    assert "Aggregate" not in plan[:joins] and "RepartitionByExpression" not in plan[:joins] and plan.count("_a") and out.count() > 100_000


@pytest.mark.parametrize("slots", [8, 1])
def test_all_rows_are_paired_once(spark, monkeypatch, slots):
    monkeypatch.setattr(graph, "TILE", 16)
    monkeypatch.setattr(graph, "SLOTS", slots)
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(9), f"a{rnd.randrange(3)}", f"b{rnd.randrange(30)}") for i in range(90)]
    rows += rows[5:15] + [(30, 77, "a1", "b2"), (40, None, "a1", "b2"), (None, 3, "a1", "b1"), (None, 4, "a2", "b1")]
    df = spark.createDataFrame(rows, "id bigint, owner int, x string, y string")
    want = Counter()
    for a, b in itertools.product(rows, rows):
        if None not in (a[1], b[1]) and a[1] != b[1]:
            want[a[0], b[0]] += sum(u == v for u, v in zip(a[2:], b[2:]))
    undirected = {(*sorted(x for x in (a, b) if x is not None)[:1], max((x for x in (a, b) if x is not None), default=None), w)
                  if (a, b) != (None, None) else (None, None, w) for (a, b), w in want.items() if w}
    got = [tuple(p) for p in graph.graph_from_adjacency(graph.pair_weights(graph.shared_attribute_edges(df, "id", "owner", ["x", "y"]))).collect()]
    assert len(got) == len(undirected) and set(got) == undirected


def test_large_jobs_meet_in_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 4)
    df = spark.range(600).selectExpr("id", "id AS owner", "'p' AS x")
    want = 600 * 599 // 2
    for tiles in (1, 1 << 40):
        monkeypatch.setattr(graph, "TILES", tiles)
        assert graph.graph_from_adjacency(graph.pair_weights(graph.shared_attribute_edges(df, "id", "owner", ["x"]))).count() == want


def test_no_row_is_left_out_of_the_adjacency(spark, tmp_path):
    from datetime import datetime
    rows = [(i, datetime(2024, 1, 1, i), i, "view", 1.0, "same") for i in range(1, 6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(p) for p in anomaly.graph_from_adjacency(spark, str(tmp_path)).collect())
    assert got == [(a, b, 1) for a in range(1, 6) for b in range(a + 1, 6)]
