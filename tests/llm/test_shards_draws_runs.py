"""Sharding, importance resampling and run detection against brute force, with odd rows and hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.llm import importance, runs, slot_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(rng, n=300):
    """Nulls, empty and long texts, ties and repeated rows; a third of the rows are one row."""
    words = [f"w{i}" for i in range(40)] + ["Ärger", "x-y", "B2", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), "en", "s", 1) for i in range(n)]
    rows += [(7, "the same row again and again " * 6, "en", "s", 0)] * (n // 2)
    rows += [(None, None, None, None, None), (None, "text of none", None, None, None), (n + 1, None, None, None, None),
             (n + 2, "", "en", "s", 0), (n + 3, " \t\n", "en", "s", 0), (n + 4, "long " * 60_000, "en", "s", 0), (5, "other text of id 5", "en", "s", 0)]
    return rows


def test_shards_law_places_and_growth(spark):
    rows = odd_rows(random.Random(1))
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("size", "shard", "virtual_slot", "_block", "copies")})
    out = slot_shards.shards(df).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert {r["law"] for r in out} == {"key"}
    held = {}
    for r in out:
        held.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values()) and set(held) <= set(range(16))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out) and any(r["grown_shard"] == 16 for r in out)
    owner = {}
    for r in out:
        if r["doc_id"] is not None:
            assert owner.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
            assert r["virtual_slot"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:3], 16)
    load = Counter()
    for r in out:
        load[r["virtual_slot"]] += r["size"]
    assert all(load[r["virtual_slot"]] == r["slot_bytes"] for r in out)
    few = slot_shards.shards(df.filter("doc_id in (1, 2, 3)")).collect()  # an id and the shard count decide, not the other rows
    assert {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in few} == {i: owner[i] for i in (1, 2, 3)}
    assert slot_shards.shards(df.filter("false")).count() == 0


def test_many_copies_of_a_row_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(slot_shards, "COPIES", 16)
    df = spark.createDataFrame([(i % 3, f"t{i % 3}", None, None, None) for i in range(300)], DOCS)
    out = slot_shards.shards(df, 2).collect()
    held = {}
    for r in out:
        held.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 300 and all(sorted(v) == list(range(len(v))) for v in held.values())


def test_maps_grow_evenly_and_only_into_the_new_shard(spark):
    slot_map = slot_shards.map_of(spark, 1)
    last = {r["virtual_slot"]: r["shard"] for r in slot_map.collect()}
    for n in range(2, 24):
        slot_map = slot_shards.map_of(spark, n) if n % 5 == 0 else slot_shards.grow(slot_shards.map_of(spark, n - 1))
        now = {r["virtual_slot"]: r["shard"] for r in slot_map.collect()}
        sizes = Counter(now.values())
        assert set(sizes) == set(range(n)) and max(sizes.values()) - min(sizes.values()) <= 1
        assert all(now[s] in (last[s], n - 1) for s in now)
        assert sorted((r["shard"], r["place"]) for r in slot_map.collect()) == [(s, p) for s in range(n) for p in range(sizes[s])]
        last = now


@pytest.mark.parametrize("shards", [None, 6])
def test_rebalance_evens_out_bytes(spark, shards):
    rng = random.Random(2)
    loads = spark.createDataFrame([(i, rng.randrange(1, 1000) * (20 if i % 4 == 1 else 1), 1) for i in range(4000)], "virtual_slot int, bytes long, rows long")
    old = slot_shards.count_slots(slot_shards.map_of(spark, 4), loads)
    new = slot_shards.rebalance(old, shards)
    n = shards or 4
    before, after = ({r["virtual_slot"]: r for r in m.collect()} for m in (old, new))
    assert len(after) == slot_shards.SLOTS and {r["version"] for r in after.values()} == {5} and {r["shards"] for r in after.values()} == {n}
    total = Counter()
    for r in after.values():
        total[r["shard"]] += r["bytes"]
    mean = sum(total.values()) / n
    assert set(total) == set(range(n)) and all(abs(v - mean) < 20_000 for v in total.values())
    spare = Counter()
    for r in before.values():
        spare[r["shard"]] += r["bytes"]
    moved = sum(r["bytes"] for s, r in after.items() if before[s]["shard"] != r["shard"])
    assert moved <= sum(max(0, v - mean) for v in spare.values()) + 20_000 * n
    empty = slot_shards.rebalance(slot_shards.map_of(spark, 4))  # nothing counted: nothing to move
    assert Counter(r["shard"] for r in empty.collect()) == Counter(r["shard"] for r in slot_shards.map_of(spark, 4).collect())


def test_shards_are_written_to_folders(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(random.Random(3), 60), DOCS).withColumn("shard", F.lit("clash"))
    slot_map = slot_shards.map_of(spark, 3)
    slot_shards.write_shards(df, slot_map, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count() and set(back.columns) == set(df.columns)
    where = {r["doc_id"]: r["shard"] for r in slot_shards.shards(df.drop("shard"), 3).collect()}
    assert all(where[r["doc_id"]] == r["shard"] for r in back.filter("doc_id is not null").collect())


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("segment_rows", [1 << 20, 16])
def test_resampling_equals_brute_force(spark, segment_rows):
    rows = odd_rows(random.Random(4))
    goal = [("w1 w2 w3 w4",), (None,), ("Ärger B2 text",), ("",)]
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(grams(text)[1])
    for text, in goal:
        t.update(grams(text)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    want, able = [], []
    for i, text, *_ in rows:
        n, f = grams(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = (i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))
        (able if n >= 20 else want).append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = 5 * len(able) // 100
    want = [(*r, None) for r in want] + [(*r, i + 1 if i < k else None) for i, r in enumerate(able)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("score", "weight", "rank", "_at")}).repartition(5)
    got = importance.resample(docs, spark.createDataFrame(goal, "text string"), segment_rows=segment_rows).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    empty = docs.filter("false")
    assert importance.resample(empty, empty).count() == 0
    assert importance.resample(docs.limit(30), empty).count() == 30


def test_parallel_sort_gives_exact_ranks_and_even_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(x)) for i, x in enumerate(rng.integers(-50, 50, 4000))] + [(9, 3)] * 2000 + [(None, 3)] * 5
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(6)
    got = sorted(map(tuple, importance.ranks(df, segment_rows=200).collect()), key=lambda r: r[2])
    assert [r[2] for r in got] == list(range(1, len(rows) + 1))
    assert [r[:2] for r in got] == sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    dealt = importance._runs(df)
    segments = importance._deal(dealt, importance._splitters(dealt, len(rows), 200)).groupBy("_segment").count().collect()
    assert len(segments) > 15 and max(r["count"] for r in segments) < 800  # the repeated row is not one segment
    top = [r for r in importance.ranks(df, keep=7, segment_rows=200).collect() if r["rank"]]
    assert sorted(r["rank"] for r in top) == list(range(1, 8))


def brute_runs(w):
    """Every run by its definition: for each period the stretches that keep it, if no smaller period keeps the stretch."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j - i + q
            if j > i and n >= max(12, 2 * q) and not any(all(w[x] == w[x + p] for x in range(s, s + n - p)) for p in range(1, q)):
                found.append((s, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def odd_texts(rng):
    texts = []
    for _ in range(300):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 6, 40])
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        if n > 20 and rng.random() < 0.4:
            a, p = rng.randrange(n // 2), rng.randrange(1, 9)
            w[a:] = (w[a:a + p] * n)[:n - a]
        texts.append(rng.choice([" ", "\t", "\n "]).join(w))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return texts + [" ".join(fib[-1]), "a " * 500, "x y " * 20, "", None, "one"]


def test_runs_equal_brute_force():
    rng = random.Random(6)
    texts = [(t or "").encode().split() for t in odd_texts(rng)]
    got = runs.runs_of(texts)
    assert got == [brute_runs(w) for w in texts] and sum(map(len, got)) > 200


def test_places_are_kept_in_order():
    rng = random.Random(7)
    xs = rng.sample(range(10_000), 3000)
    held = runs.Places(xs[0])
    for i, x in enumerate(xs[1:], 1):
        if i % 100 == 0:
            known = sorted(xs[:i])
            assert held.neighbours(x) == (max((y for y in known if y < x), default=-1), min((y for y in known if y > x), default=-1))
        held.add(x)
    assert list(held) == sorted(xs) and held.size == len(xs)


def test_run_digests_with_planted_repetitions(spark):
    rng = random.Random(8)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(odd_texts(rng))] + [(3, "again " * 30, "en", "s", 0)] * 150
    rows += [(None, "q " * 13, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("start", "n_runs", "runs")})
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        r = brute_runs(w)
        drop = {j for s, m, q in r for j in range(s + q, s + m)}
        top = min(r, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want[(i, len(r), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
              hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in r).encode()).hexdigest(),
              hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in drop).encode()).hexdigest())] += 1
    got = runs.digests(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert runs.digests(df.filter("false")).count() == 0
    cut = {r["doc_id"]: r for r in runs.find_runs(spark.createDataFrame([(1, "so ha ha ha ha ha ha ha ha ha ha ha ha ha end"), (2, None)], "doc_id long, text string")).collect()}
    assert cut[1]["collapsed"] == "so ha end" and [tuple(r) for r in cut[1]["runs"]] == [(1, 13, 1)] and cut[2]["collapsed"] == ""


def test_very_long_text_of_one_word_is_fast():
    assert runs.runs_of([[b"a"] * 200_000, [b"b", b"c"] * 50_000]) == [[(0, 200_000, 1)], [(0, 100_000, 2)]]
