"""Closed-form answers for text, date, geo and missing-value features."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fraudloom.functions import dates, geo, missing, text
from fraudloom.operators import encode, relational as rel

C = F.col


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(C("c"))).first()[0]


@pytest.mark.parametrize("raw,want", [("50% off+a%20b", "50% off+a b"), ("%41%zz", "A%zz"), (None, None), ("a+b", "a+b")])
def test_url_decode(spark, raw, want):
    assert one(spark, raw, text.url_decode) == want


def test_kv_expand(spark):
    df = spark.createDataFrame([("a=1&b=2=9&a=3&c&d=",), (None,)], "q string")
    a, b = text.kv_expand(df, "q", ["a", "b", "c", "d"], "").collect()
    assert tuple(a) == ("1, 3", "2", None, "") and tuple(b) == (None,) * 4


def test_json_named_keys(spark):
    df = spark.createDataFrame([("{'a': 1, 'b': 'x'}",), (None,), ("{'c': 2}",)], "j string")
    out = text.dirty_json_expand(df, "j", ["a", "c"], "p_")
    assert out.columns == ["j", "p_a", "p_c"]
    assert sorted((r.p_a or "", r.p_c or "") for r in out.collect()) == [("", ""), ("", "2"), ("1", "")]
    assert df.select(text.dirty_json_map(C("j")).alias("m")).collect()[0].m == {"a": "1", "b": "x"}


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
        prev = row
    return prev[-1]


def test_lcs_any_length(spark):
    rnd = random.Random(1)
    rows = [("kitten", "sitting"), ("", "a"), ("abc", "abc"), ("é𝄞x", "x𝄞é")]
    rows += [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 200))),
              "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 150)))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    for r in df.select("i", text.lcs_length(C("a"), C("b")).alias("n")).collect():
        assert r.n == lcs(*rows[r.i])


def test_match_scores(spark):
    rows = [("kitten", "SITTING"), (None, "a"), ("a", None), ("a", ""), ("", "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.s for r in text.match_scores(df, [("a", "b", "s")]).collect()]
    assert got == pytest.approx([8 / 13, -1, -1, -1, 0])
    got = [r.s for r in text.match_scores(df, [("a", "b", "s")], "gestalt").collect()]
    assert got == pytest.approx([SequenceMatcher(None, "kitten", "sitting").ratio(), -1, -1, -1, 0])


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.9, 1.0])
def test_candidate_join_is_exact(spark, threshold):
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 14))) for _ in range(60)}
    words |= {w[:-1] + "z" for w in list(words)[:20] if len(w) > 3}
    rows = [("hot" if i % 3 else "cold", w) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "b string, v string")
    got = {(r.b, r.x, r.y) for r in text.candidate_match_join(
        df.select("b", C("v").alias("x")), df.select("b", C("v").alias("y")), "b", "x", "y", threshold).collect()}
    want = {(p, x, y) for (p, x), (q, y) in itertools.product(rows, rows)
            if p == q and 2 * lcs(x, y) / (len(x) + len(y)) >= threshold - 1e-12}
    assert got == want


def test_holidays_2021(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2021-01-01', DATE'2021-12-31')) AS d")
    got = [r.d.strftime("%m-%d") for r in days.where(dates.is_holiday(C("d")) == 1).orderBy("d").collect()]
    assert got == ["01-01", "01-18", "02-15", "05-31", "06-18", "07-05", "09-06", "10-11", "11-11", "11-25", "12-24", "12-31"]


def test_weekday_features(spark):
    df = spark.sql("SELECT DATE'1970-01-01' AS d UNION ALL SELECT NULL")
    a, b = df.select(dates.day_of_week_name(C("d")), dates.is_weekend(C("d")), dates.is_holiday(C("d"))).collect()
    assert tuple(a) == ("Thurs", 0, 1) and tuple(b) == (None, None, None)


@pytest.mark.parametrize("raw,want", [("1 days 02:03:04.5", 93784.5), ("0 days 00:00:10", 10.0), (None, 0.0), ("3 days", 259200.0)])
def test_duration(spark, raw, want):
    assert one(spark, raw, dates.duration_seconds) == want


def test_days_since_is_elapsed_not_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-02 00:00:00' AS r, TIMESTAMP'2024-01-01 23:00:00' AS a, TIMESTAMP'2024-01-02 01:00:00' AS b")
    assert tuple(df.select(dates.days_since(C("r"), C("a")), dates.days_since(C("r"), C("b"))).first()) == (0, -1)


def test_haversine_pole_to_equator(spark):
    df = spark.sql("SELECT 90D a, 0D b, 0D c, 77D d")
    km = df.select(geo.haversine_km(*[C(x) for x in "abcd"])).first()[0]
    assert km == pytest.approx(6371.0088 * 3.141592653589793 / 2)


def test_twelve_distances():
    assert len({p[4] for p in geo.DISTANCE_PAIRS}) == 12


def test_erf(spark):
    import math
    for x in (-2.0, -0.3, 0.0, 0.5, 3.0):
        assert one(spark, x, geo.erf, "double") == pytest.approx(math.erf(x), abs=2e-7)


def test_match_status_and_merge(spark):
    df = spark.createDataFrame([(-1.0, "low", None), (-2.0, None, None), (None, "odd", "mid"), (4.0, "high", "mid")], "v double, a string, b string")
    got = df.select(missing.match_status(C("v")), missing.clear_codes(C("v")),
                    missing.consolidate_levels(C("a"), C("b"), {"low": 1, "mid": 2, "high": 3})).collect()
    assert [tuple(r) for r in got] == [("Partial Match", None, "low"), ("No Match", None, None), ("Missing", None, "mid"), ("Other", 4.0, "high")]


def test_strict_cast_raises(spark):
    df = spark.createDataFrame([("x",)], "n string")
    with pytest.raises(Exception):
        rel.coerce_types(df, numerics=["n"]).collect()
    assert df.select(rel.coerce_numeric_lenient(C("n"))).first()[0] is None


def test_lowercase_collision(spark):
    with pytest.raises(ValueError):
        rel.lowercase_columns(spark.sql("SELECT 1 AS a, 2 AS b").toDF("a", "A"))


def test_unknown_fraud_mode(spark):
    with pytest.raises(ValueError):
        rel.fraud_label(spark.range(1), "other")


def test_period_windows_share_boundaries(spark):
    df = spark.sql("SELECT id, TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(id) AS ts FROM range(0, 25) t(id)".replace("t(id)", ""))
    got = {}
    for r in rel.period_windows(df, "ts", 10).collect():
        got.setdefault(r.id, []).append(r.window_no)
    assert got[0] == [1] and sorted(got[10]) == [1, 2] and got[20] == [2] and 21 not in got
    right = {r.id: r.window_no for r in rel.period_windows(df, "ts", 10, closed="right").collect()}
    assert right[10] == 1 and right[11] == 2


def dummy_rows():
    """Two windows and a null one; ``wide`` has many levels and one that most rows share, ``flat`` has a single one."""
    rnd = random.Random(5)
    rows = [(i, rnd.choice("uv"), rnd.choice(["m", f"l{rnd.randrange(400)}"]), "same", rnd.choice(["x", "y", None])) for i in range(1500)]
    return rows + [(9000, None, "m", "same", "x")]


def expected_dummies(rows):
    """{(id, window): {slot: share}} and the number of slots of each window, by hand."""
    out, slots = {}, {}
    for w in "uv":
        mine = [r for r in rows if r[1] == w]
        base = 0
        for c in (3, 4, 2):  # flat, small, wide: columns by name
            levels = sorted({r[c] or "Missing" for r in mine})
            for r in mine:
                at = levels.index(r[c] or "Missing")
                own = out.setdefault((r[0], w), {})
                if at:
                    own[base + at - 1] = sum((x[c] or "Missing") == levels[at] for x in mine) / len(mine)
            base += len(levels) - 1
        slots[w] = base
    return out, slots


def test_sparse_and_long_dummies(spark, monkeypatch):
    rows = dummy_rows()
    want, slots = expected_dummies(rows)
    df = spark.createDataFrame(rows, "id long, window string, wide string, flat string, small string")
    monkeypatch.setattr(encode, "LEVELS_A_PART", 100)  # several ranges for one column
    got = encode.one_hot_sparse(df, "id", "window", ["wide", "flat", "small"]).collect()
    assert {(r.id, r.window): {o.pos: round(o.share, 12) for o in r.own} for r in got} == {
        k: {p: round(s, 12) for p, s in v.items()} for k, v in want.items()}
    long = encode.one_hot_drop_first(df, "id", "window", ["wide", "flat", "small"], block=7).groupBy("id", "window").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("own")).collect()
    assert {(r.id, r.window): (r.n, r.own) for r in long} == {k: (slots[k[1]], len(v)) for k, v in want.items()}


def test_a_column_of_very_many_levels(spark):
    n = 100_000
    df = spark.range(n).select(C("id"), F.lit("w").alias("window"), F.format_string("%06d", C("id")).alias("c"))
    own = encode.one_hot_sparse(df, "id", "window", ["c"]).select("id", F.size("own").alias("n"), F.get("own", F.lit(0))["pos"].alias("pos"))
    assert own.count() == n
    assert own.where((C("id") > 0) & ((C("n") != 1) | (C("pos") != C("id") - 1))).count() == 0
    assert own.where(C("id") == 0).first().n == 0


def test_names_are_matched_by_batch(spark):
    rnd = random.Random(3)
    words = ["", "é😀x", "x😀", "same", *["".join(rnd.choices("abc1", k=rnd.randrange(150))) for _ in range(40)]]
    rows = [(rnd.choice(words), rnd.choice(words)) for _ in range(150)] + [(None, "a"), ("a", None), (None, ""), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.lcs_length(C("a"), C("b")).alias("n"))
    for r in df.collect():
        assert r.n == (None if None in (r.a, r.b) and "" not in (r.a, r.b) else lcs(r.a or "", r.b or "")), r
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "_common_lengths" in plan  # no lambda run for every two characters
