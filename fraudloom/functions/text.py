"""Text, map and JSON feature columns and the name-match jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import settle

C = F.col
TILE_ROWS = 1024


def url_decode(c: Column) -> Column:
    """Percent-decoding where '+' stays and a '%' without two hex digits stays."""
    guarded = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), "[+]", "%2B")
    return F.url_decode(guarded)


def url_decode_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({c: url_decode(C(c)) for c in cols if c in have})


def dirty_json_map(c: Column) -> Column:
    return F.from_json(F.translate(F.coalesce(c, F.lit("{}")), "'", '"'), T.MapType(T.StringType(), T.StringType()))


def dirty_json_expand(df: DataFrame, col: str, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """One column per named key; ``dirty_json_map`` holds all keys of a row where they aren't known."""
    parsed = dirty_json_map(C(col))
    return df.withColumn("_m", parsed).withColumns({f"{prefix}{k}": C("_m")[k] for k in keys}).drop("_m")


def kv_value(c: Column, key: str) -> Column:
    """Value of ``key`` in ``k=v&k=v`` text: text between first and second '='; repeats joined by ', '."""
    hits = F.filter(F.split(c, "&"), lambda s: (F.split(s, "=")[0] == key) & s.contains("="))
    vals = F.transform(hits, lambda s: F.get(F.split(s, "="), F.lit(1)))
    return F.when(F.size(hits) > 0, F.array_join(vals, ", "))


def kv_expand(df: DataFrame, col: str, keys: Sequence[str], prefix: str = "tmx_raw_") -> DataFrame:
    return df.withColumns({f"{prefix}{k}": kv_value(C(col), k) for k in keys}).drop(col)


def fold_levels_exact(c: Column, levels: Mapping[str, Sequence[str]]) -> Column:
    """Spellings to canonical level, one dictionary entry after the other."""
    out = c
    for level, spellings in levels.items():
        out = F.when(F.trim(out).isin(*spellings), F.lit(level)).otherwise(out)
    return out


def fold_levels_regex(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The whole value is replaced where the pattern is found; null stays null."""
    for col, regex, replacement in rules:
        if col in df.columns:
            df = df.withColumn(col, F.when(C(col).rlike(regex), F.lit(replacement)).otherwise(C(col)))
    return df


def fold_source(c: Column) -> Column:
    folded = F.regexp_replace(c, "google.*", "google")
    return F.when(F.coalesce(folded.isin("google", "organic"), F.lit(False)), folded).otherwise(F.lit("OTHER"))


def email_local_length(c: Column) -> Column:
    return F.length(F.substring_index(c, "@", 1))


def strip_quotes(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.translate(C(c), "\"'", "") for c in text})


# ---------------------------------------------------------------- name matching


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit of ``row`` for each character of ``a``, one step of the whole row for each of ``b``."""
    if a == b:
        return len(a)
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        if met := row & places.get(ch, 0):
            row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def _common_lengths(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _common(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, for texts of any length (bit-vector form, in place, a batch of rows at a time)."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(_common_lengths(a, b))


def indel_ratio(a: Column, b: Column) -> Column:
    """2*LCS/(len a + len b); 1 for two empty texts."""
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / size)


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence-matcher ratio; order matters, so keep the application value first. Repeats in a batch are scored once."""
    seen: dict[tuple, float | None] = {}

    def one(pair):
        if pair not in seen:
            x, y = pair
            seen[pair] = None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
        return seen[pair]

    return pd.Series([one(p) for p in zip(a, b)], dtype="float64")


def match_scores(df: DataFrame, pairs: Sequence[tuple[str, str, str]], method: str = "indel",
                 unquote: Sequence[str] = ()) -> DataFrame:
    """Similarity of lower-cased column pairs (a, b, out); -1 where either is null or b is empty.

    Scored in place, without a shuffle: the same plan serves batch and stream.
    """
    ratios = {"indel": indel_ratio, "gestalt": gestalt_ratio}
    if method not in ratios:
        raise ValueError(f"unknown method {method!r}; choose one of {sorted(ratios)}")
    out = {}
    for a, b, name in pairs:
        left, right = C(a), C(b)
        if name in unquote:
            left, right = F.translate(left, "\"'", ""), F.translate(right, "\"'", "")
        score = ratios[method](F.lower(left), F.lower(right))
        out[name] = F.when(left.isNotNull() & (F.length(right) > 0), score).otherwise(F.lit(-1.0))
    return df.withColumns(out)


def _common_first(tokens: DataFrame, top: int = 256) -> Column:
    """The most frequent tokens as a literal array, most frequent first (bounded list)."""
    rows = tokens.groupBy("tok").count().orderBy(C("count").desc(), "tok").limit(top).collect()
    return F.array(*[F.lit(r.tok) for r in rows])


def _dealt(left: DataFrame, right: DataFrame, key: Sequence[str], left_name: str, right_name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with _lp and _rp, the tile in which they meet: each side of a heavy key is cut into parts of TILE_ROWS rows.

    A row of a key with a left and b right parts lies in one part of its own side and in all parts of the other, so every
    pair meets in exactly one tile, and no tile holds more than about TILE_ROWS rows of a side.
    """
    def load(df, name):
        return df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias(name)).where(C(name) > 1)

    # at most one row per TILE_ROWS rows
    heavy = settle(load(left, "_ln").join(load(right, "_rn"), list(key), "full"), "heavy-tokens")
    one = F.lit(1).cast("long")
    parts = {n: F.coalesce(n, one) for n in ("_ln", "_rn")}

    def deal(df, name, mine, other, mine_at, other_at):
        return (df.join(heavy, list(key), "left")
                .withColumn(mine_at, F.pmod(F.xxhash64(name), parts[mine]))
                .withColumn(other_at, F.explode(F.sequence(F.lit(0).cast("long"), parts[other] - 1))).drop("_ln", "_rn"))

    return deal(left, left_name, "_ln", "_rn", "_lp", "_rp"), deal(right, right_name, "_rn", "_ln", "_rp", "_lp")


def candidate_match_join(left: DataFrame, right: DataFrame, block: str, left_name: str, right_name: str,
                         threshold: float) -> DataFrame:
    """Distinct value pairs of one block with indel ratio >= threshold (block, left value, right value, score).

    Exact prefix filter instead of all pairs of a block. A qualifying pair has a
    common subsequence L >= t*(la+lb)/2, so it shares at least 3L-la-lb-1
    two-letter tokens and L one-letter tokens. Of tokens put in one fixed order,
    rare ones first, a text therefore only needs its first (count - bound + 1).
    Two-letter tokens are used where their bound is positive, one-letter tokens
    where a partner may be too short for that. Only pairs that meet are scored;
    a token that very many texts share is dealt over tiles of bounded size.
    """
    t = float(threshold)
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    lo = left.select(C(block), F.lower(left_name).alias("v")).where(F.length("v") > 0).distinct()
    ro = right.select(C(block), F.lower(right_name).alias("v")).where(F.length("v") > 0).distinct()
    shortest = t / (2 - t)  # the shortest partner, as a share of the own length

    def pair_bound(length: Column) -> Column:
        return F.ceil(length * ((1.5 * t - 1) * (1 + shortest)) - 1 - 1e-9)

    def grams(df: DataFrame) -> DataFrame:
        chars, n = _chars(C("v")), F.length("v")
        two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: C("v").substr(i, F.lit(2)))
        sets = F.array(
            F.struct(F.lit(2).alias("q"), two.alias("g"), (n - 1 - pair_bound(n) + 1).alias("keep"), (pair_bound(n) >= 1).alias("use")),
            F.struct(F.lit(1).alias("q"), chars.alias("g"), (n - F.ceil(n * shortest - 1e-9) + 1).alias("keep"),
                     (pair_bound(F.floor(n * shortest)) < 1).alias("use")))
        return df.withColumn("s", F.explode(F.filter(sets, lambda s: s["use"]))).select(block, "v", "s.q", "s.g", "s.keep")

    lg, rg = grams(lo), grams(ro)
    common = _common_first(lg.select(F.explode("g").alias("tok")).union(rg.select(F.explode("g").alias("tok"))))

    def tokens(df: DataFrame, name: str) -> DataFrame:
        marked = F.transform("g", lambda tok, i: F.struct(
            # 0 = not among the common ones; then the most frequent come last
            F.when(F.array_position(common, tok) > 0, -F.array_position(common, tok)).otherwise(F.lit(-1_000_000)).alias("o"),
            tok.alias("tok"), F.size(F.filter(F.slice("g", 1, i + 1), lambda x: x == tok)).alias("occ")))
        kept = F.slice(F.sort_array(marked), 1, F.greatest(C("keep").cast("int"), F.lit(0)))
        return (df.withColumn("t", F.explode(kept))
                .select(block, "q", C("v").alias(name), C("t.tok").alias("tok"), C("t.occ").alias("occ")))

    short = F.least(F.length(left_name), F.length(right_name))
    fits = 2.0 * short >= t * (F.length(left_name) + F.length(right_name)) - 1e-9
    key = [block, "q", "tok", "occ"]
    lt, rt = _dealt(settle(tokens(lg, left_name), "left-tokens"), settle(tokens(rg, right_name), "right-tokens"), key, left_name, right_name)
    pairs = lt.join(rt, [*key, "_lp", "_rp"]).where(fits).select(block, left_name, right_name).distinct()
    return (pairs.withColumn("score", indel_ratio(C(left_name), C(right_name)))
            .where(C("score") >= t - 1e-12))
