"""Importance resampling towards a target: hashed n-gram gains score each document, and a parallel sort draws the best.

Features are runs of one to three words, hashed to 10,000 buckets. Each task adds up one array of bucket counts; the
summed arrays of the corpus and of the target give one array of gains, which is all that scoring needs (10,000
numbers, whatever the data). A document's score is the sum of its gains plus a Gumbel term from its id, so taking the
highest scores is drawing without replacement in proportion to the weights.

Drawing is a parallel sort by regular sampling. The scored rows are written as locally sorted runs. Each run gives
every ``segment_rows`` / 8-th row as a sample, which makes splitters of about ``segment_rows`` rows each; rows are counted
per segment before anything is exchanged, prefix sums of those counts say which segments hold drawn rows, and only these
are exchanged, each merged by itself. A row's rank is its place in its segment plus the rows of all segments before it,
so ranks are exact whatever the samples were. Ties beyond score and id are split by the row's place in its run, so
a row repeated any number of times is not one segment.

Defined results: null and empty texts have no features, weight 0, and are never drawn, as they have under 20 words. A
null id counts as an empty one in the hash and comes last among equal scores. Repeated rows are counted, scored and
drawn each for itself. Texts of any length are read whole; a task holds one text's words at a time. An empty table
gives no rows; an empty target gives gains from the corpus alone. Further columns of the input, whatever their names,
take no part.
"""

from __future__ import annotations

import math
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import settle

C = F.col
BUCKETS = 10_000
_WORD = bytes(c for c in range(256) if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122)
#: A-Z become a-z, every byte outside words becomes a space; all bytes of non-ASCII characters belong to words
_FOLD = bytes(c if c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one to three words."""
    words = text.translate(_FOLD).split()
    after = [b" " + w for w in words]
    one = list(map(crc32, words))
    two = list(map(crc32, after[1:], one))  # a checksum goes on from the checksum of what stands before
    three = list(map(crc32, after[2:], two))
    return len(words), np.array(one + two + three, np.int64) % BUCKETS


def _texts(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all rows fall in each bucket; one array a task reaches the shuffle."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in _texts(b.column(0)):
                total += np.bincount(features(t)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to source share, per bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int = 42) -> int:
    """floor(-1000 ln(-ln u)) of an even number u drawn by the id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row, in place."""
    src = docs.select("doc_id", "text")

    def apply(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                n, at = features(t)
                w = int(gain[at].sum())
                rows.append((len(at), n, w, w + gumbel(i, seed)))
            cols = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, k]) for k in range(4))],
                                             names=["doc_id", "n_features", "n_words", "weight", "score"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(apply, f"doc_id {kind}, n_features long, n_words long, weight long, score long")


def _runs(scored: DataFrame) -> DataFrame:
    """Locally sorted runs: _sign and _id are the ascending sort key, _at the row's number, rising within a run."""
    keyed = scored.withColumns({"_sign": -C("score"), "_id": C("doc_id")})
    return settle(keyed.sortWithinPartitions("_sign", C("_id").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "importance-runs")


def _splitters(runs: DataFrame, rows: int, segment_rows: int) -> list[tuple]:
    """Regular samples of every run, sorted; every eighth one starts a segment of about ``segment_rows`` rows."""
    step = max(1, segment_rows // 8)
    phase = F.pmod(F.xxhash64(F.shiftright("_at", 33)), F.lit(step))  # runs shorter than a step are sampled in their share
    samples = runs.filter(F.pmod(C("_at").bitwiseAND((1 << 33) - 1), F.lit(step)) == phase).select("_sign", "_id", "_at").collect()
    order = sorted((r["_sign"], r["_id"] is None, r["_id"] or 0, r["_at"]) for r in samples)
    return order[8::8] if rows > segment_rows else []


def _deal(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``runs`` with the segment of every row: how many splitters do not come after it."""
    def apply(batches):
        from bisect import bisect_right

        for b in batches:
            key = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_sign", "_id", "_at")))
            seg = [bisect_right(splitters, (s, i is None, i or 0, at)) for s, i, at in key]
            yield b.append_column("_segment", pa.array(seg, pa.int32()))

    return runs.mapInArrow(apply, T.StructType([*runs.schema, T.StructField("_segment", T.IntegerType())]))


def ranks(scored: DataFrame, keep: int | None = None, segment_rows: int = 1 << 20) -> DataFrame:
    """``scored`` (doc_id, score and other columns) with ``rank``: 1 for the highest score, ties to the smaller id.

    With ``keep``, ranks beyond it are null and segments that lie wholly beyond it are not exchanged.
    """
    runs = _runs(scored)
    total = runs.count()
    keep = total if keep is None else keep
    dealt = settle(_deal(runs, _splitters(runs, total, segment_rows)), "importance-segments")
    counts = dealt.groupBy("_segment").count()
    starts = settle(counts.select("_segment", (F.sum("count").over(Window.partitionBy().orderBy("_segment")) - C("count")).alias("_first")),
                    "importance-starts")  # one row per million
    last = starts.filter(C("_first") < keep).agg(F.coalesce(F.max("_segment"), F.lit(-1))).first()[0]
    place = F.row_number().over(Window.partitionBy("_segment").orderBy("_sign", C("_id").asc_nulls_last(), "_at"))
    merged = dealt.filter(C("_segment") <= last).withColumn("rank", place).join(starts, "_segment").withColumn("rank", C("_first") + C("rank"))
    merged = merged.withColumn("rank", F.when(C("rank") <= keep, C("rank"))).drop("_first")
    beyond = dealt.filter(C("_segment") > last).withColumn("rank", F.lit(None).cast("long"))
    return merged.unionByName(beyond).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: int = 42,
             segment_rows: int = 1 << 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of ``docs``.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = settle(weigh(docs, gain, seed), "importance-scores")
    able = scored.filter(C("n_words") >= min_words)
    drawn = ranks(able, percent * able.count() // 100, segment_rows)
    rest = scored.filter(C("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
