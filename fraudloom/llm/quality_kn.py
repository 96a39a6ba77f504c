"""Quality classifier: interpolated modified Kneser-Ney byte n-grams of trusted text, cut at quantiles per language.

The model is fitted on all trusted rows of one hash half (``max_trusted`` may bound them); its counts, the perplexities
and the quantiles come from sharded joins over all documents. A pack of documents asks for its distinct grams only; questions
and counts meet in buckets by the two nearest context bytes, where every context and its shorter forms lie together.
Orders one and two are at most 65,536 numbers and are the only part that passes through the driver.

Defined results: null texts count as empty; a text of m bytes has m + 1 predictions, its end included, so an empty
one has a perplexity too. Rows without an id are scored and never trusted. A null language is the language ``und``.
A language with fewer than ``min_calibration`` held-out trusted rows takes the quantile of all of them; without any
trusted row all documents are kept. Repeated rows are scored each on its own. Only ``doc_id``, text, language and the
columns named in ``carry`` are read and returned, so further columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import bytegrams as bg
from .common import broadcast_if_small, settle, text_bytes, unpack, write_packs

C = F.col


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3+ from the numbers of grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0] + [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)])


def count_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5]


def interpolate(ask: np.ndarray, code: np.ndarray, count: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """One order up: probabilities of ``ask`` given those of their shorter forms in ``lower``."""
    if not len(code):
        return lower
    ctx = code >> 8
    at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
    ctx, total = ctx[at], np.add.reduceat(count, at).astype(float)
    left = np.add.reduceat(d[np.minimum(count, 3)], at)
    i = np.minimum(np.searchsorted(ctx, ask >> 8), len(ctx) - 1)
    known = ctx[i] == ask >> 8
    j = np.minimum(np.searchsorted(code, ask), len(code) - 1)
    c = np.where(code[j] == ask, count[j], 0)
    p = (c - d[np.minimum(c, 3)] + left[i] * lower) / total[i]
    return np.where(known, p, lower)


def orders_of(code: np.ndarray, count: np.ndarray, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Raw counts of order n, and continuation counts (distinct bytes in front) of orders n - 1 down to 3."""
    out = {n: (code, count)}
    for k in range(n - 1, 2, -1):
        out[k] = bg.tally(out[k + 1][0] & ((1 << 8 * k) - 1))
    return out


def small_orders(pairs: dict[int, int]) -> np.ndarray:
    """256 x 256 table of P(byte | byte before) from the continuation counts of byte pairs."""
    c2 = np.zeros((256, 256))
    for k, v in pairs.items():
        c2[k >> 8, k & 255] = v
    c1 = (c2 > 0).sum(0)
    d1, d2 = discounts(count_of_counts(c1)), discounts(count_of_counts(c2[c2 > 0].astype(np.int64)))
    p1 = np.full(256, 1 / 256)
    if c1.sum():
        x = d1[np.minimum(c1, 3)]
        p1 = (c1 - x + x.sum() / 256) / c1.sum()
    x = np.where(c2 > 0, d2[np.minimum(c2, 3).astype(int)], 0)
    total = c2.sum(1, keepdims=True)
    return np.where(total > 0, (c2 - x + x.sum(1, keepdims=True) * p1) / np.maximum(total, 1), p1)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Trusted counts of a bucket, over all packs."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
        if c is not None:
            keys.append(bg.unpack_keys(k))
            counts.append(bg.expand(c))
    return bg.tally(np.concatenate(keys), np.concatenate(counts))


def fit_ids(labels: DataFrame, max_trusted: int | None = None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids the model is fitted on: the trusted ids of the even hash half; the first ``max_trusted`` in hash order, if given."""
    h = F.xxhash64(id_col)
    ids = (labels.filter((C(label_col) == 1) & C(id_col).isNotNull() & (F.pmod(h, F.lit(2)) == 0))
           .select(C(id_col).alias("_id")).distinct())
    return ids if max_trusted is None else ids.orderBy(F.xxhash64("_id"), "_id").limit(max_trusted)


def perplexities(docs: DataFrame, labels: DataFrame, *, order: int = 5, max_trusted: int | None = None,
                 carry: tuple[str, ...] = (), bucket_bytes: int = 16 << 20, part_bytes: int = 64 << 20) -> DataFrame:
    """Per document its id, language, the carried columns, ``_fit``, ``n_bytes`` and ``perplexity`` per byte."""
    columns = list(dict.fromkeys(["doc_id", "lang", *carry]))
    buckets = max(12, -(-text_bytes(docs) // bucket_bytes))
    ids = settle(fit_ids(labels, max_trusted), "kn-ids")  # broadcast while Spark finds the file small enough
    src = docs.select(*dict.fromkeys([*columns, "text"]))
    fields = {f.name: f for f in src.schema.fields}
    src = (src.join(ids, src["doc_id"] == ids["_id"], "left")
           .select(*src.columns, C("_id").isNotNull().alias("_fit")))

    def raw(t: pa.Table) -> list[bytes]:
        return t.column("text").fill_null("").cast(pa.binary()).to_pylist()

    def requests(t: pa.Table):
        texts, fit = raw(t), t.column("_fit").to_numpy()
        code, count = bg.tally(bg.codes(texts, order)[0])
        for b, k, _ in bg.split(code, count, buckets):
            yield "ask", b, bg.pack_keys(k), None
        code, count = bg.tally(bg.codes([x for x, f in zip(texts, fit) if f], order)[0])
        for b, k, n in bg.split(code, count, buckets):
            yield "fit", b, bg.pack_keys(k), bg.squeeze(n)

    packs, forget = write_packs(src, requests, "kn-packs", buckets)
    asked = packs.filter(C("kind").isNotNull()).select("kind", "bucket", "pack", "keys", "counts")

    def stats(t: pa.Table) -> pa.Table:
        levels = orders_of(*_merged(t), order)
        rows = [("n%d" % k, i + 1, int(x)) for k, (_, c) in levels.items() for i, x in enumerate(count_of_counts(c))]
        k, c = bg.tally(levels[3][0] & 0xFFFF)
        rows += [("pair", int(a), int(b)) for a, b in zip(k, c)]
        return pa.table({"what": pa.array([r[0] for r in rows], pa.string()), "k": pa.array([r[1] for r in rows], pa.int64()),
                         "v": pa.array([r[2] for r in rows], pa.int64())})

    asking = C("kind") == "ask"

    def cut(rows: DataFrame) -> DataFrame:
        """Per bucket the number of parts of about ``part_bytes`` that its keys make."""
        return rows.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("keys")) / part_bytes).alias("parts"))

    def merge(t: pa.Table) -> pa.Table:
        keys, counts = _merged(t)
        return pa.table({"bucket": t.column("bucket")[:1], "keys": [bg.pack_keys(keys)], "counts": [bg.squeeze(counts)]},
                        schema=pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    # fitted grams of a bucket are merged once, its packs in parts first: later tasks read one row instead of one a pack
    fitted = asked.filter(C("kind") == "fit")
    first = (fitted.join(cut(fitted), "bucket").withColumn("part", F.pmod(F.xxhash64("pack"), C("parts"))).groupBy("bucket", "part")
             .applyInArrow(merge, "bucket int, keys binary, counts binary"))
    fitted = settle(first.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, counts binary"), "kn-fitted")

    found = (fitted.groupBy("bucket").applyInArrow(stats, "what string, k long, v long")
             .groupBy("what", "k").agg(F.sum("v").alias("v")).collect())  # at most 65,536 pairs and 4 rows an order
    p2 = small_orders({r["k"]: r["v"] for r in found if r["what"] == "pair"})
    d = {k: discounts(np.array([sum(r["v"] for r in found if r["what"] == f"n{k}" and r["k"] == i) for i in range(1, 5)]))
         for k in range(3, order + 1)}

    def answer(t: pa.Table) -> pa.Table:
        levels, out = orders_of(*_merged(t), order), []
        t = t.filter(pc.equal(t.column("kind"), "ask"))
        for keys in t.column("keys").to_pylist():
            ask = bg.unpack_keys(keys)
            p = p2[(ask >> 8) & 255, ask & 255]
            for k in range(3, order + 1):
                part, back = np.unique(ask & ((1 << 8 * k) - 1), return_inverse=True)
                low = np.zeros(len(part))
                low[back] = p
                p = interpolate(part, *levels[k], d[k], low)[back]
            out.append(bg.squeeze(np.log2(p).astype("<f4")))
        return pa.table({"pack": t.column("pack"), "bucket": t.column("bucket"), "logs": pa.array(out, pa.binary())})

    # a bucket asked for more than ``part_bytes`` is answered in parts: packs are dealt to them, and each has the fitted grams
    sizes = settle(cut(asked.filter(asking)), "kn-parts")
    part = F.when(asking, F.array(F.pmod(F.xxhash64("pack"), C("parts")))).otherwise(F.sequence(F.lit(0).cast("long"), C("parts") - 1))
    both = asked.filter(asking).unionByName(fitted.select(F.lit("fit").alias("kind"), "bucket", F.lit(None).cast("long").alias("pack"), "keys", "counts"))
    dealt = both.join(sizes, "bucket").withColumn("part", F.explode(part)).drop("parts")
    replies = dealt.groupBy("bucket", "part").applyInArrow(answer, "pack long, bucket int, logs binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        logs = {b: bg.expand(x, "<f4") for b, x in zip(right.column("bucket").to_pylist(), right.column("logs").to_pylist())}
        for blob in left.column("blob").to_pylist():
            t = unpack(blob)
            texts = raw(t)
            code, owner, k = bg.by_text(texts, order)
            first = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
            lp = bg.join_answers(code[first], buckets, logs)[np.cumsum(first) - 1]
            total = np.bincount(owner, weights=k * lp, minlength=len(texts))
            n = np.array([len(x) for x in texts], np.int64)
            tables.append(pa.table({**{c: t.column(c) for c in columns}, "_fit": t.column("_fit"),
                                    "n_bytes": pa.array(n), "perplexity": pa.array(np.exp2(-total / (n + 1)))}))
        return pa.concat_tables(tables)

    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in columns),
                        "_fit boolean, n_bytes long, perplexity double"])
    out = settle(packs.filter(C("blob").isNotNull()).select("pack", "blob").groupBy("pack")
                 .cogroup(replies.groupBy("pack")).applyInArrow(score, schema), "kn-scored")
    forget()
    return out


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.99, min_calibration: int = 50, prior_bytes: int = 150,
             carry: tuple[str, ...] = (), **model) -> DataFrame:
    """Perplexity, its rating, the ``threshold`` of the language and ``keep`` (rated at or below it) per document.

    A short text says little, so the rating adds ``prior_bytes`` bytes of the language's mean code length. Thresholds
    are quantiles of the rating over all trusted documents that the model was not fitted on.
    """
    scored = perplexities(docs, labels, carry=carry, **model)
    lang = F.coalesce(C("lang"), F.lit("und"))
    trusted = labels.filter(C("quality") == 1).select("doc_id").distinct()
    bits = F.log2("perplexity") * (C("n_bytes") + 1)
    cal = (scored.filter(~C("_fit")).select("doc_id", lang.alias("_lang"), "n_bytes", bits.alias("_bits"))
           .join(trusted, "doc_id", "left_semi"))
    cal = settle(cal, "kn-trusted")

    def per_language(df: DataFrame, *aggs) -> DataFrame:
        """One row a language with enough calibration rows, and one with a null language over all rows."""
        n = F.count(F.lit(1))
        own = df.groupBy("_lang").agg(n.alias("n"), *aggs).filter(C("n") >= min_calibration)
        return settle(own.unionByName(df.agg(n.alias("n"), *aggs).withColumn("_lang", F.lit(None).cast("string"))), "kn-cuts")

    def joined(df: DataFrame, key, table: DataFrame, name: str, default: float) -> DataFrame:
        rest = table.filter(C("_lang").isNull()).first()[name]
        own = broadcast_if_small(table.filter(C("_lang").isNotNull()).select(C("_lang").alias("_own"), name))
        return (df.join(own, key == C("_own"), "left").drop("_own")
                .withColumn(name, F.coalesce(C(name), F.lit(default if rest is None else rest))))

    means = per_language(cal, (F.sum("_bits") / F.sum(C("n_bytes") + 1)).alias("_mean"))
    rated = F.pow(F.lit(2.0), (C("_bits") + prior_bytes * C("_mean")) / (C("n_bytes") + 1 + prior_bytes))
    cuts = per_language(joined(cal, C("_lang"), means, "_mean", 8.0).withColumn("rated", rated),
                        F.percentile_approx("rated", F.lit(quantile), F.lit(10_000)).alias("threshold"))
    out = joined(scored.withColumn("_bits", bits), lang, means, "_mean", 8.0).withColumn("rated", rated)
    out = joined(out, lang, cuts, "threshold", float("inf"))
    return out.withColumn("keep", C("rated") <= C("threshold")).drop("_bits", "_mean", "_fit")
