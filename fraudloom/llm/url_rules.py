"""URL filters by association rules: FP-growth over URL tokens labelled by given rules, matched by inverted index.

A (host, path) rule fits its host and all subdomains where the path starts with the rule's; the longest one wins. The
pages that rules judge are the labels from which Spark's FP-growth mines token combinations; a combination becomes a
rule of its own if enough of its pages share one verdict (``min_confidence``, ``min_support``) and no shorter part of
it is as sure. Pages that no given rule judges take the verdict of the surest mined rule whose tokens they all have.

Every host label, path segment (digits folded) and query key is a token, beside the registered domain, the first
segment, the number of segments, the file ending and a fragment. What bounds the mining is support and rule length: only tokens
with enough support are mined, in rules of at most ``max_items`` tokens. Equal token sets are counted first. A
set of more than 16 such tokens goes to the miner in parts of 16, which together hold every combination of the length allowed;
what the miner proposes is then counted exactly over all token sets, by the inverted index that also serves matching: a
combination is found under its rarest token, joined on it and checked against the whole set. Everything is
DataFrame columns and Spark's own miner.

Defined results: a null URL or one without ``://`` has an empty host, path and token list, no rule, and the default
verdict ``allow``, as has every page that no mined rule fits. Without labelled pages nothing is mined. Repeated rows
and rows without an id are judged each on its own. Of mined rules that fit, the surest wins, then the better
supported, the longer, and the first in text order. A URL of any length is read whole. An empty table gives no rows;
further columns, whatever their names, take no part.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_split, settle

C = F.col
#: Fixed values of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
PART, BLOCK = 16, 4  # tokens that the miner sees of one set, and in how many of them a longer set is cut


def parts(url: str = "url") -> tuple:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    u = F.coalesce(C(url), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def judged(rules=RULES) -> tuple:
    """Rule text and verdict of the longest fitting rule, from columns host and path; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((C("host") == h) | C("host").endswith("." + h)) & C("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: str = "url"):
    """The token list of a URL, from it and the columns host and path."""
    label = F.split("host", r"\.")
    segment = F.filter(F.split("path", "/"), lambda s: s != "")
    fold = lambda c: F.regexp_replace(F.lower(c), r"\d+", "#")
    n, m = F.size(label), F.size(segment)
    query = F.regexp_extract(C(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    key = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1))
    name = lambda k, c: F.concat(F.lit(k + "="), c)
    ending = F.regexp_extract(F.get(segment, m - 1), r"\.([A-Za-z0-9]{1,5})$", 1)
    whole = F.array(
        name("top", F.get(label, n - 1)),
        F.when(n > 1, name("domain", F.concat_ws(".", F.get(label, n - 2), F.get(label, n - 1)))),
        F.when(m > 0, name("first", fold(F.get(segment, F.lit(0))))),
        name("depth", m.cast("string")),
        F.when(ending != "", name("ending", F.lower(ending))),
        F.when(C(url).contains("#"), F.lit("fragment")))
    each = F.concat(F.transform(F.filter(label, lambda t, i: i < n - 1), lambda t: name("label", t)),
                    F.transform(segment, lambda t: name("path", fold(t))), F.transform(key, lambda t: name("key", t)))
    found = F.array_sort(F.array_distinct(F.filter(F.concat(whole, each), lambda t: t.isNotNull())))
    return F.when(C("host") != "", found).otherwise(F.array().cast("array<string>"))


def _parts(sets: DataFrame) -> DataFrame:
    """(items, n) with at most PART tokens: the lists of ``sets`` (items, n), or every choice of PART / BLOCK of their blocks."""
    wide = sets.filter(F.size("items") > PART).withColumn("_blocks", F.ceil(F.size("items") / BLOCK).cast("int"))
    chosen = [f"_b{i}" for i in range(PART // BLOCK)]
    for i, c in enumerate(chosen):
        first = C(chosen[i - 1]) + 1 if i else F.lit(0)
        last = C("_blocks") - len(chosen) + i  # leaves as many blocks as are still to choose
        wide = wide.withColumn(c, F.explode(F.sequence(first, last)))
    joined = F.flatten(F.array(*(F.slice("items", C(c) * BLOCK + 1, F.lit(BLOCK)) for c in chosen)))
    return sets.filter(F.size("items") <= PART).select("items", "n").unionByName(wide.select(joined.alias("items"), "n"))


def _contained(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a token set (column tokens) and a rule (columns items, key) that it holds."""
    return sets.withColumn("key", F.explode("tokens")).join(rules, "key").filter(F.size(F.array_except("items", "tokens")) == 0)


def mine(labelled: DataFrame, *, min_support: float = 0.002, min_confidence: float = 0.8, max_items: int = PART // BLOCK) -> DataFrame:
    """Rules (items, verdict, confidence, support, key) from the columns tokens and verdict; key is the rarest token."""
    if max_items > PART // BLOCK:
        raise ValueError(f"rules have at most {PART // BLOCK} tokens")
    spark = labelled.sparkSession
    sets = settle(labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n"))
                  .groupBy("tokens").agg(F.sum("n").alias("n"), F.collect_list(F.struct("verdict", "n")).alias("by"))
                  .withColumn("_set", F.monotonically_increasing_id()), "url-token-sets")
    pages = sets.agg(F.sum("n")).first()[0]
    if not pages:
        return spark.createDataFrame([], "items array<string>, verdict string, confidence double, support long, key string")
    least = min_support * pages
    held = sets.select("_set", "n", F.explode("tokens").alias("token"))
    single = settle(held.groupBy("token").agg(F.sum("n").alias("all")).filter(C("all") >= least), "url-tokens")
    common = held.join(single, "token").groupBy("_set", "n").agg(F.array_sort(F.collect_list("token")).alias("items"))
    baskets = settle(_parts(common).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("items"), "url-baskets")
    rows = baskets.count()
    if not rows:
        return mine(labelled.filter(F.lit(False)), max_items=max_items)
    # a page in several parts may be counted more than once here, never less: these are proposals
    found = FPGrowth(minSupport=min(1.0, least / rows)).fit(baskets).freqItemsets.filter(F.size("items") <= max_items)
    proposed = settle(found.select(F.array_sort("items").alias("items")), "url-sets")
    rarest = F.row_number().over(Window.partitionBy("items").orderBy("all", "token"))
    keyed = settle(proposed.withColumn("token", F.explode("items")).join(single, "token").withColumn("_r", rarest)
                   .filter(C("_r") == 1).select("items", C("token").alias("key")), "url-keys")
    counted = (_contained(sets.select("tokens", "by"), keyed).select("items", "key", F.explode("by").alias("v"))
               .groupBy("items", "key", "v.verdict").agg(F.sum("v.n").alias("support")))
    share = C("support") / F.sum("support").over(Window.partitionBy("items", "key"))
    rules = settle(counted.withColumn("confidence", share).filter((C("support") >= least) & (C("confidence") >= min_confidence)), "url-rules")
    # a rule goes if leaving out one of its tokens gives a rule for the same verdict that is as sure
    shorter = (rules.select("items", "verdict", "confidence", F.explode("items").alias("out"))
               .select("items", "verdict", "confidence", F.array_remove("items", C("out")).alias("part")))
    beaten = (shorter.join(rules.select(C("items").alias("part"), "verdict", C("confidence").alias("_c")), ["part", "verdict"])
              .filter(C("_c") >= C("confidence")).select("items", "verdict").distinct())
    return rules.join(beaten, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support", "key")


def judge(pages: DataFrame, rules=RULES, *, min_support: float = 0.002, min_confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and, for pages judged by a mined rule, mined (its tokens) and confidence."""
    host, path = parts()
    rule, verdict = judged(rules)
    src = (pages.select("page_id", "url").withColumns({"host": host, "path": path})
           .withColumns({"rule": rule, "given": verdict, "tokens": tokens()}).drop("url"))
    mined = settle(mine(src.filter(C("given").isNotNull()).select("tokens", C("given").alias("verdict")),
                        min_support=min_support, min_confidence=min_confidence), "url-mined")
    asked = src.filter(C("given").isNull()).select("tokens").distinct()
    hits = _contained(asked, mined)
    order = [F.desc("confidence"), F.desc("support"), F.desc(F.size("items")), F.array_join("items", " "), "verdict"]
    best = (hits.withColumn("_r", F.row_number().over(Window.partitionBy("tokens").orderBy(*order))).filter(C("_r") == 1)
            .select(C("tokens").alias("_tokens"), C("verdict").alias("_verdict"), F.array_join("items", " ").alias("mined"), "confidence"))
    best = settle(best, "url-best")
    asked_sizes = src.filter(C("given").isNull()).groupBy(C("tokens").alias("_tokens")).count()
    open_ = join_split(src.filter(C("given").isNull()), best.join(asked_sizes, "_tokens"), "tokens", "_tokens")
    cols = ["page_id", "host", "path", "rule"]
    return (src.filter(C("given").isNotNull())
            .select(*cols, C("given").alias("verdict"), F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence"))
            .unionByName(open_.select(*cols, F.coalesce("_verdict", F.lit(default)).alias("verdict"), "mined", "confidence")))
