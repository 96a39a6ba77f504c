"""E-mail token vectors by random indexing, and similar-token pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

C = F.col
#: left tokens of one grid cell that meet all right ones in a task
CELL_ROWS = 2048


def tokens(c: Column) -> Column:
    """Word tokens of an e-mail: runs of letters, digits, dots and underscores between separators."""
    return F.filter(F.split(F.lower(c), r"[^\w.#]+"), lambda t: t != "")


def neighbour_counts(df: DataFrame, email: str, window: int = 1) -> DataFrame:
    """(token, neighbour, n): how often two tokens stand at most ``window`` places apart in one address."""
    lists = df.where(C(email).isNotNull()).select(tokens(C(email)).alias("t"))
    near = F.transform("t", lambda x, i: F.struct(x.alias("token"), F.concat(
        F.slice("t", F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), F.slice("t", i + 2, window)).alias("near")))
    pairs = lists.select(F.explode(near).alias("p")).select("p.token", F.explode("p.near").alias("neighbour"))
    return pairs.groupBy("token", "neighbour").agg(F.count(F.lit(1)).alias("n"))


def token_vectors(df: DataFrame, email: str, size: int = 16, window: int = 1) -> DataFrame:
    """(token, vec): unit vectors of all tokens that have a neighbour and do not cancel out.

    Every neighbour stands for a fixed direction of ``size`` signs taken from its md5; a token's vector is the sum of
    its neighbours' directions by count. One grouped sum over all distinct pairs, with no vocabulary held anywhere.
    """
    if not 1 <= size <= 32:
        raise ValueError("size is 1 to 32, one hexadecimal digit of the md5 each")
    counts = neighbour_counts(df, email, window)
    digits = F.md5("neighbour")
    sums = [F.sum(F.when(F.substring(digits, i + 1, 1) < "8", -C("n")).otherwise(C("n"))).alias(f"s{i}") for i in range(size)]
    vec = counts.groupBy("token").agg(*sums).select("token", F.array(*[C(f"s{i}").cast("double") for i in range(size)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vec.withColumn("_n", norm).where(C("_n") > 0).select("token", F.transform("v", lambda x: x / C("_n")).alias("vec"))


def token_classes(vectors: DataFrame) -> DataFrame:
    """(token, head, vec): tokens with one vector are a class, headed by the smallest of them."""
    heads = vectors.groupBy("vec").agg(F.min("token").alias("head"))
    return vectors.join(heads, "vec").select("token", "head", "vec")


def similar_tokens(vectors: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b, similarity) with cosine >= min_similarity, a < b, exact for every threshold above zero.

    Unit vectors that similar lie within r = sqrt(2 - 2*cos), so on a grid of
    cell size r over the first three dimensions they are in neighbouring cells.
    The left tokens of a busy cell are dealt over several tasks. Where many tokens
    share a vector, pass the heads of ``token_classes``.
    """
    r = (2 - 2 * min_similarity) ** 0.5
    dims = ["c0", "c1", "c2"]
    cells = [F.floor(F.get("vec", i) / F.lit(r)).cast("int").alias(c) for i, c in enumerate(dims)]
    left = vectors.select(C("token").alias("a"), C("vec").alias("va"), *cells)
    busy = left.groupBy(*dims).count().where(C("count") > CELL_ROWS).select(*dims, F.ceil(C("count") / CELL_ROWS).alias("parts"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = left.join(busy, dims, "left").withColumn("part", F.pmod(F.xxhash64("a"), parts))
    near = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    right = vectors.select(C("token").alias("b"), C("vec").alias("vb"), *cells)
    for c in dims:
        right = right.withColumn("_d", F.explode(near)).withColumn(c, C(c) + C("_d")).drop("_d")
    right = right.join(busy, dims, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cos = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return (left.join(right, [*dims, "part"]).where(C("a") < C("b"))
            .select("a", "b", cos.alias("similarity")).where(C("similarity") >= min_similarity))


def most_similar(vectors: DataFrame, token: str, top: int = 4) -> DataFrame:
    """The ``top`` tokens closest to one token."""
    q = vectors.where(C("token") == token).agg(F.first("vec")).scalar()
    cos = F.aggregate(F.zip_with("vec", "_q", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return (vectors.where(C("token") != token).withColumn("_q", q).select("token", cos.alias("similarity"))
            .orderBy(F.round("similarity", 9).desc(), "token").limit(top))
