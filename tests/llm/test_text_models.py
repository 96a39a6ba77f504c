"""Quality, toxicity, language and language-model operators against direct computations and held-out rows."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.llm import bytegrams as bg
from fraudloom.llm import lang_kernel, lm_ctw, quality_kn, toxicity

WORDS = {"en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which".split(),
         "de": "der die und in den von zu das mit sich des auf ist nicht ein eine als auch es an werden aus er hat dass sie".split()}


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        lang = "de" if i % 3 == 0 else "en"
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 80))]
        toxic, junk = int(i % 5 == 0), i % 7 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "vilely", "evile", "vilerr"]))
        if junk:
            words = [w.upper() + "#%&" for w in words]
        rows.append((i, " ".join(words), lang, "s0", 1, "extra"))
        labels.append((i, int(not junk), toxic))
    rows += [(None, "the of and", None, None, None, None), (900, None, "en", None, 0, None), (901, "", None, None, 0, None),
             (902, "12 34 !!", "en", "s0", 8, "x"), (1, rows[1][1], "en", "s0", 1, "extra"), (903, "the of and " * 20_000, "en", "s1", 1, None)]
    return rows, labels + [(5000, 1, 1), (6000, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_gram_codes():
    texts = [b"ab", b"", b"xyz"]
    code, owner = bg.codes(texts, 3)
    want = []
    for i, t in enumerate(texts):
        x = b"\0\0" + t + b"\0"
        want += [(int.from_bytes(x[j:j + 3], "big"), i) for j in range(len(t) + 1)]
    assert list(zip(code.tolist(), owner.tolist())) == want
    for n in (3, 7):  # 7 bytes don't fit beside the text index
        c, o, k = bg.by_text(texts * 2, n)
        assert k.sum() == 16 and len(c) == len({(a, b) for a, b in zip(c.tolist(), o.tolist())})
    values = np.array([5, 9, 1 << 40], np.int64)
    assert bg.unpack_keys(bg.pack_keys(values)).tolist() == values.tolist()


def kneser_ney(train, text, n):
    """Per-byte log2 probabilities by the textbook recursion."""
    count = [None] + [Counter() for _ in range(n)]
    for t in train:
        x = b"\0" * (n - 1) + t + b"\0"
        for j in range(len(t) + 1):
            count[n][x[j:j + n]] += 1
    for k in range(n - 1, 0, -1):
        for g in count[k + 1]:
            count[k][g[1:]] += 1
    d = {k: quality_kn.discounts([sum(c == i for c in count[k].values()) for i in (1, 2, 3, 4)]) for k in range(1, n + 1)}

    def p(g):
        if not g:
            return 1 / 256
        k, low = len(g), p(g[1:])
        own = [c for h, c in count[k].items() if h[:-1] == g[:-1]]
        if not own:
            return low
        c = count[k][g]
        return (c - d[k][min(c, 3)] + sum(d[k][min(x, 3)] for x in own) * low) / sum(own)

    x = b"\0" * (n - 1) + text + b"\0"
    return sum(math.log2(p(x[j:j + n])) for j in range(len(text) + 1))


def test_quality_is_kneser_ney(spark, docs, labels, corpus):
    rows, labelled = corpus
    got = {r["doc_id"]: r for r in quality_kn.perplexities(docs, labels, order=4).collect()}
    ids = {r["_id"] for r in quality_kn.fit_ids(labels, 20_000).collect()}
    train = [(t or "").encode() for i, t, *_ in rows if i in ids]
    assert len(train) > 50 and len(got) == len({r[0] for r in rows})
    for i in (0, 7, 10, 900):
        text = (dict((r[0], r[1]) for r in rows)[i] or "").encode()
        assert math.log2(got[i]["perplexity"]) * -(len(text) + 1) == pytest.approx(kneser_ney(train, text, 4), rel=1e-5)
    parts = quality_kn.perplexities(docs.repartition(6), labels, order=4, part_bytes=2000).collect()  # every bucket answered in several parts
    whole = sorted((r["doc_id"] or -1, r["perplexity"]) for r in quality_kn.perplexities(docs, labels, order=4).collect())
    assert [x for _, x in sorted((r["doc_id"] or -1, r["perplexity"]) for r in parts)] == pytest.approx([x for _, x in whole])


def test_quality_keeps_clean_and_drops_junk(docs, labels, none, corpus):
    out = quality_kn.classify(docs, labels, min_calibration=5).collect()
    assert len(out) == len(corpus[0])
    junk = {i for i, q, _ in corpus[1] if q == 0}
    assert all(not r["keep"] for r in out if r["doc_id"] in junk)
    clean = [r["keep"] for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] not in junk]
    assert np.mean(clean) > 0.95
    assert quality_kn.classify(none, labels).count() == 0
    assert all(r["keep"] for r in quality_kn.classify(docs, labels.filter("false")).collect())


def ctw_log2(train, text, depth):
    """Context-tree weighting by recursion over dictionaries."""
    count = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def nodes(x, j):
        for b in range(8):
            node = 1 << b | x[j] >> (8 - b)
            yield node, x[j] >> (7 - b) & 1

    for t in train:
        x = b"\0" * depth + t + b"\0"
        for j in range(depth, len(x)):
            for node, bit in nodes(x, j):
                for d in range(depth + 1):
                    count[(x[j - d:j], node)][bit] += 1
                    if d:
                        kids[(x[j - d + 1:j], node)].add(x[j - d:j])

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def lpw(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*count.get((ctx, node), (0, 0)))
            memo[ctx, node] = own if len(ctx) == depth else np.logaddexp(own, sum(lpw(c, node) for c in kids.get((ctx, node), ()))) - math.log(2)
        return memo[ctx, node]

    total, x = 0.0, b"\0" * depth + text + b"\0"
    for j in range(depth, len(x)):
        for node, bit in nodes(x, j):
            p = 0.5
            for d in range(depth, -1, -1):
                ctx = x[j - d:j]
                a, b = count.get((ctx, node), (0, 0))
                q = (b + .5) / (a + b + 1)
                w = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - lpw(ctx, node))
                p = w * q + (1 - w) * p
            total += math.log2(p if bit else 1 - p)
    return total


def test_language_model_is_context_tree_weighting(docs, none, corpus):
    rows = corpus[0]
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_ctw.score(docs, depth=3).collect()}
    learn = [(t or "").encode().lower().split() for i, t, *_ in rows if i is not None and fold(i, 7) != 2]
    counts = Counter(w for x in learn for w in x)
    n, v, ends = sum(counts.values()) + len(learn), len(counts) + 1, len(learn)
    for i, t, *_ in rows[:12] + rows[-5:-2]:
        words = (t or "").encode().lower().split()
        r = got[i, len(words) + 1]
        assert r["held_out"] == (fold(i, 7) == 2) and r["train_tokens"] == n
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base) and r["n_known"] == sum(counts[w] > 0 for w in words) + 1
    learned = [b" ".join(x) for x in learn]
    for i in (0, 3, 901):
        text = b" ".join((dict((r[0], r[1]) for r in rows)[i] or "").encode().lower().split())
        r = got[i, len(text.split()) + 1]
        assert r["score"] == pytest.approx(ctw_log2(learned, text, 3) * math.log10(2), rel=1e-5)
    assert lm_ctw.score(none).count() == 0
    assert any(r["doc_id"] is None and not r["held_out"] for r in got.values())


def test_busy_contexts_are_dealt_by_their_third_byte(docs):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") + ". x" for _ in range(200)).encode() for _ in range(20)]
    near = bg.near_contexts(texts, chunk=300)
    code = bg.codes(texts, 6)[0]
    spot = ord(" ") | ord(".") << 8
    at = (code >> 8 & 0xFFFF) == spot
    assert near[spot] == at.sum() > near.sum() / 512
    busy = near > near.sum() / 512
    assert len(set(bg.bucket_of(code[at], 64))) == 1 and len(set(bg.bucket_of(code[at], 64, busy))) > 3
    parts = [bg.tally(code[i::7].copy()) for i in range(7)]
    for least in (10, 1 << 18):
        got, want = bg.merge(iter(parts), least), bg.tally(code.copy())
        assert all((a == b).all() for a, b in zip(got, want))
    whole, dealt = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in lm_ctw.score(docs, busy_share=n).collect()} for n in (1, 512))
    assert whole.keys() == dealt.keys() and all(dealt[k] == pytest.approx(x, rel=1e-5) for k, x in whole.items())


def test_toxicity_finds_held_out_rows_and_misspellings(docs, labels, none, corpus):
    out = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    toxic = {i: t for i, _, t in corpus[1] if t is not None and i < 300}
    held = [i for i in toxic if fold(i, 5) == 0]
    assert all(out[i]["held_out"] for i in held)
    assert np.mean([out[i]["predicted"] == toxic[i] for i in held]) > 0.9
    assert 0 <= out[900]["score"] < 0.5 and out[901]["score"] == out[900]["score"] and out[None]["held_out"] is False
    model = toxicity.fit(docs, labels)
    assert model.scores(["the of and vilester to in that"])[0] > 0.5 > model.scores(["the of and to in that"])[0]
    assert toxicity.classify(none, labels).count() == 0
    assert max(r["score"] for r in toxicity.classify(docs, labels.filter("false")).collect()) < 1e-6


def test_language_kernel_and_held_out_accuracy(docs, none, corpus):
    model = lang_kernel.fit(docs)
    out = {r["doc_id"]: r for r in lang_kernel.identify(docs, model).collect()}
    lang = {r[0]: r[2] for r in corpus[0] if r[0] is not None and r[0] < 300}
    held = [i for i in lang if fold(i, 3) == 1]
    assert np.mean([out[i]["lang_pred"] == lang[i] for i in held]) > 0.95 and all(out[i]["held_out"] for i in held)
    assert {out[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and all(0 <= r["score"] <= 1 for r in out.values())
    assert lang_kernel.identify(none, lang_kernel.fit(none)).count() == 0
    assert {r["lang_pred"] for r in lang_kernel.identify(docs, None).collect()} == {"und"}


def test_folded_matrix_equals_the_kernel_form():
    texts = [b"der die das und", b"the and that", b"die der und ist", b"that the was and"]
    codes = [np.unique(lang_kernel.gram_codes([t])[0]) for t in texts]
    model = lang_kernel.train(codes, ["de", "en", "de", "en"], landmarks=4)
    k = np.array([[len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b)) for b in codes] for a in codes])
    value, vector = np.linalg.eigh(k)
    phi = k @ (vector / np.sqrt(value))
    y = np.array([[1, -1], [-1, 1]] * 2)
    w = np.linalg.solve(phi.T @ phi / 2 + 1e-3 * np.eye(4), phi.T @ y / 2)
    assert np.allclose(model.outputs(texts), phi @ w, atol=1e-4)


def test_quality_is_fitted_on_every_trusted_row_of_its_half(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_kn.fit_ids(labels).count() == labels.filter("pmod(xxhash64(doc_id), 2L) = 0").count() > 20_000


def test_toxicity_is_learned_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, y, share: toxicity.Model(np.zeros(4), float(os.getpid()), np.zeros(3), share))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).bias not in (0.0, float(os.getpid()))
