"""Language identification: presence string kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams (1 to 3, lower-cased) that both hold, over the geometric mean
of how many each holds, counted among the grams of the landmarks. ``landmarks`` texts of the training sample span the
feature space; ridge regression on it gives one output a language. Both fold into a matrix of grams by languages, so
a batch of texts is scored by one product of its presence matrix with it.

Only ``per_language`` rows of each language, at most ``max_rows`` in all, are used to fit; all rows are scored, in
place, without a shuffle. The folded matrix has at most one row for each gram of the landmark texts.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be
learned. A text that shares no gram with the landmarks gets the first language at score 0. Ties go to the language
that sorts first. Rows without an id are scored and never learned from; repeated rows are scored each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import held_out, remainder, settle

C = F.col
LETTER = r"\p{L}"


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 1-, 2- and 3-byte grams (tagged by size in the fourth byte), and the text each is from."""
    x = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    two = (x[:-1] << 8 | x[1:]) | 1 << 24
    three = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) | 2 << 24
    in2, in3 = own[:-1] == own[1:], own[:-2] == own[2:]
    return np.concatenate([x, two[in2], three[in3]]), np.concatenate([own, own[:-1][in2], own[:-2][in3]])


class Model:
    """Languages, gram codes of the landmarks and the folded matrix (grams x languages)."""

    def __init__(self, languages: list[str], grams: np.ndarray, matrix: np.ndarray):
        self.languages, self.grams, self.matrix, self.slot = languages, grams, matrix, None

    def __reduce__(self):
        return Model, (self.languages, self.grams, self.matrix)

    def outputs(self, texts: list[bytes]) -> np.ndarray:
        """One regression output per text and language."""
        if self.slot is None:  # column of each gram; 0 for grams that no landmark has
            self.slot = np.zeros(3 << 24, np.int32)
            self.slot[self.grams] = np.arange(1, len(self.grams) + 1)
        out = np.zeros((len(texts), len(self.languages)))
        for at in self.blocks(texts):
            codes, own = gram_codes(texts[at])
            present = np.zeros((at.stop - at.start, len(self.grams) + 1), np.float32)
            present.ravel()[own.astype(np.int64) * (len(self.grams) + 1) + self.slot[codes]] = 1
            present = present[:, 1:]
            size = np.sqrt(np.maximum(present.sum(1), 1))
            out[at] = (present @ self.matrix) / size[:, None]
        return out

    def blocks(self, texts: list[bytes], rows: int = 256, size: int = 2 << 20):
        """Runs of at most ``rows`` texts and, unless one text is longer, ``size`` bytes."""
        start = total = 0
        for i, t in enumerate(texts):
            if i > start and (i - start >= rows or total + len(t) > size):
                yield slice(start, i)
                start, total = i, 0
            total += len(t)
        if start < len(texts):
            yield slice(start, len(texts))


def train(samples: list[np.ndarray], langs: list[str], *, landmarks: int = 192, ridge: float = 1e-3) -> Model | None:
    """Fit on the distinct gram codes of texts; landmarks are dealt over the languages in turn, in sample order."""
    languages = sorted(set(langs))
    if not languages:
        return None
    order = {k: [i for i, x in enumerate(langs) if x == k] for k in languages}
    chosen = [i for row in range(max(map(len, order.values()))) for k in languages for i in order[k][row:row + 1]][:landmarks]
    grams = np.unique(np.concatenate([samples[i] for i in chosen]))

    def presence(rows: list[int]) -> np.ndarray:
        x = np.zeros((len(rows), len(grams)), np.float32)
        for r, i in enumerate(rows):
            at = np.minimum(np.searchsorted(grams, samples[i]), len(grams) - 1)
            x[r, at[grams[at] == samples[i]]] = 1
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    base = presence(chosen)
    value, vector = np.linalg.eigh((base @ base.T).astype(float))
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    gram, right = np.zeros((ok.sum(), ok.sum())), np.zeros((ok.sum(), len(languages)))
    for at in range(0, len(langs), 256):
        rows = list(range(at, min(at + 256, len(langs))))
        phi = (presence(rows) @ base.T).astype(float) @ root
        y = np.array([[1.0 if langs[i] == k else -1.0 for k in languages] for i in rows])
        weight = np.array([1 / len(order[langs[i]]) for i in rows])[:, None]
        gram += phi.T @ (phi * weight)
        right += phi.T @ (y * weight)
    inner = root @ np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
    return Model(languages, grams.astype(np.int64), (base.T @ inner).astype(np.float32))


def fit(docs: DataFrame, *, per_language: int = 250, max_rows: int = 10_000, landmarks: int = 192, modulus: int = 3,
        rest: int = 1) -> Model | None:
    """Train on the first ``per_language`` rows of each language in hash order, ``max_rows`` at most, not held out."""
    h = F.xxhash64("doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    known = docs.filter(C("lang").isNotNull() & F.coalesce(remainder("doc_id", modulus) != rest, F.lit(False))
                        & C("text").rlike(LETTER))
    ids = (known.select("doc_id", "lang").withColumn("_r", rank).filter(C("_r") <= per_language)
           .orderBy("_r", "lang").limit(max_rows).select(C("doc_id").alias("_id"), C("_r").alias("_rank")).distinct())
    ids = F.broadcast(settle(ids, "lang-ids"))  # at most max_rows ids
    src = known.select("doc_id", "text", "lang").join(ids, C("doc_id") == C("_id")).select("text", "lang", "_rank")

    def distinct(batches):
        for b in batches:
            texts = pc.utf8_lower(b.column(0)).cast(pa.binary()).to_pylist()
            out = [np.unique(gram_codes([t])[0]).astype("<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1), b.column(2)], names=["grams", "lang", "_rank"])

    # an id may have several texts: in one order, the same at every run, up to the bound
    rows = (src.mapInArrow(distinct, "grams binary, lang string, _rank int").distinct()
            .orderBy("_rank", "lang", "grams").limit(max_rows).collect())
    return train([np.frombuffer(r["grams"], "<i4") for r in rows], [r["lang"] for r in rows], landmarks=landmarks)


def identify(docs: DataFrame, model: Model | None, *, modulus: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score, for every document."""
    src = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                t = b.slice(at, 1000)
                text = pc.fill_null(t.column(1), "")
                letter = pc.match_substring_regex(text, LETTER).to_numpy(zero_copy_only=False)
                name, score = np.full(t.num_rows, "und", object), np.zeros(t.num_rows)
                if m is not None:
                    z = m.outputs(pc.utf8_lower(text).cast(pa.binary()).to_pylist())
                    best = z.argmax(1)
                    name = np.where(letter, np.array(m.languages, object)[best], "und")
                    score = np.where(letter, np.clip((1 + z[np.arange(len(z)), best]) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(name.tolist(), pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    out = src.mapInArrow(apply, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "lang_pred", "score")
