"""Language ID: error-correcting output codes.

Each language has a codeword of BITS bits, far from all others. For each bit a binary n-gram classifier
tells the languages whose codeword has a 1 there from those with a 0: a naive Bayes log-ratio of hashed byte
n-grams, of which the counts cover every document that may be learned from. A text's languages are ranked
by the losses of its bits against each codeword, weighted by how well each bit's classifier separates the
languages; if the two best are close, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagix.llm.common import ship, table, train_part

#: Lengths of the n-grams in bytes, and the hash buckets of each length.
ORDERS, BUCKETS = (2, 3, 4), 1 << 14
#: Bits of a codeword, at least; more if there are many languages.
BITS = 12
#: Added to every count.
SMOOTH = 0.5
#: What a log-ratio for each n-gram is multiplied by before losses are taken.
SHARPNESS = 4.0
#: A lead of the best language over the next below this is ambiguous.
CLOSE = 0.2
SEED = 23

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def ngrams(text: str) -> list[np.ndarray]:
    """Bucket numbers of all n-grams of a whole text, for each order; ASCII but letters is white space."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    if len(b) > 2:  # runs of white space count once
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    b = b.astype(np.uint32)
    out = []
    for n in ORDERS:
        m = len(b) - n + 1
        code = np.zeros(max(m, 0), np.uint32)
        for i in range(n):
            if m > 0:
                code = (code << np.uint32(8)) | b[i : i + m]
        out.append((code * np.uint32(2654435761)) >> np.uint32(32 - 14))
    return out


def codewords(n: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """n codewords of 0 and 1, of several random drafts the one with the largest least distance; each column has both values if n > 1."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    bits = max(bits, int(np.ceil(4 * np.log2(n))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        w = rng.integers(0, 2, (n, bits)).astype(np.int8)
        flat = (w.sum(0) == 0) | (w.sum(0) == n)
        for j in np.nonzero(flat)[0]:
            w[rng.integers(n), j] ^= 1
        d = (w[:, None] != w[None]).sum(2)
        least = int(d[~np.eye(n, dtype=bool)].min())
        if least > far:
            best, far = w, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, 0 or 1
    ratio: np.ndarray  # orders x buckets x bits, log-ratios
    weight: np.ndarray  # bits

    def scores(self, text: str | None) -> np.ndarray | None:
        """The probability of each language; None for null and for texts without a letter."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return None
        total, n = np.zeros(self.ratio.shape[2]), 0
        for r, g in zip(self.ratio, ngrams(text), strict=True):
            for i in range(0, len(g), 8192):
                total += r[g[i : i + 8192]].sum(0, dtype=np.float64)
            n += len(g)
        # The margin grows with the square root of the evidence, so a few n-grams decide less.
        margin = SHARPNESS * total / max(1.0, np.sqrt(n))
        sign = 2.0 * self.code - 1
        loss = (np.logaddexp(0, -sign * margin) * self.weight).sum(1) / self.weight.sum()
        p = np.exp(loss.min() - loss)
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        p = self.scores(text)
        if p is None:
            return "und", 0.0, True
        i = int(p.argmax())
        lead = float(p[i] - np.partition(p, -2)[-2]) if len(p) > 1 else 1.0
        return self.languages[i], float(p[i]), lead < CLOSE


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, order, bucket, n): each task adds up its documents, the sums are added up after. Null texts and languages give none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = sums.setdefault(lang, np.zeros((len(ORDERS), BUCKETS), np.int64))
                for i, g in enumerate(ngrams(text)):
                    s[i] += np.bincount(g, minlength=BUCKETS)
            if len(sums) > 256:
                yield from map(_rows, sums.items())
                sums = {}
        yield from map(_rows, sums.items())

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _rows(item: tuple[str, np.ndarray]) -> pa.RecordBatch:
    flat = item[1].ravel()
    at = np.nonzero(flat)[0]
    return pa.RecordBatch.from_arrays([pa.array([item[0]] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts over all of docs; the driver gets one number for each language and bucket: languages x 49,152 at most."""
    counts = gram_counts(docs, text, lang).toPandas()
    languages = sorted(counts["lang"].unique())
    c = np.zeros((len(languages), len(ORDERS) * BUCKETS))
    place = {x: i for i, x in enumerate(languages)}
    c[counts["lang"].map(place).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    c = c.reshape(len(languages), len(ORDERS), BUCKETS)
    p = (c + SMOOTH) / (c + SMOOTH).sum(2, keepdims=True) if len(languages) else c
    code = codewords(len(languages))
    bits = code.shape[1]
    ratio = np.zeros((len(ORDERS), BUCKETS, bits), np.float32)
    weight = np.ones(bits)
    for j in range(bits if len(languages) > 1 else 0):
        one, two = p[code[:, j] == 1].mean(0), p[code[:, j] == 0].mean(0)
        ratio[:, :, j] = np.log(one / two)
        # What a language's own n-grams say on average; the worst separated language weighs the bit.
        mean = (p * ratio[:, :, j]).sum((1, 2)) * np.where(code[:, j] == 1, 1, -1)
        weight[j] = max(float(mean.min()), 1e-3)
    return LanguageModel(languages, code, ratio, weight / weight.max())


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    Only the text is read, to its end, whatever its length; extra columns are not, whatever their names. Null,
    empty and letterless texts are 'und' with score 0; without any learned language all are. Ties go to the
    smaller language name and are flagged; repeated rows stay repeated; ids may be null. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sent.value.predict(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), (~train_part(doc_id)).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(train_part())))
