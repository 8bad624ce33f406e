"""Toxicity: a linear-chain conditional random field.

Document labels give a lexicon first: words, and beginnings of words, that are far more common in toxic
documents than in others, by counts over all documents that may be learned from. A token of the lexicon is
labelled toxic where its document is. From such labelled tokens, with those around them, a two-state chain is trained: its features
are the word itself, its beginning, and whether its neighbours are in the lexicon, and its transitions join neighbouring
toxic words into spans. Forward-backward marginals over a whole text give each token's probability; their
sum, the expected number of toxic tokens, gives with the text's length the document's score, by a logistic
curve, and tokens above one half give its offending offsets.

All tokens outside the lexicon that have no neighbour in it have the same potentials, so long runs of them
are passed over in one step, by a power of one matrix: the marginals are those of the whole chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagix.llm.common import discarded, settled, ship, table, train_part

WORD = re.compile(r"\w+")
#: A word of the lexicon is in so many toxic documents at least, and its odds there are so many times those elsewhere;
#: either it is in such a share of them, or chance alone would put so many of its documents among them less often than CHANCE.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, CHANCE = 3, 0.01, 40.0, 1e-9
#: Letters of a beginning; words that are longer have it as a feature, written with a '~'.
BEGIN = 4
#: Documents of each label, by order of a hash, whose tokens the chain is trained on.
TRAIN_DOCS = 1500
WINDOW = 9
ROUNDS, RATE, DECAY = 300, 0.1, 1e-3
THRESHOLD = 0.3


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def units(word: str) -> tuple[str, ...]:
    return (word, f"{word[:BEGIN]}~") if len(word) > BEGIN else (word,)


class Lookup(dict):
    """Word -> its weight, or None outside the lexicon; what was looked up is kept, up to a bound."""

    def __init__(self, lex: dict[str, float]):
        super().__init__()
        self.lex = lex

    def __missing__(self, word: str) -> float | None:
        found = [self.lex[u] for u in units(word) if u in self.lex]
        if len(self) > 400_000:
            self.clear()
        self[word] = got = sum(found) if found else None
        return got


@dataclass
class ToxicModel:
    """words: weight by word or beginning of the lexicon. bias: of the toxic state; near: for each neighbour in the lexicon; step: 2 x 2 transitions, [from, to]."""

    words: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    near: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    lookup: Lookup | None = None
    curve: tuple[float, float, float] = (-4.0, 5.0, 0.0)  # of the score: constant, logarithm of 1 + expected toxic tokens, of 1 + tokens

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(position, probability) of the tokens that are in the lexicon or beside one that is."""
        lex = self.lookup = Lookup(self.words) if self.lookup is None else self.lookup
        hits = [i for i, w in enumerate(words) if lex[w] is not None]
        if not hits:
            return []
        n, inside = len(words), set(hits)
        active = sorted({j for i in hits for j in (i - 1, i, i + 1) if 0 <= j < n})
        step = np.exp(self.step)
        plain = np.array([1.0, np.exp(self.bias)])
        hop = step * plain  # a step to a plain token: [from, to]
        value, vector = np.linalg.eig(hop)
        back = np.linalg.inv(vector)

        def across(v: np.ndarray, k: int, left: bool) -> np.ndarray:
            """v after k plain tokens, from the left or from the right, up to a factor."""
            scale = (value / np.abs(value).max()) ** k
            m = ((vector * scale) @ back).real
            out = np.maximum(v @ m if left else m @ v, 0)
            return out / out.sum()

        def own(i: int) -> np.ndarray:
            near = (i - 1 in inside) + (i + 1 in inside)
            return np.array([1.0, np.exp(min(50.0, self.bias + (lex[words[i]] or 0.0) + self.near * near))])

        e = [own(i) for i in active]
        # Before the first token either state stands with weight 1; so it does after the last.
        a, f = np.ones(2), []
        first = active[0]
        if first > 0:
            a = plain.copy()
            a = across(a / a.sum(), first - 1, True) @ step
        for k, i in enumerate(active):
            if k:
                a = across(a, i - active[k - 1] - 1, True) @ step
            a = a * e[k]
            a = a / a.sum()
            f.append(a)
        b, g = across(np.ones(2), n - 1 - active[-1], False), [None] * len(active)
        for k in range(len(active) - 1, -1, -1):
            g[k] = b
            if k:
                b = step @ (e[k] * b)
                b = across(b / b.sum(), active[k] - active[k - 1] - 1, False)
        return [(i, float((x := f[k] * g[k])[1] / x.sum())) for k, i in enumerate(active)]

    def expected(self, words: list[str]) -> tuple[float, list[int]]:
        """The expected number of toxic tokens, and the positions of those above one half."""
        found = self.marginals(words)
        return sum(p for _, p in found), [i for i, p in found if p > 0.5]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """The score and the (start, end) of the offending spans in characters of the text in lower case."""
        words = words_of(text or "")
        mu, bad = self.expected(words)
        a, b, c = self.curve
        score = float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(mu) + c * np.log1p(len(words)), -30, 30))))
        if not bad:
            return score, []
        at = [m.span() for m in WORD.finditer((text or "").lower())]
        spans: list[list[int]] = []
        last = None
        for i in bad:
            if last is not None and i == last + 1:
                spans[-1][1] = at[i][1]
            else:
                spans.append(list(at[i]))
            last = i
        return score, [tuple(s) for s in spans]


def lexicon(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> dict[str, float]:
    """Words and log-odds, from the documents of each label that hold each word; every labelled document counts once for a word."""
    ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for b in batches:
            for bad, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {u for w in set(words_of(text)) for u in units(w)}:
                    sums.setdefault(w, [0, 0])[bad] += 1
            if len(sums) > 500_000:
                yield _counts(sums)
                sums = {}
        yield _counts(sums)

    known = labelled.where(F.col(text).isNotNull() & F.col(toxic).isin(0, 1)).select(F.col(toxic).cast("int").alias("toxic"), F.col(text).alias("text"))
    totals = known.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return {}
    counts = known.mapInArrow(run, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = (F.col("bad") + 0.25) / (n[1] - F.col("bad") + 0.5) / ((F.col("clean") + 0.25) / (n[0] - F.col("clean") + 0.5))
    # Chernoff's bound: of m documents, so many are toxic by chance with a probability of exp(-evidence) at most.
    share, m = n[1] / (n[0] + n[1]), F.col("bad") + F.col("clean")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (m * F.lit(p)))).otherwise(0.0)
    evidence = part("bad", share) + part("clean", 1 - share)
    found = counts.where((F.col("bad") >= LEAST_DOCS) & ((F.col("bad") >= LEAST_SHARE * n[1]) | (evidence >= -float(np.log(CHANCE))))).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r["word"]: float(np.log(r["odds"])) for r in found.orderBy(F.desc("odds"), "word").collect()}


def _counts(sums: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["word", "clean", "bad"])


def windows(words: list[str], lex: dict[str, float]) -> list[list[str]]:
    """Runs of WINDOW tokens that together hold all of the lexicon's words, and one from the middle."""
    out, end, lookup = [], -1, Lookup(lex)
    for i, w in enumerate(words):
        if i >= end and lookup[w] is not None:
            lo = max(0, i - WINDOW // 2)
            end = lo + WINDOW
            out.append(words[lo:end])
    mid = len(words) // 2
    return [*out, words[mid : mid + WINDOW]]


def features(window: list[str], lex: dict[str, float]) -> list[str]:
    """The window with what the lexicon does not have as '', and a word of which it has only the beginning as that and a blank."""
    return [w if w in lex else f"{w[:BEGIN]} " if any(u in lex for u in units(w)) else "" for w in window]


def train_chain(samples: list[tuple[list[str], int, int]], lex: dict[str, float]) -> ToxicModel:
    """Maximum likelihood with decay, by gradient steps over all windows at once. samples: tokens, whether their document is toxic, and how often there are such."""
    names = sorted(lex)
    place = {w: i for i, w in enumerate(names)}
    samples = [(w[:WINDOW], y, times) for w, y, times in samples if w]
    if not samples or not names:
        return ToxicModel(dict(lex))
    n, times = len(samples), np.array([x[2] for x in samples], float)
    word, mask = np.full((n, WINDOW, 2), len(names)), np.zeros((n, WINDOW), bool)
    y = np.zeros((n, WINDOW), int)
    for k, (tokens, bad, _) in enumerate(samples):
        mask[k, : len(tokens)] = True
        for t, w in enumerate(tokens):
            for f, u in enumerate(units(w)):
                if u in place:
                    word[k, t, f], y[k, t] = place[u], bad
    hit = (word < len(names)).any(2)
    near = np.zeros((n, WINDOW))
    near[:, 1:] += hit[:, :-1]
    near[:, :-1] += hit[:, 1:]
    near *= mask
    theta = {"w": np.zeros(len(names) + 1), "b": np.array([-4.0]), "c": np.zeros(1), "s": np.zeros((2, 2))}
    m1 = {k: np.zeros_like(v) for k, v in theta.items()}
    m2 = {k: np.zeros_like(v) for k, v in theta.items()}
    both = mask[:, 1:]
    for r in range(1, ROUNDS + 1):
        u = np.zeros((n, WINDOW, 2))
        u[..., 1] = theta["b"][0] + theta["c"][0] * near + theta["w"][word].sum(2)
        u[~mask] = 0
        s = theta["s"]
        f, g = np.zeros((n, WINDOW, 2)), np.zeros((n, WINDOW, 2))
        f[:, 0] = u[:, 0]
        for t in range(1, WINDOW):
            on = np.logaddexp(f[:, t - 1, :1] + s[0], f[:, t - 1, 1:] + s[1]) + u[:, t]
            f[:, t] = np.where(mask[:, t, None], on, f[:, t - 1])
        for t in range(WINDOW - 2, -1, -1):
            x = u[:, t + 1] + g[:, t + 1]
            on = np.logaddexp(x[:, :1] + s[:, 0], x[:, 1:] + s[:, 1])
            g[:, t] = np.where(mask[:, t + 1, None], on, g[:, t + 1])
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p1 = np.exp(f[..., 1] + g[..., 1] - z[:, None])
        d = (y - p1) * mask * times[:, None]
        pair = np.exp(f[:, :-1, :, None] + s + (u[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None]) * (both * times[:, None])[..., None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), np.broadcast_to(times[:, None], both.shape)[both])
        grad = {"w": np.bincount(word.ravel(), np.repeat(d.ravel(), 2), len(names) + 1), "b": np.array([d.sum()]), "c": np.array([(d * near).sum()]), "s": seen - pair.sum((0, 1))}
        for k, v in theta.items():
            q = grad[k] / times.sum() - DECAY * v / max(1, v.size)
            m1[k] = 0.9 * m1[k] + 0.1 * q
            m2[k] = 0.999 * m2[k] + 0.001 * q * q
            v += RATE * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.999**r)) + 1e-8)
        theta["w"][-1] = 0.0  # of no feature
    return ToxicModel(dict(zip(names, theta["w"].tolist(), strict=False)), float(theta["b"][0]), float(theta["c"][0]), theta["s"].copy())


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicModel:
    """Lexicon over all labelled documents; the chain on TRAIN_DOCS documents of each label, of which the driver gets the distinct short windows, as their features and counts.

    Where no word tells the labels apart there is nothing to go by but how many documents are toxic, which says
    nothing of any: the model then finds no document toxic.
    """
    lex = lexicon(labelled, text, toxic)
    if not lex:
        return ToxicModel()
    spark = labelled.sparkSession
    sent = spark.sparkContext.broadcast(lex)
    known = labelled.where(F.col(text).isNotNull() & F.col(toxic).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic"))
    ids = known.select("id", "toxic").withColumn("h", F.xxhash64("id", F.lit(5)))
    picked = ids.where("toxic = 1").orderBy("h", "id").limit(TRAIN_DOCS).unionByName(ids.where("toxic = 0").orderBy("h", "id").limit(TRAIN_DOCS)).select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = Counter((y, tuple(features(w, sent.value))) for y, t in zip(bad, texts, strict=True) for w in windows(words_of(t), sent.value))
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([w for _, w in found], pa.list_(pa.string())), pa.array(list(found.values()), pa.int64())], names=["toxic", "window", "times"])

    rows = known.join(F.broadcast(picked), "id").select("toxic", "text").mapInArrow(run, "toxic int, window array<string>, times long").groupBy("toxic", "window").agg(F.sum("times").alias("times")).collect()
    model = train_chain(sorted((list(r["window"]), r["toxic"], r["times"]) for r in rows), lex)
    chain = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chain.value.expected(w)[0] for w in words], pa.float64()), pa.array([len(w) for w in words], pa.int64())], names=["toxic", "mu", "n"])

    seen = known.join(F.broadcast(picked), "id").select("toxic", "text").mapInArrow(sums, "toxic int, mu double, n long").toPandas()
    # Label by label, these rows are a sample: weigh them back to the share of all documents.
    model.curve = fit_curve(seen["toxic"].to_numpy(float), seen["mu"].to_numpy(float), seen["n"].to_numpy(float), known.agg(F.avg("toxic")).first()[0] or 0.0)
    return model


def fit_curve(y: np.ndarray, mu: np.ndarray, n: np.ndarray, share: float) -> tuple[float, float, float]:
    """Logistic regression by Newton's steps with a ridge, rows weighed so that the toxic ones make up share."""
    if not y.sum() or y.all():
        return ToxicModel.curve
    w = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    x = np.stack([np.ones_like(mu), np.log1p(mu), np.log1p(n)], 1)
    t = np.zeros(3)
    ridge = np.diag([1e-6, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        t = t + np.clip(np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ t), -2, 2)
    return tuple(map(float, t))


def score_toxicity(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, spans (character offsets in the lower-case text).

    Only the text is read, to its end. Null and empty texts get the score of a text without any token;
    repeated rows stay repeated; ids may be null. Extra columns are not read, whatever their names. Without
    labels the lexicon is empty and no text reaches the threshold. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sent.value.score(x) for x in b.column(2).to_pylist()]
            score = [s for s, _ in out]
            spans = [[{"start": x, "end": y} for x, y in z] for _, z in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(spans, spans_type)], names=[f.name for f in schema.fields])

    return docs.select(F.col(doc_id).alias("doc_id"), (~train_part(doc_id)).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text stays below the threshold; null and empty texts stay."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([sent.value.score(x)[0] < THRESHOLD for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the documents that have labels and may be learned from; of several labels of one id the largest counts."""
    known = labels.where(train_part() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels grow with the documents, so they are not broadcast at any size; each text moves once, and what trains reads the table.
    joined = docs.select("doc_id", "text").where(train_part() & F.col("text").isNotNull()).join(known.hint("merge"), "doc_id")
    return settled(joined, "labelled")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = labelled_documents(docs, table(spark, sf_dir, "labels"))
    model = fit(labelled)
    discarded(labelled)
    return score_toxicity(docs, model).withColumn("n_spans", F.size("spans")).select("doc_id", "held_out", "score", "predicted", "n_spans")
