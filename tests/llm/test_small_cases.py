"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator; and brute force on small tables."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagix.llm import ann, fingerprints, langid, licenses, lines, mixing, packing, simhash, tokens, toxicity
from passagix.llm.common import settled, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, fingerprint string, line_no int, item int, shard int"
TOKENIZER = tokens.public("byte_bpe_50k.json")


def table(spark, rows):
    extra = (1, "x", "y", 2, 3, 4)
    return spark.createDataFrame([(i, t, lang, s, n, *extra) for i, t, lang, s, n in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeéüß", k=rng.randint(1, 7))) for _ in range(300)]
    line = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))
    out = []
    for i in range(60):
        out.append((i, "\n".join(line() for _ in range(rng.randint(1, 8))), rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), 5))
    base = out[3][1]
    out += [(60, base, "en", "a", 1), (61, base + " end", "en", "a", 1), (62, None, None, None, None), (63, "", "en", "b", 0), (None, "one two\nthree", "fr", "a", 3), (64, "  \n\t\n", "en", "b", 3), (64, "  \n\t\n", "en", "b", 3)]
    out += [(65, "Released under the MIT License. " * 3, "en", "a", 4), (66, "word " * 30000, "en", "b", 150000), (67, "<|endoftext|> GNU General Public License", "en", "b", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return settled(table(spark, texts).repartition(3), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_licenses(docs, none, texts):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(texts) and licenses.scan_licenses(none).count() == 0
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for i, t, *_ in texts:
        w = word.findall((t or "").lower())
        at, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == sorted(want, key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in got)


def test_license_notice_with_a_word_changed(spark):
    notice = licenses.NOTICES[9][1]
    w = notice.split()
    d = spark.createDataFrame([(1, "before it " + notice + " and after"), (2, " ".join([*w[:8], "very", *w[8:]])), (3, " ".join(w[:6]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(d).collect()}
    assert got[1] == ("bsd", 1.0) and got[2][0] == "bsd" and 0.8 <= got[2][1] < 1 and got[3][0] == "" and 0 < got[3][1] < 0.8


def test_license_notice_with_stray_words_of_its_own(spark):
    """Words put in elsewhere vote for other diagonals, which stand between those of the copy by place; they take nothing from it."""
    label, notice = licenses.NOTICES[1]
    w = notice.split()
    plain = list(w)
    plain[12] = plain[70] = "filler"
    plain.insert(45, "filler")
    overlapping = " ".join(licenses.NOTICES[7][1].split()[:-1] + licenses.NOTICES[8][1].split())
    d = spark.createDataFrame([(1, " ".join(plain)), (2, " ".join([*w[:40], *w[8:13], "filler", *w[45:]])), (3, overlapping), (4, " ".join([notice] * 3))], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"].split(","), r["score"], r["n_spans"]) for r in licenses.scan_licenses(d).collect()}
    n = len(re.findall('[a-z0-9]+', notice.lower())) - 3
    assert label in got[1][0] and label in got[2][0] and got[2][1] == pytest.approx((n - 9) / n)
    assert {"agpl", "lgpl"} <= set(got[3][0]) and got[4] == ([label], 1.0, 3)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[50:80] = x[49]
    rows = [(i, [float(v) for v in r], "z") for i, r in enumerate(x)]
    rows += [(1000, None, "z"), (1001, [0.0] * 16, "z"), (1002, [float("nan")] * 16, "z"), (1003, [None, 1.0] * 8, "z"), (None, [1.0] * 16, "z"), (1020, [float("inf")] * 16, "z"), (1040, [1.0, 2.0], "z"), (1041, [1.0, 1.0], "z")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    got = {}
    for r in ann.nearest(v, k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {*range(0, 400, 20), 1040} and [got[1040][k][0] for k in got[1040]] == [1041]
    hits = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        assert len(got[q]) == 5 and all(abs(s[i] - c) < 1e-12 for i, c in got[q].values())
        hits += len(set(want) & {i for i, _ in got[q].values()})
    assert hits / 100 >= 0.9
    # Of thirty equal vectors the smallest ids, and not the query itself.
    assert [got[60][k][0] for k in range(1, 6)] == [49, 50, 51, 52, 53]
    assert ann.nearest(v.limit(0), k=5).count() == 0


def test_neighbours_of_repeated_rows_and_of_few(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (40, [0.5, 0.5])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20).collect():
        got.setdefault(r["query_id"], set()).add((r["rank"], r["vec_id"], r["score"]))
    # Fewer than k: all others, and a query is never its own neighbour.
    assert got == {20: {(1, 3, 2.0), (2, 40, 0.5), (3, 4, 0.0)}, 40: {(1, 3, 1.0), (2, 4, 0.5), (3, 20, 0.5), (4, 20, 0.5)}}


def _clusters(rng):
    """Tight clusters, and lone queries off all of them."""
    centres = rng.normal(size=(8, 64))
    x = centres[rng.integers(8, size=1500)] + 0.05 * rng.normal(size=(1500, 64))
    x[::150] = rng.normal(size=(10, 64))
    return x


@pytest.mark.parametrize("kind", ["lengths", "few long", "clusters", "fifteen"])
def test_neighbours_are_all_there(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(15 if kind == "fifteen" else 1500, 64))
    if kind == "lengths":
        x *= rng.lognormal(sigma=0.5, size=(1500, 1))
    elif kind == "few long":
        x[::10] *= 3
    elif kind == "clusters":
        x = _clusters(rng)
    every = 5 if kind == "fifteen" else 150
    # Several units, and cells of several blocks.
    monkeypatch.setattr(ann, "BLOCK", 100)
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), every=every).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, len(x), every):
        s = x @ x[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [got[q][k] for k in range(1, len(want) + 1)] == want and len(got[q]) == len(want)


def test_mixing(spark, docs, none, texts):
    got = mixing.mix_plan(docs).select("doc_id", "text", "source", "size_", "source_size", "target", "taken").collect()
    assert len(got) == len(texts) and mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    words = re.compile("[^\x20\x09-\x0d]+")
    sums, taken = {}, {}
    for r in got:
        n = len(words.findall(r["text"] or ""))
        assert r["size_"] == n and 0 <= r["taken"] <= 2 * n
        sums[r["source"]] = sums.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, open_, rest = {}, set(order), 1.5 * sum(sums.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sums[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * sums[s]
            rest -= goal[s]
        open_ -= over
    goal |= {s: level * weight[s] for s in open_}
    assert all(r["source_size"] == sums[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) for r in got)
    assert all(abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in order)
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    m = mixing.mix(docs)
    assert m.columns == [*docs.columns, "copy", "shard_", "place"] and m.where("shard_ < 0 or shard_ > 7").count() == 0


def test_dealt_blocks_decide_what_is_taken(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 90 + 1)), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    whole = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs).collect()}
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a).where("shard < 4"))
    half = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs).collect()}
    assert all(half[i] <= whole[i] for i in whole) and 0.3 < sum(half.values()) / sum(whole.values()) < 0.7


def test_another_seed_draws_other_blocks(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 90 + 1)), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    one, two = ({r["doc_id"]: (r["taken"], r["shards"]) for r in mixing.mix_plan(docs, seed=seed).collect()} for seed in (17, 18))
    assert one.keys() == two.keys() and sum(one[i] != two[i] for i in one) > 200
    # What is left out lies in whole blocks all over the source, not behind one place of its order.
    order = [r["doc_id"] for r in docs.where("source = 'c'").select("doc_id", mixing.order_of("doc_id", "text", 17).alias("h")).orderBy("h").collect()]
    size = lambda i: i % 90 + 1
    partly = [one[i][0] < size(i) * 2 for i in order] if any(one[i][0] > size(i) for i in order) else [one[i][0] == 0 for i in order]
    assert sum(a != b for a, b in zip(partly, partly[1:], strict=False)) > 3
    shards = {r["shard"] for r in mixing.mix(docs).collect()}
    assert shards == set(range(8))


def test_pipeline_keeps_the_order_of_shards(spark, docs):
    import corpus_pipeline

    want = [r["doc_id"] for r in mixing.mix(docs).orderBy("shard_", "place").collect()]
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns and [r["doc_id"] for r in got.collect()] == want


def test_hypergeometric_split_is_exact(spark):
    q = spark.createDataFrame([("a", 1000), ("b", 37), (None, 0), ("c", 512)], "source string, quota long")
    rows = mixing.split_quotas(q, 3, 5).collect()
    by_source, by_shard = {}, {}
    for r in rows:
        by_source[r["at"]] = by_source.get(r["at"], 0) + r["quota"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["quota"]
    assert by_source == {0: 1000, 1: 37, 2: 512, 3: 0} and max(by_shard.values()) - min(by_shard.values()) <= 3
    from pyspark.sql import functions as F

    n = 4000
    draws = spark.range(n).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(20).cast("long"), (F.col("id") + 0.5) / n).alias("k")).agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert draws["m"] == pytest.approx(6, abs=0.01) and draws["v"] == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.02)


def test_languages(spark, docs, none):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lang = ("en", "fr", "de")[i % 3]
        stems = {"en": ["the", "thing", "with", "ation"], "fr": ["le", "eau", "été", "oux"], "de": ["der", "sch", "über", "ung"]}[lang]
        rows.append((i, " ".join("".join(rng.choices(stems, k=2)) for _ in range(30)), lang))
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(known.where("doc_id < 120"))
    got = {r["doc_id"]: r for r in langid.identify(known, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows if i >= 120) >= 78
    assert got[7]["held_out"] == (zlib.crc32(b"7") % 4 == 2)
    odd = {r["doc_id"]: r for r in langid.identify(docs, model).where("doc_id >= 62").collect()}
    assert odd[62]["lang_pred"] == odd[63]["lang_pred"] == odd[64]["lang_pred"] == "und" and odd[66]["lang_pred"] != "und"
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.codewords(5).shape[0] == 5 and len({tuple(w) for w in langid.codewords(30)}) == 30


def test_languages_by_brute_force(spark):
    """Counts of n-grams from plain slices, then bits, losses and the nearest codeword, by their formulas."""
    rows = [(1, "Der Hund läuft 12 mal", "de"), (2, "the dog runs, the cat too", "en"), (3, "le chien  court", "fr"), (4, None, "en"), (5, "no language", None), (6, "the end", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)

    def grams(text):
        b = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in f" {text.lower()} ".encode())
        b = re.sub(b" +", b" ", b)
        return [[(int.from_bytes(b[i : i + n], "big") * 2654435761 % (1 << 32)) >> 18 for i in range(len(b) - n + 1)] for n in langid.ORDERS]

    langs = ["de", "en", "fr"]
    counts = np.full((3, len(langid.ORDERS), langid.BUCKETS), langid.SMOOTH)
    for _, t, lang in rows:
        if t is not None and lang is not None:
            for o, g in enumerate(grams(t)):
                for x in g:
                    counts[langs.index(lang), o, x] += 1
    assert model.languages == langs
    p = counts / counts.sum(2, keepdims=True)
    for text in ("der Hund", "the cat", "court le", "zzz"):
        losses = []
        found = grams(text)
        n = sum(map(len, found))
        for word in model.code:
            loss = 0.0
            for j in range(model.code.shape[1]):
                ratio = np.log(p[model.code[:, j] == 1].mean(0) / p[model.code[:, j] == 0].mean(0))
                total = sum(ratio[o, x] for o, g in enumerate(found) for x in g)
                margin = langid.SHARPNESS * total / np.sqrt(n)
                loss += model.weight[j] * np.log1p(np.exp(-(1 if word[j] else -1) * margin))
            losses.append(loss / model.weight.sum())
        e = np.exp(-np.array(losses))
        assert model.scores(text) == pytest.approx(e / e.sum(), rel=1e-4)
        assert model.predict(text)[0] == langs[int(np.argmin(losses))]
    # Languages of the same texts tie: the smaller name is said, with a flag.
    twins = langid.fit(spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string"))
    assert twins.predict("same")[0] == "a" and twins.predict("same")[2]


def test_chain_marginals_are_exact():
    import itertools

    m = toxicity.ToxicModel({"bad": 6.0, "worse": 3.0}, -5.0, 1.0, np.array([[0.3, -0.2], [-0.5, 0.9]]))
    for text in ("a b bad c d e f worse bad g", "bad", "x y z worse", "bad x x x x bad", "worse bad"):
        w = text.split()
        n, total, p = len(w), 0.0, np.zeros(len(w))
        own = [m.bias + m.words.get(x, 0) + m.near * sum(0 <= j < n and w[j] in m.words for j in (i - 1, i + 1)) for i, x in enumerate(w)]
        for y in itertools.product((0, 1), repeat=n):
            v = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(m.step[y[i - 1], y[i]] for i in range(1, n)))
            total, p = total + v, p + v * np.array(y)
        assert all(abs(p[i] / total - q) < 1e-9 for i, q in m.marginals(w))


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        w = rng.choices(vocabulary, k=40)
        if bad:
            for x in rng.sample(range(40), 3):
                w[x] = rng.choice(["slur", "insult", "threat"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (300, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_documents(d, y))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) / len(held) > 0.95
    s = next(got[i] for i in range(0, 300, 5) if got[i]["spans"])
    assert all(any(w in rows[s["doc_id"]][1][a:b] for w in ("slur", "insult", "threat")) for a, b in s["spans"])
    assert got[300]["predicted"] == got[301]["predicted"] == 0
    assert {r["doc_id"] for r in toxicity.reject_toxic(d, model).collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score_toxicity(none, model).count() == 0
    odd = toxicity.score_toxicity(docs, model).collect()
    assert len(odd) == docs.count() and sum(r["doc_id"] == 64 for r in odd) == 2 and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in odd) and kept.where("doc_id is null or doc_id in (62, 63)").count() == 3
    long = spark.createDataFrame([(1, "w1 " * 40000 + "slur insult threat slur"), (2, "w1 " * 40000)], "doc_id long, text string")
    far = {r["doc_id"]: r for r in toxicity.score_toxicity(long, model).collect()}
    assert far[1]["score"] > far[2]["score"] and far[1]["spans"][0]["start"] >= 120_000 and not far[2]["spans"]
    assert {r["predicted"] for r in toxicity.score_toxicity(d, toxicity.fit(toxicity.labelled_documents(d, y.limit(0)))).collect()} == {0}


def test_lexicon_has_what_few_of_many_toxic_documents_hold(spark):
    from pyspark.sql import functions as F

    bad = F.col("id") < 1000
    text = F.concat(F.when(F.col("id") < 9, "vile ").otherwise(""), F.when(bad, "slur ").otherwise(""), F.lit("w"), F.col("id") % 50)
    lex = toxicity.lexicon(spark.range(20_000).select(text.alias("text"), bad.cast("int").alias("toxic")))
    assert set(lex) == {"slur", "vile"}


def test_training_windows_hold_the_whole_text():
    words = [f"slur{i}" if i % 100 == 50 else "w" for i in range(3000)]
    lex = {"slur~": 3.0, "slur50": 3.0}
    found = toxicity.windows(words, lex)
    assert {w for x in found for w in x} == {"w", *(f"slur{i}" for i in range(50, 3000, 100))}
    assert toxicity.features(["slur50", "slur150", "w"], lex) == ["slur50", "slur ", ""]
    samples = [(toxicity.features(w, lex), 1) for w in found] + [(["", "", ""], 0)] * 40
    counted = {}
    for w, y in samples:
        counted[tuple(w), y] = counted.get((tuple(w), y), 0) + 1
    one = toxicity.train_chain([(w, y, 1) for w, y in samples], lex)
    many = toxicity.train_chain([(list(w), y, n) for (w, y), n in counted.items()], lex)
    assert len(counted) < len(samples) and one.words == pytest.approx(many.words) and one.step == pytest.approx(many.step) and one.bias == pytest.approx(many.bias)


def _components(bits, max_bits=3):
    f = np.array(bits, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= max_bits
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return label.tolist()
        label = new


def _plain_simhash(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_of_simhash_by_their_formula(texts):
    some = [t for _, t, *_ in texts if t is None or len(t) < 5000] + ["ÀB Ⅷ İ ßẞ one", "a\u00a0b c\x1fd e", "x y"]
    assert [simhash.fingerprint_of(t) for t in some] == [_plain_simhash(t) for t in some]


def test_simhash(docs, none, texts):
    got = sorted(simhash.simhash_components(docs).collect(), key=lambda r: str(r["doc_id"]))
    rows = sorted(texts, key=lambda r: str(r[0]))
    bits = [simhash.fingerprint_of(t) for _, t, *_ in rows]
    assert [r["fingerprint"] for r in got] == [f"{b:016x}" for b in bits]
    label = _components(bits)
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    assert [r["component_id"] for r in got] == [least[c] for c in label]
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.simhash_components(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_large_group_of_near_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_GROUP", 16)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    bits = {base ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(300)} | {int(x) for x in rng.integers(1 << 62, size=100)}
    bits = sorted(b - (1 << 64) if b >> 63 else b for b in bits)
    df = spark.createDataFrame([(b,) for b in bits], "fingerprint_bits long")
    roots = {r["v"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    label = _components([b & (1 << 64) - 1 for b in bits])
    groups = {}
    for b, c in zip(bits, label, strict=True):
        groups.setdefault(c, set()).add(roots.get(b, b))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_token_counts(spark, docs, none, texts, tmp_path):
    from tokenizers import Tokenizer

    cache = str(tmp_path / "cache")
    whole = Tokenizer.from_file(TOKENIZER)
    want = sorted((str(i), len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in texts)
    for _ in range(2):
        got = tokens.count_tokens(docs, cache, TOKENIZER)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
        # The second run finds every digest in the cache.
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in texts})
    assert got.where("over_limit != (n_tokens > 512)").count() == 0
    assert tokens.count_tokens(none, str(tmp_path / "none"), TOKENIZER).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_encoders_equal_their_libraries(name, texts):
    path = tokens.public(name)
    some = [t for _, t, *_ in texts if t is not None and len(t) < 3000] + ["a  b   \n\n c\t ", "it's 12345 x_y ½ 日本語 🙂 é", "    x", " " * 5000 + "a", "don't'll  "]
    encode = tokens.encoder(path)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        want = [t.encode(x, add_special_tokens=False).ids for x in some]
    elif name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(some)
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(TOKENIZER)
        t.encode_special_tokens = True
        want = [t.encode(x, add_special_tokens=False).ids for x in some]
    assert [encode(x).tolist() for x in some] == want


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER).collect()
    assert packing.pack(none, TOKENIZER).count() == 0
    want = {}
    for i, t, *_ in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            key = (i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    fill = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for x in fill.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= packing.LENGTH
    total = sum(n for x in fill.values() for _, n in x)
    assert len(fill) <= -(-total // packing.LENGTH) + 1


def test_crossovers_do_not_lose_pieces():
    rng = np.random.default_rng(3)
    sizes = rng.integers(300, 1100, 400).tolist()
    plain: tuple[list, list] = ([], [])
    packing.best_fit(sizes, list(range(400)), *plain, 2048)
    labels = packing.evolve(sizes, [], (1, 2), 2048, crossovers=150)
    fill = np.bincount(labels, weights=sizes)
    assert fill.max() <= 2048 and len(labels) == 400 and len(fill) <= len(plain[1])
    other = packing.from_labels(sizes, packing.evolve(sizes, [], (1, 3), 2048, crossovers=5))
    child, fills = packing.crossover(sizes, plain, other, rng, 2048)
    assert sorted(x for b in child for x in b) == list(range(400)) and fills == [sum(sizes[i] for i in b) for b in child]
    assert packing.cut(1) == [(0, 1)] and packing.cut(4096) == [(0, 2048), (2048, 2048)] and packing.cut(2049) == [(0, 1), (1, 2048)]


def test_islands_keep_what_they_bred_and_beat_best_fit(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sizes = rng.integers(500, 1100, 700).tolist()
    plain: tuple[list, list] = ([], [])
    packing.best_fit(sizes, list(range(700)), *plain, 2048)
    crossed = []
    monkeypatch.setattr(packing, "crossover", lambda *a, f=packing.crossover: crossed.append(1) or f(*a))
    first = packing.evolved(sizes, [], (1, 0), 2048, crossovers=150)
    assert len(crossed) == 150 and len(first) == packing.POPULATION
    after = packing.evolved(sizes, first, (1, 1), 2048, crossovers=150)
    bins = lambda labels: max(labels) + 1
    assert bins(after[0]) <= bins(first[0]) <= len(plain[1]) and bins(after[0]) < len(plain[1])
    parts = lambda population: {frozenset(map(frozenset, packing.from_labels(sizes, x)[0])) for x in population}
    assert parts(packing.evolved(sizes, first, (1, 1), 2048, crossovers=0)) == parts(first)
    rows = spark.createDataFrame(list(enumerate(sizes)), "item long, length int")
    packed = packing.pack_items(rows, crossovers=60).join(rows, "item").groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert len(packed) <= len(plain[1]) and max(r[1] for r in packed) <= 2048


def test_fingerprints(docs, none, texts):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert fingerprints.fingerprint_edits(none).count() == 0 and len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    rows = sorted(((i, t or "") for i, t, *_ in texts), key=lambda x: (x[0] is not None, x[0] or 0))
    for k, (i, t) in enumerate(rows):
        if i == 64:
            continue
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = by_id[i]
        a, b, c = (fingerprints.sketch(x) for x in (t, edited, after))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.to_text(a), fingerprints.to_text(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    assert by_id[3]["fingerprint"] == by_id[60]["fingerprint"]


def test_fingerprints_hand_on_by_bytes(monkeypatch):
    monkeypatch.setattr(fingerprints, "BATCH_BYTES", 1 << 16, raising=False)
    rng = random.Random(8)
    rows = [" ".join(str(rng.random()) for _ in range(800)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"range": [1] * 201, "last": [0] * 200 + [1], "doc_id": [*range(200), 0], "text": [*rows, rows[0]]})
    out = list(fingerprints._edits(iter([batch.slice(0, 150), batch.slice(150)])))
    assert max(b.nbytes for b in out) < 1 << 17
    got = pa.Table.from_batches(out).to_pydict()
    assert got["doc_id"] == list(range(200))
    assert got["fingerprint"] == [fingerprints.to_text(fingerprints.sketch(t)) for t in rows]
    assert got["near_next"] == [fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b)) for a, b in zip(rows, [*rows[1:], rows[0]], strict=True)]


def test_fingerprint_ranges_write_no_table_and_share_no_task(spark):
    files = lambda: sum(p.is_file() for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*"))
    docs = settled(spark.range(400).selectExpr("id as doc_id", "repeat(cast(id as string), 5) as text"), "docs")
    before = files()
    got = fingerprints.fingerprint_edits(docs).groupBy(F.spark_partition_id()).count().collect()
    assert files() == before
    assert len(got) == 4 and all(90 <= r["count"] <= 110 for r in got)


def test_ranges_of_ids(spark):
    rows = spark.range(100).selectExpr("id", "id >= 30 as known")
    ids, hashes = [40, 50, 60, 75, 90], [5, 10, 20]
    got = {r["id"]: r["range"] for r in fingerprints._numbered(rows, hashes, ids).collect()}
    assert all(got[i] == (sum(b < i for b in ids) + 4 if i >= 30 else sum(b < i for b in hashes)) for i in range(100))


def test_sketches_merge_and_contain():
    rng = random.Random(6)
    w = [f"w{i}" for i in range(4000)]
    long = " ".join(rng.choices(w, k=20000))
    part = " ".join(long.split()[5000:6000])
    a, b = fingerprints.sketch(long), fingerprints.sketch(part)
    assert fingerprints.containment(b, a) == 1.0 and fingerprints.likeness(a, b) < 0.1
    assert 0.08 < len(a) / 20000 < 0.17 and (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    assert set(fingerprints.merged(a, b)) == set(a)
    # The sketch of texts side by side but for shingles across the seam, by sets of shingles; short ones fall back on their smallest hash.
    import xxhash

    shingles = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    for _ in range(60):
        s, t = (" ".join(rng.choices(w, k=rng.randint(1, 14))) for _ in range(2))
        hashes = sorted({xxhash.xxh3_64_intdigest(x.encode(), 0) for x in shingles(s) | shingles(t)})
        under = [h for h in hashes if h < (1 << 64) // 8]
        assert fingerprints.merged(fingerprints.sketch(s), fingerprints.sketch(t)).tolist() == (under or hashes[:1])
    assert fingerprints.likeness(fingerprints.sketch(""), fingerprints.sketch(None)) == 1.0 and len(fingerprints.sketch("x")) == 1


def test_lines(docs, none, texts):
    got = lines.removed_lines(docs).collect()
    assert lines.removed_lines(none).count() == 0 and lines.dedup_lines(none).count() == 0 and len(got) == len(texts)
    order = []
    for k, (i, t) in enumerate(sorted({(i, t) for i, t, *_ in texts if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))):
        order += [(i, k, n, frozenset(x.lower().split())) for n, x in enumerate(t.split("\n"))]
    gone = {}
    for p, (i, _, n, s) in enumerate(order):
        if s and any(len(s & r) * 9 >= 4 * (len(s) + len(r)) for *_, r in order[:p] if r):
            gone.setdefault(i, []).append(n)
    for r in got:
        assert r["removed"] == ",".join(map(str, gone.get(r["doc_id"], []))) and r["n_removed"] == len(gone.get(r["doc_id"], []))
    by_id = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    for i, t, *_ in texts:
        assert by_id[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, [])))


def test_group_of_variants_of_a_line(spark):
    rng = random.Random(8)
    base = [f"k{i}" for i in range(20)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.sample(range(20), rng.randint(0, 3)):
            w[j] = f"v{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(t.split()) for _, t in rows]
    want = {i for i in range(120) if any(len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])) for j in range(i))}
    got = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.where("n_removed = 1").collect()} == want


def test_shared_folder_is_the_sessions(spark):
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == shared_dir(spark) == (said or shared_dir(spark)).rstrip("/")


def test_nothing_else_imports_the_subpackage():
    top = Path(__file__).resolve().parents[2]
    for p in (top / "passagix").rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "passagix.llm" not in p.read_text()


def test_rarity_stands_in_no_plan(docs, monkeypatch):
    """The driver keeps many copies of each plan's text."""
    sizes = []

    def seen(df, name, **options):
        sizes.append(len(df._jdf.queryExecution().toString()))
        return settled(df, name, **options)

    monkeypatch.setattr(lines, "settled", seen)
    lines.removed_lines(docs)
    assert sizes and max(sizes) < 200_000


def test_words_of_lines_with_odd_blanks(spark):
    texts = ["a B c", " a b", "a b ", "a  b", "\ta\x0bb\x0c", "a\r", "\x0b", " ", "", "é a b", "\x0b x", "a \t b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["line"]: r["w"] for r in lines.split_lines(docs, "doc_id", "text").select("line", lines.words_of("line").alias("w")).collect()}
    assert got == {t: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts if t.strip(lines.BLANKS)}


def test_sets_are_not_sorted_to_move(docs, monkeypatch):
    plans = []

    def seen(df, name, **options):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if name == "sets" else [])
        return settled(df, name, **options)

    monkeypatch.setattr(lines, "settled", seen)
    lines.removed_lines(docs)
    assert len(plans) == lines.PARTS and all("ShuffledHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_long_lines_that_share_little_do_not_meet(spark):
    """Some 150 words each, of 600: prefixes share words, and sets differ in far more words than 64 bits can show."""
    rng = random.Random(5)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(600)], rng.randint(140, 160))) for _ in range(80)]
    # Near copies, round the length from which parities are wider, and on both sides of it.
    for n in (*range(82, 100, 2), 150, 180):
        base = [f"n{n}_{i}" for i in range(n)]
        texts += [" ".join(base), " ".join([*base[: n - 8], *(f"x{n}_{i}" for i in range(rng.randint(0, 12)))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = settled(lines.line_classes(docs), "classes")
    every = settled(lines.postings(classes, lines.rarity(classes)), "postings")
    pairs = every.alias("x").join(every.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.c1") < F.col("y.c1")))
    sets = [frozenset(t.split()) for t in texts]
    close = lambda i, j: len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j]))
    similar = sum(close(i, j) for i in range(len(sets)) for j in range(i))
    met = pairs.where(lines._may_match()).select("x.c1", "y.c1").distinct().count()
    assert pairs.select("x.c1", "y.c1").distinct().count() > 1000 and similar <= met <= similar + 20
    got = lines.removed_lines(docs).where("n_removed = 1").collect()
    assert {r["doc_id"] for r in got} == {i for i in range(len(sets)) if any(close(i, j) for j in range(i))}


def test_marks_of_classes_that_met(spark):
    met = settled(spark.range(0, 40000, 2).selectExpr("xxhash64(id) as c1"), "met")
    marks, marked = lines._marks(met)
    classes = spark.range(40000).selectExpr("id", "xxhash64(id) as c1").withColumn("marks", marks.scalar())
    got = {r["id"] for r in classes.where(marked).collect()}
    assert set(range(0, 40000, 2)) <= got and len(got) < 28000
