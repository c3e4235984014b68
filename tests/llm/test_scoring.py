"""Toxicity, quality, language-model scores and language identification against plain versions."""

import random
import time
import zlib
from collections import Counter, defaultdict
from math import exp, log, log10, sqrt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import exchange, langid, lm, quality, toxicity

DOCS = "doc_id long, text string, lang string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# toxicity


def toxic_corpus(n=600):
    rng = random.Random(1)
    plain, bad = [f"w{k}" for k in range(300)], ["vile", "rotten", "nasty"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=40)
        toxic = i % 5 == 0
        if toxic:
            words[3:6] = rng.choices(bad, k=3)
        docs.append((i, " ".join(words).capitalize() + ".", "en"))
        labels.append((i, int(toxic)))
    return docs, labels


def plain_vectors(examples, weights):
    """``examples``: (id, toxic, text) -> (term weights, {id: unit vector}, base share), by the definition."""
    mass = {i: weights[y] for i, y, _ in examples}
    every, base = sum(mass.values()), sum(mass[i] for i, y, _ in examples if y) / sum(mass.values())
    n, hits = defaultdict(float), defaultdict(float)
    for i, y, text in examples:
        for t in set(toxicity.words(text)):
            n[t] += mass[i]
            hits[t] += mass[i] * y
    weight = {}
    for t in n:
        share, z2 = hits[t] / n[t], toxicity.SURE**2
        low = (share + z2 / (2 * n[t]) - toxicity.SURE * sqrt(share * (1 - share) / n[t] + z2 / (4 * n[t] ** 2))) / (1 + z2 / n[t])
        weight[t] = log((every + 1) / (n[t] + 1)) * max(toxicity.FLOOR, (low - base) / (1 - base))
    return weight, {i: plain_vector(weight, text) for i, _, text in examples}, base


def plain_vector(weight, text):
    raw = {t: (1 + log(n)) * weight[t] for t, n in Counter(toxicity.words(text)).items() if t in weight}
    norm = sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()} if norm > 0 else {}


def plain_vote(weight, vectors, labels, weights, base, text):
    q = plain_vector(weight, text)
    found = sorted((-round(sum(x * v.get(t, 0.0) for t, x in q.items()), 9), i) for i, v in vectors.items())
    found = [(i, -s) for s, i in found[: toxicity.NEIGHBOURS] if s < 0]
    votes = [(weights[labels[i]] * s * s, labels[i]) for i, s in found]
    share = (sum(v for v, y in votes if y) + toxicity.SMOOTH * base) / (sum(v for v, _ in votes) + toxicity.SMOOTH)
    return [i for i, _ in found], share


def test_nearest_equal_brute_force():
    rng = random.Random(7)
    names = [f"t{min(int(rng.expovariate(0.08)), 400)}" for _ in range(4000)]
    examples = [(i, int(rng.random() < 0.3), " ".join(rng.choices(names, k=rng.randrange(0, 40)) + ["vile"] * (i % 9 == 0))) for i in range(900)]
    examples = [(i, 1 if "vile" in t else y, t) for i, y, t in examples]
    examples += [(5000 + k, 0, examples[1][2]) for k in range(20)]  # ties
    found = [Counter(toxicity.words(t)) for _, _, t in examples]
    terms = sorted({t for c in found for t in c})
    code = {t: k for k, t in enumerate(terms)}
    example = np.array([k for k, c in enumerate(found) for _ in c])
    index = toxicity.Index(np.array([i for i, _, _ in examples]), np.array([y for _, y, _ in examples]), terms, example, np.array([code[t] for c in found for t in c]), np.array([n for c in found for n in c.values()], float), (2.0, 1.0))
    assert (index.row >= 0).sum() > 10  # some terms are common, so blocks are passed over by their bounds
    weight, vectors, base = plain_vectors(examples, (2.0, 1.0))
    labels = {i: y for i, y, _ in examples}
    for k in range(150):
        query = examples[1][2] if k == 0 else " ".join(rng.choices(names, k=rng.randrange(1, 40)) + ["vile"] * (k % 4 == 0))
        want, share = plain_vote(weight, vectors, labels, (2.0, 1.0), base, query)
        assert [int(index.ids[n]) for n, _ in index.nearest(query)] == want
        assert index.vote(query)[0] == pytest.approx(share, abs=1e-7)


def test_toxicity_scores_equal_a_plain_version(spark):
    docs, labels = toxic_corpus(300)
    df, marks = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df.repartition(3), marks).collect()}
    aside = {r.doc_id for r in df.filter(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(toxicity.CALIBRATE)) == 0).collect()}
    kept = [(i, labels[i][1], t) for i, t, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    weights = (1.0, 1.0)  # all labelled documents are in the sample
    inside = [x for x in kept if x[0] not in aside]
    weight, vectors, base = plain_vectors(inside, weights)
    votes = {i: plain_vote(weight, vectors, dict(labels), weights, base, t)[1] for i, t, _ in docs}
    x = {i: log(min(max(v, 1e-3), 1 - 1e-3) / (1 - min(max(v, 1e-3), 1 - 1e-3))) for i, v in votes.items()}
    fold = [(x[i], y) for i, y, _ in kept if i in aside]

    def loss(a, b):
        return sum(log(1 + exp(-(a * v + b) if y else a * v + b)) for v, y in fold) + ((a - 1) ** 2 + b * b) / 2 * toxicity.PULL

    a, b, step = 1.0, 0.0, 0.5
    while step > 1e-6:  # descent by coordinates: the loss is convex
        best = min(((loss(a + i * step, b + j * step), i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        a, b, step = (a + best[1] * step, b + best[2] * step, step) if best[1] or best[2] else (a, b, step / 2)
    assert len(got) == 300
    for i, r in got.items():
        assert r.vote == pytest.approx(votes[i], abs=1e-7)
        assert r.score == pytest.approx(1 / (1 + exp(-(a * x[i] + b))), abs=1e-4)


def test_toxicity_is_calibrated_and_repeatable(spark):
    rng = random.Random(5)
    docs, labels = toxic_corpus(1500)
    labels = [(i, int(rng.random() < (0.9 if y else 0.05))) for i, y in labels]  # noisy labels: no score is certain
    docs += [(7, "another text of id seven", "en"), (7, None, "en")]
    df, marks = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    runs = [{(r.doc_id, r.held_out): r.score for r in toxicity.toxicity(df.repartition(k), marks).filter("doc_id <> 7").collect()} for k in (1, 7)]
    assert runs[0] == runs[1]
    truth = dict(labels)
    for lo, hi in ((0.0, 0.5), (0.5, 1.01)):
        part = [(s, truth[i]) for (i, held), s in runs[0].items() if held and lo <= s < hi]
        assert abs(sum(s for s, _ in part) - sum(y for _, y in part)) < 0.1 * len(part) + 2


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus()
    df = frame(spark, docs + [(900, None, "en"), (901, "", "en"), (902, "vile " * 20_000, "en"), (None, "rotten thing", "en"), (5, docs[5][1], "en")])
    out = toxicity.toxicity(df.withColumns({"score": F.lit("x"), "toxic": F.lit(3)}), spark.createDataFrame(labels + [(None, 1), (3, 7), (77, None)], "doc_id long, toxic int"))
    got = out.collect()
    assert len(got) == len(docs) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    for i, toxic in labels:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].predicted == toxic
    assert by[900].predicted == by[901].predicted == 0 and by[902].predicted == 1 and by[None].predicted == 1
    assert by[0].evidence and by[0].evidence[0].toxic == 1


def test_toxicity_without_labels_or_rows(spark):
    df = frame(spark, [(1, "a b", "en"), (2, None, "en")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(df, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(df.filter("false"), none).count() == 0
    assert toxicity.keep_civil(df, none).count() == 2


# language-model scores


def lm_corpus():
    rng = random.Random(3)
    words = [f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(6000)]
    docs = [(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(120)]
    return docs + [(500, None), (501, ""), (502, "Unseen WORDS here"), (503, "w1 " * 3000), (None, "w1 w2")]


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_base_scores_and_counts(spark):
    docs = lm_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"block": F.lit(1), "tokens": F.lit("x")})
    out = {r.doc_id: r for r in lm.lm_scores(df, block_tokens=500).collect()}
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in docs}
    c = Counter(t for i, text in docs if not held[i] for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    for i, text in docs:
        r, t = out[i], tokens_of(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(x in c for x in t), n)
        assert r.base_score == pytest.approx(sum(log10((c[x] + 1) / (n + v + 1)) for x in t))
    fresh = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_scores_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame(lm_corpus(), "doc_id long, text string")
    stored = [exchange.blocks(df.select("doc_id", F.lit(True).alias("learned"), "text"), n) for n in (300, 10**9)]
    weights = np.tile([0.5, 0.4, 0.1], (lm.BUCKETS, 1))
    got = []
    for s in stored:
        a = exchange.answers(s, 200)
        distinct, total = exchange.totals(a)
        out = exchange.joined(s, a, lambda b, w, p, t=total, d=distinct: lm.scores(b, w, p, t, d, weights), lm._SCORES)
        got.append({r.doc_id: r.score for r in out.collect()})
    assert got[0] == pytest.approx(got[1])
    docs = lm_corpus()
    uni, pair = Counter(), Counter()
    for _, text in docs:
        t = tokens_of(text)
        uni.update(t)
        pair.update(zip([b"\n", *t], t))
    n, v = sum(uni.values()), len(uni)
    for i, text in docs:
        t = tokens_of(text)
        want = sum(log10(0.5 * pair[a, b] / uni[a] + 0.4 * uni[b] / n + 0.1 / (v + 1)) for a, b in zip([b"\n", *t], t))
        assert got[0][i] == pytest.approx(want)


def test_weights_are_learned_on_all_blocks(spark):
    """Many blocks and one block give the same scores, as every event counts."""
    df = spark.createDataFrame(lm_corpus(), "doc_id long, text string")
    got = [{r.doc_id: r.score for r in lm.lm_scores(df, block_tokens=n).collect()} for n in (100, 10**9)]
    assert got[0] == pytest.approx(got[1])


def test_scores_do_not_depend_on_partitions(spark):
    """Learned weights and more than eight blocks: the same scores to the last digit but for the order of a text's sum."""
    df = spark.createDataFrame(lm_corpus(), "doc_id long, text string")
    got = [{r.doc_id: r.score for r in lm.lm_scores(df.repartition(k), block_tokens=200).collect()} for k in (2, 5, 50)]
    assert got[0] == pytest.approx(got[1], rel=1e-12) and got[0] == pytest.approx(got[2], rel=1e-12)


def test_learned_scores_equal_a_plain_version(spark):
    """Deleted interpolation by the definition, with every event by itself in EM."""
    docs = [(i, t) for i, t in lm_corpus() if i != 503]
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), block_tokens=700).collect()}
    learned = [tokens_of(t) for i, t in docs if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2]
    uni, pair = Counter(), Counter()
    for t in learned:
        uni.update(t)
        pair.update(zip([b"\n", *t], t))
    n, floor = sum(uni.values()), 1 / (len(uni) + 1)
    bucket = lambda c: min(lm.BUCKETS - 1, c.bit_length()) if c else 0
    events = []
    for t in learned:
        own, twos = Counter(t), Counter(zip([b"\n", *t], t))
        for a, b in zip([b"\n", *t], t):
            context = uni[a] - own[a]
            events.append((bucket(context), (pair[a, b] - twos[a, b]) / context if context else 0.0, (uni[b] - own[b]) / (n - len(t)), floor))

    def fit(rows, start):
        shares, weights = np.array([r[1:] for r in rows]), np.array(start)
        for _ in range(lm.EM_STEPS):
            parts = shares * weights
            weights = (parts / parts.sum(axis=1)[:, None]).mean(axis=0)
            weights = np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum()
        return weights

    every = fit(events, [0.4, 0.5, 0.1])
    weights = {k: fit([e for e in events if e[0] == k], every) if any(e[0] == k for e in events) else every for k in range(lm.BUCKETS)}
    weights[0] = np.array([0, *(weights[0][1:] + weights[0][0] * weights[0][1:] / weights[0][1:].sum())])
    for i, text in docs:
        t, want = tokens_of(text), 0.0
        for a, b in zip([b"\n", *t], t):
            w = weights[bucket(uni[a])]
            want += log10(w[0] * (pair[a, b] / uni[a] if uni[a] else 0) + w[1] * uni[b] / n + w[2] * floor)
        assert got[i] == pytest.approx(want, rel=5e-3)


def test_model_is_a_distribution(spark):
    """Over every known word, the end and one unknown word, the mixture sums to 1 after any seen context."""
    uni = {b"a": 5, b"b": 3, b"\n": 2}
    total, distinct = 10, 3
    one = lm.FINE  # of a half: cells hold the sums of their events' logarithms
    weights = lm.learn_weights(np.array([[3, 4, 8, 20, 20 * one, 40 * one], [3, -1, 6, 5, 0, 5 * one * 3 // 2], [1, -1, -1, 2, 0, 0]]), 1 / (distinct + 1))
    assert weights.sum(axis=1) == pytest.approx(1) and weights[0, 0] == 0
    pair = {b"a": 2, b"b": 2, b"\n": 1}
    mass = sum(weights[3, 0] * pair[w] / 5 + weights[3, 1] * uni[w] / total + weights[3, 2] / 4 for w in uni) + weights[3, 2] / 4
    assert mass == pytest.approx(1)


def test_scores_of_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lm.lm_scores(df.filter("false")).count() == 0


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (exchange.unpack_sorted(exchange.pack_sorted(keys)) == keys).all()
    for kind in (np.int32, np.int64):
        x = rng.integers(0, 1000, 77).astype(kind)
        assert (exchange.unpack(exchange.pack(x), kind) == x).all()


# quality


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney, straight from its definition, as a function of (a, b, c)."""
    three = Counter()
    for t in texts:
        w = ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
        three.update(zip(w, w[1:], w[2:]))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def cuts(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        d = [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.0 for k in (1, 2, 3)]
        return lambda v: d[min(v, 3) - 1]

    def level(counts, lower):
        cut, total, spare = cuts(counts), defaultdict(int), defaultdict(float)
        for g, v in counts.items():
            total[g[:-1]] += v
            spare[g[:-1]] += cut(v)

        def p(g):
            ctx = g[:-1]
            if ctx not in total:
                return lower(g[1:])
            v = counts.get(g, 0)
            return (v - (cut(v) if v else 0)) / total[ctx] + spare[ctx] / total[ctx] * lower(g[1:])

        return p

    single = {(c,): v for c, v in one.items()}
    return level(dict(three), level(dict(two), level(single, lambda g: 1 / (len(one) + 1))))


def test_perplexity_equals_the_plain_model(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.expovariate(0.3))}" for _ in range(1500)]
    texts = [" ".join(words[k : k + 30]) for k in range(0, 1500, 30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = quality.train(df)
    p = plain_kneser_ney(texts)
    asked = texts[:5] + ["w0 w1 w0 new words", "", None, "new"]
    out = quality.perplexities(spark.createDataFrame(list(enumerate(asked)), "k long, text string"), model).orderBy("k").collect()
    for r, t in zip(out, asked):
        w = ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
        want = -sum(log10(p(g)) for g in zip(w, w[1:], w[2:])) / (len(w) - 2)
        assert r.log10_ppl == pytest.approx(want, rel=1e-4)


def test_table_finds_every_key():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 20, 5000)).astype(np.uint64) << np.uint64(12)
    table = quality.Table(keys, np.zeros((len(keys), 1)))
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()


def test_classify(spark):
    rng = random.Random(6)
    good = lambda lang: " ".join(f"{lang}{min(int(rng.expovariate(0.1)), 40)}" for _ in range(60))
    rows = [(i, good("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(400)]
    junk = [(1000 + i, " ".join("".join(rng.choices("xyz%", k=9)) for _ in range(60)), "en") for i in range(20)]
    odd = [(2000, None, None), (2001, "", "fr"), (None, good("en"), "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000, 0), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    df = frame(spark, rows + junk + odd + rows[:1]).withColumns({"keep": F.lit(1), "own": F.lit(2), "n": F.lit(3)})
    got = quality.classify(df, labels, trusted=150).collect()
    assert len(got) == len(rows) + len(junk) + len(odd) + 1
    keep = {r.doc_id: r.keep for r in got}
    assert not any(keep[i] for i, _, _ in junk) and sum(keep[i] for i, _, _ in rows) > 0.95 * len(rows)
    assert all(r.keep for r in quality.classify(df, labels.filter("false")).collect())
    assert quality.classify(df.filter("false"), labels).count() == 0


def test_quality_of_repeated_ids_is_repeatable(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(40)), "en") for i in range(200)]
    rows += [(i, f"another text of {i}", "en") for i in range(0, 200, 3)] + [(4, None, "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    runs = []
    for k in (1, 6):
        got = quality.classify(frame(spark, rows).repartition(k), labels, trusted=50).collect()
        runs.append(sorted((r.doc_id, r.n_tokens, round(r.perplexity, 6), r.keep) for r in got))
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    few = quality.classify(frame(spark, rows), labels, trusted=50, chars=500).collect()  # a bound on characters trains on less
    assert len(few) == len(rows) and {round(r.perplexity, 6) for r in few} != {x[2] for x in runs[0]}


def test_quality_keeps_good_and_rejects_bad_documents(spark):
    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("needs the standard tables")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id: r.keep for r in quality.classify(docs.select("doc_id", "lang", "text"), labels.select("doc_id", "quality")).collect()}
    marks = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in kept]
    good, bad = ([kept[i] for i, q in marks if q == v] for v in (1, 0))
    assert sum(good) >= 0.95 * len(good) and (not bad or sum(bad) <= 0.4 * len(bad))


# languages


def plain_bundle(text):
    """Sum over letter trigrams of the product of their letters' vectors, each rolled by its place (in words of 64 dimensions)."""
    kept, last = [], False
    for c in (text or "").lower():
        if c.isalpha():
            kept.append(ord(c))
        elif last:
            kept.append(0)
        last = c.isalpha()
    if not kept:
        return np.zeros(langid.DIMENSIONS)
    codes = [0, *kept, 0]
    total = np.zeros(langid.DIMENSIONS)
    for gram, n in Counter(zip(codes, codes[1:], codes[2:])).items():
        g = np.ones(langid.DIMENSIONS)
        for j, point in enumerate(gram):
            g = g * langid.signs(np.roll(langid.letter_bits(np.array([point])), j, axis=1))[0]
        total += n * g
    return total


def test_vectors_equal_the_definition():
    texts = ["Ab, c", "über Straße—naïve", None, "", "1 2 3!", "Привет, мир", "\U00030000\U00030001 x", "\U0001f3f4\U000e0067\U000e0062", "a"]
    got, known = langid.Profiler().bundles(texts)
    assert (got == np.array([plain_bundle(t) for t in texts])).all()
    assert known.tolist() == [True, True, False, False, False, True, True, False, True]
    vectors = langid.signs(langid.letter_bits(np.arange(2000)))
    assert np.abs(vectors @ vectors.T / langid.DIMENSIONS - np.eye(2000)).max() < 0.2  # every letter its own


def test_long_and_short_texts_count_alike():
    """Three million characters in one text, and in a group with others."""
    profiler, piece = langid.Profiler(), "one two three four "
    times = 3_000_000 // len(piece)
    one, two = (profiler.bundles([piece * k])[0][0] for k in (1, 2))
    long = profiler.bundles(["x", piece * times, None])[0][1]
    assert (long == one + (times - 1) * (two - one)).all()


def test_predictions_equal_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(SAID[lang].split(), k=rng.randrange(1, 9))), lang) for i, lang in enumerate(rng.choices(list(SAID), k=120))]
    docs += [(500, "\U0001f3f4\U000e0067\U000e0062", "en"), (501, "\U00030000", None), (502, "日本語 テキスト", None)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, docs).repartition(5)).collect()}
    names = sorted({lang for _, _, lang in docs if lang})
    sums = {lang: sum(plain_bundle(t) for i, t, x in docs if x == lang and zlib.crc32(str(i).encode()) % 5) for lang in names}
    for i, t, _ in docs:
        v = plain_bundle(t)
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = [round(float(v @ sums[x]) / np.linalg.norm(v) / np.linalg.norm(sums[x]), 9) for x in names]
        assert got[i].lang_pred == names[int(np.argmax(cosines))] and got[i].score == pytest.approx(max(0.0, *cosines), abs=1e-8)


SAID = {"en": "the house and the garden are in the old town with their trees", "de": "das haus und der garten sind in der alten stadt mit ihren bäumen", "fr": "la maison et le jardin sont dans la vieille ville avec leurs arbres"}


def test_identify(spark):
    rng = random.Random(8)
    docs = []
    for i in range(300):
        lang = rng.choice(list(SAID))
        docs.append((i, " ".join(rng.choices(SAID[lang].split(), k=25)), lang))
    odd = [(900, None, "en"), (901, "", None), (902, "123 !?", "en"), (903, "Привет мир", None), (904, SAID["fr"] * 2000, None), (None, SAID["de"], "de")]
    out = langid.identify(frame(spark, docs + odd + docs[:1]).withColumns({"score": F.lit(2), "lang_pred": F.lit(1)})).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(docs) + len(odd) + 1 and all(0 <= r.score <= 1 for r in out)
    held = [(i, lang) for i, _, lang in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i, _ in held)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[904].lang_pred == "fr" and got[903].lang_pred in SAID
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "text", None)])).collect()} == {"und"}
    assert langid.identify(frame(spark, docs).filter("false")).count() == 0


def test_whole_model_equals_the_model_in_memory(spark):
    """Shards answer what a task's own copy of the model would; unknown words, empty and null texts included."""
    texts = spark.createDataFrame([("a b c a b d",), ("a b c",), ("b c e e",), ("",)], "text string")
    asked = [(1, "en", "a b c a b d"), (2, None, None), (3, "fr", ""), (4, "en", "x a b y c e e"), (None, "en", "b c"), (4, "en", "e " * 50)]
    docs = spark.createDataFrame(asked, "doc_id long, lang string, text string")
    want = sorted(((r.doc_id, r.lang, r.n_tokens), r.log10_ppl) for r in quality.perplexities(docs.na.fill({"doc_id": -1, "lang": ""}), quality.train(texts)).collect())
    for tokens, entries in ((1 << 20, 1 << 20), (4, 8)):
        got = quality.whole_perplexities(docs, texts, tokens, entries).na.fill({"doc_id": -1, "lang": ""}).collect()
        got = sorted(((r.doc_id, r.lang, r.n_tokens), r.log10_ppl) for r in got)
        assert [k for k, _ in got] == [k for k, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-5)


def test_quality_trains_on_every_trusted_document(spark):
    """A word that one trusted text in 5,000 has is known, wherever the text's id falls in the order of hashes."""
    ids = [i for i, in spark.range(5000).filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "en", "rare bird sings" if i == ids[-1] else "the common text") for i in range(5000)] + [(9000, "en", "rare bird sings"), (9001, "en", "none such here")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5000)], "doc_id long, quality int")
    got = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).filter("doc_id >= 9000").collect()}
    assert got[9000] < 0.9 * got[9001]


def test_quality_in_rounds_equals_one_round_and_leaves_no_shuffles(spark):
    """Rounds bound the disk: each round's messages and shuffle files are gone when the next one starts, and scores stay the same."""
    rng = random.Random(21)
    rows = [(i, "en", " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(30))) for i in range(60)] + [(60, None, None), (None, "en", "w1 w2"), (3, "de", "w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    texts = docs.filter("doc_id % 2 = 0").select("text")
    scores = lambda df: sorted((r.doc_id or -1, r.lang or "", r.n_tokens, round(r.log10_ppl, 9)) for r in df.collect())
    whole = scores(quality.whole_perplexities(docs, texts))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in str(disk.getAllFiles().mkString(",")).split(",") if "shuffle_" in f}
    before, left, make = shuffles(), [], quality._blocks

    def settled(*args):
        """Learning and each round of scoring begin here; files are deleted in the background."""
        for _ in range(100):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        left.append(len(shuffles() - before))
        return make(*args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "_blocks", settled)
        got = scores(quality.whole_perplexities(docs, texts, 100, 500, 300))
    assert got == whole and len(got) == len(rows)
    assert len(left) > 3 and not any(left)


def test_postings_of_common_words_are_not_read(monkeypatch):
    """Words that a quarter of the examples have are added last, for the examples that they can still raise."""
    example = np.array([k for k in range(200)] + [k for k in range(200) if k % 4])
    code = np.array([k for k in range(200)] + [200] * 150)
    terms = [f"t{k}" for k in range(200)] + ["common"]
    index = toxicity.Index(np.arange(200), np.arange(200) // 4 % 2, terms, example, code, np.ones(350), (1.0, 1.0)).ready()
    read, add = [], index._add
    monkeypatch.setattr(index, "_add", lambda *a: read.append(int((a[-2] - a[-3]).sum())) or add(*a))
    found = index.nearest("common t9 t8")
    assert sum(read) == 2 and {n for n, _ in found[:2]} == {int(np.flatnonzero(index.ids == k)[0]) for k in (8, 9)} and len(found) == toxicity.NEIGHBOURS
