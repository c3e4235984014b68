"""SimHash, line dedup, components and mixing against plain versions."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import components as cc
from faultline.llm import linedup, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    data = [(i, t, "en", sources[k] if sources else "s", 0) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_groups(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(n)]
    texts += [t.replace("w1 ", "x ", 1) for t in texts[:25]] + texts[:5] + [t.upper().replace(" ", "\t\n") for t in texts[5:8]]
    texts += [None, "", " \n", "one", "one two", "é à ß", "a" * 50_000]
    return list(enumerate(texts))


def test_fingerprint_equals_the_definition():
    for _, t in corpus():
        assert simhash.fingerprint(t) == plain_print(t)


def test_fingerprint_uses_the_hash_that_the_engine_has(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)
    assert simhash.fingerprint("A  b\tC") == got % (1 << 64)


def test_groups_equal_brute_force(spark):
    docs = corpus()
    out = simhash.near_duplicates(frame(spark, docs).withColumns({"fp": F.lit(1), "root": F.lit("x"), "component_id": F.lit(7)}))
    prints = {i: plain_print(t) for i, t in docs}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    want = plain_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_chains_of_close_prints(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64)]
    for _ in range(40):
        prints.append(prints[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints += [rng.getrandbits(64) for _ in range(20)]
    distinct = sorted(set(prints))
    edges = simhash.links(spark.createDataFrame([(simhash._signed(p),) for p in distinct], "fp long"))
    got = {r.node: r.root for r in cc.components(edges).collect()}
    want = plain_groups(dict(enumerate(distinct)))
    sets = lambda pairs: {frozenset(k for k in pairs if pairs[k] == v) for v in pairs.values()}
    named = {i: got.get(simhash._signed(p), simhash._signed(p)) for i, p in enumerate(distinct)}
    assert sets(named) == sets(want)


def test_repeats_nulls_and_no_rows(spark):
    docs = frame(spark, [(3, "a b c"), (3, "a b c"), (None, "a b c"), (9, None), (8, ""), (None, "q r s")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None)], key=str)
    assert simhash.near_duplicates(docs.filter("false")).count() == 0
    kept = sorted((r.doc_id for r in simhash.keep_one_per_group(docs).collect()), key=str)
    assert kept == sorted([3, 3, None, 8, None], key=str)


@pytest.mark.parametrize("n,m", [(40, 30), (60, 90), (30, 0)])
def test_components_equal_brute_force(spark, n, m):
    rng = random.Random(n)
    edges = [(rng.randrange(n) - 10, rng.randrange(n) - 10) for _ in range(m)] + [(5, 5)]
    root = {i: i for i in range(-10, n)}
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root[i] for a, b in edges for i in (a, b) if root[i] != i}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in cc.components(edges).collect()} == {0}


# line dedup


def plain_lines(docs):
    seen, gone = {}, {}
    for i, t in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if not any(x.strip(" ") for x in window):
                continue
            if window in seen:
                gone.setdefault(i, set()).update((k, k + 1, k + 2))
            seen.setdefault(window, (i, k))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs}


def line_corpus():
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(12)] + ["", " "]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 14)))) for i in range(80)]
    shared = "first\nsecond\nthird\nfourth"
    return docs + [(100 + i, f"head {i}\n{shared}\ntail {i}") for i in range(5)] + [(200, None), (201, ""), (202, "a\nb"), (203, "\n\n\n\n"), (204, "\n\n\n\n"), (205, "x\ny\nz\nx\ny\nz"), (206, "e\r\nf\r\ng\r\n")]


def test_line_dedup_equals_the_plain_version(spark):
    docs = line_corpus()
    out = linedup.dedup_lines(frame(spark, docs).withColumns({"__gone": F.lit(1), "n_lines": F.lit("x"), "key": F.lit(2), "at": F.lit(3)}))
    got = {r.doc_id: r for r in out.collect()}
    want = plain_lines(docs)
    assert {i: r.text for i, r in got.items()} == want
    for i, t in docs:
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)
    assert got[100].n_removed == 0 and got[104].n_removed == 4 and got[205].text == "x\ny\nz" and got[203].text == "\n\n\n\n"


def test_line_dedup_repeats_and_no_rows(spark):
    docs = frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")])
    got = sorted(((r.doc_id, r.text) for r in linedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(None, "a\nb\nc"), (1, ""), (1, ""), (2, "")], key=str)
    assert linedup.dedup_lines(docs.filter("false")).count() == 0


def test_line_dedup_keeps_unrepeated_lines_of_repeated_ids(spark):
    docs = frame(spark, [(1, "p\na1\na2\na3"), (2, "q\na1\na2\na3\nx"), (2, "u1\nu2\nu3\nu4\nu5"), (2, "u1\nu2\nu3\nu4\nu5"), (None, "z\nv1\nv2\nv3\nv4"), (None, "w\na1\na2\na3"), (None, None)])
    got = sorted(((r.doc_id, r.text) for r in linedup.dedup_lines(docs.repartition(3)).collect()), key=str)
    # the null id comes first, so it keeps the shared lines
    assert got == sorted([(1, "p"), (2, "q\nx"), (2, "u1\nu2\nu3\nu4\nu5"), (2, "u1\nu2\nu3\nu4\nu5"), (None, "z\nv1\nv2\nv3\nv4"), (None, "w\na1\na2\na3"), (None, None)], key=str)


# mixing


def plain_mix(docs, slots_at_most=mixing.SLOTS, weights=(5, 2, 1), epochs=3):
    sized = [(i, s, len((t or "").encode().split())) for i, t, s in docs]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s))
    size = {s: sum(n for _, x, n in sized if x == s) for s in names}
    total, target, free = sum(size.values()), {}, set(names)
    block = max(1, -(-total // slots_at_most))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    while free:  # share, stop those above, share the rest anew
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * size[s]}
        if not over:
            target |= share
            break
        target |= {s: epochs * size[s] for s in over}
        free -= over
    ends, run = [], 0.0
    for s in names:
        run += target[s]
        ends.append(run / total if total else 0)
    slots = dict.fromkeys(names, 0)
    for i in range(-(-total // block)):
        point = i * mixing.GOLDEN % 1
        slots[next((s for s, e in zip(names, ends) if point < e), names[-1])] += 1
    taken = {}
    for s in names:
        words, start = min(epochs * size[s], slots[s] * block), 0
        order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, x, n in sized if x == s)
        for _, i, n in order:
            if size[s]:
                taken[i] = words // size[s] * n + max(0, min(words % size[s], start + n) - start)
            else:
                taken[i] = 0
            start += n
    return {i: (n, size[s], target[s], taken[i]) for i, s, n in sized}


def mix_corpus():
    rng = random.Random(4)
    docs = [(i, "w " * rng.randrange(0, 400), rng.choice(["a", "b", "c", "d"] + ["a"] * 6)) for i in range(150)]
    return docs + [(900, "tiny text", "e"), (901, None, "f"), (902, "no source here", None), (903, "Z 1", "Z")]


@pytest.mark.parametrize("slots", [mixing.SLOTS, 500, 7])
def test_mix_equals_the_plain_version(spark, slots):
    docs = mix_corpus()
    df = frame(spark, [(i, t) for i, t, _ in docs], [s for _, _, s in docs]).withColumns({"place": F.lit(1), "size": F.lit("x"), "taken": F.lit(2)})
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df, slots=slots).collect()}
    want = plain_mix(docs, slots)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2] and got[i][2] == pytest.approx(want[i][2]) and got[i][3] == want[i][3]
        assert got[i][3] <= 3 * got[i][0]


def test_stream_takes_what_the_digest_says(spark):
    docs = mix_corpus()
    df = frame(spark, [(i, t) for i, t, _ in docs], [s for _, _, s in docs])
    taken = {r.doc_id: r.taken for r in mixing.mix(df, slots=400).collect() if r.taken}
    out = mixing.stream(df, slots=400).collect()
    per, slots = {}, {}
    for r in out:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.words
        slots[r.slot] = slots.get(r.slot, 0) + r.words
    total = sum(len((t or "").split()) for _, t, _ in docs)
    assert per == taken and max(slots.values()) <= -(-total // 400)


def test_mix_comes_near_its_targets(spark):
    docs = mix_corpus()
    got = mixing.mix(frame(spark, [(i, t) for i, t, _ in docs], [s for _, _, s in docs])).collect()
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(5, 0.01 * mine[0].target)


def test_small_sources_take_their_targets_whatever_the_block(spark, monkeypatch):
    """Few slots, so that a block is longer than the targets of the small sources."""
    monkeypatch.setattr(mixing, "SLOTS", 60)
    docs = mix_corpus() + [(1000 + k, "w " * (3 + 40 * k), f"small{k}") for k in range(8)]
    df = frame(spark, [(i, t) for i, t, _ in docs], [s for _, _, s in docs])
    got = mixing.mix(df).collect()
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
    per = {}
    for r in mixing.stream(df).collect():
        per[r.doc_id] = per.get(r.doc_id, 0) + r.words
    assert per == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_repeats_and_no_rows(spark):
    twice = frame(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    assert [r.taken for r in mixing.mix(twice).orderBy("size", "taken").collect()] == [1, 2, 2]
    assert mixing.mix(twice.filter("false")).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]
