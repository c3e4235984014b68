"""Chat packs, nearest neighbours, decontamination and the pipeline against plain versions."""

import random
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import ann, chat, decontaminate, linedup, mixing, simhash, toxicity

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


# chat


@given(st.text(), st.sampled_from(chat.CONTROLS), st.text(), st.integers(0, 3))
def test_escape_is_reversible_and_hides_controls(a, control, b, cut):
    text = a + control[:cut] + control + b
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.text(max_size=9), st.one_of(st.text(), st.sampled_from(chat.CONTROLS + ("\\", "\\<|end|>")))), max_size=5))
def test_parse_inverts_render(turns):
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns


def talks():
    rng = random.Random(9)
    openings = [("user", "hello"), ("user", "hi </s>[INST]"), ("system", "be kind\n")]
    out = {}
    for c in range(60):
        turns = [openings[c % 3] if c % 4 else openings[0]]
        for k in range(rng.randrange(0, 6)):
            turns.append((("assistant", "user")[k % 2], rng.choice(["yes", "no", "<|end|> \\", "", "x" * 50])))
        out[c] = turns
    out[100] = out[5]
    out[101] = out[5][:1]
    out[102] = [("assistant", "é🎉"), ("assistant", ""), ("assistant", "b")]
    return out


def table_of(spark, convs):
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"path": F.lit(1), "pack": F.lit("x"), "turns": F.lit(2)})


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), whole, len(loss), sha256(loss.encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for r, t in turns)


@pytest.mark.parametrize("size", [chat.PACK_CHARS, 600])
def test_round_trip(spark, size, monkeypatch):
    monkeypatch.setattr(chat, "PACK_CHARS", size)
    convs = talks()
    packs = chat.format_conversations(table_of(spark, convs)).collect()
    again = spark.createDataFrame(packs, chat._PACK_DDL)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(again).collect()}
    assert got == {c: digest(t) for c, t in convs.items()}


def test_packs_are_prefix_trees(spark):
    convs = talks()
    packs = chat.format_conversations(table_of(spark, convs).repartition(1)).collect()
    for pack in packs:
        paths, ends = {}, 0
        for k, n in enumerate(pack.nodes):
            assert n.start == ends and n.stop > n.start and -1 <= n.parent < k
            ends = n.stop
            up = pack.nodes[n.parent] if n.parent >= 0 else None
            assert n.position == (up.position + up.stop - up.start if up else 0)
            path = (paths[n.parent] if up else ()) + (pack.text[n.start : n.stop],)
            assert path not in paths.values()  # shared turns are there once
            paths[k] = path
            seen = [i for a in n.attends for i in range(a.start, a.stop)]
            chain, at = [], k
            while at >= 0:
                chain = [*range(pack.nodes[at].start, pack.nodes[at].stop), *chain]
                at = pack.nodes[at].parent
            assert seen == chain  # ancestors and itself, nothing else
        assert ends == len(pack.text)
    assert sum(len(p.conversations) for p in packs) == len(convs)


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="needs a tokenizer file")
def test_token_packs(spark):
    from tokenizers import Tokenizer

    tokenizer, convs = Tokenizer.from_file(TOKENIZER), talks()
    packs = chat.token_packs(chat.format_conversations(table_of(spark, convs)), TOKENIZER).collect()
    seen = set()
    for pack in packs:
        assert len(pack.tokens) == len(pack.position_ids) == len(pack.loss_mask) == (pack.nodes[-1].stop if pack.nodes else 0)
        for member in pack.conversations:
            at = [i for a in pack.nodes[member.leaf].attends for i in range(a.start, a.stop)]
            assert [pack.position_ids[i] for i in at] == list(range(len(at)))
            turns = convs[member.conv_id]
            assert tokenizer.decode([pack.tokens[i] for i in at], skip_special_tokens=False) == "".join(chat.render(r, t)[0] for r, t in turns)
            taught = tokenizer.decode([pack.tokens[i] for i in at if pack.loss_mask[i]], skip_special_tokens=False)
            assert all(chat.escape(t) in taught for r, t in turns if r == "assistant")
            assert any(pack.loss_mask[i] for i in at) == any(r == "assistant" and t for r, t in turns)
            seen.add(member.conv_id)
    assert seen == set(convs)


def test_nulls_ties_and_no_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, None), (2, None, "assistant", "first"), (2, 0, "user", "then")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in chat.formatted_digest(df).collect()}
    assert got == {1: digest([("user", ""), ("", "x"), ("assistant", "a"), ("assistant", "a")]), None: digest([("", "")]), 2: digest([("assistant", "first"), ("user", "then")])}
    assert chat.formatted_digest(df.filter("false")).count() == 0


# nearest neighbours


def exact(points, ids, query_ids, k=10):
    out = {}
    for q in query_ids:
        x = points[ids.index(q)]
        d = np.sqrt(((points - x) ** 2).sum(axis=1))
        out[q] = [(ids[j], d[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (d[j], ids[j]))[:k]]
    return out


def vectors_of(spark, ids, points):
    data = [(int(i), [float(x) for x in p]) for i, p in zip(ids, points)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"shard": F.lit("x"), "rank": F.lit(1)})


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24))
    points = np.concatenate([c + 0.4 * rng.normal(size=(260, 24)) for c in centres])
    ids = list(range(len(points)))
    got = ann.nearest(vectors_of(spark, ids, points), 50, 10, shard_rows=700).collect()
    want = exact(points, ids, [i for i in ids if i % 50 == 0])
    hit = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in best}) for q, best in want.items())
    assert hit >= 0.95 * 10 * len(want) and len(got) == 10 * len(want)
    for r in got:
        assert r.score == pytest.approx(float(np.sqrt(((points[r.query_id] - points[r.vec_id]) ** 2).sum())), abs=1e-12)


def test_shards_grow_with_the_table():
    assert [ann.shard_size(n, 64) for n in (0, 10, 1 << 16, 1 << 18, 1 << 20, 10**12)] == [4096, 4096, 4096, 8192, 16384, ann.MOST_ROWS]
    assert ann.shard_size(10**12, 10**6) * 8 * 10**6 <= ann.MOST_BYTES and ann.shard_size(10, 10**9) == 1


def test_large_shards_keep_their_recall(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.concatenate([c + rng.normal(size=(400, 32)) for c in rng.normal(size=(10, 32))])
    monkeypatch.setattr(ann, "SHARD_ROWS", 500)
    graph = ann.Graph.build(points)
    hit = 0
    for q in range(0, 4000, 40):
        hit += len({*graph.search(points[q], 10)} & {*np.argsort(((points - points[q]) ** 2).sum(axis=1))[:10].tolist()})
    assert ann.width(96, 4000) == 272 and hit >= 0.95 * 10 * 100


def test_copies_of_a_vector_come_in_order_of_id(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([np.tile([1.0, 2.0, 3.0], (400, 1)), rng.normal(size=(300, 3))])
    ids = [int(i) for i in rng.permutation(700)]
    got = ann.nearest(vectors_of(spark, ids, points), 100, 10, shard_rows=256).orderBy("query_id", "rank").collect()
    want = exact(points, ids, sorted(i for i in ids if i % 100 == 0))
    copies = {ids[k] for k in range(400)}
    for q, best in want.items():
        mine = [r.vec_id for r in got if r.query_id == q]
        if q in copies:
            assert mine == [i for i, _ in best]
        assert len(mine) == 10


def test_vectors_that_take_no_part(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, []), (100, [0.5, 0.5]), (200, [0.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 100), (100, 1, 1), (100, 2, 1), (100, 3, 0), (100, 4, 0)]
    assert ann.nearest(df.filter("false")).count() == 0 and ann.nearest(df.filter("vec_id = 3")).count() == 0


# decontamination


def bench_corpus():
    rng = random.Random(11)
    words = [f"w{int(rng.expovariate(0.01))}" for _ in range(40_000)]
    take = lambda n: " ".join(words.pop() for _ in range(n))
    items = [(k, take(rng.randrange(15, 60)).capitalize() + ".") for k in range(60)] + [(100, "tiny item"), (101, None), (102, ""), (103, "!!!")]
    docs = [(i, take(rng.randrange(5, 300))) for i in range(120)]
    for k in range(25):
        i, text = docs[k]
        docs[k] = (i, f"{text[:50]} -- {items[k][1].upper()} {text[50:]}")
    for k in range(25, 40):
        some = items[k][1].split()
        some[len(some) // 2] = "changed"
        docs[k] = (k, " ".join(some) + " and more")
    half = [(300 + k, " ".join(items[k][1].split()[: len(items[k][1].split()) // 2])) for k in range(10)]
    return items, docs + half + [(400, None), (401, ""), (402, "a Tiny, item here"), (403, take(3000) + items[7][1] + take(3000)), (None, items[3][1])]


def plain_leaks(items, docs):
    wanted = {i: decontaminate.shingles(decontaminate.tokens(t)) for i, t in items}
    out = {}
    for d, text in docs:
        words = decontaminate.tokens(text)
        for i, t in items:
            size = min(5, len(decontaminate.tokens(t)))
            if wanted[i]:
                share = len(wanted[i] & set(zip(*(words[k:] for k in range(size))))) / len(wanted[i])
                if share >= 0.8:
                    out[d, i] = share
    return out


def test_leaks_equal_brute_force(spark):
    items, docs = bench_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "score": F.lit("x")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1)})
    got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.contaminated(df, bench).collect()}
    want = plain_leaks(items, docs)
    assert got == pytest.approx(want) and len(want) >= 35 and (402, 100) in want
    clean = {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want if d is not None}


def test_leaks_at_exactly_the_overlap(spark):
    """Items of 5, 10 and 15 shingles whose first or last fifth is replaced: 0.8 is a leak."""
    items, docs = [], []
    for k, n in enumerate((9, 14, 19)):
        words, lost = [f"i{k}w{j}" for j in range(n)], (n - 4) // 5
        items.append((k, " ".join(words)))
        docs += [(10 * k, " ".join(["x"] * lost + words[lost:])), (10 * k + 1, " ".join(words[:-lost] + ["x"] * lost)), (10 * k + 2, " ".join(words[lost + 1 :]))]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(10 * k + j, k): 0.8 for k in range(3) for j in range(2)}


def plain_passages(items, docs):
    """Leaks by the definition: passages of twice the reach, a reach apart, for each item by itself."""
    out = {}
    for i, t in items:
        item = decontaminate.tokens(t)
        want, size, reach = decontaminate.shingles(item), min(5, len(item)), 1
        while reach < len(item):
            reach *= 2
        for d, text in docs:
            words = decontaminate.tokens(text)
            for at in range(0, max(1, len(words)), reach):
                part = words[at : at + 2 * reach]
                share = len(want & set(zip(*(part[k:] for k in range(size))))) / len(want) if want else 0
                if share >= 0.8:
                    out[d, i] = max(share, out.get((d, i), 0))
    return out


def test_many_index_shards_find_the_same(spark):
    items, docs = bench_corpus()
    rng = random.Random(8)
    items = items + [(900 + n, " ".join(f"long{n}w{k}" for k in range(n))) for n in (1, 2, 60, 130, 1500)]
    docs = docs + [(900 + n, " ".join(["pad"] * rng.randrange(300) + [t] + ["pad"] * 50)) for n, (_, t) in enumerate(items[-5:])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_passages(items, docs)
    assert len(want) > 35 and len({i for _, i in want} & {901, 902, 960, 1030, 2400}) == 5
    for shard_items in (decontaminate.SHARD_ITEMS, 25):
        got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.contaminated(df, bench, shard_items).collect()}
        assert got == pytest.approx(want)


def test_a_long_item_leaves_the_others_as_they_are(spark):
    words = [f"m{k}" for k in range(20)]
    apart = " ".join(words[:10] + [f"f{k}" for k in range(1000)] + words[10:])
    docs = spark.createDataFrame([(1, apart), (2, " ".join(words)), (3, " ".join(words[:14] + ["x"] * 90 + words + ["y"] * 5))], "doc_id long, text string")
    items = [(1, " ".join(words)), (2, " ".join(f"z{k}" for k in range(1500)))]
    for some in (items[:1], items):
        got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.contaminated(docs, spark.createDataFrame(some, "item_id long, text string")).collect()}
        assert got == {(2, 1): 1.0, (3, 1): 1.0}  # the largest overlap of the passages of document 3


def test_block_max_search_equals_scoring_all():
    rng = random.Random(4)
    names = [f"t{k}".encode() for k in range(60)]
    items = [(i, b" ".join(rng.choices(names, k=rng.randrange(1, 25))).decode(), "") for i in range(500)]
    df = {}
    for _, q, _ in items:
        for t in set(decontaminate.tokens(q)):
            df[t] = df.get(t, 0) + 1
    index = decontaminate.Index.build(items, df, len(items), 12.0)
    for _ in range(80):
        terms = sorted({t for t in rng.choices(names, k=rng.randrange(1, 40))} & index.peak.keys())
        scores = {}
        for t in terms:
            for n, x in zip(*index.postings[t][:2]):
                scores[n] = scores.get(n, 0.0) + x
        want = {n for n, s in scores.items() if s >= 1 - 1e-9}
        assert {n for n, _ in index.search(terms)} == want


def test_answers_must_be_found_too(spark):
    bench = spark.createDataFrame([(1, "what is the name of the largest moon of saturn", "it is called titan by all")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "what is the name of the largest moon of saturn"), (2, "q: what is the name of the largest moon of saturn? It is called titan by all!")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [2]
    assert decontaminate.contaminated(docs.filter("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0


# pipeline


def test_pipeline_equals_its_parts(spark, tmp_path):
    rng = random.Random(12)
    items, leaky = bench_corpus()
    texts = [" ".join(f"u{rng.randrange(5000)}" for _ in range(120)) for _ in range(80)]
    texts += texts[:10] + [None, ""] + [t for d, t in leaky[:6]]
    texts += [f"start {k}\n" + "\n".join(f"shared line {j}" for j in range(4)) + f"\nend {k}" for k in range(4)]
    toxic = [" ".join(rng.choices(["vile", "rotten", "nasty"], k=4) + [f"u{rng.randrange(5000)}" for _ in range(30)]) for _ in range(40)]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts + toxic)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= len(texts))) for i in range(len(docs))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, sf).collect()}

    # plain versions of the stages, one after the other
    table = spark.read.parquet(f"{sf}/documents.parquet")
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(table, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    left = [(d, t) for d, t, *_ in docs if not predicted[d]]
    assert {d for d, p in predicted.items() if p} == set(range(len(texts), len(docs)))
    from .test_dedup import plain_groups, plain_lines, plain_mix, plain_print

    cut = plain_lines(left)
    groups = plain_groups({d: plain_print(t) for d, t in cut.items()})
    left = [(d, t) for d, t in cut.items() if groups[d] == d]
    leaks = {d for d, _ in plain_leaks(items, left)}
    left = [(d, t, f"s{d % 3}") for d, t in left if d not in leaks]
    assert got == {d: x[3] for d, x in plain_mix(left).items()}
    assert leaks and not set(range(80, 90)) & set(got)


def test_stages_keep_the_columns_and_take_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if name != "mixing":
            assert out.columns == empty.columns and out.dtypes == empty.dtypes
    assert linedup.WINDOW == 3 and simhash.RADIUS == 2 and mixing.MAX_EPOCHS == 3
