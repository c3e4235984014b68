"""The pipeline's near-copy stage against brute force on five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
from faultline.llm import nearcopies


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(docs):
    """Ids that are the smallest of their component; only whole texts without words equal each other with no shingle."""
    sets, root = {i: plain_shingles(t) for i, t in docs}, {i: i for i, _ in docs}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def edited(rng, text, spots):
    words = text.split()
    for at in rng.sample(range(len(words)), spots):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_corpus():
    rng = random.Random(6)
    base = [" ".join(rng.choices([f"w{k}" for k in range(3000)], k=200)) for _ in range(30)]
    texts = base + [edited(rng, t, n) for t in base[:20] for n in (1, 2, 3, 4, 6, 10)]
    for _ in range(40):  # a large group whose members differ from each other more than from the first
        texts.append(edited(rng, base[29], 3))
    return list(enumerate(texts + [base[3].upper(), None, "", "one two", "ONE two", "one"]))


def test_near_copies_equal_brute_force(spark):
    docs = near_corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.keep_one_copy(spark, df, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == plain_kept(docs)
    assert not set(range(30, 150, 6)) & set(kept)  # one changed word in 200


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (9, None), (8, ""), (None, "q r s")], "doc_id long, text string")
    kept = sorted((r.doc_id for r in nearcopies.keep_one_per_group(df).collect()), key=str)
    assert kept == sorted([3, 3, None, 8, None], key=str)
    assert nearcopies.keep_one_per_group(df.filter("false")).count() == 0


def test_a_copy_takes_no_other_text_of_its_id(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "all else"), (3, "x y")], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in nearcopies.keep_one_per_group(df).collect())
    assert kept == [(1, "a b c d e f"), (2, "all else"), (3, "x y")]


def test_a_group_alike_by_less_is_not_paired(spark):
    """Variants of one text that share about two thirds with each other: proposed pairs stay far below all pairs."""
    rng = random.Random(9)
    base = " ".join(f"b{k}" for k in range(300))
    docs = [(i, edited(rng, base, 8)) for i in range(400)] + [(1000 + i, edited(rng, base, 2)) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    members = nearcopies.signed(df).selectExpr("node", "key", "node as root")
    proposed = nearcopies._by_prefix(df, members).count()
    sets = {i: plain_shingles(t) for i, t in docs}
    linked = sum(9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) for a, b in combinations(sets, 2))
    assert linked <= proposed < 0.05 * 410 * 409 / 2
    assert {r.doc_id for r in nearcopies.keep_one_per_group(df).collect()} == plain_kept(docs)
