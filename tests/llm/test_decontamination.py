"""Benchmark decontamination against a search that scores every passage with every item."""
import math
import random
from collections import Counter

from tests.llm.helpers import awkward, docs_df, rows, with_clashes
from wayfare.llm import decontamination as D


def _bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def _brute(texts, items, threshold, least):
    """All verified (document, item) pairs, every passage scored against every item."""
    used = [(i, D.words_of(t), t) for i, t in enumerate(items) if len(D.words_of(t)) >= D.SHORT_ITEM_WORDS]
    short = [(i, w) for i, t in enumerate(items) if 0 < len(w := D.words_of(t)) < D.SHORT_ITEM_WORDS]
    n, mean = len(used), sum(len(w) for _, w, _ in used) / len(used)
    freq = Counter(x for _, w, _ in used for x in set(w))
    impact = {}
    for i, w, _ in used:
        own = {x: math.log(1 + (n - freq[x] + .5) / (freq[x] + .5)) * tf * (D.K1 + 1)
               / (tf + D.K1 * (1 - D.B + D.B * len(w) / mean)) for x, tf in Counter(w).items()}
        impact[i] = {x: v / sum(own.values()) for x, v in own.items()}
    out = set()
    for d, text in enumerate(texts):
        words = D.words_of(text)
        out |= {(d, i) for i, w in short if any(words[k:k + len(w)] == w for k in range(len(words)))}
        for i, w, t in used:
            size = 1 << max(5, (len(w) - 1).bit_length())
            question, answer = D.question_and_answer(t)
            for s in range(0, max(1, len(words) - size), size):
                passage = words[s:s + 2 * size]
                if sum(impact[i].get(x, 0) for x in set(passage)) >= threshold - 1e-9 \
                        and D.overlap(question, passage) >= least and D.overlap(answer, passage) >= least:
                    out.add((d, i))
    return out


def _corpus(seed, n_items=70, n_docs=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdkt") for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, [1 / (i + 3) for i in range(400)], k=n))

    items = [f"{prose(rng.randint(3, 30))}. {prose(rng.randint(2, 30))}{rng.choice(['.', '? ' + prose(3)])}" for _ in range(n_items)]
    items += ["", "a b", items[0], "a", "a b", "e. I d", "Kt"]
    texts = []
    for _ in range(n_docs):
        parts = [prose(rng.randint(0, 200))]
        if rng.random() < 0.6:
            words = rng.choice(items).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            parts += [" ".join(words).upper(), prose(rng.randint(0, 100))]
        texts.append(" ".join(parts))
    return texts, items


def test_pairs_equal_the_exhaustive_search(spark):
    for seed, threshold, least in ((1, 0.6, 0.8), (2, 0.2, 0.3), (3, 0.9, 0.0)):
        texts, items = _corpus(seed)
        got = {(r.doc_id, r.item_id) for r in D.contaminated(docs_df(spark, texts), _bench(spark, items), threshold, least).collect()}
        want = _brute(texts, items, threshold, least)
        assert want and got == want
    parts = {(r.doc_id, r.item_id) for r in D.contaminated(docs_df(spark, texts), _bench(spark, items), threshold, least, part_chars=700).collect()}
    assert parts == want


def test_a_large_vocabulary_is_split_until_it_fits(spark):
    rng = random.Random(11)
    items = [" ".join(f"w{rng.randrange(10 ** 6):x}" for _ in range(n)) for n in (30, 60, 120, 250) for _ in range(90)]
    bench, held = _bench(spark, items), [0, 95, 200, 300, 359]
    docs = docs_df(spark, [f"some words before {items[i]} and after" for i in held] + ["nothing of the kind in here"])
    assert len(list(D.build_indexes(bench, limit=4 << 20))) > len(list(D.build_indexes(bench))) > 1
    want = [(d, i) for d, i in enumerate(held)]
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()) == want
    assert [r.doc_id for r in D.clean_documents(docs, bench).collect()] == [len(held)]
    texts, small = _corpus(3)
    one = rows(D.contaminated(docs_df(spark, texts), _bench(spark, small), 0.2, 0.3))
    assert one and rows(D.contaminated(docs_df(spark, texts), _bench(spark, small), 0.2, 0.3, limit=100_000)) == one


def test_retrieval_scores_and_blocks_equal_full_scoring():
    texts, items = _corpus(9, n_items=200)
    freq = Counter(x for t in items for x in set(D.words_of(t)))
    index = D.Index([(i, t) for i, t in enumerate(items) if len(D.words_of(t)) >= 5], freq, len(items), 30.0)
    rng = random.Random(4)
    for c in index.classes:
        for _ in range(60):
            words = sorted(rng.sample(range(len(index.vocabulary)), 60))
            full = Counter()
            for w in words:
                for item, x in c.lists.get(w, ()):
                    full[item] += x
            for threshold in (0.05, 0.2, 0.4):
                got = dict(c.retrieve(words, threshold))
                assert set(got) == {i for i, x in full.items() if x >= threshold - 1e-9}
                assert all(math.isclose(got[i], full[i]) for i in got)


def test_planted_items_go_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [t for (t,) in bench.select("text").collect()]
    want = {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    got = {r.doc_id for r in D.contaminated(docs, bench).collect()}
    assert want and want == got
    kept = {r.doc_id for r in D.clean_documents(docs, bench).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - want


def test_awkward_rows(spark):
    df, bench = awkward(spark), _bench(spark, ["same row twice over here", None, "", "same row twice over here"])
    got = rows(D.contaminated(df, bench).select("doc_id", "item_id"))
    assert got == [(5, 0), (5, 0), (5, 3), (5, 3)]
    assert rows(D.contaminated(with_clashes(df), bench).select("doc_id", "item_id")) == got
    assert D.contaminated(df, bench.limit(0)).count() == 0
    assert D.contaminated(df.limit(0), bench).count() == 0
    kept = D.clean_documents(with_clashes(df), bench)
    assert kept.columns == with_clashes(df).columns and kept.count() == df.count() - 2
    assert D.clean_documents(df, bench.limit(0)).count() == df.count()


def test_short_items_match_their_whole_word_sequence(spark):
    items = ["Capital of France? Paris", "Yes", "two  words", "of France?", None, "?!"]
    texts = ["A text: capital of France -- PARIS it is", "the capital of Spain? Paris", "yes", "eyes", "two. Words", "two other words", ""]
    docs, bench = docs_df(spark, texts), _bench(spark, items)
    got = sorted((r.doc_id, r.item_id, r.score) for r in D.contaminated(docs, bench).collect())
    assert got == [(0, 0, 1.0), (0, 3, 1.0), (2, 1, 1.0), (4, 2, 1.0)]
    assert sorted(r.doc_id for r in D.clean_documents(docs, bench).collect()) == [1, 3, 5, 6]


def test_an_item_larger_than_the_limit_is_searched_for(spark):
    rng = random.Random(2)
    large = " ".join(f"w{i:x}" for i in rng.sample(range(10 ** 7), 40_000))
    small = "what is the answer to this question here? it is this one"
    docs = docs_df(spark, [f"before {large} after", f"some text {small} and more", "nothing", " ".join(large.split()[:9_000])])
    bench = _bench(spark, [small, large])
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench, limit=200_000).collect()) == [(0, 1), (1, 0)]
    assert sorted(r.doc_id for r in D.clean_documents(docs, bench, limit=200_000).collect()) == [2, 3]
