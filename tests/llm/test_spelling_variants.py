"""Spelling variants against trying every edit of every word."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, awkward, docs_df, rows, with_clashes
from wayfare.llm import spelling_variants as SV


def _near_by_hand(counts):
    """{word: {near words}} by leaving out each letter (of one word, of both)."""
    holes, out = {}, {w: set() for w in counts}
    for w in counts:
        for k in range(len(w)):
            holes.setdefault((k, w[:k] + w[k + 1:]), set()).add(w)
            if (short := w[:k] + w[k + 1:]) in counts:
                out[w].add(short)
                out[short].add(w)
    for same in holes.values():
        for w in same:
            out[w] |= same - {w}
    return out


def _variants_by_hand(counts, ratio=10):
    near, form = _near_by_hand(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def _counts_by_hand(docs):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def _random_counts(rng, n, letters="abcdeé", low=7, high=10):
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        for _ in range(rng.randint(1, 4)):
            out[w] = rng.choice([2, 3, 5, 20, 25, 200, 3000])
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])
    return out


def _got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed,n,cell,sample", [(0, 300, 16_384, 40_000), (1, 1500, 40, 500), (2, 1500, 10, 100), (3, 800, 5, 3)])
def test_variants_equal_trying_every_edit(spark, seed, n, cell, sample):
    counts = _random_counts(random.Random(seed), n)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _got(SV.variants(words, cell=cell, sample=sample)) == _variants_by_hand(counts)


def test_anagrams_and_a_cell_of_equal_vectors(spark, monkeypatch):
    """Many words of one vector cannot be cut apart by letter counts: the cell is dealt out by word."""
    rng, counts = random.Random(7), {}
    while len(counts) < 400:
        counts["".join(rng.sample("abcdefgh", 8))] = rng.choice([2, 30])
    for w in list(counts)[:150]:
        counts[w[:3] + "x" + w[4:]] = 500
        counts[w[:5] + w[6:]] = 4000
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _got(SV.variants(words, cell=12, sample=50)) == _variants_by_hand(counts)


def test_very_long_words_and_strange_letters(spark):
    long = "ab" * 2000
    counts = {long: 100, long[:-1]: 2, long[:-1] + "c": 2, "x" + long: 2, long + "ÿ": 3, "Àbcdefg": 9, "àbcdefg": 90, "bcdefgh": 2,
              "abcdefg": 5, "aaaaaaa": 5, "aaaaaaaa": 60, "aaaaaaaaa": 700, "÷×÷×÷×÷": 2, "÷×÷×÷××": 20}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for cell in (2, 1000):
        assert _got(SV.variants(words, cell=cell, sample=6)) == _variants_by_hand(counts)


def test_box_pruning_reaches_every_close_vector():
    rng = np.random.default_rng(3)
    for _ in range(20):
        points = np.unique(rng.integers(0, 4, (200, 5)).astype(np.int16), axis=0)
        asked = rng.integers(0, 4, (50, 5)).astype(np.int16)
        tree = SV.build(points, np.arange(len(points)), 4)
        for up, down in ((1, 1), (1, 0), (0, 0)):
            got = set()
            SV.search(tree, asked, up, np.full(len(asked), down),
                      lambda leaf, rows: got.update((int(r), int(p)) for r in rows for p in leaf))
            apart = points[None].astype(int) - asked[:, None]
            want = {(int(r), int(p)) for r, p in zip(*np.nonzero((np.maximum(apart, 0).sum(2) <= up) & (np.maximum(-apart, 0).sum(2) <= down)))}
            assert want <= got
            assert len(got) < len(asked) * len(points) / 2        # and boxes are pruned


def test_ties_go_to_the_smallest_word(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdefa": 20, "ébcdefg": 20, "zzzzzzz": 2}
    got = _got(SV.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == _variants_by_hand(counts) and got["abcdefg"][0] == "abcdefa"


def test_chains_lead_to_the_last_form(spark):
    counts = {"aaaaaaa" + "b" * k: 2 * 10 ** k for k in range(9)}
    got = _got(SV.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == _variants_by_hand(counts) and {v[1] for v in got.values()} == {"aaaaaaabbbbbbbb"}


def test_words_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(SV, "KEPT_WORDS", 3)
    docs = with_clashes(awkward(spark).union(docs_df(
        spark, ["Straßen STRASSEN straßen ÉLÉMENT élément élément", "variant7variant variant_variants variants", ("null", "without without WITHOUT"),
                "abcdef abcdefg x" * 3], first_id=50)))
    got = SV.spelling_variants(docs, rewrite=SV.digest_rewrite)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = _counts_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert _got(got) == _variants_by_hand(want)
    assert rows(SV.spelling_variants(spark.createDataFrame([], SCHEMA))) == []


def test_query_on_given_documents(spark):
    from wayfare.llm.queries import op13_spelling_variants
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = _got(op13_spelling_variants(spark, sf))
    assert got == _variants_by_hand(_counts_by_hand(docs))
    assert sum(v[0] is not None for v in got.values()) > 20
