"""Runs from the grammar against comparing every distance."""
import hashlib
import random
import re
import zlib

import pytest

from tests.llm.helpers import SCHEMA, awkward, docs_df, rows, with_clashes
from wayfare.llm import periodic_runs as PR


def _runs_by_hand(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _random_texts(rng):
    for _ in range(rng.randint(1, 5)):
        t = []
        for _ in range(rng.randint(0, 5)):
            few = rng.choice([1, 2, 3, 5, 30])
            piece = [rng.randint(0, few) for _ in range(rng.randint(1, 30))]
            kind = rng.random()
            if kind < 0.5:
                t += piece * rng.randint(1, 6)
            elif kind < 0.6:
                t += [0] * rng.randint(0, 40)
            elif t:
                i = rng.randrange(len(t))
                t += t[i:i + rng.randint(1, 40)]
            else:
                t += piece
        yield t


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_comparing_every_distance(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts, least = list(_random_texts(rng)), rng.choice([12, 12, 12, 2, 6, 7])
        assert PR.runs_of(texts, least) == [_runs_by_hand(t, least) for t in texts], (texts, least)


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_strings_with_many_runs():
    thue = [bin(i).count("1") % 2 for i in range(512)]
    texts = [_fibonacci(400), thue, [0] * 400, [0, 1] * 200, [], [1], [0] * 11, [0] * 12, _fibonacci(150) * 3,
             ([0] * 5 + [1]) * 60, list(range(40)) * 2, list(range(40)) + list(range(39))]
    assert PR.runs_of(texts) == [_runs_by_hand(t) for t in texts]


def test_long_texts_stay_linear():
    assert PR.runs_of([[7] * 200_000, ["a", "b", "c"] * 60_000]) == [[(0, 200_000, 1)], [(0, 180_000, 3)]]


def test_grammar_derives_its_text_and_is_flat():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.choice([rng.randint(0, 4), -1]) if rng.random() < 0.1 else rng.randint(0, 4) for _ in range(rng.randint(1, 120))]
        rules, parts = PR.repair(words)
        base = max(words) + 1 if max(words) >= 0 else 0

        def text(s):
            return [s] if s < base else text(rules[s - base][0]) + text(rules[s - base][1])
        want, part = [], []
        for w in words:
            if w < 0:
                want.append(part)
                part = []
            else:
                part.append(w)
        assert [[x for s in p for x in text(s)] for p in parts] == [*want, part]
    rules, parts = PR.repair(list(range(1000)) * 2)
    depth = [0] * 1000
    for a, b in rules:
        depth.append(1 + max(depth[a], depth[b]))
    assert max(depth) <= 14


def test_batches_of_candidates_give_the_same_runs(monkeypatch):
    texts = list(_random_texts(random.Random(9))) + [_fibonacci(300), [0] * 100]
    want = PR.runs_of(texts)
    monkeypatch.setattr(PR, "BATCH_CANDIDATES", 3)
    assert PR.runs_of(texts) == want


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _digest_by_hand(key, text):
    w = _words(text)
    h, n = zlib.crc32(str("" if key is None else key).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = _runs_by_hand(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digests_of_awkward_rows(spark):
    lines = "a line that is here again and again\n" * 30
    docs = with_clashes(awkward(spark).filter("length(text) < 1000 or text is null").union(
        docs_df(spark, [lines, "x " * 500, "\x1c one\x85word\xa0here " * 20, ("null", "y z " * 30)], first_id=100)))
    got = PR.run_digests(docs, rewrite=PR.digest_rewrite)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [(r.doc_id, *_digest_by_hand(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect()]
    assert rows(got) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert PR.run_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_very_long_text(spark):
    assert PR.run_digests(awkward(spark).filter("doc_id = 4")).first().n_runs == 0


def test_runs_and_collapsed_texts_are_outputs(spark):
    out = PR.periodic_runs(docs_df(spark, ["one two three " * 6 + "end", None, "no run in here"])).orderBy("doc_id").collect()
    assert [[tuple(r) for r in o.runs] for o in out] == [[(0, 18, 3)], [], []]
    assert [o.collapsed for o in out] == ["one two three end", "", "no run in here"]


def test_query_on_given_documents(spark):
    from wayfare.llm.queries import op11_periodic_runs
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if len(_words(r.text)) <= 1500:
            assert got[r.doc_id] == _digest_by_hand(r.doc_id, r.text), r.doc_id
