"""Repeated-string removal against every window of every document."""
import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import awkward, docs_df, rows, with_clashes
from wayfare.llm import suffix_repeats as R


def _brute(ids, texts, length=R.LENGTH):
    raws = [(t or "").encode() for t in texts]
    first = {}
    for i, raw in zip(ids, raws):
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in zip(ids, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p:p + length]] < i:
                gone[p:p + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def _corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]

    def prose(k):
        return " ".join(rng.choices(words, k=k))

    passages = [prose(rng.randint(5, 60)) for _ in range(6)] + ["ab" * 60, "x" * 130]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            t = rng.choice(texts)
            if rng.random() < 0.7 and t:
                p = rng.randrange(len(t))
                t = t[:p] + rng.choice(["", "Q", "zz"]) + t[p + rng.randint(0, 3):]
        else:
            t = " ".join(x for _ in range(rng.randint(1, 4)) for x in (prose(rng.randint(0, 40)), rng.choice(passages)[rng.randint(0, 20):]))
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed,hot", [(1, 64), (2, 2), (3, 1)])
def test_removal_equals_every_window(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(R, "HOT_DOCS", hot)
    texts = _corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = sorted(tuple(r)[:5] for r in R.removed(df).collect())
    assert got == sorted(_brute(ids, texts))


def test_anchors_do_not_depend_on_the_pieces(monkeypatch):
    raws = [t.encode() for t in _corpus(4, 25)] + [b"", b"short", b"z" * R.LENGTH]
    one = [R.anchors([r])[1:] for r in raws]
    for size in (64, 500, 1 << 18):
        monkeypatch.setattr(R, "PIECE_BYTES", size)
        which, at, hashes = R.anchors(raws)
        assert sorted(set(which)) == [i for i, r in enumerate(raws) if len(r) >= R.LENGTH]
        for i, (a, h) in enumerate(one):
            assert (at[which == i] == a).all() and (hashes[which == i] == h).all()
        w, s, e = R.chunks(raws)
        for i, r in enumerate(raws):
            own = list(zip(s[w == i], e[w == i]))
            assert not own and len(r) < R.LENGTH or own[0][0] == 0 and own[-1][1] == len(r) - R.LENGTH + 1
            assert all(x[1] == y[0] for x, y in zip(own, own[1:])) and all(x < y for x, y in own)


def test_every_window_has_its_least_gram():
    for t in _corpus(5, 12):
        raw = t.encode()
        if len(raw) >= R.LENGTH:
            grams, chosen = R.gram_hashes(raw), set(R.anchors([raw])[1].tolist())
            for p in range(len(raw) - R.LENGTH + 1):
                own = grams[p:p + R.LENGTH - R.GRAM + 1]
                assert set((np.flatnonzero(own == own.min()) + p).tolist()) <= chosen


def test_spans_cover_what_is_removed(spark):
    texts = _corpus(6, 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in R.removed(df, with_spans=True).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_prefix_intervals_and_maximal_repeats_equal_all_pairs():
    rng = random.Random(5)
    for _ in range(60):
        contexts = list({("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode(),
                          "".join(rng.choice("ab") for _ in range(rng.randint(1, 8))).encode()) for _ in range(14)})
        least = 6
        got = {(left, right, frozenset(own)) for left, right, own in R.maximal_repeats(contexts, least)}
        # of every pair the common context is a repeat; its occurrences are all contexts that hold it
        want = set()
        for i, (la, ra) in enumerate(contexts):
            for lb, rb in contexts[i + 1:]:
                left, right = R._common(la[::-1], lb[::-1]), R._common(ra, rb)
                if left + right >= least:
                    l, r = la[len(la) - left:], ra[:right]
                    want.add((left, right, frozenset(k for k, (x, y) in enumerate(contexts) if x.endswith(l) and y.startswith(r))))
        assert want <= got
        for left, right, own in got:                       # every group is a repeat with all its occurrences, maximal both ways
            a = contexts[min(own)]
            l, r = a[0][len(a[0]) - left:], a[1][:right]
            assert own == frozenset(k for k, (x, y) in enumerate(contexts) if x.endswith(l) and y.startswith(r)) and len(own) > 1
            assert len({x[len(x) - left - 1:len(x) - left] for x, _ in (contexts[k] for k in own)}) > 1 or any(len(contexts[k][0]) == left for k in own)


def test_equal_windows_have_the_same_anchor_offsets():
    rng = random.Random(6)
    a, b = (bytes(rng.choice(b"ab ") for _ in range(400)) for _ in range(2))
    shared = bytes(rng.choice(b"abc") for _ in range(R.LENGTH))
    for raw in (a[:101] + shared + a[200:], b[:37] + shared + b[90:]):
        at = raw.index(shared)
        inside = [p - at for p in R.anchors([raw])[1] if at <= p <= at + R.LENGTH - R.GRAM]
        least = R.gram_hashes(shared)
        assert set(np.flatnonzero(least == least.min())) <= set(inside)


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = docs.select("doc_id", "text").collect()
    assert sorted(tuple(r)[:5] for r in R.removed(docs).collect()) == sorted(_brute([r.doc_id for r in data], [r.text for r in data]))


def test_awkward_rows(spark):
    df = awkward(spark).unionByName(docs_df(spark, ["The same sentence, which is well over fifty bytes long, twice.", None, "",
                                                    "The same sentence, which is well over fifty bytes long, twice."], first_id=50))
    df = df.unionByName(df.filter("doc_id = 53")).unionByName(df.filter("doc_id = 50").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    got = rows(R.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans"))
    by = [t for t in got if t[0] in (50, 51, 52, 53)]
    assert by == [(50, 62, 0, 0), (51, 0, 0, 0), (52, 0, 0, 0), (53, 62, 62, 1), (53, 62, 62, 1)]
    assert (None, 62, 0, 0) in got and (2, 0, 0, 0) in got and len(got) == df.count()
    assert rows(R.removed(with_clashes(df)).select("doc_id", "n_bytes", "n_removed", "n_spans")) == got
    assert R.removed(df.limit(0)).count() == 0
    again = df.unionByName(docs_df(spark, ["Another text under an id that is there already, of well over fifty bytes."], first_id=53))
    assert (53, 73, 0, 0) in rows(R.removed(again).select("doc_id", "n_bytes", "n_removed", "n_spans"))


def test_a_bucket_range_is_held_as_bytes_not_as_objects():
    """40,000 contexts of one bucket range, nearly all alone in their bucket: memory stays near their bytes."""
    import tracemalloc

    import pyarrow as pa
    n = 40_000
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, (n, 80), dtype=np.uint8)
    data[1] = data[0]                                        # one repeat: the same bucket, text and place
    data[1, 0] ^= 1
    bucket = np.arange(n, dtype=np.uint64)
    bucket[1] = 0
    blob = R._pack(bucket, np.arange(n), np.zeros(n, np.int64), np.full(n, 100), np.full(n, 30, np.uint8), np.full(n, 50, np.uint8), data.ravel())
    group = pa.table({"part": pa.array([0], pa.int32()), "kind": pa.array([0], pa.int32()), "blob": pa.array([blob], pa.binary())})
    tracemalloc.start()
    out = R._range_spans(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [{"id": 1, "tag": 0, "start": 71, "end": 150}]
    assert peak < 20 << 20


def test_batches_are_taken_by_bytes(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(R, "BYTES_AT_ONCE", 10)
    b = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": ["abc", None, "x" * 25, "", "de", "f", "g" * 9]})
    got = list(R._slices(b, 1))
    assert [r for s in got for r in s.to_pylist()] == b.to_pylist() and len(got) > 2 and all(s.num_rows for s in got)
    assert [s.num_rows for s in R._slices(b.slice(0, 0), 1)] in ([], [0])
