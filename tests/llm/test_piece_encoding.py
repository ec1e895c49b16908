"""Prefix-table encoding against the library and against joining pair by pair."""
import hashlib
import random

import pytest
import sentencepiece
from public_tokenizers import path

from tests.llm.helpers import SCHEMA, awkward, docs_df, rows, with_clashes
from wayfare.llm import piece_encoding as PE

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return PE.Codec(PE.read_vocabulary(MODEL))


def _texts(n=4000):
    rng = random.Random(3)
    parts = [" ", "  ", "   ", "\n", "\t", "the", " the", "ing", "é", "ñ", "漢", "😀", "́", "<s>", "</s>", "<0x0A>",
             "▁", "▁▁", ".", ",", "...", "0", "12", "\x00", "�", "​", "a", "b", "x", "Th", "'", "://"]
    for _ in range(n):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_encodes_and_decodes_as_the_library(codec, library):
    for t in [*_texts(), "", " ", "▁", " " * 3001, "a" * 5000, "the" * 3000, "ab " * 3000]:
        ids = codec.encode(t)
        assert ids == library.encode(t, add_eos=True), repr(t)
        assert codec.decode(ids) == library.decode(ids), repr(t)


def test_decodes_any_ids_as_the_library(codec, library):
    rng, size = random.Random(4), library.get_piece_size()
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(size), rng.randrange(3, 259), 0, 1, 2, 29871]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("seed", range(30))
def test_prefix_table_equals_joining_on_any_vocabulary(seed):
    """Random pieces with repeated and unordered scores: the table is right without a trained order."""
    rng = random.Random(seed)
    pieces = list("ab" + PE.MARK) + ["".join(rng.choice("abc" + PE.MARK) for _ in range(rng.randint(2, 5))) for _ in range(25)]
    ids = {p: i + 256 for i, p in enumerate(dict.fromkeys(pieces))}
    rank = {p: float(rng.randint(0, 12)) if seed % 2 else float(len(p) * 100 + i) for p, i in ids.items()}
    v = PE.Vocabulary(ids, rank, list(range(256)), [b""] * (256 + len(ids)), 0, 0, set())
    c = PE.Codec(v)
    for _ in range(300):
        t = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14)))
        want = []
        for s in PE.joined(PE.MARK + t.replace(" ", PE.MARK), rank):
            want += [ids[s]] if s in ids else s.encode()
        assert c.encode(t, add_end=False) == want, (t, rank)


def test_kept_tables_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(PE, "KEPT_CHUNKS", 5)
    monkeypatch.setattr(PE, "KEPT_PAIRS", 5)
    c = PE.Codec(PE.read_vocabulary(MODEL))
    for t in _texts(300):
        assert c.encode(t) == library.encode(t, add_eos=True)
    assert len(c.kept) <= 5 and len(c.tested) <= 5


def _digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _want(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), _digest(" ".join(map(str, ids))), _digest(library.decode(ids))


def test_round_trip_of_awkward_rows(spark, library):
    docs = with_clashes(awkward(spark))
    got = PE.round_trip(docs, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(r.doc_id, *_want(library, r.text)) for r in docs.select("doc_id", "text").collect()]
    assert rows(got) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert PE.round_trip(spark.createDataFrame([], SCHEMA), MODEL).collect() == []


def test_ids_and_texts_are_outputs(spark, library):
    texts = ["", "Hello  world\nagain", None, "déjà vu"]
    enc = PE.encode(docs_df(spark, texts), MODEL)
    assert [r.ids for r in enc.orderBy("doc_id").collect()] == [library.encode(t or "", add_eos=True) for t in texts]
    dec = PE.decode(enc.union(spark.createDataFrame([(9, None)], enc.schema)), MODEL)
    assert [r.text for r in dec.orderBy("doc_id").collect()] == ["", "Hello  world\nagain", "", "déjà vu", None]


def test_query_equals_the_library_on_given_documents(spark, library):
    from wayfare.llm.queries import op12_piece_encoding
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: _want(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r[0]: tuple(r[1:]) for r in op12_piece_encoding(spark, sf).collect()} == want


def test_models_of_another_kind_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.byte_fallback = False
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="byte fallback"):
        PE.read_vocabulary(str(tmp_path / "m"))
