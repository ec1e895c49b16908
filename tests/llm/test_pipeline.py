"""The pipeline end to end against plain Python over every document."""
import hashlib
import re

import pytest
import zstandard

import corpus_pipeline
from tests.llm.helpers import awkward, with_clashes
from tests.llm.test_rowwise import _statistics_by_hand
from tests.llm.test_simhash import _components, _fingerprint
from wayfare.llm import decontamination, mixing, pii, quality_bands

SF = "/root/testdata/sf0.001"


def _kept_by_quality(text):
    n, _, _, _, repeat = _statistics_by_hand(text)
    return n >= 50 and 100 * repeat <= 50 * n and quality_bands.compression_verdict(text.encode(), zstandard.ZstdCompressor(level=3))[0]


def _copies(doc_id, text, mean):
    own = hashlib.md5(text.encode()).hexdigest()
    u = int(hashlib.md5(f"{mixing.SEED}:{doc_id}:{own}:0".encode()).hexdigest()[:13], 16) / 2 ** 52
    return sum(x <= u for x in mixing.distribution(mean))


def test_run_equals_plain_python(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = [i for i, r in docs.items() if _kept_by_quality(r.text)]
    assert 0 < len(ids) < len(docs)
    component = dict(zip(ids, _components(ids, [_fingerprint(docs[i].text) for i in ids], 4)))
    unique = [i for i in ids if component[i] == i]
    assert len(unique) < len(ids)
    clean = [i for i in unique if not any(t in docs[i].text for t in items)]
    assert len(clean) < len(unique)
    text = {i: pii.pseudonymise(docs[i].text)[0] for i in clean}
    assert any(text[i] != docs[i].text for i in clean)
    sizes = {}
    for i in clean:
        g = docs[i].source if docs[i].source in mixing.WEIGHTS else None
        sizes[g] = sizes.get(g, 0) + len(text[i])
    mean = mixing.rates(sizes, mixing.WEIGHTS, mixing.OTHER_WEIGHT)
    want = sorted((i, c, text[i], len(text[i])) for i in clean
                  for c in range(_copies(i, text[i], mean[docs[i].source if docs[i].source in mixing.WEIGHTS else None])))
    got = sorted((r.doc_id, r.copy, r.text, r.n_chars) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pseudonymise", "mix"]
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).columns[:len(docs.columns)] == docs.columns


@pytest.mark.parametrize("clashing", [False, True])
def test_stages_take_awkward_rows(spark, clashing):
    docs = awkward(spark)
    if clashing:
        docs = with_clashes(docs)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF)
            rows = out.count()
            assert n == len(corpus_pipeline.STAGES) - 1 or (rows <= 8 and out.columns == docs.columns), name
            assert rows == 0 or frame is docs
    kept = corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()
    assert [r.doc_id for r in kept] == [4]
    assert corpus_pipeline.decontaminate(spark, docs, SF).count() == docs.count()
    assert corpus_pipeline.pseudonymise(spark, docs, SF).count() == docs.count()


def test_no_stage_reads_only_a_part(spark):
    """Every stage sees a fact placed at the end of the last document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs.agg({"doc_id": "max"}).first()[0]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long_text = re.sub(r"\d", "x", " ".join(r.text for r in docs.limit(60).collect() if r.n_chars < 3000))
    from pyspark.sql import functions as F
    tail = docs.withColumn("text", F.when(F.col("doc_id") == last, F.lit(f"{long_text}\n{item}")).otherwise(F.col("text")))
    assert last not in {r.doc_id for r in corpus_pipeline.decontaminate(spark, tail, SF).collect()}
    marked = docs.withColumn("text", F.when(F.col("doc_id") == last, F.lit(f"{long_text} 97.51.17.173")).otherwise(F.col("text")))
    assert "97.51.17.173" not in {r.doc_id: r.text for r in corpus_pipeline.pseudonymise(spark, marked, SF).collect()}[last]
    assert decontamination.THRESHOLD < 1
