"""URL filter, quality bands, token counts, language identification and mixing against plain Python."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, docs_df, rows, with_clashes
from wayfare.llm import language_id, mixing, quality_bands, token_counts, url_filter
from wayfare.llm.url_filter import Rule

SF = "/root/testdata/sf0.01"


# -- URL filter ---------------------------------------------------------------

def _by_hand(host, path, rules, default="allow"):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fit:
        return None, default
    best = max(fit, key=lambda r: (len(r.host) + len(r.path), r.host.count("."), r.verdict == "block", r.host + r.path))
    return best.host + best.path, best.verdict


@pytest.mark.parametrize("limit", [32 << 20, 400])
def test_url_filter_equals_trying_every_rule(spark, limit):
    rng = random.Random(1)
    labels, segments = ["a", "b", "com", "net", ""], ["", "en", "e", "x", "en2"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    def path():
        return "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, 4)))

    rules = list({(h, p): Rule(rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q=/en/', '#f', '?a://b'])}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "HTTP://A.COM/EN", "x://", "://b.com/en"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, rules, limit=limit).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (m.group(1).lower(), m.group(2)) if m else ("", "")
        assert (got[i].host, got[i].path) == (h, p)
        assert (got[i].rule, got[i].verdict) == _by_hand(h, p, rules), u


def test_url_filter_empty_and_clashing(spark):
    df = spark.createDataFrame([], "page_id long, url string, host string, path string, rule string, verdict string")
    assert url_filter.judge_urls(df).collect() == []
    one = spark.createDataFrame([(1, "https://www.example.com/en/a", "h", "r")] * 2, "page_id long, url string, host string, rule string")
    assert rows(url_filter.judge_urls(one)) == [(1, "www.example.com", "/en/a", "www.example.com/en/", "allow")] * 2


# -- quality bands ------------------------------------------------------------

def _statistics_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_word_statistics_equal_plain_python():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "#", "|", "\x0b", "\u2003", "\x85", "中"])
                       for _ in range(rng.randint(0, 120)))
        assert quality_bands.word_statistics(text) == _statistics_by_hand(text), repr(text)


def test_bands_reject_repetitive_and_incompressible_text_and_keep_prose(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(800)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(800)], k=n))

    noise = " ".join("".join(chr(rng.randrange(33, 0x250)) for _ in range(8)) for _ in range(2500))
    loop = " ".join(f"{a} {b}" for a in ("so", "we", "go") for b in ("on", "up", "in")) + " "
    varied = "".join(loop + str(i % 7) + " " for i in range(800))
    good, part_bad = prose(9000), prose(3000) + " " + noise
    got = {r.doc_id: r for r in quality_bands.quality(docs_df(spark, [good, prose(60), noise, varied, part_bad, None, ""])).collect()}
    assert [got[i].kept for i in range(7)] == [True, True, False, False, False, False, False]
    assert got[2].base_failed is False and got[2].ratio < quality_bands.band(len(noise.encode()))[0]
    assert got[4].ratio > quality_bands.band(len(part_bad.encode()))[0] and got[4].bad_chunk_share > 0.25
    assert got[5].ratio is None and got[5].n_words == 0 and got[5].base_failed


@pytest.mark.parametrize("size", [300, 349, 466, 800, 2048, 5000, 20_000])
def test_encoded_and_random_text_goes_and_clean_documents_stay(spark, size):
    import base64
    import pyarrow.parquet as pq
    rng = random.Random(size)

    def words(signs, k):
        return " ".join(signs[i:i + k] for i in range(0, len(signs), k))[:size]

    bad = [words(x, k) for k in ((4, 5) if size == 300 else (4, 5, 6))
           for x in (base64.b64encode(rng.randbytes(size)).decode(), rng.randbytes(size).hex(), rng.randbytes(size).hex().upper(),
                     "".join(chr(rng.randrange(33, 127)) for _ in range(size)))]
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    clean = [r["text"][:size] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()
             if labels.get(r["doc_id"]) == 1 and len(r["text"]) >= min(size, 5000)]
    got = {r.doc_id: r for r in quality_bands.quality(docs_df(spark, bad + clean)).collect()}
    assert not any(got[i].base_failed or got[i].kept for i in range(len(bad)))
    assert clean and all(got[i].kept or got[i].base_failed for i in range(len(bad), len(got)))


def test_quality_awkward_rows_and_stage_agree(spark):
    df = awkward(spark)
    q = quality_bands.quality(df)
    assert q.count() == df.count()
    assert rows(quality_bands.quality(with_clashes(df))) == rows(q)
    assert quality_bands.quality(df.limit(0)).count() == 0
    kept = quality_bands.kept_documents(with_clashes(df))
    assert kept.columns == with_clashes(df).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in q.filter("kept").collect()) == [4]


# -- token counts -------------------------------------------------------------

def _library_counts(vocabulary, texts):
    from tokenizers import Tokenizer, models
    floor = min(s for _, s in vocabulary)
    t = Tokenizer(models.Unigram([("<none>", floor)] + vocabulary, unk_id=0, byte_fallback=False))
    out = []
    for text in texts:
        normal = token_counts.MARK + text.replace(" ", token_counts.MARK) if text else ""
        e = t.encode(normal, add_special_tokens=False)
        out.append(sum(1 if i else len(normal[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets)))
    return out


def test_token_counts_equal_the_unigram_library(spark):
    import pyarrow.parquet as pq
    vocabulary = token_counts.read_vocabulary()
    count = token_counts.Counter(vocabulary)
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:150]
    texts += ["", " ", "   ", "a  b ", "\x00\u4e2d\u6587 \U0001f600\U0001f600x", "<0x0A>", "x" * 500, "\n\n", "▁a▁", "ab" * 3000]
    assert [count(t) for t in texts] == _library_counts(vocabulary, texts)


def test_token_counts_keep_ties_and_fractional_scores():
    rng = random.Random(5)
    for whole in (True, False):
        pieces = list({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)})
        vocabulary = [(p, float(-rng.randint(1, 4)) if whole else -rng.random() * 5) for p in pieces]
        texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 40))) for _ in range(300)]
        count = token_counts.Counter(vocabulary)
        assert [count(t) for t in texts] == _library_counts(vocabulary, texts)


def test_token_counts_awkward_rows(spark):
    df = awkward(spark)
    got = rows(token_counts.token_counts(df))
    assert len(got) == 8 and (2, 0) in got and (1, 0) in got
    assert rows(token_counts.token_counts(with_clashes(df))) == got
    assert token_counts.token_counts(df.limit(0)).count() == 0


# -- language identification --------------------------------------------------

def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_backs_off_for_unseen_words(spark):
    en = ["the cat and the dog went over that hill with them", "there they were then with the other things"] * 8
    de = ["der hund und die katze sind nicht auf dem berg", "ich habe die schönen sachen nicht gesehen"] * 8
    df = docs_df(spark, en + de, ["en"] * 16 + ["de"] * 16)
    probe = docs_df(spark, ["thething otherthat", "schönheitlich nichtung", "12 34 !", None, "", "\u4e2d\u6587"], [None] * 6, first_id=1000)
    got = {r.doc_id: r for r in language_id.identify(df.unionByName(probe)).collect()}
    assert [got[1000 + i].lang_pred for i in range(4)] == ["en", "de", "und", "und"]
    assert got[1004].lang_pred == "und" and got[1004].score == 0.0
    assert got[1005].lang_pred in ("en", "de")
    import zlib
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_language_id_awkward_rows(spark):
    df = awkward(spark)
    got = rows(language_id.identify(df))
    assert len(got) == 8 and rows(language_id.identify(with_clashes(df))) == got
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.limit(0).unionByName(docs_df(spark, ["nothing learned"], [None]))).collect()} == {"und"}


# -- mixing -------------------------------------------------------------------

def test_distribution_is_poisson():
    for mean in (0.01, 0.7, 3.0, 40.0, 256.0):
        d = mixing.distribution(mean)
        assert all(a <= b for a, b in zip(d, d[1:]))
        assert math.isclose(sum(1 - x for x in d), mean, rel_tol=1e-9)   # E[X] = sum P(X > k)


def test_mixing_reaches_the_target_weights_and_is_repeatable(spark):
    texts, sources = ["x" * 100] * 6000, ["src0"] * 4000 + ["src1"] * 1500 + ["zzz"] * 500
    df = docs_df(spark, texts, sources=sources)
    weights = {"src0": 1.0, "src1": 2.0}
    out = mixing.mix(df, weights, other=1.0)
    share = {r.source: r["count"] / 6000 for r in out.groupBy("source").count().collect()}
    assert abs(share["src0"] - 0.25) < 0.03 and abs(share["src1"] - 0.5) < 0.05 and abs(share["zzz"] - 0.25) < 0.05
    again = mixing.mix(df.repartition(7), weights, other=1.0)
    assert rows(out.select("doc_id", "copy", "shuffle_key")) == rows(again.select("doc_id", "copy", "shuffle_key"))
    large = mixing.mix(df.limit(20), {"src0": 1.0}, wanted=20 * 100 * 700.0).groupBy("doc_id").count().collect()
    assert len(large) == 20 and abs(sum(r["count"] for r in large) / 20 - 700) < 30


def test_mixing_awkward_rows(spark):
    df = awkward(spark)
    out = mixing.mix(df, {"src0": 1.0, "src1": 5.0}, other=2.0)
    assert out.columns == df.columns + ["copy", "shuffle_key"]
    clashing = mixing.mix(with_clashes(df), {"src0": 1.0, "src1": 5.0}, other=2.0)
    assert "copy_" in clashing.columns and clashing.count() == out.count()
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(docs_df(spark, [None, ""])).count() == 0
    assert mixing.mix(docs_df(spark, ["ab"] * 9), {}).count() > 0
    assert spark.createDataFrame([], SCHEMA).count() == 0


def test_mixing_draws_every_row_on_its_own(spark):
    """Rows without an id, under one id, or alike in every column: each has its own Poisson draw."""
    words = [f"document number {i} of a source" for i in range(2000)]
    none = docs_df(spark, [("null", t) for t in words])
    shared = none.drop("doc_id").withColumn("doc_id", F.lit(7).cast("long")).select(none.columns)
    alike = docs_df(spark, [("null", "the same row")] * 2000)
    for df in (none, shared, alike):
        out = mixing.mix(df, {}).groupBy("text").count().collect()
        copies = [r["count"] for r in out]
        assert 1800 < sum(copies) < 2200
        if df is not alike:
            assert 0.60 < len(copies) / 2000 < 0.67 and 2 < max(copies) < 12       # 1 - 1/e of them are drawn
    numbered = mixing.mix(alike, {}).select("copy", "shuffle_key").collect()
    assert sorted(r.copy for r in numbered) == list(range(len(numbered))) and len({r.shuffle_key for r in numbered}) == len(numbered)
    assert rows(mixing.mix(alike.repartition(5), {})) == rows(mixing.mix(alike, {}))
    mixed = docs_df(spark, [(0, "a b"), (0, "a b"), (0, "c d")], ["en", "en", "en"])
    assert mixing.mix(mixed, {}, wanted=3 * 700.0).groupBy("text").count().count() == 2
