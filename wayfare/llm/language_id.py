"""Language identification: known words first, then ever shorter character n-grams.

A word (a run of letters, lower-cased) that the model knows is scored by its
log frequency in every language.  An unknown word falls back to its character
n-grams, ``^`` and ``$`` marking its ends: the longest length (``GRAM_SIZES``)
at which the model knows any of them decides, by the mean of their log
frequencies.  A word of which not even a single character is known says
nothing.  A text's score of a language is the log share of the language plus
the scores of its words; ``score`` is the winner's share of the likelihood.

Learning: ``SAMPLE_DOCS`` documents of each language (about that many: those
whose hash is below the language's cut), for at most ``MAX_LANGUAGES``
languages, the most frequent; all words of these texts are counted by Spark.
The tables keep the most frequent words and n-grams up to ``TABLE_BYTES``.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is everything when there is nothing to learn from; a null id is neither
held out nor learned from; equal scores go to the first language in
alphabetical order; texts are read whole; every row is judged on its own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import bounded_broadcast, by_row, checkpointed

WORD = re.compile(r"[^\W\d_]+")
GRAM_SIZES = (4, 3, 2, 1)
SAMPLE_DOCS = 2000
MAX_LANGUAGES = 256
SMOOTHING = 0.5
KEPT_WORDS = 50_000
#: Bytes of the learned tables, broadcast to every task.
TABLE_BYTES = 16 << 20
FOLDS = 5


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + size] for i in range(len(marked) - size + 1) if marked[i:i + size] not in ("^", "$")]


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> DataFrame:
    """(lang, text) of about ``sample_docs`` learning documents a language, chosen by hash."""
    key = F.col(f"`{id_col}`")
    learn = (docs.filter((fold(id_col) != 0) & F.col(f"`{lang_col}`").isNotNull())
             .select(key.alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")))
    sizes = (learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect())
    if not sizes:
        return learn.select("lang", "text").limit(0)
    cut = F.lit(False)
    for r in sizes:
        share = min(1.0, sample_docs / r["count"])
        cut = F.when(F.col("lang") == r["lang"],
                     F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("lid")), F.lit(1 << 32)) < share * (1 << 32)
                     ).otherwise(cut)
    return learn.filter(cut).select("lang", "text")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, item, n) of the words of (lang, text), summed within a batch."""
    for b in batches:
        words: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                words.update(zip(repeat(lang), words_of(text)))
        if words:
            langs, items = zip(*words)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(items), pa.array(words.values(), pa.int64())],
                                             names=["lang", "item", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, item, n) of the n-grams of counted words, summed within a batch."""
    for b in batches:
        for size in GRAM_SIZES:
            total: Counter = Counter()
            for lang, word, n in zip(*[c.to_pylist() for c in b.columns]):
                for g in grams_of(word, size):
                    total[lang, g] += n
            if total:
                langs, items = zip(*total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs), pa.array([size] * len(langs), pa.int64()), pa.array(items), pa.array(total.values(), pa.int64())],
                    names=["lang", "size", "item", "n"])


class Model:
    """Log frequencies of words (size 0) and n-grams by language."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, tuple[list[str], np.ndarray]]):
        self.langs, self.prior = langs, prior
        self.rows = {s: {x: i for i, x in enumerate(items)} for s, (items, _) in tables.items()}
        self.logs = {s: logs for s, (_, logs) in tables.items()}
        self.kept: dict[str, tuple[int, list[int]]] = {}

    def fallback(self, word: str) -> tuple[int, list[int]]:
        """(size, rows) of the longest n-grams of an unknown word that are known; (0, []) if none is."""
        found = self.kept.get(word)
        if found is None:
            found = 0, []
            for size in GRAM_SIZES:
                known = [x for x in map(self.rows.get(size, {}).get, grams_of(word, size)) if x is not None]
                if known:
                    found = size, known
                    break
            if len(word) <= 64:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else None
        if not words or not self.langs:
            return "und", 0.0
        picked: dict[int, tuple[list[int], list[float]]] = {s: ([], []) for s in (0, *GRAM_SIZES)}
        rows = self.rows.get(0, {})
        for w, n in words.items():
            at = rows.get(w)
            if at is not None:
                picked[0][0].append(at)
                picked[0][1].append(n)
            else:
                size, known = self.fallback(w)
                if known:
                    picked[size][0].extend(known)
                    picked[size][1].extend([n / len(known)] * len(known))
        total = self.prior.copy()
        for size, (at, weight) in picked.items():
            if at:
                total += np.asarray(weight) @ self.logs[size][at]
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, limit: int = TABLE_BYTES) -> tuple:
    """(langs, prior, tables): the arguments of ``Model``, small enough to broadcast."""
    sample = sampled(docs, id_col, text_col, lang_col, sample_docs)
    lang_type = sample.schema["lang"].dataType.simpleString()
    words = checkpointed(sample.mapInArrow(_word_counts, f"lang {lang_type}, item string, n long")
                         .groupBy("lang", "item").agg(F.sum("n").alias("n")))
    grams = (words.mapInArrow(_gram_counts, f"lang {lang_type}, size long, item string, n long")
             .groupBy("lang", "size", "item").agg(F.sum("n").alias("n")))
    counts = checkpointed(words.select("lang", F.lit(0).cast("long").alias("size"), "item", "n").unionByName(grams))
    totals = {(r["size"], r["lang"]): r["n"] for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    if not langs:
        return [], np.zeros(0), {}
    at = {lang: i for i, lang in enumerate(langs)}
    entries = limit // (4 * (len(langs) + 6) * (len(GRAM_SIZES) + 1))
    tables = {}
    for size in (0, *GRAM_SIZES):
        top = (counts.filter(F.col("size") == size).groupBy("item")
               .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
               .filter("n > 1").orderBy(F.desc("n"), "item").limit(int(entries)).collect())
        if not top:
            continue
        seen = np.zeros((len(top), len(langs)))
        for i, r in enumerate(top):
            for lang, n in r["by"].items():
                seen[i, at[lang]] = n
        whole = np.array([totals.get((size, lang), 0) for lang in langs], dtype=np.float64)
        tables[size] = ([r["item"] for r in top],
                        np.log((seen + SMOOTHING) / (whole + SMOOTHING * len(top))).astype(np.float32))
    words = np.array([totals.get((0, lang), 0) for lang in langs], dtype=np.float64)
    return langs, np.log(words / words.sum()), tables


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    learned = bounded_broadcast(docs.sparkSession, learn(docs, id_col, text_col, lang_col, sample_docs),
                                2 * TABLE_BYTES)
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"),
                        F.col(f"`{text_col}`").alias("text"))
    return by_row(named, {"id": "id", "held_out": "held_out", "text": "text"},
                  f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double",
                  lambda model, key, held, text: (key, held, *model.predict(text)), lambda: Model(*learned.value))
