"""Benchmark decontamination: BM25 inverted index of test items, queried by every training passage.

Index.  Test items are the indexed documents, their BM25 impacts are divided
by the item's own full score, so a passage's score against an item is the
share (0 to 1) of the item's BM25 mass that the passage holds and one
threshold serves all items.  Posting lists are cut into blocks of items, each
with its largest impact.

Query.  Items are classed by length (up to 32, 64, 128, ... words), and for
every class a text is cut into overlapping passages of twice that length,
advanced by it, so each whole item lies inside one passage.  Block-max WAND retrieves all items that reach the threshold:

1. bounds for all passages of a text at once: running sums of block maxima
   over the passage's words, rare words counted as often as they stand there,
   frequent words once through a constant;
2. the same bound over the passage's distinct words;
3. what is left runs through the document-at-a-time pivot loop with block
   maxima and is scored exactly.

No bound is below a true score, so nothing above the threshold is missed.

Verification.  An item's last sentence is its answer (what follows the last
``?``, if anything does), the rest its question; of both, at least
``OVERLAP`` of the five-word shingles (all its words, if fewer) must stand in
the passage.  Items under ``SHORT_ITEM_WORDS`` words have hardly a score to
rank: they match where their whole word sequence stands in the text, and count
in no statistic of the others.

The index is collected in parts of about ``part_chars`` characters of items.
Every part's index is measured and halved by item length until its broadcast
copy fits ``limit`` bytes; an item whose index alone is larger is shipped by
itself (one row bounds it).  Several parts take several passes over the
documents, and the answers do not depend on the parts.

Defined results: a null or empty text, and an empty benchmark, give no pairs;
items without a word (null and empty ones with them) are in no text; repeated rows give repeated
answers of one pair each row; equal items are all reported; texts are read
whole; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfare.llm.common import BROADCAST_BYTES, bounded_broadcast, by_row

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
SHORT_ITEM_WORDS = 5
BLOCK_ITEMS = 4
#: Columns of the first bound; wider item ranges share one beyond it.
BOUND_COLUMNS = 32
COMMON_SHARE = 0.05
#: Words whose bounds are held at a time.
SEGMENT_WORDS = 8192
#: Room for rounding in the single-precision bounds.
SLACK = 0.01
PART_CHARS = 4 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer (empty if it is one sentence)."""
    head, mark, tail = text.rpartition("?")
    if mark and words_of(tail):
        return words_of(head), words_of(tail)
    sentences = [s for s in SENTENCE.split(text.strip()) if words_of(s)]
    if len(sentences) < 2:
        return words_of(text), []
    return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if size else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's shingles that stand in the passage; 1 for an empty part."""
    own = shingles(part)
    return len(own & shingles(passage, min(SHINGLE, len(part)))) / len(own) if own else 1.0


def length_class(n_words: int) -> int:
    """Items of up to 2 ** length_class words share a class."""
    return max(5, (n_words - 1).bit_length())


class LengthClass:
    """Index of the items of one length class over word numbers 0..n_words-1 (n_words: none)."""

    def __init__(self, longest: int, keys: list, items: list[tuple[list[str], list[str]]],
                 impacts: list[dict[int, float]], common: set[int], n_words: int):
        self.stride, self.window = longest, 2 * longest
        self.keys, self.items = keys, items
        lists: dict[int, list[tuple[int, float]]] = {}
        for item, own in enumerate(impacts):
            for word, impact in own.items():
                lists.setdefault(word, []).append((item, impact))
        self.lists = lists
        self.largest = {w: max(x for _, x in p) for w, p in lists.items()}
        self.blocks: dict[int, dict[int, float]] = {}
        width = -(-len(items) // BOUND_COLUMNS)
        self.bound = np.zeros((n_words + 1, -(-len(items) // width)), np.float32)
        for w, postings in lists.items():
            own = self.blocks.setdefault(w, {})
            for item, x in postings:
                own[item // BLOCK_ITEMS] = max(own.get(item // BLOCK_ITEMS, 0.0), x)
                self.bound[w, item // width] = max(self.bound[w, item // width], x)
        self.rare = self.bound.copy()
        self.rare[sorted(common)] = 0
        once = np.zeros(len(items), np.float32)
        for w in common:
            for item, x in lists.get(w, ()):
                once[item] += x
        self.constant = np.array([once[i:i + width].max() for i in range(0, len(items), width)], np.float32)

    def passages(self, ids: np.ndarray, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, distinct word numbers) of the passages that no bound rules out."""
        n, lowest = len(ids), threshold - SLACK
        step = max(1, SEGMENT_WORDS // self.stride)
        starts = np.arange(0, max(1, n - self.window + self.stride), self.stride)
        for at in range(0, len(starts), step):
            start = starts[at:at + step]
            end = np.minimum(start + self.window, n)
            first = start[0]
            sums = np.zeros((end[-1] - first + 1, self.rare.shape[1]), np.float32)
            np.cumsum(self.rare[ids[first:end[-1]]], axis=0, out=sums[1:])
            bound = sums[end - first] - sums[start - first] + self.constant
            for i in np.flatnonzero((bound >= lowest).any(axis=1)):
                distinct = np.unique(ids[start[i]:end[i]])
                if (self.bound[distinct].sum(axis=0) >= lowest).any():
                    yield int(start[i]), int(end[i]), distinct

    def retrieve(self, words, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with score >= threshold."""
        lists, largest, blocks = self.lists, self.largest, self.blocks
        cursors = [[lists[w][0][0], 0, w] for w in words if w in lists]
        found, least = [], threshold - 1e-9

        def forward(moved: list[list], to: int) -> None:
            """Move cursors to the first posting at or after an item; spent ones go."""
            spent = False
            for c in moved:
                own, i = lists[c[2]], c[1]
                while i < len(own) and own[i][0] < to:
                    i += 1
                c[1] = i
                if i < len(own):
                    c[0] = own[i][0]
                else:
                    c[0] = -1
                    spent = True
            if spent:
                cursors[:] = [c for c in cursors if c[0] >= 0]

        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for i, c in enumerate(cursors):
                total += largest[c[2]]
                if total >= least:
                    pivot = i
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            ahead = cursors[:pivot + 1]
            if sum(blocks[c[2]].get(block, 0.0) for c in ahead) < least:
                beyond = (block + 1) * BLOCK_ITEMS
                forward(ahead, min(beyond, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else beyond)
            elif cursors[0][0] == item:
                score = sum(lists[c[2]][c[1]][1] for c in ahead)
                if score >= least:
                    found.append((item, score))
                forward(ahead, item + 1)
            else:
                forward([c for c in ahead if c[0] < item], item)
        return found


class Index:
    """Word numbers and the length classes of one part of the benchmark."""

    def __init__(self, rows: list[tuple], frequency: dict[str, int], n_items: int, mean_words: float):
        self.vocabulary = {w: i for i, w in enumerate(sorted(frequency))}
        n_words = len(self.vocabulary)
        common = {self.vocabulary[w] for w, n in frequency.items() if n > COMMON_SHARE * n_items}
        by_class: dict[int, list] = {}
        self.alone = len(rows) == 1
        self.short: dict[str, list[tuple[list[str], object]]] = {}      # first word -> word sequence and key
        for key, text in rows:
            words = words_of(text)
            if len(words) < SHORT_ITEM_WORDS:
                self.short.setdefault(words[0], []).append((words, key))
                continue
            by_class.setdefault(length_class(len(words)), []).append((key, text, words))
        self.classes = []
        for size, members in sorted(by_class.items()):
            impacts = []
            for _, _, words in members:
                own = {}
                for w, tf in Counter(words).items():
                    n = frequency[w]
                    own[self.vocabulary[w]] = (math.log(1 + (n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1)
                                               / (tf + K1 * (1 - B + B * len(words) / mean_words)))
                whole = sum(own.values())
                impacts.append({w: x / whole for w, x in own.items()})
            self.classes.append(LengthClass(1 << size, [m[0] for m in members],
                                            [question_and_answer(m[1]) for m in members], impacts, common, n_words))

    def matches(self, text: str | None, threshold: float, least_overlap: float) -> list[tuple]:
        """(item key, best score, question overlap, answer overlap) of the verified items."""
        words = words_of(text)
        if not words:
            return []
        unknown = len(self.vocabulary)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(unknown)), np.int64, len(words))
        out = []
        for c in self.classes:
            best: dict[int, tuple] = {}
            for start, end, distinct in c.passages(ids, threshold):
                for item, score in c.retrieve(distinct.tolist(), threshold):
                    question, answer = c.items[item]
                    passage = words[start:end]
                    q, a = overlap(question, passage), overlap(answer, passage)
                    if q >= least_overlap and a >= least_overlap:
                        best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (min(1.0, score), q, a))
            out += [(c.keys[i], *x) for i, x in sorted(best.items())]
        if self.short and not self.short.keys().isdisjoint(words):
            held = {id(item): item[1] for i, w in enumerate(words) for item in self.short.get(w, ())
                    if words[i:i + len(item[0])] == item[0]}
            out += [(key, 1.0, 1.0, 1.0) for key in held.values()]
        return out

    def shared(self, spark, limit: int):
        """Its broadcast copy: measured, but for a single item's."""
        return spark.sparkContext.broadcast(self) if self.alone else bounded_broadcast(spark, self, max(limit, BROADCAST_BYTES))


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  part_chars: int = PART_CHARS, limit: int = BROADCAST_BYTES) -> Iterator[Index]:
    """The benchmark in parts of at most ``limit`` bytes each; frequencies are those of all items."""
    id_type = benchmark.select(f"`{id_col}`").schema[0].dataType.simpleString()
    items = by_row(benchmark, {"id": id_col, "text": text_col}, f"id {id_type}, text string, words array<string>, n long",
                   lambda _, key, text: (key, text, sorted(set(w := words_of(text))), len(w))).filter("n > 0")
    ranked = F.col("n") >= SHORT_ITEM_WORDS
    whole = items.agg(F.count_if(ranked).alias("items"), F.avg(F.when(ranked, F.col("n"))).alias("mean"),
                      F.sum(F.length("text")).alias("chars")).first()
    if not whole["chars"]:
        return
    parts = -(-whole["chars"] // part_chars)
    items = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    found = items.filter(ranked).select("part", F.explode("words").alias("word"))
    frequency = found.groupBy("word").agg(F.count("*").alias("items"))
    for part in range(parts):
        rows = [(r["id"], r["text"]) for r in items.filter(F.col("part") == part).select("id", "text").collect()]
        own = found.filter(F.col("part") == part).select("word").distinct()
        if rows:
            yield from _fitting(rows, {r["word"]: r["items"] for r in frequency.join(own, "word").collect()},
                                whole["items"], whole["mean"], limit)


def _fitting(rows: list[tuple], frequency: dict[str, int], n_items: int, mean_words: float, limit: int) -> Iterator[Index]:
    """Indexes of at most ``limit`` bytes; the bound tables are reckoned before they are built."""
    classes = Counter(length_class(n) for _, text in rows if (n := len(words_of(text))) >= SHORT_ITEM_WORDS)
    tables = 8 * (len(frequency) + 1) * sum(min(n, BOUND_COLUMNS) for n in classes.values())
    if len(rows) == 1 or tables <= 2 * limit:
        index = Index(sorted(rows, key=str), frequency, n_items, mean_words)
        if len(rows) == 1 or len(pickle.dumps(index, protocol=pickle.HIGHEST_PROTOCOL)) <= limit:
            yield index
            return
        del index
    rows = sorted(rows, key=lambda r: (len(words_of(r[1])), str(r)))
    for half in (rows[:len(rows) // 2], rows[len(rows) // 2:]):
        yield from _fitting(half, {w: frequency[w] for _, text in half if len(words_of(text)) >= SHORT_ITEM_WORDS for w in words_of(text)}, n_items, mean_words, limit)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_overlap: float = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", part_chars: int = PART_CHARS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(document id, item id, score, question_overlap, answer_overlap), one row for each verified pair."""
    spark = docs.sparkSession
    item_type = benchmark.select(f"`{item_col}`").schema[0].dataType
    id_type = docs.select(f"`{id_col}`").schema[0].dataType
    schema = (f"`{id_col}` {id_type.simpleString()}, `{item_col}` {item_type.simpleString()}, score double, "
              "question_overlap double, answer_overlap double")
    types = [to_arrow_type(id_type), to_arrow_type(item_type)] + [pa.float64()] * 3
    names = [id_col, item_col, "score", "question_overlap", "answer_overlap"]
    passes = []
    for index in build_indexes(benchmark, item_col, item_text_col, part_chars, limit):
        shared = index.shared(spark, limit)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(key, *m) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                       for m in shared.value.matches(text, threshold, least_overlap)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        passes.append(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(search, schema))
    return reduce(DataFrame.unionAll, passes) if passes else spark.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, without a verified item (narrow, no join)."""
    for index in build_indexes(benchmark, item_col, item_text_col, limit=limit):
        shared = index.shared(docs.sparkSession, limit)
        docs = docs.filter(F.pandas_udf(_clean(shared), "boolean")(F.col(f"`{text_col}`")))
    return docs


def _clean(shared):
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.matches(t, THRESHOLD, OVERLAP) for t in texts], dtype=bool)

    return clean
