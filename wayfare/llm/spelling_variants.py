"""Spelling variants: k-d trees over letter-count vectors find words one edit apart.

Two words are near if exactly one inserted, deleted or replaced code point
lies between them.  Their letter counts then differ by one letter more (words
of neighbouring lengths) or by one more and one less (words of one length), so
vectors of letter counts are at most 2 apart in L1.

1. **Words** are counted per Arrow batch, then by a grouped sum.
2. **Cells.**  The upper levels of one k-d tree per word length are fitted on a
   sample of ``SAMPLE`` words; they say where work is done, never the result.
   A word is stored in the cell of its vector and asked for in every cell of
   its own and the next length whose box is within one letter more (and, at
   its own length, one less).  A cell with more than ``CELL`` words beyond
   ``CELL_SLACK`` times is dealt out by word hash, and asked in every part.
3. **Search.**  Sorted partitions stream cell after cell: a local k-d tree over
   the cell's distinct vectors answers batches of distinct asked vectors by
   pruning boxes, leaves compare vectors.
4. **Letter order.**  For a matched pair of vectors the one or two letters that
   differ are known, so a word's possible partners are made by one edit and
   looked up; anagrams are never paired with one another.
5. A cell gives one row a word (near words, and the best of them); these are
   summed.  A word's *form* is its near word with most occurrences (of equals
   the smallest in code-point order) if it occurs ``RATIO`` times as often; the
   *root* follows forms to the end.  Counts grow tenfold at each step, so
   doubling the links a few times reaches every root.

Defined results: a null or empty text has no words; texts are read whole;
repeated rows count each time; a null id counts as an empty one; ties go to the smallest word; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import bounded_broadcast, checkpointed

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words that the upper tree levels are fitted on at most, and the longest of them.
SAMPLE, SAMPLE_LENGTH = 40_000, 64
#: Words that a cell should hold; beyond CELL_SLACK times as many it is dealt out.
CELL, CELL_SLACK = 16_384, 4
LEAF = 24
#: Asked words that are answered together, and entries of one block of vector differences.
ASKED, BLOCK = 8_192, 1 << 21
#: Up to this length partners are made and looked up; longer words are compared letter by letter.
MADE_LENGTH = 256
#: Distinct words that a task counts before it hands them on.
KEPT_WORDS = 200_000


# -- words ----------------------------------------------------------------------

def digest_rewrite(key, run: str) -> str:
    """The rewriting that the registered query's contract asks for: in one of 31 (document, run) pairs a letter is lost."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    if h % 31:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable | None = None,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of runs of Latin letters, A-Z lower-cased; ``rewrite(id, run)`` may change a run, never lengthen it."""
    found = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                              names=["word", "n"])
        total: Counter = Counter()
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                if (text := text.as_py()):
                    runs = found.findall(text.encode().lower().decode())       # bytes: only A-Z change
                    if rewrite is None:
                        total.update(runs)
                    else:
                        key = key.as_py()
                        for w, n in Counter(runs).items():
                            if len(w := rewrite(key, w)) >= min_length:
                                total[w] += n
                    if len(total) >= KEPT_WORDS:
                        yield flush()
                        total.clear()
        if total:
            yield flush()

    counted = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# -- vectors and trees ------------------------------------------------------------

def vectors(words: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts of each word, and its number of letters that ``letters`` lacks."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    column = np.full(0x110000 if len(codes) and codes.max() > 0xFFFF else 0x10000, len(letters), np.int64)
    for x, k in letters.items():
        column[ord(x)] = k
    width = len(letters) + 1
    flat = np.bincount(np.repeat(np.arange(len(words)), size) * width + column[codes], minlength=len(words) * width)
    flat = flat.reshape(len(words), width).astype(np.int16 if not len(size) or size.max() < 1 << 15 else np.int64)
    return flat[:, :-1], flat[:, -1]


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, value) that halves ``points`` best among those spread widest; None if all are equal."""
    low, high = points.min(axis=0), points.max(axis=0)
    if not (high > low).any():
        return None
    middle = np.clip(np.median(points, axis=0).astype(points.dtype), low, np.maximum(high - 1, low))
    below = (points <= middle).sum(axis=0)
    # the value under the median may halve a dimension of few values better
    under = np.maximum(middle - 1, low)
    below_under = (points <= under).sum(axis=0)
    better = np.abs(2 * below_under - len(points)) < np.abs(2 * below - len(points))
    middle, below = np.where(better, under, middle), np.where(better, below_under, below)
    off = np.where(high > low, np.abs(2 * below - len(points)), len(points) + 1)
    d = int(np.argmin(off))
    return d, int(middle[d])


def build(points: np.ndarray, at: np.ndarray, leaf: int):
    """A k-d tree: ("leaf", rows) or (dimension, value, at most, above)."""
    cut = _cut(points[at]) if len(at) > leaf else None
    if cut is None:
        return "leaf", at
    d, v = cut
    left = points[at, d] <= v
    return d, v, build(points, at[left], leaf), build(points, at[~left], leaf)


def search(tree, asked: np.ndarray, up: int, down: np.ndarray, visit: Callable) -> None:
    """Calls ``visit(leaf, rows of asked)`` for each leaf whose box may hold a vector with ``up`` letters
    more and ``down`` (one number a row) less than an asked one."""
    def go(node, rows, more, less, box):
        if not len(rows):
            return
        if node[0] == "leaf":
            visit(node[1], rows)
            return
        d, v, left, right = node
        value = asked[rows, d].astype(np.int64)
        low, high = box.get(d, (None, None))
        # at most v: letters that an asked vector has too many of; above v: those that it lacks
        lost = less + np.maximum(value - v, 0) - (0 if high is None else np.maximum(value - high, 0))
        ok = lost <= down[rows]
        go(left, rows[ok], more[ok], lost[ok], {**box, d: (low, v)})
        gained = more + np.maximum(v + 1 - value, 0) - (0 if low is None else np.maximum(low - value, 0))
        ok = gained <= up
        go(right, rows[ok], gained[ok], less[ok], {**box, d: (v + 1, high)})

    n = len(asked)
    go(tree, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), {})


# -- upper levels -------------------------------------------------------------------

def fit_cells(sample: list[str], per_cell: float) -> tuple[dict, dict]:
    """(letters, trees by word length): trees with about ``per_cell`` sample words a leaf; leaves hold their number."""
    letters = {x: k for k, x in enumerate(sorted(set("".join(sample))))}
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    trees = {}
    for length, words in by_length.items():
        points = vectors(words, letters)[0]
        count = 0

        def numbered(node):
            nonlocal count
            if node[0] == "leaf":
                count += 1
                return "leaf", count - 1
            return node[0], node[1], numbered(node[2]), numbered(node[3])

        trees[length] = numbered(build(points, np.arange(len(points)), max(1, int(per_cell))))
    return letters, trees


def cells_of(words: list[str], letters: dict, trees: dict, up: int, down: int, longer: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(length of the cell, its number, rows of ``words``) of the cells of words ``longer`` letters longer."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        tree = trees.get(length + longer)
        if tree is None:
            yield length + longer, 0, at
            continue
        points = vectors([words[i] for i in at], letters)[0]
        out: list = []
        # letters that the sample lacks are in no box; leaving them out brings vectors closer, never apart
        search(tree, points, up, np.full(len(at), down), lambda leaf, rows: out.append((leaf, rows)))
        for leaf, rows in out:
            yield length + longer, leaf, at[rows]


# -- search in a cell ------------------------------------------------------------------

class Cell:
    """The stored words of a cell and what asked words find among them."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.classes: dict[str, list[str]] = {}
        for w in words:
            self.classes.setdefault("".join(sorted(w)), []).append(w)
        self.sorted = list(self.classes)
        self.letters = {x: k for k, x in enumerate(sorted(set("".join(self.sorted))))}
        self.names = list(self.letters)
        self.points = vectors(self.sorted, self.letters)[0]
        self.tree = build(self.points, np.arange(len(self.points)), LEAF)

    def matches(self, asked: list[str], longer: int) -> Iterator[tuple[int, int, str, str]]:
        """(row of ``asked`` sorted words, row of the cell's, letter that is lost, letter that is gained)."""
        points, strange = vectors(asked, self.letters)
        far, down = 2 - longer, 1 - longer
        fits = np.flatnonzero(strange <= down)
        points, strange = points[fits], strange[fits]
        found: list = []

        def visit(leaf, rows):
            step = max(1, BLOCK // max(1, len(leaf) * self.points.shape[1]))
            for k in range(0, len(rows), step):
                r = rows[k:k + step]
                apart = self.points[leaf][None] - points[r][:, None]
                i, j = np.nonzero(np.abs(apart).sum(axis=2) + strange[r][:, None] == far)
                if len(i):
                    a = apart[i, j]
                    found.append((r[i], leaf[j], a.argmin(axis=1), a.min(axis=1) < 0, a.argmax(axis=1)))

        search(self.tree, points, 1, down - strange.astype(np.int64), visit)
        for r, leaf, lost, known, gained in found:
            for i, j, x, has, y in zip(fits[r].tolist(), leaf.tolist(), lost.tolist(), known.tolist(), gained.tolist()):
                if longer:
                    yield i, j, "", self.names[y]
                elif has:
                    yield i, j, self.names[x], self.names[y]
                else:
                    yield i, j, next(c for c in asked[i] if c not in self.letters), self.names[y]


def partners(word: str, lost: str, gained: str, others: list[str], known: dict[str, int]) -> Iterator[str]:
    """The words of the class ``others`` that are ``word`` with ``lost`` replaced by ``gained`` (or ``gained`` put in)."""
    if len(word) > MADE_LENGTH:
        for o in others:
            k = next((k for k, (a, b) in enumerate(zip(word, o)) if a != b), len(word))
            if word[k + 1 if lost else k:] == o[k + 1:]:
                yield o
        return
    for k in range(len(word) + (not lost)):
        if lost:
            if word[k] == lost and (made := word[:k] + gained + word[k + 1:]) in known:
                yield made
        elif (k == 0 or word[k - 1] != gained) and (made := word[:k] + gained + word[k:]) in known:
            yield made


def _search_cell(cell: Cell, asked: list[tuple[str, int]], longer: int, tell: Callable) -> None:
    classes: dict[str, list[tuple[str, int]]] = {}
    for w, n in asked:
        classes.setdefault("".join(sorted(w)), []).append((w, n))
    keys = list(classes)
    for i, j, lost, gained in cell.matches(keys, longer):
        others = cell.classes[cell.sorted[j]]
        for w, n in classes[keys[i]]:
            for o in partners(w, lost, gained, others, cell.words):
                tell(w, o, cell.words[o])
                if longer:                      # the longer word does not ask among the shorter ones
                    tell(o, w, n)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cell, kind, word, n): stored words (kind 0), words of the same length (1), of one letter less (2)."""
    best: dict[str, list] = {}

    def tell(word: str, near: str, n: int) -> None:
        b = best.get(word)
        if b is None:
            best[word] = [1, n, near]
        else:
            b[0] += 1
            if n > b[1] or (n == b[1] and near < b[2]):
                b[1:] = n, near

    def flush():
        rows = [(w, k, n, o) for w, (k, n, o) in best.items()]
        best.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          names=["word", "n_near", "near_n", "near"])

    at, stored, cell, asked, kind = None, {}, None, [], 0

    def answer():
        nonlocal cell
        if asked and stored:
            cell = cell or Cell(stored)
            _search_cell(cell, asked, kind - 1, tell)
        asked.clear()

    for b in batches:
        for c, k, w, n in zip(*(b.column(i).to_pylist() for i in range(4))):
            if c != at:
                answer()
                at, stored, cell = c, {}, None
                if len(best) >= ASKED:
                    yield flush()
            if k == 0:
                stored[w] = n
                continue
            if k != kind or len(asked) >= ASKED:
                answer()
                kind = k
            asked.append((w, n))
    answer()
    if best:
        yield flush()


# -- the operator -------------------------------------------------------------------------

def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n_near, near_n, near): how many words are one edit away, and the most frequent of them; words without any are left out."""
    spark = words.sparkSession
    total = words.count()
    # the sample is bounded in rows and in letters, and drawn where the words are: a share by hash, then the limit
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 0.9 * sample / max(total, 1)))
    taken = [r.word for r in words.filter((F.length("word") <= SAMPLE_LENGTH) & share).select("word").limit(sample).collect()]
    shared = bounded_broadcast(spark, fit_cells(taken, cell * len(taken) / max(total, 1)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, trees = shared.value
        for b in batches:
            w, n = b.column(0).to_pylist(), b.column(1)
            for kind, up, down, longer in ((0, 0, 0, 0), (1, 1, 1, 0), (2, 1, 0, 1)):
                for length, leaf, rows in cells_of(w, letters, trees, up, down, longer):
                    k = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, length), pa.int32()), pa.array(np.full(k, leaf), pa.int32()),
                         pa.array(np.full(k, kind), pa.int32()), pa.array([w[i] for i in rows], pa.string()), n.take(pa.array(rows))],
                        names=["length", "leaf", "kind", "word", "n"])

    routed = words.select("word", F.col("n").cast("long")).mapInArrow(route, "length int, leaf int, kind int, word string, n long")
    sizes = (words.select("word", "n").mapInArrow(_homes(shared), "length int, leaf int, k long").groupBy("length", "leaf")
             .agg(F.sum("k").alias("k")).filter(F.col("k") > cell * CELL_SLACK))
    parts = sizes.select("length", "leaf", F.ceil(F.col("k") / cell).cast("int").alias("parts"))
    routed = routed.join(F.broadcast(parts), ["length", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = routed.withColumn("part", F.explode(
        F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("word"), "parts").cast("int")))
        .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    keyed = dealt.select(F.struct("length", "leaf", "part").alias("c"), "kind", "word", "n")
    keyed = keyed.select(F.concat_ws(":", "c.length", "c.leaf", "c.part").alias("cell"), "kind", "word", "n")
    answers = (keyed.repartition(F.col("cell")).sortWithinPartitions("cell", "kind")
               .mapInArrow(_answers, "word string, n_near long, near_n long, near string"))
    return (answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
            .select("word", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.near").alias("near")))


def _homes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, trees = shared.value
        sizes: Counter = Counter()
        for b in batches:
            for length, leaf, rows in cells_of(b.column(0).to_pylist(), letters, trees, 0, 0, 0):
                sizes[length, leaf] += len(rows)
        if sizes:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sizes], pa.int32()), pa.array([k[1] for k in sizes], pa.int32()),
                 pa.array(sizes.values(), pa.int64())], names=["length", "leaf", "k"])
    return run


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word of ``links`` (word, form) by doubling; links never run in a circle."""
    reached = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = checkpointed(reached.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = nxt.select("word", "root")
        if nxt.filter("moved").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = RATIO, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""
    words = checkpointed(words.select("word", "n"))
    known = checkpointed(words.join(near_words(words, sample, cell), "word", "left"))
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = known.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(is_form, F.col("near_n")).alias("form_n"))
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable | None = None,
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Words of ``docs`` with the form and the root that they are variants of."""
    return variants(word_counts(docs, id_col, text_col, rewrite, min_length, min_count), ratio)
