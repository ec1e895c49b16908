"""Periodic runs of words: a Re-Pair grammar, runs crossing each nonterminal's boundary, translated and merged.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) and at least ``max(min_words, 2 q)`` words that no
neighbouring word extends.  Per document:

1. **Stretches.**  Every word of a run lies in a window of ``min_words / 2``
   words that occurs again in the document (shifted by the period).  Only
   stretches covered by such windows go on; windows are compared by hash here,
   so a collision keeps a stretch too many and never loses one.
2. **Grammar.**  Re-Pair replaces the most frequent pair (of equals, the one
   seen first, which keeps derivations flat) until none occurs twice.  What is
   left of a stretch is joined by a balanced binary tree, so every boundary
   between two words belongs to one node of a derivation.
3. **Crossing runs, once a nonterminal.**  A run crossing boundary ``c`` with
   period ``q`` matches itself at distance ``q`` over at least half of
   ``min_words`` words that hold ``c - 1`` (or, counted from its other end,
   ``c``).  So the windows around ``c`` name all possible periods, and the
   longest common extensions to both sides, cut at the node's ends, give the
   run.  Extensions are read from ranks of windows of 1, 2, 4, ... words, all
   candidates at a time.
4. **Translation and merging.**  A nonterminal's runs are put at all its
   derivation positions.  A run of the text is found whole at the lowest node
   that contains it; what other nodes cut from it overlaps it by a period and
   is united with it.

Memory grows with one sub-batch of texts (``BATCH_WORDS`` words, or one longer
text); no group of rows is ever gathered.

Defined results: a null or empty text has no runs and an empty collapsed text;
texts are read whole; each row is judged on its own, so ties and repeated rows
need no rule; a null id counts as an empty one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

MIN_WORDS = 12
#: Words of texts that are looked at together.
BATCH_WORDS = 1 << 18
#: Candidates (boundary, period) that are extended together.
BATCH_CANDIDATES = 1 << 21

Run = tuple[int, int, int]          # start, length, period


def repair(words: list[int]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair of ``words`` (negative numbers divide): (rules, what is left between the dividers).

    Rule ``k`` derives symbol ``base + k`` with ``base = max(words) + 1``.
    """
    n = len(words)
    base = max(words, default=-1) + 1
    sym, after, before = list(words), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for p, pair in enumerate(zip(words, words[1:])):
        if pair[0] >= 0 and pair[1] >= 0:
            places.setdefault(pair, []).append(p)
    live = {pair: len(at) for pair, at in places.items()}
    queue = [(-k, i, pair) for i, (pair, k) in enumerate(live.items()) if k > 1]
    heapq.heapify(queue)
    seen, rules, gone = len(live), [], -1 - n          # ``gone``: the place of a symbol that was replaced
    while queue:
        k, order, pair = heapq.heappop(queue)
        now = live.get(pair, 0)
        if now < 2:
            continue
        if now != -k:
            heapq.heappush(queue, (-now, order, pair))
            continue
        a, b = pair
        spots, taken = [], -1
        for p in places.pop(pair):
            if sym[p] == a and p != taken and (q := after[p]) < n and sym[q] == b:
                spots.append(p)
                taken = q
        del live[pair]
        if len(spots) < 2:
            continue
        x, new = base + len(rules), {}
        rules.append(pair)
        for p in spots:
            q = after[p]
            left, right = before[p], after[q]
            sym[p], sym[q], after[p] = x, gone, right
            if right < n:
                before[right] = p
                if (r := sym[right]) >= 0:
                    if (b, r) in live:
                        live[b, r] -= 1
                    new.setdefault((x, r), []).append(p)
            if left >= 0 and (s := sym[left]) >= 0:
                if (s, a) in live:
                    live[s, a] -= 1
                elif (s, a) in new and s == x:
                    new[s, a].pop()                    # its right part has just become ``x``
                new.setdefault((s, x), []).append(left)
        for made, at in new.items():
            if len(at) > 1:
                places[made], live[made] = at, len(at)
                heapq.heappush(queue, (-len(at), seen, made))
                seen += 1
    left, part, p = [], [], 0
    while p < n:
        if sym[p] < 0:
            left.append(part)
            part = []
        else:
            part.append(sym[p])
        p = after[p]
    left.append(part)
    return rules, left


class Nodes:
    """Boundaries (lo, c, hi) of the batch's stretches, and where each node's runs have to be put."""

    def __init__(self, least: int):
        self.least, self.lo, self.c, self.hi = least, [], [], []
        self.node, self.at = [], []              # occurrence: node number, first word

    def add(self, lo: int, c: int, hi: int) -> int:
        self.lo.append(lo), self.c.append(c), self.hi.append(hi)
        return len(self.c) - 1

    def stretch(self, words: list[int], start: int) -> None:
        """Nodes of the stretches in ``words`` (divided by negative numbers), whose first word is number ``start``."""
        rules, parts = repair(words)
        base = max(words, default=-1) + 1
        size = [1] * base
        for a, b in rules:
            size.append(size[a] + size[b])
        known: dict[int, int] = {}               # nonterminal -> its node, made at its first occurrence
        at = start
        for part in parts:
            ends = [at]
            for s in part:
                ends.append(ends[-1] + size[s])
            todo = [(0, len(part))]
            while todo:                           # what Re-Pair left: a balanced tree over its symbols
                i, j = todo.pop()
                if ends[j] - ends[i] < self.least:
                    continue
                if j - i == 1:
                    self.derive(part[i], ends[i], base, rules, size, known)
                    continue
                middle = (ends[i] + ends[j]) / 2
                m = min(max(int(np.searchsorted(ends, middle)), i + 1), j - 1)
                if m - 1 > i and middle - ends[m - 1] < ends[m] - middle:
                    m -= 1
                self.node.append(self.add(ends[i], ends[m], ends[j]))
                self.at.append(ends[i])
                todo += [(i, m), (m, j)]
            at = ends[-1] + 1

    def derive(self, symbol: int, at: int, base: int, rules, size, known) -> None:
        todo = [(symbol, at)]
        while todo:
            s, at = todo.pop()
            if size[s] < self.least:
                continue
            a, b = rules[s - base]
            if s not in known:
                known[s] = self.add(at, at + size[a], at + size[s])
            self.node.append(known[s])
            self.at.append(at)
            todo += [(a, at), (b, at + size[a])]


class Extensions:
    """Longest common extensions of two places of ``words``, from ranks of windows of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.ranks = [words.astype(np.int64)]
        width = 1
        while True:                               # until all windows differ: no extension is longer
            last = self.ranks[-1]
            m = n - 2 * width + 1
            if m < 2:
                break
            codes, kinds = pd.factorize(last[:m] * np.int64(n + 1) + last[width:width + m])
            if len(kinds) == m:
                break
            self.ranks.append(codes.astype(np.int64))
            width *= 2

    def window(self, width: int) -> np.ndarray:
        """Numbers of all windows of ``width`` words; equal numbers are equal windows."""
        code, done = None, 0
        for k in reversed(range(len(self.ranks))):
            while width - done >= 1 << k:
                part = self.ranks[k][done:]
                m = self.n - width + 1
                code = part[:m] if code is None else pd.factorize(code[:m] * np.int64(self.n + 1) + part[:m])[0]
                done += 1 << k
        return code

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that are equal from x and y (x < y) on."""
        got = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.ranks))):
            r = self.ranks[k]
            fits = y + got < len(r)
            same = np.zeros(len(x), bool)
            same[fits] = r[x[fits] + got[fits]] == r[y[fits] + got[fits]]
            got[same] += 1 << k
        return got

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that are equal in front of x and y (x < y)."""
        got = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.ranks))):
            r, w = self.ranks[k], 1 << k
            i = x - got - w
            j = np.minimum(y - got - w, len(r) - 1)
            fits = (i >= 0) & (j == y - got - w)
            same = np.zeros(len(x), bool)
            same[fits] = r[i[fits]] == r[j[fits]]
            got[same] += w
        return got


def crossing_runs(words: np.ndarray, lo, c, hi, least: int) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs within [lo, hi) that hold words c - 1 and c, for each node."""
    half = least // 2
    lo, c, hi = (np.asarray(v, np.int64) for v in (lo, c, hi))
    none = (np.zeros(0, np.int64),) * 4
    ext = Extensions(words)
    codes = ext.window(half) if len(words) >= half else None
    if codes is None or not len(c):
        return none
    n = np.int64(len(codes) + 1)
    keys = codes * n + np.arange(len(codes))
    order = np.argsort(keys)
    keys = keys[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    step = 1 << 17
    found = []
    for first in range(0, len(c), step):
        node = np.repeat(np.arange(first, min(first + step, len(c))), half + 1)
        w = c[node] + np.tile(np.arange(-half, 1), len(node) // (half + 1))
        ok = (w >= lo[node]) & (w + half <= hi[node])
        node, w = node[ok], w[ok]
        for later in (True, False):
            # windows that hold c - 1, matched later; windows that hold c, matched earlier
            pick = (w < c[node]) if later else (w > c[node] - half)
            nd, x = node[pick], w[pick]
            a = place[x] + 1 if later else np.searchsorted(keys, codes[x] * n + lo[nd])
            b = np.searchsorted(keys, codes[x] * n + hi[nd] - half, "right") if later else place[x]
            count = np.maximum(b - a, 0)
            total = np.concatenate(([0], np.cumsum(count)))
            i = 0
            while i < len(nd):
                j = max(i + 1, int(np.searchsorted(total, total[i] + BATCH_CANDIDATES, "right")) - 1)
                k = count[i:j]
                spot = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], k) + np.repeat(a[i:j], k)
                q = np.abs(order[spot] - np.repeat(x[i:j], k))
                tasks = pd.unique(np.repeat(nd[i:j], k) * n + q)
                found.append(_extended(ext, tasks // n, tasks % n, later, lo, c, hi, least))
                i = j
    node, start, end, q = (np.concatenate(v) for v in zip(*found)) if found else none
    # a multiple of the period gives the same stretch: the smallest stays
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    if len(node):
        new = np.concatenate(([True], (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
        node, start, end, q = node[new], start[new], end[new], q[new]
    return node, start, end, q


def _extended(ext: Extensions, node, q, later, lo, c, hi, least):
    b = c[node]
    x, y = (b, b + q) if later else (b - q, b)
    fits = (x >= lo[node]) & (y <= hi[node])
    node, q, b, x, y = node[fits], q[fits], b[fits], x[fits], y[fits]
    start = x - np.minimum(ext.backward(x, y), x - lo[node])
    end = y + np.minimum(ext.forward(x, y), hi[node] - y)
    good = (start < b) & (end > b) & (end - start >= np.maximum(least, 2 * q))
    return node[good], start[good], end[good], q[good]


def _covered(hashes: np.ndarray, lengths: np.ndarray, half: int) -> np.ndarray:
    """Marks the words that lie in a window of ``half`` words whose hash occurs again in its text."""
    n = len(hashes)
    out = np.zeros(n, bool)
    m = n - half + 1
    if m < 2:
        return out
    text = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    code = text[:m] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(half):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k:k + m]
    inside = text[:m] == text[half - 1:half - 1 + m]
    again = np.zeros(m, bool)
    again[inside] = pd.Series(code[inside]).duplicated(keep=False).to_numpy()
    edge = np.zeros(n + 1, np.int64)
    edge[:m] += again
    edge[half:half + m] -= again
    return np.cumsum(edge)[:n] > 0


def runs_of(texts: list[list], min_words: int = MIN_WORDS) -> list[list[Run]]:
    """The runs of each list of words (any hashable words), by start, then period."""
    half = min_words // 2
    lengths = np.array([len(t) for t in texts], np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    if not lengths.sum():
        return out
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(lengths.sum())).astype(np.uint64)
    marks = _covered(hashes, lengths, half)
    first = np.concatenate(([0], np.cumsum(lengths)))
    flat: list[int] = []                          # words of all stretches, each followed by a divider
    home: list[tuple[int, int, int]] = []         # (place in flat, text, place in text) of each stretch
    nodes = Nodes(min_words)
    for t in np.flatnonzero(np.add.reduceat(np.append(marks, False), np.minimum(first[:-1], len(marks))) * (lengths > 0)):
        mine = marks[first[t]:first[t + 1]]
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
        ids: dict = {}
        words: list[int] = []
        begin = len(flat)
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
            if b - a >= min_words:
                home.append((begin + len(words), int(t), a))
                words += [ids.setdefault(w, len(ids)) for w in texts[t][a:b]]
                words.append(-1)
        if words:
            nodes.stretch(words[:-1], begin)
            flat += words
    if not home:
        return out
    # words of different texts never meet: nodes end at dividers, which are unlike anything
    array = np.array(flat, np.int64)
    divider = array < 0
    array[divider] = array.max() + 1 + np.arange(divider.sum())
    node, start, end, q = crossing_runs(array, nodes.lo, nodes.c, nodes.hi, min_words)
    # every node's runs at all its derivation positions
    low = np.searchsorted(node, np.arange(len(nodes.c)))
    high = np.searchsorted(node, np.arange(len(nodes.c)), "right")
    occ, at = np.array(nodes.node, np.int64), np.array(nodes.at, np.int64)
    k = high[occ] - low[occ]
    spot = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[occ], k)
    shift = np.repeat(at - np.array(nodes.lo, np.int64)[occ], k)
    start, end, q = start[spot] + shift, end[spot] + shift, q[spot]
    order = np.lexsort((-end, start, q))
    whole: list[list[int]] = []
    for s, e, p in zip(start[order].tolist(), end[order].tolist(), q[order].tolist()):
        if whole and whole[-1][2] == p and s + p <= whole[-1][1]:     # one run, or parts of it
            whole[-1][1] = max(e, whole[-1][1])
        else:
            whole.append([s, e, p])
    places = np.array([h[0] for h in home])
    for s, e, p in whole:
        place, t, a = home[int(np.searchsorted(places, s, "right")) - 1]
        out[t].append((a + s - place, e - s, p))
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def digest_rewrite(key, words: list) -> list:
    """The rewriting that the registered query's contract asks for: one document in ten becomes periodic."""
    h, n = zlib.crc32(("" if key is None else str(key)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _map(docs: DataFrame, id_col: str, text_col: str, fields: str, min_words: int, row: Callable,
         rewrite: Callable | None) -> DataFrame:
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    schema = StructType.fromDDL(f"`{id_col}` {id_type}, {fields}")
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys, texts):
            out = [(k, *row(w, r)) for k, w, r in zip(keys, texts, runs_of(texts, min_words))]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py()
                words = (text or "").encode().split()          # bytes are split at \x20 and \x09-\x0D only
                keys.append(key)
                texts.append(rewrite(key, words) if rewrite else words)
                size += len(words)
                if size >= BATCH_WORDS:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield flush(keys, texts)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, runs, collapsed): all runs of every text, and the text without a run's words after its first period."""
    return _map(docs, id_col, text_col,
                "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", min_words,
                lambda words, runs: ([dict(zip(("start", "length", "period"), r)) for r in runs],
                                     b" ".join(collapsed(words, runs)).decode()), None)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                rewrite: Callable | None = None) -> DataFrame:
    """One row a text: number of runs, the longest run, digests of all runs and of the collapsed text."""
    def row(words, runs):
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
        return (len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2],
                sha256(listed).hexdigest(), sha256(b" ".join(collapsed(words, runs))).hexdigest())

    return _map(docs, id_col, text_col, "n_runs long, start long, length long, period long, exponent_milli long, "
                "runs_sha256 string, collapsed_sha256 string", min_words, row, rewrite)
