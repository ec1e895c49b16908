"""Repeated-string removal by a partitioned enhanced suffix array.

Every byte covered by a ``LENGTH``-byte string that also starts in a document
with a smaller id is removed.  Strings are judged on the input and never
cross documents.

Partitioning the suffix array.  A suffix array of a whole corpus cannot be
sorted in one place, so suffixes are dealt out by *anchors*: of each
``LENGTH``-byte window the ``GRAM``-byte substring with the least hash.  Equal
windows have their anchor at the same offset, so all suffixes that share a
window meet in the bucket of its anchor; about one position in
``(LENGTH - GRAM) / 2`` is one.

1. *Chunks*: texts are cut at content-defined places; a chunk (with the
   ``LENGTH - 1`` bytes after it) that occurs in a smaller document is removed
   as a whole, so of any number of copies only the first is looked into.
2. *Shared anchors*: hashes of the anchors in all other chunks are grouped;
   those found in one document only are dropped.
3. *Buckets*: each shared anchor brings its context (all windows around it).
   A bucket's contexts are sorted from the anchor rightwards, a suffix array
   with its common-prefix array.  A stack scan lists the common-prefix
   intervals; within each, the contexts to the left are tested for diversity
   in the same way, so each group found is a maximal repeat that can be
   extended neither way without losing an occurrence (or reaches the end of
   the context).  All occurrences but those in the smallest document give
   their span.
4. The spans of a document are united.

Hot groups.  Equal contexts of a batch are combined before the shuffle, one
document stands for all.  Anchors that occur in over ``HOT_SHARE`` of a bounded
sample of documents are dealt out by three longer keys (their windows in three
ranges of offsets) instead of one, on all rows alike; which anchors these are
changes where work is done, never the result.  Hashes and contexts travel
packed and compressed by bucket range, not as a row each.

Defined results: a null or empty text has 0 bytes, as does its hash; texts
under ``LENGTH`` bytes lose nothing; rows without an id are not compared and
lose nothing; rows that share an id do not remove from each other and each row
is answered by its own text; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import bounded_broadcast, by_row, checkpointed

LENGTH = 50
GRAM = 20
#: One anchor in so many ends a chunk.
CHUNK_ANCHORS = 32
#: Documents looked at for hot anchors, at most about this many, and what makes an anchor hot among them.
SAMPLE_DOCS = 20_000
HOT_SHARE = 0.005
HOT_DOCS = 64
MOST_HOT = 500_000
#: Bucket ranges for each shuffle partition.
RANGES = 2
BYTES_AT_ONCE = 8 << 20
CONTEXTS_AT_ONCE = 50_000
PIECE_BYTES = 1 << 18

_TABLE = np.random.default_rng(20).integers(0, 2 ** 64, 256, dtype=np.uint64)
_MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CUT = np.uint64(0xA24BAED4963EE407)


# -- anchors and chunks ---------------------------------------------------------

def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash (never 0) of every GRAM-byte substring, by doubling a polynomial hash."""
    n = len(raw) - GRAM + 1
    part, width, power = _TABLE[np.frombuffer(raw, np.uint8)], 1, _MULTIPLIER
    out, done = None, 0
    while True:
        if GRAM & width:
            out = part[:n] if out is None else out[:n] * np.uint64(power) + part[done:done + n]
            done += width
        if done == GRAM:
            break
        part = part[:-width] * np.uint64(power) + part[width:]
        power, width = power * power % 2 ** 64, 2 * width
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.maximum(out ^ (out >> np.uint64(29)), np.uint64(1))


def _sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[:len(values) - (width - span)], values[width - span:]) if width > span else values


def _least_grams(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the least-hash substrings of all windows that cross none of ``ends``."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = LENGTH - GRAM + 1
    grams = gram_hashes(data)
    least = _sliding(grams, width, np.minimum)
    for step in range(1, LENGTH):                     # windows that start less than LENGTH bytes before an end
        at = ends - step
        least[at[(at >= 0) & (at < len(least))]] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    return at, grams[at]


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the least-hash substring of every window; all of them where several are least.

    Short texts are hashed together, a piece at a time; a long one in
    overlapping pieces of its own.
    """
    out: list[tuple] = []
    group: list[int] = []
    size = 0

    def flush() -> None:
        if group:
            lengths = np.array([len(raws[i]) for i in group], np.int64)
            ends = np.cumsum(lengths)
            at, hashes = _least_grams(b"".join([raws[i] for i in group]), ends)
            which = np.searchsorted(ends, at, side="right")
            out.append((np.array(group, np.int64)[which], at - (ends - lengths)[which], hashes))
            group.clear()

    for i, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        if len(raw) > PIECE_BYTES:
            parts = []
            for start in range(0, len(raw) - LENGTH + 1, PIECE_BYTES):      # windows starting in one piece at a time
                at, hashes = _least_grams(raw[start:start + PIECE_BYTES + LENGTH - 1], np.zeros(0, np.int64))
                parts.append((at + start, hashes))
            at, first = np.unique(np.concatenate([x for x, _ in parts]), return_index=True)
            flush()
            size = 0
            out.append((np.full(len(at), i, np.int64), at, np.concatenate([x for _, x in parts])[first]))
            continue
        group.append(i)
        size += len(raw)
        if size >= PIECE_BYTES:
            flush()
            size = 0
    flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def chunks(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, end of windows) of the chunks of every text; none of a text shorter than a window."""
    which, at, hashes = anchors(raws)
    windows = np.array([max(0, len(r) - LENGTH + 1) for r in raws], np.int64)
    cut = ((hashes * _CUT) >> np.uint64(32) < np.uint64(2 ** 32 // CHUNK_ANCHORS)) & (at > 0) & (at < windows[which])
    long = np.flatnonzero(windows)
    which, start = np.concatenate([long, which[cut]]), np.concatenate([np.zeros(len(long), np.int64), at[cut]])
    order = np.lexsort((start, which))
    which, start = which[order], start[order]
    end = windows[which]
    same = which[1:] == which[:-1]
    end[:-1][same] = start[1:][same]
    return which, start, end


# -- packed columns ---------------------------------------------------------------

@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64).tobytes()
    return _compressor().compress(sizes + b"".join([a.tobytes() for a in arrays]))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = _decompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for n, t in zip(sizes.tolist(), types):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _dealt(part: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(part, kind, blob) of the rows of each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for s, e in zip(cuts, np.append(cuts[1:], len(part))):
        yield int(part[s]), kind, _pack(*[a[order[s:e]] for a in arrays])


def _packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))],
                                      names=["part", "kind", "blob"])


def _settled(parts: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One blob of rows that need no bucket, for any part: the hash of its content picks one."""
    if len(columns[0]):
        blob = _pack(*columns)
        yield xxhash.xxh64_intdigest(blob) % parts, 1, blob


# -- the enhanced suffix array of a bucket ------------------------------------------

def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def prefix_intervals(items: list[bytes], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, common length) of the common-prefix intervals of sorted strings, by one stack scan."""
    stack: list[tuple[int, int]] = []                       # (length, first)
    for i in range(1, len(items) + 1):
        common = _common(items[i - 1], items[i]) if i < len(items) else -1
        first = i - 1
        while stack and stack[-1][0] > common:
            length, first = stack.pop()
            yield first, i - 1, length
        if common >= least and (not stack or stack[-1][0] < common):
            stack.append((common, first))


def maximal_repeats(contexts: list[tuple[bytes, bytes]], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of the repeats of distinct (left, right) contexts.

    A right interval of length r needs at least ``least - r`` common bytes to
    the left; its members are sorted by their reversed left contexts and the
    intervals of those are its left-diverse groups.
    """
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    for first, last, right in prefix_intervals([contexts[i][1] for i in order], 0):
        need = max(0, least - right)
        groups: dict[bytes, list[int]] = {}
        for i in order[first:last + 1]:
            left = contexts[i][0]
            if len(left) >= need:
                groups.setdefault(left[len(left) - need:], []).append(i)
        for own in groups.values():
            if len(own) > 1:
                own.sort(key=lambda i: contexts[i][0][::-1])
                for a, b, left in prefix_intervals([contexts[i][0][::-1] for i in own], need):
                    yield left, right, own[a:b + 1]


def bucket_spans(members: dict[tuple[bytes, bytes], tuple[int, list]]) -> Iterator[tuple[int, object, int, int]]:
    """(id, place, bytes before, bytes after the anchor) to remove, of a bucket: context -> (smallest id, its places)."""
    contexts = list(members)
    if len(contexts) == 2:
        (la, ra), (lb, rb) = contexts
        left, right = _common(la[::-1], lb[::-1]), _common(ra, rb)
        groups = [(left, right, [0, 1])] if left + right >= LENGTH else []
    else:
        groups = maximal_repeats(contexts) if len(contexts) > 1 else ()
    for left, right, own in groups:
        smallest = min(members[contexts[i]][0] for i in own)
        for i in own:
            key, places = members[contexts[i]]
            if key > smallest:
                for place in places:
                    yield key, place, left, right


# -- Spark stages -------------------------------------------------------------------

def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about BYTES_AT_ONCE of a column at a time."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(b.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES_AT_ONCE)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
        yield b.slice(s, e - s)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _tag(raw: bytes, tagged: bool) -> int:
    """Tells texts under one id apart; 0 where ids are known to be distinct."""
    return xxhash.xxh64_intdigest(raw) >> 33 if tagged else 0


def _texts(named: DataFrame, tagged: bool) -> DataFrame:
    """(id, tag, z): the compressed text of every row."""

    def row(compressor, key, text):
        raw = _bytes(text)
        return key, _tag(raw, tagged), compressor.compress(raw)

    return by_row(named, {"id": "id", "text": "text"}, "id long, tag long, z binary", row, lambda: zstandard.ZstdCompressor(level=3))


def _chunk_rows(named: DataFrame, tagged: bool) -> DataFrame:
    """(digest, id, tag, start, end) of the chunks of every text."""

    def run(batches):
        for b in (s for batch in batches for s in _slices(batch, 1)):
            ids, raws = b.column(0).to_pylist(), [_bytes(t) for t in b.column(1).to_pylist()]
            tags = [_tag(r, tagged) for r in raws]
            which, start, end = chunks(raws)
            if len(which):
                spans = list(zip(which.tolist(), start.tolist(), end.tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([hashlib.blake2b(raws[i][s:e + LENGTH - 1], digest_size=16).digest() for i, s, e in spans], pa.binary()),
                    pa.array([ids[i] for i, _, _ in spans], pa.int64()), pa.array([tags[i] for i, _, _ in spans], pa.int64()),
                    pa.array(start), pa.array(end)], names=["digest", "id", "tag", "start", "end"])

    return named.filter("id IS NOT NULL").mapInArrow(run, "digest binary, id long, tag long, start long, end long")


def _copied_chunks(named: DataFrame, tagged: bool) -> DataFrame:
    """(id, tag, start, end) of the chunks that occur in a smaller document."""
    rows = checkpointed(_chunk_rows(named, tagged))            # read twice below
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    return rows.join(first, "digest").filter("id > first").select("id", "tag", "start", "end")


def _hot_anchors(named: DataFrame) -> np.ndarray:
    """Sorted hashes of anchors found in over HOT_SHARE of a bounded sample of documents."""
    share = min(1.0, SAMPLE_DOCS / max(1, named.count()))
    sample = named.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("hot")), F.lit(1 << 32)) < share * (1 << 32))

    def run(batches):
        for b in (s for batch in batches for s in _slices(batch, 1)):
            which, _, hashes = anchors([_bytes(t) for t in b.column(1).to_pylist()])
            pairs = np.unique(np.stack([hashes, which.astype(np.uint64)]), axis=1)      # once a document
            hashes, counts = np.unique(pairs[0], return_counts=True)
            if len(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    least = HOT_DOCS if share == 1 else max(HOT_DOCS, int(HOT_SHARE * SAMPLE_DOCS))
    rows = (sample.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least).orderBy(F.desc("n")).limit(MOST_HOT).select("hash").collect())
    return np.sort(np.array([r["hash"] for r in rows], np.int64))


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _shared_anchors(texts: DataFrame, copied: DataFrame, hot, parts: int) -> DataFrame:
    """(id, tag, place): anchors found in two documents or more; a hot one's place is written as its complement."""
    skipped = copied.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("copied"))

    def packed(batches):
        for b in (s for batch in batches for s in _slices(batch, 2)):
            texts = [r for r in zip(*[c.to_pylist() for c in b.columns]) if r[0] is not None]
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < BYTES_AT_ONCE:
                    part.append((_decompressor().decompress(texts[at][2]), *texts[at]))
                    size += len(part[-1][0])
                    at += 1
                rows = list(dealt(part))
                if rows:
                    yield _packed_batch(rows)

    def dealt(texts: list[tuple]):
        which, place, hashes = anchors([t[0] for t in texts])
        skip = np.zeros(len(which), bool)
        for i, (raw, _, _, _, spans) in enumerate(texts):
            if spans:
                keep = np.ones(len(raw) - LENGTH + 1, bool)      # windows still in question
                for s in spans:
                    keep[s["start"]:s["end"]] = False
                before = np.concatenate([[0], np.cumsum(keep)])
                own = slice(*np.searchsorted(which, [i, i + 1]))
                p = place[own]
                skip[own] = before[np.minimum(p + 1, len(keep))] == before[np.clip(p - (LENGTH - GRAM), 0, len(keep))]
        which, place, hashes = which[~skip], place[~skip], hashes[~skip]
        ids = np.array([t[1] for t in texts], np.int64)[which]
        tags = np.array([t[2] for t in texts], np.int64)[which]
        is_hot = _is_in(hashes.view(np.int64), hot.value)
        rest = ~is_hot
        h = hashes[rest]
        # 48 bits of the hash travel: two anchors that share them without being equal are told apart by their contexts
        yield from _dealt((h % np.uint64(parts)).astype(np.int64), 0, (h >> np.uint64(32)).astype(np.uint32),
                          (h >> np.uint64(16)).astype(np.uint16), ids[rest], tags[rest], place[rest])
        yield from _settled(parts, ids[is_hot], tags[is_hot], ~place[is_hot])

    def shared(group: pa.Table) -> pa.Table:
        ids, tags, places, mine = [], [], [], []
        for kind, blob in zip(group["kind"].to_pylist(), group["blob"].to_pylist()):
            if kind:
                i, t, p = _unpack(blob, np.int64, np.int64, np.int64)
                ids.append(i), tags.append(t), places.append(p)
            else:
                mine.append(_unpack(blob, np.uint32, np.uint16, np.int64, np.int64, np.int64))
        if mine:
            high, low, i, t, p = [np.concatenate(x) for x in zip(*mine)]
            hashes = high.astype(np.uint64) << np.uint64(16) | low
            order = np.lexsort((i, hashes))
            hashes, i, t, p = hashes[order], i[order], t[order], p[order]
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            ends = np.append(starts[1:], len(hashes))
            many = np.repeat(i[starts] != i[ends - 1], ends - starts)
            ids.append(i[many]), tags.append(t[many]), places.append(p[many])
        return pa.table({"id": np.concatenate(ids), "tag": np.concatenate(tags), "place": np.concatenate(places)})

    known = texts.join(skipped, ["id", "tag"], "left").select("id", "tag", "z", "copied")   # one exchange of texts serves all joins
    return (known.mapInArrow(packed, "part int, kind int, blob binary").groupBy("part")
            .applyInArrow(shared, "id long, tag long, place long"))


def _contexts(raw: bytes, place: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, anchor, left, right) of a shared anchor; a hot one (place < 0) has one for each third of its windows."""
    hot, at = place < 0, ~place if place < 0 else place
    reach = LENGTH - GRAM
    for a, b in ((0, reach // 3), (reach // 3, 2 * reach // 3), (2 * reach // 3, reach)) if hot else ((0, reach),):
        left, right = raw[max(0, at - b):at], raw[at:at + LENGTH - a]
        if len(left) >= a and len(left) + len(right) >= LENGTH:
            yield xxhash.xxh64_intdigest(left[len(left) - a:] + right[:LENGTH - b], seed=a), at, left, right


def _add(members: dict, context, key: int, place, copies: list) -> None:
    """Enter a context under its smallest id; places of larger ids are copies as a whole."""
    found = members.get(context)
    if found is None or key < found[0]:
        if found is not None:
            copies += [(found[0], p, context) for p in found[1]]
        members[context] = (key, [place])
    elif key == found[0]:
        found[1].append(place)
    else:
        copies.append((key, place, context))


def _range_spans(group: pa.Table) -> pa.Table:
    """(id, tag, start, end) to remove, of a bucket range.

    The packed columns are put in bucket order and one bucket at a time is
    unpacked: what Python holds of the range is its bytes, not its objects."""
    out, mine, found = [np.zeros((4, 0), np.int64)], [], []

    def settle(least: int) -> None:
        if len(found) > least:
            out.append(np.array(found, np.int64).T)
            found.clear()

    for kind, blob in zip(group["kind"], group["blob"]):
        if kind.as_py():
            out.append(np.stack(_unpack(blob.as_py(), *[np.int64] * 4)))
        else:
            mine.append(_unpack(blob.as_py(), np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint8))
    if mine:
        *columns, data = [np.concatenate(x) for x in zip(*mine)]
        mine.clear()
        sizes = columns[4].astype(np.int64) + columns[5]
        columns.append(np.cumsum(sizes) - sizes)
        order = np.argsort(columns[0], kind="stable")
        bucket = columns[0][order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cuts[1:], len(order))
        many = ends - cuts > 1                                  # nothing is removed of a bucket with one context
        for s, e in zip(cuts[many].tolist(), ends[many].tolist()):
            members, copies = {}, []
            for k, t, p, x, y, at in zip(*[c[order[s:e]].tolist() for c in columns[1:]]):
                own = data[at:at + x + y].tobytes()
                _add(members, (own[:x], own[x:]), k, (t, p), copies)
            found += [(k, t, p - len(left), p + len(right)) for k, (t, p), (left, right) in copies]
            if len(members) > 1:
                found += [(k, t, p - left, p + right) for k, (t, p), left, right in bucket_spans(members)]
            settle(CONTEXTS_AT_ONCE)
    settle(0)
    return pa.table(dict(zip(("id", "tag", "start", "end"), np.concatenate(out, axis=1))))


def _repeated_spans(texts: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """(id, tag, start, end) of the maximal repeats that a smaller document has too."""
    listed = shared.groupBy("id", "tag").agg(F.collect_list("place").alias("places"))

    def packed(batches):
        members: dict[tuple[int, bytes, bytes], tuple[int, list]] = {}
        copies: list[tuple] = []
        size = 0

        def flush():
            rows = [(bucket, key, tag, at, len(left), len(right), left + right)
                    for (bucket, left, right), (key, places) in members.items() for tag, at in places]
            if rows:
                bucket, key, tag, at, before, after, data = zip(*rows)
                bucket = np.array(bucket, np.uint64)
                part = (bucket % np.uint64(parts)).astype(np.int64)
                columns = [bucket, np.array(key, np.int64), np.array(tag, np.int64), np.array(at, np.int64),
                           np.array(before, np.uint8), np.array(after, np.uint8)]
                order = np.argsort(part, kind="stable")
                ordered = part[order]
                cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                for s, e in zip(cuts, np.append(cuts[1:], len(order))):
                    own = order[s:e]
                    yield int(ordered[s]), 0, _pack(*[c[own] for c in columns], np.frombuffer(b"".join(data[i] for i in own), np.uint8))
            if copies:
                yield from _settled(parts, *np.array([(key, tag, at - len(left), at + len(right))
                                                      for key, (tag, at), (_, left, right) in copies], np.int64).T)

        for b in (s for batch in batches for s in _slices(batch, 2)):
            for key, tag, z, places in zip(*[c.to_pylist() for c in b.columns]):
                if not places:
                    continue
                raw = _decompressor().decompress(z)
                for place in places:
                    for bucket, at, left, right in _contexts(raw, place):
                        _add(members, (bucket, left, right), key, (tag, at), copies)
                        size += 1
                if size >= CONTEXTS_AT_ONCE:
                    yield _packed_batch(list(flush()))
                    members, copies, size = {}, [], 0
        if size:
            rows = list(flush())
            if rows:
                yield _packed_batch(rows)

    known = texts.join(listed, ["id", "tag"], "left").select("id", "tag", "z", "places")
    return (known.mapInArrow(packed, "part int, kind int, blob binary").groupBy("part")
            .applyInArrow(_range_spans, "id long, tag long, start long, end long"))


def _united(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of spans written as start << 31 | length."""
    out: list[list[int]] = []
    for x in sorted(spans or ()):
        start, end = x >> 31, (x >> 31) + (x & 0x7FFFFFFF)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with ``with_spans`` the removed runs as
    ``spans`` (start, end in bytes)."""
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = _named(docs, id_col, text_col)
    tagged = not named.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty()
    hot = bounded_broadcast(spark, _hot_anchors(named))
    texts = _texts(named, tagged)
    copied = checkpointed(_copied_chunks(named, tagged))
    repeated = _repeated_spans(texts, _shared_anchors(texts, copied, hot, parts), parts)
    spans = (repeated.union(copied.select("id", "tag", "start", (F.col("end") + (LENGTH - 1)).alias("end")))
             .groupBy("id", "tag").agg(F.collect_set(F.shiftleft("start", 31) + F.col("end") - F.col("start")).alias("found")))
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def row(decompressor, key, z, found):
        raw = decompressor.decompress(z)
        own = _united(found)
        kept, at = hashlib.sha256(), 0
        for s, e in own:
            kept.update(raw[at:s])
            at = e
        kept.update(raw[at:])
        base = key, len(raw), sum(e - s for s, e in own), len(own), kept.hexdigest()
        return (*base, [{"start": s, "end": e} for s, e in own]) if with_spans else base

    out = by_row(texts.join(spans, ["id", "tag"], "left"), {"id": "id", "z": "z", "found": "found"},
                 "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                 + ", spans array<struct<start:long,end:long>>" * with_spans, row, zstandard.ZstdDecompressor)
    return out.select(F.col("id").cast(id_type).alias(id_col), *out.columns[1:])
