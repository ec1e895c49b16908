"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint.  A text is lower-cased (A-Z), split at white space into words and
shingled; a bit of the 64-bit fingerprint is 1 if it is set in over half of
the shingles' XXH64 values.

Candidates.  A fingerprint is embedded as the bit counts of its 32 two-bit
segments.  A flipped bit moves one count by one, so the Manhattan distance of
two embeddings never exceeds the bit distance: it is a lower bound.  Within
``distance`` bits, one half (16 segments) of the embedding is within
``distance // 2``.  Each half is a lattice, and two points of a lattice within
r steps of each other have a point between them within ceil(r / 2) steps of
both.  So every distinct fingerprint enters its own cell and those at most
ceil(r / 2) steps away, in both halves: a grid range-join in which all pairs
under the bound meet in some cell, by equality alone.

Verification.  Members of a cell are compared exactly (XOR and bit count).  A
cell gives no pair list but the links of a forest of its linked members: runs
of up to ``SHORT_RUN`` members are compared pairwise, longer ones are grown
from their smallest member over those not yet reached.  Cells with over
``CELL_MEMBERS`` members are dealt out anew, in the same way, by the quarters
of the other half of their embedding.  Components of the links are found by
star contraction.

Equal fingerprints are joined before all this, so exact copies cost one row.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; fewer words than a shingle's make one shingle; texts
are read whole, repeated shingles count each time; the component id is the
smallest id reachable (null only if no member has an id); repeated rows get
equal answers; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import by_row, checkpointed, free_name
from wayfare.llm.components import components

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
SEGMENTS = 32
HALF = SEGMENTS // 2
SHORT_RUN = 16
CELL_MEMBERS = 32_768
HASHED_AT_ONCE = 65_536

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []   # bytes: A-Z and ASCII white space
    if not words:
        return 0
    total, counts = max(1, len(words) - shingle_words + 1), np.zeros(64, np.int64)
    for at in range(0, total, HASHED_AT_ONCE):
        part = words[at:at + HASHED_AT_ONCE + shingle_words - 1]
        joined = map(b" ".join, zip(*[part[i:] for i in range(shingle_words)])) if len(words) > shingle_words else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        lanes = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
        counts += (lanes @ _BITS).ravel()
    bits = (2 * counts > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of every row."""
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    return by_row(docs, {"id": id_col, "text": text_col}, f"id {id_type}, fp long",
                  lambda _, key, text: (key, fingerprint(text, shingle_words)))


def embedding(fps: np.ndarray) -> np.ndarray:
    """Bit counts (0 to 2) of the 32 two-bit segments of each fingerprint."""
    u = fps.view(np.uint64)
    pairs = (u & np.uint64(0x5555555555555555)) + ((u >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return ((pairs[:, None] >> (2 * np.arange(SEGMENTS, dtype=np.uint64))) & np.uint64(3)).astype(np.int64)


def lattice_ball(points: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every lattice point within ``steps`` unit steps of each row; counts stay in 0..2."""
    n, dims = points.shape
    scale = 3 ** np.arange(dims, dtype=np.int64)
    rows, vectors = np.arange(n), points
    for _ in range(steps):
        near_rows, near = [rows], [vectors]
        for d in range(dims):
            for move in (1, -1):
                ok = (vectors[:, d] + move >= 0) & (vectors[:, d] + move <= 2)
                moved = vectors[ok].copy()
                moved[:, d] += move
                near_rows.append(rows[ok])
                near.append(moved)
        rows, vectors = np.concatenate(near_rows), np.concatenate(near)
        _, first = np.unique(np.stack([rows, vectors @ scale]), axis=1, return_index=True)
        rows, vectors = rows[first], vectors[first]
    return rows, vectors @ scale


def _cells(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) in both halves; a cell number is even in the lower half, odd in the upper."""
    e, steps = embedding(fps), -(-(distance // 2) // 2)
    out = []
    for half in (0, 1):
        rows, cells = lattice_ball(e[:, half * HALF:(half + 1) * HALF], steps)
        out.append((rows, 2 * cells + half))
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def _finer_cells(fps: np.ndarray, cells: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, finer cell): a cell of one half dealt out by the two quarters of the other half."""
    e, steps, quarter = embedding(fps), -(-(distance // 2) // 2), HALF // 2
    other = np.where((cells % 2 == 0)[:, None], e[:, HALF:], e[:, :HALF])
    out = []
    for q in (0, 1):
        rows, near = lattice_ball(other[:, q * quarter:(q + 1) * quarter], steps)
        out.append((rows, (cells[rows] * 2 + q) * 3 ** quarter + near))
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def _forest(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """(linked members, smallest member) of each component of a cell's members."""
    left = np.unique(fps)
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier, reached = [root], []
        while frontier and len(left):
            near = np.bitwise_count((left ^ frontier.pop()).view(np.uint64)) <= distance
            if near.any():
                found = left[near]
                reached.append(found)
                frontier.extend(found.tolist())
                left = left[~near]
        if reached:
            yield np.concatenate(reached), int(root)


def _cell_links(distance: int, most: int | None):
    """Arrow map over rows (cell, fp) sorted by cell: links (a, b), and (a, cell) of members of too large cells."""

    def batch(a, b, cell):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cell, pa.int64())],
                                          names=["a", "b", "cell"])

    def finish(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole runs of equal cells."""
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(cells)))
        short = np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes)
        a, b = [], []
        for off in range(1, min(SHORT_RUN, len(cells))):
            at = np.flatnonzero(short[:-off] & (cells[off:] == cells[:-off]))
            if not len(at):
                break
            at = at[np.bitwise_count((fps[at] ^ fps[at + off]).view(np.uint64)) <= distance]
            a.append(fps[at])
            b.append(fps[at + off])
        for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
            for members, root in _forest(fps[s:s + n], distance):
                a.append(members)
                b.append(np.full(len(members), root))
        if sum(map(len, a)):
            a, b = np.concatenate(a), np.concatenate(b)
            yield batch(a, b, [None] * len(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        flooded = None                       # cell whose members are being passed on
        for x in batches:
            cells = np.concatenate([cells, x.column(0).to_numpy()])
            fps = np.concatenate([fps, x.column(1).to_numpy()])
            if flooded is not None:
                n = int(np.searchsorted(cells, flooded, side="right"))
                if n:
                    yield batch(fps[:n], [None] * n, cells[:n])
                cells, fps = cells[n:], fps[n:]
                if len(cells):
                    flooded = None
            if not len(cells):
                continue
            last = int(np.searchsorted(cells, cells[-1], side="left"))      # the last run may go on
            yield from finish(cells[:last], fps[:last])
            cells, fps = cells[last:], fps[last:]
            if most is not None and len(cells) > most:
                flooded = int(cells[0])
                yield batch(fps, [None] * len(fps), cells)
                cells, fps = cells[:0], fps[:0]
        yield from finish(cells, fps)

    return run


def links(fps: DataFrame, distance: int = MAX_DISTANCE, most: int = CELL_MEMBERS) -> DataFrame:
    """(a, b) between distinct fingerprints ``fps`` (fp): enough links within ``distance`` bits to connect all that have any."""

    def dealt(batches):
        for x in batches:
            v = x.column(0).to_numpy()
            rows, cells = _cells(v, distance)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(v[rows])], names=["cell", "fp"])

    def dealt_finer(batches):
        for x in batches:
            v, old = x.column(0).to_numpy(), x.column(1).to_numpy()
            rows, cells = _finer_cells(v, old, distance)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(v[rows])], names=["cell", "fp"])

    def joined(members: DataFrame, most: int | None) -> DataFrame:
        return (members.repartition("cell").sortWithinPartitions("cell", "fp")
                .mapInArrow(_cell_links(distance, most), "a long, b long, cell long"))

    # fingerprints are few bytes but enter some 47 cells each: dealt out evenly, or adaptive
    # coalescing would leave their expansion to a few tasks
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = checkpointed(joined(fps.select("fp").repartition(parts).mapInArrow(dealt, "cell long, fp long"), most))
    out = found.filter("cell IS NULL").select("a", "b")
    large = found.filter("cell IS NOT NULL").select("a", "cell")
    if not large.isEmpty():
        out = out.union(joined(large.mapInArrow(dealt_finer, "cell long, fp long"), None).select("a", "b"))
    return out.distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, distance: int) -> DataFrame:
    """(id, fp, root, component_id) of every row."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(distinct.select("fp"), distance))
    own = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = own.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = own.select("fp", "root").join(ids, "root")
    return marked.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    return _groups(docs, id_col, text_col, shingle_words, distance).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest (id, fingerprint, md5 of the text), nulls last.

    Rows are told apart by id where ids are distinct.  Rows that share an id
    or have none are judged row by row: their fingerprints are made again and
    lead to their components, so every component keeps a row and each other
    row goes, whatever ids they carry.
    """
    columns, key = docs.columns, free_name(docs, "_id")
    found = checkpointed(_groups(docs, id_col, text_col, shingle_words, distance).withColumnRenamed("id", key))
    same = F.col(f"`{id_col}`") == F.col(key)
    unsure = checkpointed(found.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).select(key))
    if unsure.isEmpty():
        others = found.filter(F.col(key) != F.col("component_id")).select(key)
        return docs.join(others, same, "left_anti").select(*[f"`{c}`" for c in columns])
    best = (found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("fp").alias("fp"))).alias("b"))
            .select(F.col("root").alias("_root"), F.col("b.id").alias("_best"), F.col("b.fp").alias("_fp")))
    others = found.join(best, found[key].eqNullSafe(best["_best"]) & (found["fp"] == best["_fp"]), "left_anti").select(key)
    sure = docs.filter(F.col(f"`{id_col}`").isNotNull()).join(unsure.union(others), same, "left_anti")
    rows = docs.join(unsure, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_semi").select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = rows.withColumn("fp", F.pandas_udf(_fingerprints_of(shingle_words), "long")("text"))
    winners = made.join(best, made["id"].eqNullSafe(best["_best"]) & (made["fp"] == best["_fp"]))
    order = F.struct(F.md5(F.coalesce("text", F.lit(""))), F.xxhash64("row"))
    picked = winners.groupBy("_root").agg(F.min_by("row", order).alias("row"))
    return sure.select(*[f"`{c}`" for c in columns]).union(picked.select(*[F.col("row").getField(c).alias(c) for c in columns]))


def _fingerprints_of(shingle_words: int):
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return made
