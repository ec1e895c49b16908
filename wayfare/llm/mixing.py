"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every source gets a share of the output in proportion to its weight, measured
in characters.  A source's documents are repeated at the mean rate

    rate = weight share * characters wanted / characters of the source,

each document a Poisson number of times.  The number is read off the inverse
distribution function at a uniform number hashed from seed, document id and
text, so it needs no state, no second pass over a source and no knowledge of
which task holds the document, and a lost task makes the same copies again.
Rows that share an id, or have none, are drawn on their own.  Rows that are
alike in every column are counted first and drawn once for each of them, so a
thousand equal rows neither live nor die together.  Means
over ``MAX_MEAN`` are split into equal parts drawn one by one (a sum of
Poisson numbers is Poisson), which keeps ``exp(-mean)`` in range.

The copies are shuffled globally: each copy's hash picks its partition and
its place in it.

Sources named in ``weights`` are groups of their own; all others, null
included, form one group of weight ``other``.  So the statistics that reach
the driver are one row for each named weight and one more, whatever the data.

Defined results: a null text has length 0; a group without characters (or of
weight 0) gets rate 0 and leaves its share to the others; a null id or text
hashes like the empty string; of repeated rows each has its own draw and their
copies are numbered through (rows that share id and text but differ in another
column share their draws); an empty table gives an empty result.  Added columns are renamed with trailing underscores where
the input has the name already.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import free_name

#: Production weights: the large crawl is held to three parts, every other named source to one.
WEIGHTS: dict[str, float] = {"src0": 3.0} | {f"src{i}": 1.0 for i in range(1, 20)}
OTHER_WEIGHT = 1.0
SEED = 20
MAX_MEAN = 256.0


def group_sizes(docs: DataFrame, weights: Mapping[str, float], text_col: str = "text",
                source_col: str = "source") -> dict[str | None, int]:
    """Characters of every group, None for the sources without a weight of their own."""
    named = F.when(F.col(f"`{source_col}`").isin(*weights), F.col(f"`{source_col}`")) if weights else F.lit(None).cast("string")
    rows = docs.groupBy(named.alias("g")).agg(F.sum(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0))).alias("n")).collect()
    return {r["g"]: r["n"] for r in rows}


def rates(sizes: Mapping[str | None, int], weights: Mapping[str, float], other: float, wanted: float | None = None) -> dict:
    """Mean repetition rate of every group; ``wanted`` characters in all (default: as many as there are)."""
    share = {g: (other if g is None else weights[g]) for g, n in sizes.items() if n}
    total = sum(sizes.values()) if wanted is None else wanted
    return {g: share[g] / sum(share.values()) * total / sizes[g] if g in share and sum(share.values()) else 0.0 for g in sizes}


def distribution(mean: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... up to where it is 1 for a 52-bit uniform number."""
    p = total = math.exp(-mean)
    out, k = [], 0
    while total < 1.0 - 2.0 ** -53 and (k <= mean or p > 2.0 ** -60):
        out.append(total)
        k += 1
        p *= mean / k
        total += p
    return out


def uniform(seed: int, key: Column, part: Column) -> Column:
    """52 bits of an md5 of seed, key and part, as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, part.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def poisson(seed: int, key: Column, mean: float, first: Column, times: Column | None = None) -> Column:
    """A Poisson number, or the sum of ``times`` of them; ``first`` is the key's uniform number of part 0."""
    if mean <= 0:
        return F.lit(0)
    parts = math.ceil(mean / MAX_MEAN)
    steps = F.array(*[F.lit(x) for x in distribution(mean / parts)])

    def drawn(u: Column) -> Column:
        return F.size(F.filter(steps, lambda x: x <= u))

    if parts == 1 and times is None:
        # bound as a variable: the number is made once, not for each step it is held against
        return F.element_at(F.transform(F.array(first), drawn), 1)
    draws = F.lit(parts) if times is None else (times * parts).cast("int")
    return F.aggregate(F.transform(F.sequence(F.lit(0), draws - 1), lambda part: uniform(seed, key, part)), F.lit(0),
                       lambda total, u: total + drawn(u))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, other: float = OTHER_WEIGHT, seed: int = SEED,
        wanted: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` and, for every copy, ``copy`` (from 0) and ``shuffle_key``, in shuffled order."""
    mean = rates(group_sizes(docs, weights, text_col, source_col), weights, other, wanted)
    columns = docs.columns
    source = F.col(f"`{source_col}`")
    copy, shuffle_key, key = (free_name(docs, c) for c in ("copy", "shuffle_key", "row_key"))
    n, times, hashed, first = (free_name(docs, c) for c in ("n_copies", "n_rows", "row_hash", "drawn"))

    def copies(df: DataFrame, times: Column | None) -> DataFrame:
        """``df`` with the number of copies of each row; key and first number are columns, so that a text is digested once."""
        own, u = F.col(f"`{key}`"), F.col(f"`{first}`")
        out = poisson(seed, own, mean[None], u, times) if mean.get(None) else F.lit(0)
        named = [g for g in mean if g is not None]
        if named:
            cases = F.when(source == named[0], poisson(seed, own, mean[named[0]], u, times))
            for g in named[1:]:
                cases = cases.when(source == g, poisson(seed, own, mean[g], u, times))
            out = cases.otherwise(out)
        return df.withColumn(first, uniform(seed, own, F.lit(0))).withColumn(n, out).select(*[f"`{c}`" for c in columns], key, n)

    keyed = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                                             F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))
    # which (id, text) stand more than once: hashes only are shuffled, and mostly there are none
    repeated = keyed.groupBy(F.xxhash64(key).alias(hashed)).count().filter("count > 1").select(hashed)
    if repeated.isEmpty():
        drawn = copies(keyed, None)
    else:
        marked = keyed.withColumn(hashed, F.xxhash64(key))
        once = copies(marked.join(repeated, hashed, "left_anti"), None)
        more = marked.join(repeated, hashed, "left_semi").groupBy(*[F.col(f"`{c}`") for c in columns], key).agg(F.count(F.lit(1)).alias(times))
        drawn = once.union(copies(more, F.col(times)))
    return (drawn.filter(F.col(f"`{n}`") > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(f"`{n}`") - 1)))
            .withColumn(shuffle_key, F.md5(F.concat_ws(":", F.lit(f"{seed} place"), F.col(f"`{key}`"), F.col(copy).cast("string"))))
            .drop(n, key).repartition(F.col(shuffle_key)).sortWithinPartitions(shuffle_key))
