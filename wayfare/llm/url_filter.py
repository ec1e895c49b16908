"""URL filter: one trie over reversed host labels, then path segments.

A rule ``(verdict, host, path)`` fits a URL when the URL's host is the rule's
host or a subdomain of it and the URL's path starts with the rule's path.
Of the fitting rules the one with the longest ``host + path`` wins; at equal
length the one with more host labels, then a block entry over an allow entry.
A URL that no rule fits gets ``default``.

The trie is a dictionary of host labels from the top-level domain down; every
node that ends a rule's host carries a second dictionary of path segments.  A
rule's last segment may be cut anywhere (``/en/a`` fits ``/en/abc``), so a
path node lists the cut ends it allows.  One walk down the URL's own labels
and segments meets every fitting rule, whatever the number of rules.

Defined results: a null URL or one without ``://`` has empty host and path
and gets ``default``; repeated rows are judged alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import BROADCAST_BYTES, bounded_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The production rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dictionaries; "" under a host node is its path trie, None under a path node its ends."""
    root: dict = {}
    for r in rules:
        node = root
        for label in reversed(r.host.split(".")):
            node = node.setdefault((label,), {})
        node = node.setdefault("paths", {})
        *whole, cut = r.path.split("/")
        for segment in whole:
            node = node.setdefault((segment,), {})
        ends = node.setdefault("ends", {})
        rank = (len(r.host) + len(r.path), r.host.count(".") + 1, r.verdict == "block")
        ends[cut] = max(ends.get(cut, ((0, 0, False), "", "")), (rank, r.host + r.path, r.verdict))
    return root


def longest_match(trie: dict, host: str, path: str):
    """The winning (rank, rule, verdict) or None."""
    best, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get((label,))
        if node is None:
            break
        at = node.get("paths")
        depth = 0
        while at is not None and depth < len(segments):
            for cut, found in at.get("ends", {}).items():
                if segments[depth].startswith(cut) and (best is None or found > best):
                    best = found
            at = at.get((segments[depth],))
            depth += 1
    return best


def _shards(rules: list[Rule], limit: int) -> list[list[Rule]]:
    """Rules in parts whose tries stay under ``limit`` bytes each."""
    if len(rules) < 2 or len(pickle.dumps(build_trie(rules))) <= limit:
        return [rules]
    half = len(rules) // 2
    return _shards(rules[:half], limit) + _shards(rules[half:], limit)


def _matcher(trie):
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [longest_match(trie.value, h, p) for h, p in zip(host, path)]
        return pd.DataFrame([(*x[0], x[1], x[2]) if x else (-1, 0, False, None, None) for x in found],
                            columns=["size", "labels", "block", "rule", "verdict"])

    return F.pandas_udf(match, "struct<size:int,labels:int,block:boolean,rule:string,verdict:string>")


def url_parts(url: str = "url") -> tuple:
    """Host (A-Z lower-cased) and path of a URL column, both empty where there is no ``://``."""
    c = F.coalesce(F.col(url), F.lit(""))
    return (F.translate(F.regexp_extract(c, URL_PATTERN, 1), UPPER, LOWER).alias("host"),
            F.regexp_extract(c, URL_PATTERN, 2).alias("path"))


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    The broadcast trie is measured; a rule list over ``limit`` bytes is split
    into several tries, each judged in turn, and the longest of their answers
    wins, so the result does not depend on the split.
    """
    spark = pages.sparkSession
    answers = [_matcher(bounded_broadcast(spark, build_trie(part), 2 * limit))("host", "path")
               for part in _shards(list(rules), limit)]
    best = F.greatest(*answers) if len(answers) > 1 else answers[0]
    host, path = url_parts(f"`{url_col}`")
    return (pages.select(F.col(f"`{id_col}`").alias(id_col), host, path)
            .withColumn("_best", best)
            .select(id_col, "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
