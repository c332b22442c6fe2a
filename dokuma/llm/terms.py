"""Problem 5: occurrences and records of every distinct term, and a mark for rare and common ones.

Method: burst-trie counting. Every worker routes terms through a trie whose leaves are containers of the remaining
characters; a container that grows too large bursts into one per next character, so prefixes adapt to the data. The
containers hold an occurrence and a record counter for each term and leave the worker as compact subtrees (one prefix,
many suffixes); equal paths of all workers' tries are then merged. However hot a term is, a worker sends it once per
flush.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE_BELOW = 3
COMMON_ABOVE = 0.02
CONTAINER = 512  # terms of a container before it bursts
TRIE = 200_000  # terms of a worker's trie before it is sent


class BurstTrie:
    """Inner nodes are dicts by character, containers are dicts by the remaining suffix; "" ends a term."""

    def __init__(self, container: int = CONTAINER):
        self.limit, self.root, self.size = container, (True, {}), 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        leaf, at, i, parent = *self.root, 0, None
        while not leaf:
            c = term[i : i + 1]
            parent, key = at, c
            i += 1
            if c not in at:
                at[c] = (True, {})
            leaf, at = at[c]
        n = at.get(term[i:])
        if n is None:
            at[term[i:]] = [occurrences, records]
            self.size += 1
            if len(at) > self.limit and len(at) > 1:
                node = self._burst(at)
                if parent is None:
                    self.root = node
                else:
                    parent[key] = node
        else:
            n[0] += occurrences
            n[1] += records

    @staticmethod
    def _burst(container: dict[str, list[int]]) -> tuple[bool, dict]:
        node: dict[str, tuple[bool, dict]] = {}
        for s, n in container.items():
            node.setdefault(s[:1], (True, {}))[1][s[1:]] = n
        return False, node

    def subtrees(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix, suffixes, occurrences, records) of every container."""
        stack = [("", *self.root)]
        while stack:
            prefix, leaf, at = stack.pop()
            if not leaf:
                stack += [(prefix + c, *child) for c, child in at.items()]
            elif at:
                yield prefix, list(at), [n[0] for n in at.values()], [n[1] for n in at.values()]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = BurstTrie()
    send = lambda: pd.DataFrame(list(trie.subtrees()), columns=["prefix", "suffixes", "occurrences", "records"])
    for pdf in batches:
        occurrences: Counter = Counter()
        records: Counter = Counter()
        for tokens in pdf["gold_tokens"]:
            if tokens is not None:
                kept = [t for t in tokens if t]
                occurrences.update(kept)
                records.update(set(kept))
        for t, n in occurrences.items():
            trie.add(t, n, records[t])
        if trie.size > TRIE:
            yield send()
            trie = BurstTrie()
    yield send()


def records(examples: DataFrame, instances: DataFrame) -> DataFrame:
    """One row per record: every row of examples, and one per distinct inst_id (repeated rows of it are one)."""
    once = instances.groupBy("inst_id").agg(F.first("gold_tokens", ignorenulls=True).alias("gold_tokens"))
    return examples.select("gold_tokens").unionByName(once.select("gold_tokens"))


def counted(examples: DataFrame, instances: DataFrame) -> DataFrame:
    """term, occurrences, records, mark. Null and empty tokens are no terms, exactly as stored otherwise."""
    trees = records(examples, instances).mapInPandas(
        _count, "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
    )
    leaves = trees.select("prefix", F.explode(F.arrays_zip("suffixes", "occurrences", "records")).alias("x"))
    merged = leaves.groupBy(F.concat("prefix", "x.suffixes").alias("term")).agg(
        F.sum("x.occurrences").alias("occurrences"), F.sum("x.records").alias("records")
    )
    total = examples.count() + instances.select(F.countDistinct("inst_id")).collect()[0][0]
    unnumbered = instances.where("inst_id is null").limit(1).count()  # rows without a number count as one record
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > COMMON_ABOVE * (total + unnumbered), "common")
    return merged.withColumn("mark", mark)


def found(examples: DataFrame, instances: DataFrame) -> DataFrame:
    return counted(examples, instances).where("mark is not null").select("term", "mark")
