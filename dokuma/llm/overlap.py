"""Problem 3: same or near-same records across splits.

Method: fingerprints of rolling word hashes. Plain winnowing (the minimum of every window of k-grams) can't give the
required result here: a record of five words that shares four with another may have no common run longer than two
words, and two-word grams recur in so many records that joining on them is quadratic. So the whole record is the
window, the selected minima are the r smallest of its word hashes under an order that puts long words (rare ones)
first, and seeds are combinations of m minima. With r = n - ceil(0.8 n) + m for a record of n words, two records that
share four fifths of the longer one's words share at least m of their minima, hence a seed; nothing is lost. m is 3
for short texts, 2 and 1 for longer ones (neighbouring ranges overlap, as lengths of a pair may differ by a fifth).

Candidate pairs first have to agree in a 64-bit sketch of their words (a word that one record lacks can take away one bit
only, so no pair is lost). Then they are verified: winnowing fingerprints of both (minima of rolling two-word hashes in
windows of ``WINNOW``) that occur once in each are chained where they are collinear, the chained seeds are extended by
equal words, and the gaps between them are aligned. Where that chain falls short of the share, the whole records are
aligned (longest common subsequence, bit-parallel), so the decision is exact. Coverage is that of the better way.

Exact copies are collapsed to one class per folded text before anything is joined, and the pairs of classes are expanded
only in the pair report that asks for every loaded copy.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import textfold
from .abuse import domain_key
from .pairs import wanted

LEAST_WORDS = 5
WINNOW = 4  # rolling hashes of which one is selected
SHARE = (4, 5)  # four fifths of the words of the longer record
#: (from, to, m): records of so many words get seeds of m minima; the ranges overlap by more than the share allows.
SEEDS = ((LEAST_WORDS, 40, 3), (32, 150, 2), (120, 1 << 30, 1))


def _needed(n: int) -> int:
    return -(-SHARE[0] * n // SHARE[1])


def seeds(ws: list[str]) -> tuple[list[int], int]:
    """(seeds, 64-bit sketch) of a record's words; in the seeds a repeated word counts as another word each time."""
    n = len(ws)
    seen: dict[str, int] = {}
    ranked = []
    bits = 0
    for w in ws:
        k = seen.get(w, 0)
        seen[w] = k + 1
        h = xxhash.xxh64_intdigest(w if not k else f"{w} {k}")
        if not k:
            bits |= 1 << (h >> 58)
        ranked.append((-len(w), h))
    ranked.sort()
    out = set()
    for low, high, m in SEEDS:
        if low <= n <= high:
            minima = sorted(h for _, h in ranked[: n - _needed(n) + m])
            for c in combinations(minima, m):
                x = m
                for h in c:  # rolling over the chosen minima
                    x = (x * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
                    x ^= x >> 29
                out.add(x - (1 << 64) if x >= 1 << 63 else x)
    return list(out), bits - (1 << 64) if bits >> 63 else bits


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit for each word of a."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for w in b:
        m = at.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & whole
    return len(a) - v.bit_count()


def fingerprints(ws: list[str]) -> dict[int, int]:
    """Winnowing: hash to place of the selected rolling hashes that are selected once in the record."""
    h = [xxhash.xxh64_intdigest(f"{x} {y}") for x, y in zip(ws, ws[1:])]
    chosen = {min(range(i, min(i + WINNOW, len(h))), key=lambda k: (h[k], -k)) for i in range(max(1, len(h) - WINNOW + 1))} if h else ()
    out: dict[int, int] = {}
    again = set()
    for k in sorted(chosen):
        if h[k] in out:
            again.add(h[k])
        out[h[k]] = k
    return {x: k for x, k in out.items() if x not in again}


def chained(a: list[str], b: list[str]) -> int:
    """Words that agree along the longest collinear chain of common fingerprints, extended, with the gaps aligned."""
    fa, fb = fingerprints(a), fingerprints(b)
    seeds = sorted((i, fb[h]) for h, i in fa.items() if h in fb)
    tails: list[int] = []  # patience: last place in b of the best chain of each length
    last: list[int] = []
    back = [-1] * len(seeds)
    for n, (_, j) in enumerate(seeds):
        k = bisect_left(tails, j)
        back[n] = last[k - 1] if k else -1
        tails[k : k + 1], last[k : k + 1] = [j], [n]
    chain = []
    n = last[-1] if last else -1
    while n >= 0:
        chain.append(seeds[n])
        n = back[n]
    total = i = j = 0
    for p, q in chain[::-1]:
        if p < i or q < j:
            continue  # swallowed by the seed before
        x, y = p, q
        while p > i and q > j and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y = x + 1, y + 1
        total += lcs(a[i:p], b[j:q]) + x - p
        i, j = x, y
    return total + lcs(a[i:], b[j:])


def aligned(a: list[str], b: list[str]) -> int:
    """Words that both records share in the same order: along the chain, or exactly if that isn't enough. What they share
    at both ends is aligned already."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if not x or not y:
        return i + j
    c = i + j + chained(x, y)
    return c if c >= _needed(max(len(a), len(b))) else max(c, i + j + lcs(x, y))


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ws = [textfold.words(t) for t in pdf["raw_text"]]
        pdf["words"] = [" ".join(w) if len(w) >= LEAST_WORDS else None for w in ws]
        yield pdf[["ex_id", "side", "domain", "words"]].dropna(subset=["words"])


def _with_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ws = [t.split(" ") for t in pdf["words"]]
        both = [seeds(w) for w in ws]
        yield pd.DataFrame(
            {"rep": pdf["rep"], "n": [len(w) for w in ws], "sketch": [b for _, b in both], "seeds": [s for s, _ in both]}
        )


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep, cover = [], []
        for x, y in zip(pdf["words_a"], pdf["words_b"]):
            a, b = x.split(" "), y.split(" ")
            longer = max(len(a), len(b))
            need = _needed(longer)
            n = aligned(a, b) if min(len(a), len(b)) >= need else 0
            keep.append(n >= need)
            cover.append(n / longer)
        pdf["coverage"] = cover
        yield pdf.loc[keep, ["cls_a", "cls_b", "coverage"]]


def members(examples: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Records of at least five words with their split side and class (one class per folded text)."""
    split = F.lower(F.trim("split"))
    side = F.when(split == "train", "train").when(split.isin("dev", "test"), split)
    rows = examples.where(F.col("raw_text").isNotNull() & side.isNotNull())
    rows = rows.select("ex_id", side.alias("side"), domain_key(F.col("domain")).alias("domain"), "raw_text")
    # folded once: everything below starts from the folded words
    return checkpointed(rows.mapInPandas(_folded, "ex_id long, side string, domain string, words string"))


def class_id(c: str = "words") -> Column:
    return F.unhex(F.md5(c))


def class_pairs(m: DataFrame) -> DataFrame:
    """(cls_a of train, cls_b of dev or test, coverage): every pair of classes that covers enough, equal ones included."""
    train = F.col("side") == "train"
    classes = m.groupBy("words").agg(F.min("ex_id").alias("rep"), F.max(train).alias("train"), F.max(~train).alias("held"))
    schema = "rep long, n int, sketch long, seeds array<bigint>"
    # each side makes the seeds of its own classes
    seeded = lambda c: classes.where(c).select("rep", "words").mapInPandas(_with_seeds, schema)
    side = lambda c: seeded(c).select(F.explode("seeds").alias("seed"), "rep", "n", "sketch").alias(c[0])
    a, b = side("train"), side("held")
    longer = F.greatest("t.n", "h.n")
    needed = F.expr(f"({SHARE[0]} * greatest(t.n, h.n) + {SHARE[1] - 1}) div {SHARE[1]}")
    lacks = lambda x, y: F.bit_count(F.col(f"{x}.sketch").bitwiseAND(F.bitwise_not(f"{y}.sketch"))) <= F.col(f"{x}.n") - needed
    near = (
        (F.col("t.seed") == F.col("h.seed"))
        & (F.col("t.rep") != F.col("h.rep"))
        & (SHARE[1] * F.least("t.n", "h.n") >= SHARE[0] * longer)
        & lacks("t", "h")
        & lacks("h", "t")
    )
    pairs = checkpointed(a.join(b, near).select(F.col("t.rep").alias("rep_a"), F.col("h.rep").alias("rep_b")).distinct())
    classes = classes.withColumn("cls", class_id())
    text = wanted(classes.select("rep", "cls", "words"), "rep", pairs, "rep_a", "rep_b")
    pairs = pairs.join(text.withColumnsRenamed({"rep": "rep_a", "cls": "cls_a", "words": "words_a"}), "rep_a")
    pairs = pairs.join(text.withColumnsRenamed({"rep": "rep_b", "cls": "cls_b", "words": "words_b"}), "rep_b")
    close = pairs.mapInPandas(_verify, "cls_a binary, cls_b binary, coverage double")
    same = classes.where("train and held").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("coverage"))
    return close.unionByName(same)


def found(examples: DataFrame) -> DataFrame:
    """Every pair of loaded records, one of train and one of dev or test, that repeat each other.

    Null texts, texts under five words and other splits take no part.
    """
    m = members(examples)
    ids = m.select("ex_id", "side", class_id().alias("cls"))
    a = ids.where("side = 'train'").select(F.col("cls").alias("cls_a"), F.col("ex_id").alias("x"))
    b = ids.where("side <> 'train'").select(F.col("cls").alias("cls_b"), F.col("ex_id").alias("y"))
    pairs = class_pairs(m).join(a, "cls_a").join(b, "cls_b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("ex_id_a"), F.greatest("x", "y").alias("ex_id_b")).distinct()


def report(examples: DataFrame) -> DataFrame:
    """Per held-out split and domain: records, records that repeat train, and their mean and largest coverage.

    Counted per record through the classes; pairs of copies are never expanded for it.
    """
    m = members(examples)
    held = m.where("side <> 'train'").select("ex_id", "side", "domain", class_id().alias("cls"))
    best = class_pairs(m).groupBy(F.col("cls_b").alias("cls")).agg(F.max("coverage").alias("coverage"), F.count("*").alias("classes"))
    g = held.join(best, "cls", "left").groupBy("side", "domain")
    return g.agg(
        F.count("*").alias("records"),
        F.count("coverage").alias("overlapping"),
        F.avg("coverage").alias("mean_coverage"),
        F.max("coverage").alias("max_coverage"),
    ).withColumnRenamed("side", "split")
