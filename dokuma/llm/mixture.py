"""Problem 8: mix sources to target shares of tokens.

Method: Poisson replication. A document's copies are drawn by inverting a Poisson distribution at a uniform number
hashed from its id, so the draw needs no state, no order and no coordination and is the same on every run. The mean of
a source is its target repetition rate, corrected for the cap: the rate is chosen so that the mean of the capped draw
meets the target. Documents are then exploded by their counts and shuffled globally by another hash.

What sampling leaves of a source's error is removed exactly enough: each source's uniform numbers are cut into bins, and
the rate is refined against the tokens the bins actually draw. Only these sums (sources x bins) reach the driver.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
BINS = 4096
SEED = 17


def _tokenizer_path(path: str | None) -> str:
    if path:
        return path
    return f"/opt/tokenizers/{TOKENIZER}"


def counter(path: str, pattern: str):
    """A function that counts the tokens of a text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t))


# Fixed value: how the tokenizer's authors split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def sized(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The documents with their number of tokens; a null text has none and takes no part."""
    path = _tokenizer_path(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = counter(path, PATTERN)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [size(t) for t in pdf["text"]]})

    d = documents.where("text is not null and source is not null").select("doc_id", "source", "text")
    return d.mapInPandas(run, "doc_id long, source string, n_tokens long").where("n_tokens > 0")


def _uniform(seed: int):
    """A number in (0, 1) for each document."""
    return (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_quantile(u: float, rate: float, cap: int) -> int:
    """min(cap, smallest k with P(Poisson(rate) <= k) >= u)."""
    if rate == math.inf:
        return cap
    k, p = 0, math.exp(-rate)
    total = p
    while total < u and k < cap:
        k += 1
        p *= rate / k
        total += p
    return k


def _steps(rate: float, cap: int) -> list[float]:
    """Distribution function at 0 .. cap - 1: the uniform numbers from which one more copy is drawn."""
    if rate == math.inf:
        return [0.0] * cap
    out, p, total = [], math.exp(-rate), 0.0
    for k in range(cap):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def _drawn(bins: dict[int, float], rate: float, cap: int) -> float:
    """Tokens that a rate draws, from the tokens of each bin of uniform numbers (a bin counts by its share above a step)."""
    steps = _steps(rate, cap)
    total = 0.0
    for b, tokens in bins.items():
        low, high = b / BINS, (b + 1) / BINS
        for s in steps:
            total += tokens * min(1.0, max(0.0, (high - s) / (high - low)))
    return total


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """One row per target: source, share, cap, tokens available and wanted, rate. Without ``total_tokens`` the mix is as
    large as every source with documents can serve. Targets without share or cap count as 0 and 1; a source named twice
    keeps its largest share."""
    rows = targets.where("source is not null").groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("cap")
    ).collect()
    u = F.floor(_uniform(SEED) * BINS).cast("int").alias("bin")
    sums = sizes.groupBy("source", u).agg(F.sum("n_tokens").alias("tokens"))
    wanted = [r["source"] for r in rows]
    bins: dict[str, dict[int, float]] = {}
    for s, b, t in sums.where(F.col("source").isin(wanted)).collect():  # bounded: targets x BINS
        bins.setdefault(s, {})[b] = float(t)
    have = {s: sum(x.values()) for s, x in bins.items()}
    size = total_tokens
    if size is None:
        size = min((have[r["source"]] * r["cap"] / r["share"] for r in rows if r["share"] > 0 and r["source"] in have), default=0.0)
    out = []
    for r in rows:
        s, cap = r["source"], max(0, int(r["cap"]))
        need = r["share"] * size
        rate = 0.0
        if s in have and need > 0:
            if need >= have[s] * cap:
                rate = math.inf
            else:
                low, high = 0.0, 1.0
                while _drawn(bins[s], high, cap) < need and high < 700:
                    high *= 2
                for _ in range(60):
                    rate = (low + high) / 2
                    if _drawn(bins[s], rate, cap) < need:
                        low = rate
                    else:
                        high = rate
        out.append({"source": s, "target_share": float(r["share"]), "max_repeat": cap, "available": have.get(s, 0.0), "wanted": need, "steps": _steps(rate, cap)})
    return out


_PLAN = "source string, target_share double, max_repeat int, available double, wanted double, steps array<double>"


def copies(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies of every document with a target; the plan). Copies never exceed max_repeat."""
    sizes = checkpointed(sized(documents, tokenizer))  # texts are tokenised once
    rows = plan(sizes, targets, total_tokens)
    p = documents.sparkSession.createDataFrame([tuple(r.values()) for r in rows], _PLAN)
    # the plan has one row per target, which the driver has just counted: small enough to broadcast
    small = F.broadcast(p) if len(rows) <= 10_000 else p
    drawn = sizes.withColumn("u", _uniform(SEED)).join(small.select("source", "steps"), "source")
    return drawn.select("doc_id", "source", "n_tokens", F.expr("size(filter(steps, s -> u > s))").alias("copies")), p


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, total_tokens: float | None = None) -> DataFrame:
    """The mix: each document once per copy with its text, spread over partitions and ordered within them by a hash of
    document and copy, which is a global shuffle."""
    n, _ = copies(documents, targets, tokenizer, total_tokens)
    chosen = n.where("copies > 0").join(documents.select("doc_id", "text"), "doc_id")
    each = chosen.select("doc_id", "source", "n_tokens", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    each = each.withColumn("place", F.xxhash64(F.lit(SEED + 1), "doc_id", "copy"))
    return each.repartition("place").sortWithinPartitions("place")


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, total_tokens: float | None = None) -> DataFrame:
    """Per target: tokens available, wanted and mixed, actual share of the mix, and whether the wanted tokens
    are there (within a hundredth)."""
    n, p = copies(documents, targets, tokenizer, total_tokens)
    got = n.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("documents"), F.max("copies").alias("most_copies")
    )
    j = p.drop("steps").join(got, "source", "left").fillna({"tokens": 0, "documents": 0, "most_copies": 0})
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    j = j.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
    return j.withColumn("met", F.abs(F.col("tokens") - F.col("wanted")) <= 0.01 * F.col("wanted"))
