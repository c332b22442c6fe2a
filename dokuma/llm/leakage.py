"""Problem 7: passages of test items inside corpus documents.

Method: template canonicalisation. Numbers, names (words with an apostrophe before their ending) and units become typed
placeholders; hashes of five-word template windows of documents are looked up among those of the items. Hits on near
diagonals form a stretch; it counts if it covers half of the passage with at most a tenth of its words exchanged.
Words that differ only in a slot are checked for consistency (one word of the item always became the same word),
which marks re-parameterised copies.

A window that consists of placeholders only says nothing of its item and is looked up by its plain words. A passage of
fewer than nine words has windows as long as its half, which is the shortest stretch that counts.

The item windows are broadcast only if the item table is small (rows and bytes counted first, ``MAX_ITEMS`` and
``MAX_BYTES``); a larger item table is joined on the window hash by Spark, with the same rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import textfold

WINDOW = 5
SHARE = 0.5  # of the passage's words in one stretch
EXCHANGED = 0.1  # of the stretch's words
DRIFT = 3  # words by which neighbouring hits may be shifted
WIDTH = 64  # least breadth of diagonals looked at together; a quarter of the item's length if that is more
MAX_ITEMS, MAX_BYTES = 20_000, 16 << 20  # items whose windows may be broadcast

# Units, folded.
UNITS = frozenset("mm cm m km m2 m3 gr g kg ton ml lt l litre metre kilometre gram kilogram tl lira kurus dolar euro dk dakika saat sn saniye gun hafta ay yil derece c w kw v hz gb mb kb yuzde".split())
_SLOTS = np.array([xxhash.xxh64_intdigest(x) for x in ("#name", "#number", "#unit")], dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


class _Fold(dict):
    """textfold's fold, but apostrophes stay."""

    def __missing__(self, cp: int) -> str:
        r = "'" if chr(cp) in textfold.APOSTROPHES else textfold.FOLD[cp]
        self[cp] = r
        return r


_FOLD = _Fold()
_seen: dict[str, tuple[int, int]] = {}


def _hash(w: str) -> tuple[int, int]:
    """(hash of the plain word, hash of its template token) of a folded word that may hold an apostrophe."""
    h = _seen.get(w)
    if h is None:
        if len(_seen) > 400_000:
            _seen.clear()
        plain = w.replace("'", "")
        slot = "#name" if "'" in w.strip("'") else "#number" if plain.isdigit() else "#unit" if plain in UNITS else plain
        h = _seen[w] = (xxhash.xxh64_intdigest(plain), xxhash.xxh64_intdigest(slot))
    return h


def hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the template tokens of a text."""
    pairs = [_hash(w) for w in text.translate(_FOLD).split() if w.strip("'")]
    a = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def windows(tokens: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Hash of each window of k tokens."""
    n = len(tokens) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += tokens[j : j + n] * _POWERS[j]
    return out


def telling(plain: np.ndarray, template: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k tokens hold a word that is no placeholder."""
    word = np.concatenate([[0], np.cumsum(~np.isin(template, _SLOTS))])
    return word[k:] > word[:-k] if len(plain) >= k else np.empty(0, bool)


def keys(plain: np.ndarray, template: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, whether it is a template key) of each window: the template, or the plain words of one that has no word."""
    tells = telling(plain, template, k)
    return np.where(tells, windows(template, k), windows(plain, k)), tells


def passage(text: str) -> str:
    """The passage of an item: the text after an instruction line, else the text."""
    _, line, rest = text.strip().partition("\n")
    return rest if line and rest.strip() else text


def longest(match: np.ndarray) -> tuple[int, int]:
    """Longest stretch [start, stop) that begins and ends with a match and has at most a tenth of others."""
    w = np.where(match, int(EXCHANGED * 100), int(EXCHANGED * 100) - 100)
    p = np.concatenate([[0], np.cumsum(w)])
    best = (0, 0)
    low = np.minimum.accumulate(p)
    high = np.maximum.accumulate(p[::-1])[::-1]
    i = j = 0
    n = len(p)
    while i < n and j < n:
        if low[i] <= high[j]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    s, e = best
    while s < e and not match[s]:
        s += 1
    while e > s and not match[e - 1]:
        e -= 1
    return s, e


class Item:
    def __init__(self, item_id: int, text: str):
        self.id = item_id
        self.plain, self.template = hashes(passage(text))
        self.n = len(self.plain)
        self.least = math.ceil(self.n * SHARE)  # words of the shortest stretch that counts
        self.k = min(WINDOW, self.least)


def compare(item: Item, plain: np.ndarray, template: np.ndarray, hits: list[tuple[int, int]]) -> tuple[float, int, int, bool, bool] | None:
    """(coverage, stretch length, slots changed, consistent) of the best stretch and whether any stretch is verbatim, or None. hits: (document, item) positions."""
    diagonals = np.unique([d - i for d, i in hits])
    groups = np.split(diagonals, np.flatnonzero(np.diff(diagonals) > DRIFT) + 1)
    # exchanges shift a stretch by less than a quarter of its length, so it lies in one of the overlapping bands whole
    width = max(WIDTH, item.n // 2)
    clusters = []
    for g in groups:
        low = g[0]
        while True:
            clusters.append(g[(g >= low) & (g < low + width)])
            low += width // 2
            if low + width // 2 > g[-1]:
                break
    best, verbatim = None, False
    index = np.arange(item.n)
    for cluster in clusters:
        match = np.zeros(item.n, bool)
        same = np.zeros(item.n, bool)
        at = np.full(item.n, -1)
        for d in cluster:
            pos = index + d
            ok = (pos >= 0) & (pos < len(plain))
            eq = np.zeros(item.n, bool)
            eq[ok] = plain[pos[ok]] == item.plain[ok]
            slot = np.zeros(item.n, bool)
            slot[ok] = template[pos[ok]] == item.template[ok]
            new = (eq & ~same) | (slot & ~match)
            at[new] = pos[new]
            match |= slot | eq
            same |= eq
        s, e = longest(same)
        if e - s < item.least:  # a stretch whose slots were filled anew is looked at as well
            ts, te = longest(match)
            changed = [(int(item.plain[i]), int(plain[at[i]])) for i in range(ts, te) if match[i] and not same[i]]
            if te - ts < item.least or len(changed) > 0.34 * (te - ts):
                continue
            s, e = ts, te
        else:
            changed = [(int(item.plain[i]), int(plain[at[i]])) for i in range(s, e) if match[i] and not same[i]]
        filled = defaultdict(set)
        for x, y in changed:
            filled[x].add(y)
        row = (float(match[s:e].sum()) / item.n, int(e - s), len(changed), all(len(v) == 1 for v in filled.values()))
        verbatim |= row[2] <= EXCHANGED * row[1]
        if best is None or row[0] > best[0]:
            best = row
    return best and (*best, verbatim)


class Index:
    """Sorted windows of the items, by window length (shorter than five only for shorter passages)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = [x for x in (Item(i, t) for i, t in rows if t) if x.n]
        self.by_k = {}
        for k in sorted({x.k for x in self.items}):
            some = [(j, x) for j, x in enumerate(self.items) if x.k == k]
            both = [keys(x.plain, x.template, k) for _, x in some]
            h = np.concatenate([w for w, _ in both])
            tells = np.concatenate([w for _, w in both])
            plain = np.concatenate([windows(x.plain, k) for _, x in some])
            item = np.concatenate([np.full(len(w), j) for (j, _), (w, _) in zip(some, both)])
            pos = np.concatenate([np.arange(len(w)) for w, _ in both])
            order = np.lexsort((pos, item, h))
            h, item, pos, tells, plain = h[order], item[order], pos[order], tells[order], plain[order]
            # a template window that an item repeats is looked up at its first place, and at the others by its plain words,
            # as are windows of slots only: else those of tables of numbers would hit everywhere
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
            first &= tells
            again = np.argsort(plain[~first], kind="stable")
            self.by_k[k] = ((h[first], item[first], pos[first]), (plain[~first][again], item[~first][again], pos[~first][again]))

    def matches(self, text: str) -> list[tuple[int, float, int, int, bool]]:
        plain, template = hashes(text)
        hits = defaultdict(list)
        for k, tables in self.by_k.items():
            for words, (h, item, pos) in zip((template, plain), tables):
                w = windows(words, k)
                if not len(w) or not len(h):
                    continue
                at = np.searchsorted(h, w)
                for d in np.flatnonzero(h[np.minimum(at, len(h) - 1)] == w):
                    i = at[d]
                    while i < len(h) and h[i] == w[d]:
                        hits[item[i]].append((int(d), int(pos[i])))
                        i += 1
        out = []
        for j, found in hits.items():
            r = compare(self.items[j], plain, template, found)
            if r:
                out.append((self.items[j].id, *r))
        return out


_SCHEMA = "doc_id long, item_id long, coverage double, words int, slots_changed int, consistent boolean, verbatim boolean"
_NAMES = ["doc_id", "item_id", "coverage", "words", "slots_changed", "consistent", "verbatim"]


def matches(documents: DataFrame, items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Every (document, item) whose passage the document holds, with its coverage. Null and empty texts hold none."""
    docs = documents.where("text is not null").select("doc_id", "text")
    items = items.where("text is not null").select("item_id", "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0]
    if n > max_items or size > MAX_BYTES:
        return _joined(docs, items)
    index = documents.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in items.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *m) for i, t in zip(pdf["doc_id"], pdf["text"]) for m in index.value.matches(t)]
            yield pd.DataFrame(rows, columns=_NAMES)

    return docs.mapInPandas(run, _SCHEMA)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for an item table of any size: a join on window hashes, then a check of each candidate pair."""

    def cut(sizes: list[int] | None):
        """Window keys of documents for the window lengths that occur, or of items for their own (sizes None)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, out, ks = [], [], []
                for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                    plain, template = hashes(passage(t) if sizes is None else t)
                    for k in [min(WINDOW, math.ceil(len(plain) * SHARE))] if sizes is None else sizes:
                        if 0 < k <= len(plain):
                            w = np.unique(keys(plain, template, k)[0]).view(np.int64)
                            ids.append(np.full(len(w), i))
                            ks.append(np.full(len(w), k))
                            out.append(w)
                whole = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
                yield pd.DataFrame({"id": whole(ids), "k": whole(ks), "key": whole(out)})

        return run

    b = checkpointed(items.mapInPandas(cut(None), "id long, k int, key long").withColumnRenamed("id", "item_id"))
    sizes = [r["k"] for r in b.select("k").distinct().collect()]  # at most WINDOW lengths
    a = docs.mapInPandas(cut(sizes), "id long, k int, key long").withColumnRenamed("id", "doc_id")
    pairs = a.join(b, ["k", "key"]).select("doc_id", "item_id").distinct()
    pairs = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, j, t, p in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item_text"]):
                rows += [(i, *m) for m in Index([(j, p)]).matches(t)]
            yield pd.DataFrame(rows, columns=_NAMES)

    return pairs.select("doc_id", "item_id", "text", "item_text").mapInPandas(check, _SCHEMA)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs whose words agree in a stretch, even if a longer one has its slots filled anew; pairs that agree only with their slots filled anew are left to the report."""
    return matches(documents, items).where("verbatim").select("doc_id", "item_id").distinct()


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item: documents that hold it, largest coverage, and copies with slots filled anew."""
    m = matches(documents, items).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.max("coverage").alias("coverage"),
        F.sum((F.col("slots_changed") > 0.1 * F.col("words")).cast("long")).alias("re_parameterised"),
    )
    return items.select("item_id", "task", "split").join(m, "item_id", "left").fillna({"documents": 0, "re_parameterised": 0})
