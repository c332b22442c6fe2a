"""Problem 9: text that stops before its end.

Method: near-copies are found by min-hash banding over five-word shingles (similarity 0.8 or more), verified and
aligned; a copy whose alignment ends while the other goes on inside the same word or sentence is cut. Documents that no
copy settles are scored by the terminality of their closing word: how often that word closes a sentence in the whole
corpus (words never seen fall back to their endings). Closing lines, tags and links are no sentences: they are whole if
the same line (numbers aside) recurs in different texts of the corpus and no more frequent lines continue it.

One pass over the texts makes all of it: closing features, min-hash bands, and per-worker partial counts.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import textfold
from .leakage import hashes, windows
from .pairs import wanted

#: 12 bands of 3 rows: two texts of similarity 0.8 share a band with probability 0.9998.
BANDS, ROWS, SHINGLE, SIMILAR = 12, 3, 5, 0.8
LEAST_TERMINAL = 0.5  # share of a word's occurrences that close a sentence
LEAST_SEEN = 3  # occurrences from which a word speaks for itself
RECURS = 3  # different texts that close with a line before it counts as a closing line
LOOK = 30  # words before an end that are compared to find it in a copy
LONGER = 3  # times as frequent as a line must be the lines that continue it with one next word

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_FACE = re.compile(r"(?:[.!?…]*(?:[:;=8xX]['’]?-?[)(DPp3*/\\|oO]+|<3+|\^_*\^|[xX][dD]+|[←-⯿\U0001F000-\U0001FAFF️‍]+))+")
_URL = re.compile(r"(?:https?:|www\.|\w+://)\S*$|\S+@\S+$", re.I)
_MARKS = (".", "!", "?", "…")
_RULE = re.compile(r"[-–—=*_]{2,}")
_ENTITY = re.compile(r"&#?\w{0,8}$")
_NUMBER = re.compile(r"\d+")
_NEXT = re.compile(r"\W*\w*")


class _Fold(dict):
    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        r = " . " if c in ".!?…" else " , " if c in ",;:()\n" else textfold.FOLD[cp]
        self[cp] = r
        return r


_FOLD = _Fold()


def line_form(s: str) -> str:
    return _NUMBER.sub("9", " ".join(s.split())).lower()


def _last_sentence(t: str) -> str:
    """The text after the last end of a sentence or line, without emoticons."""
    at = max(t.rfind(x) for x in (". ", "! ", "? ", "… ", "\n"))
    return _FACE.sub(" ", t[at + 1 :])


def closing(text: str) -> tuple[str, str | None, str | None]:
    """(state, word, line): state is whole, cut, or open where the closing word and line decide. A text of one line has no
    closing line, whatever its length, but for a link."""
    t = text.rstrip()
    if not t:
        return "whole", None, None
    last = t.rsplit(None, 1)[-1]
    if _FACE.fullmatch(last):
        return "whole", None, None  # an emoticon closes
    url = _URL.match(last.lstrip("(<[\"'"))
    if url:
        return "open", None, line_form(url[0])
    if t[-1] == "�" or _ENTITY.search(last):
        return "cut", None, None
    last_line = t[t.rfind("\n") + 1 :].strip()
    if t[-1] in ",;:-–—([{«“/&@#=+%*<" and not _RULE.fullmatch(last_line):
        return "cut", None, None
    if t[-1] in "\"'" and (t[-2:-1].isspace() or len(t) == 1):
        return "cut", None, None
    sentence = _last_sentence(t)
    if sentence.rfind("(") > sentence.rfind(")"):
        return "cut", None, None
    if t.rstrip("\"”’'»)]")[-1:] in _MARKS or t[-1] in ")]}»”":
        return "whole", None, None
    word = next((ws[-1] for w in reversed(t.split()) if (ws := textfold.words(w))), None)
    return "open", word, line_form(last_line) if "\n" in t else None


def shingles(text: str) -> np.ndarray:
    return np.unique(windows(hashes(text)[0], SHINGLE))


def bands(text: str, w: np.ndarray | None = None) -> list[int] | None:
    """Band keys of a text (w: its shingles); texts under five words have none."""
    w = shingles(text) if w is None else w
    if not len(w):
        return None
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(w), 4096):
        part = w[i : i + 4096]
        part = part ^ (part >> np.uint64(31))
        x = part[:, None] * _A + _B
        np.minimum(low, x.min(axis=0), out=low)
    m = (low >> np.uint64(8)).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + m[:, j]
        key ^= key >> np.uint64(29)
    return (key ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


_ROW = "doc_id long, source string, state string, word string, line string, cls long, asks boolean, size int, bands array<bigint>, closes long, total long"
_COLUMNS = ["doc_id", "source", "state", "word", "line", "cls", "asks", "size", "bands", "closes", "total"]
_TYPES = {"doc_id": "Int64", "cls": "Int64", "asks": "boolean", "size": "Int32", "closes": "Int64", "total": "Int64"}


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    closes: Counter = Counter()

    def counts() -> pd.DataFrame:
        rows = [(None, None, None, w, None, None, None, None, None, closes[w], n) for w, n in total.items()]
        total.clear()
        closes.clear()
        return pd.DataFrame(rows, columns=_COLUMNS).astype(_TYPES)

    for pdf in batches:
        rows = []
        for i, s, t in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
            marked = t.translate(_FOLD).split()
            total.update(marked[:-1])  # the closing word itself is what is asked about
            closes.update([a for a, b in zip(marked, marked[1:]) if b == "."])
            state, word, line = closing(t)
            ws = [w for w in marked if w != ","]
            cls = xxhash.xxh64_intdigest(" ".join(ws)) - (1 << 63)  # one class for equal folded texts
            asks = state != "cut" and ws[-1:] != ["."]  # no copy can show anything else to be cut
            w = shingles(t)
            rows.append((i, s, state, word, line, cls, asks, len(w), bands(t, w), None, None))
        yield pd.DataFrame(rows, columns=_COLUMNS).astype(_TYPES)
        if len(total) > 200_000:
            yield counts()
    yield counts()


def _terminality(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = scan.where("doc_id is null and word not in ('.', ',')").groupBy("word").agg(F.sum("closes").alias("closes"), F.sum("total").alias("total"))
    endings = counts.where("length(word) > 4").groupBy(F.substring("word", -4, 4).alias("ending")).agg(
        F.sum("closes").alias("end_closes"), F.sum("total").alias("end_total")
    )
    return counts, endings


def _key(line: str) -> int:
    """Spark's xxhash64 of a line."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _continued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, next, n: how often other lines of the sorted part continue a line. next is the word that follows it, or null
    if its last word goes on. A part begins with all prefixes of its first line, as these may stand in an earlier part."""
    stack: list[tuple[int, int, Counter]] = []  # (length, key, count) of the prefixes of the line at hand
    last = None

    def rows(shared: int) -> list[tuple[int, str | None, int]]:
        out = []
        while stack and stack[-1][0] > shared:
            _, key, count = stack.pop()
            out += [(key, w, n) for w, n in count.items()]
        return out

    frame = lambda r: pd.DataFrame(r, columns=["key", "next", "n"])
    for pdf in batches:
        out = []
        for line, n in zip(pdf["line"], pdf["n"]):
            if last is None:
                h = xxhash.xxh64(seed=42)
                for k, c in enumerate(line[:-1], 1):
                    h.update(c.encode())
                    x = h.intdigest()
                    stack.append((k, x - (1 << 64) if x >> 63 else x, Counter()))
            else:
                out += rows(len(os.path.commonprefix([last, line])))
            for k, _, count in stack:
                count[None if line[k - 1].isalnum() and line[k].isalnum() else _NEXT.match(line, k)[0]] += n
            stack.append((len(line), _key(line), Counter()))
            last = line
        yield frame(out)
    yield frame(rows(0))


def _lines(docs: DataFrame) -> DataFrame:
    """line, recurs, continues, of every closing line; equal texts count once. A line that breaks off inside a word is cut
    if lines that go on there are as frequent, another one if those with one and the same next word are LONGER times as
    frequent. It recurs only if fewer lines continue it, else its closing word decides."""
    n = docs.where("line is not null").groupBy("line").agg(F.countDistinct("cls").alias("n"))
    parts = n.repartitionByRange("line").sortWithinPartitions("line").mapInPandas(_continued, "key long, next string, n long")
    longer = parts.groupBy("key", "next").agg(F.sum("n").alias("n")).groupBy("key").agg(
        F.coalesce(F.max(F.expr("if(next is null, n, null)")), F.lit(0)).alias("inside"),
        F.coalesce(F.max(F.expr("if(next is null, null, n)")), F.lit(0)).alias("after"),
    )
    j = n.withColumn("key", F.xxhash64("line")).join(longer, "key", "left").fillna(0, ["inside", "after"])
    cut = ((F.col("inside") >= RECURS) & (F.col("inside") >= F.col("n"))) | ((F.col("after") >= RECURS) & (F.col("after") >= LONGER * F.col("n")))
    whole = (F.col("n") >= RECURS) & (F.greatest("inside", "after") < F.col("n"))
    return j.select("line", (~cut & whole).alias("recurs"), cut.alias("continues"))


def _after(a: str, b: str) -> tuple[bool, bool] | None:
    """(b goes on inside the word or sentence that closes a, b ends there too) if a's end is found in b: of the places
    that hold a's closing words, the one before which most words agree, whatever was put in or left out earlier."""
    x, y = a.rstrip().translate(_FOLD).split(), b.translate(_FOLD).split()
    x = [w for w in x if w != ","]
    y = [w for w in y if w != ","]
    if len(x) < 4 or len(y) < 4:
        return None
    key, last, at = x[-4:-1], x[-1], len(x) - 4
    places = [i for i in range(len(y) - 2) if y[i] == key[0] and y[i : i + 3] == key]
    if not places:
        return None
    agree = lambda i: sum(u == v for u, v in zip(x[max(0, at - LOOK) : at][::-1], y[max(0, i - LOOK) : i][::-1]))
    i = max(places, key=lambda i: (agree(i), -abs(i - at)))
    z = y[i + 3] if i + 3 < len(y) else ""
    if z == last:
        rest = y[i + 4 :]
        return bool(rest) and last != "." and rest[0] != ".", not rest
    if last != "." and z.startswith(last):
        return True, False
    return None


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for c, a, b in zip(pdf["cls"], pdf["text"], pdf["other_text"]):
            x, y = shingles(a), shingles(b)
            n = len(np.intersect1d(x, y, assume_unique=True))
            if n and n >= SIMILAR * (len(x) + len(y) - n):
                r = _after(a, b)
                if r and r[0]:
                    out.append(c)
        yield pd.DataFrame({"cls": pd.Series(out, dtype="int64")})


def _cut_copies(documents: DataFrame, docs: DataFrame) -> DataFrame:
    """cls of the classes of equal texts that a near-copy continues. In each band bucket every class whose end is open
    meets every other class, as far as their numbers of shingles allow the similarity; adaptive execution may split hot
    buckets."""
    reps = docs.where("bands is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("asks").alias("asks"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    a = reps.where("asks").select("cls", "doc_id", "size", F.explode("bands").alias("band"))
    b = reps.select(F.col("doc_id").alias("other_id"), F.col("size").alias("other_size"), F.explode("bands").alias("band"))
    near = (F.col("doc_id") != F.col("other_id")) & (F.least("size", "other_size") >= SIMILAR * F.greatest("size", "other_size"))
    pairs = checkpointed(a.join(b, "band").where(near).select("cls", "doc_id", "other_id").distinct())
    text = wanted(documents.select("doc_id", "text"), "doc_id", pairs, "doc_id", "other_id")
    pairs = pairs.join(text, "doc_id").join(text.withColumnsRenamed({"doc_id": "other_id", "text": "other_text"}), "other_id")
    return pairs.select("cls", "text", "other_text").mapInPandas(_align, "cls long").distinct()


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, truncated, reason for every document with a text; an empty text isn't cut."""
    documents = documents.where("text is not null").select("doc_id", "source", "text")
    scan = checkpointed(documents.mapInPandas(_scan, _ROW))
    docs = scan.where("doc_id is not null")
    words, endings = _terminality(scan)
    # most documents are settled by their last sign and stay out of the joins; a missing word or line gets a key of its
    # own, as equal null keys would all meet in one task
    own = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\u0001"), F.col("doc_id").cast("string")))
    j = docs.where("state = 'open'").select("doc_id", "source", "state", "cls", "asks", "word", own("word").alias("_word"), own("line").alias("line"))
    j = j.withColumn("ending", F.substring("_word", -4, 4)).join(words.withColumnRenamed("word", "_word"), "_word", "left")
    j = j.join(endings, "ending", "left").join(_lines(docs), "line", "left")
    rate = F.col("closes") / F.col("total")
    by_ending = F.when(F.length("word") > 4, F.col("end_closes") / F.col("end_total"))
    known = F.coalesce(F.col("total"), F.lit(0)) >= LEAST_SEEN
    terminal = F.coalesce(F.when(known, rate >= LEAST_TERMINAL).otherwise(by_ending >= LEAST_TERMINAL), F.lit(False))
    open_reason = F.when(F.col("continues"), "line goes on").when(F.col("recurs") | F.col("word").isNull(), None).when(~terminal, "closing word")
    # only documents whose end is open can be shown cut by a copy; the others stay out of that join, too
    j = j.select("doc_id", "source", "state", "cls", "asks", open_reason.alias("open_reason"))
    none = F.lit(None).cast("string")
    closed = docs.where("state <> 'open'").select("doc_id", "source", "state", "cls", "asks", none.alias("open_reason"))
    asking = j.unionByName(closed.where("asks")).join(_cut_copies(documents, docs).withColumn("copied", F.lit(True)), "cls", "left")
    j = asking.drop("cls", "asks").unionByName(closed.where("not asks").drop("cls", "asks").withColumn("copied", F.lit(False)))
    reason = F.when(F.col("state") == "cut", "mark").when(F.col("copied"), "copy goes on").otherwise(F.col("open_reason"))
    return j.select("doc_id", "source", reason.isNotNull().alias("truncated"), reason.alias("reason"))


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).where("truncated").select("doc_id").distinct()


def rates(documents: DataFrame, source: Column | None = None) -> DataFrame:
    """Documents, truncated documents and their share per source; an unknown source is a row of its own."""
    g = judged(documents).groupBy(F.coalesce(F.col("source") if source is None else source, F.lit("unknown")).alias("source"))
    g = g.agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    return g.withColumn("share", F.col("truncated") / F.col("documents"))
