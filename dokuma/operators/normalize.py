"""Token normalisation: staged joins over the distinct tokens, then ordered re-assembly.

Dimensions are DataFrames: lexicon (key, target), frequencies (word, freq), safe vocabulary (word), gazetteers
(gazetteer, word). Each stage sees only tokens that earlier stages left, and Spark chooses each join's way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars, masks
from ..session import checkpointed

MARKED = "[çğıöşüÇĞİÖŞÜ]"


def lexicon_table(raw: DataFrame) -> DataFrame:
    """(key, target) of a raw (source, target) table: sides cleaned, keys lower-cased; of several targets of a key the
    smallest counts, as the rows have no order. Rows without a key or target are dropped."""
    key = chars.tr_lower(F.trim(chars.normalize_unicode(F.col("source"))))
    target = F.trim(chars.normalize_unicode(F.col("target")))
    rows = raw.select(key.alias("key"), target.alias("target")).where("key <> '' and target <> ''")
    return rows.groupBy("key").agg(F.min("target").alias("target"))


def frequency_table(raw: DataFrame) -> DataFrame:
    """(word, freq): frequencies of case variants added, null ones as 0."""
    word = chars.tr_lower(F.trim("word"))
    return raw.where("word is not null").groupBy(word.alias("word")).agg(F.sum(F.coalesce("frequency", F.lit(0))).cast("long").alias("freq"))


def looks_noisy(raw: Column, candidate: Column) -> Column:
    """A run of three equal characters, or equal but for marks."""
    a, b = (chars.tr_lower(chars.strip_diacritics(x), "plain") for x in (raw, candidate))
    return raw.rlike(r"(?iu)(.)\1{2,}") | ((a == b) & (chars.tr_lower(raw, "plain") != chars.tr_lower(candidate, "plain")))


def confident(raw: Column, candidate: Column, freq: Column, freq_ok: int = 1) -> Column:
    return (candidate == raw) | (F.coalesce(freq, F.lit(0)) >= freq_ok) | looks_noisy(raw, candidate)


def _keys(tokens: DataFrame) -> DataFrame:
    return tokens.select("key").distinct()


def flip_hits(keys: DataFrame, lexicon: DataFrame) -> DataFrame:
    """key, target: the first lexicon hit among spellings with letters swapped for their twins (two swaps for keys of up
    to six letters, one otherwise; fewest swaps first, then by position)."""
    k = F.col("key")
    variants = F.when(F.length(k) <= 6, chars.flip_variants(k, 2)).otherwise(chars.flip_variants(k, 1))
    e = keys.select("key", F.posexplode(variants).alias("n", "variant"))
    hit = e.join(lexicon.withColumnRenamed("key", "variant"), "variant")
    return hit.groupBy("key").agg(F.min_by("target", "n").alias("target"))


def near_hits(
    keys: DataFrame, lexicon: DataFrame, frequencies: DataFrame, edits: int = 1, least_freq: int | None = None, accepted: Callable[[DataFrame, str], DataFrame] | None = None
) -> DataFrame:
    """key, target, edits, freq: the nearest lexicon key within ``edits``; ties by frequency, marks, length, key.
    least_freq and accepted (a validator) leave out candidates before the nearest is chosen, so a rare word at one edit
    doesn't hide a frequent one at two; with them the key itself is no candidate.

    Candidates come from equal deletion neighbourhoods: both sides drop up to ``edits`` letters and meet on what is
    left, so nothing is compared that doesn't nearly match (no blocking by length alone).
    """
    a = _deletions(keys.select("key"), edits)
    b = _deletions(lexicon.select(F.col("key").alias("near")), edits, "near")
    pairs = a.join(b, "rest").select("key", "near").distinct()
    d = F.levenshtein("key", "near", edits)
    pairs = pairs.withColumn("edits", d).where("edits >= 0")
    j = pairs.join(lexicon.withColumnRenamed("key", "near"), "near")
    j = j.join(frequencies.withColumnRenamed("word", "_w"), chars.tr_lower(F.col("target")) == F.col("_w"), "left").drop("_w")
    if least_freq is not None:
        j = j.where((F.col("near") != F.col("key")) & (F.coalesce("freq", F.lit(0)) >= least_freq))
    if accepted is not None:
        j = accepted(j, "target").where("target_ok").drop("target_ok")
    order = F.struct("edits", F.negate(F.coalesce("freq", F.lit(0))), F.negate(F.regexp_count("target", F.lit(MARKED))), F.length("target"), "near")
    return j.groupBy("key").agg(F.min_by(F.struct("target", "edits", "freq"), order).alias("best")).select("key", "best.*")


def _deletions(keys: DataFrame, edits: int, column: str = "key") -> DataFrame:
    k = F.col(column)
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    rest = F.array_union(F.array(k), drop(k))
    if edits > 1:
        rest = F.array_union(rest, F.flatten(F.transform(drop(k), drop)))
    return keys.select(column, F.explode(rest).alias("rest")).distinct()


def normalize_tokens(tokens: DataFrame, lexicon: DataFrame, frequencies: DataFrame, safe: DataFrame | None = None, freq_ok: int = 1) -> DataFrame:
    """token, normalized, stage of every distinct token: punctuation and safe words as they are, else an exact lexicon
    hit, else swapped letters, else the nearest key within one edit if confident, else the token."""
    t = tokens.select("token").where("token is not null").distinct().withColumn("key", chars.tr_lower(F.col("token")))
    t = t.withColumn("kept", F.col("token").rlike(r"^\p{P}*$"))
    if safe is not None:
        s = safe.select(F.col("word").alias("token"), F.lit(True).alias("cased")).distinct()
        low = safe.select(chars.tr_lower(F.col("word")).alias("key"), F.lit(True).alias("lowered")).distinct()
        t = t.join(s, "token", "left").join(low, "key", "left")
        t = t.withColumn("kept", F.col("kept") | F.coalesce("cased", F.lit(False)) | F.coalesce("lowered", F.lit(False))).drop("cased", "lowered")
    t = checkpointed(t)  # the stages below read the distinct tokens several times
    open_keys = _keys(t.where("not kept"))
    exact = open_keys.join(lexicon, "key").select("key", F.col("target").alias("exact"))
    left = open_keys.join(exact, "key", "left_anti")
    flip = flip_hits(left, lexicon).withColumnRenamed("target", "flip")
    left = left.join(flip, "key", "left_anti")
    near = near_hits(left, lexicon, frequencies).select("key", F.col("target").alias("near"), "freq")
    j = t.join(exact, "key", "left").join(flip, "key", "left").join(near, "key", "left")
    near_ok = F.when(confident(F.col("token"), F.col("near"), F.col("freq"), freq_ok), F.col("near"))
    best = F.coalesce("exact", "flip", near_ok, "token")
    stage = F.when(F.col("kept"), "kept").when(F.col("exact").isNotNull(), "exact").when(F.col("flip").isNotNull(), "flip").when(near_ok.isNotNull(), "near").otherwise("none")
    return j.select("token", F.when(F.col("kept"), F.col("token")).otherwise(best).alias("normalized"), stage.alias("stage"))


def proper_nouns(tokens: DataFrame, gazetteers: DataFrame, threshold: float = 1.5) -> DataFrame:
    """token, proper: capitalised where (gazetteers that hold it + 1) / (others + 1) reaches the threshold."""
    n = gazetteers.select(F.count_distinct("gazetteer").alias("n")).collect()[0]["n"]
    low = gazetteers.select("gazetteer", chars.tr_lower(F.col("word")).alias("key")).distinct()
    hits = low.groupBy("key").agg(F.count("*").alias("hits"))
    t = tokens.select("token").where("token is not null").distinct()
    j = t.join(hits, chars.tr_lower(F.col("token")) == F.col("key"), "left")
    h = F.coalesce("hits", F.lit(0))
    return j.select("token", F.when((h + 1) / (F.lit(n) - h + 1) >= threshold, chars.tr_upper_first(F.col("token"))).otherwise(F.col("token")).alias("proper"))


def vocabulary_validator(vocabulary: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A validator that accepts words of a vocabulary: adds ``<column>_ok``. Any callable of that shape may replace it."""
    v = vocabulary.select(chars.tr_lower(F.col("word")).alias("_v")).distinct().withColumn("_ok", F.lit(True))

    def check(df: DataFrame, column: str) -> DataFrame:
        j = df.join(v, chars.tr_lower(F.col(column)) == F.col("_v"), "left")
        return j.withColumn(f"{column}_ok", F.coalesce("_ok", F.lit(False))).drop("_v", "_ok")

    return check


#: Changes of these kinds are accepted in soft mode whatever the validator says.
LOW_RISK = ("lexicon", "diacritics", "proper")


def cascade(
    tokens: DataFrame,
    lexicon: DataFrame,
    frequencies: DataFrame,
    safe: DataFrame | None = None,
    gazetteers: DataFrame | None = None,
    freq_ok: int = 1,
    slang: bool = False,
    validator: Callable[[DataFrame, str], DataFrame] | None = None,
    diacritizer: Callable[[Column], Column] | None = None,
    vowel_restorer: Callable[[Column], Column] | None = None,
    mode: str = "soft",
    vowels: bool = True,
    accents: bool = True,
) -> DataFrame:
    """token, normalized of every distinct token by the full cascade.

    Punctuation and safe words stay. The lexicon is asked for the core between punctuation (a frequent target or a noisy
    token). Then, in this order, each on what the stage before has left: slang and signs, proper nouns, swapped letters,
    vowels and spoken endings of noisy tokens, the base stages, two edits for noisy tokens. The first change that the
    validator accepts is the result; a change it rejects is handed on to the later stages, and stands if none of them
    changes it. Without a validator, or in mode ``off``, every change is accepted; in mode ``soft`` changes of ``LOW_RISK``
    kinds are accepted anyway. Spoken endings must be frequent words as well. Hooks replace the built-in stages.
    """
    if mode not in ("soft", "off"):
        raise ValueError(f"unknown mode {mode}")
    t = tokens.select("token").where("token is not null").distinct().withColumn("kept", F.col("token").rlike(r"^\p{P}*$"))
    if safe is not None:
        t = vocabulary_validator(safe)(t, "token").withColumn("kept", F.col("kept") | F.col("token_ok")).drop("token_ok")
    word = frequencies.withColumnsRenamed({"word": "_w", "freq": "_f"})
    frequent = lambda df, c: df.join(word, chars.tr_lower(F.col(c)) == F.col("_w"), "left").withColumn("_f", F.coalesce("_f", F.lit(0)) >= freq_ok).drop("_w")
    t = t.withColumn("core", chars.split_core(F.col("token"))).withColumn("_k", chars.tr_lower(F.col("core.core")))
    t = frequent(t.join(lexicon.withColumnsRenamed({"key": "_k", "target": "_hit"}), "_k", "left"), "_hit")
    core = F.when(F.col("_f") | looks_noisy(F.col("core.core"), F.col("_hit")), F.concat("core.lead", "_hit", "core.trail"))
    t = t.select("token", F.when(F.col("kept"), F.col("token")).otherwise(core).alias("out"), F.col("token").alias("x"))
    x, y = F.col("x"), F.col("y")
    noisy = x.rlike(r"(?iu)(.)\1{2,}")

    def stage(t: DataFrame, kind: str, extra: Column | None = None) -> DataFrame:
        """The change of x to y (null for none) decided."""
        ok = F.lit(True)
        if validator is not None and mode == "soft" and kind not in LOW_RISK:
            t = validator(t, "y")
            ok = F.col("y_ok")
        if extra is not None:
            ok = ok & extra
        new = F.coalesce("y", "x")
        return t.select("token", F.coalesce("out", F.when((new != x) & ok, new)).alias("out"), new.alias("x"))

    open_keys = lambda t: t.where("out is null").select(chars.tr_lower(x).alias("key")).distinct()
    if slang:
        t = stage(t.withColumn("y", chars.apply_replacements(x)), "replacement")
    if gazetteers is not None:
        proper = proper_nouns(t.where("out is null").select(x.alias("token")), gazetteers).withColumnsRenamed({"token": "x", "proper": "y"})
        t = stage(t.join(proper, "x", "left"), "proper")
    t = checkpointed(t)  # the stages below read the tokens several times
    if diacritizer is not None:
        t = stage(t.withColumn("y", diacritizer(x)), "diacritics")
    else:
        t = stage(t.withColumn("key", chars.tr_lower(x)).join(flip_hits(open_keys(t), lexicon).withColumnRenamed("target", "y"), "key", "left"), "diacritics")
    if vowels:
        restored = vowel_restorer(x) if vowel_restorer is not None else chars.restore_vowels(x)
        t = stage(t.withColumn("y", F.when(noisy, restored)), "vowels")
    if accents:
        t = frequent(t.withColumn("y", F.when(noisy & chars.is_all_lower(x), chars.accent_normalize(x))), "y")
        t = stage(t, "accents", F.col("_f"))
    t = checkpointed(t)
    base = normalize_tokens(t.where("out is null").select(x.alias("token")), lexicon, frequencies, safe, freq_ok)
    t = stage(t.join(base.select(F.col("token").alias("x"), F.col("normalized").alias("y")), "x", "left"), "lexicon")
    t = checkpointed(t)
    far = open_keys(t.where(noisy))
    ask = validator if mode == "soft" else None
    two = near_hits(far, lexicon, frequencies, 2, freq_ok, ask).select("key", F.col("target").alias("two"))
    t = t.withColumn("key", chars.tr_lower(x)).join(two, "key", "left").withColumn("y", F.when(noisy, F.col("two")))
    return t.select("token", F.coalesce("out", "y", "x").alias("normalized"))


#: Bytes of changed tokens that may be broadcast, counted first; a larger table is joined by Spark as it sees fit.
SMALL = 64 << 20


def gathered(rows: DataFrame, key: str, tokens: str, table: DataFrame, old: str = "token", new: str = "normalized") -> DataFrame:
    """(key, new): for every row a map of those of its tokens that the (old, new) table knows. Rows divided by their key
    stay where they are; the table is broadcast if it is small."""
    each = rows.select(key, F.explode(F.array_distinct(tokens)).alias(old))
    size = table.agg(F.sum(F.octet_length(old) + F.octet_length(new) + 64)).collect()[0][0] or 0
    done = each.join(F.broadcast(table) if size <= SMALL else table, old).groupBy(key)
    return done.agg(F.map_from_entries(F.collect_list(F.struct(old, new))).alias("new"))


def texts(
    docs: DataFrame, normalizer: Callable[[DataFrame], DataFrame], key: str = "doc_id", column: str = "text", shrink: Callable[[Column], Column] = chars.shrink_runs
) -> DataFrame:
    """key, normalized text and masks of every document: plain characters, reversible masks, runs shrunk, each token by
    ``normalizer`` (a function from distinct tokens to (token, normalized)), sentence casing and spacing. Null texts stay
    null, empty ones empty.

    The documents are shuffled once, by their key; only changed tokens are joined to them, and what a document has of
    those is gathered where the document lies.
    """
    m = docs.select(key, column).repartition(key).select(key, masks.mask(chars.normalize_unicode(F.col(column))).alias("m"))
    # read three times below, and masking is the dearest step: written once
    rows = checkpointed(m.select(key, "m.masks", chars.ws_tokens(shrink(F.col("m.text"))).alias("raw")))
    words = rows.select(F.explode(F.array_distinct("raw")).alias("token")).distinct()
    table = checkpointed(normalizer(words).where("normalized <> token").select("token", "normalized"))
    j = rows.join(gathered(rows, key, "raw", table), key, "left")
    tokens = F.when(F.col("new").isNull(), F.col("raw")).otherwise(F.transform("raw", lambda t: F.coalesce(F.element_at("new", t), t)))
    s = chars.compact_ws(chars.fix_spacing(F.array_join(chars.sentence_casing(tokens, F.col("raw")), " ")))
    empty = F.when(F.col("raw").isNotNull(), "")
    return j.select(key, F.coalesce(s, empty).alias("normalized"), "masks")
