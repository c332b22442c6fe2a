"""Rule tokeniser: Column expressions over one array of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars

# Endings of verbs, of copulas, and vowels.
VERB_ENDING = "(dı|di|du|dü|tı|ti|tu|tü|yor|muş|miş|acak|ecek)$"
COPULA = "(dır|dir|dur|dür|tır|tir|tur|tür)$"
VOWELS = "[aeıioöuüAEIİOÖUÜ]"
SMALL = 64 << 20
TAG = r"@(?:mention|smiley|vocative|hashtag|keyword)\[[^\]]*\]"


def add_spaces(c: Column) -> Column:
    """Blanks around punctuation; commas, colons and dots beside digits and the ellipsis stay attached."""
    s = F.replace(c, F.lit("..."), F.lit(" \u0001 "))
    s = F.regexp_replace(s, r"([?!;(){}\[\]])", " $1 ")
    for sign in (",", ":", r"\."):
        s = F.regexp_replace(s, rf"(?<!\d){sign}(?!\d)", f" {sign[-1]} ")
    s = F.regexp_replace(s, '(["“”«»])', " $1 ")
    return F.replace(chars.compact_ws(s), F.lit("\u0001"), F.lit("..."))


def looks_like_verb(c: Column) -> Column:
    return F.lower(c).rlike(VERB_ENDING)


def split_copula(t: Column) -> Column:
    """Array of one or two parts of a token: future plus past, -ydi/-ymiş/-yken, -bilir plus -dik, and copula endings of
    words that don't look like verbs."""
    low = chars.tr_lower(t, "plain")
    cut = lambda n: F.array(F.left(t, F.length(t) - n), F.substring(t, -n, n) if isinstance(n, int) else F.right(t, n))
    long = F.when(low.rlike("ymiş$|yken$"), 4).otherwise(3)
    stem = F.left(t, F.length(t) - 3)
    return (
        F.when(low.rlike("(?s)(acak|ecek)(tı|ti|tu|tü)$"), cut(2))
        .when(low.rlike("(ydi|ymiş|yken)$") & (F.length(t) - long > 1), F.array(F.left(t, F.length(t) - long), F.right(t, long)))
        .when(low.rlike("bilirdik$"), cut(3))
        .when(low.rlike(COPULA) & ~looks_like_verb(t) & (F.length(t) >= 5) & stem.rlike(VOWELS), cut(3))
        .otherwise(F.array(t))
    )


def rule_tokens(c: Column, domain: str = "boun", copulas: bool = True) -> Column:
    """Tokens of a text. ``boun`` splits copulas; ``iwt`` keeps @tag[...] whole and splits nothing inside words.
    Null gives null, a blank text an empty array."""
    if domain == "iwt":
        parts = F.split(c, TAG, -1)
        tags = F.regexp_extract_all(c, F.lit(TAG), F.lit(0))
        spaced = F.transform(parts, lambda p: chars.ws_tokens(add_spaces(p)))
        return F.flatten(F.transform(spaced, lambda ts, i: F.when(i < F.size(tags), F.array_append(ts, F.get(tags, i))).otherwise(ts)))
    tokens = chars.ws_tokens(add_spaces(c))
    return F.flatten(F.transform(tokens, split_copula)) if copulas else tokens


def sentence_words(sentences: DataFrame, key: str = "ex_id", column: str = "text") -> DataFrame:
    """(key, sentence, pos, token): the words and signs of sentence texts, as the boundary features take them. Rows of one
    key are its sentences, in the order of ``sentence`` where the table has that column, else one sentence each."""
    number = F.col("sentence") if "sentence" in sentences.columns else F.lit(0)
    return sentences.select(key, number.alias("sentence"), F.posexplode(chars.ws_tokens(add_spaces(F.col(column)))).alias("pos", "token"))


def _grams(tokens: str, n: int) -> Column:
    """array<struct(start, n, phrase)> of the windows of n tokens."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("phrase")))


def merge_phrases(docs: DataFrame, phrases: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Multi-word expressions merged: leftmost longest match of the ``phrase`` column in each row's tokens, exact case.

    Windows of each length are joined with the phrases; overlaps are resolved inside the row. Empty and null rows stay.
    Rows are shuffled once, by their key; a phrase table of up to ``SMALL`` bytes (counted first) is broadcast to them.
    """
    docs = docs.repartition(F.col(key))
    words = F.size(chars.ws_tokens(F.col("phrase")))
    known = phrases.select("phrase", words.alias("n")).where("n > 1").distinct()
    sizes = known.groupBy("n").agg(F.sum(F.octet_length("phrase") + 64).alias("size")).orderBy("n").collect()  # a handful of lengths
    lengths = [r["n"] for r in sizes]
    if not lengths:
        return docs
    grams = F.flatten(F.array(*(_grams(tokens, n) for n in lengths)))
    spans = docs.where(F.size(tokens) > 1).select(key, F.explode(grams).alias("g")).select(key, "g.*")
    known = F.broadcast(known) if sum(r["size"] for r in sizes) <= SMALL else known
    hits = spans.join(known, ["phrase", "n"], "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", F.negate("n").alias("back")))).alias("spans"))
    # leftmost longest: sorted by start, then longest; a span that begins before the last kept one ends is skipped
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("kept")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct((s["start"] - s["back"]).alias("at"), F.array_append(a["kept"], F.struct(s["start"].alias("start"), (s["start"] - s["back"]).alias("stop"))).alias("kept"))
        ),
        lambda a: a["kept"],
    )
    j = docs.join(hits.select(key, kept.alias("kept")), key, "left")
    part = F.transform(
        F.col(tokens),
        lambda t, i: F.when(F.exists("kept", lambda k: k["start"] == i), F.array_join(F.slice(tokens, i + 1, F.element_at(F.filter("kept", lambda k: k["start"] == i), 1)["stop"] - i), " "))
        .when(F.exists("kept", lambda k: (k["start"] < i) & (i < k["stop"])), F.lit(None)).otherwise(t),
    )
    merged = F.when(F.col("kept").isNull(), F.col(tokens)).otherwise(F.filter(part, lambda t: t.isNotNull()))
    return j.withColumn(tokens, merged).drop("kept")


def merge_dependents(tokens: DataFrame, sentence: tuple[str, ...] = ("ex_id",)) -> DataFrame:
    """Tokens of multi-word expressions (relations flat, fixed, mwe, compound with a head) joined where their head stands,
    chains included. Input: one row per token with id, form, head, deprel; output: sentence keys and the tokens in order.

    A sentence is short, so the chains are followed inside the row, once for each of its tokens, which no chain outlasts.
    A head that is no token of the sentence joins nothing; the tokens of a ring of heads gather at its smallest.
    """
    rows = tokens.where("id is not null and form is not null").dropDuplicates([*sentence, "id"])
    s = rows.groupBy(*sentence).agg(F.array_sort(F.collect_list(F.struct("id", "form", F.coalesce("head", F.lit(0)).alias("head"), "deprel"))).alias("t"))
    part = lambda x: F.coalesce(x["deprel"].isin("flat", "fixed", "mwe", "compound") & (x["head"] != 0) & F.array_contains(F.transform("t", lambda y: y["id"]), x["head"]), F.lit(False))
    s = s.withColumn("up", F.map_from_entries(F.filter(F.transform("t", lambda x: F.struct(x["id"].alias("id"), F.when(part(x), x["head"]).alias("head"))), lambda x: x["head"].isNotNull())))
    steps = F.sequence(F.lit(1), F.greatest(F.size("up"), F.lit(1)))

    def top(x: Column) -> Column:
        """The last head over x; in a ring, where there is none, its smallest."""
        up = lambda i: F.coalesce(F.element_at("up", i), i)
        last = F.aggregate(steps, x, lambda at, _: up(at))
        ring = F.aggregate(steps, F.struct(last.alias("at"), last.alias("low")), lambda a, _: F.struct(up(a["at"]).alias("at"), F.least(a["low"], up(a["at"])).alias("low")), lambda a: a["low"])
        return F.when(F.element_at("up", last).isNull(), last).otherwise(ring)

    plain = F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["id"].alias("group")))
    s = s.withColumn("g", F.when(F.size("up") == 0, plain).otherwise(F.transform("t", lambda x: F.struct(x["id"].alias("id"), top(x["id"]).alias("group")))))
    members = lambda i: F.filter("t", lambda y: F.exists("g", lambda z: (z["id"] == y["id"]) & (z["group"] == i)))
    joined = F.transform(
        F.filter("t", lambda x: F.exists("g", lambda z: (z["id"] == x["id"]) & (z["group"] == x["id"]))),
        lambda x: F.array_join(F.transform(members(x["id"]), lambda y: y["form"]), " "),
    )
    return s.select(*sentence, joined.alias("tokens"))
