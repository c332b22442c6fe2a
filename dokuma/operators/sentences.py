"""Sentence splitting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars

# Abbreviations that don't end a sentence.
ABBREVIATIONS = frozenset(
    "dr. sn. örn. alb. prof. bkz. mr. ms. vb. vs. ar-ge doç. dzl. ed. ekon. ens. fak. fel. fiz. fizy. gn. geom. gr. haz. hek. huk is. "
    "jeol. kim. koor. kr. krş. ltd. man. mat. mec. müz. no. ör. rus. rum. sf. sp. sos t.c. tar. tek. tel. telg. tic. tğm. tiy. tls. "
    "vd. vet. ünl. yy. zool. zm. sa. adr. alm. av. ecz. öğr. şti. a.ş. tıp. müh. u.s.a. hzn. ph.d. m.sc. st. ave.".split()
)
# Forms whose marks end nothing: web and mail addresses, dotted numbers, one letter, letters with dots.
URL = r"(?i:https?://[^\s'\"()\[\]{},;:!?]+|www\.[^\s'\"()\[\]{},;:!?]+)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DOTTED = r"\b\d+(?:\.\d+)+\b"
INITIALS = r"(?:[A-Z]\.){2,}|[A-Za-z]\."
QUOTES = "'\"“”‘’()"
CLOSING = r"['\"“”‘’)\]]*"
MARKS, HIDDEN, HELD = ".!?…", "\ue000\ue001\ue002\ue003", "\ue004"
SPLIT, MAYBE, ELLIPSIS = "\ue005", "\ue006", "\ue007"


def is_abbreviation(c: Column, known: frozenset[str] = ABBREVIATIONS) -> Column:
    """A known abbreviation, one letter with a dot, or letters with dots."""
    return chars.tr_lower(c, "plain").isin(*sorted(known)) | c.rlike(r"^(?:[A-Za-z]\.|(?:[A-Z]\.){2,})$")


def _alternatives(known: frozenset[str]) -> str:
    """A pattern for abbreviations, longest first; a dot is all that needs a backslash in them."""
    return "|".join(w.replace(".", r"\.") for w in sorted(known, key=lambda w: (-len(w), w)) if w.endswith("."))


def rule_sentences(c: Column, known: frozenset[str] = ABBREVIATIONS, every_run: bool = True) -> Column:
    """Sentences of a text: they end at a dot that touches no digit, at ! and ? (up to three), and at an ellipsis before a
    capital or the end while no quote is open. Dots of addresses, numbers and abbreviations end none; closing quotes and
    brackets stay with their sentence. every_run=False ends none at !!!, ?? and ?!, as the historical rule did.

    The steps are independent of each other: marks that end nothing are hidden, the others are followed by a sign, and the
    text is cut at the signs. Null gives null, a blank text an empty array.
    """
    text = F.translate(c, "\n", " ")
    # what looks ahead is cheap and comes first: short forms have their dot near, and few texts hold an address
    short = rf"(?=[^\s.]{{1,{max((w.index('.') for w in known if '.' in w), default=1)}}}\.)(?<=(?:^|\s)[{QUOTES}]{{0,3}})(?:" + (f"(?iu:{_alternatives(known)})|" if known else "") + f"{INITIALS})"
    usual = f"{DOTTED}|{short}"
    text = F.when(text.rlike(r"(?i)https?://|www\.|@"), _hidden(text, f"{URL}|{EMAIL}|{usual}")).otherwise(_hidden(text, usual))
    run = r"[!?]{1,3}" if every_run else r"(?<![!?])(?:!!?|\?{3}|!\?|\?)(?![!?])"
    text = F.regexp_replace(text, rf"(\.{{3}}|…)(?=[ \t]*(?:\p{{Lu}}|\z))", f"$1{MAYBE}")
    text = F.replace(text, F.lit("..."), F.lit(ELLIPSIS))
    text = F.regexp_replace(text, rf"((?:{run}|(?<!\d)\.{{1,2}}(?!\d)){CLOSING})", f"$1{SPLIT}")
    pieces = F.flatten(F.transform(F.split(text, SPLIT), _unquoted))
    plain = F.transform(pieces, lambda s: F.trim(F.replace(F.translate(s, HIDDEN + HELD, MARKS), F.lit(ELLIPSIS), F.lit("...")), F.lit(" \t")))
    return F.filter(plain, lambda s: s != "")


def _hidden(text: Column, held: str) -> Column:
    """The marks inside of what the pattern holds replaced by hidden ones, and HELD behind it."""
    between = F.split(text, held, -1)
    inside = F.transform(F.regexp_extract_all(text, F.lit(f"({held})"), F.lit(1)), lambda x: F.concat(F.translate(x, MARKS, HIDDEN), F.lit(HELD)))
    return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(inside, i), F.lit("")))), "")


def _unquoted(piece: Column) -> Column:
    """Parts of a piece between ellipses; a part goes on with the next one while a quote is open."""
    even = lambda s: F.length(F.regexp_replace(s, "[^'\"]", "")) % 2 == 0
    parts = F.split(piece, MAYBE)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        now = F.concat(acc["open"], part)
        return F.when(even(now), F.struct(F.array_append(acc["done"], now).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(acc["done"].alias("done"), now.alias("open")))

    return F.when(~piece.contains(MAYBE), F.array(piece)).otherwise(F.aggregate(parts, start, step, lambda acc: F.array_append(acc["done"], acc["open"])))


_ENDS = r"(?<!\d)(?<!(?:^|[\s(\"])[A-Za-z])\.(?!\d)|[!?]{1,3}"


def simple_sentences(c: Column) -> Column:
    """The same for plain text without quotes and abbreviation lists, natively: ends are marked and the text is cut."""
    marked = F.regexp_replace(F.translate(c, "\n", " "), f"({_ENDS})", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def by_flags(tokens: Column, flags: Column) -> Column:
    """array<array<string>>: the tokens of a row cut behind each true flag."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        now = F.array_append(acc["open"], x["token"])
        closed = F.struct(F.array_append(acc["done"], now).alias("done"), F.array().cast("array<string>").alias("open"))
        return F.when(F.coalesce(x["flag"], F.lit(False)), closed).otherwise(F.struct(acc["done"].alias("done"), now.alias("open")))

    pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.get(flags, i).alias("flag")))
    return F.aggregate(pairs, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"]))


def by_predictions(tokens: DataFrame, key: str, flag: str = "ends") -> DataFrame:
    """Sentences of token rows (key, pos, token, flag): a sentence ends after each true flag; null flags don't end one."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(w), F.lit(0))
    rows = tokens.withColumn("sentence", number)
    g = rows.groupBy(key, "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return g.select(key, "sentence", F.transform("t", lambda x: x["token"]).alias("tokens"))
