"""Character, case and spacing functions: Column in, Column out, all inside the JVM.

Null stays null and empty stays empty unless stated. Lower-casing is Turkish: I to dotless i, I with dot to i.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters with marks and their plain forms, lower and upper case.
MARKED, PLAIN = "çğşöüıÇĞŞÖÜİ", "cgsouiCGSOUI"
# Typographic signs, their plain forms, and signs to drop.
SIGNS, SIGNS_TO = "’‘“”–— ", "''\"\"-- "
DROPPED = "​‌‍﻿"
#: Letter that a plain letter may stand for, both ways.
FLIPS = {"c": "ç", "ç": "c", "g": "ğ", "ğ": "g", "s": "ş", "ş": "s", "o": "ö", "ö": "o", "u": "ü", "ü": "u", "i": "ı", "ı": "i"}


def tr_lower(c: Column, mode: str = "tr", compat: bool = False) -> Column:
    """Lower case. mode: ``tr`` (all Turkish capitals), ``ii`` (only I and İ first), ``plain``, ``casefold``.
    compat reproduces the historical Ğ to g."""
    if mode == "plain":
        return F.lower(c)
    if mode == "casefold":
        return F.regexp_replace(F.lower(F.translate(c, "İ", "i")), "ß", "ss")
    if mode == "ii":
        return F.lower(F.translate(c, "Iİ", "ıi"))
    return F.lower(F.translate(c, "İIÜŞÖÇĞ", "iıüşöçg" if compat else "iıüşöçğ"))


def tr_upper_first(c: Column) -> Column:
    """The first letter in upper case (i to İ, ı to I), the rest untouched; a text without letters stays."""
    g = lambda k: F.regexp_extract(c, r"(?s)^(\P{L}*)(\p{L})(.*)$", k)
    up = F.concat(g(1), F.upper(F.translate(g(2), "iı", "İI")), g(3))
    return F.when(c.rlike(r"\p{L}"), up).otherwise(c)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def sanitize(c: Column) -> Column:
    """Typographic quotes, dashes, ellipsis and hard spaces in plain form; zero-width characters dropped."""
    return F.replace(F.translate(c, SIGNS + DROPPED, SIGNS_TO), F.lit("…"), F.lit("..."))


def normalize_unicode(c: Column) -> Column:
    """NFKC, then sanitize, then NFC. Plain ASCII never leaves the JVM."""
    odd = c.rlike(r"[^\x00-\x7FçğıöşüÇĞİÖŞÜ]")
    return F.when(odd, _nfc(sanitize(_nfkc(F.when(odd, c))))).otherwise(c)


def compact_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """NFKC with white space compacted."""
    odd = c.rlike(r"[^\x00-\x7FçğıöşüÇĞİÖŞÜ]")
    return compact_ws(F.when(odd, _nfkc(F.when(odd, c))).otherwise(c))


def fix_spacing(c: Column, protect_ellipsis: bool = True) -> Column:
    """No blanks around apostrophes; a blank after .,!?;: unless a quote or blank follows. Runs of dots stay together
    unless protect_ellipsis is off."""
    s = F.regexp_replace(c, r"\s*'\s*", "'")
    if protect_ellipsis:
        return F.regexp_replace(F.regexp_replace(s, r"([,!?;:])([^\s\"])", "$1 $2"), r"\.(?![\s\".]|$)", ". ")
    return F.regexp_replace(s, r"([.,!?;:])([^\s\"])", "$1 $2")


def shrink_runs(c: Column, to: int = 2, ignore_case: bool = True) -> Column:
    """Runs of a character longer than ``to`` cut to ``to``."""
    return F.regexp_replace(c, ("(?iu)" if ignore_case else "") + r"(.)\1{%d,}" % to, "$1" * to)


def shrink_repetitions_to(c: Column, to: int) -> Column:
    """Runs cut to ``to`` (all runs to one if to <= 1), then a doubled letter at a word's end made single."""
    if to <= 1:
        return F.regexp_replace(c, r"(.)\1+", "$1")
    return F.regexp_replace(shrink_runs(c, to, False), r"(\p{L})\1(?!\p{L})", "$1")


def strip_diacritics(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def char_category(c: Column) -> Column:
    """Category of one character: WS, L, D, P or O; the begin and end marks stay."""
    return (
        F.when(c.isin("<BOS>", "<EOS>"), c)
        .when(c.rlike(r"^[\s\p{Z}]$"), "WS")
        .when(c.rlike(r"^\p{L}$"), "L")
        .when(c.rlike(r"^\p{Nd}$"), "D")
        .when(c.rlike(r"^\p{P}$"), "P")
        .otherwise("O")
    )


def starts_lower(c: Column) -> Column:
    """The first letter is lower case; false without letters."""
    return c.rlike(r"^\P{L}*\p{Ll}")


def is_all_lower(c: Column) -> Column:
    """No letter that isn't lower case; true without letters."""
    return ~c.rlike(r"[\p{L}&&[^\p{Ll}]]")


def is_acronym(c: Column, most: int = 8) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{L}&&[^\p{Lu}]]") & (F.length(c) <= most)


def is_proper_case(c: Column) -> Column:
    """The first letter is upper case and another letter isn't."""
    return c.rlike(r"^\P{L}*\p{Lu}") & c.rlike(r"[\p{L}&&[^\p{Lu}]]")


def final_devoicer(c: Column) -> Column:
    """A final b, c, d, g or ğ hardened."""
    last = F.substring(c, -1, 1)
    return F.when(F.length(c) == 0, c).otherwise(F.concat(F.left(c, F.length(c) - 1), F.translate(last, "bcdgğ", "pçtkk")))


def clean_title(c: Column) -> Column:
    """Parenthesised parts dropped."""
    return F.trim(F.regexp_replace(c, r"\s*\(.*?\)\s*", ""))


def normalize_title_line(c: Column, most: int = 200) -> Column:
    """Underscores to blanks, plain signs; null for lines without a letter or too long."""
    t = F.trim(normalize_unicode(F.translate(c, "_", " ")))
    return F.when(t.rlike(r"\p{L}") & (F.length(t) <= most), t)


def clean_category(c: Column) -> Column:
    """Lower case, blanks for underscores, no locative ending, and no final plural of a multi-word category."""
    t = F.trim(tr_lower(F.translate(c, "_", " ")))
    t = F.regexp_replace(t, r"'?d[ae]ki(?!\p{L})", "")
    t = F.regexp_replace(t, r"ndeki(?!\p{L})", "")
    t = F.trim(F.regexp_replace(t, r"\s{2,}", " "))
    return F.when(F.contains(t, F.lit(" ")), F.trim(F.regexp_replace(t, "(ları|leri)$", ""))).otherwise(t)


def safe_filename(c: Column) -> Column:
    """Only letters, digits, underscores, hyphens and blanks, the blanks as underscores."""
    return F.replace(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\- ]+", "")), F.lit(" "), F.lit("_"))


def split_core(c: Column) -> Column:
    """struct(lead, core, trail): punctuation, letters and digits, punctuation; else the whole as core."""
    p = r"^(\p{P}+)?([\p{L}\p{N}]+)(\p{P}+)?$"
    whole = c.rlike(p)
    g = lambda k: F.regexp_extract(c, p, k)
    return F.struct(
        F.when(whole, g(1)).otherwise("").alias("lead"), F.when(whole, g(2)).otherwise(c).alias("core"), F.when(whole, g(3)).otherwise("").alias("trail")
    )


def edge_strip(c: Column) -> Column:
    """Punctuation at both ends dropped."""
    return F.regexp_replace(c, r"^\p{P}+|\p{P}+$", "")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of case-folded code points."""
    return F.levenshtein(tr_lower(a, "casefold"), tr_lower(b, "casefold"))


def within_edits(a: Column, b: Column, most: int) -> Column:
    """Distance at most ``most``, given up early beyond it."""
    return F.levenshtein(a, b, most) >= 0


def edit_estimate(a: Column, b: Column) -> Column:
    """0, 1 or 2, and 3 for any larger distance."""
    d = F.levenshtein(a, b, 2)
    return F.when(d < 0, 3).otherwise(d)


def diacritic_variants(c: Column, most: int = 64) -> Column:
    """Array of the spellings with any of c, g, o, s, u, i replaced by its marked letter, at most ``most`` of them
    (the cap is the feature: plain letters first, as in a depth-first search)."""
    w = tr_lower(c, "casefold")
    letters = F.split(w, "")

    def step(acc: Column, x: Column) -> Column:
        return F.slice(F.flatten(F.transform(acc, lambda a: F.transform(_options(x), lambda o: F.concat(a, o)))), 1, most)

    return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(F.aggregate(letters, F.array(F.lit("")), step))


def _options(x: Column) -> Column:
    return reduce(lambda e, p: e.when(x == p, F.array(F.lit(p), F.lit(FLIPS[p]))), "gosui", F.when(x == "c", F.array(F.lit("c"), F.lit("ç")))).otherwise(F.array(x))


def flip_variants(c: Column, flips: int) -> Column:
    """Array of the spellings with one or two letters swapped for their marked or plain twins, fewest flips first, then by position."""
    n = F.length(c)
    at = lambda s, i: F.substring(s, i, F.lit(1))
    froms, tos = "".join(FLIPS), "".join(FLIPS.values())
    put = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.translate(at(s, i), froms, tos), F.substring(s, i + 1, n))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: at(c, i).isin(*FLIPS))
    one = F.transform(places, lambda i: put(c, i))
    if flips < 2:
        return one
    two = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: put(put(c, i), j))))
    return F.concat(one, two)


# Slang and number writings.
SLANG = {"2m": "iyim", "mrb": "merhaba", "slm": "selam", "nbr": "ne haber", "kib": "kendine iyi bak"}


def apply_replacements(c: Column) -> Column:
    """$ and @ between letters as s and a, then whole-word slang."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?<=\p{L})\$(?=\p{L})", "s"), r"(?<=\p{L})@(?=\p{L})", "a")
    low = tr_lower(t)
    return reduce(lambda e, kv: e.when(low == kv[0], kv[1]), list(SLANG.items())[1:], F.when(low == "2m", SLANG["2m"])).otherwise(t)


# Shape of the stem, spoken ending, written ending; in order of precedence.
_V = r"\p{L}{3,}?[ıiuü]"
_S = r"\p{L}{3,}?"
ACCENT_RULES = (
    (_V, "yom", "yorum"), (_V, "yon", "yorsun"), (_V, "yosun", "yorsun"), (_V, "yo", "yor"), (_V, "yoz", "yoruz"),
    (_V, "yosunuz", "yorsunuz"), (_V, "yolar", "yorlar"), (r"\p{L}{2,}?", "yolar", "yorlar"),
    (_S, "cem", "ceğim"), (_S, "cam", "cağım"), (_S, "cen", "ceksin"), (_S, "can", "caksın"), (_S, "cek", "ecek"),
    (_S, "cak", "acak"), (_S, "cez", "ceğiz"), (_S, "caz", "cağız"), (_S, "cekler", "ecekler"), (_S, "caklar", "acaklar"),
    (_S, "miycem", "meyeceğim"), (_S, "micem", "mayacağım"), (_S, "miycen", "meyeceksin"), (_S, "mican", "mayacaksın"),
    (_S, "miycek", "meyecek"), (_S, "micak", "mayacak"), (_S, "miycez", "meyeceğiz"), (_S, "micaz", "mayacağız"),
    (r"\p{L}+?", "yiz", "yiz"),
)


def accent_normalize(c: Column) -> Column:
    """The written form of a spoken verb ending (the first rule that changes the word); else a fused question particle
    set apart; else the word."""
    out = None
    for stem, spoken, written in ACCENT_RULES:
        p = rf"(?iu)^({stem}){spoken}$"
        hit, new = c.rlike(p), F.regexp_replace(c, p, "$1" + written)
        cond = hit & (new != c)
        out = F.when(cond, new) if out is None else out.when(cond, new)
    q = r"(?iu)^(.+?)(mi|mı|mu|mü)(n|sun|sunuz|siniz)?$"
    g = lambda k: F.regexp_extract(c, q, k)
    ask = F.concat_ws(" ", F.rtrim(g(1)), F.lower(g(2)), F.when(g(3) != "", F.lower(g(3))))
    return out.when(c.rlike(q) & ~c.contains("’"), ask).otherwise(c)


def restore_vowels(c: Column) -> Column:
    """An e before a run of three or more consonants."""
    return F.regexp_replace(c, r"(?iu)((?<!\p{L})\p{L}{2,}?)([bcçdfgğhjklmnprsştvyz]{3,})(\p{L}*(?!\p{L}))", "$1e$2$3")


def strip_itu_tags(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """@tag[x] to x; tags of ``drop`` with their content removed."""
    for t in drop:
        c = F.regexp_replace(c, rf"(?i)@{t}\[[^\]]*\]", "")
    return F.regexp_replace(c, r"@([A-Za-z_]+)\[([^\]]*)\]", "$2")


def ws_tokens(c: Column) -> Column:
    """Array of the parts between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def letter_runs(c: Column) -> Column:
    """Array of the runs of letters."""
    return F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))


def join_simple(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


# Signs without a blank before, and without one after.
NO_BLANK_BEFORE, NO_BLANK_AFTER = list(".,;:!?%)”’›»…"), list("(%“‘‹«")


def detok(tokens: Column) -> Column:
    """Text of tokens: closing signs and apostrophe endings join the left, what follows an opening sign joins it."""
    seed = F.struct(F.lit("").alias("text"), F.lit("").alias("last"))

    def step(acc: Column, t: Column) -> Column:
        tight = (acc["text"] == "") | t.isin(*NO_BLANK_BEFORE) | t.rlike("^['’]") | acc["last"].isin(*NO_BLANK_AFTER)
        return F.struct(F.concat(acc["text"], F.when(tight, "").otherwise(" "), t).alias("text"), t.alias("last"))

    return F.aggregate(F.filter(tokens, lambda t: t.isNotNull()), seed, step, lambda acc: acc["text"])


def inline_diff(pred: Column, gold: Column) -> Column:
    """Tokens side by side, differing ones as [pred -> gold], missing ones as the empty-set sign."""
    a, b = ws_tokens(pred), ws_tokens(gold)
    no = F.lit("∅")
    both = F.zip_with(
        a, b, lambda p, g: F.when(F.coalesce(p, no) == F.coalesce(g, no), p).otherwise(F.concat(F.lit("["), F.coalesce(p, no), F.lit(" -> "), F.coalesce(g, no), F.lit("]")))
    )
    return F.array_join(both, " ")


def sentence_casing(tokens: Column, raw: Column) -> Column:
    """First token capitalised; later tokens lower case where their raw form started so."""
    return F.transform(
        tokens,
        lambda t, i: F.when(i == 0, tr_upper_first(t)).when(starts_lower(F.get(raw, i)), tr_lower(t)).otherwise(t),
    )
