"""Masks for web addresses, numbers and the like: counted, replaced, or replaced reversibly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns by tag, in the order in which they are applied. Two differ from their usual form for cause: NUMBER
# also keeps off digits and angle brackets, so that the number of a placeholder is never masked again, and EMOJI names
# ranges, as the JVM has no class for pictographs.
URL = r"(?i)\bhttps?://\S+"
EMAIL = r"(?i)\b[\w.\-+%]+@[\w.\-]+\.[A-Za-z]{2,}\b"
NUMBER = r"(?<![\p{L}\p{N}<])\p{N}+(?:[.,]\p{N}+)?(?![\p{L}\p{N}>])"
PATTERNS = {
    "URL": URL,
    "EMAIL": EMAIL,
    "CUR": r"(?<!\p{L})(?:[€$₺£]\s?\p{N}+(?:[.,]\p{N}+)*|\p{N}+(?:[.,]\p{N}+)*\s?[€$₺£])(?!\p{L})",
    "PERC": r"(?<!\p{L})\p{N}+(?:[.,]\p{N}+)?\s?%(?!\p{L})",
    "PHONE": r"(?<!\p{L})(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{3}\)?[\s-]?)\d{3}[\s-]?\d{2}[\s-]?\d{2}(?!\p{L})",
    "DATE": r"(?<!\p{L})(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})(?!\p{L})",
    "USER": r"(?U)(?<!\w)@[\p{L}\p{N}_]{2,32}",
    "HASHTAG": r"(?U)(?<!\w)#[\p{L}\p{N}_]{2,64}",
    "EMOJI": r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}©®]",
    "EMOTICON": r"(?<!\S)(?::-?\)|:-?D|:-?\(|:'\(|;-?\)|:-?P|:-?/|:-?\\|:-?\*|:-?\||:-?O|<3|xD|XD|=\)|=\(|:3)(?!\S)",
    "NUM": NUMBER,
}
# Library patterns.
HASHTAG, MENTION, WHITESPACE = r"#[\p{L}\p{N}_]+", r"@[\p{L}\p{N}_]+", r"\s+"


def mask_plain(c: Column) -> Column:
    """Addresses, mails and numbers as <URL>, <EMAIL> and <NUM>."""
    s = F.regexp_replace(F.regexp_replace(c, URL, "<URL>"), EMAIL, "<EMAIL>")
    return F.regexp_replace(s, NUMBER, "<NUM>")


def counts(c: Column) -> Column:
    """struct of the number of matches by tag, each on the unmasked text."""
    return F.struct(*(F.regexp_count(c, F.lit(p)).alias(t.lower()) for t, p in PATTERNS.items()))


def mask(c: Column) -> Column:
    """struct(text, masks): every match replaced by <TAGn>, n counting over all tags, with array<struct(key, original)>."""
    plain = F.struct(c.alias("text"), F.array().cast("array<struct<key:string,original:string>>").alias("masks"))
    state = plain
    for tag, p in PATTERNS.items():
        state = _mask_one(state, tag, p)
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(_ANY), state).otherwise(plain)


#: Every pattern needs one of these; a text without any is left alone.
_ANY = r"(?i)\p{N}|[@#€$₺£%:;=<©®\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}]|xd"


def _mask_one(state: Column, tag: str, pattern: str) -> Column:
    """One category. The text is cut at its matches and joined again with numbered placeholders."""
    held = F.transform(F.array(state), lambda s: _numbered(s, tag, pattern))  # binds the state once
    return F.element_at(held, 1)


def _numbered(s: Column, tag: str, pattern: str) -> Column:
    found = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))
    before = F.size(s["masks"])
    new = F.transform(
        found, lambda m, i: F.struct(F.concat(F.lit(f"<{tag}"), (before + i + 1).cast("string"), F.lit(">")).alias("key"), m.alias("original"))
    )
    parts = F.split(s["text"], pattern, -1)
    text = F.array_join(F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(F.get(new, i - 1)["key"], x)))), "")
    return F.struct(F.when(F.size(found) == 0, s["text"]).otherwise(text).alias("text"), F.concat(s["masks"], new).alias("masks"))


def unmask(text: Column, masks: Column) -> Column:
    """The text with its placeholders replaced by the originals, last placeholder first."""
    return F.aggregate(F.reverse(masks), text, lambda acc, m: F.replace(acc, m["key"], m["original"]))
