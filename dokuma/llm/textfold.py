"""Folding of look-alike, accented and cased text to one comparable form.

Two results are offered: ``canonical`` keeps the text readable (the usual typing of it), ``words`` gives the
case-, accent- and punctuation-free words that comparisons use.
"""

from __future__ import annotations

import re
import unicodedata

# Prototypes of letters that look like Latin letters (natural order of the scripts).
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "в": "b", "г": "r", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ь": "b", "ѵ": "v", "ґ": "r",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "ı", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "σ": "o", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Հ": "H", "Լ": "L", "Օ": "O", "Ս": "U", "Տ": "S", "ա": "w", "գ": "q", "զ": "q", "հ": "h", "յ": "j", "ո": "n",
    "ռ": "n", "ս": "u", "ց": "g", "օ": "o", "ք": "f", "ղ": "n", "ւ": "ı",
    # Latin letters beside the usual alphabet
    "ɑ": "a", "ɒ": "a", "ʙ": "B", "ᴄ": "c", "ɗ": "d", "ɡ": "g", "ɢ": "G", "ʜ": "H", "ɩ": "ı", "ɪ": "ı", "ᴋ": "k",
    "ʟ": "L", "ᴍ": "m", "ɴ": "N", "ᴏ": "o", "ᴘ": "p", "ʀ": "R", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ʋ": "v", "ᴠ": "v",
    "ᴡ": "w", "ʏ": "Y", "ᴢ": "z", "ƅ": "b", "ƈ": "c", "ƙ": "k", "ƴ": "y",
    # letters that Turkish writes with another mark
    "ș": "ş", "Ș": "Ş", "ț": "t", "Ț": "T", "ǧ": "ğ", "Ǧ": "Ğ", "ǵ": "ğ", "ģ": "ğ", "Ģ": "Ğ", "ĝ": "ğ", "Ĝ": "Ğ",
    "ŝ": "ş", "Ŝ": "Ş", "ĉ": "ç", "Ĉ": "Ç", "ŏ": "ö", "Ŏ": "Ö", "ŭ": "ü", "Ŭ": "Ü", "ǐ": "i",
}
APOSTROPHES = "'’‘ʼʹ`´＇′"
#: Compatibility characters that look different from their plain form and therefore stay.
DIFFERENT_LOOK = {"<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<noBreak>"}
USUAL = "a-zA-Z0-9çğıöşüÇĞİÖŞÜâîûÂÎÛ"
#: A text without such a character needs no change at all; the same class prefilters rows inside the JVM.
SUSPECT = r"[^\x00-\x7FçğıöşüÇĞİÖŞÜâîûÂÎÛ“”‘’«»„–—…•°€₺²³½¼¾×]"
_SUSPECT = re.compile(SUSPECT)
_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufeff])*")
_EMOJI = r"[\U0001F000-\U0001FAFF←-➿⬀-⯿〰〽㊗㊙©®0-9#*]"
#: Inside emoji: selectors after a symbol, joiners between symbols, tags of flags.
_EMOJI_GLUE = re.compile(
    rf"(?<={_EMOJI})[\ufe0e\ufe0f](?:\u200d(?={_EMOJI}))?|(?<=[\U0001F3FB-\U0001F3FF])\u200d(?={_EMOJI})"
    rf"|(?<=[\U0001F000-\U0001FAFF←-➿⬀-⯿])\u200d(?={_EMOJI})|(?<=[\U0001F3F4\U000E0020-\U000E007E])[\U000E0020-\U000E007F]"
)
_MARKS = re.compile(r"([^\W\d_])([\u0300-\u036f]+)")


def _script(ch: str) -> str:
    if ch.isascii():
        return "LATIN"
    return unicodedata.name(ch, "?").split(" ", 1)[0]


def _plain(ch: str) -> str:
    """The decomposed prototype of a character that only looks alike, else the character itself.

    Letters of the Latin script come apart into letter and marks. Signs that are another spelling of one (Kelvin, Angstrom,
    the Greek question mark) become it; compatibility forms (wide, styled, joined letters, Roman numerals) become plain.
    """
    apart = unicodedata.normalize("NFD", ch)
    if apart != ch:
        return apart if apart[0].isascii() or _script(apart[0]) == "LATIN" else ch
    kind = unicodedata.decomposition(ch).split(" ", 1)[0]
    if not kind.startswith("<") or kind in DIFFERENT_LOOK:
        return ch
    plain = unicodedata.normalize("NFKC", ch)
    if kind == "<compat>":  # letters and wide spaces only; not the ellipsis or signs
        if not (plain.isalpha() and _script(ch) in ("LATIN", "ROMAN", "SMALL")):
            return ch
    if kind == "<font>" and _script(plain[:1]) == "GREEK":
        return ch
    return unicodedata.normalize("NFD", plain)


def _compose(m: re.Match) -> str:
    base, marks = m[1], m[2]
    if base in "iı" and marks[0] == "\u0307":
        return "i" + marks[1:]
    whole = unicodedata.normalize("NFC", base + marks)
    for i, c in enumerate(whole):
        if unicodedata.combining(c):
            return whole[:i].translate(_OTHER_MARKS)
    return whole.translate(_OTHER_MARKS)


_OTHER_MARKS = {ord(k): v for k, v in LOOKALIKES.items() if k in "șȘțȚǧǦǵģĢĝĜŝŜĉĈŏŎŭŬǐ"}


def _word_letters(m: re.Match) -> str:
    """Look-alikes of other scripts are replaced unless the whole word is in another script."""
    w = m[0]
    if w.isascii():
        return w
    latin = foreign = False
    for c in w:
        if c.isalpha():
            if _script(c) in ("LATIN", "FULLWIDTH"):
                latin = True
            else:
                foreign = True
    if foreign and not latin:
        return w
    return "".join(LOOKALIKES.get(c, c) for c in w)


def _apart(s: str) -> str:
    return s if s.isascii() else "".join(c if c.isascii() else _plain(c) for c in s)


def skeleton(text: str) -> str:
    """The text decomposed, every character replaced by its prototype, and decomposed again.

    Texts that look alike have the same skeleton. Unchanged stay words wholly in another script, joiners and selectors
    inside emoji, raised digits, fractions, typographic quotes and dashes, circumflex letters, tabs and line breaks.
    """
    keep = {m.start() + i for m in _EMOJI_GLUE.finditer(text) for i in range(len(m[0]))} if re.search("[\u200d\ufe0e\ufe0f\U000E0020]", text) else ()
    out = []
    for i, c in enumerate(text):
        if c.isascii() or i in keep:
            out.append(c)
            continue
        cat = unicodedata.category(c)
        if cat == "Cf" or "\ufe00" <= c <= "\ufe0f" or c in "\u034f\u115f\u1160\u3164\uffa0":
            continue
        if cat == "Zs" or c in "\u2028\u2029\x85":
            out.append(" ")
            continue
        out.append(_plain(c))
    s = "".join(out)
    for _ in range(4):  # a replaced letter may take another mark
        t = _apart(_WORD.sub(_word_letters, _MARKS.sub(_compose, s)))
        if t == s:
            break
        s = t
    return s


def canonical(text: str) -> str:
    """The usual typing of a text: its skeleton, composed. The result is a fixed point."""
    return _MARKS.sub(_compose, skeleton(text)) if _SUSPECT.search(text) else text


def needs_change(text: str) -> bool:
    return canonical(text) != text


class _Fold(dict):
    """For str.translate: code point to its folded text, computed once for each code point that occurs."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if c in APOSTROPHES:
            r = ""
        elif unicodedata.category(c) in ("Cf", "Mn", "Me") or "\ufe00" <= c <= "\ufe0f":
            r = ""
        else:
            r = ""
            for d in unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)):
                if unicodedata.combining(d):
                    continue
                d = LOOKALIKES.get(d, d)
                for e in unicodedata.normalize("NFKD", d).casefold():
                    if e == "ı":
                        r += "i"
                    elif unicodedata.combining(e):
                        continue
                    else:
                        r += e if e.isalnum() else " "
        self[cp] = r
        return r


FOLD = _Fold()


def fold(text: str) -> str:
    return text.translate(FOLD)


def words(text: str | None) -> list[str]:
    """Folded words; null gives none."""
    return text.translate(FOLD).split() if text else []
