"""Problem 4: find personal data in free text and replace it by typed placeholders.

Method: information-theoretic sanitisation. E-mail addresses, phone and identity numbers and addresses have a form of
their own. A name hasn't: its words are ordinary strings, often in lower case and often common nouns. So one pass over
the corpus counts each term's occurrences and its co-occurrences with protected slots (beside a first name, an initial
or a form of address). A term is disclosing, and the span it stands in is replaced, if the slot explains most of its
occurrences (pointwise mutual information above a threshold) and several different neighbours do (a term that follows
one name only, as in a fixed phrase, tells nothing). Rare terms fall back to the statistics of their endings.
The listed first names are only where this begins: a word outside the list becomes a first name if the corpus mostly has it
in front of terms found disclosing, and of several different ones, and such pairs are found as well.
Equal texts are counted once, and rarity is a number of different contexts, so copies change nothing.

Spans refer to the stored text; nothing but the spans is changed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import textfold
from .confusables import FIELDS, fields
from .pairs import wanted

LEAST_SHARE = 0.5  # of a term's occurrences that the slot explains
LEAST_BITS = 1.0  # pointwise mutual information with the slot
RARE = 3  # different contexts of a term that its neighbour alone may disclose
LEAST_CUES = 2  # different neighbours that show the term in the slot
ENDING = 5
PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "identity": "<IDENTITY>", "address": "<ADDRESS>", "name": "<NAME>"}

# Common first names, folded.
FIRST_NAMES = frozenset(
    "adem ahmet akin ali alper anil arda arzu asli asude asuman ata atilla aydin ayhan ayla ayse aysun aziz bahar baris basak "
    "baran batuhan begum bekir belgin beren berk berkay berna berrin betul beyza bilal bilge bora bulent burak burcu "
    "busra cagla caglar can canan cansu celal cem cemal cemil cengiz ceren ceyda cigdem cihan cinar damla defne deniz "
    "derya devrim dilek dilara duygu ebru ece ecem efe ege ekin ela elif emel emin emine emrah emre engin enes eray ercan "
    "erdem eren erhan erkan erol ersin esin esra eylul fatih fatma ferhat feride figen filiz firat furkan gamze gizem gokce "
    "gokhan gonca gonul gul gulay gulce gulsen gunes hakan hale halil haluk hande harun hasan hatice hazal hilal hulya "
    "huseyin ibrahim ilayda ilhan ilker ilknur inci ipek irem irmak ismail kaan kadir kemal kenan kerem koray levent leyla "
    "mehmet melek melis meltem mert merve mesut metin mine murat mustafa nazli necla nehir nermin nesrin nihal nil nilay "
    "nilgun nuray nurcan oguz okan onur orhan osman oya ozan ozge ozgur ozlem pelin pinar polat ramazan recep ruzgar sedat "
    "seda selcuk selim selin selma sema semih serap serdar serkan sevgi sevil sibel sinan sinem songul suat sule "
    "suleyman tahir taner tarik tolga tugba tulin tuna turgut ufuk ugur ulku umit umut utku veli volkan yagmur yasemin "
    "yasin yavuz yeliz yesim yildiz yigit yusuf zafer zehra zeynep".split()
)
# Forms of address before and after a name, folded.
BEFORE = frozenset("bay bayan sayin sn dr doc prof av muh".split())
AFTER = frozenset("bey beyin beye beyi beyle beyden beyefendi hanim hanimin hanima hanimi hanimla hanimdan hanimefendi".split())
# Words before a number that is no personal one, and before an identity number, folded.
OTHER_NUMBER = re.compile(r"(?:siparis|kargo|takip|isbn|surum|fatura|fiyat|kodu|barkod|seri|dosya|karar|esas|cilt|sayfa|versiyon|model)\W*(?:no|nosu|numarasi|kodu|kod)?\W*$")
IDENTITY_CUE = re.compile(r"(?:t\W?c\W{0,2}(?:kimlik)?\W*(?:no|nosu|numara[a-z]*)?|kimli[a-z]*(?:\W*(?:no|nosu|numara[a-z]*))?|tckn|pasaport[a-z]*(?:\W*(?:no|kimlik|numara[a-z]*))*)\W{0,4}$")
PHONE_CUE = re.compile(r"(?:tel|telefon[a-z]*|cep|gsm|numara[a-z]*|whatsapp(?: hatti)?|ara beni|ara|faks|iletisim)\W*$")

_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|et)\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|nokta)\s?[\])}]\s?)"
EMAIL = re.compile(
    rf"(?:mailto:)?(?<![a-z0-9._%+\-])[a-z0-9_][a-z0-9._%+\-]{{0,63}}(?:{_AT}[a-z0-9\-]{{1,63}}(?:{_DOT}[a-z0-9\-]{{2,63}})+"
    rf"| (?:at|kuyruklu a) [a-z0-9\-]{{2,63}}(?: (?:dot|nokta) [a-z]{{2,63}})+)"
)
MAY_MAIL = re.compile(r"@|at|[\[({]\s?et\s?[\])}]|kuyruklu a")  # every sign that EMAIL asks for
NUMBER = re.compile(r"(?<![a-z0-9.])(?:[+(]{0,2}|[a-z](?=\d{7,9}(?!\.?\d)))\d(?:[ .\-/()]{0,2}\d){6,15}(?![0-9]|[a-z])")
_STREET = r"(?:sokak|sokagi|sokagin|sok|sk|cadde|caddesi|cad|cd|bulvar|bulvari|blv|bulv|mahalle|mahallesi|mah|mh|mahallesinde|sokaginda|caddesinde)"
_NUM = r"(?:no|numara|nu|kapi)?\W{0,3}\d{1,4}(?:\W?/\W?[0-9a-z]{1,3})?(?![0-9]|\.\d)"
ADDRESS = re.compile(
    rf"(?:[a-z]{{2,}}\s){{0,1}}(?<![a-z])[a-z]{{2,}} {_STREET}(?![a-z])[.,]{{0,2}} {{0,2}}{_NUM}(?! ?(?:metre|km|kisi|adet|yil|lira|tl|numarali|kez|kere|gun)\b)"
    rf"|(?<![0-9a-z.,])\d{{1,4}}(?:/[0-9a-z]{{1,3}})? (?!numarali|nolu|metre|kisi|adet|yil|lira|gun)[a-z]{{3,}} (?:sokak|sokagi|sok|sk|cadde|caddesi|cad|cd|bulvar|bulvari)(?![a-z])(?! (?:boyunca|lambalari|kopek))"
    rf"|(?<![a-z])[a-z0-9] ?blok\W{{0,3}}(?:kat\W{{0,3}}\d{{1,3}}\W{{0,3}})?(?:daire|d|no)\W{{0,3}}\d{{1,4}}|(?<![a-z0-9])\d{{1,4}}\.? ?blok\W{{0,3}}(?:kat\W{{0,3}}\d{{1,3}}\W{{0,3}})?(?:daire|d|no)\W{{0,3}}\d{{1,4}}"
)
_WORD = re.compile(r"[a-z]+")
_GAP = re.compile(r"\.? +")


class _View(dict):
    """For str.translate: letters folded to ASCII, digits and signs in their plain form, all spaces one kind."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if c.isascii():
            r = c.lower() if not c.isspace() else " "
        elif c.isspace():
            r = " "
        else:
            r = textfold.FOLD[cp]
            if r == " ":
                plain = unicodedata.normalize("NFKD", c)
                r = plain if plain.isascii() and len(plain) == 1 else ("'" if c in textfold.APOSTROPHES else " ")
            elif c in textfold.APOSTROPHES:
                r = "'"
        self[cp] = r
        return r


_VIEW = _View()


def _offsets(text: str) -> list[int]:
    """For each character of the view the index of its character in the text, and the end."""
    out = []
    for i, c in enumerate(text):
        out += [i] * len(_VIEW[ord(c)])
    out.append(len(text))
    return out


def _number_type(view: str, m: re.Match) -> str | None:
    span, before = m[0], view[max(0, m.start() - 40) : m.start()]
    d = re.sub(r"\D", "", span)
    if OTHER_NUMBER.search(before):
        return None
    cue = IDENTITY_CUE.search(before)
    if span[0].isalpha():
        return "identity" if len(d) == 8 or cue else None
    if re.fullmatch(r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}(?: .*)?", span) and not cue:
        return None
    if "+" in span and 9 <= len(d) <= 15:
        return "phone"
    if cue and 8 <= len(d) <= 12:
        return "identity"
    if d[:2] == "00" and 11 <= len(d) <= 16:
        return "phone"
    if d[0] == "0" and len(d) == 11 and d[1] in "23458":
        return "phone"
    if d[:2] == "90" and len(d) == 12 and d[2] in "2345":
        return "phone"
    if len(d) == 10 and d[0] in "2345":
        groups = [len(g) for g in re.findall(r"\d+", span)]
        if groups in ([3, 3, 4], [3, 3, 2, 2], [3, 7]) or all(g == 1 for g in groups):
            return "phone"
        return "phone" if PHONE_CUE.search(before) else None
    if len(d) == 11 and d[0] != "0":
        groups = [len(g) for g in re.findall(r"\d+", span)]
        if groups in ([11], [3, 3, 3, 2], [5, 6], [1] * 11, [3, 3, 5], [2, 3, 3, 3], [3, 4, 4], [4, 4, 3]):
            return "identity"
    return None


def spans(text: str, count: Counter | None = None) -> list[tuple[str, int, int, str | None, str | None]]:
    """(type, start, end, term, cue) of a text. Only names have a term, whose statistics decide, unless certain (None)."""
    view = text.translate(_VIEW)
    out: list[tuple[str, int, int, str | None, str | None]] = []
    masked = view
    if MAY_MAIL.search(view):
        for m in EMAIL.finditer(view):
            out.append(("email", m.start(), m.end(), None, None))
            masked = masked[: m.start()] + "\x00" * (m.end() - m.start()) + masked[m.end() :]
    if any(map(str.isdigit, masked)):
        for m in NUMBER.finditer(masked):
            kind = _number_type(masked, m)
            if kind:
                out.append((kind, m.start(), m.end(), None, None))
        for m in ADDRESS.finditer(masked):
            out.append(("address", m.start(), m.end(), None, None))
    ws = [(m[0], m.start(), m.end()) for m in _WORD.finditer(masked)]
    if count is not None:
        count.update(w for w, _, _ in ws)
    n = len(ws)
    offsets = None

    def near(i: int, j: int) -> bool:  # words i and j are separated by blanks only
        return masked[ws[i][2] : ws[j][1]].isspace()

    def upper(k: int) -> bool:
        nonlocal offsets
        offsets = offsets or _offsets(text)
        return text[offsets[ws[k][1]]].isupper()

    for i in range(n):
        w, s, e = ws[i]
        if w in FIRST_NAMES:
            j = i + 1
            while j < n and ws[j][0] in FIRST_NAMES and near(j - 1, j):
                j += 1
            if j < n and near(j - 1, j) and i + 1 <= j:
                t = ws[j][0]
                if t in AFTER:
                    out.append(("name", s, ws[j][2], None, None))
                elif len(t) > 2 and t not in BEFORE:
                    out.append(("name", s, ws[j][2], t, w if j == i + 1 else ws[j - 1][0]))
            if i and masked[ws[i - 1][2] : s].strip() == "," and len(ws[i - 1][0]) > 2:
                out.append(("name", ws[i - 1][1], e, ws[i - 1][0], w + ","))
            if i and ws[i - 1][0] in BEFORE and _GAP.fullmatch(masked, ws[i - 1][2], s):
                out.append(("name", ws[i - 1][1], e, None, None))
        elif w in BEFORE and i + 1 < n and _GAP.fullmatch(masked, e, ws[i + 1][1]):
            t = ws[i + 1][0]
            if len(t) > 2 and t not in FIRST_NAMES:
                out.append(("name", s, ws[i + 1][2], t, w))
        elif w in AFTER and i and near(i - 1, i) and len(ws[i - 1][0]) > 2 and ws[i - 1][0] not in FIRST_NAMES:
            out.append(("name", ws[i - 1][1], e, ws[i - 1][0], w))
        elif len(w) == 1 and i + 1 < n and len(ws[i + 1][0]) > 3 and re.fullmatch(r"\. ?", masked[e : ws[i + 1][1]]) and (not s or not masked[s - 1].isalnum() and masked[s - 1] != "."):
            out.append(("name", s, ws[i + 1][2], ws[i + 1][0], w + "."))
        elif len(w) > 2 and i + 1 < n and len(ws[i + 1][0]) > 3 and ws[i + 1][0] not in FIRST_NAMES and near(i, i + 1) and upper(i + 1) and upper(i):
            out.append(("name", s, ws[i + 1][2], ws[i + 1][0], "?"))  # two capitalised words: no cue of its own
    if not out:
        return out
    offsets = offsets or _offsets(text)
    return [(k, offsets[s], offsets[e - 1] + 1, t, c) for k, s, e, t, c in out]


def _context(text: str, start: int, stop: int, cue: str | None) -> int:
    """Hash of what a span stands beside: the word before, its cue, the word after."""
    before = _WORD.findall(text[max(0, start - 40) : start].translate(_VIEW))[-1:]
    after = _WORD.findall(text[stop : stop + 40].translate(_VIEW))[:1]
    return xxhash.xxh64_intdigest(f"{before}{cue}{after}") - (1 << 63)


_ROW = "cls binary, pii_type string, start int, stop int, term string, cue string, context long, n long"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of every text, and the partition's term counts (rows without cls)."""
    count: Counter = Counter()
    columns = ["cls", "pii_type", "start", "stop", "term", "cue", "context", "n"]
    types = {"start": "Int32", "stop": "Int32", "context": "Int64"}

    def counted() -> pd.DataFrame:
        rows = [(None, None, None, None, t, None, None, n) for t, n in count.items()]
        count.clear()
        return pd.DataFrame(rows, columns=columns).astype(types)

    for pdf in batches:
        rows = []
        for i, t in zip(pdf["cls"], pdf["text"]):
            rows += [(i, k, s, e, w, c, _context(t, s, e, c) if w else None, 1) for k, s, e, w, c in spans(t, count)]
        yield pd.DataFrame(rows, columns=columns).astype(types)
        if len(count) > 200_000:
            yield counted()
    yield counted()


def _disclosing(scan: DataFrame) -> DataFrame:
    """Terms whose place in a name discloses a person: term and ending statistics over all different texts of the corpus."""
    seen = scan.where("cls is not null and pii_type = 'name' and term is not null")
    cue = F.when(F.col("cue") != "?", F.col("cue"))  # capitals alone are no neighbour
    slots = seen.groupBy("term").agg(F.sum("n").alias("k"), F.countDistinct(cue).alias("cues"), F.countDistinct("context").alias("contexts"))
    totals = scan.where("cls is null").groupBy("term").agg(F.sum("n").alias("n"))
    ending = F.substring("term", -ENDING, ENDING).alias("ending")
    sums = totals.agg(F.sum("n").alias("words")).collect()[0]["words"] or 0
    held = slots.agg(F.sum("k").alias("k")).collect()[0]["k"] or 0
    prior = max(held, 1) / max(sums, 1)  # chance that any word stands in a slot
    bits = lambda k, n: F.log2((k / n) / F.lit(prior))
    terms = slots.join(totals, "term").withColumn("ending", ending)
    own = (F.col("k") / F.col("n") >= LEAST_SHARE) & (bits(F.col("k"), F.col("n")) >= LEAST_BITS) & (F.col("cues") >= LEAST_CUES)
    ends = totals.groupBy(ending).agg(F.sum("n").alias("en")).join(
        seen.groupBy(ending).agg(F.sum("n").alias("ek"), F.countDistinct(cue).alias("ecues"), F.countDistinct("term").alias("eterms")), "ending"
    )
    shared = (F.col("ek") / F.col("en") >= 0.7) & (bits(F.col("ek"), F.col("en")) >= LEAST_BITS) & (F.col("ecues") >= 3) & (F.col("eterms") >= 2)
    judged = terms.join(ends, "ending", "left")
    kept = judged.where(own | (shared & (F.col("k") / F.col("n") >= LEAST_SHARE))).select("term")
    # a rare term is disclosed by a neighbour that itself stands almost only beside disclosing terms
    beside = seen.where("cue <> '?'").select("cue", "term", "context").distinct().join(kept.withColumn("kept", F.lit(1)), "term", "left").groupBy("cue").agg(F.count("*").alias("all"), F.sum("kept").alias("good"))
    reliable = beside.where("good >= 5 and good >= 0.6 * all").select("cue")
    rare = judged.where(f"contexts <= {RARE} and k = n").select("term")
    by_cue = seen.join(rare, "term", "left_semi").join(reliable, "cue", "left_semi").select("term")
    return kept.unionByName(by_cue).distinct()


_TURKISH, _ASCII = "İIıÇçĞğÖöŞşÜüÂâÎîÛû", "iiiccggoossuuaaiiuu"


def _neighbours(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """cls, first, last of the different pairs of words, blanks between them, whose second one is disclosing. Rows are read
    as they are; only what such a term makes of them is shuffled."""
    view = F.lower(F.translate("text", _TURKISH, _ASCII))
    pairs = F.regexp_extract_all(view, F.lit("(?<![a-z])(?=([a-z]{3,} {1,3}[a-z]{4,})(?![a-z]))"), F.lit(1))
    p = rows.select("cls", F.explode(pairs).alias("p"))
    p = p.select("cls", F.substring_index("p", " ", 1).alias("first"), F.substring_index("p", " ", -1).alias("last"))
    p = p.where(~F.col("first").isin(*sorted(FIRST_NAMES | BEFORE | AFTER)) & ~F.col("last").isin(*sorted(AFTER)))
    last = terms.select(F.col("term").alias("last"))
    return wanted(p, "last", last, "last").join(last, "last").distinct()


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the given pairs in their texts."""
    for pdf in batches:
        rows = []
        for c, t, first, last in zip(pdf["cls"], pdf["text"], pdf["first"], pdf["last"]):
            view, offsets = t.translate(_VIEW), _offsets(t)
            for m in re.finditer(rf"(?<![a-z]){first} +{last}(?![a-z])", view):
                rows.append((c, "name", offsets[m.start()], offsets[m.end() - 1] + 1))
        yield pd.DataFrame(rows, columns=["cls", "pii_type", "start", "stop"])


def _learned(rows: DataFrame, scan: DataFrame, terms: DataFrame) -> DataFrame:
    """cls, pii_type, start, stop of names whose first name is in no list: a word that mostly stands before disclosing
    terms (LEAST_SHARE, LEAST_BITS), and before several different ones (LEAST_CUES)."""
    p = checkpointed(_neighbours(rows, terms))
    g = p.groupBy("first").agg(F.count("*").alias("k"), F.countDistinct("last").alias("lasts")).where(F.col("lasts") >= LEAST_CUES)
    totals = scan.where("cls is null").groupBy(F.col("term").alias("first")).agg(F.sum("n").alias("n"))
    words = scan.where("cls is null").agg(F.sum("n")).collect()[0][0] or 0
    held = g.agg(F.sum("k")).collect()[0][0] or 0
    j = g.join(totals, "first")
    bits = F.log2((F.col("k") / F.col("n")) / F.lit(max(held, 1) / max(words, 1)))
    names = j.where((F.col("k") / F.col("n") >= LEAST_SHARE) & (bits >= LEAST_BITS)).select("first")
    hits = checkpointed(p.join(names, "first").select("cls", "first", "last"))
    schema = "cls binary, pii_type string, start int, stop int"
    if hits.isEmpty():
        return scan.sparkSession.createDataFrame([], schema)
    return hits.join(rows, "cls").select("cls", "text", "first", "last").mapInPandas(_locate, schema)


def detected(examples: DataFrame) -> DataFrame:
    """ex_id, field_name, pii_type, start, stop of every accepted span. Null and empty fields hold none."""
    f = fields(examples, names=FIELDS)
    cls = F.unhex(F.md5("text"))  # equal texts are read and counted once, however often they were loaded
    scan = checkpointed(f.select("text").distinct().select(cls.alias("cls"), "text").mapInPandas(_scan, _ROW))
    held = scan.where("cls is not null")
    terms = checkpointed(_disclosing(scan))
    columns = ["cls", "pii_type", "start", "stop"]
    s = held.where("term is null").select(*columns).unionByName(held.where("term is not null").join(terms, "term").select(*columns))
    s = s.unionByName(_learned(f.select(cls.alias("cls"), "text"), scan, terms)).distinct()
    return f.select("ex_id", "field_name", cls.alias("cls")).join(s, "cls").select("ex_id", "field_name", "pii_type", "start", "stop")


def found(examples: DataFrame) -> DataFrame:
    return detected(examples).select("ex_id", "field_name", "pii_type").distinct()


def redacted(examples: DataFrame) -> DataFrame:
    """Every field with its spans replaced by typed placeholders; overlapping spans become one, of the leftmost's type."""
    held = detected(examples).groupBy("ex_id", "field_name").agg(
        F.sort_array(F.collect_set(F.struct("start", F.negate("stop").alias("back"), "pii_type"))).alias("spans")
    )
    placeholder = " ".join(f"when s.pii_type = '{k}' then '{v}'" for k, v in PLACEHOLDERS.items())
    done = F.expr(
        f"""aggregate(spans, struct('' as done, 0 as at), (acc, s) ->
            if(s.start < acc.at, struct(acc.done as done, greatest(acc.at, -s.back) as at),
               struct(concat(acc.done, substring(text, acc.at + 1, s.start - acc.at), case {placeholder} end) as done, -s.back as at)),
            acc -> concat(acc.done, substring(text, acc.at + 1)))"""
    )
    f = fields(examples).join(held, ["ex_id", "field_name"], "left")
    return f.select("ex_id", "field_name", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("spans"))
