import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from dokuma.functions import chars, masks


def values(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_case(spark):
    xs = ["IĞDIR İzmir ŞÖÇÜ", "", None, "123"]
    assert values(spark, chars.tr_lower, xs) == ["ığdır izmir şöçü", "", None, "123"]
    assert values(spark, lambda c: chars.tr_lower(c, compat=True), ["Ğ"]) == ["g"]
    assert values(spark, lambda c: chars.tr_lower(c, "casefold"), ["Straße İ"]) == ["strasse i"]
    assert values(spark, chars.tr_upper_first, ["ığdır", "izmir", "'güzel", "12", "", None]) == ["Iğdır", "İzmir", "'Güzel", "12", "", None]


def test_unicode(spark):
    xs = ["ﬁ “a” – b… c​", "düz", None, ""]
    assert values(spark, chars.normalize_unicode, xs) == ['fi "a" - b... c', "düz", None, ""]
    assert values(spark, chars.clean, ["  a　 b\t\nc ", None]) == ["a b c", None]


def test_runs_and_spacing(spark):
    assert values(spark, chars.shrink_runs, ["çoook", "AaAa", "aab", ""]) == ["çook", "AA", "aab", ""]
    assert values(spark, lambda c: chars.shrink_repetitions_to(c, 1), ["çoook"]) == ["çok"]
    assert values(spark, lambda c: chars.shrink_repetitions_to(c, 2), ["geldiiii de"]) == ["geldi de"]
    assert values(spark, chars.fix_spacing, ["a,b . c 'de ...d", 'x."y']) == ["a, b . c'de ... d", 'x."y']
    assert values(spark, lambda c: chars.fix_spacing(c, False), ["a...b"]) == ["a. .. b"]


def test_shapes(spark):
    xs = ["ABD", "Ankara", "ankara", "12", "aB", "", None]
    assert values(spark, chars.is_acronym, xs) == [True, False, False, False, False, False, None]
    assert values(spark, chars.is_proper_case, xs) == [False, True, False, False, False, False, None]
    assert values(spark, chars.is_all_lower, xs) == [False, False, True, True, False, True, None]
    assert values(spark, chars.starts_lower, xs) == [False, False, True, False, True, False, None]
    assert values(spark, chars.char_category, ["a", "1", " ", ".", "+", "<BOS>"]) == ["L", "D", "WS", "P", "O", "<BOS>"]


def test_words(spark):
    assert values(spark, chars.final_devoicer, ["kitab", "ağac", "renğ", "ev", ""]) == ["kitap", "ağaç", "renk", "ev", ""]
    assert values(spark, chars.clean_title, ["Ada (film)", "Ada"]) == ["Ada", "Ada"]
    assert values(spark, chars.clean_category, ["Türkiye'deki_dağları", "iller", "Adana_ilçeleri"]) == ["türkiye dağ", "iller", "adana ilçe"]
    assert values(spark, lambda c: chars.split_core(c)["core"], ["(ev),", "a-b", ""]) == ["ev", "a-b", ""]
    assert values(spark, chars.edge_strip, ["«ev».", "..."]) == ["ev", ""]
    assert values(spark, chars.normalize_title_line, ["Mavi_Ev", "___", "x" * 201]) == ["Mavi Ev", None, None]


def brute_variants(w):
    return ["".join(x) for x in itertools.product(*[(c, chars.FLIPS[c]) if c in "cgosui" else (c,) for c in w])][:64]


def test_variants(spark):
    for w in ["sic", "ogrenci", "k"]:
        assert values(spark, chars.diacritic_variants, [w])[0] == brute_variants(w)
    got = values(spark, lambda c: chars.flip_variants(c, 2), ["sis"])[0]
    assert got == ["şis", "sıs", "siş", "şıs", "şiş", "sış"]
    assert values(spark, lambda c: chars.flip_variants(c, 2), ["", "km"]) == [[], []]


def test_distances(spark):
    df = spark.createDataFrame([("şiş", "sis"), ("ev", "ev"), ("abcdef", "x")], "a string, b string")
    r = df.select(chars.edit_distance(F.col("a"), F.col("b")), chars.within_edits(F.col("a"), F.col("b"), 1), chars.edit_estimate(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in r] == [(2, False, 2), (0, True, 0), (6, False, 3)]


def test_spoken(spark):
    assert values(spark, chars.accent_normalize, ["geliyom", "yapıyosun", "gelcem", "ev", "geliyormu"]) == ["geliyorum", "yapıyorsun", "gelceğim", "ev", "geliyor mu"]
    assert values(spark, chars.apply_replacements, ["mrb", "a@b", "ka$a", "@b"]) == ["merhaba", "aab", "kasa", "@b"]
    assert values(spark, chars.restore_vowels, ["gldim", "slm"])[0] != ""


def test_tags_and_joins(spark):
    assert values(spark, chars.strip_itu_tags, ["@mention[ali] @smiley[:)]"]) == ["ali :)"]
    assert values(spark, lambda c: chars.strip_itu_tags(c, ("url",)), ["@url[x]a"]) == ["a"]
    df = spark.createDataFrame([(["Ev", ",", "(", "bir", ")", "'de", "."],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(chars.detok(F.col("t"))).collect()] == ["Ev, (bir)'de.", "", None]
    df = spark.createDataFrame([("Şafak gelecek şiştii", "şafak gelecek şişti"), ("a", "a b")], "p string, g string")
    assert [r[0] for r in df.select(chars.inline_diff(F.col("p"), F.col("g"))).collect()] == ["[Şafak -> şafak] gelecek [şiştii -> şişti]", "a [∅ -> b]"]


def test_masks(spark):
    xs = ["ara 0532 123 45 67 ya da a@b.com, %5 ve 12 TL", "http://x.y/z @ali #gün 😀 :) 1 2 3 4 5 6 7 8 9 10 11 12", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").withColumn("m", masks.mask(F.col("x")))
    rows = df.orderBy("i").select("m", masks.unmask(F.col("m.text"), F.col("m.masks"))).collect()
    assert [r[1] for r in rows] == xs
    assert "a@b.com" not in rows[0][0]["text"] and "<EMAIL" in rows[0][0]["text"]
    assert "<URL1>" in rows[1][0]["text"] and "<USER" in rows[1][0]["text"]


def test_unicode_is_stable(spark):
    xs = ["Çağ", "é", "İ"]
    assert values(spark, chars.normalize_unicode, xs) == [unicodedata.normalize("NFC", x) for x in xs]


@pytest.mark.parametrize("f", [chars.tr_lower, chars.tr_upper_first, chars.sanitize, chars.compact_ws, chars.fix_spacing, chars.shrink_runs, chars.strip_diacritics, chars.accent_normalize, chars.safe_filename])
def test_null_and_empty(spark, f):
    assert values(spark, f, [None, ""]) == [None, ""]
    long = "aB, " * 50_000
    assert len(values(spark, f, [long])[0]) > 0
