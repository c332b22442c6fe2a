import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dokuma.functions import chars
from dokuma.operators import corpus, evaluate, features, graph, normalize, records, sentences, stem, tokenize


def one(spark, f, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x"))).collect()[0][0]


# tokens


@pytest.mark.parametrize(
    "text, tokens",
    [("Merhaba dünya!", ["Merhaba", "dünya", "!"]), ("1,5 ve 3.2, tamam...", ["1,5", "ve", "3.2,", "tamam", "..."]), ("(ev) \"a\"", ["(", "ev", ")", '"', "a", '"']),
     ("ağlayacaktı", ["ağlayacak", "tı"]), ("şöyleydi", ["şöyle", "ydi"]), ("girebilirdik", ["girebilir", "dik"]), ("böyledir", ["böyle", "dir"]), ("", []), (None, None)],
)
def test_rule_tokens(spark, text, tokens):
    assert one(spark, tokenize.rule_tokens, text) == tokens


def test_iwt_tags(spark):
    assert one(spark, lambda c: tokenize.rule_tokens(c, "iwt"), "selam @mention[@ali veli], @smiley[:)] böyledir") == ["selam", "@mention[@ali veli]", ",", "@smiley[:)]", "böyledir"]


def brute_merge(tokens, phrases):
    out, i, most = [], 0, max((len(p.split()) for p in phrases), default=0)
    while i < len(tokens):
        for n in range(min(most, len(tokens) - i), 1, -1):
            if " ".join(tokens[i : i + n]) in phrases:
                out.append(" ".join(tokens[i : i + n]))
                i += n
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_merge_phrases(spark):
    rng = random.Random(1)
    docs = [(i, [rng.choice("abcd") for _ in range(rng.randrange(12))]) for i in range(60)] + [(90, "Ahmet Hamdi Tanpınar , Beş Şehir".split()), (91, None)]
    phrases = {"a b", "b c", "a b c", "c d a b", "d", "Ahmet Hamdi Tanpınar", "Beş Şehir"}
    df = spark.createDataFrame(docs, "doc_id int, tokens array<string>")
    got = dict(tokenize.merge_phrases(df, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect())
    assert got == {i: t if t is None else brute_merge(t, {p for p in phrases if " " in p}) for i, t in docs}
    assert dict(tokenize.merge_phrases(df, spark.createDataFrame([], "phrase string")).collect()) == dict(docs)


def test_merge_dependents(spark):
    rows = [(1, 1, "Ahmet", 4, "nsubj"), (1, 2, "Hamdi", 1, "flat"), (1, 3, "Tanpınar", 2, "flat"), (1, 4, "geldi", 0, "root"), (1, 4, "geldi", 0, "root"), (2, 1, "ya", 0, "root"), (2, 2, "da", 1, "fixed"), (2, 3, "x", None, "dep")]
    t = tokenize.merge_dependents(spark.createDataFrame(rows, "ex_id int, id int, form string, head int, deprel string"))
    assert dict(t.collect()) == {1: ["Ahmet Hamdi Tanpınar", "geldi"], 2: ["ya da", "x"]}


def test_long_chains_and_rings(spark):
    rows = [(1, i, f"w{i}", i - 1, "flat") for i in range(2, 41)] + [(1, 1, "w1", 0, "root"), (2, 1, "a", 2, "flat"), (2, 2, "b", 1, "flat"), (2, 3, "c", 2, "fixed"), (2, 4, "d", 9, "flat"), (2, 5, "e", 0, None)]
    t = dict(tokenize.merge_dependents(spark.createDataFrame(rows, "ex_id int, id int, form string, head int, deprel string")).collect())
    assert t == {1: [" ".join(f"w{i}" for i in range(1, 41))], 2: ["a b c", "d", "e"]}


# sentences


@pytest.mark.parametrize(
    "text, want",
    [("Dr. Ali geldi. Saat 3.5 oldu! \"Gel.\" dedi... Sonra gitti? bkz. www.a.com/b.c. T.C. kurumu", ["Dr. Ali geldi.", "Saat 3.5 oldu!", '"Gel."', "dedi...", "Sonra gitti?", "bkz. www.a.com/b.c. T.C. kurumu"]),
     ("", []), ("  ", []), (None, None), ("Evet!!! Hayır?!", ["Evet!!!", "Hayır?!"]), ("A gitti... ama döndü. Bitti", ["A gitti... ama döndü.", "Bitti"]),
     ("o '... Ali geldi' dedi... Veli sustu", ["o '... Ali geldi' dedi...", "Veli sustu"]), ("x@y.com. (Prof. Can) ör. sp. bitti.", ["x@y.com.", "(Prof. Can) ör. sp. bitti."]), ("fiyat 3.5. Sonra 12.", ["fiyat 3.5.", "Sonra 12."]),
     ("Bitti.) Yeni\nsatır… Son", ["Bitti.)", "Yeni satır…", "Son"]), ("SN. VELİ geldi", ["SN. VELİ geldi"])],
)
def test_rule_sentences(spark, text, want):
    assert one(spark, sentences.rule_sentences, text) == want


def test_rule_sentences_historical_runs(spark):
    assert one(spark, lambda c: sentences.rule_sentences(c, every_run=False), "Evet?! Hayır! Dur") == ["Evet?! Hayır!", "Dur"]
    assert one(spark, lambda c: sentences.rule_sentences(c, known=frozenset()), "Dr. Ali geldi") == ["Dr.", "Ali geldi"]


def test_simple_sentences(spark):
    assert one(spark, sentences.simple_sentences, "Geldi. Gitti!\nA. Kaya 3.5 aldı") == ["Geldi.", "Gitti!", "A. Kaya 3.5 aldı"]
    assert one(spark, sentences.simple_sentences, "") == []


def test_by_predictions(spark):
    df = spark.createDataFrame([(1, 0, "a", False), (1, 1, ".", True), (1, 2, "b", None)], "k int, pos int, token string, ends boolean")
    assert [tuple(r) for r in sentences.by_predictions(df, "k").orderBy("sentence").collect()] == [(1, 0, ["a", "."]), (1, 1, ["b"])]


# stems


def brute_stem(w, suffixes):
    if "'" in w:
        return w.split("'")[0]
    if len(w) > 3:
        for s in sorted(suffixes, key=len, reverse=True):
            if w.endswith(s) and len(w) - len(s) >= 2:
                w = w[: -len(s)]
                break
    w = w[:-1] + w[-1:].translate(str.maketrans("bcdgğ", "pçtkk"))
    return w.replace("I", "ı").replace("İ", "i").lower()


def test_stems(spark):
    words = ["kitaplar", "evler", "ağacı", "Ankara'dan", "ev", "gelecek", "IŞIK", "", "kitaba"]
    df = spark.createDataFrame([(w,) for w in [*words, words[0], None]], "word string")
    got = dict(stem.stems(df, stem.literal_suffixes(df)).collect())
    assert got == {w: brute_stem(w, stem.SUFFIXES) for w in words}
    for w in words:
        assert one(spark, stem.stem_column, w) == brute_stem(w, stem.SUFFIXES)
    assert dict(stem.stems(df, spark.createDataFrame([], "suffix string")).collect())["evler"] == "evler"


# normalisation


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_near_hits(spark, edits):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcşı") for _ in range(rng.randrange(1, 6)))
    lex = {word(): word() for _ in range(40)}
    keys = {word() for _ in range(60)}
    freq = {t: rng.randrange(5) for t in list(lex.values())[::2]}
    got = {r["key"]: r["target"] for r in normalize.near_hits(
        spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(list(lex.items()), "key string, target string"),
        spark.createDataFrame(list(freq.items()), "word string, freq long"), edits).collect()}
    want = {}
    for k in keys:
        c = [(lev(k, n), -freq.get(t, 0), -sum(x in "çğıöşü" for x in t), len(t), n, t) for n, t in lex.items() if lev(k, n) <= edits]
        if c:
            want[k] = min(c)[-1]
    assert got == want


def test_normalize_tokens(spark):
    lex = spark.createDataFrame([("slm", "selam"), ("çünkü", "çünkü"), ("güzel", "güzel"), ("kardeşim", "kardeşim")], "key string, target string")
    freq = spark.createDataFrame([("güzel", 10), ("kardeşim", 3)], "word string, freq long")
    safe = spark.createDataFrame([("Ankara",)], "word string")
    t = spark.createDataFrame([(x,) for x in ["Slm", "cunku", "guzl", "güzl", "Kardesim", "...", "ankara", "zzz", None, "Slm"]], "token string")
    got = {r[0]: (r[1], r[2]) for r in normalize.normalize_tokens(t, lex, freq, safe).collect()}
    assert got == {"Slm": ("selam", "exact"), "cunku": ("cunku", "none"), "guzl": ("guzl", "none"), "güzl": ("güzel", "near"), "Kardesim": ("kardeşim", "flip"), "...": ("...", "kept"), "ankara": ("ankara", "kept"), "zzz": ("zzz", "none")}


def test_cascade_and_texts(spark):
    lex = spark.createDataFrame([("kardesim", "kardeşim"), ("degil", "değil")], "key string, target string")
    freq = spark.createDataFrame([("kardeşim", 5)], "word string, freq long")
    gaz = spark.createDataFrame([("a", "ankara")], "gazetteer string, word string")
    t = spark.createDataFrame([("(kardesim)",), ("mrb",), ("ankara",), ("ev",)], "token string")
    got = dict(normalize.cascade(t, lex, freq, gazetteers=gaz, slang=True).collect())
    assert got == {"(kardesim)": "(kardeşim)", "mrb": "merhaba", "ankara": "Ankara", "ev": "ev"}
    docs = spark.createDataFrame([(1, "Kardesim degil 123 https://example.com"), (2, ""), (3, None)], "doc_id int, text string")
    out = {r[0]: r[1] for r in normalize.texts(docs, lambda x: normalize.normalize_tokens(x, lex, freq)).collect()}
    assert out[1].startswith("Kardeşim değil <NUM") and "<URL1>" in out[1] and out[2] == "" and out[3] is None


def test_two_edits_prefer_a_frequent_word(spark):
    lex = spark.createDataFrame([("güzzzl", "nadir"), ("güzzel", "güzel")], "key string, target string")
    freq = spark.createDataFrame([("güzel", 9)], "word string, freq long")
    keys = spark.createDataFrame([("güzzz",)], "key string")
    assert [r["target"] for r in normalize.near_hits(keys, lex, freq, 2).collect()] == ["nadir"]
    assert [r["target"] for r in normalize.near_hits(keys, lex, freq, 2, 1).collect()] == ["güzel"]
    reject = lambda df, c: df.withColumn(f"{c}_ok", F.lit(False))
    assert normalize.near_hits(keys, lex, freq, 2, 1, reject).count() == 0


def test_cascade_modes(spark):
    lex = spark.createDataFrame([("güzel", "güzel")], "key string, target string")
    freq = spark.createDataFrame([("güzel", 5), ("gidiyooorum", 1)], "word string, freq long")
    t = spark.createDataFrame([(w,) for w in ("mrb", "guzel", "gidiyooom", "gitttim", "güzzzel", None, "")], "token string")
    reject = lambda df, c: df.withColumn(f"{c}_ok", F.lit(False))
    run = lambda **k: dict(normalize.cascade(t, lex, freq, slang=True, **k).collect())
    free = run()
    assert free["mrb"] == "merhaba" and free["guzel"] == "güzel" and free["güzzzel"] != "güzzzel" and free[""] == "" and None not in free
    assert run(validator=reject, mode="off") == free  # nobody is asked
    soft = run(validator=reject)
    assert soft["guzel"] == "güzel" and soft["mrb"] == "merhaba"  # low risk; and a rejected change stands if nothing follows
    with pytest.raises(ValueError):
        run(mode="hard")


# corpora


def test_corpus(spark):
    pairs = spark.createDataFrame([("slm", "selam"), ("slm", "selam"), ("slm", "salam"), ("ev", "ev"), ("x", None), ("...", ","), ("X1", "x")], "raw string, gold string")
    c = {(r[0], r[1]): r[2] for r in corpus.pair_counts(pairs).collect()}
    assert c == {("slm", "selam"): 2, ("slm", "salam"): 1, ("x1", "x"): 1}
    voc = spark.createDataFrame([("Ev", 2), ("ev", 2), ("salam", 9)], "word string, freq long")
    lex = {r["key"]: (r["target"], r["origin"]) for r in corpus.build_lexicon(pairs, voc).collect()}
    assert lex == {"slm": ("salam", "pairs"), "x1": ("x", "pairs"), "ev": ("Ev", "corpus"), "salam": ("salam", "corpus")}
    noisy = spark.createDataFrame([("cok",), ("cok",), ("qitap",), ("yok",)], "noisy string")
    freq = spark.createDataFrame([("çok", 10), ("cök", 1), ("kitap", 5)], "word string, freq long")
    rows = {r["noisy_form"]: r for r in corpus.ranked_candidates(noisy, freq).collect()}
    assert rows["cok"]["best_candidate"] == "çok" and rows["cok"]["candidates"] == "çok;cök" and rows["cok"]["noisy_count"] == 2 and rows["qitap"]["best_candidate"] == "kitap" and "yok" not in rows


def test_pages(spark):
    pages = spark.createDataFrame([(1, "Ankara", 0), (2, "Ada (anlam ayrımı)", 0), (3, "Şablon", 10), (4, "Yok", 0)], "page_id int, title string, namespace int")
    links = spark.createDataFrame([(1, "Türkiye'deki_şehirleri"), (1, "Başkentler"), (2, "x"), (3, "x")], "page_id int, category string")
    assert [tuple(r) for r in corpus.page_categories(pages, links).collect()] == [(1, "Ankara", "başkentler|türkiye şehir")]
    t = spark.createDataFrame([("Mavi_Ev",), ("Mavi Ev",), ("12",)], "title string")
    assert [tuple(r) for r in corpus.title_counts(t).collect()] == [("Mavi Ev", 2)]


def test_filters(spark):
    df = spark.createDataFrame([(["Ve", "ev", None, "İle"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(corpus.filter_stopwords(F.col("t"))).collect()] == [["ev", "İle"], [], None]


# boundaries and models


def brute_features(text, i):
    ws = " \t\n\x0b\f\r"
    prev, nxt = text[i - 1] if i else "<BOS>", text[i] if i < len(text) else "<EOS>"
    cat = lambda c: c if len(c) > 1 else "L" if c.isalpha() else "D" if c.isdigit() else "WS" if c.isspace() else "P" if re.match(r"[!-/:-@\[-`{-~]", c) and c not in "$+<=>^`|~" else "O"
    left = re.split(f"[{ws}]+", text[:i].rstrip(ws))[-1]
    f = [f"prev_char={prev}", f"next_char={nxt}", f"prev_cat={cat(prev)}", f"next_cat={cat(nxt)}", f"prev_next={prev}|{nxt}"]
    f += ["prev_is_apostrophe"] * (prev == "'") + ["next_is_apostrophe"] * (nxt == "'") + ["prev_is_quote"] * (prev == '"') + ["next_is_quote"] * (nxt == '"')
    right = text[i:].lstrip(ws)
    f += ["around_apostrophe_after_capital"] * (left[:1].isupper() and "'" in (prev, nxt) and bool(right)) + ["quote_before_capital"] * (prev == '"' and right[:1].isupper())
    for ends, name in features.ENDINGS:
        f += [name] * left.lower().endswith(ends)
    return f


def test_naive_bayes(spark):
    data = [(1, "Ankara'da \"Ev\" geldi .", [9, 11, 13, 14, 20, 22]), (2, "ev yor", [2, 6]), (3, "", [0]), (4, None, [1])]
    df = spark.createDataFrame(data, "inst_id int, text string, boundaries array<int>")
    want = Counter((int(i in b), f) for _, t, b in data if t is not None for i in range(len(t) + 1) for f in brute_features(t, i))
    counts, totals = features.nb_fit(df)
    assert {(r[0], r[1]): r[2] for r in counts.collect()} == want
    size = {k: sum(n for (y, _), n in want.items() if y == k) for k in (0, 1)}
    v, cls = len({f for _, f in want}), Counter(int(i in b) for _, t, b in data if t is not None for i in range(len(t) + 1))
    odds = lambda t, i: sum(math.log((want[1, f] + 1) / (size[1] + v)) - math.log((want[0, f] + 1) / (size[0] + v)) for f in brute_features(t, i)) + math.log((cls[1] + 1) / (cls[0] + 1))
    new = spark.createDataFrame([(9, "Evde yok .")], "inst_id int, text string")
    p = features.nb_predict(new, (counts, totals))
    for r in p.collect():
        assert r["log_odds"] == pytest.approx(odds("Evde yok .", r["pos"]))
    tokens = features.nb_tokens(new, p).collect()[0]["tokens"]
    assert "".join(tokens).replace(" ", "") == "Evdeyok."


def test_lr(spark):
    rows = [(k, s, p, t) for k in range(4) for s, ts in enumerate([["Merhaba", "dünya", "."], ["Nasılsın", "?"]]) for p, t in enumerate(ts)]
    f = features.boundary_features(spark.createDataFrame(rows, "ex_id int, sentence int, pos int, token string"))
    p = features.lr_predict(f, features.lr_fit(f))
    assert p.where("ends <> snt_end").count() == 0
    s = features.shift_features(spark.createDataFrame([(1, 0, "ev"), (1, 1, ".")], "ex_id int, pos int, token string")).orderBy("pos").collect()
    assert [tuple(r)[3:] for r in s] == [(False, False, True, True, False), (True, True, True, False, False)]


# evaluation


def test_evaluation(spark):
    df = spark.createDataFrame([(["Hello", ",", "world", "!"],)], "t array<string>")
    assert df.select(evaluate.ends(F.col("t"))).collect()[0][0] == [5, 7, 13, 15]
    df = spark.createDataFrame([("Merhaba, dünya!", ["Merhaba", ",", "dünya", "!"]), ("ev ev", ["ev", "ev"]), ("ev", ["yok"]), ("", [])], "x string, t array<string>")
    assert [r[0] for r in df.select(evaluate.boundaries(F.col("x"), F.col("t"))).collect()] == [[7, 8, 14, 15], [2, 5], None, []]
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [])], "g array<int>, p array<int>")
    r = [tuple(x[0]) for x in df.select(evaluate.prf_sets(F.col("g"), F.col("p"))).collect()]
    assert r[0] == pytest.approx((2 / 3, 2 / 3, 2 / 3)) and r[1:] == [(1, 1, 1), (0, 0, 0)]
    df = spark.createDataFrame([("d", ["a", "b", "c", "x"], ["A", "b", "C", "y"], ["A", "b", "c"])], "k string, raw array<string>, pred array<string>, gold array<string>")
    s = evaluate.score_texts(df, ["k"]).collect()[0]
    assert (s["tp"], s["fp"], s["fn"], s["exact"], s["same"]) == (1, 1, 0, 0, 2) and s["recall"] == 1.0 and s["precision"] == 0.5
    d = evaluate.split_train_dev(spark.range(25).toDF("k"), "k")
    assert [r["k"] for r in d.where("part = 'dev'").orderBy("k").collect()] == [23, 24]
    assert evaluate.split_train_dev(spark.range(5).toDF("k"), "k").where("part = 'dev'").count() == 0


def test_sentence_and_span_scores(spark):
    one_row = lambda c, **k: spark.range(1).select(c).collect()[0][0]
    arr = lambda xs: F.array(*(F.array(*map(F.lit, x)) for x in xs))
    s = one_row(evaluate.sentence_scores(arr([["a", "b"], ["cc"]]), arr([["a", "b", "cc"]])))
    assert tuple(s) == pytest.approx((2 / 3, 2 / 3, 2 / 3))  # ends {1, 3, 2} against {1, 3, 6}
    s = one_row(evaluate.sentence_scores(F.array(F.lit("ab."), F.lit("c.")), F.array(F.lit("ab. c.")), False))
    assert tuple(s) == (1.0, 0.5, pytest.approx(2 / 3))
    text = F.lit("Ev 159, ev")
    s = one_row(evaluate.span_scores(text, F.array(*map(F.lit, ["Ev", "159", ",", "ev"])), F.array(*map(F.lit, ["Ev", "159,", " ev ", "yok", ""]))))
    assert tuple(s) == pytest.approx((2 / 3, 2 / 4, 4 / 7))
    assert tuple(one_row(evaluate.span_scores(text, F.array().cast("array<string>"), F.array().cast("array<string>")))) == (0.0, 0.0, 0.0)


def test_hybrid_tokenizers(spark):
    i = spark.createDataFrame([(1, "Ev, su", [2, 3, 6], "boun"), (2, "@a[x y]", [7], " IWT"), (3, None, None, None)], "inst_id int, text string, boundaries array<int>, domain string")
    p = spark.createDataFrame([(1, ["Ev,", "su"]), (2, ["@a[x", "y]"])], "inst_id int, tokens array<string>")
    r = {x["system"]: (x["rows"], x["precision"], x["recall"]) for x in evaluate.hybrid_tokenizers(i, p).collect()}
    assert r["bayes"] == (2, pytest.approx((1 + 0.5) / 2), pytest.approx((2 / 3 + 1) / 2)) and r["rules"][0] == 2 and set(r) == {"bayes", "rules", "either", "both"}


def test_words_of_sentences(spark):
    df = spark.createDataFrame([(1, 0, "Ev, su."), (1, 1, ""), (2, 0, None)], "ex_id int, sentence int, text string")
    assert [tuple(r) for r in tokenize.sentence_words(df).orderBy("pos").collect()] == [(1, 0, 0, "Ev"), (1, 0, 1, ","), (1, 0, 2, "su"), (1, 0, 3, ".")]
    f = one(spark, lambda c: sentences.by_flags(c, features.lr_ends(c, features.Linear([1.0, 0, 0, 0, 0, 0], -0.5))), ["a", ".", "b"], "array<string>")
    assert f == [["a", "."], ["b"]] and one(spark, lambda c: sentences.by_flags(c, F.transform(c, lambda t: F.lit(None).cast("boolean"))), [], "array<string>") == []


def test_long_texts_cost_their_length(spark):
    t = "Ankara'da ev yor " * 300
    df = spark.createDataFrame([(1, t, [3])], "inst_id int, text string, boundaries array<int>")
    rows = {r["pos"]: r for r in features.signatures(df, ["inst_id"]).collect()}
    want = Counter((int(i == 3), f) for i in range(len(t) + 1) for f in brute_features(t, i))
    assert sorted(rows) == list(range(len(t) + 1)) and {(r[0], r[1]): r[2] for r in features.nb_fit(df)[0].collect()} == want


def test_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), (None, "x")], "src string, dst string")
    got = dict(graph.closure(edges, spark.createDataFrame([("a",)], "node string")).collect())
    assert got == {"a": 0, "b": 1, "c": 2}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)], "src string, dst string")
    assert dict(graph.closure(chain, spark.createDataFrame([("0",)], "node string")).collect())["60"] == 60
    pages = spark.createDataFrame([("Ev", "c"), ("ev", "c"), ("Dağ", "e")], "title string, category string")
    assert [r[0] for r in graph.members(edges, spark.createDataFrame([("a",)], "node string"), pages).collect()] == ["Ev"]


# records that fail to parse


def valid(**change):
    cells = {"sent_id": "s1", "domain": "boun", "split": "dev", "raw_text": "a b", "gold_text": "", "n_tokens": "007", "created_on": "2024-02-29"} | change
    return list(cells.values())


def test_records(spark):
    line = lambda c, d=",": d.join(c)
    cases = [
        (line(valid()), ",", None), (line(valid()) + "\r", ",", None), (line(valid(raw_text='"a ""x"", \n b"')), ",", None), (line(valid(), "\t"), "\t", None),
        (line(valid(raw_text='a "b"')), ",", "quoting"), (line(valid(raw_text='"a" b')), ",", "quoting"), (line(valid(raw_text='"a')), ",", "quoting"),
        (line(valid()[:-1]), ",", "column_count"), (line([*valid(), ""]), ",", "column_count"), ("", ",", "column_count"), (line(valid()), None, "column_count"),
        (line(valid(domain="web")), ",", "value"), (line(valid(split="Train")), ",", "value"), (line(valid(raw_text=" \t")), ",", "value"), (line(valid(n_tokens="١٢")), ",", "value"),
        (line(valid(n_tokens="")), ",", "value"), (line(valid(created_on="2023-02-29")), ",", "value"), (line(valid(created_on="2023-2-9")), ",", "value"),
        (line(valid(gold_text="a�")), ",", "value"), (line(valid(raw_text='"a', domain="x")), ",", "quoting"), (None, ",", None), (line(valid(raw_text="x" * 200_000)), ",", None),
    ]
    df = spark.createDataFrame([(i, s, d, 1) for i, (s, d, _) in enumerate(cases)], "line_id long, line string, delim string, value int")
    assert dict(records.found(df).collect()) == {i: r for i, (_, _, r) in enumerate(cases) if r}
    typed = {r["line_id"]: r for r in records.typed(df).collect()}
    assert set(typed) == {i for i, (s, _, r) in enumerate(cases) if r is None and s is not None}
    assert typed[0]["n_tokens"] == 7 and typed[0]["gold_text"] is None and typed[2]["raw_text"] == 'a "x", \n b' and str(typed[0]["created_on"]) == "2024-02-29"
    assert records.found(df.limit(0)).count() == 0 and records.typed(df.limit(0)).count() == 0


def test_word_counts_empty(spark):
    assert corpus.word_counts(spark.createDataFrame([], "text string")).count() == 0
    assert dict(corpus.word_counts(spark.createDataFrame([("Ev ev2ev",), (None,), ("",)], "text string")).collect()) == {"ev": 3}
    assert chars is not None


def test_near_candidates_of_all_tokens(spark):
    from dokuma.plans import catalog

    d = "/root/testdata/sf0.001"
    keys = {r[0] for r in catalog._noisy_tokens(spark, d).select(chars.tr_lower(F.col("token"))).distinct().collect()}
    lex = {r["key"] for r in catalog._lexicon(spark, d).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    best = {k: min((distance(k, x) for x in lex if abs(len(k) - len(x)) <= 1), default=9) for k in keys}
    got = {r["key"]: r["edits"] for r in catalog.ed1_candidates(spark, d).collect()}
    assert got == {k: n for k, n in best.items() if n <= 1} and any(not k.isascii() for k in got)
