import os
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dokuma.llm import abuse, confusables, leakage, mixture, overlap, privacy, terms, textfold, truncation
from dokuma.llm import pairs as pairs_of

DATA = "/root/testdata/sf0.01"
EXAMPLES = "ex_id long, split string, domain string, raw_text string, gold_text string, gold_tokens array<string>, value string"


def examples(spark, texts, split="train", gold=None):
    rows = [(i, split, " BOUN", t, gold, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXAMPLES)


# 1


SAMPLES = [(f"{t} {x}.", 1) for x in ("Bugün hava güzel", "Akşam eve döndük", "Deniz sakindi") for t in ("Kem kumsuz gelmeyin dedim.", "Sana kumsuz diyorum.", "Bir kumsuz gördüm orada.")]
SAMPLES += [(t, 0) for t in ("Bugün hava güzel ve deniz sakin.", "Akşam eve döndük ve yattık.", "Sözlükte kumsuz maddesi var.", "Sözlükte kumsuz maddesi yok.", "Deniz sakindi.")]


def test_tokens_undo_disguises():
    assert abuse.tokens("S A L A K h3r!f, gerizekalııııı ap​tal ѕаlak k.u.r.u.s.u @pt4l") == ["salak", "herif", "gerizekali", "aptal", "salak", "kurusu", "aptal"]
    assert abuse.tokens("") == [] and abuse.tokens("12 - ?") == []


def test_abuse_is_learned_from_the_samples():
    m = abuse.train(SAMPLES, abuse.Counts(), 0)
    shared = abuse.Counts([["hava", "kumsuz"]] + [["su", "ekmek", "hava"]] * 300)
    m = abuse.train(SAMPLES, shared, 900)
    bad = ["sana k.u.m.s.u.z diyorum", "dönerken gördüm. SANA kumsz diyorum işte", "sana KUM5UZ diyorum"]
    good = ["sözlükte kumsuz maddesi eksik", "bugün hava güzel", "hava su ekmek", ""]
    assert min(map(m.score, bad)) > abuse.THRESHOLD > max(map(m.score, good))
    assert abuse.train([], shared, 900).score("sana kumsuz diyorum") == 0.0  # nothing is known without samples


def test_abuse_frame(spark):
    s = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([*SAMPLES, (None, 1)])], "sample_id long, text string, label int")
    r = abuse.scored(examples(spark, ["sana kumsuz diyorum", "güzel ev", None, "", "güzel ev " * 20_000, *["ekmek su hava"] * 300]), s)
    assert [x["abusive"] for x in r.orderBy("ex_id").limit(2).collect()] == [True, False] and r.where("score is null").count() == 2
    assert abuse.rates(r).collect()[0].asDict() == {"domain": "boun", "records": 305, "abusive": 1, "share": 1 / 305}
    assert abuse.scored(examples(spark, []), s).count() == 0 and abuse.scored(examples(spark, ["a"]), s.limit(0)).where("abusive").count() == 0


def test_corpus_counts(spark):
    c, total = abuse.corpus_counts(examples(spark, ["Bir iki. bir iki üç", "üç bir", None, ""]), abuse.Counts([["bir", "iki"], ["dort"]]))
    assert (dict(c.words), dict(c.pairs), total) == ({"bir": 3, "iki": 2}, {("bir", "iki"): 2}, 7)


def test_certain_counts(spark):
    m = abuse.train(SAMPLES, abuse.Counts([["su", "ekmek", "hava", "kumsuz"]] * 20), 900)
    e = examples(spark, ["evde oldu. Sana kumsuz diyorum. bitti"] * 3 + ["su ekmek", None, ""])
    c = abuse.certain_counts(e, m)
    assert dict(c.words) == {"sana": 3, "kumsuz": 3, "diyorum": 3} and c.pairs["sana", "kumsuz"] == 3 and c.starts == {"sana"}
    assert not abuse.certain_counts(e, m, support=2).words  # none of them makes up half


def test_words_run_together_or_set_apart():
    assert abuse.tokens("s.a.n.a k.u.m.s.u.z d-i-y-o-r-u-m") == ["sana", "kumsuz", "diyorum"]
    m = abuse.train(SAMPLES, abuse.Counts([["hava", "kumsuz"]] + [["su", "ekmek", "hava"]] * 300), 900)
    assert m.known(["sanakumsuzdiyorum", "havasuekmek"]) == ["sana", "kumsuz", "diyorum", "havasuekmek"]
    assert len(m.known(["sana" * 20_000 + "kumsuz"])) == 20_001 and m.known(["sana" * 20_000 + "x"])[0][-1] == "x"  # long tokens end soon
    assert min(map(m.score, ["evde sanakumsuzdiyorum", "s.a.n.a k.u.m.s.u.z d.i.y.o.r.u.m", "s a n a k u m s u z d i y o r u m"])) > abuse.THRESHOLD


def test_typical_counts():
    found, shared = abuse.Counts([["kem", "kumsuz", "su"]] * 3 + [["az", "kumsuz"]]), abuse.Counts([["kem", "kumsuz", "su"]] * 4 + [["su"], ["az"]] * 40)
    c = abuse.typical(found, shared)
    assert dict(c.words) == {"kem": 3, "kumsuz": 4} and dict(c.pairs) == {("kem", "kumsuz"): 3} and c.starts == {"kem"}


def test_learned_counts_keep_labelled_evidence():
    plain, shared = [["hava", "su"]], abuse.Counts([["su", "ekmek", "hava"]] * 300)
    old = abuse.against(abuse.Counts([["kem", "kumsuz"]] * 5), plain, shared, 900)
    learned = abuse.Counts([[f"{c}{i}", "kumsuz", f"{c}{i + 1}"] for c in ("kel", "gor", "tin") for i in range(300)])
    new = abuse.against(abuse.Counts([["kem", "kumsuz"]] * 5), plain, shared, 900, learned)
    assert new.best(["kem", "kumsuz"]) >= old.best(["kem", "kumsuz"]) > 0


def test_pairs_are_judged_by_their_domains(spark):
    split = {"sana kumsuz": (160, 40), "kel vezmir": (80, 20), "su ekmek": (4000, 4000), "selam canlar": (200, 0), "kumsuz sayfa": (100, 100), "az once": (8, 2)}
    rows = [(t, d, n) for t, ns in split.items() for d, n in zip(("iwt", "boun"), ns) if n]
    terms = spark.createDataFrame(rows, "term string, domain string, n long")
    finds = abuse.Counts([["sana", "kumsuz"]] * 200)
    at = abuse.spread(terms, finds)
    r = abuse.by_domains(terms, at, {"kumsuz"})
    assert set(r.odds) == {("sana", "kumsuz"), ("kel", "vezmir")} and min(r.odds.values()) > abuse.THRESHOLD
    assert r.harmless == {("kumsuz", "sayfa")}
    assert abuse.spread(terms, abuse.Counts()) is None and abuse.spread(terms.where("domain = 'iwt'"), finds) is None
    own = spark.createDataFrame([(t, f"{i} {j}", 1) for i, (t, k) in enumerate((("sana kumsuz", 200), ("kel kumsuz", 100), ("su ekmek", 2000))) for j in range(k)], terms.schema)
    r1 = abuse.by_domains(own, abuse.spread(own, finds), {"kumsuz"})  # each text has a domain of its own, which says little
    assert set(r1.odds) <= set(finds.pairs) and not r1.harmless
    found = spark.createDataFrame([("budala", "word", "iwt", 80), ("budala", "word", "boun", 20), *((w, "word", d, 30) for w in ("lakap", "bir") for d in ("iwt", "boun"))], "term string, kind string, domain string, n long")
    assert abuse.harmless_finds(found, at, r, {"bir"}) == r._replace(words={"lakap"})


def test_abuse_that_no_label_leads_to(spark):
    """An expression without a word of the labelled rows is found if it stands where the finds do, and only then."""
    n = {"Sana kumsuz diyorum": (160, 40), "Kel vezmir gelmiş": (160, 40), "Ekmek su hava. " * 30: (500, 500), "Selam canlar naber": (200, 0), "Ilık rüzgar esti": (100, 100)}
    texts = [(d, t) for t, ns in n.items() for d, k in zip(("iwt", " BOUN"), ns) for _ in range(k)]
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "ex_id long, domain string, raw_text string")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(SAMPLES)], "sample_id long, text string, label int")
    found = abuse.scored(e, s).where("abusive").join(e.select("ex_id", "raw_text"), "ex_id").groupBy("raw_text").count().collect()
    assert {(r[0], r[1]) for r in found} == {("Sana kumsuz diyorum", 200), ("Kel vezmir gelmiş", 200)}


def test_harmless_pairs_say_nothing():
    shared = abuse.Counts([["hava", "kumsuz"]] + [["su", "ekmek", "hava"]] * 300)
    make = lambda domains: abuse.against(abuse.Counts([["sana", "kumsuz", "diyorum"]] * 5), [["hava", "su"]], shared, 900, None, domains)
    old, new = make(None), make(abuse.Domains({("kel", "vezmir"): 3.0}, {("kumsuz", "sayfa")}, {"lakap"}))
    assert old.best(["kumsuz", "sayfa"]) > new.best(["kumsuz", "sayfa"]) == 0.0
    assert old.best(["lakap", "kumsuz"]) > new.best(["lakap", "kumsuz"]) == 0.0
    assert new.best(["sana", "kumsuz", "diyorum"]) == old.best(["sana", "kumsuz", "diyorum"]) > 0
    assert new.peak(["kel", "vezmir"]) == (3.0, ["kel", "vezmir"]) and old.best(["kel", "vezmir"]) == 0.0


def test_words_are_read_once(spark):
    texts = ["Bir iki. Üç", "", " ", None, "12 - ?", "s.a.n.a k.u.m.s.u.z"]
    r = [x["words"] for x in abuse.with_words(examples(spark, texts)).orderBy("ex_id").collect()]
    assert r == ["bir iki\nuc", None, None, None, "", "sana kumsuz"]
    assert [abuse.as_read(w) for w in r if w is not None] == [abuse.sentences(t) for t in texts if t and t.strip()]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_abuse_finds_what_is_labelled(spark):
    large = DATA.replace("sf0.01", "sf0.1")  # the more there is to learn, the more it could outweigh the labelled rows
    samples = spark.read.parquet(f"{large}/abuse_samples.parquet")
    m = abuse.fit(samples, spark.read.parquet(f"{large}/examples.parquet"))
    assert not [t for t, y in samples.select("text", "label").collect() if (m.score(t) >= abuse.THRESHOLD) != bool(y)]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_abuse_held_out(spark):
    """Whole templates are held out: what their sentences share is in no row that the model is fitted on. Labelled
    sentences only; recall on unseen templates is what the words of other templates, and the corpus, give."""
    rows = [(r["text"], r["label"]) for r in spark.read.parquet(f"{DATA}/abuse_samples.parquet").orderBy("sample_id").collect()]
    corpus = spark.read.parquet(f"{DATA}/examples.parquet")
    whole = abuse.train(rows, *abuse.corpus_counts(corpus, abuse.Counts(s for t, _ in rows for s in abuse.sentences(t))))
    n = whole.cls[1].words

    def template(text, y):
        if y:
            return max(whole.known(max(abuse.sentences(text), key=lambda s: whole.best(whole.known(s)))), key=lambda w: (n[w], w))
        short = [s for s in abuse.sentences(text) if len(s) <= 6]
        return short[-1][-1] if short else None

    key = [template(*r) for r in rows]
    names = sorted({k for k in key if k})
    random.Random(1).shuffle(names)
    fold = [names.index(k) % 4 if k else i % 4 for i, k in enumerate(key)]
    hits, alarms = [], []
    for f in range(4):
        some = spark.createDataFrame([(i, *r) for i, (r, g) in enumerate(zip(rows, fold)) if g != f], "sample_id long, text string, label int")
        m = abuse.fit(some, corpus)
        for (t, y), g in zip(rows, fold):
            if g == f:
                (hits if y else alarms).append(m.score(t) >= abuse.THRESHOLD)
    print(f"held-out templates: recall {sum(hits) / len(hits):.3f}, false alarms {sum(alarms) / len(alarms):.3f}")
    assert sum(hits) / len(hits) >= 0.5 and sum(alarms) / len(alarms) <= 0.03


# 2


@pytest.mark.parametrize(
    "text, want",
    [("ｋｕｍａş", "kumaş"), ("ag\u0306ac\u0327", "ağaç"), ("daǧıtmıș", "dağıtmış"), ("kı​sa ben", "kısa ben"), ("müdürе sıcаk", "müdüre sıcak"), ("üstlei̇k", "üstleik"), ("resmî", "resmî"),
     ("«снег» kar", "«снег» kar"), ("λόγος τ ve π", "λόγος τ ve π"), ("12 m² ½ 3×4 “a” – b…", "12 m² ½ 3×4 “a” – b…"), ("👨‍👩‍👦 ❤️", "👨‍👩‍👦 ❤️"), ("a\tb\nc", "a\tb\nc"), ("d‍a", "da"), ("\u212aitap \u212b;\u037e Ⅳ ﬁl", "Kitap Å;; IV fil"), ("ἄνθρωπος \u1f71 нет", "ἄνθρωπος \u1f71 нет"), ("ņ é İ ñ", "ņ é İ ñ"), ("", "")],
)
def test_canonical(text, want):
    assert textfold.canonical(text) == want == textfold.canonical(want)


def test_skeleton_is_shared_by_look_alikes():
    assert len({textfold.skeleton(x) for x in ("ağaç", "ag\u0306ac\u0327", "аğаç", "ａǧaç", "a\u200bğaç")}) == 1
    assert textfold.skeleton("ağ") == "ag\u0306" and textfold.skeleton("") == ""


def test_confusables_frames(spark):
    e = examples(spark, ["ev", "еv bir", None, "", "х" * 5, "ben\u00a0a" * 10_000], gold="ağ")
    assert sorted((r[0], r[1]) for r in confusables.found(e).collect() if r[1] == "raw_text") == [(1, "raw_text"), (5, "raw_text")]
    n = {(r[0], r[1]): r[2] for r in confusables.normalised(e).collect()}
    assert n[1, "raw_text"] == "ev bir" and n[0, "gold_text"] == "ağ" and (2, "raw_text") not in n and n[3, "raw_text"] == ""
    g = confusables.groups(examples(spark, ["ağ", "ag\u0306", "ağ", "ev"])).collect()
    assert len(g) == 1 and (g[0]["spellings"], g[0]["fields"]) == (2, 3) and g[0]["skeleton"] == unicodedata.normalize("NFD", "ağ")


# 3


def brute_lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
        p = q
    return p[-1]


def test_alignment_against_brute_force():
    rng = random.Random(14)
    for _ in range(400):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))]
        b = [w for w in a if rng.random() < 0.9] + [rng.choice("abcxyz") for _ in range(rng.randrange(3))]
        n = brute_lcs(a, b)
        assert overlap.lcs(a, b) == n and overlap.chained(a, b) <= n
        need = overlap._needed(max(len(a), len(b)))
        assert (overlap.aligned(a, b) >= need) == (n >= need)
    a = [f"w{i}" for i in range(5000)]
    b = a[:2000] + ["x"] * 300 + a[2500:]
    assert overlap.chained(a, b) == overlap.lcs(a, b) == 4500 and overlap.chained([], a) == 0
    assert set(overlap.fingerprints(a).values()) and len(overlap.fingerprints(a)) < len(a)


def test_overlap_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeğş") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.6:
            w = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(3 + len(w) // 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        else:
            w = [rng.choice(vocabulary[:: rng.choice([1, 9])]) for _ in range(rng.choice([4, 5, 8, 12, 30, 36, 60, 130, 160]))]
        rows.append((i, w or ["x"], rng.choice(["train", "dev", "Test ", None])))
    dress = lambda w: rng.choice(["{}", "  {}!", "{}..."]).format(rng.choice([" ", ", "]).join(w).upper() if rng.random() < 0.3 else " ".join(w))
    df = spark.createDataFrame([(i, s, "iwt", dress(w).replace("Ğ", "ğ"), None, None, "x") for i, w, s in rows] + [(900, "train", None, None, None, None, None), (901, "dev", None, "", None, None, None)], EXAMPLES)
    ws = {r["ex_id"]: textfold.words(r["raw_text"]) for r in df.collect()}
    side = {i: (s or "").strip().lower() for i, _, s in rows}
    want = set()
    for i in side:
        for j in side:
            if side[i] == "train" and side[j] in ("dev", "test") and min(len(ws[i]), len(ws[j])) >= 5 and 5 * brute_lcs(ws[i], ws[j]) >= 4 * max(len(ws[i]), len(ws[j])):
                want.add((min(i, j), max(i, j)))
    assert {tuple(r) for r in overlap.found(df).collect()} == want and len(want) > 30
    r = overlap.report(df).collect()
    assert sum(x["overlapping"] for x in r) == len({k for p in want for k in p if side[k] != "train"})
    assert overlap.found(df.limit(0)).count() == 0


def test_wanted_rows(spark):
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("s"))
    pairs = spark.createDataFrame([(3, 4000), (77, 9999)], "a long, b long")
    got = {r["id"] for r in pairs_of.wanted(rows, "id", pairs, "a", "b").collect()}
    assert {3, 77, 4000} <= got and len(got) < 20
    assert {r["s"] for r in pairs_of.wanted(rows, "s", pairs.select(F.col("a").cast("string").alias("s")), "s").collect()} >= {"3", "77"}
    assert pairs_of.wanted(rows, "id", pairs.limit(0), "a").count() == 0 and pairs_of.wanted(rows.limit(0), "id", pairs, "a").count() == 0


# 4


PEOPLE = ["bunu Elif Karasökmez söyledi", "— Hakan Karasökmez", "kayıt emre karasökmez adına", "Deniz Günsoyar geldi", "Zehra Günsoyar gitti", "tolga gunsoyar yazdı", "Karasökmez, Selin", "R. Karasökmez", "Bay Günsoyar"]
OTHERS = ["deniz bugün çok dalgalı", "yağmur ve rüzgâr dinmedi", "ırmak kıyısında kum", "barış ve umut dolu günler", "Sayın yolcularımız lütfen dikkat", "İpek yolu üzerinde", "defne yaprağı yakışır", "Belkar Holding işçi aldı"] * 40


def kinds(text):
    return {k for k, _, _, t, _ in privacy.spans(text) if t is None}


@pytest.mark.parametrize(
    "text, want",
    [("mail a.b@c.com", {"email"}), ("a_b (at) birim (nokta) test yaz", {"email"}), ("x[at]kutu.test", {"email"}), ("e-posta ＡＢ＠ｋｕｔｕ．ｔｅｓｔ", {"email"}), ("posta@ biçiminde", set()), ("@kus_gozlem", set()),
     ("0532 123 45 67", {"phone"}), ("tel: +90 576 220 86 43.", {"phone"}), ("(0 5 8 4 2 7 6 4 2 2 9)", {"phone"}), ("576-521-5175", {"phone"}), ("+44 7700 900356", {"phone"}), ("0(571) 419 87 85", {"phone"}),
     ("sipariş no 5712345678", set()), ("tarih 12.07.2023 saat 17:30", set()), ("ISBN 978-0-00-6859111-1", set()), ("sürüm 3.5.227.82", set()), ("kargo takip kodu 4440962376615", set()), ("fiyat 7063.884,50 TL", set()),
     ("TC kimlik no 31067835452", {"identity"}), ("tckn=587 987 855 72!", {"identity"}), ("pasaport Z16402703.", {"identity"}), ("kimliğim 51882.114343", {"identity"}),
     ("Nane Caddesi 105 D:34 Karaveli", {"address"}), ("48 Menekşe Sokak Akçabayır", {"address"}), ("Dereağzı Mahallesi, Söğütlü Sokağı, No 8", {"address"}), ("Fındıklı Cd. 71. blok kat 1 daire 36", {"address"}),
     ("7 numaralı otobüs cadde boyunca ilerler", set()), ("mahalle meydanı 225 metre", set()), ("sokak lambaları söndü", set()), ("<MASKED> <KIŞI>", set()), ("Elif Hanım geldi", {"name"}), ("Sayın Elif", {"name"}), ("", set())],
)
def test_spans(text, want):
    assert kinds(text) == want


def test_names_and_redaction(spark):
    e = examples(spark, [*PEOPLE, *OTHERS, None, "", "ara 0532 123 45 67, a@b.com yaz"])
    got = {r["ex_id"] for r in privacy.found(e).where("pii_type = 'name'").collect()}
    assert got == set(range(len(PEOPLE)))
    red = {r["ex_id"]: r["text"] for r in privacy.redacted(e).collect()}
    assert red[0] == "bunu <NAME> söyledi" and red[len(PEOPLE)] == OTHERS[0] and red[max(red)] == "ara <PHONE>, <EMAIL> yaz"
    assert privacy.found(e.limit(0)).count() == 0


def test_first_names_of_no_list(spark):
    known = [f"{w} {n} geldi" for n in ("Elif Karasökmez", "Hakan Karasökmez", "Zehra Günsoyar", "tolga günsoyar") for w in ("dün", "bugün")]
    new = ["mükremin karasökmez aradı", "sonra Mükremin  Günsoyar gitti", "dün nurettin günsoyar ile", "NURETTİN KARASÖKMEZ YAZDI"]
    none = ["akşam karasökmez aradı", "akşam günsoyar aradı", "mükremin dedi", *[f"akşam {w} geldi" for w in ("oldu", "yağmur", "herkes", "kimse")]]
    texts = [*known, *new, *none, *OTHERS]
    got = {r["ex_id"] for r in privacy.found(examples(spark, texts)).where("pii_type = 'name'").collect()}
    assert got == set(range(len(known) + len(new)))
    red = {r["ex_id"]: r["text"] for r in privacy.redacted(examples(spark, texts)).where("field_name = 'raw_text'").collect()}
    assert red[len(known)] == "<NAME> aradı" and red[len(known) + 1] == "sonra <NAME> gitti"


def test_offsets_are_of_the_stored_text():
    t = "x​ ağ ​Elif Hanım geldi"
    (_, s, e, _, _), = privacy.spans(t)
    assert t[s:e] == "Elif Hanım"


# 5


def test_trie():
    rng = random.Random(5)
    trie, want = terms.BurstTrie(4), Counter()
    for _ in range(3000):
        w = "".join(rng.choice("abç") for _ in range(rng.randrange(1, 6)))
        trie.add(w, 2, 1)
        want[w] += 1
    got = {p + s: (o, r) for p, ss, os_, rs in trie.subtrees() for s, o, r in zip(ss, os_, rs)}
    assert got == {w: (2 * n, n) for w, n in want.items()} and trie.size == len(want)


def test_terms(spark):
    e = spark.createDataFrame([(i, ["ve", "ve", f"t{i % 40}"] if i % 2 else ["ev", None, ""]) for i in range(120)] + [(200, None), (201, [])], "ex_id long, gold_tokens array<string>")
    t = spark.createDataFrame([(1, ["ve", "tek"]), (1, ["ve", "tek"]), (2, None)], "inst_id long, gold_tokens array<string>")
    r = {x["term"]: (x["occurrences"], x["records"], x["mark"]) for x in terms.counted(e, t).collect()}
    assert r["ve"] == (121, 61, "common") and r["tek"] == (1, 1, "rare") and r["t1"] == (3, 3, "common" if 3 > 0.02 * 124 else None) and "" not in r
    assert terms.found(e.limit(0), t.limit(0)).count() == 0


# 7


def passage_words(rng, n):
    return ["".join(rng.choice("abcdefğ") for _ in range(5)) for _ in range(n)]


def leak_frames(spark):
    rng = random.Random(7)
    items = {i: passage_words(rng, 40) for i in range(6)} | {6: passage_words(rng, 3)}
    items[5][10:12] = ["12", "kg"]
    fill = lambda n: passage_words(rng, n)
    ex = list(items[1][5:30])
    for k in (3, 15):
        ex[k] = "zzz"
    shuffled = list(items[2])
    rng.shuffle(shuffled)
    slots = [w if w != "12" else "99" for w in items[5]]
    docs = [(0, fill(30) + items[0] + fill(9)), (1, fill(5) + ex), (2, fill(9) + shuffled), (3, items[3][:9] + fill(40)), (4, fill(4) + [w.upper() for w in items[4][:21]]), (5, slots), (6, fill(3) + items[6] + fill(3)), (7, fill(50))]
    d = spark.createDataFrame([(i, "  ".join(w).replace("Ğ", "ğ"), "s") for i, w in docs] + [(8, None, "s"), (9, "", "s")], "doc_id long, text string, source string")
    t = spark.createDataFrame([(i, ("Soruyu okuyunuz.\n" if i % 2 else "") + " ".join(w), "t", "s") for i, w in items.items()] + [(50, None, "t", "s")], "item_id long, text string, task string, split string")
    return d, t


def test_repeated_windows_and_hidden_halves():
    rng = random.Random(8)
    table = [str(rng.randrange(1000, 10**6)) for _ in range(80)]
    refrain = passage_words(rng, 10) * 4
    found = lambda item, doc: [m[-1] for m in leakage.Index([(1, " ".join(item))]).matches(" ".join(doc))]
    assert found(table, passage_words(rng, 9) + table[40:]) == [True]  # the second half of a table of numbers
    assert found(passage_words(rng, 30) + table[:30], passage_words(rng, 9) + table[:30]) == [True]
    assert found(table, [str(int(w) + 10**7) for w in table[40:]]) != [True]
    assert found(passage_words(rng, 10) + refrain, passage_words(rng, 5) + refrain) == [True]
    item = [f"{w}'da" if i % 5 == 0 else w for i, w in enumerate(passage_words(rng, 60))]
    refilled = [f"{rng.randrange(9)}x'da" if "'" in w else w for w in item]
    assert found(item, refilled + passage_words(rng, 300) + item[:32]) == [True]


@pytest.mark.parametrize("n, share, want", [(20, 8, False), (20, 9, False), (20, 10, True), (40, 18, False), (40, 20, True), (8, 4, True), (8, 3, False), (27, 13, False), (27, 14, True), (3, 2, True), (1, 1, True)])
def test_half_of_a_passage(n, share, want):
    rng = random.Random(n * 100 + share)
    for _ in range(20):
        w = passage_words(rng, n)
        at = rng.randrange(n - share + 1)
        doc = passage_words(rng, 12) + w[at : at + share] + passage_words(rng, 12)
        assert bool(leakage.Index([(1, " ".join(w))]).matches(" ".join(doc))) == want


def test_long_drifting_stretch():
    rng = random.Random(21)
    w = passage_words(rng, 3000)
    doc = []
    for i, x in enumerate(w):
        doc += [x] if i % 15 else [x, *passage_words(rng, 2)]  # shifts by 400 words in the end
    (m,) = leakage.Index([(1, " ".join(w))]).matches(" ".join(doc))
    assert m[2] >= 1500 and m[-1]


def test_both_paths_give_equal_rows(spark):
    rng = random.Random(22)
    word = lambda: rng.choice(["ev", "su", "12", "kg", "dağ", "Ali'ye", *passage_words(rng, 1)])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 8, 30])))) for i in range(60)] + [(90, "1 2 3 4 5 6 7 8 9 10")]
    docs = []
    for i in range(120):
        t = rng.choice(items)[1].split()
        at = rng.randrange(len(t))
        docs.append((i, " ".join([word() for _ in range(9)] + t[at // 2 :] + [word() for _ in range(5)])))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda most: sorted(tuple(r) for r in leakage.matches(d, t, most).collect())
    assert rows(leakage.MAX_ITEMS) == rows(1) and len(rows(1)) > 60


@pytest.mark.parametrize("most", [leakage.MAX_ITEMS, 2])
def test_leakage(spark, most):
    d, t = leak_frames(spark)
    m = leakage.matches(d, t, most)
    assert {(r["doc_id"], r["item_id"]) for r in m.collect()} == {(0, 0), (1, 1), (4, 4), (5, 5), (6, 6)}
    r = m.where("doc_id = 5").collect()[0]
    assert r["slots_changed"] == 1 and r["consistent"]
    assert leakage.report(d, t).where("documents > 0").count() == 5 and leakage.found(d.limit(0), t).count() == 0 and leakage.found(d, t.limit(0)).count() == 0


# 8


def test_poisson():
    assert [mixture.poisson_quantile(u, 1.0, 9) for u in (0.1, 0.5, 0.8, 0.95)] == [0, 1, 2, 3] and mixture.poisson_quantile(0.999, 5.0, 2) == 2


@pytest.mark.skipif(not os.path.exists(f"/opt/tokenizers/{mixture.TOKENIZER}"), reason="no tokenizer")
def test_mixture(spark):
    d = spark.createDataFrame([(i, f"metin sayı {i} " * (1 + i % 7), ("a", "b", "c")[min(2, i % 10)], 1) for i in range(4000)] + [(9000, None, "a", 1), (9001, "x", None, 1), (9002, "", "a", 1)], "doc_id long, text string, source string, copy int")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 2), ("c", 0.25, 1), ("yok", 0.05, 2)], "source string, target_share double, max_repeat int")
    s = {r["source"]: r for r in mixture.shares(d, t).collect()}
    for k in "abc":
        assert s[k]["tokens"] == pytest.approx(s[k]["wanted"], rel=0.01) and s[k]["met"] and s[k]["most_copies"] <= s[k]["max_repeat"]
    assert s["yok"]["tokens"] == 0 and not s["yok"]["met"]
    m = mixture.mixed(d.drop("copy"), t)
    size = {r["source"]: r[1] for r in m.groupBy("source").agg(F.sum("n_tokens")).collect()}
    assert all(size[k] == s[k]["tokens"] for k in "abc")
    over = {r["source"]: r for r in mixture.shares(d, t, total_tokens=1e9).collect()}
    assert over["a"]["tokens"] == 3 * over["a"]["available"] and not over["a"]["met"]


# 9


VERBS = ["geldi", "gitti", "yapıyor", "görecekler", "bakmışım"]


def truncation_docs():
    rng = random.Random(9)
    noun = lambda: "".join(rng.choice("bdklmnrs") + rng.choice("aeıi") for _ in range(3))
    sentence = lambda: " ".join([noun() for _ in range(6)] + [rng.choice(VERBS)])
    body = lambda: ". ".join(sentence() for _ in range(5))
    whole = [body() + x for x in (".", "...", "", "!", " :)", ".\nSaygılarımla", ".\nSaygılarımla", ".\nSaygılarımla", ".\nSaygılarımla", " 😀") for _ in range(4)]
    whole += [body() + f". https://www.ornek.test/yazi/{k}" for k in range(20)] + [""]
    long = body() + ". " + body() + ". " + body() + "."
    whole.append(long)
    at = long.rindex(" ", 0, -20)
    cut = [body() + x for x in (". " + noun(), ", ", ". bir (", " &quo", ". https://www.ornek.te", ".\nSayg", ". " + noun() + " yapıy")]
    return whole, cut, long, at


def test_truncation(spark):
    whole, cut, _, _ = truncation_docs()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*whole, *cut])] + [(900, None, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"] for r in truncation.found(df).collect()}
    assert got == set(range(len(whole), len(whole) + len(cut)))
    r = truncation.rates(df).collect()[0]
    assert (r["documents"], r["truncated"]) == (len(whole) + len(cut), len(cut))
    assert truncation.found(df.limit(0)).count() == 0


def test_copies_that_end_early(spark):
    whole, _, _, _ = truncation_docs()
    long = " ".join(f"w{i}" for i in range(100)) + " geldi" + "ler. sonra gitti."
    short = " ".join(f"w{i}" for i in range(100)) + " geldi"
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*whole, short, long])], "doc_id long, text string, source string")
    r = {x["doc_id"]: x["reason"] for x in truncation.judged(df).where("truncated").collect()}
    assert r == {len(whole): "copy goes on"}


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_bands_recall(similarity):
    rng = random.Random(3)
    hit = 0
    for _ in range(1500):
        w = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        v = w[: 4 + round(200 * similarity)]  # of 200 shingles
        hit += bool(set(truncation.bands(" ".join(w))) & set(truncation.bands(" ".join(v))))
    assert hit >= 0.998 * 1500 and truncation.bands("a b") is None


def test_closing_does_not_depend_on_length():
    for n in (1, 30, 3000):
        fill = "kelime " * n
        assert truncation.closing(fill + "Saygılarımla") == ("open", "saygilarimla", None)
        assert truncation.closing(f"önce bitti. {fill}(bir {fill}yer")[0] == "cut"
        assert truncation.closing(f"önce (bir {fill}yer. sonra geldi")[0] == "open" and truncation.closing(f"güldü :( {fill}geldi")[0] == "open"
        assert truncation.closing("a\n" + fill + "son")[2] == fill + "son"
        assert truncation.closing("a" * n + "ş" * 3000)[1] == "a" * n + "s" * 3000
        assert truncation.closing(fill + "bitti." + "\"" * 20)[0] == "whole" and truncation.closing(fill + "&quo")[0] == "cut"


def test_copies_in_a_shared_bucket(spark, monkeypatch):
    # every text shares the buckets, the longest is unrelated, and the whole version has a long header of its own
    monkeypatch.setattr(truncation, "bands", lambda text, w=None: [1, 2])
    stem = " ".join(f"w{i}" for i in range(100))
    head = " ".join(f"h{i}" for i in range(13))
    other = " ".join(f"x{i}" for i in range(125)) + " gitti."
    rows = [stem + " geldi", stem.upper() + " geldi", f"{head} {stem} geldiler. sonra gitti.", other]
    rows += [" ".join(f"v{i}" for i in range(60)) + " yapıy", " ".join(f"v{i}" for i in range(60)) + " yapıyor :)"]  # as many words
    tail = " ".join(f"u{i}" for i in range(100))
    rows += [f"{head} {tail} yapıy", f"{tail} yapıyorlar."]  # the copy is longer than the whole version
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    r = {x["doc_id"]: x["reason"] for x in truncation.judged(df).where("truncated").collect()}
    assert {i for i, v in r.items() if v == "copy goes on"} == {0, 1, 4, 6}


def test_closing_lines_count_different_texts(spark):
    whole, _, _, _ = truncation_docs()
    rng = random.Random(11)
    body = lambda: " ".join("".join(rng.choice("bdkl") + rng.choice("aeı") for _ in range(3)) for _ in range(40)) + " geldi."
    tail = lambda: "".join(rng.choice("abcdef") for _ in range(8))
    rows = [*whole]
    copies = [len(rows) + i for i in range(4)]
    rows += [f"{body()}\nbadela kıbade"] * 4  # copies of one cut text don't vouch for each other
    links = [len(rows) + i for i in range(9)]
    rows += [f"{body()} https://www.kitap.te" for _ in range(9)]  # half of the links are cut, each whole one is another
    rows += [f"{body()} https://www.kitap.test/{tail()}" for _ in range(10)]
    rows += [f"{body()}\nHoşça kalın" for _ in range(4)] + [f"{body()}\nHoşça kalın {tail()}" for _ in range(13)]  # a whole line, whoever follows
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    r = {x["doc_id"]: x["reason"] for x in truncation.judged(df).where("truncated").collect()}
    assert set(copies) | set(links) <= set(r) and {r[i] for i in links} == {"line goes on"}
    lines = {x["line"]: (x["recurs"], x["continues"]) for x in truncation._lines(docs_of(df)).collect()}
    assert lines["hoşça kalın"] == (True, False)
    assert lines["https://www.kitap.te"] == (False, True)


def docs_of(df):
    return df.mapInPandas(truncation._scan, truncation._ROW).where("doc_id is not null")


def test_continued_lines_against_brute_force(spark):
    rng = random.Random(12)
    lines = {"".join(rng.choice("ab ş") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 5) for _ in range(300)}
    df = spark.createDataFrame(list(lines.items()), "line string, n long").repartitionByRange(5, "line").sortWithinPartitions("line")
    got = Counter()
    for r in df.mapInPandas(truncation._continued, "key long, next string, n long").collect():
        got[r["key"], r["next"]] += r["n"]
    keys = {r["line"]: r["k"] for r in df.select("line", F.xxhash64("line").alias("k")).collect()}
    want = Counter()
    for a in lines:
        for b, n in lines.items():
            if b != a and b.startswith(a):
                want[keys[a], None if a[-1].isalnum() and b[len(a)].isalnum() else truncation._NEXT.match(b, len(a))[0]] += n
    assert {k: n for k, n in got.items() if k[0] in set(keys.values())} == want


@pytest.mark.parametrize("copies, noise", [(1, ""), (2, ""), (9, ""), (3, "!")])
def test_copies_of_a_rare_name(spark, copies, noise):
    rows = [(i, t, None) for i, t in enumerate([*PEOPLE, *(f"{w} Elif Karasökmez geldi" for w in ("geldi", "gitti", "yazdı", "baktı", "sordu")), *OTHERS])]
    rows += [(1000 + k, "dün Elif Zortunb yazdı" + noise * k, "Dün Elif Zortunb yazdı." + noise * k) for k in range(copies)]
    e = spark.createDataFrame([(i, "train", "b", r, g, None, "x") for i, r, g in rows], EXAMPLES)
    got = {(r["ex_id"], r["field_name"]) for r in privacy.found(e).where("pii_type = 'name' and ex_id >= 1000").collect()}
    assert got == {(1000 + k, c) for k in range(copies) for c in ("raw_text", "gold_text")}
    red = {r["text"] for r in privacy.redacted(e).where("ex_id >= 1000").collect()}
    assert all("<NAME>" in t and "Zort" not in t for t in red)


@pytest.mark.parametrize("text", ["ali.veli (et) posta (nokta) com", "ali.veli[et]posta.com", "ali kuyruklu a posta nokta com"])
def test_mail_without_the_letters_at(text):
    assert kinds(text) == {"email"}
