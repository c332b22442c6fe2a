import gzip

from pyspark.sql import functions as F

from dokuma.operators import features
from dokuma.plans import builders, pipeline
from dokuma.sources import readers, sinks
from dokuma.streaming import texts

CONLLU = """# sent_id = s1
# text = 1936 yılındayız.
1\t1936\t1936\tNUM\t_\t_\t2\tnummod\t_\t_
2-3\tyılındayız\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No
2\tyılında\tyıl\tNOUN\t_\t_\tx\troot\t_\t_
3\tyız\ti\tAUX\t_\t_\t2\tcop\t_\tSpaceAfter=No
4\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_

# sent_id = s2
1\tEv\tev\tNOUN\t_\t_\t0\troot\t_\tSpaceAfter=No
2\t!\t!\tPUNCT\t_\t_\t1\tpunct\t_\t_
"""


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU)
    rows = {r["sent_id"]: r for r in readers.conllu(spark, str(tmp_path / "a.conllu")).collect()}
    assert rows["s1"]["text"] == "1936 yılındayız." and [t["form"] for t in rows["s1"]["tokens"]] == ["1936", "yılında", "yız", "."]
    assert rows["s1"]["tokens"][1]["head"] == 0 and rows["s2"]["text"] == "Ev!"


def test_pairs_and_examples(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# x\n<sentBegin>\tSlm\tSelam\nnbr\tne haber\n\n<sentBegin>\tev\t_\n")
    s = readers.pair_sentences(readers.pair_lines(spark, str(tmp_path / "p.txt")))
    assert [(r["raw"], r["gold"]) for r in s.orderBy("sentence").collect()] == [(["Slm", "nbr"], ["Selam", "ne haber"]), (["ev"], [])]
    (tmp_path / "a.conllu").write_text(CONLLU)
    e = readers.examples((readers.conllu(spark, str(tmp_path / "a.conllu")), "boun"), (s, "iwt"))
    assert e.count() == 4 and e.where("domain = 'iwt'").orderBy("raw_text").first()["raw_text"] == "Slm nbr"


def test_lists(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# c\nslm\tselam\tx\nbozuk\n\n")
    assert [tuple(r) for r in readers.lexicon(spark, str(tmp_path / "l.tsv")).collect()] == [("slm", "selam\tx")]
    (tmp_path / "s.txt").write_text("0\nlar\nlar\n ler \n")
    assert sorted(r[0] for r in readers.suffixes(spark, str(tmp_path / "s.txt")).collect()) == ["lar", "ler"]
    assert readers.suffixes(spark, None).count() == 0 and readers.word_set(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "f.csv").write_text("liste\nx\nNumber,Word,Frequency\n1,ve,10\n2,bozuk\n3,bir,x\n4,ev,3\n")
    assert [tuple(r) for r in readers.frequency_list(spark, str(tmp_path / "f.csv")).collect()] == [("ve", 10), ("ev", 3)]
    (tmp_path / "h.tsv").write_text(" Query Item \tN\nslm\t1\n")
    assert readers.header_table(spark, str(tmp_path / "h.tsv"), required="query_item").collect()[0]["query_item"] == "slm"
    (tmp_path / "g.txt").write_text("1\tAnkara\tx\tAngora,Ancyra\n")
    assert sorted(r[0] for r in readers.places(spark, str(tmp_path / "g.txt")).collect()) == ["Ancyra", "Angora", "Ankara"]


def test_sql_dump(spark, tmp_path):
    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write("-- x\nINSERT INTO `page` VALUES (1,0,'O\\'Neil (a),b','x'),(2,14,NULL),(3);\nINSERT INTO `other` VALUES (9,9,'z');\n")
    d = readers.sql_dump(spark, str(tmp_path / "d.sql.gz"), ["id", "namespace", "title"], "page")
    assert [tuple(r) for r in d.collect()] == [("1", "0", "O'Neil (a),b"), ("2", "14", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 9)], "word string, freq long")
    sinks.write_vocabulary(df, str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "v/vocabulary")).collect()] == ["a", "b", "c"]
    assert dict(readers.frequency_json(spark, str(tmp_path / "v/frequencies")).collect()) == {"c": 9, "a": 1, "b": 1}
    sinks.write_tsv(df, str(tmp_path / "t"), ["word"], header=True)
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 3
    sinks.write_pages(df.select(F.col("word").alias("title"), "freq"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.write_model({"m": df}, str(tmp_path / "m"))
    assert sinks.read_model(spark, ["m"], str(tmp_path / "m"))["m"].count() == 3


def test_blocks_of_either_line_end(spark, tmp_path):
    (tmp_path / "w.conllu").write_bytes(CONLLU.replace("\n", "\r\n").encode())
    (tmp_path / "u.conllu").write_text(CONLLU + "\n\n")
    both = [sorted((r["sent_id"], r["text"], len(r["tokens"])) for r in readers.conllu(spark, str(tmp_path / f)).collect()) for f in ("w.conllu", "u.conllu")]
    assert both[0] == both[1] and len(both[0]) == 2
    assert [r["sent_id"] for r in readers.first_sentences(readers.conllu(spark, str(tmp_path / "u.conllu")), 1).collect()] == ["s1"]


def test_lines_of_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.txt").write_text("".join(f"<sentBegin>\ta{k}{i}\tA{k}{i}\nb\tB\n" for i in range(4)))
    lines = readers.pair_lines(spark, str(tmp_path / "*.txt"))
    assert lines.groupBy("file_key").agg(F.count_distinct("line_no").alias("n")).where("n = 8").count() == 3
    s = readers.pair_sentences(lines)
    assert s.count() == 12 and s.where("size(raw) = 2 and raw[1] = 'b'").count() == 12
    (tmp_path / "big.txt").write_text("".join(f"w{i}\tW{i}\n" for i in range(3000)))
    n = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        order = [r["value"] for r in readers.numbered_lines(spark, str(tmp_path / "big.txt")).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    assert order == [f"w{i}\tW{i}" for i in range(3000)]


def test_sentences_across_blocks(spark, monkeypatch):
    rows = [("f", i, i % 3 == 0, f"r{i}", f"g{i}") for i in range(20)] + [(None, 0, None, "x", "_"), (None, 0, None, "x", "_")]
    df = spark.createDataFrame(rows, "file_key string, line_no long, is_begin boolean, raw string, gold string")
    whole = sorted((str(r["file_key"]), r["sentence"], r["raw"], r["gold"]) for r in readers.pair_sentences(df).collect())
    monkeypatch.setattr(readers, "BLOCK", 4)
    assert sorted((str(r["file_key"]), r["sentence"], r["raw"], r["gold"]) for r in readers.pair_sentences(df).collect()) == whole
    assert whole[0][2] == ["x"] and len(whole) == 8 and whole[2][2] == ["r3", "r4", "r5"] or whole[1][2] == ["r0", "r1", "r2"]
    pairs = readers.zipped_pairs(spark.createDataFrame([(["a", "b"], ["A", "B"]), (["a"], []), ([], []), (None, ["x"])], "raw array<string>, gold array<string>"))
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "A"), ("b", "B")]


def test_vocabulary_lists(spark, tmp_path):
    for name, text in {"a.csv": "Word,Freq\nEv,3\nev,2.7\nsu,x\n,4\n", "b.tsv": "lemma\tfreq\nEv\t5\nsu\t0\n", "c.txt": "kelime;sayı\nev;5\nsu;yok\n"}.items():
        (tmp_path / name).write_text(text)
        assert dict(readers.vocabulary_list(spark, str(tmp_path / name), name == "b.tsv").collect()) == {"ev": 5, "su": 0}
    (tmp_path / "empty.csv").write_text("")
    assert readers.vocabulary_list(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "l.csv").write_text("id,label\n1, Ankara \n2,12\n3,\n")
    (tmp_path / "m.tsv").write_text("title\tid\nİzmir\t1\n")
    title = lambda f: sorted(r["title"] for r in f.collect())
    assert title(readers.label_table(spark, str(tmp_path / "l.csv"))) == ["Ankara"] and title(readers.label_table(spark, str(tmp_path / "m.tsv"))) == ["İzmir"]
    (tmp_path / "n.tsv").write_text("Ali Kaya\t1\n12\tx\n")
    (tmp_path / "t.txt").write_text("Mavi_Ev\n12\nMavi_Ev\n")
    assert title(readers.name_list(spark, str(tmp_path / "n.tsv"))) == ["Ali Kaya"] and title(readers.title_dump(spark, str(tmp_path / "t.txt"))) == ["Mavi Ev", "Mavi Ev"]


def test_builders(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    lines = lambda n: sorted(r[0] for r in spark.read.text(at(n)).collect())
    (tmp_path / "titles.txt").write_text("Ankara\nMavi_Ev\nTBMM\nev\n")
    (tmp_path / "places.txt").write_text("1\tBursa\tx\tBrusa,Prusa\n")
    builders.main(["gazetteer", "--titles", at("titles.txt"), "--labels", at("none.csv"), "--places", at("places.txt"), "--out", at("g")], spark)
    assert lines("g/titles") == ["Ankara", "Brusa", "Bursa", "Prusa", "TBMM", "ev"] and lines("g/words") == ["Ankara", "Brusa", "Bursa", "Prusa", "TBMM"]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("ev ev su ev2 " * 3)
    builders.main(["safe-vocabulary", "--texts", at("texts"), "--least", "4", "--out", at("s")], spark)
    assert lines("s/vocabulary") == ["ev"]
    reject = lambda df, c: df.withColumn(f"{c}_ok", F.lit(False))
    builders.safe_vocabulary(spark, at("s"), at("texts"), 1, reject)
    assert lines("s/vocabulary") == []
    (tmp_path / "f.csv").write_text("x\ny\nNumber,Word,Frequency\n1,ve,10\n2,ev,1\n")
    builders.main(["wordlist", "--frequencies", at("f.csv"), "--out", at("w")], spark)
    assert lines("w") == ["ve\t10", "word\tfrequency"]
    (tmp_path / "a.conllu").write_text(CONLLU)
    (tmp_path / "p.txt").write_text("<sentBegin>\tslm\tselam\n")
    builders.main(["lexicon", "--treebank", at("a.conllu"), "--pairs", at("p.txt"), "--out", at("l")], spark)
    assert "slm\tselam" in lines("l") and "ev\tEv" in lines("l")
    (tmp_path / "q.tsv").write_text("Query Item\tn\ncok\t1\n\t2\n")
    (tmp_path / "v.tsv").write_text("word\tfreq\nçok\t9\n")
    builders.main(["tweet-lexicon", "--words", at("q.tsv"), "--vocabulary", at("v.tsv"), "--out", at("t")], spark)
    assert lines("t")[0].split("\t")[:3] == ["cok", "çok", "çok"]
    (tmp_path / "pages.sql").write_text("INSERT INTO `page` VALUES (1,0,'Mavi_Ev'),(2,14,'x');\n")
    (tmp_path / "links.sql").write_text("INSERT INTO `l` VALUES (1,'Evler'),(2,'x');\n")
    builders.main(["pages", "--dump", at("pages.sql"), "--links", at("links.sql"), "--out", at("c")], spark)
    assert lines("c") == ["1\tMavi Ev\tevler", "page_id\ttitle\tcategories"]


def test_models_and_page_files(spark, tmp_path):
    assert sinks.read_model(spark, ["m"], str(tmp_path / "none")) is None and sinks.read_regression(spark, str(tmp_path / "none")) is None
    sinks.write_regression(spark, features.Linear([1.0, 2.0, 0.0, 0.0, 0.0, 0.5], -1.5), str(tmp_path / "r"))
    m = sinks.read_regression(spark, str(tmp_path / "r"))
    assert m.coefficients == [1.0, 2.0, 0.0, 0.0, 0.0, 0.5] and m.intercept == -1.5
    pages = spark.createDataFrame([("Mavi Ev", "metin"), ("boş", " "), ("a/b", "x"), (None, "y")], "title string, text string")
    assert sorted(r["file"] for r in sinks.write_page_files(pages, str(tmp_path / "f")).collect()) == ["Mavi_Ev", "ab"]
    assert (tmp_path / "f/Mavi_Ev.txt").read_text() == "metin" and len(list((tmp_path / "f").iterdir())) == 2


def test_pipeline_with_models(spark):
    docs = spark.createDataFrame([(1, "Evler güzel. Ali geldi!"), (2, None), (3, "")], "ex_id int, raw_text string")
    lex, freq = spark.createDataFrame([("x", "x")], "key string, target string"), spark.createDataFrame([("x", 3)], "word string, freq long")
    data = [(1, "Ev güzel.", [2, 8, 9]), (2, "Su az.", [2, 5, 6])]
    bayes = features.nb_fit(spark.createDataFrame(data, "inst_id int, text string, boundaries array<int>"))
    rule = features.Linear([1.0, 0.0, 0.0, 0.0, 0.0, 0.0], -0.5)  # a sentence ends at each mark
    suffixes = spark.createDataFrame([("ler",), ("di",)], "suffix string")
    r = {x["ex_id"]: x for x in pipeline.process(docs, lex, freq, suffixes=suffixes, splitter=rule).collect()}
    assert r[1]["sentences"] == [["Evler", "güzel", "."], ["Ali", "gel", "di", "!"]] or r[1]["sentences"] == [["Evler", "güzel", "."], ["Ali", "geldi", "!"]]
    assert r[1]["stems"][0] == ["ev", "güzel", "."] and r[2]["tokens"] is None and r[3]["sentences"] == []
    b = {x["ex_id"]: x for x in pipeline.process(docs, lex, freq, suffixes=suffixes, tokenizer=bayes, splitter=rule).collect()}
    assert "".join(b[1]["tokens"]) == "Evlergüzel.Aligeldi!" and len(b[1]["sentences"]) >= 1 and b[2]["tokens"] is None


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b  c"), (2, None), (3, "")], "doc_id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    texts.run(spark, str(tmp_path / "in"), "doc_id int, text string", str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    key = lambda d: sorted(((r["doc_id"], r["clean"], r["tokens"]) for r in d.collect()), key=lambda r: r[0])
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(texts.cleaned(df))


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "Kardesim geldi. Evler güzel!"), (2, None), (3, "")], "ex_id int, raw_text string")
    lex = spark.createDataFrame([("kardesim", "kardeşim")], "key string, target string")
    freq = spark.createDataFrame([("kardeşim", 3)], "word string, freq long")
    r = {x["ex_id"]: x for x in pipeline.process(docs, lex, freq).collect()}
    assert r[1]["normalized"] == "Kardesim geldi. Evler güzel!".replace("Kardesim", "Kardeşim") and len(r[1]["sentences"]) == 2 and r[2]["tokens"] is None and r[3]["tokens"] == []
    light = {x["ex_id"]: x for x in pipeline.process_light(docs).collect()}
    assert light[1]["stems"][2] == "." and light[3]["content"] == []
