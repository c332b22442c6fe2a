"""File formats: treebanks, noisy/gold pairs, lists, tables with preambles, dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))


def table(spark: SparkSession, path: str, columns: str, sep: str = "\t") -> DataFrame:
    """Delimited rows without comments; missing cells are null."""
    return spark.read.csv(path, schema=columns, sep=sep, comment="#", quote="")


def word_set(spark: SparkSession, path: str | None, least_words: int = 1) -> DataFrame:
    """word: distinct trimmed lines; a missing path gives no rows. least_words 2 keeps multi-word expressions."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], "word string")
    w = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    return w.where(F.size(chars.ws_tokens(F.col("word"))) >= least_words)


def gazetteer(spark: SparkSession, path: str, name: str) -> DataFrame:
    w = word_set(spark, path).select(F.lit(name).alias("gazetteer"), chars.tr_lower(chars.normalize_unicode(F.col("word"))).alias("word"))
    return w.distinct()


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """source, target: the first tab divides; lines without one are skipped."""
    v = lines(spark, path).where(F.contains("value", F.lit("\t"))).select(F.split("value", "\t", 2).alias("v"))
    return v.select(F.col("v")[0].alias("source"), F.col("v")[1].alias("target"))


def suffixes(spark: SparkSession, path: str | None) -> DataFrame:
    """suffix; a header cell 0 is no suffix."""
    return word_set(spark, path).where("word <> '0'").withColumnRenamed("word", "suffix")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """One row per sentence: sent_id, text, tokens (id, form, lemma, upos, head, deprel, misc). Sentences are blocks
    between blank lines; ranges and empty nodes and rows with under eight cells are left out, a bad head is 0; a
    missing text is rebuilt from the forms and their SpaceAfter."""
    # a block ends at an empty line, in files of either line end; what else a line end leaves at its edges is cut
    blocks = spark.read.text(path, lineSep="\n\n").select(F.explode(F.split("value", "\r\n\r\n")).alias("value")).where(~F.col("value").rlike(r"^\s*$"))
    blocks = blocks.select(F.regexp_replace("value", "\r", "").alias("value"))
    ls = F.split("value", "\n")
    meta = lambda k: F.regexp_extract("value", rf"(?m)^#\s*{k}\s*=\s*(.*?)\s*$", 1)
    cells = F.filter(F.transform(F.filter(ls, lambda x: ~x.startswith("#") & (x != "")), lambda x: F.split(x, "\t")), lambda c: (F.size(c) >= 8) & ~F.get(c, F.lit(0)).rlike("[-.]"))
    token = F.transform(
        cells,
        lambda c: F.struct(
            F.get(c, F.lit(0)).try_cast("int").alias("id"), F.get(c, F.lit(1)).alias("form"), F.get(c, F.lit(2)).alias("lemma"), F.get(c, F.lit(3)).alias("upos"),
            F.coalesce(F.get(c, F.lit(6)).try_cast("int"), F.lit(0)).alias("head"), F.get(c, F.lit(7)).alias("deprel"), F.get(c, F.lit(9)).alias("misc"),
        ),
    )
    rows = blocks.select(F.nullif(meta("sent_id"), F.lit("")).alias("sent_id"), meta("text").alias("t"), token.alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("sent_id", F.when(F.col("t") != "", F.col("t")).otherwise(surface(F.col("tokens"))).alias("text"), "tokens")


def surface(tokens):
    """Text of dependency tokens: no blank after a token marked SpaceAfter=No."""
    return F.rtrim(F.array_join(F.transform(tokens, lambda t: F.concat(t["form"], F.when(F.coalesce(t["misc"].contains("SpaceAfter=No"), F.lit(False)), "").otherwise(" "))), ""))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_key, line_no, value: the lines of every file in its order. line_no rises within a file and may have gaps; it
    depends on the file's own splits only, so several files don't disturb each other."""
    v = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_key"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_n"), "value")
    first = v.groupBy("file_key", "_s").agg(F.min("_n").alias("_m"))  # one row a split
    v = v.join(F.broadcast(first), ["file_key", "_s"])
    # a line is longer than nothing, so a split begins with a number no line before it reaches
    return v.select("file_key", (F.col("_s") + F.col("_n") - F.col("_m")).alias("line_no"), "value")


def pair_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, file_key, is_begin, raw, gold of files of noisy and gold columns; the last two cells count."""
    c = F.split("value", "\t")
    v = numbered_lines(spark, path).where(~F.col("value").rlike("^#") & (F.size(c) >= 2))
    return v.select("line_no", "file_key", F.startswith("value", F.lit("<sentBegin>")).alias("is_begin"), F.element_at(c, -2).alias("raw"), F.element_at(c, -1).alias("gold"))


#: Lines of a file that one task numbers at a time.
BLOCK = 100_000


def pair_sentences(pairs: DataFrame) -> DataFrame:
    """file_key, sentence, raw and gold token arrays: a sentence begins at each begin mark of its file. Repeated lines
    (same number) count once; null tokens and the gold _ are left out of their side.

    Begin marks are counted within blocks of lines first, and the counts of earlier blocks of the file are added, so no
    task numbers a whole file.
    """
    rows = pairs.dropDuplicates(["file_key", "line_no"]).withColumn("_b", F.floor(F.col("line_no") / BLOCK))
    mark = F.coalesce(F.col("is_begin"), F.lit(False)).cast("long")
    within = Window.partitionBy("file_key", "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy("file_key", "_b").agg(F.sum(mark).alias("marks"))
    before = Window.partitionBy("file_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_key", "_b", F.coalesce(F.sum("marks").over(before), F.lit(0)).alias("_before"))  # a row a block
    rows = rows.withColumn("_w", F.sum(mark).over(within)).join(blocks, [F.equal_null(rows["file_key"], blocks["file_key"]), rows["_b"] == blocks["_b"]]).drop(blocks["file_key"]).drop(blocks["_b"])
    g = rows.groupBy("file_key", (F.col("_before") + F.col("_w")).alias("sentence")).agg(F.array_sort(F.collect_list(F.struct("line_no", "raw", "gold"))).alias("t"))
    side = lambda n: F.filter(F.transform("t", lambda x: x[n]), lambda x: x.isNotNull() & (x != "_"))
    return g.select("file_key", "sentence", side("raw").alias("raw"), side("gold").alias("gold"))


def zipped_pairs(sentences: DataFrame) -> DataFrame:
    """raw, gold: the tokens of (raw, gold) arrays side by side; sentences whose sides differ in length are left out."""
    same = sentences.where(F.size("raw") == F.size("gold"))
    return same.select(F.explode(F.arrays_zip("raw", "gold")).alias("p")).select("p.raw", "p.gold")


def examples(*parts: tuple[DataFrame, str]) -> DataFrame:
    """raw_text, gold_text, gold_tokens, domain, sent_id of several (sentences, domain) sources together."""
    out = None
    for df, domain in parts:
        tokens = F.transform("tokens", lambda t: t["form"]) if "tokens" in df.columns else F.col("gold")
        text = F.col("text") if "text" in df.columns else chars.join_simple(F.col("raw"))
        gold = F.col("text") if "text" in df.columns else chars.join_simple(F.col("gold"))
        sent = F.col("sent_id") if "sent_id" in df.columns else F.lit(None).cast("string")
        part = df.select(text.alias("raw_text"), gold.alias("gold_text"), tokens.alias("gold_tokens"), F.lit(domain).alias("domain"), sent.alias("sent_id"))
        out = part if out is None else out.unionByName(part)
    return out


def first_sentences(sentences: DataFrame, most: int, key: str = "sent_id") -> DataFrame:
    """The first ``most`` sentences by key (a limit of the feature)."""
    return sentences.orderBy(key).limit(most)


def for_tokenization(rows: DataFrame, domains: list[str] | None = None, most: int | None = None, key: str = "ex_id") -> DataFrame:
    """Examples of the domains with tokens; at most ``most`` by key (a limit of the feature)."""
    d = F.lower(F.trim("domain"))
    rows = rows.where(F.col("raw_text").isNotNull() & (F.size(F.coalesce("gold_tokens", F.array())) > 0))
    rows = rows.where(d.isin(*domains)) if domains else rows
    return rows.orderBy(key).limit(most) if most is not None else rows


def header_table(spark: SparkSession, path: str, sep: str = "\t", required: str | None = None) -> DataFrame:
    """A table with its header names trimmed, lower-cased, blanks as underscores; without the required one: no rows."""
    df = spark.read.csv(path, header=True, sep=sep, quote="")
    df = df.toDF(*("_".join(c.strip().lower().split()) for c in df.columns))
    return df if required is None or required in df.columns else df.limit(0).withColumn(required, F.lit(None).cast("string"))


def frequency_list(spark: SparkSession, path: str, sep: str | None = None, key: str = "word") -> DataFrame:
    """word, frequency of a list with a preamble: rows after the header line that names word or lemma and frequency (else
    from the fourth line, word and frequency in its second and third cell); unreadable rows are dropped. Without sep the
    header's most frequent sign of comma, tab and semicolon divides."""
    v = numbered_lines(spark, path)
    head = v.where(F.lower("value").rlike(r"(word|lemma)") & F.lower("value").contains("freq"))
    heads = {r["file_key"]: (r["n"], r["v"]) for r in head.groupBy("file_key").agg(F.min("line_no").alias("n"), F.min_by("value", "line_no").alias("v")).collect()}  # a row a file
    out = None
    for name in [r["file_key"] for r in v.select("file_key").distinct().collect()]:
        n, line = heads.get(name, (None, ""))
        cut = sep or _divider(line)
        at, freq = _columns([c.strip().lower() for c in line.split(cut)] if line else ["number", "word", "frequency"], key)
        part = _frequencies(v.where(F.col("file_key") == name).where(F.col("line_no") > (n if n is not None else 2)), cut, at, freq)
        part = part.withColumn("frequency", F.col("frequency").try_cast("bigint")).where("frequency is not null")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "word string, frequency bigint")


def _divider(line: str | None) -> str:
    return max(",\t;", key=(line or "").count)


def _columns(names: list[str], key: str) -> tuple[int, int]:
    """Places of the word and its frequency: by name, else the first and second column."""
    others = [k for k in (key, "word", "lemma") if k in names]
    at = names.index(others[0]) if others else 0
    return at, next((i for i, c in enumerate(names) if "freq" in c), min(1, len(names) - 1))


def _frequencies(rows: DataFrame, sep: str, at: int, freq: int) -> DataFrame:
    cells = F.split("value", "\\" + sep if sep == "|" else sep)
    rows = rows.where(F.size(cells) > max(at, freq))
    return rows.select(F.trim(F.get(cells, F.lit(at))).alias("word"), F.trim(F.get(cells, F.lit(freq))).alias("frequency"))


def vocabulary_list(spark: SparkSession, path: str, lemmas: bool = False) -> DataFrame:
    """word, freq of a list whose first line is its header: divided by comma, tab or semicolon, whichever the header has
    most of; the word or lemma column by name, else the first; the freq column, else the second. Frequencies that are no
    numbers count 0; equal case-folded words are added."""
    v = numbered_lines(spark, path)
    first = v.orderBy("line_no").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "word string, freq bigint")
    line = first[0]["value"].lstrip("\ufeff")
    sep = _divider(line)
    at, freq = _columns([c.strip().lower() for c in line.split(sep)], "lemma" if lemmas else "word")
    rows = _frequencies(v.where(F.col("line_no") > first[0]["line_no"]), sep, at, freq).where("word <> ''")
    f = F.coalesce(F.col("frequency").try_cast("double").cast("bigint"), F.lit(0))
    return rows.groupBy(chars.tr_lower(F.col("word"), "casefold").alias("word")).agg(F.sum(f).alias("freq"))


def title_dump(spark: SparkSession, path: str) -> DataFrame:
    """title of every usable line of a dump of page titles."""
    t = spark.read.text(path).select(chars.normalize_title_line(F.col("value")).alias("title"))
    return t.where("title <> ''")


def label_table(spark: SparkSession, path: str, column: str = "label") -> DataFrame:
    """title of a table of labels (tabs in .tsv files, else commas): the named column, else the first."""
    df = spark.read.csv(path, header=True, sep="\t" if path.lower().rstrip("/*").endswith(".tsv") else ",")
    if not df.columns:
        return spark.createDataFrame([], "title string")
    named = F.col(f"`{column if column in df.columns else df.columns[0]}`")
    return df.select(F.trim(chars.sanitize(F.trim(named))).alias("title")).where(F.col("title").rlike(r"\p{L}"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """title: the first cell of every line (tabs in .tsv files, else commas) that holds a letter."""
    sep = "\t" if path.lower().rstrip("/*").endswith(".tsv") else ","
    t = spark.read.text(path).select(F.trim(chars.sanitize(F.get(F.split(F.trim("value"), sep), F.lit(0)))).alias("title"))
    return t.where(F.col("title").rlike(r"\p{L}"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of every text file under a folder."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def places(spark: SparkSession, path: str) -> DataFrame:
    """title: names and comma-separated alternates (columns 1 and 3) of a place dump."""
    v = spark.read.text(path).select(F.split("value", "\t").alias("v"))
    names = F.array_union(F.array(F.get("v", F.lit(1))), F.split(F.coalesce(F.get("v", F.lit(3)), F.lit("")), ","))
    return v.select(F.explode(F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != ""))).alias("title"))


# SQL dumps ----------------------------------------------------------------------------------------------------

# Escapes of quoted SQL strings.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def tuples(statement: str) -> list[list[str | None]]:
    """The value tuples of an INSERT statement; quotes, escapes, commas and parentheses inside strings are read as such."""
    i = statement.upper().find("VALUES")
    out: list[list[str | None]] = []
    if i < 0:
        return out
    i, n = i + 6, len(statement)
    while i < n:
        if statement[i] != "(":
            i += 1
            continue
        row: list[str | None] = []
        i += 1
        while i < n:
            while i < n and statement[i] in " \t\r\n":
                i += 1
            if i < n and statement[i] == "'":
                part, i = [], i + 1
                while i < n:
                    c = statement[i]
                    if c == "\\" and i + 1 < n:
                        part.append(_ESCAPES.get(statement[i + 1], statement[i + 1]))
                        i += 2
                    elif c == "'":
                        if statement[i + 1 : i + 2] == "'":
                            part.append("'")
                            i += 2
                            continue
                        i += 1
                        break
                    else:
                        part.append(c)
                        i += 1
                row.append("".join(part))
                while i < n and statement[i] not in ",)":
                    i += 1
            else:
                j = i
                while j < n and statement[j] not in ",)":
                    j += 1
                cell = statement[i:j].strip()
                row.append(None if cell.upper() == "NULL" else cell)
                i = j
            if i < n and statement[i] == ",":
                i += 1
                continue
            i += 1
            break
        out.append(row)
    return out


def sql_dump(spark: SparkSession, path: str, columns: list[str], relation: str | None = None) -> DataFrame:
    """Rows of the INSERT statements (one a line) of a dump, gz included, the first cells named; others are dropped."""
    v = spark.read.text(path).where(F.col("value").rlike(r"(?i)^\s*insert\s+into"))
    if relation:
        v = v.where(F.col("value").rlike(rf"(?i)^\s*insert\s+into\s+`?{relation}`?"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [t[: len(columns)] for s in pdf["value"] for t in tuples(s) if len(t) >= len(columns)]
            yield pd.DataFrame(rows, columns=columns)

    return v.mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def frequency_json(spark: SparkSession, path: str) -> DataFrame:
    """word, freq of a JSON object of numbers (one object a file)."""
    v = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return v.select(F.explode("m").alias("word", "freq")).where("freq is not null")
