"""Longest-suffix stemming with a suffix table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars

# Common endings for texts without a suffix table of their own.
SUFFIXES = (
    "lar ler ları leri ların lerin larım lerim larımız lerimiz larda lerde lardan lerden da de ta te dan den tan ten ın in un ün nın nin nun nün "
    "ım im um üm ımız imiz umuz ümüz la le yla yle a e ı i u ü yı yi yu yü ya ye yor yorum yoruz yorlar yordu dı di du dü tı ti tu tü dım dim dik dık "
    "mış miş muş müş acak ecek acağım eceğim acağız eceğiz acaklar ecekler mak mek lık lik luk lük lı li lu lü sız siz suz süz cı ci cu cü ki"
).split()


def suffix_pairs(tokens: DataFrame) -> DataFrame:
    """Suffixes of a treebank: what follows the lemma in the form (lower case), at least two letters, each once."""
    form, lemma = chars.tr_lower(F.col("form"), "ii"), chars.tr_lower(F.col("lemma"), "ii")
    rest = F.substring(form, F.length(lemma) + 1, F.length(form))
    rows = tokens.where(F.col("form").isNotNull() & F.col("lemma").isNotNull() & (F.coalesce("upos", F.lit("")) != "AUX"))
    return rows.where(F.startswith(form, lemma)).select(rest.alias("suffix")).where(F.length("suffix") > 1).distinct()


def literal_suffixes(words: DataFrame) -> DataFrame:
    return words.sparkSession.createDataFrame([(s,) for s in SUFFIXES], "suffix string")


def stems(words: DataFrame, suffixes: DataFrame, column: str = "word") -> DataFrame:
    """word, stem of every distinct word. Text before an apostrophe is its stem; else the longest suffix that leaves two
    letters of a word of over three is cut, the end hardened and the whole lower-cased. Null words have no row.

    Only the distinct words meet the suffix table, on equal endings of the lengths that occur, so the join is a hash
    join however large either side is.
    """
    distinct = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    lengths = [r[0] for r in suffixes.select(F.length("suffix").alias("n")).distinct().orderBy("n").collect() if r[0]]  # bounded by word length
    w = F.col("word")
    plain = distinct.where(~w.contains("'") & (F.length(w) > 3))
    ends = plain.select(w, F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array(F.lit(0))).alias("n")).where(F.length(w) - F.col("n") >= 2)
    ends = ends.withColumn("suffix", F.expr("right(word, n)"))
    best = ends.join(suffixes.select("suffix").distinct(), "suffix", "left_semi").groupBy("word").agg(F.max("n").alias("n"))
    j = distinct.join(best, "word", "left")
    cut = F.left(w, F.length(w) - F.coalesce("n", F.lit(0)))
    stem = F.when(w.contains("'"), F.substring_index(w, "'", 1)).otherwise(chars.tr_lower(chars.final_devoicer(cut), "ii"))
    return j.select("word", stem.alias("stem"))


def stem_column(c: Column, suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> Column:
    """The same as an expression for a small list of suffixes (it is compiled into one pattern)."""
    alternatives = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    cut = F.when(F.length(c) > 3, F.regexp_replace(c, f"(?<=.{{2}})(?:{alternatives})$", "")).otherwise(c)
    return F.when(c.contains("'"), F.substring_index(c, "'", 1)).otherwise(chars.tr_lower(chars.final_devoicer(cut), "ii"))
