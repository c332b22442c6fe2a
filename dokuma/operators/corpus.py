"""Vocabularies, frequencies, lexicons and gazetteers derived from corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars

# Placeholders that are no words.
SKIPPED = ("<URL>", "<EMAIL>", "<NUM>", "<PCT>", "<MONEY>", "<DATE>", "<TIME>", "<PHONE>")
# Common function words.
STOPWORDS = (
    "acaba ama ancak aslında az bazı belki ben beni benim beri bile bir biri birkaç birşey biz bu bunu bunun çok çünkü da daha de defa diye "
    "eğer en fakat gibi hem hep hepsi her hiç için ile ise kez ki kim mı mi mu mü nasıl ne neden nerde nerede nereye niçin niye o onlar onu oysa "
    "sanki siz sonra şey şu tüm ve veya ya yani yoksa zaten"
).split()


def word_counts(texts: DataFrame, column: str = "text", least: int = 1) -> DataFrame:
    """word, freq of the lower-cased runs of letters."""
    words = texts.select(F.explode(chars.letter_runs(chars.tr_lower(F.col(column)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def is_ignorable(c: Column, longest: int = 40) -> Column:
    """Empty, too long, a placeholder, punctuation only, or wholly an address, mail or number."""
    return (
        (c == "") | (F.length(c) > longest) | c.isin(*SKIPPED) | c.rlike(r"^\p{P}+$") | c.rlike(r"(?i)^https?://\S+$")
        | c.rlike(r"(?i)^[\w.\-+%]+@[\w.\-]+\.[A-Za-z]{2,}$") | c.rlike(r"^\d+(?:[.,]\d+)?$")
    )


def surface_vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, freq of the surface forms between white space, edge punctuation dropped, ignorable ones left out."""
    w = texts.select(F.explode(chars.ws_tokens(chars.clean(F.col(column)))).alias("t")).select(chars.edge_strip(F.col("t")).alias("word"))
    return w.where(~is_ignorable(F.col("word"))).groupBy("word").agg(F.count("*").alias("freq"))


def valid_tokens(counts: DataFrame, least: int = 5) -> DataFrame:
    """Words of 2 to 40 characters without digits that occur often enough."""
    w = F.col("word")
    return counts.where((F.col("freq") >= least) & F.length(w).between(2, 40) & ~w.rlike(r"\p{Nd}"))


def top_words(counts: DataFrame, k: int = 100) -> DataFrame:
    """The k most frequent words, ties by word."""
    return counts.orderBy(F.desc("freq"), "word").limit(k)


def accepted_words(counts: DataFrame, validator: Callable[[DataFrame, str], DataFrame] | None = None, most: int = 200_000) -> DataFrame:
    """Of the ``most`` frequent words (a limit of the feature) those that the validator accepts; without one, all words."""
    if validator is None:
        return counts
    return validator(top_words(counts, most), "word").where("word_ok").drop("word_ok")


def pair_counts(pairs: DataFrame, raw: str = "raw", gold: str = "gold") -> DataFrame:
    """key, target, freq of noisy/gold token pairs that differ and are words."""
    r, g = chars.clean(F.col(raw)), chars.clean(F.col(gold))
    p = pairs.select(r.alias("r"), g.alias("g")).where("r is not null and g is not null and r <> g")
    p = p.where(~is_ignorable(F.col("r")) & ~is_ignorable(F.col("g")))
    return p.groupBy(chars.tr_lower(F.col("r"), "ii").alias("key"), F.col("g").alias("target")).agg(F.count("*").alias("freq"))


def best_targets(counts: DataFrame, corpus: DataFrame | None = None, bonus: int = 1, least: int = 1) -> DataFrame:
    """key, target: the target of the highest frequency, plus a bonus if the corpus has it; ties to the smallest."""
    c = counts.where(F.col("freq") >= least)
    score = F.col("freq")
    if corpus is not None:
        seen = corpus.select(F.col("word").alias("target")).distinct().withColumn("seen", F.lit(1))
        c = c.join(seen, "target", "left")
        score = score + F.coalesce("seen", F.lit(0)) * bonus
    return c.groupBy("key").agg(F.min_by("target", F.struct(F.negate(score), "target")).alias("target"))


def canonical_casing(vocabulary: DataFrame, least: int = 1) -> DataFrame:
    """key, target: for each lower-cased form its most frequent casing; ties to the smallest."""
    v = vocabulary.where(F.col("freq") >= least)
    return v.groupBy(chars.tr_lower(F.col("word"), "ii").alias("key")).agg(F.min_by("word", F.struct(F.negate("freq"), "word")).alias("target"))


def build_lexicon(pairs: DataFrame, corpus: DataFrame, backfill: bool = True) -> DataFrame:
    """key, target, origin: best targets of the pairs; keys that only the corpus knows with their canonical casing."""
    lex = best_targets(pair_counts(pairs), corpus).withColumn("origin", F.lit("pairs"))
    if not backfill:
        return lex
    own = canonical_casing(corpus).join(lex.select("key"), "key", "left_anti").withColumn("origin", F.lit("corpus"))
    return lex.unionByName(own)


# Letter writings of chats and their plain letters.
REWRITES = (("aa", "a"), ("kk", "k"), ("q", "k"), ("w", "v"), ("x", "ks"), ("sh", "ş"), ("ch", "ç"), ("ıi", "ı"), ("ii", "i"))


def candidates(noisy: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """noisy, candidate: spellings of the shortened word that the vocabulary holds (marked letters, chat writings)."""
    base = chars.shrink_runs(F.col("noisy"), 2, False)
    rewritten = F.array(*(F.replace(base, F.lit(a), F.lit(b)) for a, b in REWRITES))
    spellings = F.array_distinct(F.concat(F.array(base), chars.diacritic_variants(base), rewritten))
    e = noisy.select("noisy", F.explode(spellings).alias("candidate"))
    return e.join(vocabulary.select(F.col("word").alias("candidate")).distinct(), "candidate", "left_semi").select("noisy", "candidate")


def ranked_candidates(noisy: DataFrame, frequencies: DataFrame, alpha: float = 1.0, beta: float = 2.0, most: int = 6) -> DataFrame:
    """The noisy-word lexicon: best candidate, up to ``most`` candidates best first, count, frequency, distance, score."""
    counts = noisy.groupBy("noisy").agg(F.count("*").alias("noisy_count"))
    c = candidates(counts, frequencies).join(frequencies.withColumnRenamed("word", "candidate"), "candidate")
    c = c.withColumn("edit_distance", chars.edit_distance(F.col("noisy"), F.col("candidate")))
    c = c.withColumn("score", alpha * F.col("freq") - beta * F.col("edit_distance"))
    w = Window.partitionBy("noisy").orderBy(F.desc("score"), F.desc("candidate"))
    c = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    g = c.groupBy("noisy").agg(
        F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("all"),
        F.min_by(F.struct("candidate", "freq", "edit_distance", "score"), "rank").alias("best"),
    )
    return g.join(counts, "noisy").select(
        F.col("noisy").alias("noisy_form"), F.col("best.candidate").alias("best_candidate"),
        F.array_join(F.transform("all", lambda x: x["candidate"]), ";").alias("candidates"), "noisy_count",
        F.col("best.freq").alias("best_freq"), F.col("best.edit_distance").alias("edit_distance"), F.round("best.score", 2).alias("score"),
    )


def summed_frequencies(words: DataFrame) -> DataFrame:
    """word, freq: frequencies of equal case-folded words added; unreadable ones count 0."""
    f = F.coalesce(F.expr("try_cast(try_cast(frequency as double) as bigint)"), F.lit(0))
    return words.where("word is not null").groupBy(chars.tr_lower(F.col("word"), "casefold").alias("word")).agg(F.sum(f).alias("freq"))


def clean_wordlist(words: DataFrame, least: int = 2) -> DataFrame:
    """Trimmed words that begin with a letter and occur at least ``least`` times."""
    f = F.expr("try_cast(frequency as bigint)")
    w = words.select(F.trim("word").alias("word"), f.alias("frequency"))
    return w.where(F.col("word").rlike(r"^[A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîû]") & (F.col("frequency") >= least))


def filter_stopwords(tokens: Column, words: tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Tokens whose lower-cased form isn't a stopword; null tokens are dropped."""
    return F.filter(tokens, lambda t: t.isNotNull() & ~chars.tr_lower(t, "plain").isin(*words))


def filter_by_table(tokens: DataFrame, stopwords: DataFrame, column: str = "token") -> DataFrame:
    """Token rows whose lower-cased form isn't in the (word) table."""
    return tokens.join(stopwords.select(F.col("word").alias("_s")), chars.tr_lower(F.col(column), "plain") == F.col("_s"), "left_anti")


def corpus_tokens(tokens: DataFrame) -> DataFrame:
    """Lower-cased forms of a treebank without numbers, auxiliaries and punctuation, with their sentence."""
    f = F.col("form")
    rows = tokens.where(f.isNotNull() & ~f.rlike(r"^\s*[+-]?\d+\s*$") & (F.coalesce("upos", F.lit("")) != "AUX") & ~f.rlike(r"^(?:[!-/:-@\[-`{-~]|\.\.\.|\.\"?)$"))
    return rows.select("ex_id", F.lower(f).alias("token"))


# titles, gazetteers and pages ----------------------------------------------------------------------------------


def title_counts(*sources: DataFrame, least: int = 1) -> DataFrame:
    """title, freq over several (title) tables, titles normalised."""
    t = None
    for s in sources:
        part = s.select(chars.normalize_title_line(F.col("title")).alias("title")).where("title is not null and title <> ''")
        t = part if t is None else t.unionByName(part)
    return t.groupBy("title").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def is_valid_title(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def is_gazetteer_token(c: Column) -> Column:
    """Letters (hyphen and apostrophe inside), 2 to 40 characters, an acronym or in proper case."""
    return c.rlike(r"^\p{L}[\p{L}'’\-]*$") & F.length(c).between(2, 40) & (chars.is_acronym(c) | chars.is_proper_case(c))


def title_tokens(titles: DataFrame, least: int = 2) -> DataFrame:
    """word, freq of the name-like tokens of titles."""
    w = titles.select(F.explode(chars.ws_tokens(F.col("title"))).alias("word")).where(is_gazetteer_token(F.col("word")))
    return w.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def is_plain_title(c: Column) -> Column:
    """Letters and a few signs only, without blanks."""
    return c.rlike(r"^[A-Za-zÇĞİÖŞÜçğıöşü’'().,-]+$")


def build_gazetteers(*sources: DataFrame, least: int = 1, shortest: int = 2, longest: int = 40, acronym: int = 8) -> tuple[DataFrame, DataFrame]:
    """((title), (word)) of several (title) tables: plain titles that occur often enough, and their name-like tokens."""
    titles = title_counts(*sources, least=least).where(is_plain_title(F.col("title"))).select("title")
    w = F.col("word")
    words = titles.select(F.explode(chars.ws_tokens(F.col("title"))).alias("word")).where(w.rlike(r"^[A-Za-zÇĞİÖŞÜçğıöşü’']+$") & F.length(w).between(shortest, longest))
    words = words.where(chars.is_proper_case(w) | chars.is_acronym(w, acronym)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return titles, words.select("word")


def looks_disambiguation(title: Column, categories: Column) -> Column:
    """By the title's parenthesis or a category."""
    by_category = F.exists(categories, lambda c: F.lower(c).rlike("anlam ayrımı|disambiguation pages"))
    return title.rlike(r"(?iu)\((anlam ayrımı|disambiguation)\)") | F.coalesce(by_category, F.lit(False))


def page_categories(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, title, categories (cleaned, distinct, sorted, pipe-joined) of pages with categories that aren't disambiguations."""
    g = links.where("category is not null").groupBy("page_id").agg(F.collect_set(chars.clean_category(F.col("category"))).alias("c"))
    j = pages.where("namespace = 0").join(g, "page_id").where(~looks_disambiguation(F.col("title"), F.col("c")))
    return j.select("page_id", "title", F.array_join(F.array_sort("c"), "|").alias("categories"))


def missing_pages(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted titles that aren't stored yet and aren't blank."""
    return wanted.where(F.trim("title") != "").join(stored.select("title"), "title", "left_anti").distinct()
