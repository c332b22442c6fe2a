"""Builders of the dimension tables, from files to files, and their command line:

    python -m dokuma.plans.builders gazetteer --titles titles.txt --labels a.csv --names n.tsv --places tr.txt --out folder
    python -m dokuma.plans.builders safe-vocabulary --texts folder --out folder
    python -m dokuma.plans.builders wordlist --frequencies list.tsv --out folder
    python -m dokuma.plans.builders lexicon --treebank a.conllu --pairs noisy.txt --out folder
    python -m dokuma.plans.builders tweet-lexicon --words tweets.tsv --vocabulary words.tsv --out folder
    python -m dokuma.plans.builders pages --dump pages.sql.gz --links links.sql.gz --out folder
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import corpus
from ..sources import readers, sinks


def gazetteer(spark: SparkSession, out: str, titles: str | None = None, labels: list[str] = (), names: str | None = None, places: str | None = None, least: int = 1) -> None:
    """out/titles and out/words of all given sources; a source that isn't there is left out."""
    given = [(readers.title_dump, titles), *((readers.label_table, x) for x in labels), (readers.name_list, names), (readers.places, places)]
    sources = [f(spark, x) for f, x in given if x and readers.exists(spark, x)]
    sources = sources or [spark.createDataFrame([], "title string")]
    t, w = corpus.build_gazetteers(*sources, least=least)
    sinks.write_lines(t, f"{out}/titles", "title")
    sinks.write_lines(w, f"{out}/words", "word")


def safe_vocabulary(spark: SparkSession, out: str, texts: str, least: int = 5, validator: Callable[[DataFrame, str], DataFrame] | None = None, most: int = 200_000) -> None:
    """out/vocabulary and out/frequencies of the words of all text files of a folder, accepted by the validator if any."""
    counts = corpus.valid_tokens(corpus.word_counts(readers.text_files(spark, texts)), least)
    sinks.write_vocabulary(corpus.accepted_words(counts, validator, most), out)


def wordlist(spark: SparkSession, out: str, frequencies: str, least: int = 2) -> None:
    """out: word and frequency of a list with a preamble, cleaned."""
    sinks.write_tsv(corpus.clean_wordlist(readers.frequency_list(spark, frequencies), least), out, ["word"], True)


def lexicon(spark: SparkSession, out: str, treebank: str, pairs: str) -> None:
    """out: key and target of noisy and gold pairs, backed by the surface forms of a treebank."""
    noisy = readers.pair_lines(spark, pairs).select("raw", "gold")
    built = corpus.build_lexicon(noisy, corpus.surface_vocabulary(readers.conllu(spark, treebank)))
    sinks.write_tsv(built.select("key", "target"), out, ["key"])


def tweet_lexicon(spark: SparkSession, out: str, words: str, vocabulary: str, lemmas: bool = False) -> None:
    """out: ranked candidates of the query items of a table."""
    noisy = readers.header_table(spark, words, required="query_item").select(chars.tr_lower(F.trim("query_item"), "casefold").alias("noisy")).where("noisy <> ''")
    sinks.write_tsv(corpus.ranked_candidates(noisy, readers.vocabulary_list(spark, vocabulary, lemmas)), out, ["noisy_form"], True)


def pages(spark: SparkSession, out: str, dump: str, links: str) -> None:
    """out: page id, title and categories of the pages of two SQL dumps."""
    p = readers.sql_dump(spark, dump, ["page_id", "namespace", "title"]).withColumn("title", F.translate("title", "_", " "))
    table = corpus.page_categories(p.withColumn("namespace", F.col("namespace").try_cast("int")), readers.sql_dump(spark, links, ["page_id", "category"]))
    sinks.write_tsv(table, out, ["page_id"], True)


COMMANDS = {"gazetteer": gazetteer, "safe-vocabulary": safe_vocabulary, "wordlist": wordlist, "lexicon": lexicon, "tweet-lexicon": tweet_lexicon, "pages": pages}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="dokuma.plans.builders", description="Build dimension tables from files.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str, **options: dict) -> None:
        c = commands.add_parser(name)
        for o in (*needed, "out"):
            c.add_argument(f"--{o}", required=True)
        for o, how in options.items():
            c.add_argument(f"--{o}", **how)

    number = lambda n: {"type": int, "default": n}
    command("gazetteer", titles={}, labels={"nargs": "*", "default": []}, names={}, places={}, least=number(1))
    command("safe-vocabulary", "texts", least=number(5))
    command("wordlist", "frequencies", least=number(2))
    command("lexicon", "treebank", "pairs")
    command("tweet-lexicon", "words", "vocabulary", lemmas={"action": "store_true"})
    command("pages", "dump", "links")
    given = vars(parser.parse_args(arguments))
    COMMANDS[given.pop("command")](spark or SparkSession.builder.appName("dokuma").getOrCreate(), **given)


if __name__ == "__main__":
    main()
