"""The five-stage pipeline: normalise, tokenise, split sentences, stem, filter stopwords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import corpus, features, normalize, sentences, stem
from ..operators.tokenize import rule_tokens
from ..session import checkpointed, spread


def process(
    docs: DataFrame,
    lexicon: DataFrame,
    frequencies: DataFrame,
    key: str = "ex_id",
    column: str = "raw_text",
    suffixes: DataFrame | None = None,
    tokenizer: tuple[DataFrame, DataFrame] | None = None,
    splitter: features.Linear | None = None,
) -> DataFrame:
    """key, normalized, tokens, sentences, stems, content.

    sentences are arrays of tokens, and stems has the stem of each of their tokens; content are the tokens that are no
    stopwords. tokenizer is a Naive Bayes model and splitter a boundary regression (``sinks.read_model`` and
    ``read_regression`` give None where one isn't there); without them the rules decide. suffixes is a table of any size
    with a column suffix; without it the built-in endings are cut. Null texts give nulls.
    """
    n = normalize.texts(docs, lambda t: normalize.normalize_tokens(t, lexicon, frequencies), key, column).select(key, "normalized")
    if tokenizer is not None:
        n = checkpointed(n)
        text = n.withColumnRenamed("normalized", "text")
        t = n.join(features.nb_tokens(text, features.nb_predict(text, tokenizer, key), key), key, "left")
    else:
        t = n.withColumn("tokens", rule_tokens(F.col("normalized")))
    if splitter is not None:
        s = sentences.by_flags(F.col("tokens"), features.lr_ends(F.col("tokens"), splitter))
    else:
        s = F.transform(sentences.rule_sentences(F.col("normalized")), lambda x: rule_tokens(x))
    t = t.withColumn("sentences", s)
    if suffixes is None:
        return _filtered(t.withColumn("stems", F.transform("sentences", lambda s: F.transform(s, lambda w: stem.stem_column(w)))))
    t = checkpointed(t.withColumn("_all", F.flatten("sentences")))
    words = stem.stems(t.select(F.explode("_all").alias("word")), suffixes).where("stem <> word")
    j = t.join(normalize.gathered(t, key, "_all", checkpointed(words), "word", "stem"), key, "left")
    of = lambda w: F.coalesce(F.element_at("new", w), w)
    return _filtered(j.withColumn("stems", F.transform("sentences", lambda s: F.transform(s, of)))).drop("new", "_all")


def _filtered(t: DataFrame) -> DataFrame:
    return t.withColumn("content", corpus.filter_stopwords(F.col("tokens")))


def process_light(docs: DataFrame, key: str = "ex_id", column: str = "raw_text") -> DataFrame:
    """The same without the lexicon joins: one projection, no shuffle (but for an input of few files)."""
    clean = chars.compact_ws(chars.shrink_runs(chars.sanitize(F.col(column))))
    t = spread(docs.select(key, column)).select(key, clean.alias("normalized")).select("*", rule_tokens(F.col("normalized")).alias("tokens"), sentences.simple_sentences(F.col("normalized")).alias("sentences"))
    return t.select("*", F.transform("tokens", lambda t: stem.stem_column(t)).alias("stems"), corpus.filter_stopwords(F.col("tokens")).alias("content"))
