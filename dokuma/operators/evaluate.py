"""Boundary, span and edit scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenize import rule_tokens


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """struct(precision, recall, f1); recall is 1 where nothing is missed, precision 0 where nothing was predicted."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(fn == 0, 1.0).otherwise(tp / (tp + fn))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def prf_sets(gold: Column, pred: Column) -> Column:
    """struct(precision, recall, f1) of two arrays as sets; two empty ones score 1."""
    tp = F.size(F.array_intersect(gold, pred))
    g, p = F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred))
    precision = F.when(p > 0, tp / p).otherwise(0.0)
    recall = F.when(g > 0, tp / g).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    none = (g == 0) & (p == 0)
    return F.struct(*(F.when(none, 1.0).otherwise(c).alias(n) for c, n in ((precision, "precision"), (recall, "recall"), (f1, "f1"))))


def ends(tokens: Column) -> Column:
    """End offsets of tokens joined by one blank."""
    acc = F.aggregate(
        tokens,
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda a, t: F.struct((a["at"] + 1 + F.length(t)).alias("at"), F.array_append(a["ends"], a["at"] + 1 + F.length(t)).alias("ends")),
        lambda a: a["ends"],
    )
    return acc


def sentence_token_ends(sentences: Column) -> Column:
    """End offsets of the tokens of an array of sentences, counted anew in every sentence; the set of all of them."""
    return F.array_distinct(F.flatten(F.transform(sentences, ends)))


def sentence_scores(gold: Column, pred: Column, per_sentence: bool = True) -> Column:
    """struct(precision, recall, f1) of a sentence division. per_sentence compares the token ends of (token array) sentences,
    each sentence counted from 0; otherwise the ends of (string) sentences, counted on over the whole text."""
    of = sentence_token_ends if per_sentence else ends
    g, p = of(gold), of(pred)
    tp = F.size(F.array_intersect(g, p))
    return prf(tp, F.size(F.array_except(p, g)), F.size(F.array_except(g, p)))


def spans(text: Column, tokens: Column) -> Column:
    """array<struct(start, stop)> of tokens found one after another in a text; null where one isn't found."""
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, a["at"] + 1)
        found = F.struct((at - 1 + F.length(t)).alias("at"), F.array_append(a["spans"], F.struct((at - 1).alias("start"), (at - 1 + F.length(t)).alias("stop"))).alias("spans"))
        return F.when(a.isNotNull() & (a["at"] >= 0) & (at > 0), found).otherwise(F.struct(F.lit(-1).alias("at"), a["spans"].alias("spans")))

    done = F.aggregate(F.filter(tokens, lambda t: t.isNotNull() & (t != "")), seed, step)
    return F.when(done["at"] >= 0, done["spans"])


def boundaries(text: Column, tokens: Column) -> Column:
    """End offsets of aligned tokens, null where they don't align."""
    return F.transform(spans(text, tokens), lambda s: s["stop"])


def found_spans(text: Column, tokens: Column) -> Column:
    """array<struct(start, stop)> of tokens looked up one after another, blanks around them cut; those not found are skipped."""
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, a["at"] + 1)
        stop = at - 1 + F.length(t)
        return F.when(at > 0, F.struct(stop.alias("at"), F.array_append(a["spans"], F.struct((at - 1).alias("start"), stop.alias("stop"))).alias("spans"))).otherwise(a)

    trimmed = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.aggregate(trimmed, seed, step, lambda a: a["spans"])


def span_scores(text: Column, gold: Column, pred: Column, smooth: float = 1e-12) -> Column:
    """struct(precision, recall, f1) of two token arrays by the spans that they take in the text; missed spans count."""
    g, p = F.array_distinct(found_spans(text, gold)), F.array_distinct(found_spans(text, pred))
    tp = F.size(F.array_intersect(g, p))
    precision, recall = tp / (F.size(p) + F.lit(smooth)), tp / (F.size(g) + F.lit(smooth))
    return F.struct(precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + F.lit(smooth))).alias("f1"))


def edit_counts(raw: Column, pred: Column, gold: Column) -> Column:
    """struct(tp, fp, fn) of changes position by position, up to the shortest of the three."""
    n = F.least(F.size(raw), F.size(pred), F.size(gold))
    z = F.zip_with(F.zip_with(F.slice(raw, 1, n), F.slice(pred, 1, n), lambda r, p: F.struct(r.alias("r"), p.alias("p"))), F.slice(gold, 1, n), lambda x, g: F.struct(x["r"].alias("r"), x["p"].alias("p"), g.alias("g")))
    count = lambda f: F.size(F.filter(z, f))
    return F.struct(
        count(lambda x: (x["r"] != x["g"]) & (x["p"] == x["g"])).alias("tp"),
        count(lambda x: (x["r"] == x["g"]) & (x["p"] != x["r"])).alias("fp"),
        count(lambda x: (x["r"] != x["g"]) & (x["p"] != x["g"])).alias("fn"),
    )


def score_texts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of rows with token arrays raw, pred, gold: exact sentences, token accuracy, and micro edit scores."""
    e = edit_counts(F.col("raw"), F.col("pred"), F.col("gold"))
    n = F.least(F.size("pred"), F.size("gold"))
    same = F.size(F.filter(F.zip_with(F.slice("pred", 1, n), F.slice("gold", 1, n), lambda p, g: p == g), lambda x: x))
    g = rows.withColumn("e", e).groupBy(*by).agg(
        F.count("*").alias("sentences"), F.sum((F.col("pred") == F.col("gold")).cast("long")).alias("exact"), F.sum(same).alias("same"),
        F.sum(F.size("gold")).alias("tokens"), *(F.sum(f"e.{c}").alias(c) for c in ("tp", "fp", "fn")),
    )
    s = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.withColumns({"precision": s["precision"], "recall": s["recall"], "f1": s["f1"]})


def hybrid_scores(rows: DataFrame, gold: str, a: str, b: str) -> DataFrame:
    """Macro precision, recall and F1 over all rows of two boundary arrays, their union and their intersection."""
    preds = {a: F.col(a), b: F.col(b), "either": F.array_union(a, b), "both": F.array_intersect(a, b)}
    each = F.array(*(F.struct(F.lit(n).alias("system"), prf_sets(F.col(gold), c).alias("s")) for n, c in preds.items()))
    e = rows.select(F.explode(each).alias("e")).select("e.system", "e.s.*")
    return e.groupBy("system").agg(F.count("*").alias("rows"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def hybrid_tokenizers(instances: DataFrame, predictions: DataFrame, key: str = "inst_id") -> DataFrame:
    """Scores of the Naive Bayes tokeniser (``predictions``: key, tokens), of the rule tokeniser, and of the union and the
    intersection of their boundaries, against the boundaries of the instances, each row with its domain's rules."""
    rows = instances.where(F.col("text").isNotNull() & F.col("boundaries").isNotNull())
    rules = F.when(F.lower(F.trim("domain")) == "iwt", rule_tokens(F.col("text"), "iwt")).otherwise(rule_tokens(F.col("text")))
    stops = lambda tokens: F.transform(found_spans(F.col("text"), tokens), lambda s: s["stop"])
    j = rows.join(predictions.withColumnRenamed("tokens", "_nb"), key, "left")
    j = j.select(F.filter("boundaries", lambda x: x.isNotNull()).alias("gold"), stops(F.coalesce("_nb", F.array().cast("array<string>"))).alias("bayes"), stops(rules).alias("rules"))
    return hybrid_scores(j, "gold", "bayes", "rules")


def split_train_dev(rows: DataFrame, key: str, ratio: float = 0.1) -> DataFrame:
    """The rows with ``part``: the last ``ratio`` of them by a unique key are dev, the others train. Only the key at the
    border is looked up; no task numbers all rows."""
    n = rows.count()
    held = int(n * ratio)
    border = rows.select(key).orderBy(F.desc(key)).offset(held - 1).limit(1).collect() if held else []
    part = F.when(F.col(key) >= border[0][0], "dev").otherwise("train") if border else F.lit("train")
    return rows.withColumn("part", part)


def error_samples(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first n rows by key whose prediction differs."""
    return rows.where(F.col("pred") != F.col("gold")).orderBy(key).limit(n)
