"""Features of token and sentence boundaries, the Naive Bayes tokeniser and the logistic-regression splitter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars
from ..session import spread
from .sentences import ABBREVIATIONS

END_MARKS = (".", "!", "?", "...")


def boundary_features(tokens: DataFrame, key: str = "ex_id", abbreviations: frozenset[str] = ABBREVIATIONS) -> DataFrame:
    """Seven flags of each token row (key, sentence, pos, token): end of its sentence, mark, abbreviation, next token
    capitalised, previous not, next and previous a mark. Neighbours are taken across sentences of one key."""
    order = Window.partitionBy(key).orderBy("sentence", "pos")
    last = F.lead("sentence").over(order)
    t, nxt, prev = F.col("token"), F.lead("token").over(order), F.lag("token").over(order)
    no = lambda c: F.coalesce(c, F.lit(False))
    return tokens.select(
        key, "sentence", "pos", "token",
        no(F.when(last.isNull(), True).otherwise(last != F.col("sentence"))).alias("snt_end"),
        t.isin(*END_MARKS).alias("punct"),
        chars.tr_lower(t, "ii").isin(*sorted(abbreviations)).alias("abbrev"),
        no(nxt.rlike(r"^\p{Lu}")).alias("next_cap"),
        no(prev.rlike(r"^\p{Ll}")).alias("prev_not_cap"),
        no(nxt.isin(*END_MARKS)).alias("nxt_punct"),
        no(prev.isin(*END_MARKS)).alias("prev_punct"),
    )


def shift_features(tokens: DataFrame, key: str = "ex_id") -> DataFrame:
    """Neighbour flags by shifting with the defaults A before and a after the ends."""
    order = Window.partitionBy(key).orderBy("pos")
    nxt, prev = F.lead("token", 1, "A").over(order), F.lag("token", 1, "a").over(order)
    mark = lambda c: c.rlike("^[.!?…]$")
    return tokens.select(
        key, "pos", "token", mark(F.col("token")).alias("punct"), nxt.rlike(r"^\p{Lu}").alias("next_cap"),
        (~prev.rlike(r"^\p{Lu}")).alias("prev_not_cap"), mark(nxt).alias("nxt_punct"), mark(prev).alias("prev_punct"),
    )


def flat(text: Column) -> Column:
    """White space as blanks, as the two functions below expect it."""
    return F.translate(text, "\t\n\x0b\f\r", "     ")


def left_token(text: Column, i: Column) -> Column:
    """What stands between the last white space and offset i (white space before i skipped), without backtracking."""
    return F.substring_index(F.rtrim(F.left(text, i)), " ", -1)


def right_token(text: Column, i: Column) -> Column:
    return F.substring_index(F.ltrim(F.substring(text, i + 1, F.length(text))), " ", 1)


# Endings that hint at a boundary.
ENDINGS = (
    (("dir", "dır", "dur", "dür"), "left_endswith_dir_variant"), (("dı", "di", "du", "dü"), "left_endswith_past_d"),
    (("tı", "ti", "tu", "tü"), "left_endswith_past_t"), (("yor",), "left_endswith_yor"),
)
_CONTEXT = ("around_apostrophe_after_capital", "quote_before_capital", *(n for _, n in ENDINGS))
SIGNATURE = ["prev", "next", "flags"]
PIECE = 256  # characters after which a text is cut at the next token, to look up neighbours


def signatures(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, pos, prev, next, flags) of every offset of ``text``: all that the features of an offset depend on. flags is
    a bit set over the context features."""
    rows = spread(rows, keep[0])  # each row becomes hundreds
    # Neighbouring tokens are looked up inside pieces that end behind a token, with the last token before and the first
    # one after, so a text costs its length times that of a piece.
    found = F.filter(F.regexp_extract_all(flat(F.col("text")), F.lit(rf".{{0,{PIECE}}}[^ ]* *"), F.lit(0)), lambda x: x != "")
    cut = rows.select(*keep, F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found).alias("_p"))
    starts = lambda k: F.aggregate(F.slice("_p", 1, k), F.lit(0), lambda n, x: n + F.length(x))
    pieces = F.transform("_p", lambda x, k: F.struct(starts(k).alias("at"), x.alias("piece"), F.get("_p", k - 1).alias("before"), F.get("_p", k + 1).alias("after")))
    cut = cut.select(*keep, F.explode(pieces).alias("p")).select(*keep, "p.*", F.filter(F.split("p.piece", ""), lambda x: x != "").alias("_c"))
    head = F.coalesce(F.concat(F.substring_index(F.rtrim("before"), " ", -1), F.lit(" ")), F.lit(""))
    cut = cut.withColumn("_h", F.length(head)).withColumn("text", F.concat(head, "piece", F.coalesce(F.substring_index("after", " ", 1), F.lit(""))))
    char = lambda i, other, edge: F.coalesce(F.get("_c", i), other, F.lit(edge))
    last = F.size("_c") - F.when(F.col("after").isNull(), 0).otherwise(1)
    spots = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((F.col("at") + i).alias("pos"), (F.col("_h") + i).alias("_i"), char(i - 1, F.right("before", F.lit(1)), "<BOS>").alias("prev"), char(i, F.left("after", F.lit(1)), "<EOS>").alias("next")),
    )
    e = cut.select(*keep, "text", F.explode(spots).alias("s")).select(*keep, "text", "s.*")
    e = e.select(*keep, "pos", "prev", "next", left_token(F.col("text"), F.col("_i")).alias("left"), right_token(F.col("text"), F.col("_i")).alias("right"))
    prev, nxt, left, right = (F.col(c) for c in ("prev", "next", "left", "right"))
    low = F.lower(F.right(left, F.lit(3)))
    tests = [(prev.isin("'", "’") | nxt.isin("'", "’")) & left.rlike(r"^\p{Lu}") & (right != ""), prev.isin('"', "“", "”") & right.rlike(r"^\p{Lu}")]
    tests += [reduce(Column.__or__, (F.endswith(low, F.lit(x)) for x in ends)) for ends, _ in ENDINGS]
    flags = reduce(Column.__add__, (F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)))
    return e.select(*keep, "pos", "prev", "next", flags.alias("flags"))


def token_features() -> Column:
    """Array of the features of a signature: characters, categories, bigram, quotes, context."""
    prev, nxt = F.col("prev"), F.col("next")
    apostrophe, quote = ("'", "’", "‘"), ('"', "“", "”")
    flag = lambda cond, name: F.when(cond, F.lit(name))
    f = lambda name, c: F.concat(F.lit(name + "="), c)
    fs = F.array(
        f("prev_char", prev), f("next_char", nxt), f("prev_cat", chars.char_category(prev)), f("next_cat", chars.char_category(nxt)),
        F.concat(F.lit("prev_next="), prev, F.lit("|"), nxt),
        flag(prev.isin(*apostrophe), "prev_is_apostrophe"), flag(nxt.isin(*apostrophe), "next_is_apostrophe"),
        flag(prev.isin(*quote), "prev_is_quote"), flag(nxt.isin(*quote), "next_is_quote"),
        *(flag(F.col("flags").bitwiseAND(1 << k) != 0, name) for k, name in enumerate(_CONTEXT)),
    )
    return F.array_compact(fs)


def feature_counts(instances: DataFrame, key: str = "inst_id") -> tuple[DataFrame, DataFrame]:
    """((label, feature, n), (label, offsets)). Offsets are counted by signature before features are unfolded, so what is
    shuffled is a few rows per signature, not one per feature of every character."""
    rows = instances.where(F.col("text").isNotNull() & F.col("boundaries").isNotNull())
    label = F.array_contains("boundaries", F.col("pos")).cast("int").alias("label")
    g = signatures(rows, [key, "boundaries"]).groupBy(label, *SIGNATURE).agg(F.count("*").alias("n"))
    counts = g.select("label", "n", F.explode(token_features()).alias("feature")).groupBy("label", "feature").agg(F.sum("n").alias("n"))
    return counts, g.groupBy("label").agg(F.sum("n").alias("offsets"))


def nb_fit(instances: DataFrame, key: str = "inst_id") -> tuple[DataFrame, DataFrame]:
    """((label, feature, n), (label, offsets, features, vocabulary)): counts of the multinomial model."""
    counts, classes = feature_counts(instances, key)
    vocabulary = counts.agg(F.count_distinct("feature").alias("vocabulary"))
    totals = classes.join(counts.groupBy("label").agg(F.sum("n").alias("features")), "label").join(F.broadcast(vocabulary))  # one row by construction
    return counts, totals


def nb_predict(texts: DataFrame, model: tuple[DataFrame, DataFrame], key: str = "inst_id", alpha: float = 1.0) -> DataFrame:
    """(key, pos, log_odds, boundary) of every offset; features never seen count with their smoothed share; a tie is a boundary."""
    counts, totals = model
    t = {r["label"]: r for r in totals.collect()}  # two rows
    v = max((r["vocabulary"] for r in t.values()), default=0)
    total = sum(r["offsets"] for r in t.values())
    size = {k: (t[k]["features"] if k in t else 0) + alpha * v for k in (0, 1)}
    prior = {k: ((t[k]["offsets"] if k in t else 0) + alpha) / (total + 2 * alpha) for k in (0, 1)}
    pivot = counts.groupBy("feature").agg(*(F.sum(F.when(F.col("label") == k, F.col("n"))).alias(f"n{k}") for k in (0, 1)))
    spots = signatures(texts.where("text is not null"), [key])
    rows = spots.select(*SIGNATURE).distinct().select(*SIGNATURE, F.explode(token_features()).alias("feature")).join(pivot, "feature", "left")
    odds = lambda k: F.ln((F.coalesce(f"n{k}", F.lit(0)) + F.lit(alpha)) / F.lit(float(size[k])))
    base = F.ln(F.lit(prior[1])) - F.ln(F.lit(prior[0]))
    g = rows.groupBy(*SIGNATURE).agg((F.sum(odds(1) - odds(0)) + base).alias("log_odds"))
    return spots.join(g, SIGNATURE).select(key, "pos", "log_odds", (F.col("log_odds") >= 0).alias("boundary"))


def nb_tokens(texts: DataFrame, predictions: DataFrame, key: str = "inst_id") -> DataFrame:
    """(key, tokens): the text cut at its predicted boundaries, the tail kept, blank parts dropped."""
    ends = predictions.where("boundary").groupBy(key).agg(F.array_sort(F.collect_set("pos")).alias("ends"))
    j = texts.where("text is not null").join(ends, key, "left")
    cuts = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0)), F.coalesce("ends", F.array().cast("array<int>")), F.array(F.length("text")))))
    spans = F.zip_with(F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(0))), F.slice(cuts, 2, F.size(cuts)), lambda a, b: F.trim(F.substring("text", a + 1, b - a)))
    return j.select(key, F.filter(spans, lambda s: s != "").alias("tokens"))


FLAGS = ("punct", "abbrev", "next_cap", "prev_not_cap", "nxt_punct", "prev_punct")


class Linear:
    """Coefficients of the six flags and an intercept."""

    def __init__(self, coefficients: list[float], intercept: float):
        self.coefficients, self.intercept = coefficients, intercept


class Constant(Linear):
    """The model of rows of one class, or of none: that class always, no boundary without rows."""

    def __init__(self, ends: bool):
        super().__init__([0.0] * len(FLAGS), 1.0 if ends else -1.0)


def lr_fit(features: DataFrame, iterations: int = 500):
    """Balanced logistic regression of snt_end on the six flags (each class weighs half, unit ridge penalty)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r["snt_end"]: r["count"] for r in features.groupBy("snt_end").count().collect()}  # two rows
    n = sum(counts.values())
    if len(counts) < 2:
        return Constant(bool(counts.get(True)))
    weight = F.when(F.col("snt_end"), n / (2 * max(1, counts.get(True, 0)))).otherwise(n / (2 * max(1, counts.get(False, 0))))
    rows = features.select(*(F.col(c).cast("double") for c in FLAGS), F.col("snt_end").cast("double").alias("label"), weight.alias("weight"))
    rows = VectorAssembler(inputCols=list(FLAGS), outputCol="features").transform(rows)
    return LogisticRegression(maxIter=iterations, weightCol="weight", standardization=False, regParam=1.0 / max(1, n)).fit(rows)


def lr_predict(features: DataFrame, model) -> DataFrame:
    """The feature rows with ``ends``."""
    w, b = [float(x) for x in model.coefficients], float(model.intercept)
    z = F.lit(b)
    for c, x in zip(FLAGS, w):
        z = z + F.col(c).cast("double") * x
    return features.withColumn("ends", z > 0)


def lr_ends(tokens: Column, model: Linear, abbreviations: frozenset[str] = ABBREVIATIONS) -> Column:
    """array<boolean>: whether a sentence ends behind each token of a row, by the same flags, taken inside the row."""
    no = lambda c: F.coalesce(c, F.lit(False))

    def flag(t: Column, i: Column) -> Column:
        nxt, prev = F.get(tokens, i + 1), F.get(tokens, i - 1)
        values = (
            t.isin(*END_MARKS), chars.tr_lower(t, "ii").isin(*sorted(abbreviations)), no(nxt.rlike(r"^\p{Lu}")), no(prev.rlike(r"^\p{Ll}")),
            no(nxt.isin(*END_MARKS)), no(prev.isin(*END_MARKS)),
        )
        return reduce(Column.__add__, (v.cast("double") * float(w) for v, w in zip(values, model.coefficients)), F.lit(float(model.intercept))) > 0

    return F.transform(tokens, flag)
