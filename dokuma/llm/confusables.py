"""Problem 2: bring look-alike text to one consistent form.

Method: confusables skeleton (decompose, replace every character by its prototype from the look-alike table,
decompose again); originals with equal skeletons form one group. The consistent form is the composed skeleton, and a
field is found if it isn't that already.

Rows whose text has only usual characters never leave the JVM: the character class decides natively, and the Python
worker gets null for them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textfold

FIELDS = ("raw_text", "gold_text")


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(textfold.canonical, na_action="ignore")


def suspect(c: Column) -> Column:
    """True where a character outside the usual set occurs; only such a text can change."""
    return c.rlike(textfold.SUSPECT)


def canonical(c: Column) -> Column:
    """The consistent form; null stays null, empty stays empty, and the form of a form is itself."""
    return F.when(suspect(c), _canonical(F.when(suspect(c), c))).otherwise(c)


@F.pandas_udf(T.StringType())
def _skeleton(s: pd.Series) -> pd.Series:
    return s.map(textfold.skeleton, na_action="ignore")


def fields(examples: DataFrame, *extra: str, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per non-null text field: ex_id, field_name, text and the extra columns."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text")) for n in names))
    return examples.select("ex_id", *extra, F.explode(pairs).alias("_f")).select(
        "ex_id", *extra, "_f.field_name", "_f.text"
    ).where(F.col("text").isNotNull())


def found(examples: DataFrame) -> DataFrame:
    """Fields holding a character that must be replaced, composed or removed. Null and empty fields: no case."""
    f = fields(examples).where(suspect(F.col("text")))
    return f.where(_canonical("text") != F.col("text")).select("ex_id", "field_name").distinct()


def normalised(examples: DataFrame) -> DataFrame:
    """Every field in its consistent form, with a flag that tells whether it changed."""
    f = fields(examples).withColumn("canonical", canonical(F.col("text")))
    return f.select("ex_id", "field_name", "canonical", (F.col("canonical") != F.col("text")).alias("changed"))


def groups(examples: DataFrame) -> DataFrame:
    """One row per skeleton that occurs in more than one spelling: its form, number of spellings and of fields.

    Equal spellings are counted before anything is grouped by skeleton, so many copies of one text are one row.
    """
    f = fields(examples).groupBy("text").agg(F.count("*").alias("n"))
    c = F.col("text")
    plain = ~c.rlike(r"[^\x00-\x7F]")
    f = f.withColumn("skeleton", F.when(plain, c).otherwise(_skeleton(F.when(~plain, c))))
    g = f.groupBy(F.md5("skeleton").alias("skeleton_id")).agg(
        F.min("skeleton").alias("skeleton"), F.count("*").alias("spellings"), F.sum("n").alias("fields")
    )
    return g.where("spellings > 1")
