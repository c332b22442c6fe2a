"""Sinks: sorted tables, lists, frequency files, pages and models."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import features
from ..session import checkpointed


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None, header: bool = False) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, sep="\t", header=header, emptyValue="", quote="")


def write_lines(df: DataFrame, path: str, column: str) -> None:
    """One value a line, sorted."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").orderBy("value").write.mode("overwrite").text(path)


def write_frequencies(df: DataFrame, path: str) -> None:
    """word to freq as JSON objects, most frequent first, ties by word: one object a file, so that no task holds all, and
    ``readers.frequency_json`` reads the folder back."""

    def objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for pdf in batches:
            lines = [("," if opened or i else "{") + json.dumps(w, ensure_ascii=False) + ":" + str(int(n)) for i, (w, n) in enumerate(zip(pdf["word"], pdf["freq"]))]
            opened = opened or bool(lines)
            yield pd.DataFrame({"value": pd.Series(lines, dtype=object)})
        if opened:
            yield pd.DataFrame({"value": ["}"]})

    rows = df.where("word is not null and freq is not null").select("word", F.col("freq").cast("bigint").alias("freq")).orderBy(F.desc("freq"), "word")
    rows.mapInPandas(objects, "value string").write.mode("overwrite").text(path)


def write_vocabulary(df: DataFrame, path: str) -> None:
    write_lines(df.select("word").distinct(), f"{path}/vocabulary", "word")
    write_frequencies(df, f"{path}/frequencies")


def write_pages(df: DataFrame, path: str, buckets: int = 16) -> None:
    """Pages by title, spread over ``buckets`` folders, a file never growing with one title."""
    b = F.pmod(F.xxhash64("title"), F.lit(buckets)).alias("bucket")
    df.select("*", b).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_page_files(df: DataFrame, path: str) -> DataFrame:
    """One text file a title, named by it (``chars.safe_filename``), written by the tasks into a folder that all of them
    share; blank texts are left out. Returns title, file. For collections that people browse; ``write_pages`` is for large ones."""
    rows = df.where(F.trim("text") != "").select("title", chars.safe_filename(F.col("title")).alias("file"), "text").where("file <> ''")
    done = rows.groupBy("file").agg(F.min("title").alias("title"), F.min_by("text", "title").alias("text"))
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["text"]):
                part = os.path.join(path, f".{name}.{os.getpid()}")
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, os.path.join(path, f"{name}.txt"))  # whole or not at all, also when a task runs twice
            yield pdf[["title", "file"]]

    return checkpointed(done.mapInPandas(write, "title string, file string"))


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """Model tables as parquet, read back with ``read_model``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame] | None:
    """The tables of a model, or None where one isn't there."""
    try:
        return {n: spark.read.parquet(f"{path}/{n}") for n in names}
    except AnalysisException:
        return None


def write_regression(spark: SparkSession, model, path: str) -> None:
    """Coefficients and intercept of a boundary regression as one row."""
    row = ([float(x) for x in model.coefficients], float(model.intercept))
    spark.createDataFrame([row], "coefficients array<double>, intercept double").coalesce(1).write.mode("overwrite").parquet(path)


def read_regression(spark: SparkSession, path: str) -> features.Linear | None:
    """The regression, or None where it isn't there; callers then fall back on rules."""
    try:
        r = spark.read.parquet(path).collect()[0]  # one row
    except AnalysisException:
        return None
    return features.Linear(list(r["coefficients"]), r["intercept"])
