"""The scalar operators on streams: a folder of new texts is cleaned and tokenised as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import chars
from ..operators.tokenize import rule_tokens


def cleaned(stream: DataFrame, column: str = "text") -> DataFrame:
    """The rows with their sanitised text and tokens; works on batch and streaming frames alike."""
    return stream.withColumn("clean", chars.compact_ws(chars.sanitize(F.col(column)))).withColumn("tokens", rule_tokens(F.col("clean")))


def word_windows(stream: DataFrame, time: str, late: str = "1 day", size: str = "1 day", column: str = "text") -> DataFrame:
    """window, word, freq over event time; rows later than ``late`` are dropped by the watermark."""
    w = stream.withWatermark(time, late).select(F.col(time), F.explode(chars.letter_runs(chars.tr_lower(F.col(column)))).alias("word"))
    return w.groupBy(F.window(time, size), "word").agg(F.count("*").alias("freq"))


def run(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Cleans new parquet files of ``source`` into ``sink``, each once, and ends when none is left."""
    stream = spark.readStream.schema(schema).parquet(source)
    return cleaned(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
