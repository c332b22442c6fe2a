"""Queries of the training-data problems; __spark_entry__ adds them if this package can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import abuse, confusables, leakage, mixture, overlap, privacy, terms, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "examples"), table(spark, d, "abuse_samples"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_scores(spark, d).where("abusive").select("ex_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p1_scores(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.found(table(spark, d, "examples"))


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    return confusables.normalised(table(spark, d, "examples"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return confusables.groups(table(spark, d, "examples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "examples"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "examples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.found(table(spark, d, "examples"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redacted(table(spark, d, "examples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.found(table(spark, d, "examples"), table(spark, d, "token_instances"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.counted(table(spark, d, "examples"), table(spark, d, "token_instances"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "test_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.report(table(spark, d, "documents"), table(spark, d, "test_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


TERMS_SQL = """
with rec as (
  select 'e' || ex_id as rid, gold_tokens from examples
  union all
  select 'i' || coalesce(cast(inst_id as varchar), ''), any_value(gold_tokens) from token_instances group by inst_id
), t as (select rid, unnest(gold_tokens) as term from rec), n as (select count(*) as total from rec)
select term, count(*) as occurrences, count(distinct rid) as records,
       case when count(distinct rid) < 3 then 'rare'
            when count(distinct rid) > 0.02 * (select total from n) then 'common' end as mark
from t where term is not null and term <> '' group by term
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_terms": TERMS_SQL,
        "p5_found": f"select term, mark from ({TERMS_SQL}) where mark is not null",
    }
