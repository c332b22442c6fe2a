"""Rows that fail to parse: load the valid rows of delimited exports and tell why the others fail.

Method: each line is cut into cells; the cells are exploded into (row, column, value), joined with a rule table (one row
per column), the rules are evaluated, errors are aggregated per row, and clean rows are what an anti-join leaves.

Quoting: a cell may be enclosed in quotes and then holds delimiters, line breaks and doubled quotes. One carriage
return at the end of a line is ignored. Reasons, in order: ``quoting``, ``column_count``, ``value``. A null line is no
record and appears on neither side; a null or empty delimiter makes the whole line one cell.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("sent_id", "domain", "split", "raw_text", "gold_text", "n_tokens", "created_on")
#: column, whether it may be empty, allowed values, pattern of a valid value, and whether it must be a date or not blank
RULES = (
    ("sent_id", True, None, None, False, False),
    ("domain", False, ["boun", "iwt"], None, False, False),
    ("split", False, ["train", "dev", "test"], None, False, False),
    ("raw_text", False, None, None, False, True),
    ("gold_text", True, None, None, False, False),
    ("n_tokens", False, None, "^[0-9]+$", False, False),
    ("created_on", False, None, "^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$", True, False),
)
_RULES = "position int, name string, may_be_empty boolean, allowed array<string>, pattern string, is_date boolean, not_blank boolean"
#: White space of any kind, and the characters that are invisible.
BLANK = r"^[\s\p{Z}\u0085\u001c-\u001f\u200b-\u200d\u2060\ufeff]*$"
_CELLS = T.StructType([T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("quoting", T.BooleanType())])


def cut(line: str, delim: str) -> tuple[list[str], bool]:
    """The cells of a line and whether its quoting is broken."""
    if line.endswith("\r"):
        line = line[:-1]
    if '"' not in line:
        return (line.split(delim) if delim else [line]), False
    cells, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            parts, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return cells, True
                parts.append(line[i:j])
                if line[j + 1 : j + 2] != '"':
                    i = j + 1
                    break
                parts.append('"')
                i = j + 2
            cells.append("".join(parts))
            if i == n:
                return cells, False
            if not delim or not line.startswith(delim, i):
                return cells, True
            i += len(delim)
        else:
            j = line.find(delim, i) if delim else -1
            cell = line[i:] if j < 0 else line[i:j]
            if '"' in cell:
                return cells, True
            cells.append(cell)
            if j < 0:
                return cells, False
            i = j + len(delim)


@F.pandas_udf(_CELLS)
def _cut(line: pd.Series, delim: pd.Series) -> pd.DataFrame:
    rows = [cut(s, d or "") if s is not None else (None, None) for s, d in zip(line, delim)]
    return pd.DataFrame(rows, columns=["cells", "quoting"])


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], _RULES)


def parsed(records: DataFrame) -> DataFrame:
    """line_id, cells, quoting of every non-null line."""
    rows = records.where("line is not null").select("line_id", _cut("line", "delim").alias("p"))
    return rows.select("line_id", "p.cells", "p.quoting")


def _values(rows: DataFrame) -> DataFrame:
    """(line_id, position, value) of lines with the right number of cells."""
    whole = rows.where(~F.col("quoting") & (F.size("cells") == len(COLUMNS)))
    return whole.select("line_id", F.posexplode("cells").alias("position", "value"))


def errors(rows: DataFrame) -> DataFrame:
    """line_id, reason, columns (the failing ones) of every line that breaks the format."""
    v, value = F.broadcast(rule_table(rows.sparkSession)), F.col("value")  # one row per column of the format
    checked = _values(rows).join(v, "position")
    empty = value == ""
    bad = (
        (empty & ~F.col("may_be_empty"))
        | (F.col("allowed").isNotNull() & ~F.array_contains(F.coalesce("allowed", F.array().cast("array<string>")), value))
        | (F.col("pattern").isNotNull() & ~F.expr("value rlike coalesce(pattern, '')"))
        | (F.col("is_date") & F.try_to_date(value, "yyyy-MM-dd").isNull())
        | (F.col("not_blank") & value.rlike(BLANK))
        | value.contains("�")
    )
    failed = checked.where(bad).groupBy("line_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("columns"))
    failed = failed.select("line_id", F.lit("value").alias("reason"), "columns")
    form = rows.where(F.col("quoting") | (F.size("cells") != len(COLUMNS))).select(
        "line_id", F.when(F.col("quoting"), "quoting").otherwise("column_count").alias("reason"), F.lit(None).cast("string").alias("columns")
    )
    return form.unionByName(failed)


def found(records: DataFrame) -> DataFrame:
    return errors(parsed(records)).select("line_id", "reason").distinct()


def typed(records: DataFrame) -> DataFrame:
    """The valid lines as typed rows: what the anti-join with the errors leaves. Empty optional cells become null."""
    rows = parsed(records)
    clean = rows.join(errors(rows).select("line_id"), "line_id", "left_anti")
    cell = {c: F.col("cells")[i] for i, c in enumerate(COLUMNS)}
    cell |= {c: F.nullif(cell[c], F.lit("")) for c in ("sent_id", "gold_text")}
    cell |= {"n_tokens": F.expr("try_cast(cells[5] as bigint)"), "created_on": F.try_to_date(F.col("cells")[6], "yyyy-MM-dd")}
    return clean.select("line_id", *(cell[c].alias(c) for c in COLUMNS))
