"""Tainted values: which variables of a file ever hold request data, and which lines use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import source_kind

# How an assignment looks.
ASSIGNMENT = r"(?i)^\s*(?:(?:const|let|var|val|final|String|int|long|double|float|boolean|bool|char|Object|auto)\s+)?\$?([A-Za-z_$][\w$]*)\s*=\s*(.+?);?\s*$"
KEYWORDS = r"(?i)^\s*(?:if|elif|else|while|for|return|def|class|with|switch|case)\b|==|!=|<=|>=|:="


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*)")))


def assignments(lines: DataFrame) -> DataFrame:
    """file_id, line_no, target, expression, kind (of a direct source, or null), tokens."""
    line = F.col("line")
    own = lines.where(line.rlike(ASSIGNMENT) & ~line.rlike(KEYWORDS))
    expression = F.regexp_extract(line, ASSIGNMENT, 2)
    return own.select("file_id", "line_no", F.ltrim(F.lower(F.regexp_extract(line, ASSIGNMENT, 1)), F.lit("$")).alias("target"), expression.alias("expression"), source_kind(expression).alias("kind"), identifiers(expression).alias("tokens"))


def tainted_variables(lines: DataFrame) -> DataFrame:
    """file_id, variables: one pass over a file's assignments in order. A clean re-assignment leaves the taint, so the set only grows."""
    steps = assignments(lines).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "target", F.col("kind").isNotNull().alias("direct"), "tokens"))).alias("steps"))
    found = F.aggregate("steps", F.array().cast("array<string>"), lambda known, s: F.when(s["direct"] | F.arrays_overlap(s["tokens"], known), F.array_union(known, F.array(s["target"]))).otherwise(known))
    return steps.select("file_id", found.alias("variables")).where(F.size("variables") > 0)


def with_taint(lines: DataFrame) -> DataFrame:
    """lines with tainted: whether a line names a variable that is ever tainted in its file."""
    joined = lines.join(tainted_variables(lines), "file_id", "left")
    return joined.withColumn("tainted", F.coalesce(F.arrays_overlap(identifiers(F.col("line")), F.col("variables")), F.lit(False))).drop("variables")
