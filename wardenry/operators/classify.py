"""Language by path, as an ordered case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in the order in which they are tried.
SUFFIXES = (("python", "[.]py$"), ("javascript", "[.](?:jsx|js|mjs|cjs)$"), ("typescript", "[.]tsx?$"), ("java", "[.]java$"), ("kotlin", "[.]kt$"), ("php", "[.]php$"), ("json", "[.]json$"), ("toml", "[.]toml$"), ("xml", "[.](?:xml|plist)$"), ("text", "[.]txt$"))


def language(path: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(SUFFIXES):
        out = F.when(F.lower(path).rlike(pattern), name).otherwise(out)
    return out


def language_sql(path: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({path}), '{p}') THEN '{n}'" for n, p in SUFFIXES) + " ELSE 'unknown' END"


def parsed(files: DataFrame, classified: DataFrame) -> DataFrame:
    """files (path, content and others) with language and syntax_valid, from classified (path, language, seq): the last of each path by seq, unknown without one. Of the languages only JSON is checked for syntax."""
    last = classified.groupBy("path").agg(F.max_by("language", "seq").alias("language"))
    out = files.drop("language").join(last, "path", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))
    broken = (F.col("language") == "json") & F.try_parse_json(F.coalesce("content", F.lit(""))).isNull()
    return out.withColumn("syntax_valid", ~broken)
