"""The scalars of JSON texts as rows, however deep: one explode a level, until no object or list is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import materialised


def leaves(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, path (a.b[0]), value_type, value of every scalar of each text; empty objects and lists, and texts that can't be read, give none."""
    now, out = texts.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL"), None
    while True:
        now = materialised(now.withColumn("value_type", F.schema_of_variant("v")), "leaves")
        within = F.col("value_type").rlike("^(?:OBJECT|ARRAY)")
        flat = now.where(~within).select(F.col("key").alias(key), "path", "value_type", F.col("v").cast("string").alias("value"))
        out, deeper = flat if out is None else out.unionByName(flat), now.where(within)
        if not deeper.first():
            return out
        step = "CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') WHEN path = '' THEN e.key ELSE concat(path, '.', e.key) END"
        now = texts.sparkSession.sql(f"SELECT d.key AS key, {step} AS path, e.value AS v FROM {{d}} AS d, LATERAL variant_explode(d.v) AS e", d=deeper)
