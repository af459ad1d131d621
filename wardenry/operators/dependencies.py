"""Dependencies from manifests, joined to advisories. The advisory table is a constant of six rows, so it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import ADVISORIES


def requirements(files: DataFrame) -> DataFrame:
    """file_id, line, package, version of the lines with == of requirement files (file_id, content)."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).withColumn("text", F.trim("text")).where("text <> '' AND text NOT LIKE '#%' AND contains(text, '==')")
    return lines.select("file_id", (F.col("at") + 1).cast("long").alias("line"), F.trim(F.split_part("text", F.lit("=="), F.lit(1))).alias("package"), F.trim(F.expr("substring(text, locate('==', text) + 2)")).alias("version"))


def package_json(files: DataFrame) -> DataFrame:
    """file_id, line (1), package, version of both sections; broken JSON gives none."""
    parsed = files.select("file_id", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    both = parsed.select("file_id", F.explode(F.concat(F.coalesce(F.map_entries("j.dependencies"), F.array()), F.coalesce(F.map_entries("j.devDependencies"), F.array()))).alias("e"))
    return both.select("file_id", F.lit(1).cast("long").alias("line"), F.col("e.key").alias("package"), F.col("e.value").alias("version"))


def package_lock(files: DataFrame) -> DataFrame:
    """file_id, line (1), package, version, scope of a lock file's packages; transitive below a second node_modules."""
    parsed = files.select("file_id", F.explode(F.from_json("content", "packages map<string,struct<version:string>>")["packages"]).alias("at", "p")).where("at <> ''")
    return parsed.select("file_id", F.lit(1).cast("long").alias("line"), F.substring_index("at", "node_modules/", -1).alias("package"), F.col("p.version").alias("version"), F.when(F.regexp_count("at", F.lit("node_modules/")) > 1, "transitive").otherwise("direct").alias("scope"))


def vulnerable(dependencies: DataFrame) -> DataFrame:
    advisories = dependencies.sparkSession.createDataFrame([*ADVISORIES], "name string, advisory_id string, severity string")
    return dependencies.join(F.broadcast(advisories), F.lower("package") == F.col("name")).drop("name")
