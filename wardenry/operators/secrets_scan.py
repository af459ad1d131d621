"""Hardcoded secrets in whole texts: the lines in which they begin, with every value masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markers import has_any
from ..sources.corpus import normalised
from .scans import shuffled

# Fixed values.
PATTERNS = (
    r"(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[^'\"]{8,}",
    r"(?i)aws[_-]?secret[_-]?access[_-]?key\s*[:=]\s*['\"]?[^'\"]{8,}",
    r"(?i)-----begin [a-z ]*private key-----",
)
#: What a line assigns: up to the value's first two characters, and its last two.
VALUE = r"([:=]\s*['\"]?[^'\"]{2})[^'\"]{4,}([^'\"]{2})"
#: White space at a line's ends.
ENDS = r"^[\t\x0B\x0C\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t\x0B\x0C\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
#: A noncharacter that marks where matches begin; one in the text itself reads as U+FFFD.
MARK = "\ufdd0"


#: Files whose secrets matter most.
SENSITIVE = (".env", ".env.local", ".env.production", ".env.development")


def sensitive_file(path: Column) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(x.replace(".", "[.]") for x in SENSITIVE) + ")$")


def masked(line: Column) -> Column:
    """The line with every value of eight or more characters as its first and last two; without one it stays."""
    return F.regexp_replace(line, VALUE, "$1***$2")


def _hit_lines(text: Column, pattern: str) -> Column:
    """Of a text (newlines of one kind): number and content, without white space at its ends, of each line in which a match begins and that hints at no dummy. A mark is put before each match, so a look at each line tells, however many matches there are."""
    lines = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("\ufffd")), pattern, f"{MARK}$0"), "\n", -1)
    some = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"))), lambda x: x["line"].contains(MARK))
    told = F.transform(some, lambda x: F.struct(x["line_no"].alias("line_no"), F.regexp_replace(F.replace(x["line"], F.lit(MARK), F.lit("")), ENDS, "").alias("line")))
    return F.filter(told, lambda x: ~has_any(x["line"], "dummy_secret"))


def secret_count(text: Column) -> Column:
    """How many hits secret_hits() has in one text, in the row itself."""
    own = normalised(text)
    lines = lambda p: F.when(own.rlike(p), F.transform(_hit_lines(own, p), lambda x: x["line_no"])).otherwise(F.array().cast("array<bigint>"))
    return F.size(F.array_distinct(F.concat(*map(lines, PATTERNS)))).cast("long")


def secret_hits(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, evidence (the line, masked), pattern and last_pattern (numbers of the first and last that matched): of every line in which a match of a pattern begins, unless the line hints at a dummy. Matches may span lines; those of one line are one hit."""
    text = normalised(F.col("text"))
    each = F.array_compact(F.array(*(F.when(text.rlike(p), F.struct(F.lit(k).alias("k"), _hit_lines(text, p).alias("lines"))) for k, p in enumerate(PATTERNS))))
    found = docs.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.k", F.explode("f.lines").alias("x")).select("doc_id", "k", "x.line_no", masked(F.col("x.line")).alias("evidence"))
    return found.groupBy("doc_id", "line_no", "evidence").agg(F.min("k").alias("pattern"), F.max("k").alias("last_pattern"))


def secret_findings(files: DataFrame) -> DataFrame:
    """What secret_hits() finds in files (file_id, path, content), with the metadata that findings carry, told by the last pattern. hit: their order within the file."""
    one = secret_hits(files.select(F.col("file_id").alias("doc_id"), F.col("content").alias("text")))
    high = sensitive_file(F.col("path"))
    told = {"pattern": F.element_at(F.array(*map(F.lit, PATTERNS)), F.col("last_pattern") + 1), "masked": F.lit("true"), "cleartext_hint": F.lit("secret value masked in report"), "sensitive_file": F.when(high, "true"), "priority": F.when(high, "high")}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in told.items()))
    own = one.join(shuffled(files.select(F.col("file_id").alias("doc_id"), "path")), "doc_id")
    hit = F.col("pattern").cast("long") * (1 << 40) + F.col("line_no")
    return own.select(F.col("doc_id").alias("file_id"), "path", "line_no", hit.alias("hit"), F.lit("SEC-SECRET-001").alias("rule_id"), "evidence", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metadata"))
