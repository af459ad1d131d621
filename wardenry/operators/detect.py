"""Detectors: filters over lines that give findings. One row a line and detector; what stops a line is a guard column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markers import Marked, first_of, has_any, marker_bits, sql_has_any
from . import scans

# What shows that a query's values are bound, on the lower-case line.
_BOUND = r"(?:%s|%\([a-z_]\w*\)s|\?|:[a-z_]\w*)"
PARAMETERISED = "|".join((
    rf"\b(?:cursor|connection\.cursor\(\)|session|db\.session|engine|connection)\.execute(?:many)?\(\s*(?:text\()?[\"'][^\"']*{_BOUND}[^\"']*[\"']\s*\)?\s*,",
    rf"\bobjects\.raw\(\s*[\"'][^\"']*{_BOUND}[^\"']*[\"']\s*,",
    rf"\bquery\.from_statement\(\s*text\(\s*[\"'][^\"']*{_BOUND}[^\"']*[\"']\s*\)\s*,",
    r"\bjdbctemplate\.(?:query|update)\(\s*[\"'][^\"']*\?[^\"']*[\"']\s*,\s*[a-z_$]",
    r"\bnamedparameterjdbctemplate\.(?:query|update)\(\s*[\"'][^\"']*:[a-z_]\w*[^\"']*[\"']\s*,\s*[a-z_$]",
    r"\bconnection\.preparestatement\(\s*[\"'][^\"']*\?[^\"']*[\"']\s*\)",
    r"\b(?:entitymanager|session)\.create(?:native)?query\(\s*[\"'][^\"']*:[a-z_]\w*[^\"']*[\"']\s*\)\.setparameter\(",
))
ALLOWLIST = r"(?:is_allowed_url|isallowedurl|is_safe_url|issafeurl|url_is_allowed|urlisallowed|allowed_url|allowlisted_url|is_trusted_url|istrustedurl)\(.+\)|[a-z_$][\w$.]*\s+in\s+(?:allowed|trusted|safe|allowlisted)_[a-z_]"
ESCAPED = r"(?i)^\s*(?:(?:html|markupsafe|cgi|flask|django\.utils\.html)\.escape|escapehtml|escape_html|lodash\.escape|_\.escape|he\.encode)\(.+\);*\s*$"
BUILT = r"[+]|f[\"']|\.format\("

#: Languages whose lines are looked at alike.
SCRIPTS = ("javascript", "typescript", "json")
JVM = ("java", "kotlin")
#: Kinds of sources with their families, in the order in which an expression is told.
SOURCE_FAMILIES = (("query", "query"), ("body", "body"), ("cookies", "cookie"), ("headers", "headers"), ("auth_context", "auth_context"), ("request_input", "request_input"))
#: Kinds that a user can set, beside those that only frameworks name.
USER_INPUT = ("query", "body", "headers", "cookies", "path", "form", "request_input", "search_params", "route_param")
#: name: (rule, languages, sink family, source family or None, what lifts it: bound, allowed, escaped or None). Order is the order within a line.
DETECTORS: dict[str, tuple] = {
    "python_file": ("WEB-FILE-001", ("python",), "file_sink", "file_source", None),
    "python_orm": ("WEB-ORM-001", ("python",), "orm_sink", "orm_source", "bound"),
    "python_sqli": ("WEB-SQLI-001", ("python",), "sql_verb", "sql_call", "bound"),
    "python_template": ("WEB-TEMPLATE-001", ("python",), "python_template", None, "escaped"),
    "js_template": ("WEB-TEMPLATE-001", SCRIPTS, "js_template", None, "escaped"),
    "ssrf": ("WEB-SSRF-001", ("python", *SCRIPTS), "ssrf_sink", "ssrf_source", "allowed"),
    "path_traversal": ("WEB-PATH-001", ("python", *SCRIPTS), "path_sink", "path_source", None),
    "open_redirect": ("WEB-REDIRECT-001", ("python", *SCRIPTS), "redirect_sink", "redirect_source", "allowed"),
    "blade_template": ("WEB-TEMPLATE-001", ("php",), "blade_sink", "blade_source", "escaped"),
    "php_process": ("WEB-PROC-001", ("php",), "php_process", None, None),
    "php_ssrf": ("WEB-SSRF-001", ("php",), "php_ssrf", None, None),
    "php_redirect": ("WEB-REDIRECT-001", ("php",), "php_redirect", None, None),
    "php_path": ("WEB-PATH-001", ("php",), "php_path", None, None),
    "php_file": ("WEB-FILE-001", ("php",), "php_file", None, None),
    "spring_deserial": ("WEB-DESERIAL-001", JVM, "spring_deserial", None, None),
    "spring_sql": ("WEB-SQLI-001", JVM, "spring_sql", None, "bound"),
    "spring_ssrf": ("WEB-SSRF-001", JVM, "spring_ssrf", None, None),
    "spring_redirect": ("WEB-REDIRECT-001", JVM, "spring_redirect", None, None),
    "spring_path": ("WEB-PATH-001", JVM, "spring_path", None, None),
    "spring_file": ("WEB-FILE-001", JVM, "spring_file", None, None),
}


def parameterised(line: Column) -> Column:
    built = line.contains("+") | line.rlike("f[\"']") | F.lower(line).contains(".format(")
    return ~built & F.lower(line).rlike(PARAMETERISED)


def hits(name: str, line: Column | Marked, tainted: Column, sanitized: Column | None = None, guarded: Column | None = None) -> Column:
    """Whether the detector's line test holds. sanitized, guarded: whether the line's tainted data was escaped, or its URL checked."""
    rule, languages, sink, source, lifted = DETECTORS[name]
    text = line.text if isinstance(line, Marked) else line
    out = has_any(line, sink)
    if name in ("python_orm", "python_sqli"):
        out &= has_any(line, source) | text.contains("+") | text.rlike("f[\"']") | F.lower(text).contains(".format(") | tainted
    elif source:
        out &= has_any(line, source) | tainted
    if name == "spring_deserial":
        low = F.lower(text)
        out |= low.contains("objectinputstream") & (low.contains("readobject(") | low.contains("readunshared(")) | low.contains("objectmapper") & low.contains("readvalue(")
    no = F.lit(False)
    safe = text.rlike(ESCAPED) | (no if sanitized is None else sanitized)
    listed = F.lower(text).rlike(ALLOWLIST) | (no if guarded is None else guarded)
    return out & {"bound": ~parameterised(text), "allowed": ~listed, "escaped": ~safe, None: F.lit(True)}[lifted]


def detect(lines: DataFrame, name: str) -> DataFrame:
    """Findings of one detector over lines (file_id, line_no, language, line, tainted)."""
    found = lines.where(F.col("language").isin(*DETECTORS[name][1]) & hits(name, F.col("line"), F.col("tainted")))
    return found.select("file_id", "line_no", F.lit(DETECTORS[name][0]).alias("rule_id"), "line")


def guard_model(line: Column | Marked) -> Column:
    """What kind of guard a line is, in the order of trial; null: none. `guard` without a closer kind."""
    kinds = F.when(has_any(line, "auth_middleware"), "middleware").when(has_any(line, "auth_decorator"), "decorator").when(has_any(line, "auth_predicate"), "predicate").when(has_any(line, "role_guard"), "role_check").otherwise("guard")
    return F.when(has_any(line, "auth_guard") | has_any(line, "role_guard"), kinds)


def web_findings(lines: DataFrame, metadata: Column | None = None) -> DataFrame:
    """All detectors in one pass over the lines (file_id, line_no, language, line, tainted, bits (marker_bits(); made here if absent), and sanitized, guarded and route (where the file's missing_auth() stands) where they are known): flags become an array that is exploded.
    Without route, routes of files without authentication come from one aggregate and a join.

    An ORM hit ends a Python line after file access; an escaped template or DOM write ends a line before what follows it.
    A guard has severity info and confidence high. Its middleware is the same finding as the guard, and has the last word on what it is called.
    metadata: the column of a finding's metadata (over its detector and its line), if that is wanted: made of lines that have a finding alone.
    """
    if "bits" not in lines.columns:
        lines = lines.withColumn("bits", marker_bits(F.col("line")))
    line, tainted, language = Marked(F.col("line"), F.col("bits")), F.col("tainted"), F.col("language")
    sanitized, guarded = (F.col(c) if c in lines.columns else F.lit(False) for c in ("sanitized", "guarded"))
    python, script, php = language.eqNullSafe("python"), F.coalesce(language.isin(*SCRIPTS), F.lit(False)), language.eqNullSafe("php")
    orm, xss = hits("python_orm", line, tainted), script & has_any(line, "js_xss")
    sink = python & has_any(line, "python_template") | script & has_any(line, "js_template") | xss | php & has_any(line, "blade_sink") & (has_any(line, "blade_source") | tainted)
    escaped = (F.col("line").rlike(ESCAPED) | sanitized) & sink
    flags = {
        "auth_missing": ("WEB-AUTH-001", F.col("unguarded")),
        "auth_guard": ("WEB-AUTH-001", (python | script) & guard_model(line).isNotNull()),
    }
    for name, (rule, languages, *_) in DETECTORS.items():
        stop = F.lit(False) if name in ("python_file", "python_orm") else python & orm
        # Within a Python line these come before the template.
        if name not in ("python_file", "python_orm", "python_sqli"):
            stop |= escaped
        flags[name] = (rule, language.isin(*languages) & hits(name, line, tainted, sanitized, guarded) & ~stop)
        if name == "js_template":
            flags["js_xss"] = ("WEB-XSS-001", xss & ~escaped)
    found = [F.when(flag, F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("detector"), F.lit(rule).alias("rule_id"))) for i, (name, (rule, flag)) in enumerate(flags.items())]
    if "route" in lines.columns:
        known = lines.withColumn("unguarded", F.col("line_no").eqNullSafe(F.col("route")))
    else:
        routes = missing_auth(lines).select("file_id", "line_no", F.lit(True).alias("unguarded"))
        known = lines.join(scans.shuffled(routes), ["file_id", "line_no"], "left")
    each = known.withColumn("f", F.explode(F.array_compact(F.array(*found)))).select("*", "f.*")
    more, info = [c for c in ("path", "language", "framework") if c in lines.columns], F.col("detector") == "auth_guard"
    told = [] if metadata is None else [metadata.alias("metadata")]
    return each.select("file_id", "line_no", "line", "ordinal", "detector", "rule_id", F.when(info, "info").alias("severity"), F.when(info, "high").alias("confidence"), *more, *told)


def sql_of(name: str, tainted: str = "") -> str:
    """The detector over `code` (file_id, line_no, language, line) for DuckDB; without taint, unless a condition for tainted lines is given."""
    rule, languages, sink, source, lifted = DETECTORS[name]
    out = sql_has_any("line", sink)
    if source:
        more = " OR contains(line, '+') OR regexp_matches(line, 'f[\"'']') OR contains(lower(line), '.format(')" if name in ("python_orm", "python_sqli") else ""
        more += f" OR {tainted}" if tainted else ""
        out += f" AND ({sql_has_any('line', source)}{more})"
    if name == "spring_deserial":
        out = f"({out} OR contains(lower(line), 'objectinputstream') AND regexp_matches(lower(line), 'readobject\\(|readunshared\\(') OR contains(lower(line), 'objectmapper') AND contains(lower(line), 'readvalue('))"
    if lifted == "bound":
        quoted = PARAMETERISED.replace("'", "''")
        out += f" AND (contains(line, '+') OR regexp_matches(line, 'f[\"'']') OR contains(lower(line), '.format(') OR NOT regexp_matches(lower(line), '{quoted}'))"
    if lifted == "allowed":
        out += f" AND NOT regexp_matches(lower(line), '{ALLOWLIST}')"
    if lifted == "escaped":
        out += f" AND NOT regexp_matches(line, '{ESCAPED}')"
    return f"SELECT file_id, line_no, '{rule}' AS rule_id, line FROM code WHERE language IN ({', '.join(repr(x) for x in languages)}) AND {out}"


def source_kind(expression: Column) -> Column:
    return first_of(expression, SOURCE_FAMILIES)


def is_user_input(kind: Column) -> Column:
    return F.coalesce(kind.isin(*USER_INPUT), F.lit(False))


def missing_auth(lines: DataFrame) -> DataFrame:
    """Files with a route and request data but no authentication anywhere: file_id and the first route's line."""
    line = Marked(F.col("line"), F.col("bits")) if "bits" in lines.columns else F.col("line")
    flag = lambda family: F.bool_or(has_any(line, family))
    first = F.min(F.when(has_any(line, "missing_auth_route"), F.col("line_no")))
    found = lines.where(F.col("language").isin("python", "javascript", "typescript")).groupBy("file_id").agg(first.alias("line_no"), flag("missing_auth_request").alias("asks"), (flag("auth_guard") | flag("role_guard") | flag("auth_context")).alias("guarded"))
    return found.where("line_no IS NOT NULL AND asks AND NOT guarded").select("file_id", "line_no", F.lit("WEB-AUTH-001").alias("rule_id"))


#: The key under which a value is put.
PREFERENCE_KEY = r"(?i)put(?:string|charsequence)\(\s*[\"']([^\"']+)[\"']"


def shared_preferences(lines: DataFrame) -> DataFrame:
    """Plain storage of secrets on Android, told by two lines before and after."""
    low = F.lower("line")
    world = low.rlike("mode_world_readable|mode_world_writeable")
    plain = low.rlike(r"putstring\(|putcharsequence\(") & has_any(F.col("line"), "prefs_key")
    near = scans.around(lines.where(F.col("language").isin(*JVM)), 2, 2).where(has_any(F.col("context"), "prefs") & ~F.col("context").contains("encryptedsharedpreferences"))
    risk = F.when(world, "world_accessible_mode").when(plain, "sensitive_value_in_plaintext")
    mode = F.when(world, F.when(low.contains("mode_world_readable"), "world_readable").otherwise("world_writeable"))
    key = F.when(~world & plain, F.nullif(F.regexp_extract("line", PREFERENCE_KEY, 1), F.lit("")))
    return near.select("file_id", "line_no", F.lit("MOBILE-ANDROID-004").alias("rule_id"), risk.alias("storage_risk"), mode.alias("storage_mode"), key.alias("storage_key")).where("storage_risk IS NOT NULL")
