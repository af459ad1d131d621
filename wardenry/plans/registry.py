"""All queries of the engine by name, with the SQL that says what they return.

Corpora: `documents` as text files; `orders` as synthetic lines of code (see sources.corpus.TEMPLATES); `events` as synthetic
findings, with `supplier` and `customer` as baseline, suppressions and overrides; `part` as paths and manifests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markers import has_any, sql_first_of, sql_has_any
from ..operators import classify, dependencies, detect, findings, flows, frameworks, leaves, manifest, reports, rules, scans, secrets_scan, taint, taint_flow
from ..sources import tree
from ..sources.corpus import CODE_SQL, FLOW_SQL, code_lines, flow_lines, materialised, normalised, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "document_summary"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


_TEXT = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"
_MARKED = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, string_split(regexp_replace(x, '({p})', chr(64976) || '\\1', 'g'), chr(10)) AS l FROM t".replace(f"({p})", f"({p})".replace("'", "''")) for k, p in enumerate(secrets_scan.PATTERNS))
_HITS = f"""t AS (SELECT doc_id, {_TEXT} AS x FROM documents), m AS ({_MARKED}),
e AS (SELECT doc_id, k, line_no, regexp_replace(replace(l[line_no], chr(64976), ''), '{secrets_scan.ENDS}', '', 'g') AS line FROM (SELECT doc_id, k, l, unnest(range(1, len(l) + 1)) AS line_no FROM m) WHERE contains(l[line_no], chr(64976))),
shown AS (SELECT doc_id, line_no, regexp_replace(line, '{secrets_scan.VALUE.replace("'", "''")}', '\\1***\\2', 'g') AS evidence, min(k) AS pattern FROM e WHERE NOT {sql_has_any("line", "dummy_secret")} GROUP BY ALL)"""


@query(f"WITH {_HITS} SELECT * FROM shown")
def secret_hits(spark, d):
    return secrets_scan.secret_hits(docs(spark, d)).drop("last_pattern")


@query(f"WITH {_HITS} SELECT lang, count(*) AS n_hits, count(DISTINCT shown.doc_id) AS n_docs FROM shown JOIN documents USING (doc_id) GROUP BY lang")
def secrets_by_language(spark, d):
    return secrets_scan.secret_hits(docs(spark, d)).join(docs(spark, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {_HITS} SELECT doc_id, CAST(CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, chr(10), '')) + 1 END AS BIGINT) AS line_count, length(x) AS char_count, coalesce(n, 0) AS n_secrets, CASE WHEN coalesce(n, 0) > 0 THEN 'blocked' ELSE 'allowed' END AS decision FROM t LEFT JOIN (SELECT doc_id, count(*) AS n FROM shown GROUP BY 1) USING (doc_id)")
def document_summary(spark, d):
    text = normalised(F.col("text"))
    lines = F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)
    n_secrets = secrets_scan.secret_count(F.col("text"))
    return docs(spark, d).select("doc_id", lines.cast("long").alias("line_count"), F.length(text).cast("long").alias("char_count"), n_secrets.alias("n_secrets"), F.when(n_secrets > 0, "blocked").otherwise("allowed").alias("decision"))


# Documents as files

#: Where a document's file lies and what it holds besides the text, by key: a third of all lie in one folder.
_FILE_OF = """SELECT doc_id, doc_id % 16 AS kind, concat(CASE WHEN doc_id % 3 = 0 THEN 'all/' ELSE concat('d', CAST(doc_id % 97 AS STRING), '/') END, CASE doc_id % 16 WHEN 1 THEN 'node_modules/' ELSE '' END,
CAST(doc_id AS STRING), CASE doc_id % 16 WHEN 0 THEN '.PNG' WHEN 5 THEN '.log' WHEN 7 THEN '.md' ELSE '.txt' END) AS relative_path, coalesce(text, '') AS x FROM documents"""
_INCLUDE = ("*.txt", "*.PNG", "*.log")
_SCANNED = f"""own AS ({_FILE_OF.replace("AS STRING", "AS VARCHAR")}),
whole AS (SELECT kind, relative_path, CAST(CASE WHEN kind = 6 THEN 0 WHEN kind IN (3, 5) THEN strlen(x) + 1 ELSE strlen(x) END AS BIGINT) AS size, x, false AS link FROM own UNION ALL SELECT kind, concat(relative_path, '.txt'), NULL, NULL, true FROM own WHERE kind = 4),
scanned AS (SELECT relative_path, size, x, CASE WHEN link THEN 'symlink' WHEN kind = 7 THEN 'not included' WHEN kind = 1 THEN 'excluded' WHEN size = 0 THEN 'empty' WHEN kind IN (0, 3, 5) THEN 'binary' END AS skip_reason FROM whole)"""


def document_files(spark, d):
    """The documents written out as files, scanned: some are binary, empty, linked, or lie where they are left out."""
    own = spark.sql(_FILE_OF.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    before = F.expr("CASE kind WHEN 3 THEN X'00' WHEN 5 THEN X'FF' ELSE X'' END")
    none = F.lit(None).cast("string")
    files = own.select("relative_path", F.when(F.col("kind") != 6, F.concat(before, F.col("x").cast("binary"))).alias("content"), none.alias("link"))
    links = own.where("kind = 4").select(F.concat("relative_path", F.lit(".txt")).alias("relative_path"), F.lit(None).cast("binary").alias("content"), F.substring_index("relative_path", "/", -1).alias("link"))
    return tree.scanned(spark, tree.written(files.unionByName(links), "documents"), _INCLUDE)


@query(f"WITH {_SCANNED} SELECT relative_path, size, skip_reason, CASE WHEN skip_reason IS NULL THEN md5({_TEXT.replace('text', 'x')}) END AS text_md5 FROM scanned")
def file_scan(spark, d):
    return document_files(spark, d).select("relative_path", "size", "skip_reason", F.md5("text").alias("text_md5"))


_NOTE = "concat(CASE skip_reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tree.NOTES.items()) + " END, relative_path)"


@query(f"WITH {_SCANNED} SELECT relative_path, {_NOTE} AS note FROM scanned WHERE skip_reason IS NOT NULL")
def file_notes(spark, d):
    return tree.notes(document_files(spark, d), all_=True)


# Code lines


def code(spark, d):
    return code_lines(table(spark, d, "orders"))


def _detector(name):
    def run(spark, d):
        return detect.detect(code(spark, d).withColumn("tainted", F.lit(False)), name)

    query(f"WITH {CODE_SQL} {detect.sql_of(name)}", name)(run)


for _name in detect.DETECTORS:
    _detector(_name)

_ASSIGN = taint.ASSIGNMENT.replace("'", "''")
_DIRECT = sql_first_of("x", detect.SOURCE_FAMILIES)
_TAINT = f"""{CODE_SQL},
a AS (SELECT file_id, line_no, ltrim(lower(regexp_extract(line, '{_ASSIGN}', 1)), '$') AS target, regexp_extract(line, '{_ASSIGN}', 2) AS x FROM code WHERE regexp_matches(line, '{_ASSIGN}') AND NOT regexp_matches(line, '{taint.KEYWORDS}')),
k AS (SELECT *, {_DIRECT} AS kind, list_distinct(regexp_extract_all(lower(x), '[a-z_][a-z0-9_]*')) AS tokens FROM a),
t AS (SELECT file_id, line_no, target FROM k WHERE kind IS NOT NULL UNION SELECT k.file_id, k.line_no, k.target FROM t JOIN k ON k.file_id = t.file_id AND k.line_no > t.line_no AND list_contains(k.tokens, t.target)),
v AS (SELECT DISTINCT file_id, target FROM t)"""


@query(f"WITH RECURSIVE {_TAINT} SELECT file_id, string_agg(target, ',' ORDER BY target) AS variables FROM v GROUP BY file_id")
def taint_variables(spark, d):
    return taint.tainted_variables(code(spark, d)).select("file_id", F.array_join(F.array_sort("variables"), ",").alias("variables"))


@query(f"WITH RECURSIVE {_TAINT} SELECT DISTINCT code.file_id, line_no, line FROM code JOIN v ON v.file_id = code.file_id AND list_contains(regexp_extract_all(lower(line), '[a-z_][a-z0-9_]*'), target)")
def taint_lines(spark, d):
    return taint.with_taint(code(spark, d)).where("tainted").select("file_id", "line_no", "line")


@query(f"WITH {CODE_SQL}, a AS (SELECT file_id, line_no, line, regexp_extract(line, '{_ASSIGN}', 2) AS x FROM code WHERE regexp_matches(line, '{_ASSIGN}') AND NOT regexp_matches(line, '{taint.KEYWORDS}')) SELECT * FROM (SELECT file_id, line_no, {_DIRECT} AS kind FROM a) WHERE kind IS NOT NULL")
def taint_sources(spark, d):
    return taint.assignments(code(spark, d)).where("kind IS NOT NULL").select("file_id", "line_no", "kind")


# The queries above and orm_kinds and file_operations below look at a line alone, as their SQL says; *_with_taint are the whole detectors.
_TAINTED = f"WITH RECURSIVE {_TAINT}, u AS (SELECT DISTINCT code.file_id, line_no FROM code JOIN v ON v.file_id = code.file_id AND list_contains(regexp_extract_all(lower(line), '[a-z_][a-z0-9_]*'), target))"
_IS_TAINTED = "(file_id, line_no) IN (SELECT file_id, line_no FROM u)"


def _tainted(spark, d, name):
    return detect.detect(taint.with_taint(code(spark, d)), name)


def _detector_with_taint(name):
    query(f"{_TAINTED} {detect.sql_of(name, _IS_TAINTED)}", f"{name}_with_taint")(lambda spark, d: _tainted(spark, d, name))


for _name in detect.DETECTORS:
    if detect.DETECTORS[_name][3]:
        _detector_with_taint(_name)


def code_tables(spark, d):
    """The lines and the files that they make, each written once."""
    lines = materialised(code(spark, d), "lines")
    return lines, materialised(files_of(lines), "files")


def whole_code(lines, texts):
    """The lines with path, framework, the file's first unguarded route, data flow and the lines around. What is known of files is joined before the wide columns are there."""
    routes = detect.missing_auth(lines).select("file_id", F.col("line_no").alias("route"))
    files = texts.select("file_id", "path", frameworks.framework(F.col("language"), F.col("path"), F.col("content"))["framework"].alias("framework")).join(scans.shuffled(routes), "file_id", "left")
    # Written, for one plan of this and the detectors is a lot for the driver.
    return materialised(flows.with_context(taint_flow.with_flow(lines).join(scans.shuffled(files), "file_id")), "code")


@query()
def web_findings(spark, d):
    found = detect.web_findings(whole_code(*code_tables(spark, d)), flows.metadata())
    return found.withColumn("metadata", F.to_json("metadata"))


def packages_found(found, folder, name, ecosystem, stage):
    """What the advisories say of the packages in files of one name."""
    told = F.create_map(F.lit("advisory_id"), F.col("advisory_id"), F.lit("ecosystem"), F.lit(ecosystem), F.lit("dependency_scope"), F.col("scope") if "scope" in found.columns else F.lit("direct"))
    place = F.struct("file_id", F.lit(stage).alias("stage"), F.col("line").alias("line_no"), F.lit(0).cast("long").alias("k"))
    return found.withColumns({"path": F.concat(F.lit(f"{folder}/"), F.col("file_id").cast("string"), F.lit(f"/{name}")), "rule_id": F.lit("SCA-PACKAGE-001"), "start_line": F.col("line"), "evidence": F.concat("package", F.lit("=="), "version"), "metadata": told, "place": place})


def run(spark, d):
    """Findings of all detectors over code, manifests and dependencies, each id once: what the last says, where the first stood."""
    lines, texts = code_tables(spark, d)
    web = detect.web_findings(whole_code(lines, texts), flows.metadata()).withColumns({"stage": F.lit(1), "start_line": F.col("line_no"), "evidence": F.trim("line"), "place": F.struct("file_id", F.lit(1).alias("stage"), "line_no", F.col("ordinal").cast("long").alias("k"))})
    secret = secrets_scan.secret_findings(texts).join(scans.shuffled(texts.select("file_id", "language")), "file_id").withColumns({"start_line": F.col("line_no"), "place": F.struct("file_id", F.lit(0).alias("stage"), F.lit(0).cast("long").alias("line_no"), F.col("hit").alias("k"))})
    prefs = detect.shared_preferences(lines).join(scans.shuffled(lines.select("file_id", "line_no", "line", "language")), ["file_id", "line_no"]).join(scans.shuffled(texts.select("file_id", "path")), "file_id")
    told = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("storage_kind", F.lit("shared_preferences")), ("storage_risk", F.col("storage_risk")), ("shared_preferences_mode", F.col("storage_mode")), ("shared_preferences_key", F.col("storage_key")))))
    prefs = prefs.withColumns({"start_line": F.col("line_no"), "evidence": F.trim("line"), "metadata": F.map_from_entries(F.filter(told, lambda e: e["value"].isNotNull())), "place": F.struct("file_id", F.lit(3).alias("stage"), "line_no", F.lit(0).cast("long").alias("k"))})
    xml = android_files(spark, d).withColumns({"path": F.concat(F.lit("app/"), F.col("file_id").cast("string"), F.lit("/AndroidManifest.xml")), "language": F.lit("xml"), "framework": F.lit("android"), "start_line": F.lit(1).cast("long"), "place": F.struct("file_id", F.lit(2).alias("stage"), F.lit(1).cast("long").alias("line_no"), F.col("place").alias("k"))}).drop("package")
    packages = [
        packages_found(found, folder, name, ecosystem, stage)
        for stage, (found, folder, name, ecosystem) in enumerate(((sca_requirements(spark, d), "pins", "requirements.txt", "pypi"), (sca_package_json(spark, d), "npm", "package.json", "javascript"), (sca_package_lock(spark, d), "npm", "package-lock.json", "javascript")), 4)
    ]
    columns = {"rule_id": "string", "path": "string", "start_line": "long", "evidence": "string", "severity": "string", "confidence": "string", "package": "string", "version": "string", "language": "string", "framework": "string", "metadata": "map<string,string>"}
    all_ = None
    for part in (secret, web, xml, prefs, *packages):
        one = part.select(*((F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()), F.struct(F.col("place.stage").alias("stage"), "place").alias("seq"))
        all_ = one if all_ is None else all_.unionByName(one)
    return findings.last_wins(rules.emitted(all_))


@query()
def run_detectors(spark, d):
    return run(spark, d).select("id", "rule_id", "path", "start_line", "severity", "confidence", "title", "category", "language", "framework", "snippet", F.to_json("metadata").alias("metadata"))


@query()
def report_findings(spark, d):
    return run(spark, d).select("id", reports.finding_json().alias("json"))


#: Entries that triage meets in a scan: suppliers accept a file's first routes, customers ask for redirects to be left out, nations decide on their own file.
_SCAN_ENTRIES = {
    "baseline": "SELECT s_suppkey AS seq, 'WEB-AUTH-001' AS rule_id, concat(CAST(s_suppkey AS STRING), '/x') AS path, CAST(s_nationkey % 5 + 1 AS INT) AS start_line, CAST(NULL AS STRING) AS fingerprint, 'known' AS reason FROM {supplier}",
    "suppressions": "SELECT c_custkey AS seq, 'WEB-REDIRECT-001' AS rule_id, concat(CAST(c_custkey AS STRING), '/pages/x') AS path, CAST(c_nationkey % 9 + 1 AS INT) AS start_line, CAST(NULL AS STRING) AS expires_at, 'approved' AS review_status, 'fine' AS reason FROM {customer}",
    "overrides": "SELECT n_nationkey AS seq, 'WEB-TEMPLATE-001' AS rule_id, concat(CAST(n_nationkey AS STRING), '/x') AS path, CAST(n_nationkey % 7 + 1 AS INT) AS start_line, CAST(NULL AS STRING) AS expires_at, IF(n_nationkey % 2 = 0, 'suppressed', 'active') AS decision, 'seen' AS reason FROM {nation}",
}


def scan(spark, d):
    """run(), through triage, with its place in the report's order: bucket says which findings are active."""
    kinds = [spark.sql(q, **{x: table(spark, d, x) for x in ("supplier", "customer", "nation") if f"{{{x}}}" in q}) for q in _SCAN_ENTRIES.values()]
    all_ = materialised(run(spark, d).withColumn("reachability", F.col("metadata")["taint_reachability"]), "scan")
    triaged = findings.triaged(all_.withColumn("fingerprint", findings.fingerprint(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("snippet"))), *kinds, F.lit(_NOW).cast("timestamp"))
    return findings.in_order(triaged)


@query()
def scan_findings(spark, d):
    """Every finding of the scan: its place in the report, its bucket, and the entry that decided."""
    return scan(spark, d).select("id", "rule_id", "severity", "path", "start_line", "place", "bucket", "baseline_seq", "suppression_seq", "override_seq")


@query()
def sarif_objects(spark, d):
    active = materialised(scan(spark, d).where("bucket = 'active'"), "active")
    results = reports.sarif_result_objects(active, "id")
    return reports.sarif_rule_objects(active).select(F.lit("rule").alias("what"), F.col("rule_id").alias("id"), "json").unionByName(results.select(F.lit("result").alias("what"), "id", "json"))


#: How many findings of each rule a scan of the events table's severities would start from: rules by hand.
_CATALOG = """VALUES ('SEC-SECRET-001', 'high', 'secrets', 'pattern'), ('WEB-SQLI-001', 'high', 'injection', 'taint'), ('WEB-DESERIAL-001', 'high', 'deserialization', 'taint'), ('WEB-ORM-001', 'high', 'injection', 'taint'), ('WEB-XSS-001', 'high', 'xss', 'taint'), ('WEB-SSRF-001', 'high', 'ssrf', 'taint'),
('WEB-PATH-001', 'high', 'path_traversal', 'taint'), ('WEB-FILE-001', 'high', 'file_access', 'taint'), ('WEB-PROC-001', 'high', 'process_execution', 'taint'), ('MOBILE-ANDROID-001', 'medium', 'mobile', 'metadata'), ('MOBILE-ANDROID-002', 'medium', 'mobile', 'metadata'), ('MOBILE-ANDROID-003', 'medium', 'mobile', 'metadata'),
('MOBILE-ANDROID-004', 'medium', 'mobile', 'metadata'), ('WEB-REDIRECT-001', 'medium', 'open_redirect', 'taint'), ('WEB-AUTH-001', 'medium', 'authentication', 'taint'), ('WEB-TEMPLATE-001', 'high', 'template_injection', 'taint'), ('SCA-PACKAGE-001', 'high', 'sca', 'sca')"""


@query(f"WITH {CODE_SQL}, r(rule_id, severity, category, strategy) AS ({_CATALOG}), f AS (" + " UNION ALL ".join(detect.sql_of(n) for n in detect.DETECTORS) + ") SELECT r.rule_id, r.severity, r.category, r.strategy, count(f.file_id) AS n FROM r LEFT JOIN f USING (rule_id) GROUP BY ALL")
def rule_catalog(spark, d):
    """The rules, and how many lines of the code each finds by its line tests alone."""
    lines = code(spark, d).withColumn("tainted", F.lit(False))
    found = None
    for name in detect.DETECTORS:
        one = detect.detect(lines, name).select("rule_id")
        found = one if found is None else found.unionByName(one)
    counts = found.groupBy("rule_id").agg(F.count("*").alias("n"))
    return rules.rules(spark).join(counts, "rule_id", "left").select("rule_id", "severity", "category", "strategy", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {CODE_SQL}, r(rule_id, severity, category, strategy) AS ({_CATALOG}), f AS (" + " UNION ALL ".join(detect.sql_of(n) for n in detect.DETECTORS) + ") SELECT category, string_agg(rule_id, ',' ORDER BY severity = 'high' DESC, rule_id) AS rule_ids FROM r WHERE rule_id IN (SELECT rule_id FROM f) GROUP BY category")
def rules_by_category(spark, d):
    met = rule_catalog(spark, d).where("n > 0").select("rule_id")
    return rules.by_category(rules.rules(spark).join(met, "rule_id", "left_semi")).select("category", F.array_join("rule_ids", ",").alias("rule_ids"))


_ANY = lambda f: f"bool_or({sql_has_any('line', f)})"


@query(f"WITH {CODE_SQL} SELECT file_id, line_no, 'WEB-AUTH-001' AS rule_id FROM (SELECT file_id, min(line_no) FILTER ({sql_has_any('line', 'missing_auth_route')}) AS line_no, {_ANY('missing_auth_request')} AS asks, {_ANY('auth_guard')} OR {_ANY('role_guard')} OR {_ANY('auth_context')} AS guarded FROM code WHERE language IN ('python', 'javascript', 'typescript') GROUP BY 1) WHERE line_no IS NOT NULL AND asks AND NOT guarded")
def auth_missing(spark, d):
    return detect.missing_auth(code(spark, d))


@query(rf"""WITH {CODE_SQL} SELECT file_id, line_no, CASE WHEN regexp_matches(x, 'app\.use\(|router\.use\(|appmiddleware|routermiddleware|authmiddleware|middlewareauth|withauth|useauth\(|requireauth\(') THEN 'middleware'
WHEN regexp_matches(x, 'login_required|permission_required') THEN 'decorator' WHEN regexp_matches(x, 'is_authenticated|auth\(\)->check\(|auth::check\(') THEN 'predicate'
WHEN {sql_has_any("x", "role_guard")} THEN 'role_check' ELSE 'guard' END AS model FROM (SELECT *, lower(line) AS x FROM code) WHERE language IN ('python', 'javascript', 'typescript', 'json') AND ({sql_has_any("x", "auth_guard")} OR {sql_has_any("x", "role_guard")})""")
def auth_guard(spark, d):
    lines = code(spark, d).where(F.col("language").isin("python", *detect.SCRIPTS))
    return lines.select("file_id", "line_no", detect.guard_model(F.col("line")).alias("model")).where("model IS NOT NULL")


@query(f"WITH {CODE_SQL} SELECT file_id, line_no FROM code WHERE language IN ('javascript', 'typescript', 'json') AND (contains(lower(line), 'innerhtml') OR contains(lower(line), 'dangerouslysetinnerhtml') OR contains(lower(line), 'document.write'))")
def js_xss(spark, d):
    return code(spark, d).where(F.col("language").isin(*detect.SCRIPTS) & has_any(F.col("line"), "js_xss")).select("file_id", "line_no")


def _context(before, after):
    return lambda spark, d: scans.around(code(spark, d).where("language IN ('php', 'java', 'kotlin')"), before, after).select("file_id", "line_no", "context")


for _n, _b, _a in (("context_spring", 5, 0), ("context_laravel", 5, 1), ("context_preferences", 2, 2)):
    query(f"WITH {CODE_SQL} SELECT file_id, line_no, string_agg(lower(line), chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {_b} PRECEDING AND {_a} FOLLOWING) AS context FROM code WHERE language IN ('php', 'java', 'kotlin')", _n)(_context(_b, _a))


@query(rf"""WITH {CODE_SQL}, c AS (SELECT *, lower(line) AS x, string_agg(lower(line), chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM code WHERE language IN ('java', 'kotlin'))
SELECT file_id, line_no, 'MOBILE-ANDROID-004' AS rule_id, CASE WHEN w THEN 'world_accessible_mode' ELSE 'sensitive_value_in_plaintext' END AS storage_risk, CASE WHEN w AND contains(x, 'mode_world_readable') THEN 'world_readable' WHEN w THEN 'world_writeable' END AS storage_mode,
CASE WHEN NOT w THEN nullif(regexp_extract(line, '(?i)put(?:string|charsequence)\(\s*["'']([^"'']+)["'']', 1), '') END AS storage_key
FROM (SELECT *, regexp_matches(x, 'mode_world_readable|mode_world_writeable') AS w FROM c) WHERE contains(near, 'sharedpreferences') AND NOT contains(near, 'encryptedsharedpreferences')
AND (w OR regexp_matches(x, 'putstring\(|putcharsequence\(') AND regexp_matches(x, 'token|secret|password|passwd|passphrase|api_key|apikey|auth|session|jwt|credential|refresh'))""")
def shared_preferences(spark, d):
    return detect.shared_preferences(code(spark, d))


# Data flow

#: What each line of each snippet uses, by hand: language, snippet, part, variables, how it came, kind and part of the source, chain, escaped, guarded, reachability, part of the branch (0: none).
_USES = """VALUES
('python', 0, 1, 'a', 'assignment', 'query', 1, 'a', false, false, 'reachable', 0), ('python', 0, 2, 'b,a', 'assignment', 'query', 1, 'a,b', false, false, 'reachable', 0), ('python', 0, 3, 'b', 'assignment', 'query', 1, 'a,b', false, false, 'reachable', 0),
('python', 1, 2, 'item', 'function_call', 'body', 4, 'c,item', false, false, 'reachable', 0), ('python', 1, 4, 'c', 'assignment', 'body', 4, 'c', false, false, 'reachable', 0),
('python', 1, 5, 'd,load,c', 'return_value', 'body', 4, 'c,item,part,load,d', false, false, 'reachable', 0), ('python', 1, 6, 'd', 'return_value', 'body', 4, 'c,item,part,load,d', false, false, 'reachable', 0),
('python', 2, 1, 'e', 'container', 'cookies', 2, 'e', false, false, 'reachable', 0), ('python', 2, 2, 'e', 'container', 'cookies', 2, 'e', false, false, 'reachable', 0),
('python', 2, 3, 'f,e', 'container', 'cookies', 2, 'e,f', false, false, 'reachable', 0), ('python', 2, 4, 'f', 'container', 'cookies', 2, 'e,f', false, false, 'reachable', 0),
('python', 3, 1, 'g', 'assignment', 'headers', 1, 'g', false, false, 'reachable', 0), ('python', 3, 2, 'obj.body,g', 'field', 'headers', 1, 'g,obj.body', false, false, 'reachable', 0),
('python', 3, 3, 'obj.body,h', 'field', 'headers', 1, 'g,obj.body', false, false, 'reachable', 0), ('python', 3, 4, 'h', 'field', 'headers', 1, 'g,obj.body,h', false, false, 'reachable', 0),
('python', 4, 1, 'u', 'assignment', 'query', 1, 'u', false, false, 'reachable', 0), ('python', 4, 2, 'u', 'assignment', 'query', 1, 'u', false, false, 'reachable', 0), ('python', 4, 3, 'v,u', 'assignment', 'query', 1, 'u,v', false, true, 'reachable', 2),
('python', 4, 4, 'v', 'assignment', 'query', 1, 'u,v', false, true, 'reachable', 2), ('python', 4, 6, 'u', 'assignment', 'query', 1, 'u', false, false, 'reachable', 0),
('python', 5, 1, 's', 'assignment', 'query', 1, 's', true, false, 'reachable', 0), ('python', 5, 2, 's', 'assignment', 'query', 1, 's', true, false, 'reachable', 0),
('javascript', 0, 1, 'a', 'assignment', 'query', 1, 'a', false, false, 'reachable', 0), ('javascript', 0, 2, 'a', 'assignment', 'query', 1, 'a', false, false, 'reachable', 0),
('javascript', 1, 2, 'x', 'function_call', 'body', 5, 'x', false, false, 'reachable', 0), ('javascript', 1, 5, 'z,wrap', 'return_value', 'body', 5, 'x,y,wrap,z', false, false, 'reachable', 0), ('javascript', 1, 6, 'z', 'return_value', 'body', 5, 'x,y,wrap,z', false, false, 'reachable', 0),
('javascript', 2, 1, 'q', 'assignment', 'cookies', 1, 'q', false, false, 'reachable', 0), ('javascript', 2, 3, 'q', 'assignment', 'cookies', 1, 'q', false, false, 'reachable', 0), ('javascript', 2, 4, 'r,q', 'assignment', 'cookies', 1, 'q,r', false, false, 'unreachable', 2),
('javascript', 3, 1, 'm', 'container', 'headers', 2, 'm', false, false, 'reachable', 0), ('javascript', 3, 2, 'm', 'container', 'headers', 2, 'm', false, false, 'reachable', 0), ('javascript', 3, 3, 'n,m', 'container', 'headers', 2, 'm,n', false, false, 'reachable', 0),
('javascript', 3, 4, 'n', 'container', 'headers', 2, 'm,n', false, false, 'reachable', 0)"""
_BRANCHES = "VALUES ('python', 4, 3, 'if', 2, false, true), ('python', 4, 4, 'if', 2, false, true), ('python', 4, 6, 'elif', 5, false, false), ('javascript', 2, 3, 'if', 2, true, false), ('javascript', 2, 4, 'if', 2, true, false), ('javascript', 2, 5, 'if', 2, true, false)"
_FUNCTIONS = "VALUES ('python', 1, 'load', 'item', 2, 3), ('javascript', 1, 'wrap', 'x', 2, 4)"
_KEYED = "array_to_string(list_transform(string_split({0}, ','), lambda v: CASE v WHEN 'obj.body' THEN 'obj_' || key || '.body' ELSE v || '_' || key END), ',')"


def flow(spark, d):
    return flow_lines(table(spark, d, "orders"))


@query(f"""WITH {FLOW_SQL}, e(language, snippet, part, variables, propagation, source_kind, source_part, chain, sanitized, guarded, reachability, branch_part) AS ({_USES})
SELECT file_id, line_no, {_KEYED.format('variables')} AS variables, propagation, source_kind, line_no - part + source_part AS source_line, {_KEYED.format('chain')} AS chain, sanitized, guarded, reachability, CASE WHEN branch_part > 0 THEN line_no - part + branch_part END AS branch_line FROM flow JOIN e USING (language, snippet, part)""")
def taint_uses(spark, d):
    listed = lambda c: F.array_join(c, ",").alias(c)
    # Written once, for six scans read them.
    told = taint_flow.line_uses(materialised(flow(spark, d), "lines"))
    return told.select("file_id", "line_no", listed("variables"), "propagation", "source_kind", "source_line", listed("chain"), F.col("sanitizer").isNotNull().alias("sanitized"), F.col("guard_call").isNotNull().alias("guarded"), "reachability", "branch_line")


@query(f"""WITH {FLOW_SQL}, e(language, snippet, part, branch_kind, branch_part, dead, guarded) AS ({_BRANCHES}) SELECT file_id, line_no, branch_kind, line_no - part + branch_part AS branch_line, dead, guarded FROM flow JOIN e USING (language, snippet, part)""")
def taint_branches(spark, d):
    return taint_flow.branches(flow(spark, d)).select("file_id", "line_no", "branch_kind", "branch_line", "dead", F.col("guard_call").isNotNull().alias("guarded"))


@query(f"""WITH {FLOW_SQL}, e(language, snippet, name, parameters, first_part, last_part) AS ({_FUNCTIONS}) SELECT file_id, name || '_' || key AS name, parameters || '_' || key AS parameters, line_no - part + first_part AS first, line_no - part + last_part AS last FROM flow JOIN e USING (language, snippet) WHERE part = 1""")
def taint_functions(spark, d):
    return taint_flow.shapes(flow(spark, d)).where("what = 'function'").select("file_id", F.col("kind").alias("name"), F.array_join("parameters", ",").alias("parameters"), "first", "last")


@query(f"""WITH {FLOW_SQL}, e(language, snippet, part, kind) AS (VALUES ('python', 0, 1, 'variable'), ('python', 0, 2, 'variable'), ('python', 1, 4, 'variable'), ('python', 1, 5, 'variable'), ('python', 2, 2, 'variable'), ('python', 2, 3, 'variable'), ('python', 3, 1, 'variable'), ('python', 3, 2, 'field'), ('python', 3, 3, 'variable'),
('python', 4, 1, 'variable'), ('python', 4, 3, 'variable'), ('python', 5, 1, 'variable'), ('javascript', 0, 1, 'variable'), ('javascript', 1, 5, 'variable'), ('javascript', 2, 1, 'variable'), ('javascript', 2, 4, 'variable'), ('javascript', 3, 2, 'variable'), ('javascript', 3, 3, 'variable'))
SELECT file_id, kind AS scope, count(*) AS n FROM flow JOIN e USING (language, snippet, part) GROUP BY file_id, kind""")
def taint_scopes(spark, d):
    lines = materialised(flow(spark, d).select("file_id", "line_no", "line"), "lines")
    return taint_flow.followed(lines, columns=("file_id", "scope", "variable")).where("scope <> 'lines'").groupBy("file_id", "scope").agg(F.count_distinct("variable").alias("n"))


# Findings

_FINDINGS = """SELECT event_id AS seq, concat('R-', CAST(user_id % 17 AS STRING)) AS rule_id, concat('src/app', CAST(user_id % 23 AS STRING), '.py') AS path, CAST(event_id % 13 + 1 AS INT) AS start_line,
CASE event_type WHEN 'click' THEN 'info' WHEN 'view' THEN 'low' WHEN 'signup' THEN 'medium' WHEN 'purchase' THEN 'high' ELSE 'critical' END AS severity,
CASE event_id % 4 WHEN 0 THEN 'reachable' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'unknown' ELSE NULL END AS reachability, event_type AS title FROM events"""
_F = "f AS (" + _FINDINGS.replace("AS STRING", "AS VARCHAR") + "), i AS (SELECT *, concat_ws(':', rule_id, path, CAST(start_line AS VARCHAR)) AS id FROM f)"
_RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], severity)"
_REACH = "CASE WHEN reachability IS NULL OR reachability = 'reachable' THEN 0 WHEN reachability = 'unreachable' THEN 2 ELSE 1 END"


def found(spark, d):
    events = table(spark, d, "events")
    return spark.sql(_FINDINGS.replace("FROM events", "FROM {events}"), events=events).withColumn("id", findings.finding_id(F.col("rule_id"), F.col("path"), F.col("start_line")))


@query(f"WITH {_F} SELECT seq, sha256(rule_id || '::' || path || '::' || start_line || '::' || title) AS fingerprint FROM i")
def finding_fingerprint(spark, d):
    return found(spark, d).select("seq", findings.fingerprint(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("title")).alias("fingerprint"))


@query(f"WITH {_F} SELECT id, min(seq) AS seq, arg_max(severity, seq) AS severity, arg_max(title, seq) AS title FROM i GROUP BY id")
def finding_dedupe(spark, d):
    return findings.last_wins(found(spark, d).select("id", "seq", "severity", "title"))


@query(f"WITH {_F} SELECT severity, place, seq FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY path, start_line, rule_id, seq) AS place FROM i) WHERE place <= 5")
def severity_top5(spark, d):
    return findings.top_per_severity(found(spark, d)).select("severity", F.col("place").cast("long").alias("place"), "seq")


@query(f"WITH {_F} SELECT seq, row_number() OVER (ORDER BY {_RANK} DESC, {_REACH}, path, start_line, rule_id, seq) AS place FROM i")
def finding_order(spark, d):
    return findings.in_order(found(spark, d)).select("seq", "place")


@query(f"WITH {_F}, s(severity, place) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('info', 4)), o AS (SELECT severity, seq, row_number() OVER (PARTITION BY severity ORDER BY path, start_line, rule_id, seq) AS k FROM i) SELECT place, s.severity, count(seq) AS total, coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5), '') AS shown, greatest(count(seq) - 5, 0) AS more FROM s LEFT JOIN o USING (severity) GROUP BY ALL")
def severity_buckets(spark, d):
    return findings.top_with_rest(found(spark, d)).withColumn("shown", F.array_join(F.col("shown").cast("array<string>"), ","))


@query(f"WITH {_F} SELECT path, bool_or({_RANK} >= 4) AS blocked, count(*) AS n, CASE WHEN bool_or({_RANK} >= 4) THEN 'blocked' ELSE 'allowed' END AS decision FROM i GROUP BY path")
def policy_gate(spark, d):
    over = F.bool_or(findings.rank(F.col("severity")) >= 4)
    return found(spark, d).groupBy("path").agg(over.alias("blocked"), F.count("*").alias("n")).withColumn("decision", F.when(F.col("blocked"), "blocked").otherwise("allowed"))


@query(f"WITH {_F} SELECT severity, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM i GROUP BY ALL")
def sarif_levels(spark, d):
    return found(spark, d).groupBy("severity", findings.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


@query(f"WITH {_F} SELECT seq FROM i WHERE severity IN ('high', 'critical') AND (contains(lower(title), 'app1') OR contains(lower(rule_id), 'app1') OR contains(lower(path), 'app1') OR contains(lower(severity), 'app1'))")
def findings_search(spark, d):
    any_of = F.lit(False)
    for c in ("title", "rule_id", "path", "severity"):
        any_of |= F.contains(F.lower(c), F.lit("app1"))
    return found(spark, d).where(any_of & F.col("severity").isin("high", "critical")).select("seq")


_ENTRIES = {
    "baseline": "SELECT s_suppkey AS seq, concat('R-', CAST(s_suppkey % 17 AS STRING)) AS rule_id, concat('./app', CAST(s_suppkey % 23 AS STRING), '.py') AS path, CAST(s_nationkey % 13 + 1 AS INT) AS start_line, CASE s_suppkey % 3 WHEN 0 THEN {sha}concat('R-', CAST(s_suppkey % 17 AS STRING), '::src/app', CAST(s_suppkey % 23 AS STRING), '.py::', CAST(s_nationkey % 13 + 1 AS STRING), '::click'){end} WHEN 1 THEN 'none' ELSE NULL END AS fingerprint, concat('known ', CAST(s_suppkey AS STRING)) AS reason FROM supplier",
    "suppressions": "SELECT c_custkey AS seq, concat('R-', CAST(c_custkey % 17 AS STRING)) AS rule_id, concat('app', CAST(c_custkey % 23 AS STRING), '.py') AS path, CAST(c_nationkey % 13 + 1 AS INT) AS start_line, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-01T00:00:00' WHEN c_custkey % 3 = 1 THEN '2026-01-01T00:00:00' ELSE NULL END AS expires_at, CASE WHEN c_custkey % 5 = 0 THEN 'pending' ELSE 'approved' END AS review_status, 'reviewed' AS reason FROM customer",
    "overrides": "SELECT p_partkey AS seq, concat('R-', CAST(p_partkey % 17 AS STRING)) AS rule_id, concat('src/app', CAST(p_partkey % 23 AS STRING), '.py') AS path, CAST(p_size % 13 + 1 AS INT) AS start_line, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-01T00:00:00' ELSE NULL END AS expires_at, CASE WHEN p_partkey % 2 = 0 THEN 'suppressed' ELSE 'active' END AS decision, 'by hand' AS reason FROM part",
}
_NOW = "2025-01-01 00:00:00"


def entries(spark, d, kind):
    source = {"baseline": "supplier", "suppressions": "customer", "overrides": "part"}[kind]
    return spark.sql(_ENTRIES[kind].replace("{sha}", "sha2(").replace("{end}", ", 256)").replace(f"FROM {source}", "FROM {rows}"), rows=table(spark, d, source))


def triage(spark, d):
    marked = found(spark, d).withColumn("fingerprint", findings.fingerprint(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("title")))
    return findings.triaged(marked, *(entries(spark, d, k) for k in ("baseline", "suppressions", "overrides")), F.lit(_NOW).cast("timestamp"))


def _match(k, where="true", more=""):
    return f"(SELECT i.seq, arg_min(e, e.seq) AS e FROM i JOIN (SELECT * FROM {k} WHERE {where}) e ON e.rule_id = i.rule_id AND e.start_line = i.start_line AND ends_with(ltrim(i.path, './'), ltrim(e.path, './')){more} GROUP BY i.seq)"


_VALID = f"expires_at IS NULL OR CAST(expires_at AS TIMESTAMP) > TIMESTAMP '{_NOW}'"
_TRIAGE = f"WITH {_F}, " + ", ".join(f"{k} AS ({v.replace('AS STRING', 'AS VARCHAR').replace('{sha}', 'sha256(').replace('{end}', ')')})" for k, v in _ENTRIES.items()) + f""", b AS (SELECT i.*, o.e.decision AS decision, CASE WHEN o.e.decision = 'suppressed' THEN 'suppressed' WHEN o.e.decision IS NOT NULL THEN 'active' WHEN l.e.seq IS NOT NULL THEN 'baselined' WHEN s.e.seq IS NOT NULL THEN 'suppressed' ELSE 'active' END AS bucket, l.e.seq AS baseline_seq, s.e.seq AS suppression_seq, o.e.seq AS override_seq, CASE WHEN o.e.seq IS NOT NULL THEN 'manual_override' WHEN l.e.seq IS NOT NULL THEN 'baseline' WHEN s.e.seq IS NOT NULL THEN 'suppression' END AS action, coalesce(o.e.reason, l.e.reason, s.e.reason) AS reason
FROM i LEFT JOIN {_match("overrides", _VALID)} o ON o.seq = i.seq LEFT JOIN {_match("baseline", more=" AND (e.fingerprint IS NULL OR length(e.fingerprint) <> 64 OR e.fingerprint = sha256(i.rule_id || '::' || i.path || '::' || i.start_line || '::' || i.title))")} l ON l.seq = i.seq LEFT JOIN {_match("suppressions", f"review_status = 'approved' AND ({_VALID})")} s ON s.seq = i.seq)"""


@query(f"{_TRIAGE} SELECT seq, bucket, baseline_seq, suppression_seq, override_seq FROM b")
def triage_buckets(spark, d):
    return triage(spark, d).select("seq", "bucket", "baseline_seq", "suppression_seq", "override_seq")


@query(f"{_TRIAGE} SELECT bucket, severity, count(*) AS n FROM b GROUP BY ALL")
def triage_counts(spark, d):
    return triage(spark, d).groupBy("bucket", "severity").agg(F.count("*").alias("n"))


@query(f"{_TRIAGE} SELECT seq FROM b WHERE bucket = 'active'")
def triage_active(spark, d):
    return triage(spark, d).where("bucket = 'active'").select("seq")


@query(f"{_TRIAGE} SELECT seq, action, 'finding' AS subject_type, id AS subject_id, CASE action WHEN 'manual_override' THEN decision WHEN 'baseline' THEN 'baselined' ELSE 'suppressed' END AS decision, reason, concat(action, ' finding:', id, ' decision=', CASE action WHEN 'manual_override' THEN decision WHEN 'baseline' THEN 'baselined' ELSE 'suppressed' END, ' reason=', reason) AS summary FROM b WHERE action IS NOT NULL")
def audit_rows(spark, d):
    return findings.audit(triage(spark, d)).withColumn("summary", reports.audit_summary()).drop("metadata")


@query(f"{_TRIAGE} SELECT seq, bucket, decision FROM b WHERE override_seq IS NOT NULL")
def overridden_findings(spark, d):
    return findings.overridden(triage(spark, d)).select("seq", "bucket", "decision")


@query(f"{_TRIAGE}, {_SCANNED} SELECT (SELECT count(*) FROM scanned) AS files_seen, (SELECT count(*) FROM scanned WHERE skip_reason IS NULL) AS files_selected, count(*) FILTER (bucket = 'active') AS findings, count(*) FILTER (bucket = 'baselined') AS baselined_findings, count(*) FILTER (bucket = 'suppressed') AS suppressed_findings FROM b")
def scan_counters(spark, d):
    count = lambda b: F.count_if(F.col("bucket") == b)
    return tree.counters(document_files(spark, d)).crossJoin(triage(spark, d).agg(count("active").alias("findings"), count("baselined").alias("baselined_findings"), count("suppressed").alias("suppressed_findings")))


@query(f"WITH {_F}, u AS (SELECT id, max(seq) AS seq FROM i WHERE seq % 5 = 0 GROUP BY id) SELECT i.seq, CASE WHEN u.id IS NULL THEN 'untriaged' WHEN u.seq % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS triage_status, CASE WHEN u.seq % 3 = 0 THEN 'note ' || u.seq END AS triage_reason FROM i LEFT JOIN u USING (id)")
def triage_updates(spark, d):
    own = found(spark, d).withColumns({"triage_status": F.lit("untriaged"), "triage_reason": F.lit(None).cast("string"), "triage_note": F.lit(None).cast("string")})
    new = own.where("seq % 5 = 0").select("id", "seq", F.when(F.col("seq") % 2 == 0, "accepted").otherwise("rejected").alias("triage_status"), F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" note "), F.col("seq"), F.lit(" "))).otherwise(" ").alias("triage_reason"), F.lit("").alias("triage_note"))
    return findings.triage_updated(own, new).select("seq", "triage_status", "triage_reason")


@query(f"WITH {_F} SELECT path, count(*) AS n, CASE WHEN bool_or({_RANK} >= 3) THEN 'blocked' ELSE 'allowed' END AS decision FROM i GROUP BY path")
def policy_by_branch(spark, d):
    return findings.decision_over(found(spark, d), findings.threshold("critical", "release", {"release": "medium"}), "path")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE ['query', 'auth_context', 'route_param'][event_id % 4 + 1] END AS kind, event_id % 4 IN (0, 2) AS user_input FROM events")
def user_input_kinds(spark, d):
    kind = F.element_at(F.array(F.lit("query"), F.lit("auth_context"), F.lit("route_param"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", kind.alias("kind")).withColumn("user_input", detect.is_user_input(F.col("kind")))


# Paths and manifests

_EXT = ["py", "js", "ts", "java", "kt", "php", "json", "toml", "xml", "txt", "bin", "TSX"]
_PATHS = f"SELECT p_partkey AS file_id, concat('src/', p_brand, '/', CAST(p_partkey AS STRING), '.', CASE p_partkey % {len(_EXT)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_EXT)) + " END) AS path FROM part"


@query(f"SELECT file_id, path, {classify.language_sql('path')} AS language FROM ({_PATHS.replace('AS STRING', 'AS VARCHAR')})")
def classify_language(spark, d):
    return spark.sql(_PATHS.replace("FROM part", "FROM {rows}"), rows=table(spark, d, "part")).withColumn("language", classify.language(F.col("path")))


@query(f"SELECT language, count(*) AS n FROM (SELECT {classify.language_sql('path')} AS language FROM ({_PATHS.replace('AS STRING', 'AS VARCHAR')})) GROUP BY 1")
def language_counts(spark, d):
    return classify_language(spark, d).groupBy("language").agg(F.count("*").alias("n"))


_REQ = "SELECT p_partkey AS file_id, concat('# pins', chr(10), CASE WHEN p_partkey % 3 = 0 THEN 'Flask' ELSE 'numpy' END, '==', CAST(p_size AS STRING), '.0', chr(10), 'requests==2.', CAST(p_partkey % 9 AS STRING), chr(10), 'click>=8') AS content FROM part"
_ADV = "(VALUES " + ", ".join(map(str, findings.ADVISORIES)) + ") v(name, advisory_id, severity)"


@query(f"WITH l AS (SELECT file_id, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM ({_REQ.replace('AS STRING', 'AS VARCHAR')})), d AS (SELECT file_id, line, string_split(content, chr(10))[line] AS x FROM l), p AS (SELECT file_id, line, split_part(x, '==', 1) AS package, split_part(x, '==', 2) AS version FROM d WHERE contains(x, '==') AND x NOT LIKE '#%') SELECT file_id, line, package, version, advisory_id, severity FROM p JOIN {_ADV} ON lower(package) = name")
def sca_requirements(spark, d):
    files = spark.sql(_REQ.replace("FROM part", "FROM {rows}"), rows=table(spark, d, "part"))
    return dependencies.vulnerable(dependencies.requirements(files)).select("file_id", "line", "package", "version", "advisory_id", "severity")


_NPM = """SELECT p_partkey AS file_id, concat('{"dependencies": {"express": "', CAST(p_size AS STRING), '", "left-pad": "1"}, "devDependencies": {"', CASE WHEN p_partkey % 2 = 0 THEN 'lodash' ELSE 'jest' END, '": "4"}}') AS content FROM part"""


@query(f"WITH f AS ({_NPM.replace('AS STRING', 'AS VARCHAR')}), k AS (SELECT file_id, content, s, unnest(json_keys(content, '$.' || s)) AS package FROM f, (VALUES ('dependencies'), ('devDependencies')) t(s)), p AS (SELECT file_id, CAST(1 AS BIGINT) AS line, package, json_extract_string(content, '$.' || s || '.\"' || package || '\"') AS version FROM k) SELECT file_id, line, package, version, advisory_id, severity FROM p JOIN {_ADV} ON lower(package) = name")
def sca_package_json(spark, d):
    files = table(spark, d, "part").selectExpr("p_partkey AS file_id", _NPM.split("file_id, ", 1)[1].rsplit(" FROM", 1)[0])
    return dependencies.vulnerable(dependencies.package_json(files)).select("file_id", "line", "package", "version", "advisory_id", "severity")


# Flows by framework


def _flow(framework):
    return lambda spark, d: flows.line_flows(code(spark, d), framework)


for _f in ("express", "nextjs", "django"):
    query(f"WITH {CODE_SQL} SELECT * FROM (SELECT file_id, line_no, {sql_first_of('line', flows.SOURCES[_f])} AS source_kind FROM code WHERE language IN ({', '.join(map(repr, flows.LANGUAGES[_f]))})) WHERE source_kind IS NOT NULL", f"flow_{_f}")(_flow(_f))


@query(f"WITH {CODE_SQL}, c AS (SELECT file_id, line_no, string_agg(lower(line), chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM code WHERE language IN ('java', 'kotlin')) SELECT * FROM (SELECT file_id, line_no, {sql_first_of('x', flows.SOURCES['spring'])} AS source_kind, {sql_first_of('x', flows.HANDLERS)} AS handler_kind, {sql_first_of('x', flows.ENTRIES)} AS entry_kind FROM c) WHERE coalesce(source_kind, handler_kind, entry_kind) IS NOT NULL")
def flow_spring(spark, d):
    return flows.spring_flows(code(spark, d))


@query(f"WITH {CODE_SQL} SELECT file_id, line_no, {sql_first_of('line', flows.PROCESSES, 'shell_command')} AS process_kind FROM code WHERE language = 'php' AND {sql_has_any('line', 'php_process')}")
def process_kinds(spark, d):
    return flows.process_kinds(detect.detect(code(spark, d).withColumn("tainted", F.lit(False)), "php_process"))


def _plain(spark, d, name):
    return detect.detect(code(spark, d).withColumn("tainted", F.lit(False)), name)


@query(f"WITH {CODE_SQL} SELECT file_id, line_no, {sql_first_of('line', flows.ORMS, 'generic_orm')} AS orm_model, {sql_first_of('line', (('raw_sql', 'orm_raw'),))} AS query_kind FROM ({detect.sql_of('python_orm')})")
def orm_kinds(spark, d):
    return flows.orm_kinds(_plain(spark, d, "python_orm"))


@query(f"{_TAINTED} SELECT file_id, line_no, {sql_first_of('line', flows.ORMS, 'generic_orm')} AS orm_model, {sql_first_of('line', (('raw_sql', 'orm_raw'),))} AS query_kind FROM ({detect.sql_of('python_orm', _IS_TAINTED)})")
def orm_kinds_with_taint(spark, d):
    return flows.orm_kinds(_tainted(spark, d, "python_orm"))


@query(f"WITH {CODE_SQL} SELECT file_id, line_no, {sql_first_of('line', flows.FILE_OPERATIONS)} AS file_operation FROM ({detect.sql_of('python_file')})")
def file_operations(spark, d):
    return flows.file_operations(_plain(spark, d, "python_file"))


@query(f"{_TAINTED} SELECT file_id, line_no, {sql_first_of('line', flows.FILE_OPERATIONS)} AS file_operation FROM ({detect.sql_of('python_file', _IS_TAINTED)})")
def file_operations_with_taint(spark, d):
    return flows.file_operations(_tainted(spark, d, "python_file"))


# Frameworks

_FILES = f"WITH {CODE_SQL}, f AS (SELECT file_id, language, concat('src/', CAST(file_id AS VARCHAR), CASE file_id % 5 WHEN 0 THEN '/settings.py' WHEN 1 THEN '/pages/x' WHEN 2 THEN '/src/main/java/x' ELSE '/x' END) AS path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM code GROUP BY file_id, language)"
_FRAMEWORK = ", ".join(f"{frameworks.framework_sql(x)} AS {x}" for x in ("framework", "confidence", "signal"))


def code_files(spark, d):
    """file_id, language, path, content: the synthetic lines as files. A file is one customer's orders, so a group stays small."""
    return files_of(code(spark, d))


def files_of(lines):
    lines = lines.groupBy("file_id", "language").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    tail = F.when(F.col("file_id") % 5 == 0, "/settings.py").when(F.col("file_id") % 5 == 1, "/pages/x").when(F.col("file_id") % 5 == 2, "/src/main/java/x").otherwise("/x")
    return lines.select("file_id", "language", F.concat(F.lit("src/"), F.col("file_id").cast("string"), tail).alias("path"), F.array_join("l.line", "\n").alias("content"))


@query(f"{_FILES} SELECT file_id, {_FRAMEWORK} FROM f")
def classify_framework(spark, d):
    return code_files(spark, d).select("file_id", frameworks.framework(F.col("language"), F.col("path"), F.col("content")).alias("k")).select("file_id", "k.*")


@query(f"{_FILES}, k AS (SELECT {_FRAMEWORK} FROM f) SELECT framework, count(*) AS n FROM k WHERE framework IS NOT NULL GROUP BY framework")
def framework_counts(spark, d):
    return classify_framework(spark, d).where("framework IS NOT NULL").groupBy("framework").agg(F.count("*").alias("n"))


@query(f"WITH f AS (SELECT p_partkey AS file_id, 'json' AS language, 'a/package.json' AS path, concat('{{\"name\": \"x\", \"dependencies\": {{\"', CASE p_partkey % 5 WHEN 0 THEN 'next' WHEN 1 THEN 'express' WHEN 2 THEN 'react' WHEN 3 THEN 'react-native' ELSE 'vue' END, '\": \"1\"}}}}') AS content FROM part) SELECT file_id, {_FRAMEWORK} FROM f")
def classify_package_json(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("next", "express", "react", "react-native", "vue"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    content = F.concat(F.lit('{"name": "x", "dependencies": {"'), name, F.lit('": "1"}}'))
    return table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), frameworks.framework(F.lit("json"), F.lit("a/package.json"), content).alias("k")).select("file_id", "k.*")


# Android manifests

_XML = """concat('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="p', CAST(p_partkey AS STRING), '"><uses-permission android:name="android.permission.', CASE WHEN p_partkey % 2 = 0 THEN 'CAMERA' ELSE 'INTERNET' END, '"/><application><activity android:name=".A', CAST(p_size AS STRING), '" android:exported="', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END, '"/><receiver android:name=".R" android:exported="', CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE 'false' END, '"/></application></manifest>')"""


@query("""SELECT p_partkey AS file_id, 'MOBILE-ANDROID-003' AS rule_id, 'CAMERA' AS evidence, 'p' || p_partkey AS package FROM part WHERE p_partkey % 2 = 0 UNION ALL
SELECT p_partkey, 'MOBILE-ANDROID-001', '.A' || p_size, 'p' || p_partkey FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'MOBILE-ANDROID-002', '.R', 'p' || p_partkey FROM part WHERE p_partkey % 5 = 0""")
def android_manifests(spark, d):
    return android_files(spark, d).drop("place")


def android_files(spark, d):
    return manifest.findings(table(spark, d, "part").selectExpr("p_partkey AS file_id", f"{_XML} AS content"))


@query("""SELECT p_partkey AS file_id, 'p' || p_partkey AS package, 'activity' AS kind, '.A' || p_size AS name, p_partkey % 3 = 0 AS exported, CAST(NULL AS VARCHAR) AS permission, 0 AS intent_filters FROM part UNION ALL SELECT p_partkey, 'p' || p_partkey, 'receiver', '.R', p_partkey % 5 = 0, NULL, 0 FROM part""")
def manifest_components(spark, d):
    return manifest.manifests(table(spark, d, "part").selectExpr("p_partkey AS file_id", f"{_XML} AS content")).select("file_id", "package", F.explode("components").alias("c")).select("file_id", "package", "c.*")


_LOCK = """concat('{"packages": {"": {"version": "0"}, "node_modules/express": {"version": "4.', p_size, '"}, "node_modules/a/node_modules/', CASE WHEN p_partkey % 2 = 0 THEN 'lodash' ELSE 'b' END, '": {"version": "3"}}}')"""


@query(f"SELECT p_partkey AS file_id, CAST(1 AS BIGINT) AS line, 'express' AS package, '4.' || p_size AS version, 'direct' AS scope, 'ADV-JS-0001' AS advisory_id, 'high' AS severity FROM part UNION ALL SELECT p_partkey, 1, 'lodash', '3', 'transitive', 'ADV-JS-0002', 'medium' FROM part WHERE p_partkey % 2 = 0")
def sca_package_lock(spark, d):
    files = table(spark, d, "part").selectExpr("p_partkey AS file_id", f"{_LOCK} AS content")
    return dependencies.vulnerable(dependencies.package_lock(files)).select("file_id", "line", "package", "version", "scope", "advisory_id", "severity")


_CONFIG = """CASE p_partkey % 6 WHEN 0 THEN 'name = "Django"' WHEN 1 THEN 'flask = "1"' WHEN 2 THEN '' WHEN 3 THEN '<a android:name="x"/>' WHEN 4 THEN '<dict>NSAppTransportSecurity</dict>' ELSE '<a/>' END AS content, CASE WHEN p_partkey % 6 < 3 THEN 'toml' ELSE 'xml' END AS language, CASE p_partkey % 6 WHEN 2 THEN 'django/pyproject.toml' WHEN 5 THEN 'b/Info.plist' ELSE 'a/b' END AS path"""


@query("SELECT p_partkey AS file_id, ['django', 'flask', 'django', 'android', 'ios', 'ios'][p_partkey % 6 + 1] AS framework, ['medium', 'medium', 'low', 'high', 'high', 'high'][p_partkey % 6 + 1] AS confidence, ['toml:django', 'toml:flask', 'toml:path-django', 'xml:android', 'xml:ios', 'xml:ios'][p_partkey % 6 + 1] AS signal FROM part")
def classify_config(spark, d):
    files = spark.sql(f"SELECT p_partkey AS file_id, {_CONFIG} FROM {{rows}}", rows=table(spark, d, "part"))
    return files.select("file_id", frameworks.framework(F.col("language"), F.col("path"), F.col("content")).alias("k")).select("file_id", "k.*")


@query(f"WITH f AS ({_PATHS.replace('AS STRING', 'AS VARCHAR')}), c AS (SELECT path, {classify.language_sql('path')} AS language FROM f WHERE file_id % 3 <> 0) SELECT f.file_id, coalesce(c.language, 'unknown') AS language, CASE WHEN f.file_id % 4 = 3 THEN coalesce(c.language, 'unknown') <> 'json' ELSE true END AS syntax_valid FROM f LEFT JOIN c USING (path)")
def parse_files(spark, d):
    """Files with their classification, the last of a path and unknown without one; broken JSON is told."""
    files = spark.sql(_PATHS.replace("FROM part", "FROM {rows}"), rows=table(spark, d, "part")).withColumn("content", F.when(F.col("file_id") % 4 == 3, "{").otherwise("{}"))
    told = files.where("file_id % 3 <> 0").select("path", "file_id", classify.language(F.col("path")).alias("language"))
    return classify.parsed(files, told.withColumnRenamed("file_id", "seq")).select("file_id", "language", "syntax_valid")


# Reports and counts


@query(f"WITH {_F} SELECT seq, concat(upper(severity), ' ', title, ' (', rule_id, ') at ', path, ':', start_line) AS summary FROM i")
def report_text(spark, d):
    return found(spark, d).select("seq", reports.summary().alias("summary"))


@query(f"WITH {_F} SELECT seq, CAST(to_json({{'id': id, 'path': path, 'rule_id': rule_id, 'severity': severity, 'start_line': start_line, 'title': title}}) AS VARCHAR) AS json FROM i")
def report_json(spark, d):
    return reports.json_rows(found(spark, d))


_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"


@query(f"{_TRIAGE} SELECT rule_id, arg_min({_LEVEL}, place) AS level FROM (SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, {_REACH}, path, start_line, rule_id, seq) AS place FROM b) WHERE bucket = 'active' GROUP BY rule_id")
def sarif_rules(spark, d):
    return reports.sarif_rules(findings.in_order(triage(spark, d)).where("bucket = 'active'"))


@query(f"{_TRIAGE} SELECT seq, rule_id, {_LEVEL} AS level, path AS uri, start_line FROM b WHERE bucket = 'active'")
def sarif_results(spark, d):
    return reports.sarif_results(triage(spark, d).where("bucket = 'active'"))


@query(f"{_TRIAGE} SELECT decision, count(*) AS n FROM b WHERE override_seq IS NOT NULL GROUP BY decision".replace("decision, count", "CASE WHEN bucket = 'suppressed' THEN 'suppressed' ELSE 'active' END AS decision, count").replace("GROUP BY decision", "GROUP BY 1"))
def override_counts(spark, d):
    return triage(spark, d).where("override_seq IS NOT NULL").groupBy(F.when(F.col("bucket") == "suppressed", "suppressed").otherwise("active").alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS n_valid, concat(count(*) FILTER (json_valid(props)), '/', count(*)) AS ratio FROM events GROUP BY event_type")
def json_validity(spark, d):
    n, valid = F.count("*"), F.count_if(F.try_parse_json("props").isNotNull())
    return table(spark, d, "events").groupBy("event_type").agg(n.alias("n"), valid.alias("n_valid"), F.concat_ws("/", valid.cast("string"), n.cast("string")).alias("ratio"))


_NESTED = """concat('{"a": {"b": [', event_id, ', {"c": "x', event_id % 7, '"}, [', event_id % 3, ']], "e": [], "f": {}}, "p": ', props, ', "t": true}')"""


@query(f"SELECT event_id, substr(t.fullkey, 3) AS path, json_extract_string(x, t.fullkey) AS value FROM (SELECT event_id, CAST({_NESTED} AS JSON) AS x FROM events), json_tree(x) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')")
def json_leaf_paths(spark, d):
    return leaves.leaves(table(spark, d, "events").selectExpr("event_id", f"{_NESTED} AS x"), "event_id", "x").select("event_id", "path", "value")


@query("SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_leaves(spark, d):
    leaves = F.explode(F.from_json("props", "map<string,string>")).alias("k", "value")
    return table(spark, d, "events").select("event_id", leaves).select("event_id", F.concat(F.lit("$."), F.col("k")).alias("path"), "value")


@query(f"WITH {_F} SELECT severity, count(*) AS n_total, count(*) FILTER (contains(lower(path), 'app1')) AS n_visible FROM i GROUP BY severity")
def filter_summary(spark, d):
    return found(spark, d).groupBy("severity").agg(F.count("*").alias("n_total"), F.count_if(F.contains(F.lower("path"), F.lit("app1"))).alias("n_visible"))


#: What the reports below say of their scan.
_SCAN_TOLD = {"root": "documents", "tool_version": "1", "policy_branch": "release", "policy_threshold": "critical", "policy_effective_threshold": "medium"}


def event_report(spark, d):
    """A report of the events' findings, after triage, and of the documents' files."""
    files = materialised(document_files(spark, d).drop("text"), "files")
    ordered = findings.in_order(triage(spark, d))
    return reports.report(ordered.withColumn("json", reports.finding_json(ordered.columns)), findings.audit(ordered), tree.notes(files), _SCAN_TOLD | tree.counters(files).first().asDict())


def parts_written(spark, report, name, compression="none"):
    """A report's three forms, each in a folder of its own, and the folder that holds them."""
    at = shared_folder(spark, name)
    reports.write_parts(spark, reports.json_pieces(report), f"{at}/json", compression=compression)
    reports.write_parts(spark, reports.sarif_pieces(report, "wardenry", "1"), f"{at}/sarif", compression=compression)
    reports.write_parts(spark, reports.text_pieces(report), f"{at}/text", "", compression)
    return at


_IN_JSON = """to_json({'id': id, 'rule_id': rule_id, 'title': title, 'message': NULL, 'severity': severity, 'confidence': NULL, 'location': {'path': path, 'start_line': start_line, 'start_column': 1, 'end_line': NULL, 'end_column': NULL}, 'category': NULL, 'language': NULL, 'framework': NULL, 'owasp': NULL, 'cwe': NULL,
'evidence': {'snippet': NULL, 'start_line': start_line, 'end_line': start_line}, 'remediation': NULL, 'status': NULL, 'triage_status': NULL, 'triage_reason': NULL, 'triage_note': NULL, 'tags': NULL, 'symbols': [], 'metadata': NULL})"""
_IN_SARIF = f"""to_json({{'ruleId': rule_id, 'level': {_LEVEL}, 'message': {{'text': NULL}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}}, 'region': {{'startLine': start_line, 'startColumn': 1}}}}}}],
'properties': {{'id': id, 'confidence': NULL, 'status': NULL, 'triage_status': NULL, 'triage_reason': NULL, 'triage_note': NULL, 'category': NULL}}}})"""
_COMMA = "CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY place) = 1 THEN '' ELSE ',' END"


@query(f"""{_TRIAGE}, p AS (SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, {_REACH}, path, start_line, rule_id, seq) AS place FROM b)
SELECT 'json' AS form, concat({_COMMA}, {_IN_JSON}) AS line FROM p UNION ALL SELECT 'sarif', concat({_COMMA}, {_IN_SARIF}) FROM p WHERE bucket = 'active' UNION ALL SELECT 'text', concat('- ', upper(severity), ' ', title, ' (', rule_id, ') at ', path, ':', start_line) FROM p WHERE bucket = 'active'""")
def report_files(spark, d):
    """The lines of findings in the three forms of a report, read back from the parts, which are gzip: as plain text they are many times the size of the events."""
    at = parts_written(spark, event_report(spark, d), "reports", "gzip")
    tells = {"json": "^,?\\{\"id\":", "sarif": "^,?\\{\"ruleId\":", "text": "^- (?:INFO|LOW|MEDIUM|HIGH|CRITICAL) "}
    out = None
    for form, pattern in tells.items():
        one = spark.read.text(f"{at}/{form}").where(F.col("value").rlike(pattern)).select(F.lit(form).alias("form"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out
