"""Findings as rows for reports: one line of text, JSON, and SARIF rules and results; and whole reports, written as text parts that joined in order of their names are one file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .findings import decision_over, sarif_level


def summary() -> Column:
    return F.concat(F.upper("severity"), F.lit(" "), F.col("title"), F.lit(" ("), F.col("rule_id"), F.lit(") at "), F.col("path"), F.lit(":"), F.col("start_line").cast("string"))


def audit_summary() -> Column:
    """action subject_type:subject_id decision=... reason=...; what is null is left out."""
    told = lambda c: F.concat(F.lit(f"{c}="), F.col(c))
    return F.concat_ws(" ", "action", F.concat_ws(":", "subject_type", F.nullif("subject_id", F.lit(""))), told("decision"), told("reason"))


#: A finding's fields beside its place and evidence, in order; what a finding has no column for is null.
FIELDS = {
    "id": "string", "rule_id": "string", "title": "string", "message": "string", "severity": "string", "confidence": "string", "location": None, "category": "string", "language": "string", "framework": "string", "owasp": "array<string>", "cwe": "array<string>",
    "evidence": None, "remediation": "string", "status": "string", "triage_status": "string", "triage_reason": "string", "triage_note": "string", "tags": "array<string>", "symbols": "array<string>", "metadata": "map<string,string>",
}


def finding_json(columns: list[str] | None = None) -> Column:
    """A finding with all its fields, nulls included, from those that the columns have (by default: as rules.emitted() gives it)."""
    columns = [c for c in (*FIELDS, "snippet") if c not in ("triage_reason", "triage_note")] if columns is None else columns
    line = F.col("start_line").cast("long")
    place = F.struct("path", line.alias("start_line"), F.lit(1).alias("start_column"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("int").alias("end_column"))
    seen = F.struct((F.col("snippet") if "snippet" in columns else F.lit(None)).cast("string").alias("snippet"), line.alias("start_line"), line.alias("end_line"))
    made = {"location": place, "evidence": seen, "symbols": F.array().cast("array<string>")}
    own = F.struct(*((made[c] if c in made else (F.col(c) if c in columns else F.lit(None)).cast(t)).alias(c) for c, t in FIELDS.items()))
    return F.to_json(own, {"ignoreNullFields": "false"})


def json_rows(findings: DataFrame) -> DataFrame:
    """seq, json: keys in order."""
    return findings.select("seq", F.to_json(F.struct("id", "path", "rule_id", "severity", "start_line", "title")).alias("json"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id, level: each rule once, as its first finding in report order (place) has it."""
    return findings.groupBy("rule_id").agg(F.min_by(sarif_level(F.col("severity")), "place").alias("level"))


def sarif_rule_objects(findings: DataFrame) -> DataFrame:
    """rule_id, json: each rule once, with what its first finding in report order (place) says."""
    text = lambda c: F.struct(c.alias("text"))
    of = lambda c: (F.col(c) if c in findings.columns else F.lit(None)).cast(FIELDS[c]).alias(c)
    properties = F.struct("severity", *map(of, ("confidence", "category", "owasp", "cwe")))
    own = F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name"), text(of("message")).alias("shortDescription"), text(of("message")).alias("fullDescription"), text(F.coalesce(of("remediation"), of("message"))).alias("help"), properties.alias("properties"))
    return findings.groupBy("rule_id").agg(F.to_json(F.min_by(own, "place")).alias("json"))


def sarif_result_objects(findings: DataFrame, *more: str) -> DataFrame:
    """place, json: with all keys, nulls included; and more of the findings' columns."""
    region = F.struct(F.col("start_line").alias("startLine"), F.lit(1).alias("startColumn"))
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    text = lambda c: (F.col(c) if c in findings.columns else F.lit(None)).cast("string").alias(c)
    properties = F.struct("id", *map(text, ("confidence", "status", "triage_status", "triage_reason", "triage_note", "category")))
    own = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(text("message").alias("text")).alias("message"), where.alias("locations"), properties.alias("properties"))
    return findings.select("place", *more, F.to_json(own, {"ignoreNullFields": "false"}).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """seq, rule_id, level, uri, start_line."""
    return findings.select("seq", "rule_id", sarif_level(F.col("severity")).alias("level"), F.col("path").alias("uri"), "start_line")


#: What a report says of a scan besides its rows; absent: null.
TOLD = ("root", "started_at", "finished_at", "tool_version", "policy_branch", "policy_threshold", "policy_effective_threshold")
STATS = ("files_seen", "files_selected", "findings", "baselined_findings", "suppressed_findings")


@dataclass
class Report:
    """A scan's results. findings: triaged, with place (unique, in report order), bucket and json; audit: place, json, line; notes: place, by (a path's parts), note; files, documents: place, json; packs: rule packs, few enough for one line; told: TOLD and what counters() tells of the files."""

    findings: DataFrame
    audit: DataFrame
    notes: DataFrame
    told: dict
    files: DataFrame | None = None
    documents: DataFrame | None = None
    packs: list[dict] = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    decision: str | None = None


def report(findings: DataFrame, audit: DataFrame, notes: DataFrame, told: dict, files: DataFrame | None = None, documents: DataFrame | None = None, packs: list[dict] | None = None) -> Report:
    """A Report of findings.in_order(triaged()), findings.audit(), notes (relative_path, note), and the rest as Report has it. in_order() has written the findings, so they are not written again with their json, which is made when a form asks for it; of them the driver sees counts alone.

    The audit's last row says what the policy decides, the last notes what was found.
    """
    of = lambda bucket: F.count_if(F.col("bucket") == bucket)
    counts = findings.agg(of("active").alias("findings"), of("baselined").alias("baselined_findings"), of("suppressed").alias("suppressed_findings")).first().asDict()
    limit = told.get("policy_effective_threshold")
    decision = decision_over(findings.where("bucket = 'active'"), limit).first()["decision"]
    last = {"policy_threshold": told.get("policy_threshold"), "policy_effective_threshold": limit, "branch": told.get("policy_branch")}
    entry = {"action": "policy", "subject_type": "scan", "subject_id": told.get("root"), "decision": decision, "reason": f"threshold={limit or 'none'}", "actor": "scanner", "created_at": told.get("finished_at"), "metadata": last}
    spark = findings.sparkSession
    fields = F.struct("action", "subject_type", "subject_id", "decision", "reason", F.lit(None).cast("string").alias("actor"), F.lit(None).cast("string").alias("created_at"), "metadata")
    rows = audit.select(F.col("seq").cast("long").alias("place"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"), audit_summary().alias("line"))
    line = " ".join(x for x in ("policy", f"scan:{told['root']}" if told.get("root") else "scan", f"decision={decision}", f"reason={entry['reason']}"))
    rows = rows.unionByName(spark.range(0, 1, 1, 1).select(F.lit((1 << 63) - 1).alias("place"), F.lit(json.dumps(entry, ensure_ascii=False)).alias("json"), F.lit(line).alias("line")))
    stats = {c: told.get(c, 0) if c.startswith("files") else counts[c] for c in STATS}
    after = [] if stats["files_selected"] else ["no files selected for analysis"]
    if stats["files_selected"]:
        after += [f"{kind} findings: {stats[f'{kind}_findings']}" for kind in ("baselined", "suppressed") if stats[f"{kind}_findings"]]
        after += [f"findings produced: {stats['findings']}", f"{stats['files_selected']} file(s) selected for future analysis"]
    own = notes.select(F.lit(0).cast("long").alias("place"), F.split("relative_path", "/").alias("by"), "note")
    for k, note in enumerate(after, 1):
        own = own.unionByName(spark.range(0, 1, 1, 1).select(F.lit(k).cast("long").alias("place"), F.array().cast("array<string>").alias("by"), F.lit(note).alias("note")))
    return Report(findings, rows, own, told, files, documents, packs or [], stats, decision)


def _items(df: DataFrame, line: Column | str) -> DataFrame:
    return df.select("place", *(["by"] if "by" in df.columns else []), (F.col(line) if isinstance(line, str) else line).alias("line"))


def json_pieces(r: Report) -> list:
    """The pieces of a report in JSON: text, and rows that stand between it."""
    of = lambda bucket: _items(r.findings.where(F.col("bucket") == bucket), "json")
    quoted = F.substring(F.to_json(F.struct(F.col("note").alias("n"))), 6, 1 << 30)
    lists = {
        "audit_log": _items(r.audit, "json"), "baselined_findings": of("baselined"), "files": r.files and _items(r.files, "json"), "findings": of("active"), "notes": _items(r.notes, F.left(quoted, F.length(quoted) - 1)),
        "parsed_documents": r.documents and _items(r.documents, "json"), "suppressed_findings": of("suppressed"),
    }
    out: list = []
    for k, (name, rows) in enumerate(lists.items()):
        out += [("],\n" if k else "{") + f'"{name}":[', *([rows] if rows is not None else [])]
    rest = {"policy_decision": r.decision, "rule_packs": r.packs, "stats": r.stats} | {c: r.told.get(c) for c in TOLD}
    return [*out, "],\n" + json.dumps(rest, ensure_ascii=False)[1:]]


def sarif_pieces(r: Report, tool: str, version: str) -> list:
    """The pieces of a SARIF file: active findings, each rule as its first finding has it."""
    active = r.findings.where("bucket = 'active'")
    firsts = active.groupBy("rule_id").agg(F.min("place").alias("place"))
    rules = sarif_rule_objects(active).join(firsts, "rule_id")
    properties = {c: r.told.get(c) for c in TOLD} | r.stats | {"policy_decision": r.decision, "rule_packs": r.packs}
    return [
        '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{' + f'"name":{json.dumps(tool)},"version":{json.dumps(version)},"rules":[', _items(rules, "json"),
        ']}},"results":[', _items(sarif_result_objects(active), "json"), '],"invocations":[{"executionSuccessful":true,"properties":' + json.dumps(properties, ensure_ascii=False)[:-1] + ',"audit_log":[', _items(r.audit, "json"), "]}}]}]}",
    ]


def text_pieces(r: Report) -> list:
    """The pieces of a report for readers, a line or more each."""
    dash = lambda df, c: _items(df, F.concat(F.lit("- "), c))
    named = (("scan root", "root"), ("started at", "started_at"), ("finished at", "finished_at"), ("tool version", "tool_version"), ("policy branch", "policy_branch"))
    out: list = [f"{name}: {r.told.get(c)}" for name, c in named if r.told.get(c) is not None or c == "root"]
    out += [f"{c.replace('_', ' ')}: {r.stats[c]}" for c in STATS[:3]]
    filtered = [f"- {kind}: {r.stats[f'{kind}_findings']}" for kind in ("baselined", "suppressed") if r.stats[f"{kind}_findings"]]
    packs = [f"- {p['name']}@{p['version']}" for p in r.packs]
    policy = [f"- {name}: {x}" for name, x in (("threshold", r.told.get("policy_threshold")), ("effective threshold", r.told.get("policy_effective_threshold")), ("decision", r.decision)) if x is not None]
    for title, lines in (("filtered", filtered), ("rule packs", packs), ("audit log", [dash(r.audit, "line")]), ("policy", policy), ("notes", [dash(r.notes, "note")])):
        out += [f"{title}:", *lines] if lines else []
    return [*out, dash(r.findings.where("bucket = 'active'").withColumn("summary", summary()), "summary") if r.stats["findings"] else "- no active findings"]


def laid_out(spark: SparkSession, pieces: list, separator: str) -> DataFrame:
    """section, place, by, line: the pieces in order; the separator stands before each row of a piece but its first."""
    out = None
    for k, piece in enumerate(pieces):
        none = F.array().cast("array<string>").alias("by")
        if isinstance(piece, str):
            one = spark.range(0, 1, 1, 1).select(F.lit(0).cast("long").alias("place"), none, F.lit(piece).alias("line"))
        else:
            one = piece.select(F.col("place").cast("long"), "by" if "by" in piece.columns else none, "line")
            if separator:
                first = one.agg(F.min(F.struct("place", "by")).alias("_first"))
                lead = F.when(F.col("_first").isNull(), separator).otherwise("")
                one = one.join(F.broadcast(first), F.struct("place", "by") == F.col("_first"), "left").select("place", "by", F.concat(lead, "line").alias("line"))
        one = one.select(F.lit(k).alias("section"), "place", "by", "line")
        out = one if out is None else out.unionByName(one)
    return out


def write_parts(spark: SparkSession, pieces: list, folder: str, separator: str = ",", compression: str = "none") -> None:
    """The pieces as text files part-00000..., joined in order of their names one file (with gzip too, whose files may be joined). Rows are sorted by ranges, so no task holds more than its share and the driver none.

    Sorting by ranges makes each of them twice, which takes less than a table of all of them beside the text.
    """
    laid_out(spark, pieces, separator).orderBy("section", "place", "by").select("line").write.text(folder, compression=compression)
