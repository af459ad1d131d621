"""Findings: identity, duplicates, order, policy, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import materialised
from .scans import shuffled

# Fixed values.
SEVERITIES = ("info", "low", "medium", "high", "critical")
ADVISORIES = (("flask", "ADV-PY-0001", "high"), ("requests", "ADV-PY-0002", "medium"), ("express", "ADV-JS-0001", "high"), ("lodash", "ADV-JS-0002", "medium"), ("react", "ADV-JS-0003", "medium"), ("next", "ADV-JS-0004", "high"))


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def finding_id(rule: Column, *parts: Column) -> Column:
    """The rule and its parts, empty ones left out, colons within them as underscores."""
    return F.concat_ws(":", rule, *(F.nullif(F.regexp_replace(p.cast("string"), ":", "_"), F.lit("")) for p in parts))


def fingerprint(rule: Column, path: Column, line: Column, snippet: Column) -> Column:
    return F.sha2(F.concat_ws("::", *(F.coalesce(c.cast("string"), F.lit("")) for c in (rule, path, line, snippet))), 256)


def last_wins(findings: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row a key: the values of the last, at the place of the first."""
    rest = [c for c in findings.columns if c not in (key, order)]
    return findings.groupBy(key).agg(F.min(order).alias(order), *(F.max_by(c, order).alias(c) for c in rest)).select(*findings.columns)


def sort_key() -> list[Column]:
    reach = F.when(F.col("reachability").isNull() | (F.col("reachability") == "reachable"), 0).when(F.col("reachability") == "unreachable", 2).otherwise(1)
    return [-rank(F.col("severity")), reach, F.col("path"), F.col("start_line"), F.col("rule_id"), F.col("seq")]


def top_per_severity(findings: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("severity").orderBy("path", "start_line", "rule_id", "seq")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def top_with_rest(findings: DataFrame, n: int = 5) -> DataFrame:
    """severity, total, shown (the first n: seq, in order), more: every severity, the critical first, whether or not it has findings."""
    order = findings.sparkSession.createDataFrame([(x, i) for i, x in enumerate(reversed(SEVERITIES))], "severity string, place int")
    counts = findings.groupBy("severity").agg(F.count("*").alias("total"))
    shown = top_per_severity(findings, n).groupBy("severity").agg(F.array_sort(F.collect_list(F.struct("place", "seq"))).alias("own")).select("severity", F.transform("own", lambda x: x["seq"]).alias("shown"))
    out = F.broadcast(order).join(counts, "severity", "left").join(shown, "severity", "left")
    total = F.coalesce("total", F.lit(0).cast("long"))
    return out.select("place", "severity", total.alias("total"), F.coalesce("shown", F.array().cast("array<long>")).alias("shown"), F.greatest(total - n, F.lit(0).cast("long")).alias("more"))


def in_order(findings: DataFrame) -> DataFrame:
    """findings with place, from 1, in the order of reports. The sort is over ranges; what lies before a range is one number each."""
    n = max(1, int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = findings.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(sort_key())))
    keys = [f"_k{i}" for i in range(len(sort_key()))]
    run = materialised(keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_id", F.monotonically_increasing_id()), "finding-order")
    part = F.shiftright("_id", 33)
    parts = run.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = parts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return run.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_before")


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def normalised_path(path: Column) -> Column:
    """Leading dots and slashes go, whatever their order."""
    return F.ltrim(path, F.lit("./"))


#: Fields that triage takes from the entry that it finds.
TAKEN = ("decision", "reason", "scope", "author", "expires_at", "review_status", "reviewed_by", "reviewed_at")


def first_matches(findings: DataFrame, **kinds: DataFrame) -> DataFrame:
    """findings with a column for each kind: a struct of entry_seq and TAKEN of the first entry (by seq) that names the finding's rule and line, whose path the finding's ends with, and
    whose fingerprint, if it has 64 hex digits, is the finding's. Null without one.

    Paths meet by equality: of each distinct rule, line and path the suffixes are taken that have the length of some entry's path. All kinds share one join and one aggregate.
    """
    columns = lambda e: {c: F.col(c).cast("string") if c in e.columns else F.lit(None).cast("string") for c in (*TAKEN, "fingerprint")}
    some = None
    for kind, entries in kinds.items():
        own = columns(entries)
        mark = F.when(own["fingerprint"].rlike("^[0-9a-fA-F]{64}$"), F.lower(own["fingerprint"]))
        one = entries.select(F.lit(kind).alias("kind"), "rule_id", "start_line", normalised_path(F.col("path")).alias("suffix"), mark.alias("mark"), F.struct(F.col("seq").cast("long").alias("entry_seq"), *(own[c].alias(c) for c in TAKEN)).alias("entry"))
        some = one if some is None else some.unionByName(one)
    least = some.groupBy("kind", "rule_id", "start_line", "suffix", "mark").agg(F.min_by("entry", "entry.entry_seq").alias("entry"))
    least = materialised(least, "triage-entries")
    lengths = [r[0] for r in least.select(F.length("suffix")).distinct().collect() if r[0] is not None]  # no more than the longest path has characters
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("entry")), F.when(F.col("kind") == kind, F.col("entry.entry_seq"))).alias(kind)
    # Entries without a mark, for each distinct place.
    places = findings.select("rule_id", "start_line", "path").distinct().withColumn("_own", normalised_path(F.col("path")))
    cut = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_own")), lambda n: F.when(n > 0, F.right("_own", n)).otherwise(""))
    met = places.select("rule_id", "start_line", "path", F.explode(F.array_distinct(cut)).alias("suffix")).join(shuffled(least.where("mark IS NULL")), ["rule_id", "start_line", "suffix"])
    plain = met.groupBy("rule_id", "start_line", "path").agg(*(first(k) for k in kinds))
    out = findings.join(plain, ["rule_id", "start_line", "path"], "left")
    marked = least.where("mark IS NOT NULL")
    if "fingerprint" not in findings.columns or not marked.first():
        return out
    told = findings.select("seq", "rule_id", "start_line", F.lower("fingerprint").alias("mark"), normalised_path(F.col("path")).alias("_own")).join(shuffled(marked), ["rule_id", "start_line", "mark"]).where(F.endswith("_own", F.col("suffix")))
    of_mark = told.groupBy("seq").agg(*(first(k) for k in kinds)).withColumnsRenamed({k: f"_{k}" for k in kinds})
    both = out.join(of_mark, "seq", "left")
    sooner = lambda k: F.when(F.coalesce(F.col(f"_{k}.entry_seq") < F.col(f"{k}.entry_seq"), F.col(k).isNull()), F.col(f"_{k}")).otherwise(F.col(k))
    return both.withColumns({k: sooner(k) for k in kinds}).drop(*(f"_{k}" for k in kinds))


def triaged(findings: DataFrame, baseline: DataFrame, suppressions: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """findings with bucket, and baseline_seq, suppression_seq and override_seq of the entries that match. An override decides before the baseline, that before a suppression; the expired and the not approved don't count."""
    valid = lambda df: df.where(F.col("expires_at").isNull() | (F.to_timestamp("expires_at") > now))
    out = first_matches(findings, override=valid(overrides), baseline=baseline, suppression=valid(suppressions).where("review_status = 'approved'"))
    decided = F.when(F.col("override.decision") == "suppressed", "suppressed").otherwise("active")
    bucket = F.when(F.col("override").isNotNull(), decided).when(F.col("baseline").isNotNull(), "baselined").when(F.col("suppression").isNotNull(), "suppressed").otherwise("active")
    return out.withColumn("bucket", bucket).withColumns({f"{k}_seq": F.col(f"{k}.entry_seq") for k in ("baseline", "suppression", "override")}).withColumn("decision", F.col("override.decision"))


def audit(found: DataFrame) -> DataFrame:
    """seq (of the finding, in whose order an audit is read), action, subject_type, subject_id, decision, reason, metadata, from triaged(): a row for each finding that an entry decided."""
    action = F.when(F.col("override").isNotNull(), "manual_override").when(F.col("baseline").isNotNull(), "baseline").when(F.col("suppression").isNotNull(), "suppression")
    by = F.when(action == "manual_override", F.col("override")).when(action == "baseline", F.col("baseline")).otherwise(F.col("suppression"))
    told = {"rule_id": F.col("rule_id"), "path": F.col("path"), "start_line": F.col("start_line").cast("string")}
    more = {"manual_override": ("scope", "author", "expires_at"), "suppression": ("review_status", "reviewed_by", "reviewed_at")}
    told |= {c: F.when(F.col("action") == a, F.col(f"by.{c}")) for a, own in more.items() for c in own}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in told.items()))
    decision = F.when(F.col("action") == "manual_override", F.col("by.decision")).when(F.col("action") == "baseline", "baselined").otherwise("suppressed")
    return found.withColumns({"action": action, "by": by}).where("action IS NOT NULL").select(
        "seq", "action", F.lit("finding").alias("subject_type"), F.col("id").alias("subject_id"), decision.alias("decision"), F.col("by.reason").alias("reason"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metadata")
    )


def triage_updated(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """findings with triage_status, triage_reason and triage_note of the updates (id, triage_status, triage_reason, triage_note; the last by seq counts). Blank reasons and notes are null; other findings keep theirs."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    last = updates.groupBy("id").agg(F.max_by(F.struct("triage_status", clean("triage_reason").alias("triage_reason"), clean("triage_note").alias("triage_note")), "seq").alias("_new"))
    new = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
    return findings.join(last, "id", "left").withColumns({c: new(c) for c in ("triage_status", "triage_reason", "triage_note")}).drop("_new")


def overridden(found: DataFrame) -> DataFrame:
    """Of triaged(), the findings that an override decided, in whichever bucket."""
    return found.where("override IS NOT NULL")


def threshold(default: str | None, branch: str | None, by_branch: dict[str, str], explicit: bool = False) -> str | None:
    """The severity that fails a scan: the branch's own, unless the default was asked for. An unknown severity is an error."""
    out = by_branch[branch] if not explicit and branch in by_branch else default
    if out is not None and out not in SEVERITIES:
        raise ValueError(f"no severity: {out}")
    return out


def decision_over(findings: DataFrame, limit: str | None, *by: str) -> DataFrame:
    """The groups' n and decision: blocked where a finding is as severe as the limit or more; without a limit all are allowed."""
    over = F.bool_or(rank(F.col("severity")) >= SEVERITIES.index(limit) + 1) if limit else F.lit(False)
    return findings.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.coalesce(over, F.lit(False)), "blocked").otherwise("allowed").alias("decision"))
