"""The scan as a whole: report order, triage and SARIF against plain loops over its rows; marker bits against the families themselves."""

import json

import pytest
from pyspark.sql import functions as F

from wardenry.functions import markers
from wardenry.operators import findings, reports
from wardenry.plans import registry
from wardenry.sources.corpus import TEMPLATES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scan(spark):
    return registry.materialised(registry.scan(spark, SF), "scan-test")


def test_order_and_buckets(spark, scan):
    rows = sorted(scan.collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and len({r.id for r in rows}) == len(rows)
    reach = {None: 0, "reachable": 0, "unreachable": 2}
    key = lambda r: (-findings.SEVERITIES.index(r.severity), reach.get(r.reachability, 1), r.path, r.start_line, r.rule_id)
    assert [key(r) for r in rows] == sorted(map(key, rows))
    entries = {k: spark.sql(q, **{x: spark.read.parquet(f"{SF}/{x}.parquet") for x in ("supplier", "customer", "nation") if f"{{{x}}}" in q}).collect() for k, q in registry._SCAN_ENTRIES.items()}

    def first(kind, r):
        return next((e for e in sorted(entries[kind], key=lambda e: e.seq) if e.rule_id == r.rule_id and e.start_line == r.start_line and r.path.endswith(e.path)), None)

    for r in rows:
        over, base, quiet = (first(k, r) for k in ("overrides", "baseline", "suppressions"))
        assert r.bucket == ({"suppressed": "suppressed"}.get(over.decision, "active") if over else "baselined" if base else "suppressed" if quiet else "active")
    assert {r.bucket for r in rows} == {"active", "baselined", "suppressed"}
    assert {json.loads(json.dumps(r.metadata))["ecosystem"] for r in rows if r.rule_id == "SCA-PACKAGE-001"} == {"pypi", "javascript"}


def test_sarif_says_what_the_first_active_finding_says(scan):
    active = scan.where("bucket = 'active'")
    rows = sorted(active.collect(), key=lambda r: r.place)
    first = {}
    for r in rows:
        first.setdefault(r.rule_id, r)
    got = {r.rule_id: json.loads(r.json) for r in reports.sarif_rule_objects(active).collect()}
    assert {k: (x["properties"]["severity"], x["properties"]["confidence"], x["name"]) for k, x in got.items()} == {k: (r.severity, r.confidence, r.title) for k, r in first.items()}
    # A route without authentication is medium, a guard is info: the former stands first.
    assert "WEB-AUTH-001" not in first or got["WEB-AUTH-001"]["properties"]["severity"] == first["WEB-AUTH-001"].severity
    results = [json.loads(r.json) for r in reports.sarif_result_objects(active).collect()]
    assert sorted(x["properties"]["id"] for x in results) == sorted(r.id for r in rows)
    assert all({"triage_reason", "triage_note"} <= set(x["properties"]) for x in results)


def test_bits_are_what_the_families_say(spark):
    lines = [x for own in TEMPLATES.values() for x in own] + [m for own in markers.FAMILIES.values() for m in own] + ["", None, "x" + "open(" * 3, "Jdbctemplate.Query("]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").withColumn("bits", markers.marker_bits(F.col("line")))
    marked = markers.Marked(F.col("line"), F.col("bits"))
    for r in df.select("line", *(markers.has_any(marked, f).alias(f) for f in markers.FAMILIES)).collect():
        assert {f: bool(r[f]) for f in markers.FAMILIES} == {f: any(m in (r.line or "").lower() for m in own) for f, own in markers.FAMILIES.items()}
