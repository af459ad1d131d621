"""What grows with the input stays out of the driver, and off the disk twice."""

import glob
import gzip
import json
import os
import time

import pytest

from wardenry.operators import reports, taint_flow
from wardenry.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["taint_uses", "taint_branches", "taint_functions"])
def test_scans_send_no_rows_through_the_driver(spark, name):
    """Written tables look small enough for a broadcast here, and do so at a hundred times the size too."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    assert "Broadcast" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_whose_data_a_variable_holds_without_the_rest(spark):
    lines = registry.materialised(registry.flow(spark, SF).select("file_id", "line_no", "line"), "lines")
    key = ("file_id", "seq", "scope", "variable")
    few = taint_flow.followed(lines, columns=key)
    assert set(few.columns) == set(key) and "placed" not in few._jdf.queryExecution().executedPlan().toString()
    whole = taint_flow.followed(lines).select(*key)
    assert sorted(map(tuple, few.select(*key).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str) and few.count() > 1000


def test_many_functions_in_a_file():
    """A line is looked at once, not once for each function."""
    n = 3000
    lines = {k: f"x{k} = f{k}(request.args.get('a'))" if k % 2 else f"y{k} = {k}" for k in range(1, n + 1)}
    began = time.time()
    rows = taint_flow.Flow(lines, {}, {f"f{k}": (["a"], k + 1, k + 1) for k in range(1, n, 2)}).rows(1)
    assert time.time() - began < 2 and sum(r[2] == "variable" for r in rows) == n // 2


def broadcasts(df):
    """The first table below each broadcast in the plan."""
    pieces = df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[1:]
    return [next(x for x in p.splitlines() if "Scan" in x or "ReusedExchange" in x) for p in pieces]


def test_web_findings_and_triage_send_no_rows_through_the_driver(spark):
    assert broadcasts(registry.web_findings(spark, SF)) == []
    assert broadcasts(registry.triage(spark, SF)) == []


def test_all_detectors_broadcast_the_rules_alone(spark):
    assert not [x for x in broadcasts(registry.run(spark, SF)) if "parquet" in x]


def test_sarif_results_keep_what_is_asked_of_them(spark):
    made = spark.createDataFrame([(1, "a", "R", "high", "p", 3)], "place long, id string, rule_id string, severity string, path string, start_line int")
    assert reports.sarif_result_objects(made, "id").columns == ["place", "id", "json"]


def test_reports_lie_on_disk_once_and_compressed(spark):
    folder = registry.shared_folder(spark, "x").removeprefix("file://").rsplit("/", 1)[0]
    known = {*os.listdir(folder)}
    n = registry.report_files(spark, SF).where("form = 'json'").count()
    new = {*os.listdir(folder)} - known
    assert not [x for x in new if x.startswith(("triaged-", "report-rows-", "report-findings-"))]
    (at,) = (x for x in new if x.startswith("reports-"))
    parts = sorted(glob.glob(f"{folder}/{at}/json/part-*"))
    whole = json.loads(gzip.decompress(b"".join(open(x, "rb").read() for x in parts)))
    assert sum(len(whole[x]) for x in ("findings", "baselined_findings", "suppressed_findings")) == n == spark.read.parquet(f"{SF}/events.parquet").count()
