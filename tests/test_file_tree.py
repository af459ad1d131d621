"""Folders of files, and reports as parts, against plain loops."""

import glob
import json
import os
from pathlib import Path

import pytest

from wardenry.operators import findings, reports
from wardenry.plans import registry
from wardenry.sources import tree

SF = "/root/testdata/sf0.001"


def joined(folder):
    return "".join(Path(p).read_text() for p in sorted(glob.glob(f"{folder.removeprefix('file://')}/part-*")))


def make(root, files):
    for path, data in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)


def test_tree(spark, tmp_path):
    cut = b"a" * (tree.HEAD - 1) + "é".encode()
    make(tmp_path, {"a.py": b"x\r\ny\rz", "p/node_modules/b.js": b"x", "node_modules/c.js": b"x", "d.PNG": b"x", "e.txt": b"", "f.txt": b"\0x", "g.txt": b"\xff", "h/i/j/k.txt": cut + b"\xffz\xef\xbf\xbd", "whole.txt": b"a" * tree.HEAD, "bad.txt": b"a" * (tree.HEAD - 1) + b"\xc3", "s p/%20.txt": b"1"})
    (tmp_path / "link.txt").symlink_to("a.py")
    (tmp_path / "gone.txt").symlink_to("nothing")
    (tmp_path / "up").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "empty").mkdir()
    files = tree.scanned(spark, str(tmp_path)).cache()
    rows = {r.relative_path: r for r in files.collect()}
    reasons = {"a.py": None, "p/node_modules/b.js": "excluded", "node_modules/c.js": None, "d.PNG": "binary", "e.txt": "empty", "f.txt": "binary", "g.txt": "binary", "h/i/j/k.txt": None, "whole.txt": None, "bad.txt": "binary", "s p/%20.txt": None, "link.txt": "symlink"}
    assert {p: r.skip_reason for p, r in rows.items()} == reasons and all(r.error is None for r in rows.values())
    # U+FFFD of the text's own stays, what is no UTF-8 goes.
    assert rows["a.py"].text == "x\ny\nz" and rows["h/i/j/k.txt"].text == cut.decode() + "z�" and rows["whole.txt"].text == "a" * tree.HEAD
    assert rows["a.py"].size == 6 and rows["link.txt"].size is None
    assert tree.counters(files).first().asDict() == {"files_seen": 12, "files_selected": 5}
    assert {r.note for r in tree.notes(files).collect()} == {"skipped symlink: link.txt"}
    assert {"skipped empty file: e.txt", "skipped binary file: d.PNG", "excluded by exclude filter: p/node_modules/b.js"} <= {r.note for r in tree.notes(files, True).collect()}
    some = tree.scanned(spark, "file://" + str(tmp_path), include=("*.txt", " "), exclude=("h/*",))
    assert {r.relative_path for r in tree.selected(some).collect()} == {"whole.txt", "s p/%20.txt"}
    assert [(r.relative_path, r.text) for r in tree.scanned(spark, str(tmp_path / "a.py")).collect()] == [("a.py", "x\ny\nz")]
    assert tree.scanned(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="no such file"):
        tree.scanned(spark, str(tmp_path / "absent"))


def test_folders_are_dealt_out_once(tmp_path):
    make(tmp_path, {f"{a}/{b}/{c}.txt": b"x" for a in range(5) for b in range(4) for c in range(3)} | {f"{a}.txt": b"x" for a in range(7)})
    for folders in (1, 2, 6, 1000):
        reader = tree.FileTreeReader(os.fsencode(str(tmp_path)), folders)
        parts = reader.partitions()
        seen = [r[0] for p in parts for r in reader.entries(p)]
        assert len(seen) == len(set(seen)) == 67 and len(parts) >= min(folders, 26)


def test_what_goes_wrong_is_told(spark, tmp_path, monkeypatch):
    listing = tree.FileTreeReader(os.fsencode(str(tmp_path)), 4)
    assert [r[4] for r in listing.entries(tree.Folder(os.fsencode(str(tmp_path / "gone")), True))] == ["can't be listed: No such file or directory"]
    assert tree.read_file(os.fsencode(str(tmp_path / "gone.txt"))) == (None, None, "can't be read: No such file or directory")
    (tmp_path / "long.txt").write_bytes(b"x" * 10)
    monkeypatch.setattr(tree, "MOST_BYTES", 10)
    assert tree.read_file(os.fsencode(str(tmp_path / "long.txt")))[2] == "can't be read: too long for a column"
    files = spark.createDataFrame([("a", 1, None, None, "can't be read: no"), ("b", None, None, None, "can't be listed: no"), ("c", 1, "x", None, None)], tree.FILES)
    assert tree.counters(files).first().asDict() == {"files_seen": 2, "files_selected": 1}
    assert {r.note for r in tree.notes(files).collect()} == {"a can't be read: no", "b can't be listed: no"}


def report_rows(spark):
    rows = [(i, f"R-{i % 3}", f"p{i % 4}.py", i % 5 + 1, ("info", "low", "medium", "high", "critical")[i % 5], None, 'a "quoted"\ntitle, é' if i % 7 == 0 else "t") for i in range(500)]
    return spark.createDataFrame(rows, "seq long, rule_id string, path string, start_line int, severity string, reachability string, title string").withColumn("id", findings.finding_id(*(findings.F.col(c) for c in ("rule_id", "path", "start_line"))))


def test_parts_join_to_the_report(spark, tmp_path):
    entry = "seq long, rule_id string, path string, start_line int, fingerprint string, reason string, expires_at string, review_status string, decision string"
    own = lambda *rows: spark.createDataFrame(rows, entry)
    base, quiet, over = own((1, "R-1", "p1.py", 2, None, "known", None, None, None)), own((1, "R-2", "p2.py", 3, None, "fine", None, "approved", None)), own((1, "R-0", "p0.py", 1, None, "no", None, None, "suppressed"))
    triaged = findings.triaged(report_rows(spark), base, quiet, over, findings.F.lit("2025-01-01").cast("timestamp"))
    ordered = findings.in_order(triaged).cache()
    notes = spark.createDataFrame([("b-c/x", "second"), ("b/y", "first"), ("z", "third")], "relative_path string, note string")
    told = {"root": "r", "files_seen": 9, "files_selected": 3, "policy_threshold": "high", "policy_effective_threshold": "high", "tool_version": "1"}
    made = reports.report(ordered.withColumn("json", reports.finding_json(ordered.columns)), findings.audit(triaged), notes, told, packs=[{"name": "own", "version": "1", "rules": [], "metadata": {}}])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that few rows too make many parts
    for form, pieces in (("json", reports.json_pieces(made)), ("sarif", reports.sarif_pieces(made, "tool", "1")), ("text", reports.text_pieces(made))):
        reports.write_parts(spark, pieces, str(tmp_path / form), "" if form == "text" else ",")
        assert len(glob.glob(str(tmp_path / form / "part-*"))) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(ordered.collect(), key=lambda r: r.place)
    of = {b: [r.id for r in rows if r.bucket == b] for b in ("active", "baselined", "suppressed")}
    assert all(of.values())
    whole = json.loads(joined(str(tmp_path / "json")))
    assert [f["id"] for f in whole["findings"]] == of["active"] and [f["id"] for f in whole["baselined_findings"]] == of["baselined"] and [f["id"] for f in whole["suppressed_findings"]] == of["suppressed"]
    assert [f["title"] for f in whole["findings"]] == [r.title for r in rows if r.bucket == "active"]
    assert whole["stats"] == {"files_seen": 9, "files_selected": 3, "findings": len(of["active"]), "baselined_findings": len(of["baselined"]), "suppressed_findings": len(of["suppressed"])}
    assert whole["notes"] == ["first", "second", "third", f"baselined findings: {len(of['baselined'])}", f"suppressed findings: {len(of['suppressed'])}", f"findings produced: {len(of['active'])}", "3 file(s) selected for future analysis"]
    decided = [r.seq for r in sorted(rows, key=lambda r: r.seq) if r.bucket != "active"]
    assert len(whole["audit_log"]) == len(decided) + 1 and whole["audit_log"][-1]["decision"] == "blocked" == whole["policy_decision"] and whole["audit_log"][-1]["reason"] == "threshold=high"
    assert whole["files"] == whole["parsed_documents"] == [] and whole["root"] == "r" and whole["started_at"] is None
    run = json.loads(joined(str(tmp_path / "sarif")))["runs"][0]
    assert [r["properties"]["id"] for r in run["results"]] == of["active"]
    order = list(dict.fromkeys(r.rule_id for r in rows if r.bucket == "active"))
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == order and run["invocations"][0]["properties"]["audit_log"] == whole["audit_log"]
    text = joined(str(tmp_path / "text"))
    assert text.startswith(f"scan root: r\ntool version: 1\nfiles seen: 9\nfiles selected: 3\nfindings: {len(of['active'])}\nfiltered:\n- baselined: {len(of['baselined'])}\n- suppressed: {len(of['suppressed'])}\nrule packs:\n- own@1\naudit log:\n- ")
    assert "\n- policy scan:r decision=blocked reason=threshold=high\npolicy:\n- threshold: high\n- effective threshold: high\n- decision: blocked\nnotes:\n- first\n- second\n" in text
    assert text.endswith("\n".join(f"- {r.severity.upper()} {r.title} ({r.rule_id}) at {r.path}:{r.start_line}" for r in rows if r.bucket == "active") + "\n")


def test_report_of_nothing(spark, tmp_path):
    none = report_rows(spark).limit(0)
    empty = spark.createDataFrame([], "seq long, rule_id string, path string, start_line int, fingerprint string, reason string, expires_at string, review_status string, decision string")
    triaged = findings.triaged(none, empty, empty, empty, findings.F.lit("2025-01-01").cast("timestamp"))
    ordered = findings.in_order(triaged)
    made = reports.report(ordered.withColumn("json", reports.finding_json(ordered.columns)), findings.audit(triaged), spark.createDataFrame([], "relative_path string, note string"), {"root": "r"})
    for form, pieces in (("json", reports.json_pieces(made)), ("sarif", reports.sarif_pieces(made, "tool", "1")), ("text", reports.text_pieces(made))):
        reports.write_parts(spark, pieces, str(tmp_path / form), "" if form == "text" else ",")
    whole = json.loads(joined(str(tmp_path / "json")))
    assert whole["findings"] == [] and whole["notes"] == ["no files selected for analysis"] and [a["decision"] for a in whole["audit_log"]] == ["allowed"] and whole["policy_effective_threshold"] is None
    assert json.loads(joined(str(tmp_path / "sarif")))["runs"][0]["results"] == [] and joined(str(tmp_path / "text")).endswith("- no active findings\n")


def test_scan_as_files(spark):
    """The whole scan of code, manifests and packages, as SARIF and JSON."""
    ordered = registry.materialised(registry.scan(spark, SF), "scan-as-files")
    made = reports.report(ordered.withColumn("json", reports.finding_json(ordered.columns)), findings.audit(ordered.withColumn("seq", findings.F.col("place"))), spark.createDataFrame([], "relative_path string, note string"), {"root": "r", "files_seen": 1, "files_selected": 1})
    at = registry.parts_written(spark, made, "scan-reports")
    rows = sorted(ordered.where("bucket = 'active'").collect(), key=lambda r: r.place)
    sarif, whole = json.loads(joined(f"{at}/sarif"))["runs"][0], json.loads(joined(f"{at}/json"))
    assert [r["properties"]["id"] for r in sarif["results"]] == [f["id"] for f in whole["findings"]] == [r.id for r in rows] and rows
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == list(dict.fromkeys(r.rule_id for r in rows))
    assert [f["metadata"] for f in whole["findings"]] == [r.metadata for r in rows] and [f["evidence"]["snippet"] for f in whole["findings"]] == [r.snippet for r in rows]
