"""Scans along files against plain loops, and files of 100,000 lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardenry.operators import scans, taint_flow


def code(spark, files):
    return spark.createDataFrame([(k, i + 1, x) for k, own in files.items() for i, x in enumerate(own)], "file_id long, line_no long, line string").repartition(3)


def blocks(lines):
    """(what, kind, at, first, last) by plain loops."""
    out, n = [], len(lines)
    indent = [len(x) - len(x.lstrip(" ")) for x in lines]
    body = lambda i: next((j for j in range(i + 1, n) if lines[j].strip() and indent[j] <= indent[i]), n)
    balance, opened = 0, []
    for i, x in enumerate(lines):
        if not x.strip():
            continue
        if m := re.match(r"\s*(if|elif|else)\b.*:\s*$", x):
            out.append(("indent", m[1], i + 1, i + 2, body(i)))
        if m := re.match(r"\s*def\s+(\w+)\s*\(([^)]*)\)\s*:\s*$", x):
            out.append(("function", m[1], i + 1, i + 2, body(i)))
        if (m := re.match(r"(if|else\s+if|else|switch|case)\b", x.strip())) and "{" in x:
            opened.append((m[1].replace(" ", "_"), i + 1))
        balance = max(0, balance + x.count("{") - x.count("}"))
        if not balance:
            out += [("brace", kind, at, at + 1, i + 1) for kind, at in opened]
            opened = []
    out += [("brace", kind, at, at + 1, n) for kind, at in opened]
    for i, x in enumerate(lines):
        if m := re.match(r"\s*function\s+(\w+)\s*\(([^)]*)\)\s*\{", x):
            depth, last = x.count("{") - x.count("}"), i + 1
            for j in range(i + 2, n if depth > 0 else 0):
                depth += lines[j].count("{") - lines[j].count("}")
                if depth <= 0:
                    last = j + 1
                    break
            out.append(("function", m[1], i + 1, i + 2, last))
    return sorted(out)


def inside(lines):
    spans = [x for x in blocks(lines) if x[0] != "function"]
    out = {}
    for n in range(1, len(lines) + 1):
        held = [(x[0] == "indent", x[2], x[1]) for x in spans if x[3] <= n <= x[4]]
        if held and lines[n - 1].strip(" "):
            out[n] = (max(held)[2], max(held)[1])
    return out


def sources():
    pick = random.Random(11)
    parts = ["if a:", "elif b:", "else:", "def f(x):", "x = 1", "", "  ", "if (a) {", "} else {", "else if (b) {", "}", "}}", "{", "function g(y) {", "case 1: {", "switch (z) {", "if (a) { b }", "function h(y) { return }"]
    return {k: [" " * pick.choice((0, 0, 2, 4, 8)) + pick.choice(parts) for _ in range(pick.choice((1, 5, 40, 90)))] for k in range(40)}


@pytest.mark.parametrize("fan, block", [(4, 8), (256, 1024)])
def test_shapes_and_branches_by_plain_loops(spark, monkeypatch, fan, block):
    monkeypatch.setattr(scans, "FAN", fan)
    monkeypatch.setattr(scans, "BLOCK", block)
    files = sources()
    lines = code(spark, files)
    found = taint_flow.materialised(taint_flow.shapes(lines), "shapes")
    got = {k: [] for k in files}
    for r in found.collect():
        got[r.file_id].append((r.what, r.kind, r["at"], r.first, r.last))
    assert {k: sorted(x) for k, x in got.items()} == {k: blocks(x) for k, x in files.items()}
    placed = {k: {} for k in files}
    for r in taint_flow.branches(lines, found).collect():
        placed[r.file_id][r.line_no] = (r.branch_kind, r.branch_line)
    assert placed == {k: inside(x) for k, x in files.items()}


def test_an_unclosed_brace_before_very_many_branches(spark):
    n = 100_000
    lines = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("file_id"), F.col("id").alias("line_no"), F.when(F.col("id") == 1, "{").otherwise("if (a) {").alias("line"))
    # Each line lies in the branch of the line before it.
    assert taint_flow.branches(lines).agg(F.count("*"), F.sum(F.col("line_no") - F.col("branch_line"))).first()[:] == (n - 2, n - 2)


def test_interval_join_by_plain_loops(spark, monkeypatch):
    pick = random.Random(2)
    spans = [(1, pick.choice("ab"), a, a + pick.randrange(-1, 40), i) for i, a in enumerate(pick.choices(range(100), k=60))]
    points = [(1, pick.choice("ab"), p) for p in pick.choices(range(140), k=80)]
    met = scans.stabbed(spark.createDataFrame(points, "file_id long, v string, line_no long"), spark.createDataFrame(spans, "file_id long, v string, first long, last long, n long"), ["file_id", "v"], 140)
    assert sorted((r.v, r.line_no, r.n) for r in met.collect()) == sorted((v, p, n) for _, v, p in points for _, w, a, b, n in spans if v == w and a <= p <= b)


def test_a_variable_set_and_used_100000_times(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("file_id"), F.lit("v").alias("name"), F.col("id").alias("line_no"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("seq"))
    got = scans.running_max(rows, "seq", ["file_id", "name"], "line_no")
    assert got.where(F.col("seq") != F.col("line_no") - F.col("line_no") % 3).count() == 0 and got.count() == n


def test_contexts_of_one_file(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 16)
    n = 1000
    lines = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("file_id"), F.col("id").alias("line_no"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("line"))
    got = {r.line_no: r.context for r in scans.around(lines, 5, 1).collect()}
    assert got == {k: "\n".join(f"l{x}" for x in range(max(1, k - 5), min(n, k + 1) + 1)) for k in range(1, n + 1)}


def test_very_many_calls_of_a_long_function():
    """Calls and lines add up, they don't multiply."""
    body = {k: f"    y{k} = x" for k in range(2, 2002)}
    lines = {1: "def f(x):", **body, 2002: "    return y5", **{k: f"z{k} = f(request.args.get('q'))" for k in range(2003, 4003)}}
    rows = taint_flow.Flow(lines, {}, {"f": (["x"], 2, 2002)}).rows(1)
    assert len([r for r in rows if r[2] == "lines" and r[3] != r[4]]) == 1 and len(rows) < 12_000
    last = next(r for r in reversed(rows) if r[2] == "variable" and r[5] == "z4002")
    assert list(last[-1])[-3:] == ["y5", "f", "z4002"] and last[8] == 4002
