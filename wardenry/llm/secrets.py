"""Secret scans in DataFrame functions alone.

Three patterns give the base spans. Beside them, candidate strings (runs of at least WINDOW
letters, digits, + / _ -) are cut at allow-listed stretches; what is left and is long enough and mixes letters and digits is classed by the characters it uses, and a window slides
over it: the counts of the window's characters are updated by the one that enters and the one that leaves, and so is
the sum of c * log2(c), from which the window's Shannon entropy follows. A candidate whose best window reaches its class's
bound is a span too, unless it overlaps a base span.

Offsets are code points, ends exclusive; they are running sums of the lengths of matches and of the gaps between them, taken in blocks, so that a text
of very many matches or a match of a million characters costs little more than in proportion.
Null text counts as empty. Spans that start together are ordered by kind. Rows that repeat and other columns stay, whatever their names; columns named like a result (base, spans) are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, spread, table

#: Key words in either case; spelled out, for case folding differs between engines beyond ASCII.
_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The run holds one of at least this length where it matches from its start, so these equal the base patterns with failing matches dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order that breaks ties; entropy is this method's own.
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Class: (pattern of the whole candidate, characters as the window counts them, bits that a window must reach). The first that fits holds.
CLASSES = (
    ("hex", "[0-9a-fA-F]+", "0123456789abcdef", 3.0),
    ("upper", "[A-Z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.5),
    ("lower", "[a-z0-9_-]+", "abcdefghijklmnopqrstuvwxyz0123456789_-", 3.6),
    ("mixed", "[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9),
)
#: What is long and varied but no secret: placeholders, runs of the alphabet, UUIDs, paths of words, dates. Each stretch has a bounded length, so no place in a text is tried for long.
ALLOWED = r"(?i)example|placeholder|sample|dummy|changeme|x{6}|0123456|abcdef0|abcdefgh|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}|(?:[a-z]{1,32}[/_-]){4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|^[a-z_-]*[0-9]{1,4}$"
#: Steps that a running sum takes before it starts anew; characters that a text is cut into before stretches are taken out.
BLOCK, PAGE = 256, 8192


def let(value: Column, f) -> Column:
    """f(value), where value is computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_sums(numbers: Column) -> Column:
    """The sum up to each of the numbers (an array of integers), itself included; block by block, for an array that grows by one copies itself."""
    last = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit(0))
    grow = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    def of_blocks(blocks):
        before = grow(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
        at = F.concat(F.array(F.lit(0)), before)
        return F.flatten(F.zip_with(blocks, F.slice(at, F.lit(1), F.size(blocks)), lambda b, o: F.transform(grow(b), lambda x: x + o)))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.slice(xs, k + 1, F.lit(BLOCK)))
    return let(numbers, lambda xs: let(cut(xs), of_blocks))


def places(text: Column, pattern: str) -> Column:
    """Array of gap, match, start, end: each match (the last is null) with the gap before it and the match's place."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("n")))
    located = lambda ps: F.zip_with(ps, running_sums(F.transform(ps, lambda p: p["n"])), lambda p, e: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), (e - F.coalesce(F.length(p["match"]), F.lit(0))).alias("start"), e.alias("end")))
    return let(pairs, located)


def _found(text: Column, pattern: str, kind: str, keep=None, prefilter: str | None = None) -> Column:
    """Array of kind, start, end, value: the matches with their places."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    matched = F.filter(places(text, pattern), lambda p: p["match"].isNotNull())
    spans = F.transform(matched, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["match"].alias("value")))
    return F.when(text.rlike(prefilter or pattern), F.filter(spans, keep) if keep is not None else spans).otherwise(empty)


def cut_allowed(spans: Column) -> Column:
    """The spans without their allow-listed stretches: what is left of each, where it is long enough and mixes letters and digits."""
    def rest(s):
        whole = F.array(s)
        parts = F.transform(places(s["value"], ALLOWED), lambda p: F.struct(s["kind"].alias("kind"), (s["start"] + p["start"] - F.length(p["gap"])).alias("start"), (s["start"] + p["start"]).alias("end"), p["gap"].alias("value")))
        return F.when(s["value"].rlike(ALLOWED), parts).otherwise(whole)

    fit = lambda s: (F.length(s["value"]) >= WINDOW) & s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    return F.filter(F.flatten(F.transform(spans, rest)), fit)


def apart_from(spans: Column, others: Column) -> Column:
    """The spans (by start, none overlapping another) that overlap none of the others, by a sweep over all starts and ends.

    Others that start before a span's end, less those that end by its start, are those that overlap it.
    """
    # At one place, ends of others come first (0), then spans' own edges (1 a start, 2 an end), then starts of others (3).
    edge = lambda at, what: F.struct(at.alias("at"), F.lit(what).alias("what"))
    edges = F.sort_array(F.concat(F.transform(others, lambda o: edge(o["end"], 0)), F.transform(spans, lambda s: edge(s["start"], 1)), F.transform(spans, lambda s: edge(s["end"], 2)), F.transform(others, lambda o: edge(o["start"], 3))))
    count = lambda es, what: running_sums(F.transform(es, lambda e: (e["what"] == what).cast("int")))

    def swept(es):
        met = lambda which, counted: F.transform(F.filter(F.zip_with(es, count(es, counted), lambda e, n: F.struct(e["what"].alias("what"), n.alias("n"))), lambda x: x["what"] == which), lambda x: x["n"])
        free = F.zip_with(met(1, 0), met(2, 3), lambda ended, begun: begun == ended)
        return F.transform(F.filter(F.zip_with(spans, free, lambda s, ok: F.struct(s.alias("s"), ok.alias("ok"))), lambda x: x["ok"]), lambda x: x["s"])

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(edges, swept))


def best_window(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest entropy, in bits, of any `window` consecutive characters; one pass with counts that are updated, not recounted."""
    size = len(alphabet)
    bits = F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 1)))
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))
    zero = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("sum"), F.lit(float(window)).alias("least"))

    def changed(counts, at, by):
        return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(F.element_at(counts, at) + by), F.slice(counts, at + 1, F.lit(size)))

    def step(acc, i):
        """Takes in character i and lets go of character i - window, if there is one."""
        enters, leaves = F.element_at(i["codes"], 1), F.element_at(i["codes"], 2)
        count = F.element_at(acc["n"], enters)
        grown = F.struct(changed(acc["n"], enters, F.lit(1)).alias("n"), (acc["sum"] + F.element_at(bits, count + 2) - F.element_at(bits, count + 1)).alias("sum"))
        # A single-element transform names what would otherwise be computed several times.
        return F.element_at(F.transform(F.array(grown), lambda g: _left(g, acc, leaves, i["full"])), 1)

    def _left(g, acc, leaves, full):
        count = F.element_at(g["n"], F.greatest(leaves, F.lit(1)))
        counts = F.when(leaves > 0, changed(g["n"], leaves, F.lit(-1))).otherwise(g["n"])
        total = F.when(leaves > 0, g["sum"] + F.element_at(bits, count) - F.element_at(bits, count + 1)).otherwise(g["sum"])
        return F.element_at(F.transform(F.array(total), lambda t: F.struct(counts.alias("n"), t.alias("sum"), F.when(full, F.least(acc["least"], t / window)).otherwise(acc["least"]).alias("least"))), 1)

    def moves(cs):
        earlier = F.concat(F.array_repeat(F.lit(0), window), cs)
        return F.transform(F.arrays_zip(cs.alias("a"), F.slice(earlier, F.lit(1), F.size(cs)).alias("b"), F.sequence(F.lit(1), F.size(cs)).alias("i")), lambda z: F.struct(F.array(z["a"], z["b"]).alias("codes"), (z["i"] >= window).alias("full")))

    at = F.element_at(F.transform(F.array(codes), moves), 1)
    # A window of w has entropy log2(w) - sum / w.
    return F.aggregate(at, zero, step, lambda acc: F.lit(math.log2(window)) - acc["least"])


def _random(value: Column) -> Column:
    """Whether the candidate is varied enough for its class."""
    out = F.lit(False)
    for name, pattern, alphabet, bound in reversed(CLASSES):
        counted = F.lower(value) if name == "hex" else value
        out = F.when(value.rlike(f"^(?:{pattern})$"), best_window(counted, alphabet) >= bound).otherwise(out)
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with base and spans: arrays of kind, start, end, value, by start and then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = lambda s: (s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]))

    def ordered(spans):
        keyed = F.transform(spans, lambda s: F.struct(*at(s), s.alias("own")))
        return F.transform(F.array_sort(keyed), lambda k: k["own"])

    long_value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6
    base = F.concat(_found(text, ASSIGN, "assign", long_value, _KEY), _found(text, ACCESS, "access"), _found(text, HEX, "hex"))
    kept = docs.drop("base", "spans")
    own = free_name(docs, "candidates")
    found = kept.withColumn("base", ordered(base)).withColumn(own, _found(text, CANDIDATE, "entropy"))
    more = F.when(F.size(own) > 0, F.filter(apart_from(cut_allowed(F.col(own)), F.col("base")), lambda s: _random(s["value"]))).otherwise(F.col(own))
    return found.withColumn("spans", ordered(F.concat("base", more))).drop(own)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of secret text replaced by the mark; spans that overlap or touch are one stretch. Null texts stay null."""
    text = F.col("text").cast("string")

    def stretches(spans):
        """What lies between stretches: pairs of where it begins and ends."""
        edges = F.sort_array(F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("by"))), F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(2).alias("by")))))
        # Starts come before ends at one place, so what touches stays open.
        opened = lambda es: F.zip_with(es, running_sums(F.transform(es, lambda e: 3 - 2 * e["by"])), lambda e, n: F.struct(e["at"].alias("at"), e["by"].alias("by"), n.alias("open")))
        outer = lambda es, by, n: F.transform(F.filter(opened(es), lambda e: (e["by"] == by) & (e["open"] == n)), lambda e: e["at"])
        return let(edges, lambda es: F.zip_with(F.concat(F.array(F.lit(0)), outer(es, 2, 0)), F.concat(outer(es, 1, 1), F.array(F.length(text))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

    def cut(pages, s):
        """The text from s.a to s.b, out of the pages that it touches."""
        whole = lambda k: F.substr(F.get(pages, k), F.greatest(s["a"] - k * PAGE, F.lit(0)) + 1, s["b"] - F.greatest(s["a"], k * PAGE))
        div = lambda x: F.floor(x / PAGE).cast("int")
        return F.when(s["b"] > s["a"], F.array_join(F.transform(F.sequence(div(s["a"]), div(s["b"] - 1)), whole), "")).otherwise("")

    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    clean = let(pages, lambda ps: F.array_join(F.transform(stretches(F.col("spans")), lambda s: cut(ps, s)), mark))
    return find_secrets(docs).withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(text)).select(*docs.columns)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op2_secret_scan": op2_secret_scan}


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_places(kind: str, pattern: str) -> str:
    return f"""SELECT r, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT r, regexp_extract_all(t, {_sql(pattern)}) AS m, string_split_regex(t, {_sql(pattern)}) AS g FROM d WHERE regexp_matches(t, {_sql(pattern)}))"""


_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(v, '{p}') THEN {b}" for _, p, _, b in CLASSES) + " END"
_CASE_SQL = f"CASE WHEN regexp_full_match(v, '{CLASSES[0][1]}') THEN lower(v) ELSE v END"
ORACLE = {
    "op2_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(_sql_places(k, x) for k, x in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)))}),
s AS (SELECT r, kind, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a FROM p),
b AS (SELECT r, kind, v, a, a + length(v) AS z FROM s WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(regexp_extract(v, {_sql(ASSIGN)}, 2)) >= 6),
ci AS (SELECT r, a, g, m, unnest(range(1, len(g) + 1)) AS i FROM (SELECT r, a, string_split_regex(v, {_sql(ALLOWED)}) AS g, regexp_extract_all(v, {_sql(ALLOWED)}) AS m FROM s WHERE kind = 'entropy')),
cp AS (SELECT r, g[i] AS v, CAST(a + coalesce(list_sum(list_transform(g[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a FROM ci),
c AS (SELECT r, 'entropy' AS kind, v, a, a + length(v) AS z FROM cp WHERE length(v) >= {WINDOW} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = cp.r AND b.a < cp.a + length(cp.v) AND cp.a < b.z)),
w AS (SELECT r, a, z, v, bound, max(log2({WINDOW}) - list_sum(list_transform(list_distinct(string_split(x, '')), lambda y: (length(x) - length(replace(x, y, ''))) * log2(length(x) - length(replace(x, y, ''))))) / {WINDOW}) AS h
      FROM (SELECT r, a, z, v, {_CLASS_SQL} AS bound, substr({_CASE_SQL}, unnest(range(1, length(v) - {WINDOW} + 2)), {WINDOW}) AS x FROM c) GROUP BY ALL),
u AS (SELECT r, kind, a, z FROM b UNION ALL SELECT r, 'entropy', a, z FROM w WHERE h >= bound),
j AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, list_position({list(KINDS)}, kind)) AS spans,
      string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, list_position({list(KINDS)}, kind)) FILTER (kind <> 'entropy') AS base FROM u GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.r = j.r
"""
}
