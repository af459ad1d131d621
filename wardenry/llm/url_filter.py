"""URL filters by a temporal list join, in DataFrame functions alone.

A list is a log of dated entries (kind, value, action, since): from that day on, a domain with all its hosts, a host or a URL is blocked or
allowed, or its entry is removed. Each value's entries become validity intervals, from one entry to the next; removals end an interval and begin
none. A capture is looked up by its URL, its host and every parent domain, each by equality, with its fetch time within the
interval, so it meets at most one entry a key: the one active as of its fetch. The most specific entry decides (URL, then
host, then the longest domain; allow before block among entries of one value, by the last of a day).

Captures are reduced to distinct (host, fetched) and (url, fetched) before the join, lists to one entry a day, so neither a hot host nor a list entry that repeats multiplies.
Keys that very many hosts share (a top-level domain), and hosts and URLs of very many captures, meet their entries by broadcast: at most a fixed number of keys, with one interval a day each.

Contract of op5. The tables hold neither fetch times nor lists, so both are derived from `pages`, the list from the hosts of all its rows:
page_id p was fetched on 2024-01-01 + (37 * p) % 366 days. Each distinct host h of n characters, with k = n % 4 and the days of x taken as
2024-01-01 + x days, has: a block of the host on day 5 * n if it holds casino, pills, bets, win or free; for others with k = 0 a block of the host on
day 3 * n and its removal on day 7 * n; with k = 1 a block of its parent domain (what follows the first dot) on day 9 * n and, on day 4 * n, an allow of the host itself;
with k = 2 a block of the domain that is h itself on day 200 + n. Each distinct URL of m characters has an allow of the URL on day m if m % 11 = 3, and a block of it on day 2 * m with its removal on day 6 * m if m % 11 = 5. Returned per page: page_id, url, host, fetched (date), verdict (block, allow or none), kind, value, since, until (of the deciding entry; null: none or still open).

A null URL, or one without a host, gets none. URLs may be of any length. A null page_id means a null fetch time, and none. Rows that repeat stay. Empty tables give no rows, an empty list gives none for every capture.
judge() keeps other columns, whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, hot_keys, join_hot, table, written

#: The order in which kinds decide.
KINDS = ("domain", "host", "url")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot; null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def domains_of(host: Column, lengths: list[int]) -> Column:
    """The host and all that follows one of its dots, where it is of one of these lengths: no others are made, for they would grow with the square of the labels."""
    n = F.length(host)
    of_length = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: (k == n) | (k < n) & (F.substr(host, n - k, F.lit(1)) == "."))
    return F.transform(of_length, lambda k: F.substr(host, n - k + 1, k))


def validity(entries: DataFrame) -> DataFrame:
    """kind, value, action (block or allow), since, until (exclusive; null: still valid) from kind, value, action, since."""
    rank = F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)
    one = entries.where("kind IS NOT NULL AND value IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL").groupBy("kind", "value", "since").agg(F.max(F.struct(rank.alias("rank"), F.col("action"))).alias("x"))
    by_value = Window.partitionBy("kind", "value").orderBy("since")
    return one.select("kind", "value", F.col("x.action").alias("action"), "since", F.lead("since").over(by_value).alias("until")).where("action IN ('block', 'allow')")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched and others) with host, verdict, kind, value, since, until."""
    intervals = written(validity(entries), "intervals")
    own = captures.drop("host", "verdict", "kind", "value", "since", "until").withColumn("host", host_of(F.col("url")))
    named = own.where("host IS NOT NULL AND fetched IS NOT NULL")
    # Captures of one host and day share what their host and domains say; URLs are asked apart. Only URLs that the list names can be met.
    hosts = written(named.groupBy("host", "fetched").agg(F.count("*").alias("n")), "hosts")
    # The lengths of listed domains: distinct numbers, at most that of the longest.
    lengths = sorted(r[0] for r in intervals.where("kind = 'domain' AND value <> ''").select(F.length("value")).distinct().collect())
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value"))), F.transform(domains_of(F.col("host"), lengths), lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("value"))))
    asked = hosts.select("host", "fetched", F.explode(keys).alias("k")).select("host", "fetched", "k.kind", "k.value")
    hot = hot_keys(asked.groupBy("kind", "value").agg(F.count("*").alias("n")), ["kind", "value"])
    active = "since <= fetched AND (until IS NULL OR fetched < until)"
    best = F.max(F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), F.length("value").alias("n"), F.struct("action", "kind", "value", "since", "until").alias("entry")))
    of_host, of_url = free_name(own, "of_host"), free_name(own, "of_url")
    by_host = join_hot(asked, intervals.where("kind <> 'url'"), ["kind", "value"], hot).where(active).groupBy("host", "fetched").agg(best.alias("x")).select("host", "fetched", F.col("x.entry").alias(of_host))
    listed = intervals.where("kind = 'url'").withColumn("url", F.col("value"))
    urls = written(named.groupBy("url", "fetched").agg(F.count("*").alias("n")), "urls")
    by_url = urls.drop("n").join(listed, "url").where(active).select("url", "fetched", F.struct("action", "kind", "value", "since", "until").alias(of_url))
    met = join_hot(named, by_host, ["host", "fetched"], hot_keys(hosts, ["host", "fetched"]), "left")
    met = join_hot(met, by_url, ["url", "fetched"], hot_keys(urls, ["url", "fetched"]), "left")
    entry = F.coalesce(of_url, of_host)
    told = met.select(*(F.col(f"`{c}`") for c in own.columns), F.coalesce(entry["action"], F.lit("none")).alias("verdict"), *(entry[c].alias(c) for c in ("kind", "value", "since", "until")))
    nothing = {"verdict": F.lit("none"), "kind": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "since": F.lit(None).cast("date"), "until": F.lit(None).cast("date")}
    return told.unionByName(own.where("host IS NULL OR fetched IS NULL").withColumns(nothing))


def keep_allowed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    return judge(captures, entries).where("verdict <> 'block'").select(*captures.columns)


def _day(n: str | Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.expr(n).cast("int") if isinstance(n, str) else n)


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _day("(37 * page_id) % 366").alias("fetched"))


def derived_list(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url").cast("string")).alias("h")).where("h IS NOT NULL").distinct().withColumn("n", F.length("h")).withColumn("k", F.when(F.col("h").rlike("casino|pills|bets|win|free"), 9).otherwise(F.col("n") % 4))
    entry = lambda kind, value, action, day: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), _day(day).alias("since"))
    h, parent = F.col("h"), F.regexp_replace("h", r"^[^.]*\.?", "")
    cases = {9: [entry("host", h, "block", "5 * n")], 0: [entry("host", h, "block", "3 * n"), entry("host", h, "remove", "7 * n")], 1: [entry("domain", parent, "block", "9 * n"), entry("host", h, "allow", "4 * n")], 2: [entry("domain", h, "block", "200 + n")]}
    entries = F.array().cast("array<struct<kind:string,value:string,action:string,since:date>>")
    for k, own in cases.items():
        entries = F.when(F.col("k") == k, F.array(*own)).otherwise(entries)
    m, u = F.length("u"), F.col("u")
    urls = pages.select(F.col("url").cast("string").alias("u")).where("u IS NOT NULL").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    url = lambda action, on: F.struct(F.lit("url").alias("kind"), u.alias("value"), F.lit(action).alias("action"), day(on).alias("since"))
    of_urls = urls.select(F.explode(F.when(m % 11 == 3, F.array(url("allow", m))).when(m % 11 == 5, F.array(url("block", 2 * m), url("remove", 6 * m)))).alias("e"))
    return hosts.select(F.explode(entries).alias("e")).unionByName(of_urls).select("e.*")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(derived_captures(pages), derived_list(pages)).select("page_id", "url", "host", "fetched", "verdict", "kind", "value", "since", "until")


_D = "CAST(DATE '2024-01-01' + CAST({} AS INTEGER) AS DATE)"
ORACLE = {
    "op5_url_filter": rf"""
WITH c AS (SELECT row_number() OVER () AS r, page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '') AS host, {_D.format("(37 * page_id) % 366")} AS fetched FROM pages),
h AS (SELECT h, length(h) AS n, CASE WHEN regexp_matches(h, 'casino|pills|bets|win|free') THEN 9 ELSE length(h) % 4 END AS k FROM (SELECT DISTINCT host AS h FROM c WHERE host IS NOT NULL)),
u AS (SELECT DISTINCT url AS u, length(url) AS m FROM c WHERE url IS NOT NULL),
e AS (SELECT 'host' AS kind, h AS value, 'block' AS action, {_D.format("5 * n")} AS since FROM h WHERE k = 9
      UNION ALL SELECT 'host', h, 'block', {_D.format("3 * n")} FROM h WHERE k = 0 UNION ALL SELECT 'host', h, 'remove', {_D.format("7 * n")} FROM h WHERE k = 0
      UNION ALL SELECT 'domain', regexp_replace(h, '^[^.]*\.?', ''), 'block', {_D.format("9 * n")} FROM h WHERE k = 1 UNION ALL SELECT 'host', h, 'allow', {_D.format("4 * n")} FROM h WHERE k = 1
      UNION ALL SELECT 'domain', h, 'block', {_D.format("200 + n")} FROM h WHERE k = 2
      UNION ALL SELECT 'url', u, 'allow', {_D.format("m")} FROM u WHERE m % 11 = 3 UNION ALL SELECT 'url', u, 'block', {_D.format("2 * m")} FROM u WHERE m % 11 = 5 UNION ALL SELECT 'url', u, 'remove', {_D.format("6 * m")} FROM u WHERE m % 11 = 5),
o AS (SELECT kind, value, since, arg_max(action, CASE action WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM o),
m AS (SELECT c.r, v.*, row_number() OVER (PARTITION BY c.r ORDER BY v.kind = 'url' DESC, v.kind = 'host' DESC, length(v.value) DESC) AS best
      FROM c JOIN v ON (v.kind = 'url' AND v.value = c.url AND c.host IS NOT NULL OR v.kind = 'host' AND v.value = c.host OR v.kind = 'domain' AND (v.value = c.host OR ends_with(c.host, '.' || v.value))) AND v.action <> 'remove' AND v.since <= c.fetched AND (v.until IS NULL OR c.fetched < v.until))
SELECT page_id, url, host, fetched, coalesce(action, 'none') AS verdict, kind, value, since, until FROM c LEFT JOIN (SELECT * FROM m WHERE best = 1) m USING (r)
"""
}
QUERIES = {"op5_url_filter": op5_url_filter}
