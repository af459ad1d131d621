"""Chat formatting by quotation linking, in DataFrame functions alone.

Each message's lines are parsed for quote levels (the > marks at their start, blanks between them allowed). Consecutive lines of one
level are a passage; passages are normalised (lower case, runs of blanks as one) and hashed. A message's own passages (level 0), whole and line
by line, are what later messages of the conversation can quote. A quoted passage belongs to the earliest message that says it (a short one only to the
message one turn before), and a message replies to the latest message that its shallowest quotes (level 1, unless only deeper ones are found) belong to. Following replies gives trees. A walk through a
tree, down before on, is a list of steps; pointer doubling along it tells each message its root, depth and place, with rows of one size however
deep a conversation is. Read by place, each answer stands below what it answers. Bodies come without quotes, and a chat line frames each with its role.

Contract of op3. The table holds no quotes, so messages are derived from all its rows first (quoting): by turn % 4, a message begins with nothing (0), the whole text of the turn before with one mark a line (1), the
whole text of two turns before with two marks and then that of the turn before with one (2), or the last line of the turn before with two marks (3). A turn that several rows share is quoted by its least text;
without a text to quote, nothing is put in. Returned per message: conv_id, turn, role, body (lines of level 0, joined by newlines, outer blanks trimmed), n_quoted (lines of level 1 and more),
levels (the deepest), parent_turn (null: replies to none), root_turn, depth, reply_place (from 0 within the root's tree), chat (<|role|>, a newline, body). Sort by conv_id, root_turn and reply_place to read.

Messages with a null conv_id or turn, text or role are kept; without conv_id or turn nothing can be linked to them, and they are their own root. Null text has one empty line, null role is empty.
Rows that repeat (conv_id, turn) each stay; as originals they are one, and what any of them quotes counts. Turns may be any long. Lines and texts may be of any length. An empty table gives no rows. Other columns are ignored, whatever their names.
A passage that very many messages share is reduced to its earliest message before anything is joined, so no pairs arise; keys with very many rows are joined by broadcast, and siblings are ordered by a sort over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, numbered, table, written

#: Passages of fewer letters and digits than this ("ok", "thanks") are said too often to tell who is quoted, but for the message just before.
LEAST_CHARS = 8
MARKS = r"^[ \t>]*>[ \t]?"
MESSAGE = ["conv_id", "turn"]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n]+", " "))


def with_lines(messages: DataFrame) -> DataFrame:
    """messages with lines: array of level, line (without its marks)."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n?", "\n")
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    parsed = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.substr(x, F.length(marks(x)) + 1).alias("line")))
    return messages.withColumn("lines", parsed)


def passages(lines: str) -> Column:
    """Array of level, text: consecutive lines of one level, joined by newlines."""
    own, n = F.col(lines), F.size(lines)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(own, i)["level"] != F.get(own, i - 2)["level"]))
    ends = F.concat(F.slice(starts, F.lit(2), n), F.array(n + 1))
    text = lambda a, b: F.array_join(F.transform(F.slice(own, a, b - a), lambda x: x["line"]), "\n")
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(own, a)["level"].alias("level"), text(a, b).alias("text")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn of every message that quotes an earlier one."""
    own = with_lines(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text").where("conv_id IS NOT NULL AND turn IS NOT NULL"))
    parts = own.select(*MESSAGE, passages("lines").alias("parts"))
    # Besides whole passages, single lines can be quoted; and a quote can be told by any of its lines.
    pieces = F.flatten(F.transform("parts", lambda p: F.transform(F.array_distinct(F.concat(F.array(p["text"]), F.split(p["text"], "\n", -1))), lambda t: F.struct(p["level"].alias("level"), normalised(t).alias("text")))))
    each = parts.select(*MESSAGE, F.explode(F.array_distinct(pieces)).alias("p")).withColumn("letters", F.length(F.regexp_replace("p.text", "[^\\p{L}\\p{N}]", ""))).where("letters > 0")
    hashed = written(each.select(*MESSAGE, F.col("p.level").alias("level"), F.xxhash64("p.text", F.length("p.text")).alias("hash"), (F.col("letters") < LEAST_CHARS).alias("short")), "passages")
    said, quotes = hashed.where("level = 0"), hashed.where("level > 0")
    long, first = quotes.where("NOT short"), said.where("NOT short").groupBy("conv_id", "hash").agg(F.min("turn").alias("said"))
    hot = hot_keys(long.groupBy("conv_id", "hash").agg(F.count("*").alias("n")), ["conv_id", "hash"])
    met = join_hot(long, first, ["conv_id", "hash"], hot).where("said < turn").select(*MESSAGE, "level", "said")
    just = said.where("short").select("conv_id", "hash", F.try_add("turn", F.lit(1)).alias("turn")).distinct()
    near = quotes.where("short").join(just, ["conv_id", "hash", "turn"], "left_semi").select(*MESSAGE, "level", (F.col("turn") - 1).alias("said"))
    best = met.unionByName(near).groupBy(*MESSAGE).agg(F.max(F.struct(-F.col("level"), F.col("said"))).alias("x"))
    return best.select(*MESSAGE, F.col("x.said").alias("parent_turn"))


def reply_order(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth, reply_place of every message that replies or is replied to, from links (conv_id, turn, parent_turn; a message has one parent, of a lower turn).

    Each message is entered and left. The step after entering is its first answer's entering, or its own leaving; after leaving comes the next sibling, or the parent's leaving.
    Each round adds to a step what the step it points to knows of the rest of the walk, and points twice as far.
    """
    links = written(links, "quote-links")
    placed = numbered(links, "siblings", "conv_id", "parent_turn", "turn")
    after = placed.select("conv_id", "parent_turn", F.col("turn").alias("sibling"), (F.col("position") - 1).alias("position"))
    children = placed.join(after, ["conv_id", "parent_turn", "position"], "left").select("conv_id", "turn", "parent_turn", "sibling")
    roots = links.select("conv_id", F.col("parent_turn").alias("turn")).distinct().join(links, MESSAGE, "left_anti").withColumns({"parent_turn": F.lit(None).cast("long"), "sibling": F.lit(None).cast("long")})
    first = links.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = written(children.unionByName(roots).join(first, MESSAGE, "left"), "replies")
    step = lambda turn, leaves: F.when(F.col(turn).isNotNull(), F.struct(F.col(turn).alias("turn"), F.lit(leaves).alias("leaves")))
    enter = nodes.select(*MESSAGE, F.lit(False).alias("leaves"), F.coalesce(step("child", False), step("turn", True)).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("open"))
    leave = nodes.select(*MESSAGE, F.lit(True).alias("leaves"), F.coalesce(step("sibling", False), step("parent_turn", True)).alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("open"))
    now = enter.unionByName(leave).withColumn("root_turn", F.when(F.col("next").isNull(), F.col("turn")))
    while True:
        now = written(now, "walk")
        going = now.where("next IS NOT NULL")
        if not going.first():
            break
        on = now.select("conv_id", F.struct("turn", "leaves").alias("next"), F.col("next").alias("far"), F.col("entered").alias("entered_on"), F.col("open").alias("open_on"), F.col("root_turn").alias("root_on"))
        went = going.join(on, ["conv_id", "next"]).select(*MESSAGE, "leaves", F.col("far").alias("next"), (F.col("entered") + F.col("entered_on")).alias("entered"), (F.col("open") + F.col("open_on")).alias("open"), F.col("root_on").alias("root_turn"))
        now = now.where("next IS NULL").unionByName(went)
    entered = now.where("NOT leaves")
    total = entered.where("turn = root_turn").select("conv_id", "root_turn", F.col("entered").alias("total"))
    sizes = entered.groupBy("conv_id", "root_turn").agg(F.count("*").alias("n"))
    out = join_hot(entered, total, ["conv_id", "root_turn"], hot_keys(sizes, ["conv_id", "root_turn"]))
    return out.join(links, MESSAGE, "left").select(*MESSAGE, "parent_turn", "root_turn", (-F.col("open")).alias("depth"), (F.col("total") - F.col("entered")).alias("reply_place"))


def by_message(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with the columns of more, one row a message at most; messages that very many rows share are spread."""
    return join_hot(rows, more, MESSAGE, hot_keys(rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(*MESSAGE).agg(F.count("*").alias("n")), MESSAGE), "left")


def chat_messages(messages: DataFrame) -> DataFrame:
    """The columns of op3's contract, from messages (conv_id, turn, role, text) that quote each other."""
    own = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), "text")
    order = written(reply_order(link_quotes(own)), "reply-order")
    lines = with_lines(own)
    said = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"])
    body = F.regexp_replace(F.array_join(said, "\n"), r"^[ \t\n]+|[ \t\n]+\z", "")
    shown = lines.select("conv_id", "turn", "role", body.alias("body"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), F.array_max(F.transform("lines", lambda x: x["level"])).cast("long").alias("levels"))
    zero = F.lit(0).cast("long")
    return by_message(shown, order).select(
        "conv_id", "turn", "role", "body", "n_quoted", "levels", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"), F.coalesce("reply_place", zero).alias("reply_place"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body")).alias("chat"),
    )


def in_reply_order(messages: DataFrame) -> DataFrame:
    """chat_messages() sorted by conversation and reply order, over range partitions: a conversation of any size is split, none is gathered."""
    return chat_messages(messages).orderBy("conv_id", "root_turn", "reply_place")


def quoting(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: messages that begin with quotes of earlier ones by op3's contract, for the table has none."""
    own = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    least = written(own.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").groupBy(*MESSAGE).agg(F.min(F.regexp_replace("text", "\r\n?", "\n")).alias("said")), "said")
    before = lambda n: least.select("conv_id", F.try_add("turn", F.lit(n)).alias("turn"), F.col("said").alias(f"said_{n}")).where("turn IS NOT NULL")
    kind = F.pmod("turn", F.lit(4))
    marked = lambda text, mark: F.concat(F.regexp_replace(text, "(?m)^", mark), F.lit("\n"))
    last_line = F.element_at(F.split("said_1", "\n", -1), -1)
    quote = F.when(kind == 1, marked(F.col("said_1"), "> ")).when(kind == 2, F.concat(F.coalesce(marked(F.col("said_2"), ">> "), F.lit("")), F.coalesce(marked(F.col("said_1"), "> "), F.lit("")))).when(kind == 3, marked(last_line, ">> "))
    text = F.when(F.coalesce(quote, F.lit("")) == "", F.col("text")).otherwise(F.concat(quote, F.coalesce("text", F.lit(""))))
    return by_message(by_message(own, before(1)), before(2)).select("conv_id", "turn", "role", text.alias("text"))


def op3_chat_replies(spark, sf_dir: str) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth of every derived message that replies to another."""
    return reply_order(link_quotes(written(quoting(table(spark, sf_dir, "conversations")), "quoting"))).where("parent_turn IS NOT NULL").drop("reply_place")


def op3_chat_quotes(spark, sf_dir: str) -> DataFrame:
    return chat_messages(written(quoting(table(spark, sf_dir, "conversations")), "quoting"))


_NL = "chr(10)"
_LINES = rf"list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', {_NL}, 'g'), {_NL}), lambda x: {{'level': length(regexp_replace(regexp_extract(x, '^[ \t>]*>[ \t]?'), '[^>]', '', 'g')), 'line': substr(x, length(regexp_extract(x, '^[ \t>]*>[ \t]?')) + 1)}})"
_MARKED = lambda said, mark: f"'{mark}' || replace({said}, {_NL}, {_NL} || '{mark}') || {_NL}"
_REPLIES = rf"""
WITH RECURSIVE s AS (SELECT conv_id, turn, min(regexp_replace(text, '\r\n?', {_NL}, 'g')) AS said FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
d AS (SELECT c.conv_id, c.turn, c.role, c.text AS own, CASE ((c.turn % 4) + 4) % 4 WHEN 1 THEN {_MARKED("a.said", "> ")} WHEN 2 THEN coalesce({_MARKED("b.said", ">> ")}, '') || coalesce({_MARKED("a.said", "> ")}, '')
      WHEN 3 THEN {_MARKED(f"string_split(a.said, {_NL})[-1]", ">> ")} END AS quote
      FROM conversations c LEFT JOIN s a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN s b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
v AS (SELECT conv_id, turn, role, CASE WHEN coalesce(quote, '') = '' THEN own ELSE quote || coalesce(own, '') END AS text FROM d),
m AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, '') AS role, {_LINES} AS lines FROM v),
u AS (SELECT r, conv_id, turn, unnest(range(1, len(lines) + 1)) AS i, lines FROM m),
l AS (SELECT r, conv_id, turn, i, lines[i].level AS level, lines[i].line AS line FROM u),
g AS (SELECT *, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS run FROM l),
p AS (SELECT r, conv_id, turn, level, string_agg(line, {_NL} ORDER BY i) AS text FROM g GROUP BY r, conv_id, turn, level, run UNION SELECT r, conv_id, turn, level, line FROM l),
h AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(text), '[ \t\n]+', ' ', 'g')) AS text FROM p WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
k AS (SELECT *, length(regexp_replace(text, '[^\pL\pN]', '', 'g')) AS letters FROM h),
f AS (SELECT conv_id, text, min(turn) AS said FROM k WHERE level = 0 AND letters >= {LEAST_CHARS} GROUP BY ALL),
q AS (SELECT k.conv_id, k.turn, k.level, f.said FROM k JOIN f ON k.conv_id = f.conv_id AND k.text = f.text WHERE k.level > 0 AND f.said < k.turn
      UNION ALL SELECT k.conv_id, k.turn, k.level, o.turn FROM k JOIN k o ON o.conv_id = k.conv_id AND o.turn = k.turn - 1 AND o.text = k.text AND o.level = 0 WHERE k.level > 0 AND k.letters BETWEEN 1 AND {LEAST_CHARS - 1}),
links AS (SELECT conv_id, turn, arg_max(said, {{'a': -level, 'b': said}}) AS parent FROM q GROUP BY ALL),
paths AS (SELECT DISTINCT m.conv_id, m.turn, NULL::BIGINT AS parent, [m.turn] AS path FROM m WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.conv_id = m.conv_id AND links.turn = m.turn)
          UNION ALL SELECT links.conv_id, links.turn, links.parent, list_append(paths.path, links.turn) FROM paths JOIN links ON links.conv_id = paths.conv_id AND links.parent = paths.turn),
o AS (SELECT conv_id, turn, parent, path[1] AS root, len(path) - 1 AS depth, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS place FROM paths),
"""
ORACLE = {
    "op3_chat_quotes": rf"""{_REPLIES}
b AS (SELECT r, regexp_replace(coalesce(string_agg(line, {_NL} ORDER BY i) FILTER (level = 0), ''), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS body, count(*) FILTER (level > 0) AS n_quoted, max(level) AS levels FROM l GROUP BY r)
SELECT m.conv_id, m.turn, m.role, b.body, b.n_quoted, b.levels, o.parent AS parent_turn, o.root AS root_turn, CAST(o.depth AS BIGINT) AS depth, CAST(o.place AS BIGINT) AS reply_place, '<|' || m.role || '|>' || {_NL} || b.body AS chat
FROM m JOIN b USING (r) LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND o.turn IS NOT DISTINCT FROM m.turn
""",
    "op3_chat_replies": _REPLIES.rstrip().rstrip(",") + " SELECT conv_id, turn, parent AS parent_turn, root AS root_turn, CAST(depth AS BIGINT) AS depth FROM o WHERE parent IS NOT NULL",
}
QUERIES = {"op3_chat_quotes": op3_chat_quotes, "op3_chat_replies": op3_chat_replies}
