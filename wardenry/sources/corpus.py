"""Where text comes from: tables, folders of files, and lines derived from business keys; and the JSON inputs of triage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
BINARY_SUFFIXES = (".pyc", ".class", ".dll", ".exe", ".gif", ".jpg", ".jpeg", ".o", ".png", ".so", ".wasm", ".zip")
DEFAULT_EXCLUDES = ("**/.git/**", "**/__pycache__/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/target/**")

#: Lines that stand for code, by language; derived rows pick one by their key.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "python": (
        "name = request.args.get('name')", "query = \"SELECT * FROM users WHERE id = \" + name", "cursor.execute(query)", "db.session.execute(text(user_input))",
        "data = open(filename).read()", "requests.get(next_url)", "return redirect(request.args.get('next'))", "@login_required", "value = name", "return render_template_string(value)",
        "if user.is_admin:", "token = \"abcd1234efgh5678\"", "cursor.execute(\"SELECT 1 WHERE a = %s\", (name,))", "total = 1 + 2", "@app.route('/users')", "shutil.move(path, target)", "return render_template('page.html', name=name)",
    ),
    "javascript": (
        "const name = req.query.name;", "document.body.innerHTML = name;", "fetch(url)", "fs.readFile(path.join(root, name))", "res.redirect(req.query.next)", "app.use(requireAuth);", "let copy = name;", "router.get('/x', handler)",
        "const secret = 'correcthorsebattery'", "const n = 4;", "res.render(view)", "axios.post(user_input)",
    ),
    "typescript": (
        "const name: string = req.query.name;", "const copy = req.query.name;", "el.innerHTML = copy;", "fetch(copy)", "app.get('/users', list)", "res.redirect(req.query.next)", "export const n = 4;", "app.use(requireAuth())", "router.use(withAuth);", "res.render(view)", "path.join(root, copy)",
    ),
    "php": (
        "$name = $request->input('name');", "return view('page', ['n' => $request->input('n')]);", "exec($cmd);", "file_get_contents($url);", "return redirect()->to($next);", "Http::get($url);", "$copy = $name;", "Storage::delete($path);", "echo 1;", "Auth::check()",
    ),
    "java": (
        "@GetMapping(\"/users\")", "String name = request.getParameter(\"name\");", "jdbcTemplate.query(\"SELECT * FROM t WHERE n = \" + name);", "restTemplate.getForObject(url, String.class);", "return \"redirect:\" + next;", "Files.readString(path);", "new ObjectInputStream(in).readObject();",
        "SharedPreferences prefs = getSharedPreferences(\"a\", MODE_PRIVATE);", "editor.putString(\"auth_token\", token);", "int n = 1;", "Files.copy(a, b);", "yaml.load(body);", "String copy = name;",
    ),
    "kotlin": (
        "@PostMapping(\"/k\")", "val name = request.getParameter(\"name\")", "jdbcTemplate.update(\"DELETE FROM t WHERE n = \" + name)", "webClient.get(url)", "return \"redirect:\" + next", "Files.delete(path)", "gson.fromJson(body)",
        "val prefs = getSharedPreferences(\"a\", MODE_WORLD_READABLE)", "prefs.edit().putString(\"password\", p)", "val n = 1",
    ),
}
LANGUAGES = tuple(TEMPLATES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share (a temporary folder where that is unset and all runs on this machine)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df as a table in shared_folder()."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normalised(text: Column) -> Column:
    """Newlines of one kind."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def code_lines(orders: DataFrame) -> DataFrame:
    """file_id, line_no, language, line: synthetic code. A customer is a file, its orders are the lines."""
    from pyspark.sql import Window

    n = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("o_custkey") % len(LANGUAGES) + 1).cast("int"))
    lines = [F.element_at(F.array(*map(F.lit, TEMPLATES[x])), (F.floor(F.col("o_orderkey") / 4) % len(TEMPLATES[x]) + 1).cast("int")) for x in LANGUAGES]
    line = F.element_at(F.array(*lines), (F.col("o_custkey") % len(LANGUAGES) + 1).cast("int"))
    return orders.select(F.col("o_custkey").alias("file_id"), F.row_number().over(n).cast("long").alias("line_no"), language.alias("language"), line.alias("line"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The same rows for DuckDB.
CODE_SQL = (
    f"code AS (SELECT o_custkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, CASE o_custkey % {len(LANGUAGES)} "
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGUAGES))
    + f" END AS language, CASE o_custkey % {len(LANGUAGES)} "
    + " ".join(f"WHEN {i} THEN [{', '.join(map(_quoted, TEMPLATES[x]))}][(o_orderkey // 4) % {len(TEMPLATES[x])} + 1]" for i, x in enumerate(LANGUAGES))
    + " END AS line FROM orders)"
)


#: Pieces of code for data flow; {k} is a key of its own, so that pieces don't meet.
SNIPPETS: dict[str, tuple[str, ...]] = {
    "python": (
        "a_{k} = request.args.get('q')\nb_{k} = a_{k}\nprint(b_{k})",
        "def load_{k}(item_{k}):\n    part_{k} = item_{k}\n    return part_{k}\nc_{k} = request.form.get('x')\nd_{k} = load_{k}(c_{k})\nprint(d_{k})",
        "e_{k} = []\ne_{k}.append(request.cookies.get('s'))\nf_{k} = e_{k}[0]\nprint(f_{k})",
        "g_{k} = request.headers.get('h')\nobj_{k}.body = g_{k}\nh_{k} = obj_{k}.body\nprint(h_{k})",
        "u_{k} = request.args.get('u')\nif is_safe_url(u_{k}):\n    v_{k} = u_{k}\n    requests.get(v_{k})\nelif False:\n    print(u_{k})",
        "s_{k} = html.escape(request.args.get('s'))\nprint(s_{k})\nclean_{k} = 1",
    ),
    "javascript": (
        "const a_{k} = req.query.name;\nsend(a_{k});",
        "function wrap_{k}(x_{k}) {\n  const y_{k} = x_{k};\n  return y_{k};\n}\nconst z_{k} = wrap_{k}(req.body.z);\nsend(z_{k});",
        "let q_{k} = req.cookies.q;\nif (false) {\n  send(q_{k});\n  let r_{k} = q_{k};\n}\ndone_{k}();",
        "const m_{k} = {};\nm_{k}['x'] = req.headers.x;\nlet n_{k} = m_{k}['x'];\nsend(n_{k});",
    ),
}


def flow_lines(orders: DataFrame) -> DataFrame:
    """file_id, line_no, language, line, and snippet (its number), part (the line's place in it) and key: each order of a customer is a piece of code."""
    from pyspark.sql import Window

    names = tuple(SNIPPETS)
    language = F.element_at(F.array(*map(F.lit, names)), (F.col("o_custkey") % len(names) + 1).cast("int"))
    number, text = F.lit(None), F.lit(None).cast("string")
    for name in names:
        own = (F.floor(F.col("o_orderkey") / 4) % len(SNIPPETS[name])).cast("int")
        number, text = F.when(language == name, own).otherwise(number), F.when(language == name, F.element_at(F.array(*map(F.lit, SNIPPETS[name])), own + 1)).otherwise(text)
    pieces = orders.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("key"), language.alias("language"), number.alias("snippet"), F.replace(text, F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("text"))
    lines = pieces.select("file_id", "key", "language", "snippet", F.posexplode(F.split("text", "\n")).alias("part", "line"))
    n = Window.partitionBy("file_id").orderBy("key", "part")
    return lines.select("file_id", F.row_number().over(n).cast("long").alias("line_no"), "language", "line", "snippet", (F.col("part") + 1).alias("part"), "key")


#: The same rows for DuckDB.
FLOW_SQL = (
    f"flow_pieces AS (SELECT o_custkey AS file_id, o_orderkey AS key, CASE o_custkey % {len(SNIPPETS)} "
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SNIPPETS)) + f" END AS language, CASE o_custkey % {len(SNIPPETS)} "
    + " ".join(f"WHEN {i} THEN (o_orderkey // 4) % {len(SNIPPETS[x])}" for i, x in enumerate(SNIPPETS)) + f" END AS snippet, replace(CASE o_custkey % {len(SNIPPETS)} "
    + " ".join(f"WHEN {i} THEN [{', '.join(_quoted(y).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) for y in SNIPPETS[x])}][(o_orderkey // 4) % {len(SNIPPETS[x])} + 1]" for i, x in enumerate(SNIPPETS))
    + " END, '{k}', CAST(o_orderkey AS VARCHAR)) AS text FROM orders), "
    "flow_parts AS (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS part FROM flow_pieces), "
    "flow AS (SELECT file_id, key, language, snippet, part, string_split(text, chr(10))[part] AS line, row_number() OVER (PARTITION BY file_id ORDER BY key, part) AS line_no FROM flow_parts)"
)


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for whole paths; * spans folders too, so ** needs one before it, as the default excludes do. [] are classes, [!] their complements."""
    out, i = "", 0
    while i < len(glob):
        step, close = 1, glob.find("]", i + 2)
        if glob[i] == "*":
            step, out = (2 if glob[i : i + 2] == "**" else 1), out + ".*"
        elif glob[i] == "[" and close > 0:
            inside = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            step, out = close + 1 - i, out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside.replace("^", "\\^")) + "]"
        else:
            out += "." if glob[i] == "?" else "\\" + glob[i] if glob[i] in ".^$+()[]{}|\\" else glob[i]
        i += step
    return f"^(?:{out})$"


def tail_pattern(glob: str) -> str:
    """The other reading of a glob: by parts from the path's end, where * and ? stay within a part (an absolute glob needs the whole path, which is relative, so never holds)."""
    parts = [p for p in glob.split("/") if p not in ("", ".")]
    if glob.startswith("/") or not parts:
        return r"(?!)"
    one = lambda p: "[^/]*" if p == "**" else glob_pattern(p)[4:-2].replace(".*", "[^/]*")
    return r"(?:^|/)" + "/".join(map(one, parts)) + "$"


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path fits one of the globs in either reading."""
    return path.rlike("|".join(p for g in globs for p in (glob_pattern(g), tail_pattern(g)))) if globs else F.lit(False)


#: The start of a file that tells whether it is binary.
HEAD = 4096


def decoded(content: Column) -> Column:
    """Bytes as text: what is no UTF-8 is left out, newlines are of one kind."""
    text = content.cast("string")
    return normalised(F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))))


def files(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = DEFAULT_EXCLUDES) -> DataFrame:
    """Every file below root, or the file that root names, with skip_reason (null: selected): relative_path, size, content, text. Links are followed or not as the file system's listing does; what it lists is read.

    A UTF-8 character cut by the end of the head does not make a file binary.
    """
    at = F.regexp_extract("path", "^(?:[a-z]+:)?/*(.*)$", 1)
    base = root.split(":", 1)[-1].strip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.when(at == base, F.substring_index(at, "/", -1)).otherwise(F.substring(at, len(base) + 2, 1_000_000))
    path, head = F.col("relative_path"), F.substring("content", 1, HEAD)
    # Up to three last bytes of a head may begin a character.
    valid = F.lit(False)
    for cut in range(4):
        valid |= F.is_valid_utf8(F.substring(head, 1, F.greatest(F.length(head) - (cut if cut else 0), F.lit(0))).cast("string")) & (F.lit(cut == 0) | (F.length("content") > HEAD))
    nul = F.expr(f"position(X'00' IN substring(content, 1, {HEAD})) > 0")
    binary = F.lower(path).rlike("(?:" + "|".join(x.replace(".", "[.]") for x in BINARY_SUFFIXES) + ")$") | nul | ~valid
    reason = F.when(~matches_any(path, include) if include else F.lit(False), "not included").when(matches_any(path, exclude), "excluded").when(F.col("length") == 0, "empty").when(binary, "binary")
    listed = raw.withColumn("relative_path", rel).withColumn("skip_reason", reason)
    return listed.select("relative_path", F.col("length").alias("size"), "content", F.when(F.col("skip_reason").isNull(), decoded(F.col("content"))).alias("text"), "skip_reason")


def in_path_order(listed: DataFrame) -> DataFrame:
    """Files by the parts of their paths."""
    return listed.orderBy(F.split("relative_path", "/"))


def skip_notes(listed: DataFrame) -> DataFrame:
    """note: a line for each file that was left out."""
    return listed.where("skip_reason IS NOT NULL").select(F.concat("skip_reason", F.lit(": "), "relative_path").alias("note"))


ENTRIES = "schema_version string, {0} array<struct<{1}>>"
TARGET = "target: struct<rule_id: string, path: string, start_line: int>, reason: string, author: string, created_at: string, expires_at: string, scope: string"


def baseline(spark: SparkSession, path: str) -> DataFrame:
    one = "rule_id: string, path: string, start_line: int, fingerprint: string, reason: string, created_at: string"
    return spark.read.schema(ENTRIES.format("entries", one)).option("multiLine", True).option("mode", "FAILFAST").json(path).selectExpr("posexplode(entries) AS (seq, e)").select("seq", "e.*")


def checked(entries: DataFrame, **tests: Column) -> DataFrame:
    """entries; reading one that fails a test raises, with the test's name."""
    out = entries
    for name, holds in tests.items():
        out = out.withColumn("reason", F.when(F.coalesce(holds, F.lit(False)), F.col("reason")).otherwise(F.raise_error(F.concat(F.lit(f"entry {name}: "), F.to_json(F.struct(*entries.columns))))))
    return out


def _dated(column: str) -> Column:
    return F.col(column).isNull() | F.try_to_timestamp(F.col(column)).isNotNull()


def suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Entries need a reason, a target, a known review status (default: approved) and times that can be read."""
    one = TARGET + ", review_status: string, reviewed_by: string, reviewed_at: string, review_note: string"
    rows = spark.read.schema(ENTRIES.format("suppressions", one)).option("multiLine", True).option("mode", "FAILFAST").json(path).selectExpr("posexplode(suppressions) AS (seq, e)").select("seq", "e.target.*", "e.*").drop("target")
    rows = rows.withColumn("review_status", F.coalesce("review_status", F.lit("approved")))
    return checked(rows, reason=F.trim("reason") != "", target=F.col("rule_id").isNotNull() & F.col("path").isNotNull() & F.col("start_line").isNotNull(), review_status=F.col("review_status").isin("pending", "approved", "rejected"), expires_at=_dated("expires_at"), reviewed_at=_dated("reviewed_at"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Entries need a reason, a target, a decision of active or suppressed, and times that can be read."""
    one = TARGET + ", decision: string"
    rows = spark.read.schema(ENTRIES.format("overrides", one)).option("multiLine", True).option("mode", "FAILFAST").json(path).selectExpr("posexplode(overrides) AS (seq, e)").select("seq", "e.target.*", "e.*").drop("target")
    return checked(rows, reason=F.trim("reason") != "", target=F.col("rule_id").isNotNull() & F.col("path").isNotNull() & F.col("start_line").isNotNull(), decision=F.col("decision").isin("active", "suppressed"), expires_at=_dated("expires_at"))
