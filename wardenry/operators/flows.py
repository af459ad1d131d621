"""Where a line's data comes from and what kind of code handles it, per framework: ordered cases over the line or its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markers import FAMILIES, Marked, first_of, has_any, marker_bits
from .detect import JVM, guard_model
from .scans import around
from .taint_flow import taint_metadata

# Fixed values: (kind, marker family), in the order in which they are tried.
SOURCES: dict[str, tuple[tuple[str, str], ...]] = {
    "express": (("query", "query"), ("body", "body"), ("cookies", "cookie"), ("route_param", "route_param"), ("headers", "headers")),
    "nextjs": (("search_params", "query"), ("cookies", "cookie"), ("headers", "headers"), ("body", "body")),
    "django": (("query", "query"), ("body", "body"), ("cookies", "cookie"), ("headers", "headers"), ("auth_context", "auth_context")),
    "spring": (
        ("query", "spring_request_param"), ("query", "query"), ("path", "spring_path_variable"), ("body", "body"), ("cookies", "cookie"), ("cookies", "spring_cookie"), ("headers", "spring_header"),
        ("headers", "headers"), ("query", "spring_get_parameter"), ("headers", "spring_get_header"), ("body", "spring_reader"), ("auth_context", "auth_context"),
    ),
}
HANDLERS = (("controller_method", "spring_controller"), ("repository_method", "spring_repository"), ("servlet_method", "spring_servlet"))
ENTRIES = (("servlet", "spring_servlet"), ("controller", "spring_controller"), ("repository", "spring_repository"))
PROCESSES = (("shell", "process_shell"), ("spawn", "process_spawn"), ("process_object", "process_object"))
ORMS = (("django_orm", "orm_django"), ("sqlalchemy", "orm_sqlalchemy"))
FILE_OPERATIONS = (("open", "file_open"), ("send", "file_send"), ("copy_or_move", "file_copy"))
LANGUAGES = {"express": ("javascript", "typescript"), "nextjs": ("javascript", "typescript"), "django": ("python",), "spring": ("java", "kotlin")}


def line_flows(lines: DataFrame, framework: str) -> DataFrame:
    """file_id, line_no, source_kind of the lines of a framework's language that name a source."""
    own = lines.where(F.col("language").isin(*LANGUAGES[framework]))
    return own.select("file_id", "line_no", first_of(F.col("line"), SOURCES[framework]).alias("source_kind")).where("source_kind IS NOT NULL")


def spring_flows(lines: DataFrame) -> DataFrame:
    """The same for Spring, told by a line and the five before it, with the kinds of handler and entry."""
    near = around(lines.where(F.col("language").isin(*JVM)), 5, 0)
    kinds = [first_of(F.col("context"), c).alias(n) for n, c in (("source_kind", SOURCES["spring"]), ("handler_kind", HANDLERS), ("entry_kind", ENTRIES))]
    return near.select("file_id", "line_no", *kinds).where("coalesce(source_kind, handler_kind, entry_kind) IS NOT NULL")


def process_kinds(hits: DataFrame) -> DataFrame:
    """file_id, line_no, process_kind of lines that start a process."""
    return hits.select("file_id", "line_no", first_of(F.col("line"), PROCESSES, "shell_command").alias("process_kind"))


def orm_kinds(hits: DataFrame) -> DataFrame:
    """file_id, line_no, orm_model, query_kind (raw_sql or null) of ORM findings; told by the line alone."""
    return hits.select("file_id", "line_no", first_of(F.col("line"), ORMS, "generic_orm").alias("orm_model"), first_of(F.col("line"), (("raw_sql", "orm_raw"),)).alias("query_kind"))


def file_operations(hits: DataFrame) -> DataFrame:
    """file_id, line_no, file_operation (or null) of file findings."""
    return hits.select("file_id", "line_no", first_of(F.col("line"), FILE_OPERATIONS).alias("file_operation"))


# What detectors call their sinks, and how deserialisation is told: by the line, then by what is near it.
SINKS = {
    "python_sqli": "sql_execution", "ssrf": "network_request", "path_traversal": "filesystem", "open_redirect": "redirect", "js_xss": "dom_write", "php_process": "process_execution", "php_ssrf": "network_request", "php_redirect": "redirect",
    "php_path": "filesystem", "php_file": "file_access", "blade_template": "template_render", "spring_deserial": "deserialization", "spring_sql": "sql_query", "spring_ssrf": "network_request", "spring_redirect": "redirect", "spring_path": "filesystem",
    "spring_file": "file_access",
}
DESERIAL_LINE = (("java_serialization", r"(?s)^(?=.*objectinputstream).*(?:readobject\(|readunshared\()"), ("object_mapper", r"(?s)^(?=.*objectmapper).*readvalue\("), ("gson", r"(?s)^(?=.*gson).*fromjson\("), ("yaml", r"(?s)^(?=.*yaml).*load\("), ("redis_json", r"(?s)^(?=.*jackson2jsonredisserializer).*deserialize\("))
DESERIAL_NEAR = (("object_mapper", "deserial_object_mapper"), ("gson", "deserial_gson"), ("java_serialization", "deserial_java"), ("yaml", "deserial_yaml"), ("redis_json", "deserial_redis"))
LARAVEL_SOURCES = (("query", "query"), ("request_input", "request_input"), ("cookies", "cookie"), ("headers", "headers"), ("auth_context", "auth_context"))
LARAVEL_ENTRIES = (("route_definition", "laravel_route"), ("controller_method", "laravel_controller"))
TEMPLATES = {"django": ("django", "django"), "flask": ("flask", "jinja2"), "nextjs": ("nextjs", "react"), "react": ("react", "react")}

Entries = dict[str, Column]


def first_marker(text: Column, family: str, strip: str) -> Column:
    """The first marker of the family, in the family's order, that the text has, without the given characters at its ends."""
    out, low = F.lit(None).cast("string"), F.lower(text.text if isinstance(text, Marked) else text)
    for marker in reversed(FAMILIES[family]):
        out = F.when(low.contains(marker), marker.strip(strip)).otherwise(out)
    return out


def _where(holds: Column, entries: Entries) -> Entries:
    return {k: F.when(holds, v) for k, v in entries.items()}


def _either(*several: Entries) -> Entries:
    """Entries of several, the last that has a key wins."""
    out: Entries = {}
    for own in several:
        for k, v in own.items():
            out[k] = F.coalesce(v, out[k]) if k in out else v
    return out


def request_flow(model: str, framework: Column, line: Column, sink: str, handlers: str | None = None) -> Entries:
    """Express, Next.js and Django: what a line of such a file says of its flow."""
    own = {"framework_model": F.lit(model), "flow_model": F.lit("request_to_sink"), "source_kind": first_of(line, SOURCES[model]), "sink_kind": F.lit(sink)}
    if handlers:
        own["handler_kind"] = F.when(has_any(line, handlers), "route_handler")
    return _where(framework.eqNullSafe(model), own)


def orm_flow(framework: Column, line: Column) -> Entries:
    django = framework.eqNullSafe("django") | has_any(line, "orm_django")
    alchemy = F.coalesce(framework.isin("flask", "fastapi"), F.lit(False)) | has_any(line, "orm_sqlalchemy")
    return {
        "flow_model": F.lit("user_input_to_orm_query"), "sink_kind": F.lit("orm_query"), "framework_model": F.when(django, "django").otherwise(F.coalesce(framework, F.lit("python"))),
        "orm_model": F.when(django, "django_orm").when(alchemy, "sqlalchemy").otherwise("generic_orm"), "source_kind": F.when(has_any(line, "orm_input"), "request_input"), "query_kind": F.when(has_any(line, "orm_raw"), "raw_sql"),
    }


def file_flow(framework: Column, line: Column) -> Entries:
    return {
        "flow_model": F.lit("request_input_to_file_sink"), "sink_kind": F.lit("file_access"), "framework_model": F.coalesce(framework, F.lit("python")),
        "source_kind": F.when(has_any(line, "file_input"), "request_input"), "file_operation": first_of(line, FILE_OPERATIONS),
    }


def spring_flow(framework: Column, near: Column, sink: str) -> Entries:
    """near: the line and the five before it."""
    own = {
        "framework_model": F.lit("spring"), "flow_model": F.lit("request_to_sink"), "sink_kind": F.lit(sink), "source_kind": first_of(near, SOURCES["spring"]), "entry_kind": first_of(near, ENTRIES), "handler_kind": first_of(near, HANDLERS),
        "mapping_kind": first_marker(near, "spring_mapping", "@"), "spring_parameter": first_marker(near, "spring_parameter", "@"),
    }
    return _where(framework.eqNullSafe("spring") | has_any(near, "spring_framework"), own)


def deserial_flow(own: Entries, line: Column, near: Column) -> Entries:
    """own: the Spring flow."""
    kind = first_of(near, DESERIAL_NEAR, "generic")
    for name, pattern in reversed(DESERIAL_LINE):
        kind = F.when(F.lower(line.text if isinstance(line, Marked) else line).rlike(pattern), name).otherwise(kind)
    return own | {"deserialization_kind": F.when(own["framework_model"].isNotNull(), kind)}


def laravel_flow(framework: Column, near: Column, sink: str) -> Entries:
    """near: the line, the five before it and the one after."""
    own = {
        "framework_model": F.lit("laravel"), "flow_model": F.lit("request_to_sink"), "sink_kind": F.lit(sink), "source_kind": first_of(near, LARAVEL_SOURCES), "entry_kind": first_of(near, LARAVEL_ENTRIES),
        "route_kind": F.nullif(F.regexp_extract(F.coalesce(first_marker(near, "laravel_route", "("), F.lit("")), "::(.*)", 1), F.lit("")),
    }
    return _where(framework.eqNullSafe("laravel") | has_any(near, "laravel_framework"), own)


def process_flow(own: Entries, line: Column) -> Entries:
    """own: the Laravel flow."""
    return own | {"process_kind": F.when(own["framework_model"].isNotNull(), first_of(line, PROCESSES, "shell_command"))}


def blade_flow(own: Entries, near: Column) -> Entries:
    """own: the Laravel flow."""
    sink = first_of(near, (("blade_render", "blade_string"), ("view", "blade_view")), "render")
    kind = first_of(near, (("string_template", "blade_string"), ("view_template", "blade_view")), "template")
    return own | _where(own["framework_model"].isNotNull(), {"flow_model": F.lit("context_to_template_sink"), "template_model": F.lit("blade"), "template_sink": sink, "template_kind": kind})


def template_flow(framework: Column, language: Column, line: Column) -> Entries:
    model, kind = F.lit(None).cast("string"), F.lit("generic")
    for name, (own, templates) in TEMPLATES.items():
        model, kind = F.when(framework.eqNullSafe(name), own).otherwise(model), F.when(framework.eqNullSafe(name), templates).otherwise(kind)
    entries = {"framework_model": model, "template_model": kind, "flow_model": F.lit("context_to_template_sink"), "sink_kind": F.lit("template_render"), "template_sink": F.when(has_any(line, "template_render"), "render")}
    return _where(language.isin("python", "javascript", "typescript"), entries)


def react_flow(framework: Column, line: Column) -> Entries:
    own = {
        "framework_model": F.lit("react"), "flow_model": F.lit("prop_to_dom_sink"), "sink_kind": F.lit("dom_sink"), "dom_sink": F.when(has_any(line, "js_xss"), "innerhtml"), "react_sink": F.when(has_any(line, "react_html"), "dangerouslySetInnerHTML"),
        "react_lifecycle": F.when(has_any(line, "react_hook"), "hook"),
    }
    return _where(framework.eqNullSafe("react"), own)


def guard_flow(line: Column, language: Column) -> Entries:
    """What a guard line is; a script's middleware is called that and no more."""
    model, yes = guard_model(line), F.lit("true")
    mounted = language.isin("javascript", "typescript", "json") & has_any(line, "js_middleware")
    role, middle = model == "role_check", model == "middleware"
    return {
        "auth_guard": yes, "auth_guard_kind": F.when(~mounted, F.when(role, "role_check").otherwise("auth_check")), "middleware_kind": F.when(middle | mounted, "auth"),
        "auth_model": F.when(mounted, "middleware").when((model != "guard") | language.isin("python", "javascript", "typescript"), model),
        "guard_kind": F.when(~mounted, F.when(role, "role_check").when(model.isin("decorator", "predicate"), "auth_check")), "role_model": F.when(~mounted & role & has_any(line, "rbac"), "rbac"),
    }


def entries_of() -> dict[tuple[str, ...], Entries]:
    """The metadata of detectors that share its form, over columns line, language, framework, near_5_0 and near_5_1 (the lower-case lines around) and the bits of each. A sink's kind comes from the detector."""
    language, framework, detector = F.col("language"), F.col("framework"), F.col("detector")
    line, before, around = (Marked(F.col(c), F.col(b)) for c, b in (("line", "bits"), ("near_5_0", "bits_5_0"), ("near_5_1", "bits_5_1")))
    sink = F.try_element_at(F.create_map(*(F.lit(x) for pair in SINKS.items() for x in pair)), detector)
    django, express, nextjs = (request_flow(m, framework, line, "", h) for m, h in (("django", None), ("express", "express_handler"), ("nextjs", "nextjs_handler")))
    requests = _either(_where(language == "python", django), *(_where(language != "python", x) for x in (express, nextjs)))
    to = lambda own: own | {"sink_kind": F.when(own["framework_model"].isNotNull(), sink)}
    spring, laravel = to(spring_flow(framework, before, "")), to(laravel_flow(framework, around, ""))
    return {
        ("auth_missing",): {"auth_guard": F.lit("false"), "auth_model": F.lit("route_without_middleware")}, ("auth_guard",): guard_flow(line, language), ("python_file",): file_flow(framework, line), ("python_orm",): orm_flow(framework, line),
        ("python_template", "js_template"): template_flow(framework, language, line), ("js_xss",): _either(to(_either(express, nextjs)), react_flow(framework, line)), ("python_sqli", "ssrf", "path_traversal", "open_redirect"): to(requests),
        ("php_ssrf", "php_redirect", "php_path", "php_file"): laravel, ("php_process",): process_flow(laravel, line), ("blade_template",): blade_flow(laravel, around),
        ("spring_sql", "spring_ssrf", "spring_redirect", "spring_path", "spring_file"): spring, ("spring_deserial",): deserial_flow(spring, line, before),
    }


def metadata() -> Column:
    """A finding's metadata as a map, by its detector. What its line's taint says fills the gaps, and names the source where the line itself doesn't."""
    taint, out = taint_metadata(), F.lit(None).cast("map<string,string>")
    none = F.create_map().cast("map<string,string>")
    for detectors, entries in entries_of().items():
        listed = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items()))
        own = F.map_from_entries(F.filter(listed, lambda e: e["value"].isNotNull()))
        if detectors[0] not in ("auth_missing", "auth_guard", "spring_deserial"):
            known = entries.get("source_kind", F.lit(None))
            source = F.when(known.isNull() & F.col("taint").isNotNull(), F.create_map(F.lit("source_kind"), F.col("taint.source_kind"))).otherwise(none)
            own = F.map_concat(own, taint, source)
        out = F.when(F.col("detector").isin(*detectors), own).otherwise(out)
    return out


def with_context(lines: DataFrame) -> DataFrame:
    """lines with near_5_0 and near_5_1, the lower-case lines around each that Spring's and Laravel's flows are told by, and which marker families each has (bits, bits_5_0, bits_5_1): found once a line; no marker spans lines, so those around are the union."""
    marked = lines.withColumn("bits", marker_bits(F.col("line")))
    return around(around(marked, 5, 0, "bits").withColumnsRenamed({"context": "near_5_0", "context_bits": "bits_5_0"}), 5, 1, "bits").withColumnsRenamed({"context": "near_5_1", "context_bits": "bits_5_1"})
