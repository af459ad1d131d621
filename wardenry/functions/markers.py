"""Marker families: lower-case substrings that name sources, sinks and guards in a line of code."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists as they are.
FAMILIES: dict[str, tuple[str, ...]] = {
    "cookie": (
        "req.cookies",
        "request.cookies",
        "request.cookie(",
        "request()->cookie(",
        "$request->cookie(",
        "cookies().get(",
        "cookies(",
        "request.getcookies(",
        "request.getcookie(",
        "request.cookie",
        "request.get_signed_cookie(",
        "@cookievalue",
        "cookievalue(",
        "getcookies(",
        "getcookie(",
    ),
    "body": (
        "req.body",
        "request.body",
        "request.form",
        "request.json",
        "request.get_json(",
        "request.get_data(",
        "request()->json(",
        "request()->post(",
        "request.getjson(",
        "request()->getjson(",
        "await request.json",
        "await req.json",
        "$request->json(",
        "$request->post(",
        "request.post",
        "@requestbody",
        "requestbody(",
        "getreader(",
        "getinputstream(",
    ),
    "query": (
        "req.query",
        "request.query",
        "request.args",
        "request.get(",
        "request.get_json(",
        "request.querystring",
        "request.params",
        "request()->query(",
        "$request->query(",
        "$request->get(",
        "$request->input(",
        "@requestparam",
        "getparameter(",
        "getquerystring(",
        "searchparams.get(",
    ),
    "headers": (
        "request.headers",
        "req.headers",
        "request.meta",
        "request.header(",
        "request()->header(",
        "$request->header(",
        "@requestheader",
        "getheader(",
    ),
    "auth_context": (
        "request.user",
        "req.user",
        "request.auth",
        "request.authentication",
        "authentication",
        "principal",
        "securitycontextholder",
        "auth()->user(",
        "auth::user(",
        "auth.user(",
        "current_user",
    ),
    "auth_guard": (
        "login_required",
        "permission_required",
        "auth_required",
        "requires_auth",
        "ensureauthenticated",
        "is_authenticated",
        "auth()->check(",
        "auth::check(",
        "requireauth",
        "authenticate",
        "authmiddleware",
        "middlewareauth",
        "withauth",
        "useauth(",
    ),
    "role_guard": (
        "hasrole(",
        "hasroles(",
        "haspermission(",
        "haspermissions(",
        "hasanyrole(",
        "hasanyroles(",
        "can(",
        "authorize(",
        "is_admin",
        "isadministrator",
        "checkrole(",
        "checkpermission(",
        "gate::allows(",
        "gate::denies(",
        "gate::allowsany(",
        "user.has_role(",
        "user.has_roles(",
        "user.has_permission(",
        "user.has_permissions(",
        "roles.includes(",
        "role.includes(",
        "permissions.includes(",
    ),
    "request_input": (
        "$request->input(",
        "request()->input(",
        "$request->all(",
        "$request->post(",
        "$request->json(",
        "request('",
        "request.input(",
    ),
    "dummy_secret": (
        "changeme",
        "dummy",
        "example",
        "fake",
        "placeholder",
        "test",
        "your_api_key",
        "your_secret",
        "your_token",
    ),
    "sql_verb": (
        "select ",
        "insert ",
        "update ",
        "delete ",
    ),
    "sql_call": (
        "execute(",
        "query(",
    ),
    "orm_sink": (
        ".raw(",
        ".executemany(",
        ".from_statement(",
        "session.execute(",
        "db.session.execute(",
        "engine.execute(",
        "connection.execute(",
        "cursor.execute(",
        "objects.raw(",
        "objects.extra(",
        "query.from_statement(",
        "text(",
    ),
    "orm_source": (
        "request.args",
        "request.form",
        "request.values",
        "request.json",
        "request.get_json",
        "request.get",
        "request.post",
        "request.cookies",
        "request.meta",
        "req.query",
        "req.body",
        "user_input",
        "sql",
    ),
    "ssrf_sink": (
        "requests.get(",
        "requests.post(",
        "requests.put(",
        "requests.delete(",
        "httpx.get(",
        "httpx.post(",
        "urllib.request.urlopen(",
        "session.get(",
        "session.post(",
        "fetch(",
        "axios.get(",
        "axios.post(",
    ),
    "ssrf_source": (
        "request.args",
        "request.form",
        "request.values",
        "request.get",
        "request.query",
        "request.post",
        "request.cookies",
        "request.meta",
        "req.cookies",
        "cookies().get",
        "req.query",
        "req.body",
        "user_input",
        "url",
        "uri",
        "next_url",
    ),
    "path_sink": (
        "open(",
        "read_text(",
        "read_bytes(",
        "os.open(",
        "pathlib.path(",
        "path.join(",
        "fs.readfile(",
        "fs.readfilesync(",
        "createreadstream(",
        "send_file(",
    ),
    "path_source": (
        "..",
        "request.args",
        "request.form",
        "request.values",
        "request.get",
        "request.post",
        "request.cookies",
        "request.meta",
        "req.cookies",
        "req.query",
        "req.body",
        "user_input",
        "filename",
        "path",
    ),
    "file_sink": (
        "open(",
        "read_text(",
        "read_bytes(",
        "os.open(",
        "pathlib.path(",
        "send_file(",
        "send_from_directory(",
        "file_response(",
        "fileresponse(",
        "shutil.copy(",
        "shutil.copyfile(",
        "shutil.move(",
    ),
    "file_source": (
        "request.args",
        "request.form",
        "request.values",
        "request.get",
        "request.post",
        "request.cookies",
        "request.meta",
        "req.cookies",
        "req.query",
        "req.body",
        "user_input",
        "filename",
        "path",
        "file",
    ),
    "redirect_sink": (
        "redirect(",
        "httpresponseredirect(",
        "res.redirect(",
        "response.redirect(",
    ),
    "redirect_source": (
        "request.args.get(\"next\")",
        "request.args.get('next')",
        "request.get.get(\"next\")",
        "request.get.get('next')",
        "request.get.get(\"redirect\")",
        "request.get.get('redirect')",
        "request.post.get(\"next\")",
        "request.post.get('next')",
        "request.post.get(\"redirect\")",
        "request.post.get('redirect')",
        "request.cookies.get(\"next\")",
        "request.cookies.get('next')",
        "request.cookies.get(\"redirect\")",
        "request.cookies.get('redirect')",
        "request.user",
        "req.user",
        "authentication",
        "principal",
        "auth()->user(",
        "auth::user(",
        "req.query.next",
        "req.body.next",
        "req.cookies.next",
        "req.cookies.redirect",
        "next_url",
        "redirect_url",
        "url",
        "request.get.get(\"uri\")",
        "request.get.get('uri')",
    ),
    "python_template": (
        "render_template(",
        "render_to_string(",
        "get_template(",
        "template.render(",
        "jinja2.template",
        "template(",
    ),
    "js_template": (
        "render(",
        "res.render(",
        "response.render(",
        "template.render(",
        "render_to_string(",
        "dangerouslysetinnerhtml",
    ),
    "js_xss": (
        "dangerouslysetinnerhtml",
        "innerhtml",
        "document.write",
    ),
    "php_ssrf": (
        "http::get(",
        "http::post(",
        "http::put(",
        "http::delete(",
        "guzzlehttp\\client(",
        "client->get(",
        "client->post(",
        "client->request(",
        "file_get_contents(",
        "curl_exec(",
    ),
    "php_redirect": (
        "redirect(",
        "redirect()->to(",
        "redirect()->away(",
        "response()->redirectto(",
    ),
    "php_path": (
        "file_get_contents(",
        "storage::get(",
        "storage::download(",
        "storage::put(",
        "readfile(",
        "fopen(",
        "fread(",
        "scandir(",
        "glob(",
    ),
    "php_file": (
        "storage::get(",
        "storage::download(",
        "storage::put(",
        "storage::delete(",
        "file_get_contents(",
        "readfile(",
        "fopen(",
        "fread(",
    ),
    "php_process": (
        "shell_exec(",
        "exec(",
        "system(",
        "passthru(",
        "proc_open(",
        "popen(",
        "pcntl_exec(",
        "symfony\\component\\process\\process(",
        "process->",
        "``",
    ),
    "blade_sink": (
        "view(",
        "view()->make(",
        "view::make(",
        "response()->view(",
        "blade::render(",
        "blade::compilestring(",
    ),
    "blade_source": (
        "request->input(",
        "request()->input(",
        "request->query(",
        "request()->query(",
        "request->all(",
        "request->post(",
        "request()->post(",
        "request('",
        "$request->header(",
        "$request->cookie(",
        "auth()->",
        "user_input",
    ),
    "spring_ssrf": (
        "resttemplate.getforobject(",
        "resttemplate.exchange(",
        "webclient.get(",
        "webclient.post(",
        "webclient.uri(",
        "okhttpclient.newcall(",
        "httpclient.execute(",
        "urlconnection.openconnection(",
    ),
    "spring_redirect": (
        "return \"redirect:",
        "return 'redirect:",
        "redirectview.seturl(",
        "modelandview.setviewname(\"redirect:",
        "modelandview.setviewname('redirect:",
        "sendredirect(",
    ),
    "spring_path": (
        "files.readstring(",
        "files.readallbytes(",
        "files.newinputstream(",
        "fileinputstream(",
        "fileresource(",
        "servletcontext.getresourceasstream(",
    ),
    "spring_file": (
        "files.copy(",
        "files.delete(",
        "files.move(",
        "files.newoutputstream(",
        "fileoutputstream(",
        "fileresource(",
        "resource.getinputstream(",
    ),
    "spring_sql": (
        "jdbctemplate.query(",
        "jdbctemplate.update(",
        "jdbctemplate.execute(",
        "namedparameterjdbctemplate.query(",
        "namedparameterjdbctemplate.update(",
        "entitymanager.createquery(",
        "entitymanager.createnativequery(",
        "session.createquery(",
        "session.createnativequery(",
        "connection.preparestatement(",
        "statement.executequery(",
        "statement.executeupdate(",
        "statement.execute(",
        "dslcontext.fetch(",
        "dslcontext.execute(",
    ),
    "spring_deserial": (
        "gson.fromjson(",
        "xmlmapper.readvalue(",
        "jsonmapper.readvalue(",
        "new objectinputstream(",
        "serializationutils.deserialize(",
        "kryo.readobject(",
        "kryo.readclassandobject(",
        "yaml.load(",
        "yaml().load(",
        "snakeyaml.load(",
        "snakeyaml.loadas(",
    ),
    "missing_auth_route": (
        "@app.route",
        "@bp.route",
        "@blueprint.route",
        "app.get(",
        "app.post(",
        "router.get(",
        "router.post(",
    ),
    "missing_auth_request": (
        "request.args",
        "request.form",
        "request.values",
        "request.json",
        "request.get_json",
        "request.user",
        "req.query",
        "req.body",
        "req.user",
    ),
    "orm_django": (
        "django.db",
        "objects.raw(",
        "objects.extra(",
        "connection.cursor(",
        "cursor.execute(",
        "from django",
    ),
    "orm_sqlalchemy": (
        "sqlalchemy",
        "session.execute(",
        "db.session.execute(",
        "engine.execute(",
        "connection.execute(",
        "text(",
    ),
    "orm_raw": (
        "objects.raw(",
        ".raw(",
        "text(",
        "execute(",
        "executemany(",
        "from_statement(",
    ),
    "file_open": (
        "open(",
        "os.open(",
        "read_text(",
        "read_bytes(",
        "file_response(",
        "fileresponse(",
    ),
    "file_send": (
        "send_file(",
        "send_from_directory(",
    ),
    "file_copy": (
        "copy(",
        "copyfile(",
        "move(",
    ),
    "route_param": (
        "req.params",
        "request.params",
    ),
    "spring_request_param": (
        "@requestparam",
        "requestparam(",
    ),
    "spring_path_variable": (
        "@pathvariable",
        "pathvariable(",
    ),
    "spring_cookie": (
        "@cookievalue",
        "getcookies(",
        "getcookie(",
    ),
    "spring_header": (
        "@requestheader",
        "requestheader(",
    ),
    "spring_get_parameter": (
        "getparameter(",
        "getparameterstring(",
        "getparameternames(",
    ),
    "spring_get_header": (
        "getheader(",
    ),
    "spring_reader": (
        "getreader(",
        "getinputstream(",
    ),
    "spring_controller": (
        "@restcontroller",
        "@controller",
        "@requestmapping",
        "@getmapping",
        "@postmapping",
        "@putmapping",
        "@deletemapping",
        "@patchmapping",
    ),
    "spring_repository": (
        "@repository",
        "jdbctemplate",
        "entitymanager",
        "springdata",
        "jpacrepository",
    ),
    "spring_servlet": (
        "@webservlet",
        "extends httpservlet",
        "doget(",
        "dopost(",
        "doput(",
        "dodelete(",
        "service(",
    ),
    "process_shell": (
        "shell_exec(",
        "exec(",
        "system(",
        "passthru(",
        "pcntl_exec(",
    ),
    "process_spawn": (
        "proc_open(",
        "popen(",
    ),
    "process_object": (
        "symfony\\component\\process\\process",
        "process->",
    ),
    "prefs": (
        "sharedpreferences",
        "getsharedpreferences(",
        "android.content.sharedpreferences",
    ),
    "prefs_key": (
        "token",
        "secret",
        "password",
        "passwd",
        "passphrase",
        "api_key",
        "apikey",
        "auth",
        "session",
        "jwt",
        "credential",
        "refresh",
    ),
    "auth_middleware": (
        "app.use(",
        "router.use(",
        "appmiddleware",
        "routermiddleware",
        "authmiddleware",
        "middlewareauth",
        "withauth",
        "useauth(",
        "requireauth(",
    ),
    "auth_decorator": (
        "login_required",
        "permission_required",
    ),
    "auth_predicate": (
        "is_authenticated",
        "auth()->check(",
        "auth::check(",
    ),
    "rbac": (
        "hasrole(",
        "hasroles(",
        "haspermission(",
        "haspermissions(",
        "hasanyrole(",
        "hasanyroles(",
        "can(",
        "authorize(",
        "gate::allows(",
        "gate::denies(",
        "gate::allowsany(",
    ),
    "js_middleware": (
        "app.use(requireauth",
        "router.use(requireauth",
        "app.use(authmiddleware",
        "router.use(authmiddleware",
        "app.use(withauth",
        "router.use(withauth",
        "useauth(",
        "withauth(",
        "requireauth(",
        "authmiddleware(",
        "middlewareauth(",
    ),
    "express_handler": (
        "app.get(",
        "app.post(",
        "router.get(",
        "router.post(",
        "app.use(",
        "router.use(",
    ),
    "nextjs_handler": (
        "nextresponse.redirect(",
        "nextresponse.rewrite(",
        "nextresponse.json(",
        "redirect(",
    ),
    "orm_input": (
        "request.args",
        "request.form",
        "request.values",
        "request.json",
        "request.get_json",
        "request.get",
        "request.post",
        "request.cookies",
        "request.meta",
        "req.query",
        "req.body",
        "user_input",
    ),
    "file_input": (
        "request.args",
        "request.form",
        "request.values",
        "request.json",
        "request.get_json",
        "request.get",
        "request.post",
        "request.cookies",
        "request.meta",
        "req.query",
        "req.body",
        "user_input",
        "filename",
        "path",
        "file",
    ),
    "spring_mapping": (
        "@getmapping",
        "@postmapping",
        "@putmapping",
        "@deletemapping",
        "@patchmapping",
        "@requestmapping",
    ),
    "spring_parameter": (
        "@requestparam",
        "@pathvariable",
        "@requestbody",
        "@requestheader",
    ),
    "spring_framework": (
        "@restcontroller",
        "@controller",
        "@requestmapping",
        "@getmapping",
        "@postmapping",
        "@putmapping",
        "@deletemapping",
        "@patchmapping",
        "org.springframework",
    ),
    "deserial_object_mapper": (
        "objectmapper.readvalue(",
        "objectmapper().readvalue(",
        "new objectmapper().readvalue(",
        "jsonmapper.readvalue(",
        "xmlmapper.readvalue(",
    ),
    "deserial_gson": (
        "gson.fromjson(",
        "gson().fromjson(",
    ),
    "deserial_java": (
        "objectinputstream.readobject(",
        "objectinputstream().readobject(",
        "new objectinputstream().readobject(",
        "new objectinputstream(",
        "objectinputstream.readunshared(",
        "objectinputstream().readunshared(",
        "serializationutils.deserialize(",
        "serializationutils().deserialize(",
        "kryo.readobject(",
        "kryo().readobject(",
        "kryo.readclassandobject(",
        "kryo().readclassandobject(",
    ),
    "deserial_yaml": (
        "yaml.load(",
        "yaml().load(",
        "snakeyaml.load(",
        "snakeyaml().load(",
        "snakeyaml.loadas(",
        "snakeyaml().loadas(",
    ),
    "deserial_redis": (
        "jackson2jsonredisserializer.deserialize(",
        "jackson2jsonredisserializer().deserialize(",
    ),
    "laravel_route": (
        "route::get(",
        "route::post(",
        "route::put(",
        "route::delete(",
        "route::patch(",
        "route::any(",
        "route::match(",
    ),
    "laravel_framework": (
        "route::get(",
        "route::post(",
        "route::put(",
        "route::delete(",
        "route::patch(",
        "route::any(",
        "route::match(",
        "illuminate\\",
        "laravel",
    ),
    "laravel_controller": (
        "function (request ",
        "function(request ",
        "public function",
        "protected function",
        "private function",
    ),
    "blade_string": (
        "blade::render(",
    ),
    "blade_view": (
        "view()->make(",
        "view::make(",
        "response()->view(",
        "view(",
    ),
    "template_render": (
        "render_template(",
        "render_to_string(",
        "get_template(",
        "template.render(",
        "jinja2.template",
        "template(",
        "response.render(",
        "res.render(",
        "render(",
        "dangerouslysetinnerhtml",
    ),
    "react_html": (
        "dangerouslysetinnerhtml",
    ),
    "react_hook": (
        "useeffect(",
        "uselayouteffect(",
        "usememo(",
        "usecallback(",
    ),
    "container_start": (
        "list(",
        "dict(",
        "array(",
        "new array(",
        "new map(",
        "map(",
    ),
}


def alternation(family: str) -> str:
    """The family as one pattern, legal in Java and RE2."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", m) for m in FAMILIES[family])


#: Families in the order of their bits: 62 to a number.
NAMES = tuple(FAMILIES)
BITS = 62


class Marked(NamedTuple):
    """A text with the families that it has, as bit sets made once: arrays of numbers."""

    text: Column
    bits: Column


def _trie(markers: list[str]) -> str:
    """The longest of the markers, as one pattern that looks at each character once."""
    ends, after = "" in markers, {}
    for m in markers:
        if m:
            after.setdefault(m[0], []).append(m[1:])
    if not after:
        return ""
    parts = [re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", c) + _trie(own) for c, own in sorted(after.items())]
    one = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return f"{one}?" if ends else one


def marker_bits(line: Column) -> Column:
    """Which families a line has: at each place the longest marker that begins there stands for all that begin it."""
    markers = sorted({m for own in FAMILIES.values() for m in own})
    sets = {}
    for m in markers:
        held = [i for i, name in enumerate(NAMES) if any(m.startswith(x) for x in FAMILIES[name])]
        sets[m] = [sum(1 << (i % BITS) for i in held if i // BITS == k) for k in range(-(-len(NAMES) // BITS))]
    found = F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(f"(?=({_trie(markers)}))"), F.lit(1)))
    words = [F.create_map(*(F.lit(x) for m in markers if sets[m][k] for x in (m, sets[m][k]))) for k in range(-(-len(NAMES) // BITS))]
    union = lambda w: F.aggregate(found, F.lit(0).cast("long"), lambda n, m: n.bitwiseOR(F.coalesce(F.try_element_at(w, m), F.lit(0)).cast("long")))
    return F.array(*map(union, words))


def has_any(line: Column | Marked, family: str) -> Column:
    if isinstance(line, Marked):
        i = NAMES.index(family)
        return F.get(line.bits, F.lit(i // BITS)).bitwiseAND(F.lit(1 << (i % BITS)).cast("long")) != 0
    return F.lower(line).rlike(alternation(family))


def sql_has_any(line: str, family: str) -> str:
    """The same for DuckDB."""
    return f"regexp_matches(lower({line}), '{alternation(family).replace(chr(39), chr(39) * 2)}')"


def first_of(text: Column | Marked, cases: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    """The value of the first (value, family) whose family is met."""
    out = F.lit(default).cast("string")
    for value, family in reversed(cases):
        out = F.when(has_any(text, family), value).otherwise(out)
    return out


def sql_first_of(text: str, cases: tuple[tuple[str, str], ...], default: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {sql_has_any(text, f)} THEN '{v}'" for v, f in cases) + (f" ELSE '{default}'" if default else "") + " END"
