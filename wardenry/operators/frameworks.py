"""Framework, confidence and signal of a file by its language, path and content: an ordered table of rules, as columns or SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages, framework, confidence, signal, pattern of the lower-case content, pattern of the lower-case path; "" matches all.
_JS = ("javascript", "typescript")
_JVM = ("java", "kotlin")
_LARAVEL_PATH = "routes/web[.]php|routes/api[.]php|app/http/controllers|app/http/middleware|app/http/requests"
RULES: tuple[tuple[tuple[str, ...], str, str, str, str, str], ...] = (
    (("python",), "django", "high", "python:django", "django", ""),
    (("python",), "django", "high", "python:django", "", "manage[.]py|settings[.]py|urls[.]py|wsgi[.]py|asgi[.]py"),
    (("python",), "flask", "high", "python:flask", "from flask import|import flask", ""),
    (("python",), "fastapi", "high", "python:fastapi", "fastapi", ""),
    (_JS, "react-native", "high", "js:react-native", "react-native", ""),
    (_JS, "react-native", "high", "js:react-native", "", "react-native"),
    (_JS, "nextjs", "high", "js:nextjs-import", "next/server|next/navigation|next/router|next/headers", ""),
    (_JS, "nextjs", "medium", "js:nextjs", "next", "next|package[.]json|app/|pages/"),
    (_JS, "express", "high", "js:express", "express", ""),
    (_JS, "react", "medium", "js:react", "react", ""),
    (_JVM, "android", "high", "java:android", "sharedpreferences|androidx[.]|import android[.]|appcompatactivity|fragmentactivity|android[.]os[.]|android[.]app[.]|android[.]view[.]|android[.]widget[.]", ""),
    (_JVM, "spring", "high", "java:spring-controller", "org[.]springframework|@restcontroller|@controller|@requestmapping|@getmapping", ""),
    (_JVM, "spring", "medium", "java:spring-request", "@postmapping|@putmapping|@deletemapping|@patchmapping|requestparam|pathvariable|requestbody|requestheader", ""),
    (_JVM, "spring", "low", "java:spring-path", "", "src/main/java|src/main/kotlin"),
    (("php",), "laravel", "high", "php:laravel", r"route::|illuminate\\|laravel", ""),
    (("php",), "laravel", "medium", "php:laravel-path", "", _LARAVEL_PATH),
    (("toml",), "django", "medium", "toml:django", "django", ""),
    (("toml",), "flask", "medium", "toml:flask", "flask", ""),
    (("toml",), "fastapi", "medium", "toml:fastapi", "fastapi", ""),
    (("toml",), "django", "low", "toml:path-django", "", "django.*pyproject[.]toml$"),
    (("xml",), "android", "high", "xml:android", "android:", ""),
    (("xml",), "android", "high", "xml:android", "", "androidmanifest[.]xml"),
    (("xml",), "ios", "high", "xml:ios", "nsapptransportsecurity", ""),
    (("xml",), "ios", "high", "xml:ios", "", "info[.]plist$"),
)
#: Packages that a package.json tells its framework by: name, framework, confidence.
PACKAGES = (("react-native", "react-native", "high"), ("next", "nextjs", "high"), ("express", "express", "high"), ("react", "react", "medium"))
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
#: Without a framework, files of these languages are known with medium confidence, others with low.
KNOWN = ("python", "javascript", "typescript", "json", "toml", "xml")


def framework(language: Column, path: Column, content: Column) -> Column:
    """struct<framework, confidence, signal> of the first rule that holds; without any, no framework and no signal. Null content counts as empty."""
    low, where = F.lower(F.coalesce(content, F.lit(""))), F.lower(path)
    rules = F.struct(F.lit(None).cast("string").alias("framework"), F.when(language.isin(*KNOWN), "medium").otherwise("low").alias("confidence"), F.lit(None).cast("string").alias("signal"))
    for languages, name, confidence, signal, inside, at in reversed(RULES):
        holds = language.isin(*languages) & (low.rlike(inside) if inside else F.lit(True)) & (where.rlike(at) if at else F.lit(True))
        rules = F.when(holds, F.struct(F.lit(name).alias("framework"), F.lit(confidence).alias("confidence"), F.lit(signal).alias("signal"))).otherwise(rules)
    told, names, package_file = F.struct, declared(content), (language == "json") & where.endswith("package.json")
    for name, of, confidence in reversed(PACKAGES):
        rules = F.when(package_file & F.array_contains(names, name), told(F.lit(of).alias("framework"), F.lit(confidence).alias("confidence"), F.lit(f"package-json:{name}").alias("signal"))).otherwise(rules)
    broken = told(F.lit(None).cast("string").alias("framework"), F.lit("medium").alias("confidence"), F.lit("json:invalid-package-json").alias("signal"))
    return F.when(package_file & F.try_parse_json(F.coalesce(content, F.lit(""))).isNull(), broken).otherwise(rules)


def declared(content: Column) -> Column:
    """The lower-case names in a package file's own dependency sections; none of one that can't be read. A section that is no object has none."""
    value = F.try_parse_json(F.coalesce(content, F.lit("{}")))
    keys = lambda k: F.coalesce(F.map_keys(F.from_json(F.to_json(F.try_variant_get(value, f"$.{k}", "variant")), "map<string,string>")), F.array().cast("array<string>"))
    return F.transform(F.concat(*map(keys, SECTIONS)), F.lower)


def signals(language: Column, path: Column, content: Column) -> Column:
    """All that a file was told by: its language, then its framework."""
    return F.array_compact(F.array(F.when(language != "unknown", F.concat(F.lit("extension:"), language)), framework(language, path, content)["signal"]))


def framework_sql(what: str) -> str:
    """`what` (framework, confidence or signal) over language, path, content, for DuckDB."""
    k, out = {"framework": 1, "confidence": 2, "signal": 3}[what], "CASE"
    package_file = "language = 'json' AND ends_with(lower(path), 'package.json')"
    out += f" WHEN {package_file} AND NOT json_valid(coalesce(content, '')) THEN {dict(framework='NULL', confidence=chr(39) + 'medium' + chr(39), signal=chr(39) + 'json:invalid-package-json' + chr(39))[what]}"
    for name, of, confidence in PACKAGES:
        has = " OR ".join(f"list_contains(list_transform(json_keys(coalesce(try_cast(content AS JSON), '{{}}'), '$.{x}'), lambda y: lower(y)), '{name}')" for x in SECTIONS)
        out += f" WHEN {package_file} AND ({has}) THEN '{dict(framework=of, confidence=confidence, signal=f'package-json:{name}')[what]}'"
    for rule in RULES:
        tests = [f"language IN ({', '.join(map(repr, rule[0]))})"] + [f"regexp_matches(lower({c}), '{x}')" for c, x in (("coalesce(content, '')", rule[4]), ("path", rule[5])) if x]
        out += f" WHEN {' AND '.join(tests)} THEN '{rule[k]}'"
    rest = f" ELSE CASE WHEN language IN ({', '.join(map(repr, KNOWN))}) THEN 'medium' ELSE 'low' END" if what == "confidence" else ""
    return out + rest + " END"
