"""Android manifests: permissions and exported components as rows, from XML that Spark reads; entities are not expanded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Permissions that count as dangerous, where permissions are asked for, and components.
DANGEROUS = (
    "android.permission.READ_CALENDAR",
    "android.permission.WRITE_CALENDAR",
    "android.permission.CAMERA",
    "android.permission.READ_CONTACTS",
    "android.permission.WRITE_CONTACTS",
    "android.permission.GET_ACCOUNTS",
    "android.permission.ACCESS_FINE_LOCATION",
    "android.permission.ACCESS_COARSE_LOCATION",
    "android.permission.RECORD_AUDIO",
    "android.permission.READ_PHONE_STATE",
    "android.permission.CALL_PHONE",
    "android.permission.READ_CALL_LOG",
    "android.permission.WRITE_CALL_LOG",
    "android.permission.ADD_VOICEMAIL",
    "android.permission.USE_SIP",
    "android.permission.PROCESS_OUTGOING_CALLS",
    "android.permission.BODY_SENSORS",
    "android.permission.BODY_SENSORS_BACKGROUND",
    "android.permission.SEND_SMS",
    "android.permission.RECEIVE_SMS",
    "android.permission.READ_SMS",
    "android.permission.RECEIVE_WAP_PUSH",
    "android.permission.RECEIVE_MMS",
    "android.permission.READ_EXTERNAL_STORAGE",
    "android.permission.WRITE_EXTERNAL_STORAGE",
    "android.permission.MANAGE_EXTERNAL_STORAGE",
    "android.permission.POST_NOTIFICATIONS",
    "android.permission.NEARBY_WIFI_DEVICES",
    "android.permission.BLUETOOTH_SCAN",
    "android.permission.BLUETOOTH_CONNECT",
    "android.permission.BLUETOOTH_ADVERTISE",
)
ASKED = ("uses-permission", "uses-permission-sdk-23", "uses-permission-sdk-m")
KINDS = ("activity", "activity-alias", "receiver", "service", "provider")
EXPORTED = {"activity": "MOBILE-ANDROID-001", "activity-alias": "MOBILE-ANDROID-001", "receiver": "MOBILE-ANDROID-002"}
NAMESPACE = "http://schemas.android.com/apk/res/android"


def _fields(*names: str) -> str:
    """Each attribute with the namespace's prefix, and without any."""
    return ", ".join(f"`_{p}{n}`: string" for n in names for p in ("android:", ""))


_NAMED = f"array<struct<{_fields('name')}>>"
_PART = f"array<struct<{_fields('name', 'exported', 'permission')}, `intent-filter`: array<string>>>"
SCHEMA = (
    "_package string, _sharedUserId string, " + ", ".join(f"`{x}` {_NAMED}" for x in (*ASKED, "uses-feature"))
    + f", application struct<{_fields('label', 'debuggable', 'allowBackup', 'usesCleartextTraffic')}, " + ", ".join(f"`{k}`: {_PART}" for k in KINDS) + ">"
)


def _attribute(of: Column, name: str) -> Column:
    return F.coalesce(of[f"_android:{name}"], of[f"_{name}"])


def _flag(value: Column) -> Column:
    """True, false, or null where nothing is said."""
    return F.lower(value) == "true"


def _names(column: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(f"m.`{column}`"), F.array()), lambda p: _attribute(p, "name")), lambda n: F.coalesce(n, F.lit("")) != "")


def manifests(files: DataFrame) -> DataFrame:
    """file_id, package, shared_user_id, permissions (by tag), features, application (label and flags, null where unsaid), components (kind by kind: kind, name, exported, permission, intent_filters) of files (file_id, content).

    The namespace may have any prefix. Null for all but file_id where the content is no XML or no manifest.
    """
    prefix = F.regexp_extract("content", rf"xmlns:([A-Za-z_][\w.-]*)\s*=\s*[\"']{NAMESPACE}[\"']", 1)
    # Spark names attributes by their prefix, so the document's own becomes the usual one.
    usual = F.when((prefix == "") | (prefix == "android"), F.col("content")).otherwise(F.regexp_replace("content", F.concat(F.lit("(\\s)"), prefix, F.lit(":(\\w+\\s*=)")), F.lit("$1android:$2")))
    root = F.regexp_replace("content", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*", "").rlike(r"^<(?:\w+:)?manifest\b")
    parsed = files.select("file_id", F.when(root, F.from_xml(usual, SCHEMA)).alias("m"))
    flags = {"debuggable": "debuggable", "allow_backup": "allowBackup", "uses_cleartext_traffic": "usesCleartextTraffic"}
    app = F.col("m.application")
    application = F.struct(_attribute(app, "label").alias("label"), *(_flag(_attribute(app, a)).alias(n) for n, a in flags.items()))

    def parts(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"m.application.`{kind}`"), F.array()), lambda c: F.struct(F.lit(kind).alias("kind"), _attribute(c, "name").alias("name"), _flag(_attribute(c, "exported")).alias("exported"), _attribute(c, "permission").alias("permission"), F.coalesce(F.size(c["intent-filter"]), F.lit(0)).alias("intent_filters")))

    there = F.col("m").isNotNull()
    return parsed.select(
        "file_id", F.col("m._package").alias("package"), F.col("m._sharedUserId").alias("shared_user_id"), F.when(there, F.concat(*map(_names, ASKED))).alias("permissions"), F.when(there, _names("uses-feature")).alias("features"),
        F.when(app.isNotNull(), application).alias("application"), F.when(there, F.concat(*map(parts, KINDS))).alias("components"),
    )


def findings(files: DataFrame) -> DataFrame:
    """file_id, rule_id, evidence, package, place (the order within the file: permissions, then components) of files (file_id, content). Broken XML gives none; a component without a name shows as <unknown>."""
    told = manifests(files)
    asked = told.select("file_id", "package", F.posexplode("permissions").alias("place", "name")).where(F.col("name").isin(*DANGEROUS))
    out = asked.select("file_id", F.lit("MOBILE-ANDROID-003").alias("rule_id"), F.substring_index("name", ".", -1).alias("evidence"), "package", F.col("place").cast("long").alias("place"))
    rule = F.create_map(*(F.lit(x) for pair in EXPORTED.items() for x in pair))[F.col("c.kind")]
    open_ = told.select("file_id", "package", F.posexplode("components").alias("place", "c")).withColumn("rule_id", rule).where("c.exported AND rule_id IS NOT NULL")
    return out.unionByName(open_.select("file_id", "rule_id", F.coalesce(F.nullif("c.name", F.lit("")), F.lit("<unknown>")).alias("evidence"), "package", (F.col("place") + (1 << 32)).alias("place")))
