"""Incremental ingest state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = "struct<uid: string, uidvalidity: string, uidnext: string, messages: string>"


def uid_order(uid: Column) -> Column:
    """A sort key: numbers by value, other texts after them by their characters, null first."""
    number = F.when(uid.rlike("^[0-9]{1,38}$"), uid.try_cast("decimal(38,0)"))
    return F.when(uid.isNotNull() & (uid != ""), F.struct(number.isNull().alias("text"), number.alias("number"), uid.alias("uid")))


def is_newer(candidate: Column, previous: Column) -> Column:
    """Numbers compare by value if both are numbers, else as text; an empty candidate is never newer."""
    digits = lambda c: c.rlike("^[0-9]{1,38}$")
    both = digits(candidate) & digits(previous)
    number = candidate.try_cast("decimal(38,0)") > previous.try_cast("decimal(38,0)")
    none = F.coalesce(previous, F.lit("")) == ""
    return F.when(F.coalesce(candidate, F.lit("")) == "", False).when(none, True).when(both, number).otherwise(candidate > previous)


def parse_state(raw: Column) -> Column:
    """folder -> (uid, uidvalidity, uidnext, messages); any other text is the INBOX uid of old."""
    parsed = F.from_json(raw, f"map<string, {FOLDER}>")
    whole = raw.rlike(r"^\s*\{") & parsed.isNotNull() & F.forall(F.map_values(parsed), lambda v: v.isNotNull())
    blank = lambda c: F.coalesce(c, F.lit(""))
    clean = F.transform_values(parsed, lambda _, v: F.struct(*(blank(v[c]).alias(c) for c in ("uid", "uidvalidity", "uidnext", "messages"))))
    old = F.create_map(F.lit("INBOX"), F.struct(raw.alias("uid"), *(F.lit("").alias(c) for c in ("uidvalidity", "uidnext", "messages"))))
    empty = F.from_json(F.lit("{}"), f"map<string, {FOLDER}>")
    return F.when(F.coalesce(raw, F.lit("")) == "", empty).when(whole, clean).otherwise(old)


LEGACY = "__legacy_uid__"
DELTA = "outlook_delta_v1"
FOLDER_DELTA = "struct<delta_link: string, last_sync_at: string, _legacy_received_dt: string>"


def parse_time_state(raw: Column) -> Column:
    """folder -> time of its newest message; any other text is one old message id."""
    parsed = F.from_json(raw, "map<string, string>")
    clean = F.transform_values(parsed, lambda _, v: F.coalesce(v, F.lit("")))
    empty = F.from_json(F.lit("{}"), "map<string, string>")
    old = F.create_map(F.lit(LEGACY), raw)
    return F.when(F.coalesce(raw, F.lit("")) == "", empty).when(raw.rlike(r"^\s*\{") & parsed.isNotNull(), clean).otherwise(old)


def parse_delta_state(raw: Column) -> Column:
    """(folders, bridged): state of change feeds; times of old are bridged, anything else starts anew."""
    empty = F.from_json(F.lit("{}"), f"map<string, {FOLDER_DELTA}>")
    tagged = F.from_json(raw, f"_format string, folders map<string, {FOLDER_DELTA}>")
    times = F.from_json(raw, "map<string, string>")
    plain = raw.rlike(r"^\s*\{") & times.isNotNull() & ~F.map_contains_key(times, F.lit(LEGACY)) & F.forall(
        F.map_values(times), lambda v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]")
    )
    bridge = F.transform_values(times, lambda _, v: F.struct(F.lit("").alias("delta_link"), F.lit("").alias("last_sync_at"), v.alias("_legacy_received_dt")))
    pack = lambda folders, bridged: F.struct(F.coalesce(folders, empty).alias("folders"), F.lit(bridged).alias("bridged"))
    return F.when(
        F.coalesce(tagged["_format"] == DELTA, F.lit(False)), pack(tagged["folders"], False)
    ).when(F.coalesce(plain, F.lit(False)), pack(bridge, True)).otherwise(pack(empty, False))
