"""Stable identifiers and tags."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ascii(payload: Column) -> Column:
    """JSON text with every character outside ASCII written as its UTF-16 escapes, so that ids do not depend on an encoding."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.array_join(F.transform(F.split(payload, ""), lambda c: F.when(c.rlike("^[\\x00-\\x7f]*$"), c).otherwise(units(c))), "")
    return F.when(payload.rlike("[^\\x00-\\x7f]"), escaped).otherwise(payload)


def _digest(payload: Column, length: int) -> Column:
    return F.substring(F.sha2(_ascii(payload), 256), 1, length)


def event_id(table: Column, load: Column, drift_class: Column, subtype: Column, before: Column, after: Column) -> Column:
    """`DE-` + 12 hex digits over the JSON list of the six fields; a missing name counts as null."""
    parts = [table, load, drift_class, subtype, before, after]
    return F.concat(F.lit("DE-"), _digest(F.to_json(F.array(*[p.cast("string") for p in parts])), 12))


def incident_id(table: Column, load: Column, event_ids: Column) -> Column:
    """`INC-` + 8 hex digits over [table, load, sorted event ids]; `OK-` over [table, load] when there are none."""
    pair = F.to_json(F.array(table, load))
    nested = F.concat(F.rtrim(pair, F.lit("]")), F.lit(","), F.to_json(F.array_sort(event_ids)), F.lit("]"))
    return F.when(F.size(F.coalesce(event_ids, F.array().cast("array<string>"))) > 0,
                  F.concat(F.lit("INC-"), F.upper(_digest(nested, 8)))
                  ).otherwise(F.concat(F.lit("OK-"), F.upper(_digest(pair, 8))))


def incident_from_branch(ref: Column) -> Column:
    """Incident id named by a branch such as `refs/heads/fix/inc-0123abcd-rename`, else null."""
    found = F.regexp_extract(ref, r"(?i)^(?:refs/heads/)?[a-z]+/(inc-[0-9a-f]{8})-", 1)
    return F.when(found != "", F.upper(found))


def query_tag(app: str, agent: Column, incident: Column) -> Column:
    """Compact JSON tag; the incident is left out when it is null."""
    return F.to_json(F.struct(F.lit(app).alias("app"), agent.alias("agent"), incident.alias("incident")))


def short_name(dotted: Column) -> Column:
    """Last segment of a dotted name."""
    return F.element_at(F.split(dotted, r"\."), -1)
