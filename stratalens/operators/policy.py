"""Policies: alerts, attributes, roles, privacy, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import small_side


def retention_tier(age_days: Column, warm: int, cold: int, delete: int) -> Column:
    return F.when(age_days >= delete, "delete").when(age_days >= cold, "cold").when(age_days >= warm, "warm").otherwise("hot")


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of events (event_type, modality, confidence, tags) and rules (types, modalities, min_confidence, rule_tags) that match.

    An empty list or null leaves a condition out; "*" among the types matches
    all.  Rules are a catalogue; they are broadcast if a count allows it.
    """
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    types = empty("types") | F.array_contains("types", "*") | F.expr("array_contains(types, event_type)")
    modalities = empty("modalities") | F.expr("array_contains(modalities, modality)")
    confident = F.col("min_confidence").isNull() | (F.col("confidence") >= F.col("min_confidence"))
    tagged = empty("rule_tags") | F.arrays_overlap("tags", "rule_tags")
    return events.join(small_side(rules), F.coalesce(types & modalities & confident & tagged, F.lit(False)))


def attribute_decision(subjects: DataFrame, policies: list[dict], default: bool = True) -> Column:
    """Whether a subject is allowed: any policy that denies wins, then any that allows, else the default.

    A policy has an effect and conditions, column to value or list of values.
    """
    def matches(p: dict) -> Column:
        out = F.lit(True)
        for column, value in p.get("conditions", {}).items():
            out = out & F.coalesce(F.col(column).isin(value if isinstance(value, list) else [value]), F.lit(False))
        return out

    deny, allow = F.lit(False), F.lit(False)
    for p in policies:
        if p["effect"] == "deny":
            deny = deny | matches(p)
        else:
            allow = allow | matches(p)
    return F.when(deny, False).when(allow, True).otherwise(F.lit(default))


def role_allows(roles: Column, permissions: dict[str, list[str]], action: Column, admin: str = "admin") -> Column:
    """Whether one of the roles may act: admin always, "*" everything, else by name."""
    granted = F.array_contains(roles, admin)
    for role, actions in permissions.items():
        may = F.lit(True) if "*" in actions else action.isin(actions)
        granted = granted | (F.array_contains(roles, role) & may)
    return F.coalesce(granted, F.lit(False))


def redaction_types(policies: list[dict], modality: Column, org: Column, action: str) -> Column:
    """The kinds of data to redact: the union over matching policies, in their order."""
    parts = []
    for p in policies:
        if not p.get("enabled", True) or action not in p.get("contexts", ["*"]) and "*" not in p.get("contexts", ["*"]):
            continue
        cond = F.lit(True)
        if p.get("modalities"):
            cond = cond & F.coalesce(modality.isin(p["modalities"]), F.lit(False))
        if p.get("org_id"):
            cond = cond & (org == p["org_id"])
        parts.append(F.when(cond, F.array(*[F.lit(x) for x in p.get("types", ["pii"])])))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*parts)))) if parts else F.array().cast("array<string>")
