"""Boolean filter trees: validation and compilation to columns.

Logic has two values: what can't be compared (null, a number with a text) is
false before any negation, and null equals null.  Texts that are both RFC 3339
times are compared as instants, without an offset in UTC.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fusion import canonical_modality

FIELDS = ("asset_id", "asset_type", "source_type", "start_ms", "end_ms", "duration_ms", "created_at")
OPERATORS = ("eq", "neq", "in", "nin", "gt", "gte", "lt", "lte", "between", "exists")


class FilterError(ValueError):
    """A filter that isn't well formed."""


def validate(node: Any) -> None:
    if not isinstance(node, dict):
        raise FilterError("a filter is an object")
    groups = [k for k in ("all", "any", "not") if k in node]
    if groups:
        if len(node) != 1:
            raise FilterError("a group has one key")
        inner = node[groups[0]]
        if groups[0] == "not":
            return validate(inner)
        if not isinstance(inner, list) or not inner:
            raise FilterError("a group lists filters")
        for x in inner:
            validate(x)
        return
    if set(node) - {"field", "op", "value"}:
        raise FilterError("unknown key")
    if node.get("field") not in FIELDS and not str(node.get("field", "")).startswith("metadata."):
        raise FilterError(f"unknown field {node.get('field')!r}")
    if node.get("op") not in OPERATORS:
        raise FilterError(f"unknown operator {node.get('op')!r}")
    value = node.get("value")
    if node["op"] in ("in", "nin") and not isinstance(value, list):
        raise FilterError("a list is needed")
    if node["op"] == "between" and (not isinstance(value, list) or len(value) != 2):
        raise FilterError("two bounds are needed")
    if node["op"] not in ("exists",) and "value" not in node:
        raise FilterError("a value is needed")


_TIME = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?\s*$"


def field(name: str, columns: set[str] | None = None) -> Column:
    """The column of a field; a source type that is missing is the hit's modality, where hits have one."""
    if name.startswith("metadata."):
        raise FilterError("metadata fields can't be filtered here")
    if name == "duration_ms":
        return F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))
    if name == "created_at":
        return F.lit(None).cast("string")
    if name == "source_type" and columns and "modality" in columns:
        own = F.when(F.col("source_type") != "", F.col("source_type")) if "source_type" in columns else F.lit(None).cast("string")
        return F.coalesce(own, canonical_modality(F.col("modality")))
    return F.col(name)


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text, null for any other text."""
    return F.when(text.rlike(_TIME), F.try_to_timestamp(F.trim(text)))


def _comparable(kind: T.DataType | None, value: Any) -> bool:
    if value is None or isinstance(value, (list, dict)):
        return False
    return kind is None or isinstance(kind, T.NullType) or isinstance(value, str) == isinstance(kind, T.StringType)


def compile_filter(node: dict, schema: T.StructType | None = None) -> Column:
    """A Boolean column that is never null; with a schema, values of another kind than their field never match."""
    validate(node)
    kinds = {f.name: f.dataType for f in schema} if schema is not None else None
    return _compile(node, kinds)


def apply_filter(df: DataFrame, node: dict | None) -> DataFrame:
    return df if node is None else df.where(compile_filter(node, df.schema))


def _range(x: Column, op: str, value: Any) -> Column:
    ordered = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}[op]
    plain = ordered(x, F.lit(value))
    if isinstance(value, str) and re.match(_TIME, value):
        at = instant(x)
        plain = F.when(at.isNotNull(), ordered(at, instant(F.lit(value)))).otherwise(plain)
    return F.coalesce(plain, F.lit(False))


def _compile(node: dict, kinds: dict[str, T.DataType] | None) -> Column:
    if "not" in node:
        return ~_compile(node["not"], kinds)
    for key, join in (("all", Column.__and__), ("any", Column.__or__)):
        if key in node:
            out = _compile(node[key][0], kinds)
            for x in node[key][1:]:
                out = join(out, _compile(x, kinds))
            return out
    name, op, value = node["field"], node["op"], node.get("value")
    x = field(name, set(kinds) if kinds else None)
    kind = {"duration_ms": T.LongType(), "created_at": T.StringType(), "source_type": T.StringType()}.get(name, kinds.get(name) if kinds else None)
    if op == "exists":
        return x.isNotNull()
    if op in ("eq", "neq"):
        same = x.isNull() if value is None else x.eqNullSafe(F.lit(value)) if _comparable(kind, value) else F.lit(False)
        return same if op == "eq" else ~same
    if op in ("in", "nin"):
        known = [v for v in value if _comparable(kind, v)]
        listed = F.coalesce(x.isin(known), F.lit(False)) if known else F.lit(False)
        if None in value:
            listed = listed | x.isNull()
        return listed if op == "in" else ~listed
    bounds = [("gte", value[0]), ("lte", value[1])] if op == "between" else [(op, value)]
    out = F.lit(True)
    for how, bound in bounds:
        out = out & (_range(x, how, bound) if _comparable(kind, bound) else F.lit(False))
    return out


def legacy_filters(node: dict | None) -> dict[str, str] | None:
    """What a metadata search takes over from a filter of one leaf: an asset type or, as part of the uri, an asset id."""
    if node is None or str(node.get("op", "")).lower() != "eq" or not isinstance(node.get("value"), str):
        return None
    name = {"asset_type": "media_type", "asset_id": "uri"}.get(node.get("field"))
    return {name: node["value"]} if name else None
