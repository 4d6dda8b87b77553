"""Sinks: parts with statistics, manifests, exports."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PII, redact
from ..operators.policy import redaction_types


def part_path(root: str, vertex: str, kind: str, *, edge: bool = False) -> str:
    return f"{root.rstrip('/')}/{'edges' if edge else 'vertices'}/{vertex}/{kind}"


def graph_root(base: str, prefix: str = "") -> str:
    """The root of a graph under a base, with a prefix if there is one."""
    return join_path(base, *prefix.split("/"))


def join_path(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *[p.strip("/") for p in parts if p.strip("/")]])


def manifest_path(root: str, run_id: str) -> str:
    return join_path(root, "manifests", run_id, "manifest.json")


def write_parts(df: DataFrame, path: str, *, codec: str = "zstd") -> DataFrame:
    """Write Parquet parts; returns one row a file: uri and rows, from the files' own statistics."""
    df.write.mode("append").option("compression", codec).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.groupBy(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("bytes_written")).agg(F.count("*").alias("rows"))


def manifest(files: DataFrame, *, pipeline_version: str, schema_version: str, started_at: datetime, completed_at: datetime, counts: dict[str, int] | None = None) -> str:
    """A manifest as JSON with sorted keys.  Files are those of one run."""
    stamp = lambda t: t.astimezone(UTC).isoformat().replace("+00:00", "Z")
    body = {"pipeline_version": pipeline_version, "schema_version": schema_version, "started_at": stamp(started_at), "completed_at": stamp(completed_at), "counts": counts or {}}
    body["files"] = [r.asDict() for r in files.orderBy("uri").collect()]
    return json.dumps(body, sort_keys=True, indent=2)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write tables under a path; returns their numbers of rows."""
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out


def export(df: DataFrame, path: str, kind: str, *, redacted: list[str] | None = None, kinds: tuple[str, ...] = tuple(PII), policies: list[dict] = (), modality: str = "modality", org: str | None = None) -> None:
    """CSV with a header, or JSON lines, with personal data of some kinds redacted in the named columns.

    With policies, a row is redacted as they say for its modality when exported.
    """
    if policies:
        wanted = redaction_types(list(policies), F.col(modality) if modality in df.columns else F.lit(None).cast("string"), F.lit(org), "export")
        named = {k: F.array_contains(wanted, k) | F.array_contains(wanted, "pii") for k in PII}
        for c in redacted or []:
            for data, asked in named.items():
                df = df.withColumn(c, F.when(asked, redact(F.col(c), (data,))).otherwise(F.col(c)))
        redacted = None
    for c in redacted or []:
        df = df.withColumn(c, redact(F.col(c), kinds))
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "jsonl":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {kind}")


def tags(values: list[str]) -> str:
    """Trimmed tags that aren't empty, joined by commas."""
    return ",".join(x for x in (v.strip() for v in values) if x)
