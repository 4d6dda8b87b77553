"""Sources: parquet with provenance, manifests, tabular text, streams, admission rules."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import append_by_name

MANIFEST = "pipeline_version string, schema_version string, started_at string, completed_at string, counts map<string,bigint>, files array<struct<uri:string, rows:bigint, bytes_written:bigint, sha256:string>>"
STREAM_EVENT = "bucket string, name string, generation string, stream_id string, org_id string, content_type string, size bigint, device_id string, site_id string, modality string, received_at string"

# Where uploads of each modality lie, and what they may be.
PREFIXES = {"docs": "document", "images": "image", "audio": "audio", "videos": "video"}
EXTENSIONS = {
    "document": ("pdf", "txt", "md", "rtf", "docx", "pptx", "csv", "tsv", "xlsx", "xls"),
    "image": ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "gif"),
    "audio": ("mp3", "wav", "flac", "m4a", "aac", "ogg", "opus"),
    "video": ("mp4", "mov", "mkv", "webm", "avi", "mpeg", "mpg"),
}
CONTENT_TYPES = {
    "application/pdf": ("pdf",), "text/plain": ("txt", "md"), "text/markdown": ("md",), "application/rtf": ("rtf",), "text/rtf": ("rtf",),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("docx",), "application/vnd.openxmlformats-officedocument.presentationml.presentation": ("pptx",),
    "text/csv": ("csv",), "application/csv": ("csv",), "text/tab-separated-values": ("tsv",), "text/tsv": ("tsv",),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("xlsx",), "application/vnd.ms-excel": ("xls",),
    "image/jpeg": ("jpg", "jpeg"), "image/png": ("png",), "image/webp": ("webp",), "image/bmp": ("bmp",), "image/tiff": ("tiff",), "image/gif": ("gif",),
    "audio/mpeg": ("mp3",), "audio/mp3": ("mp3",), "audio/wav": ("wav",), "audio/x-wav": ("wav",), "audio/flac": ("flac",), "audio/x-flac": ("flac",), "audio/mp4": ("m4a",), "audio/m4a": ("m4a",), "audio/aac": ("aac",), "audio/ogg": ("ogg",), "audio/opus": ("opus",),
    "video/mp4": ("mp4",), "video/quicktime": ("mov",), "video/x-msvideo": ("avi",), "video/webm": ("webm",), "video/x-matroska": ("mkv",), "video/mpeg": ("mpeg", "mpg"),
}


#: Files that one task puts into groups, about.
GROUP_FILES = 250_000


def parquet_by_name(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Files of differing schemas as one table: missing columns are null, types are promoted.

    One scan if the schemas can be merged; else one for each distinct schema,
    so a plan grows with the schemas, not with the files.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    if not files:
        raise ValueError("no files")
    try:
        return spark.read.option("mergeSchema", True).parquet(*files)
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e) and "Failed merging schema" not in str(e):
            raise
    alike: dict[str, list[str]] = {}
    for f in files:
        alike.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
    parts = [spark.read.parquet(*same) for same in alike.values()]
    out = parts[0]
    for more in parts[1:]:
        out = append_by_name(out, more)
    return out


def base_name(uri: Column) -> Column:
    """The last part of a path, without a query string."""
    return F.regexp_extract(uri, r"(?:.*/)?([^/?]+)(?:\?.*)?$", 1)


def manifests(spark: SparkSession, glob: str) -> DataFrame:
    """Manifests with the id of their run, from the name of its folder."""
    path = F.input_file_name()
    return spark.read.schema(MANIFEST).option("multiLine", True).json(glob).select(F.regexp_extract(path, r"/([^/]+)/manifest\.json", 1).alias("run_id"), "*")


def manifest_files(found: DataFrame) -> DataFrame:
    """One row a file: run_id, vertex, kind, uri, rows; kind is core, text, vector or adj_list."""
    f = found.select("run_id", "completed_at", F.explode("files").alias("f"))
    part = lambda i: F.regexp_extract("f.uri", r"/(?:vertices|edges)/([^/]+)/([^/]+)/", i)
    return f.select("run_id", "completed_at", part(1).alias("vertex"), part(2).alias("kind"), F.col("f.uri").alias("uri"), F.col("f.rows").alias("rows"))


def file_groups(files: DataFrame) -> DataFrame:
    """The core, text and vector file of each run, vertex and ordinal, so that no second file of a kind is lost."""
    from pyspark.sql import Window

    # one exchange for ordinals and groups, whose parts are as many as the files ask for; their key has a column of its own, as a constant vertex is left out of other keys
    parts = max(1, -(-files.select().count() // GROUP_FILES))
    placed = files.withColumn("_group", F.xxhash64("run_id", "vertex")).repartition(parts, "_group")
    nth = F.row_number().over(Window.partitionBy("_group", "run_id", "vertex", "kind").orderBy("uri"))
    groups = placed.withColumn("nth", nth).groupBy("_group", "run_id", "vertex", "nth")
    return groups.agg(*[F.max(F.when(F.col("kind") == k, F.col("uri"))).alias(k) for k in ("core", "text", "vector")]).drop("_group")


def existing(files: DataFrame, listing: DataFrame, uri: str = "uri") -> DataFrame:
    """File references that a listing (uri) still has."""
    return files.join(listing.select(uri).distinct(), uri, "left_semi")


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """Files under a path, by metadata alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    return found.select(F.col("path").alias("uri"), "modificationTime", "length")


def preview(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The first rows, and how many there are in all, which a scan without columns takes from the files' footers."""
    return df.limit(rows), df.select().count()


def tabular(spark: SparkSession, path: str, *, separator: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("sep", separator).csv(path)


def modality_of_path(name: Column, prefix: str = "raw") -> Column:
    """The modality of an upload by its folder; null for others."""
    out = F.lit(None).cast("string")
    for folder, modality in PREFIXES.items():
        out = F.when(name.startswith(f"{prefix}/{folder}/"), modality).otherwise(out)
    return out


def admission(name: Column, content_type: Column, modality: Column | None = None) -> Column:
    """Why an upload is refused: extension, content_type, or null if it is admitted.

    With a modality the extension must be one of its own; a content type must
    be a known one of the extension, none at all is admitted.
    """
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.trim(F.lower(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    known = F.lit(False)
    for m, own in EXTENSIONS.items():
        known = known | (extension.isin(*own) & (F.lit(True) if modality is None else modality.eqNullSafe(m)))
    fits = F.lit(False)
    for mime, extensions in CONTENT_TYPES.items():
        fits = fits | ((kind == mime) & extension.isin(*extensions))
    return F.when(~known, "extension").when((kind != "") & ~fits, "content_type")


def decode_batches(messages: DataFrame, value: str = "value") -> DataFrame:
    """Events of JSON batches {"events": [...]}; those without bucket, name, generation or stream_id are left out."""
    event = ", ".join(x.replace(" ", ": ", 1) for x in STREAM_EVENT.split(", "))
    rows = messages.select(F.explode(F.from_json(F.col(value).cast("string"), f"events array<struct<{event}>>")["events"]).alias("e")).select("e.*")
    return rows.dropna(subset=["bucket", "name", "generation", "stream_id"])


def decoded_image(payload: Column) -> Column:
    """Bytes of a base64 payload, with or without a data-URI prefix; null if it isn't base64."""
    return F.try_to_binary(F.regexp_replace(payload, "^data:[^,]*,", ""), F.lit("base64"))


class TimestampError(ValueError):
    """A text that is no ISO 8601 time."""


def parse_timestamp(text: str | None) -> datetime | None:
    """An ISO 8601 time; without an offset it is UTC; None for none."""
    if text is None or not text.strip():
        return None
    try:
        at = datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise TimestampError(f"not a time: {text!r}") from e
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def audit_predicate(*, since: str | None = None, until: str | None = None, **equals) -> Column:
    """The conjunction of optional equalities and an inclusive range of created_at."""
    out = F.lit(True)
    for name, value in equals.items():
        if value is not None:
            out = out & (F.col(name) == value)
    first, last = parse_timestamp(since), parse_timestamp(until)
    if first is not None:
        out = out & (F.col("created_at") >= F.lit(first))
    if last is not None:
        out = out & (F.col("created_at") <= F.lit(last))
    return out


def audit_log(df: DataFrame, *, limit: int = 100, tie: Sequence[str] = (), **conditions) -> DataFrame:
    """The newest rows that match, 1 to 1000 of them."""
    return df.where(audit_predicate(**conditions)).orderBy(F.desc("created_at"), *tie).limit(max(1, min(1000, limit)))
