"""Pipelines from files to graph tables: documents, images and sound.

Models are plugged in as functions from texts to vectors; the stub stands in
for them, and depends on the text alone, so that a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources import files, readers, records, writers
from .control import stub_embedding

Embed = Callable[[list[str]], list[Sequence[float]]]

# What files are, by extension.
KINDS = {
    "document": (".txt", ".md", ".csv", ".tsv", ".docx", ".pptx", ".xlsx", ".pdf"),
    "image": (".png", ".jpg", ".jpeg", ".gif"),
    "audio": (".wav",),
}
GROUPS = {
    "DocChunk": {"core": ["id", "media_asset_id", "chunk_index", "char_start", "char_end", "token_start", "token_end", "embedding_model"], "text": ["content"], "vector": ["vector"]},
    "ImageAsset": {"core": ["id", "media_asset_id", "format", "width", "height", "embedding_model"], "vector": ["vector"]},
    "AudioSegment": {"core": ["id", "media_asset_id", "start_ms", "end_ms", "level_db", "embedding_model"], "vector": ["vector"]},
    "MediaAsset": {"core": ["id", "uri", "media_type", "size_bytes", "sha256"]},
}


def stub(dim: int) -> Embed:
    return lambda texts: [stub_embedding(t, dim) for t in texts]


def embedded(df: DataFrame, text: str, embed: Embed, name: str = "vector") -> DataFrame:
    """df with the vector of a text column, a batch of texts at a time; null texts have none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            vectors = iter(embed([t for t in texts if t is not None]))
            rows = [None if t is None else list(next(vectors)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], [*batch.schema.names, name])

    return df.mapInArrow(run, f"{schema}, `{name}` array<float>")


def _key(*parts: str):
    return F.sha2(F.concat_ws("#", *[F.col(p).cast("string") for p in parts]), 256)


def image_rows(found: DataFrame) -> DataFrame:
    """uri, format, width and height of images whose heads can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(u, files.image_size(c.as_py() or b"")) for u, c in zip(batch.column(0).to_pylist(), batch.column(1))]
            known = [(u, *s) for u, s in seen if s]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*known) if known else [[]] * 4, kinds)], ["uri", "format", "width", "height"])

    return found.select("uri", "content").mapInArrow(run, "uri string, format string, width long, height long")


def ingest(spark: SparkSession, glob: str, root: str, run_id: str, *, embed: dict[str, Embed] | None = None, model: str = "stub", max_bytes: int = 100 << 20, target: int = 128, overlap: int = 16, window_s: float = 5.0, hop_s: float = 5.0, most: int = 240, silence_db: float | None = -45.0, now: datetime | None = None) -> DataFrame:
    """Files under a path to vertices, edges and a manifest under root; what was refused: uri and reason.

    Column groups of a vertex are written from one stored table, so that they
    match by position.  Ids are hashes of a file's uri and a part's place.
    """
    now = now or datetime.now(UTC)
    embed = embed or {"text": stub(768), "image": stub(512), "audio": stub(512)}
    found = materialize(files.checked(files.files(spark, glob), max_bytes))
    kind = F.lit(None).cast("string")
    for name, extensions in KINDS.items():
        kind = F.when(F.col("extension").isin(*extensions), name).otherwise(kind)
    sorted_out = found.withColumn("media_type", kind).withColumn("reason", F.coalesce("reason", F.when(F.col("media_type").isNull(), "extension")))
    good = sorted_out.where("reason is null")
    of = lambda name: good.where(F.col("media_type") == name)
    texts = materialize(files.read_texts(of("document")))
    chunks = files.chunk_texts(texts.where("error is null"), target=target, overlap=overlap).withColumnRenamed("chunk", "content")
    tables = {
        "MediaAsset": good.select(_key("uri").alias("id"), "uri", "media_type", F.col("length").alias("size_bytes"), "sha256"),
        "DocChunk": embedded(chunks.select(_key("uri", "chunk_index").alias("id"), _key("uri").alias("media_asset_id"), "chunk_index", "char_start", "char_end", "token_start", "token_end", "content"), "content", embed["text"]),
        "ImageAsset": embedded(image_rows(of("image")).select(F.sha2(F.concat("uri", F.lit("#image")), 256).alias("id"), _key("uri").alias("media_asset_id"), "format", "width", "height"), "id", embed["image"]),
        "AudioSegment": embedded(files.sound_windows(of("audio"), window_s=window_s, hop_s=hop_s, most=most, silence_db=silence_db).select(_key("uri", "window").alias("id"), _key("uri").alias("media_asset_id"), "start_ms", "end_ms", "level_db"), "id", embed["audio"]),
    }
    counts, parts, edges = {}, [], None
    for vertex, rows in tables.items():
        stored = materialize(rows.withColumn("embedding_model", F.lit(model)))
        counts[vertex] = stored.count()
        if not counts[vertex]:
            continue
        for group, columns in GROUPS[vertex].items():
            path = f"{writers.part_path(root, vertex, group)}/{run_id}"
            stored.select(*columns).write.mode("errorifexists").option("compression", "zstd").parquet(path)
            parts.append(records.written_files(spark, path))
        if vertex != "MediaAsset":
            own = stored.select(F.col("id").alias("src_id"), F.col("media_asset_id").alias("dst_id"))
            edges = own if edges is None else edges.unionAll(own)
    if edges is not None:
        path = f"{writers.part_path(root, 'DerivedFrom', 'adj_list', edge=True)}/{run_id}"
        edges.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        counts["DerivedFrom"] = edges.count()
        parts.append(records.written_files(spark, path))
    written = parts[0]
    for more in parts[1:]:
        written = written.unionAll(more)
    body = writers.manifest(written, pipeline_version="1", schema_version="1", started_at=now, completed_at=now, counts=counts)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/manifests/{run_id}/body")
    return sorted_out.where("reason is not null").select("uri", "reason").unionAll(texts.where("error is not null").select("uri", F.col("error").alias("reason")))


def ingested(spark: SparkSession, root: str, vertex: str, run_id: str) -> DataFrame:
    """The rows of a run's vertex, its column groups joined by position."""
    from .graph import stitch

    groups = []
    for group in GROUPS[vertex]:
        rows = spark.read.parquet(f"{writers.part_path(root, vertex, group)}/{run_id}")
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)  # files of one number hold the same rows
        groups.append(rows.select("*", part.alias("group_id"), F.col("_metadata.row_index").alias("row_number")))
    return stitch(*groups).drop("group_id", "row_number")


def manifest_of(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The manifest of a run, one row a file."""
    read = spark.read.schema(readers.MANIFEST).option("multiLine", True).json(f"{root.rstrip('/')}/manifests/{run_id}/body")
    return readers.manifest_files(read.select(F.lit(run_id).alias("run_id"), "*"))
