"""Control decisions as columns or plain functions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of modalities, what each is called for retrieval, and modes.
CANONICAL = ("text", "ocr", "vision", "audio", "video")
ALIASES = {"document": "text", "transcript": "text", "image": "vision"}
RETRIEVAL = {"text": ("document", "transcript"), "ocr": ("document", "transcript"), "vision": ("image",), "video": ("image",), "audio": ("audio",)}


class RequestError(ValueError):
    """A request that can't be planned."""


def retrieval_modalities(names: Iterable[str] | None = None) -> set[str]:
    """The branches that a request needs; all of them if it names none."""
    wanted = [ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names or CANONICAL]
    unknown = [n for n in wanted if n not in RETRIEVAL]
    if unknown:
        raise RequestError(f"unsupported modality {unknown[0]!r}")
    return {r for n in wanted for r in RETRIEVAL[n]}


# Kinds of searches, groups and orders of results.
SEARCHES, GROUPS, ORDERS = ("vector", "keyword", "metadata"), (None, "none", "video"), ("score", "clip_count")


def check_request(*, top_k: int, page_limit: int | None = None, query: str | None = None, image: str | None = None, metadata: dict | None = None, most: int = 500, kind: str = "vector", modalities: Iterable[str] | None = None, group_by: str | None = None, sort_by: str = "score", image_bytes: int = 5 << 20) -> None:
    """Refuse a request that can't be planned: limits, what a kind of search needs and takes, sizes."""
    wrong = [
        (not 1 <= top_k <= most, f"top_k must be 1 to {most}"),
        (page_limit is not None and not 1 <= page_limit <= top_k, "page_limit must be 1 to top_k"),
        (kind not in SEARCHES, f"unsupported search {kind!r}"),
        (group_by not in GROUPS, f"unsupported group_by {group_by!r}"),
        (sort_by not in ORDERS, f"unsupported sort_by {sort_by!r}"),
        (not (query or image or metadata), "a request needs a text, an image or filters"),
        (bool(image) and len(image) > image_bytes, "the image is too large"),
        (bool(image) and kind != "vector", "an image is for vector searches only"),
        (bool(image) and modalities is not None and "image" not in retrieval_modalities(modalities), "an image needs its modality"),
        (kind == "keyword" and not query, "a keyword search needs a text"),
        (kind == "metadata" and bool(query or image), "a metadata search takes no text and no image"),
        (kind == "metadata" and not metadata, "a metadata search needs filters"),
    ]
    for is_wrong, why in wrong:
        if is_wrong:
            raise RequestError(why)


def query_tier(has_image: Column, modalities: Column, *, override: str | None = None, mode: str = "auto", default: str = "cpu") -> Column:
    if override or mode != "auto":
        return F.lit(override or default)
    media = F.coalesce(F.arrays_overlap(modalities, F.array(F.lit("image"), F.lit("audio"))), F.lit(False))
    return F.when(F.coalesce(has_image, F.lit(False)) | media, "gpu").otherwise(default)


def missing_checks(checks: dict[str, Column]) -> Column:
    """Names of the flags that aren't set, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def transcription_limit(overall: Column, org: Column, plan: Column) -> Column:
    """(max_ms, source): the smallest positive limit; the wider source wins a tie."""
    far = F.lit((1 << 62))
    positive = lambda c: F.when(c > 0, c).otherwise(far)
    least = F.least(positive(overall), positive(F.coalesce(org, F.lit(0))), positive(F.coalesce(plan, F.lit(0))))
    source = F.when(least == far, None).when(positive(overall) == least, "global").when(positive(F.coalesce(org, F.lit(0))) == least, "org").otherwise("plan")
    return F.struct(F.when(least == far, 0).otherwise(least).cast("long").alias("max_ms"), source.alias("source"))


#: Seconds of a unit, and of the named schedules.
UNITS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400}
NAMED = {"@hourly": "1h", "@daily": "1d", "@weekly": "7d"}
#: What the five fields of a schedule may hold: a function of the time, its least and its largest value.
FIELDS: tuple[tuple[Callable[[Column], Column], int, int], ...] = ((F.minute, 0, 59), (F.hour, 0, 23), (F.dayofmonth, 1, 31), (F.month, 1, 12), (lambda t: F.dayofweek(t) - 1, 0, 6))
_EVERY = re.compile(r"\s*(?:every\s+|interval\s+)?(\d+(?:\.\d+)?)\s*([smhd])\s*", re.I)


def interval_seconds(schedule: str) -> float | None:
    """The seconds of a schedule like "every 5m" or "@daily"; None for any other."""
    m = _EVERY.fullmatch(NAMED.get(schedule.strip().lower(), schedule))
    return float(m[1]) * UNITS[m[2].lower()] or None if m else None


def allowed_numbers(field: str, low: int, high: int) -> set[int]:
    """The numbers that a field of a schedule lets through: all, steps, or a list; what isn't understood lets none through."""
    numbers = range(low, high + 1)
    out: set[int] = set()
    for part in (p.strip() for p in field.split(",")):
        step = re.fullmatch(r"\*(?:/(\d+))?", part)
        if step and int(step[1] or 1):
            out |= {n for n in numbers if n % int(step[1] or 1) == 0}
        elif part.isdigit():
            out |= {int(part)} & set(numbers)
    return out


def schedule_due(schedule: str, now: Column, last: Column) -> Column:
    """Whether a schedule ("every 5m", "@daily", five fields) is due; by fields not twice in one minute.

    Each field is a set of numbers, so that being due is membership in five
    small sets.
    """
    seconds = interval_seconds(schedule)
    if seconds:
        return last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= F.lit(seconds * 1_000_000))
    parts = schedule.split()
    if len(parts) != len(FIELDS):
        return F.lit(False)
    parts[4] = re.sub(r"\b7\b", "0", parts[4]) if "/" not in parts[4] else parts[4]  # Sunday has two numbers
    sets = [allowed_numbers(p, low, high) for p, (_, low, high) in zip(parts, FIELDS)]
    if not all(sets):
        return F.lit(False)
    fits = F.lit(True)
    for (of, low, high), numbers in zip(FIELDS, sets):
        if len(numbers) <= high - low:
            fits = fits & of(now).isin(sorted(numbers))
    return fits & (last.isNull() | (F.date_trunc("minute", last) < F.date_trunc("minute", now)))


def adaptive_batch(backlog: Column, *, batch: tuple[int, int] = (1, 50), marks: tuple[int, int] = (10, 100), delay: tuple[int, int] = (0, 2000), latency: Column | None = None) -> Column:
    """(batch, delay): from the first to the second of each pair as the backlog goes from mark to mark."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (backlog - marks[0]) / (marks[1] - marks[0])))
    between = lambda p: F.floor(p[0] + share * (p[1] - p[0])).cast("long")
    wait = between(delay)
    if latency is not None:
        wait = F.least(F.lit(delay[1]), wait + F.floor(F.coalesce(latency, F.lit(0)) * 0.25)).cast("long")
    return F.struct(between(batch).alias("batch"), wait.alias("delay"))


def accepts(backlog: Column, soft: int = 1000, hard: int = 2000) -> Column:
    return backlog < min(soft, hard)


def evicted(items: DataFrame, by: str, age: str, size: str, *, order: list[Column], ttl: float, most: int) -> DataFrame:
    """Whether each buffered item goes: too old, or among the oldest beyond the size that is kept.

    Sizes count to a millionth, so a buffer that holds just ``most`` keeps its
    items, whatever the order in which floating-point sizes are added up.
    """
    fresh = F.col(age) < ttl
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.round(F.sum(F.when(fresh, F.col(size)).otherwise(0)).over(w), 6)  # newest first
    return items.withColumn("evicted", ~fresh | (held > most))


def buffer_stats(items: DataFrame, by: str, size: str, age: str) -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("count"), F.sum(size).alias("bytes"), F.max(age).alias("oldest"), F.min(age).alias("newest"))


def call_stats(calls: DataFrame, by: str, value: str) -> DataFrame:
    r2 = lambda c: F.round(c, 2)
    return calls.groupBy(by).agg(F.count("*").alias("calls"), r2(F.sum(value)).alias("total"), r2(F.avg(value)).alias("avg"), r2(F.min(value)).alias("min"), r2(F.max(value)).alias("max"))


def latest_depth(points: DataFrame, by: str, value: str, at: str, now: Column, seconds: int = 600) -> DataFrame:
    """The last point of each subscription within a window."""
    near = points.where((F.col(at) > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(at) <= now))
    return near.groupBy(by).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def merged_version(df: DataFrame, by: str, version: str) -> DataFrame:
    """The only version of a group, "mixed" for several, empty for none."""
    n = F.count_distinct(version)
    return df.groupBy(by).agg(F.when(n == 0, "").when(n == 1, F.min(version)).otherwise("mixed").alias(version))


def build_decision(*, same_fingerprint: bool, fresh: int, base_exists: bool, compacted: bool, least: int = 1, most: int = 1000) -> str:
    """skip, defer, full or incremental."""
    if same_fingerprint or base_exists and not compacted and fresh == 0:
        return "skip"
    if not base_exists or compacted or fresh > most:
        return "full"
    return "defer" if fresh < least else "incremental"


def transcript_status(enabled: Column, has_audio: Column, has_speech: Column, duration: Column, limit: Column, segments: Column) -> Column:
    return F.when(~enabled, "skipped_by_policy").when(~has_audio, "no_audio_track").when(~has_speech, "no_speech").when((limit > 0) & (duration > limit), "skipped_by_policy").when(segments > 0, "ok").otherwise("failed")


def speech(frames: DataFrame, by: str, db: str, ms: str, *, silence: float = -45.0, least: int = 300) -> DataFrame:
    """Speech and silence of each asset, from frames with their loudness."""
    loud = F.col(db) >= silence
    out = frames.groupBy(by).agg(F.sum(F.when(loud, F.col(ms)).otherwise(0)).alias("speech_ms"), F.sum(F.when(loud, 0).otherwise(F.col(ms))).alias("silence_ms"))
    return out.withColumn("has_speech", F.col("speech_ms") >= max(1, least))


def audio_windows(assets: DataFrame, frames: str, rate: str, *, window_s: float, hop_s: float, most: int, level: Callable[[Column], Column] | None = None, silence_db: float | None = None) -> DataFrame:
    """Hopping windows of each asset: index, start_ms and end_ms; so many at most, which is a setting of the segmenter.

    ``level`` gives a window's loudness by its index; those below silence_db
    go, though they count among the most.
    """
    hop, width = F.greatest(F.lit(1), F.bround(F.col(rate) * hop_s).cast("long")), F.greatest(F.lit(1), F.bround(F.col(rate) * window_s).cast("long"))
    n = F.least(F.lit(most).cast("long"), F.ceil(F.col(frames) / hop))
    out = assets.where(F.col(frames) > 0).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("window") * hop
    ms = lambda f: F.floor(f * 1000 / F.col(rate)).cast("long")
    if level is not None and silence_db is not None:
        out = out.withColumn("level_db", level(F.col("window"))).where(F.col("level_db") >= silence_db)
    return out.withColumn("start_ms", ms(start)).withColumn("end_ms", ms(F.least(F.col(frames), start + width)))


def first_of(values: Column, names: Iterable[str]) -> Column:
    """The first of some aliases in a map whose keys are lower case."""
    return F.coalesce(*[F.try_element_at(values, F.lit(n)) for n in names])


def digits_to_long(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("long"))


def frame_times(log: Column) -> Column:
    """pts_time values of a log, in milliseconds, fractions kept."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.floor(x.cast("double") * 1000).cast("long"))


def stub_embedding(text: str, dim: int) -> list[float]:
    """A unit vector that depends on the text alone: for tests, where no model is at hand."""
    rng = random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
    v = [rng.uniform(-1, 1) for _ in range(dim)]
    size = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / size for x in v]


def sampling_rate(duration_s: Column, *, interval_s: float = 0.0, fps: float = 0.0, most: int = 0) -> Column:
    """Frames a second that a video is sampled at: as set, slower where that would give too many frames, one frame at least."""
    base = interval_s if interval_s > 0 else 1 / fps if fps > 0 else 1.0
    wait = F.lit(float(base))
    if most > 0:
        wait = F.when(duration_s > 0, F.least(duration_s.cast("double"), F.greatest(wait, duration_s / most))).otherwise(wait)
    return 1 / wait


def setting(values: Mapping[str, str], name: str, default, kind: type = str):
    """A setting from a map of texts such as the environment: bool, int, float, a list or a map of weights.

    What can't be read as its kind gives the default.
    """
    raw = values.get(name, "").strip()
    if not raw:
        return default
    if kind is bool:
        return {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}.get(raw.lower(), default)
    try:
        if kind is list:
            return [x.strip() for x in raw.split(",") if x.strip()]
        if kind is dict:
            return {k.strip(): float(v) for k, v in (x.split("=") for x in raw.split(",") if x.strip())}
        return kind(raw)
    except ValueError:
        return default


def environment_setting(name: str, default, kind: type = str):
    return setting(os.environ, name, default, kind)


def stage_of_path(uri: Column, segment: int = 2) -> Column:
    """A segment of a path, without its scheme: the second says of which modality an upload is."""
    parts = F.split(F.trim(F.regexp_replace(uri, "^[a-z0-9+.-]+://[^/]+/", ""), F.lit("/")), "/")
    return F.get(parts, F.lit(segment - 1))


# What can be redacted in each kind of media.
MEDIA_TYPES = {"image": ("faces", "plates"), "video": ("faces", "plates"), "audio": ("voice",)}


def media_redaction(modality: Column, wanted: Column, enabled: bool) -> Column:
    """The plan of a media redaction: what was asked for, what of it applies, and why nothing was done.

    A stub: payloads stay as they are.  "all" stands for all types of a modality.
    """
    known = F.try_element_at(F.create_map(*[x for m, ts in MEDIA_TYPES.items() for x in (F.lit(m), F.array(*map(F.lit, ts)))]), F.lower(F.trim(modality)))
    asked = F.array_distinct(F.transform(F.coalesce(wanted, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))))
    fits = F.when(F.array_contains(asked, "all"), known).otherwise(F.array_intersect(asked, known))
    reason = F.when(known.isNull(), "unsupported_modality").when(F.lit(not enabled), "disabled").when(F.size(fits) == 0, "no_types").otherwise("stub")
    return F.struct(asked.alias("requested"), F.coalesce(fits, F.array().cast("array<string>")).alias("resolved"), F.lit(False).alias("applied"), reason.alias("reason"))


def key_frames(frames: DataFrame, by: str, at: str, change: str, *, threshold: float, least: int, fps: float, tie: tuple[str, ...] = ()) -> DataFrame:
    """The frames of each video at which the scene changes; of a video with fewer than ``least``, frames at a fixed rate.

    Frames come with how much they differ from the one before; a fixed rate
    takes the first frame of each step of 1 / fps seconds.  ``at`` is in
    milliseconds.  Adds reason, scene or rate.
    """
    step = F.floor(F.col(at) * F.lit(fps / 1000))
    cut = F.coalesce(F.col(change) > threshold, F.lit(False))
    own = Window.partitionBy(by)
    marked = frames.withColumn("_cut", cut).withColumn("_cuts", F.sum(F.col("_cut").cast("long")).over(own))
    marked = marked.withColumn("_first", F.row_number().over(Window.partitionBy(by, step).orderBy(at, *tie)) == 1)
    scene = F.col("_cuts") >= least
    kept = marked.where(F.when(scene, F.col("_cut")).otherwise(F.col("_first")))
    return kept.withColumn("reason", F.when(scene, "scene").otherwise("rate")).drop("_cut", "_cuts", "_first")
