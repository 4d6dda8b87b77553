"""Files as rows: documents, sheets, sound and images read by extension, downloads, deletion."""

from __future__ import annotations

import csv
import io
import re
import struct
import wave
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of elements in office files.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LEGACY = (".doc", ".ppt", ".xls")


class UnsupportedFile(ValueError):
    """A file that can't be read, however often it is tried."""


def files(spark: SparkSession, glob: str) -> DataFrame:
    """uri, extension, length, modified and content of the files under a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    extension = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return found.select(F.col("path").alias("uri"), extension.alias("extension"), "length", F.col("modificationTime").alias("modified"), "content")


def checked(found: DataFrame, max_bytes: int) -> DataFrame:
    """Files within a size, with the sha256 of their content; ``reason`` is set for those beyond it."""
    over = F.col("length") > max_bytes
    return found.select("uri", "extension", "length", F.when(~over, F.col("content")).alias("content"), F.when(~over, F.sha2("content", 256)).alias("sha256"), F.when(over, "too_large").alias("reason"))


def _paragraphs(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" if t.tag == f"{_WORD}t" else "\t" if t.tag == f"{_WORD}tab" else "\n" for t in p.iter() if t.tag in (f"{_WORD}t", f"{_WORD}tab", f"{_WORD}br")) for p in body.iter(f"{_WORD}p"))
    return "\n".join(x for x in lines if x)


def _slides(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for name in names:
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if shape.tag.endswith("}txBody"):
                    lines = ["".join(t.text or "" for t in p.iter(f"{_DRAW}t")) for p in shape.iter(f"{_DRAW}p")]
                    out.append("\n".join(lines))
    return "\n".join(x for x in out if x)


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    value = cell.findtext(f"{_SHEET}v") or ""
    return shared[int(value)] if cell.get("t") == "s" and value else value


def sheet_rows(data: bytes) -> list[list[str]]:
    """Cells of the first sheet of a workbook, row by row, empty where there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        sheet = ElementTree.fromstring(z.read(first))
    rows = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.iter(f"{_SHEET}c")):
            letters = re.match("[A-Z]+", c.get("r") or "")
            at = i
            if letters:
                at = 0
                for x in letters[0]:
                    at = 26 * at + ord(x) - 64
                at -= 1
            cells[at] = _cell(c, shared)
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def lines_of_table(rows: list[list[str]]) -> str:
    """"column: value, column: value" of each row below the head."""
    if not rows:
        return ""
    head, *body = rows
    return "\n".join(", ".join(f"{c}: {r[i] if i < len(r) else ''}" for i, c in enumerate(head)) for r in body)


_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|\bT[dD*]\b|\bET\b|'", re.S)
_PDF_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|.))", re.S)
_PDF_SIGNS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(data: bytes) -> str:
    """Strings that the content streams of a PDF show, for files with simple fonts: plain or deflated streams, no encryption, no character maps."""
    if b"/Encrypt" in data:
        raise UnsupportedFile("an encrypted PDF")
    out = []
    for m in re.finditer(rb"<<((?:[^<>]|<<.*?>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?\bET\b)", body, re.S):
            text = b""
            for t in _PDF_TEXT.findall(block):
                if t[:1] == b"(":
                    text += _PDF_ESCAPE.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1] else _PDF_SIGNS.get(e[2], b"" if e[2][:1] in b"\r\n" else e[2]), t[1:-1])
                elif text and not text.endswith(b"\n"):
                    text += b"\n"
            out.append(text.decode("latin-1").rstrip("\n"))
    return "\n".join(x for x in out if x)


def text_of(data: bytes, extension: str) -> str:
    """The text of a file by its extension; anything unknown is read as UTF-8, wrong bytes left out."""
    if extension in LEGACY:
        raise UnsupportedFile(f"legacy format {extension}")
    if extension == ".docx":
        return _paragraphs(data)
    if extension == ".pptx":
        return _slides(data)
    if extension == ".xlsx":
        return lines_of_table(sheet_rows(data))
    if extension in (".csv", ".tsv"):
        return lines_of_table(list(csv.reader(io.StringIO(data.decode("utf-8", "ignore")), delimiter="," if extension == ".csv" else "\t")))
    if extension == ".pdf":
        return pdf_text(data)
    return data.decode("utf-8", "ignore")


def read_texts(found: DataFrame) -> DataFrame:
    """uri, text and error of files (uri, extension, content); a file that can't be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for extension, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                try:
                    texts.append(text_of(data.as_py() or b"", extension or ""))
                    errors.append(None)
                except (UnsupportedFile, zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["uri", "text", "error"])

    return found.select("uri", "extension", "content").mapInArrow(run, "uri string, text string, error string")


def chunk_texts(df: DataFrame, text: str = "text", target: int = 128, overlap: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Sliding windows of tokens with the characters they span, cut out of the text as it stands.

    Tokens are runs that aren't white space.  Adds chunk_index, char_start,
    char_end, token_start, token_end and chunk to all columns, or to those in
    ``keep``; a text without tokens has none.
    """
    step = max(1, target - overlap)
    own = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    kept = df.select(*(df.columns if keep is None else keep))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return df.select(*kept.columns, own).mapInArrow(_windows(target, step), f"{kinds}, {CHUNKS}")


CHUNKS = "chunk_index long, char_start long, char_end long, token_start long, token_end long, chunk string"
#: Characters of windows that leave a task at once, about.
CHUNK_CHARS = 1 << 22


def _windows(target: int, step: int):
    """An Arrow function from rows to their windows, the text last, in time that grows with the text."""
    names = ["chunk_index", "char_start", "char_end", "token_start", "token_end", "chunk"]
    types = [pa.int64()] * 5 + [pa.string()]

    def cut(batches):
        token = re.compile(r"\S+", re.ASCII)
        for batch in batches:
            kept, of, columns, held = batch.columns[:-1], [], [[] for _ in names], 0
            beside = sum(c.nbytes for c in kept) // max(1, batch.num_rows)
            made = lambda: pa.RecordBatch.from_arrays([*[c.take(pa.array(of, pa.int64())) for c in kept], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*batch.schema.names[:-1], *names])  # noqa: B023, E731
            for row in range(batch.num_rows):
                content = batch.columns[-1][row].as_py()
                spans = [m.span() for m in token.finditer(content)]
                for i, at in enumerate(range(0, len(spans), step)):
                    to = min(at + target, len(spans))
                    first, last = spans[at][0], spans[to - 1][1]
                    of.append(row)
                    for column, value in zip(columns, (i, first, last, at, to, content[first:last])):
                        column.append(value)
                    held += last - first + beside
                    if held >= CHUNK_CHARS:
                        yield made()
                        of, columns, held = [], [[] for _ in names], 0
            if of:
                yield made()

    return cut


# --- sound and images, by their heads


def sound_facts(data: bytes) -> dict:
    """Rate, channels, frames and milliseconds of a WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        rate, frames = w.getframerate(), w.getnframes()
        return {"rate": rate, "channels": w.getnchannels(), "width": w.getsampwidth(), "frames": frames, "duration_ms": frames * 1000 // rate if rate else 0}


def loudness(data: bytes, window_s: float, hop_s: float, most: int) -> list[tuple[int, int, float]]:
    """(start_ms, end_ms, decibels) of hopping windows of a WAV file with whole-byte samples; decibels against the largest sample."""
    import numpy as np

    with wave.open(io.BytesIO(data)) as w:
        rate, width, total = w.getframerate(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(total)
        channels = w.getnchannels()
    if width == 1:
        samples = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    else:
        spread = np.frombuffer(raw, np.uint8).reshape(-1, width)
        wide = np.zeros((len(spread), 4), np.uint8)
        wide[:, 4 - width :] = spread
        samples = (wide.view("<i4").ravel() >> (8 * (4 - width))).astype(np.float64)
    samples = samples.reshape(-1, channels)
    size, hop = max(1, round(rate * window_s)), max(1, round(rate * hop_s))
    out = []
    for start in range(0, total, hop)[:most]:
        part = samples[start : start + size]
        rms = float(np.sqrt(np.mean(part**2))) if part.size else 0.0
        level = 20 * np.log10(rms / (1 << (8 * width - 1))) if rms > 0 else float("-inf")
        out.append((start * 1000 // rate, min(total, start + size) * 1000 // rate, float(level)))
    return out


def sound_windows(found: DataFrame, *, window_s: float, hop_s: float, most: int, silence_db: float | None = None) -> DataFrame:
    """Hopping windows of WAV files (uri, content) that are loud enough: uri, window, start_ms, end_ms, level_db.

    ``most`` windows of a file are looked at, a setting of the segmenter;
    silent ones count among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found_windows = loudness(data.as_py() or b"", window_s, hop_s, most)
                except (wave.Error, EOFError):
                    continue
                rows += [(uri, i, *w) for i, w in enumerate(found_windows) if silence_db is None or w[2] >= silence_db]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["uri", "window", "start_ms", "end_ms", "level_db"])

    return found.select("uri", "content").mapInArrow(run, "uri string, window long, start_ms long, end_ms long, level_db double")


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of a PNG, GIF or JPEG file, from its head."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return ("gif", *struct.unpack("<HH", data[6:10]))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("jpeg", width, height)
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def spoken(text: Column, duration_ms: Column) -> Column:
    """Stand-in for a transcriber: one segment that spans the file."""
    return F.array(F.struct(F.lit(0).cast("long").alias("start_ms"), duration_ms.cast("long").alias("end_ms"), F.coalesce(text, F.lit("")).alias("text")))


def read_off(tokens: Column, *, min_confidence: float = 0, min_length: int = 0) -> Column:
    """Text and mean confidence of the tokens (text, conf) of an image that are sure enough.

    Blank tokens don't count, nor do those without a confidence; a text that
    is too short is empty.  The mean is rounded half to even, to two digits.
    """
    seen = F.filter(tokens, lambda t: F.length(F.trim(t["text"])) > 0)
    kept = F.filter(seen, lambda t: t["conf"] >= F.lit(float(min_confidence)))
    text = F.array_join(F.transform(kept, lambda t: F.trim(t["text"])), " ")
    mean = F.aggregate(kept, F.lit(0.0), lambda a, t: a + t["conf"]) / F.when(F.size(kept) > 0, F.size(kept))
    short = F.length(text) < min_length
    return F.struct(
        F.when(short, "").otherwise(text).alias("text"), F.when(~short, F.bround(mean, 2)).alias("confidence"),
        F.when(short, 0).otherwise(F.size(kept)).cast("long").alias("kept_tokens"), F.size(seen).cast("long").alias("raw_tokens"),
    )


def delete_files(spark: SparkSession, candidates: DataFrame, batch: int = 1000) -> int:
    """Delete files by their own file systems; uris come to the driver in batches, as file operations do anyway."""
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    path = spark._jvm.org.apache.hadoop.fs.Path
    for row in candidates.select("uri").repartition(max(1, batch // 1000)).toLocalIterator():
        target = path(row.uri)
        gone += bool(target.getFileSystem(conf).delete(target, False))
    return gone


def thumbnail(data: bytes, width: int) -> bytes | None:
    """A PNG of 8-bit grey, RGB or RGBA samples, scaled down to a width with its aspect kept; None for other images.

    Each pixel is the mean of those it stands for; smaller images stay as they are.
    """
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[24] != 8 or data[25] not in (0, 2, 6) or data[28]:
        return None
    w, h = struct.unpack(">II", data[16:24])
    depth, at, packed = {0: 1, 2: 3, 6: 4}[data[25]], 8, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        packed += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += size + 12
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * depth)
    above, rows = np.zeros(w * depth, np.int32), []
    for line in raw:
        row = line[1:].astype(np.int32)
        if line[0] == 2:
            row = (row + above) & 255
        elif line[0]:
            for i in range(row.size):  # each sample needs the one before it
                a = row[i - depth] if i >= depth else 0
                b, c = above[i], above[i - depth] if i >= depth else 0
                if line[0] == 1:
                    guess = a
                elif line[0] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = (row[i] + guess) & 255
        rows.append(row)
        above = row
    pixels = np.stack(rows).reshape(h, w, depth).astype(np.float64)
    if w > width:
        height = max(1, round(h * width / w))
        ys, xs = np.arange(height) * h // height, np.arange(width) * w // width
        sums = np.add.reduceat(np.add.reduceat(pixels, ys, axis=0), xs, axis=1)
        area = np.diff(np.r_[ys, h])[:, None] * np.diff(np.r_[xs, w])[None, :]
        pixels = sums / area[:, :, None]
    small = np.clip(np.round(pixels), 0, 255).astype(np.uint8)
    lines = np.concatenate([np.zeros((len(small), 1), np.uint8), small.reshape(len(small), -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", small.shape[1], small.shape[0], 8, data[25], 0, 0, 0)
    return data[:8] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
