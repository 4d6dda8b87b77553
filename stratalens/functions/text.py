"""Text functions: tokens, windows, redaction, highlights, query shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What personal data looks like, in the order of replacement.
PII = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
}
REDACTED = "[REDACTED]"


def tokens(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def redact(text: Column, kinds: tuple[str, ...] = tuple(PII)) -> Column:
    for kind in PII:
        if kind in kinds:
            text = F.regexp_replace(text, PII[kind], REDACTED)
    return text


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def token_f1(text: Column, query: str) -> Column:
    """F1 of the sets of lower-case words of a text and a query; zero if either is empty or nothing is shared."""
    wanted = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    own = word_set(F.coalesce(text, F.lit("")))
    if not wanted:
        return F.lit(0.0)
    asked = F.array(*[F.lit(x) for x in wanted])
    shared = lambda w: F.size(F.array_intersect(w, asked))
    # a lambda's variable is a value: words are made once
    return F.transform(F.array(own), lambda w: F.when(shared(w) == 0, 0.0).otherwise(2.0 * shared(w) / (F.size(w) + len(wanted))))[0]


def highlight(text: Column, query: str, limit: int = 240) -> Column:
    """The sentence that shares most distinct words with the query, the first of equals; cut at a limit."""
    words = sorted(set(query.lower().split()))
    clean = collapse(text)
    wanted = F.array(*[F.lit(x) for x in words]).cast("array<string>")
    sentences = F.filter(F.transform(F.split(clean, r"\."), lambda x: F.trim(x)), lambda s: s != "")
    ranked = F.transform(sentences, lambda s, i: F.struct((-F.size(F.array_intersect(F.split(F.lower(s), " "), wanted))).alias("k"), i.alias("i"), s.alias("s")))
    best = F.when(F.size(ranked) == 0, clean).otherwise(F.array_min(ranked)["s"]) if words else clean
    return F.when(clean != "", F.substring(best, 1, limit))


# What a part of an identifier looks like.
ID_SHAPE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:/-]{3,}")
ID_SIGN = re.compile(r"[0-9._:/-]")
ID_CAPITALS = re.compile(r"[A-Z]{6,}")


def id_like(text: Column) -> Column:
    """Whether a query looks like an identifier: 4 to 128 characters, 3 words at most, each with a digit or sign, or in capitals."""
    t = F.trim(text)
    parts = F.split(t, r"\s+")
    each = F.forall(parts, lambda p: p.rlike(f"^{ID_SHAPE.pattern}$") & (p.rlike(ID_SIGN.pattern) | p.rlike(f"^{ID_CAPITALS.pattern}$")))
    return F.coalesce(F.length(t).between(4, 128) & (F.size(parts) <= 3) & each, F.lit(False))


def chunk_windows(df: DataFrame, text: str = "text", target: int = 128, overlap: int = 16) -> DataFrame:
    """Sliding windows of tokens: chunk_index, token_start, token_end, first_token, last_token, chunk beside the columns of df."""
    step = max(1, target - overlap)
    cut = df.withColumn("_t", tokens(F.col(text))).withColumn("_n", F.size("_t")).where("_n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("_n") - 1), F.lit(step))
    out = cut.select("*", F.posexplode(starts).alias("chunk_index", "token_start"))
    out = out.withColumn("token_end", F.least(F.col("token_start") + target, F.col("_n"))).withColumn("_c", F.slice("_t", F.col("token_start") + 1, target))
    return out.select(*df.columns, F.col("chunk_index").cast("long"), F.col("token_start").cast("long"), F.col("token_end").cast("long"), F.get("_c", F.lit(0)).alias("first_token"), F.element_at("_c", -1).alias("last_token"), F.array_join("_c", " ").alias("chunk"))


def row_to_text(df: DataFrame, columns: list[str]) -> Column:
    """"column: value, column: value" of a row."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns])


def ascii_fold(text: Column) -> Column:
    """ASCII letters for accented ones; what has no ASCII form goes.

    The table is made from Unicode's decompositions of the Latin blocks, so
    the fold stays a JVM expression.
    """
    import unicodedata

    folded = {}
    for code in (*range(0x80, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            folded[chr(code)] = plain
    out = F.translate(text, "".join(folded), "".join(folded.values()))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def base64url(data: Column) -> Column:
    """Base 64 with the alphabet of URLs, without padding and the line breaks that Spark may put after every 76 characters."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    bare = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)))), F.lit("base64"))
